"""The outer query language: ``key=value;`` pairs, whose values may be lists with ``|``. Quotes and parentheses protect both."""

from __future__ import annotations


class LanguageError(ValueError):
    """The text is no statement."""


def split(text: str, separator: str) -> list[str]:
    """The parts between separators outside quotes and parentheses."""
    parts, quote, depth, start, i = [], "", 0, 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == separator and depth <= 0:
            parts.append(text[start:i])
            start = i + 1
        i += 1
    if quote:
        raise LanguageError(f"a quote is not closed in {text!r}")
    return [*parts, text[start:]]


def statement(text: str) -> dict[str, str]:
    """The keys (lower case) and values of a statement; of a key given twice the first counts."""
    out: dict[str, str] = {}
    for part in split(text, ";"):
        if not part.strip():
            continue
        key, sign, value = part.partition("=")
        if not sign or not key.strip():
            raise LanguageError(f"key=value expected, not {part.strip()!r}")
        out.setdefault(key.strip().lower(), value.strip())
    if "operation" not in out:
        raise LanguageError("a statement needs operation=")
    return out


def values(text: str) -> list[str]:
    return [v.strip() for v in split(text, "|")]


def unquoted(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text
