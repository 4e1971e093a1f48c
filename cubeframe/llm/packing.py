"""Mixture-controlled packing of tokenised documents into sequences of fixed length.

Every source is a queue of tokens. Windows of ``WINDOW`` sequences are filled by deficit round-robin: in each window every queue that has tokens
left gets a credit in proportion to its target, serves the whole tokens of the credit and carries the fraction (the deficit) on, from window to window and
whichever partitions its documents lie in. A queue that is empty leaves its share to the others, by their targets. Without targets
the shares are those of the whole corpus, so all queues end together and every window has the mixture of the whole.

What a queue has served after w windows is a closed form (``Schedule``): at a virtual time v it is ``min(size, target * v)``, and v follows from the
tokens of w windows. So a document's pieces follow from its place in its queue alone, without a sequential pass: a place is the sum of the
tokens of its queue in earlier partitions (a table of one row per partition and queue) and before it in its own.

The windows lie end to end in sequences of ``length`` tokens, so documents and windows are cut at sequence ends, and only the
last sequence is padded.

Defined cases: a null text is empty and packs as the end token alone; a null source is a queue of its own (its target is that of None); rows that
repeat are packed each; a text of any length is taken whole, and worked on in runs cut at white space; other columns are not read, whatever their names;
an empty table gives an empty result. The queues' names and sizes come to the driver and go to every task: a row each, ``MOST_QUEUES`` at most, beyond
which sources share queues by hash; nothing is dropped.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._store import materialize, ship

LENGTH = 4096
#: Sequences in a window.
WINDOW = 64
MOST_QUEUES = 1 << 20
#: Rows of the partition and queue table that are broadcast (about 50 MB); beyond it the join shuffles.
BROADCAST_PLACES = 1 << 20
#: Pieces of text whose ids a worker remembers in each of two generations, and the longest that is remembered (some 15 MB a generation).
CACHED, LONGEST = 100_000, 48
#: Characters of text that are encoded at once.
RUN = 1 << 20

#: Texts that need no normaliser but lower case: ASCII but controls other than white space, and the letters of Latin-1.
_PLAIN = re.compile("[\\t\\n\\x0b\\x0c\\r -~À-ÖØ-öø-ÿ]*")
#: What such texts, in lower case, are split into (a fixed pattern of this kind of tokenizer): words, digits, suffixes, signs.
_SPLIT = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-zß-öø-ÿ0-9]+")
_encoders: dict[tuple[str, bool], Callable[[list[str]], list[bytes]]] = {}


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if it is a printable Latin-1 character, else the next of U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def _runs(text: str, most: int) -> Iterator[str]:
    """The text in runs of about ``most`` characters, cut at white space."""
    at = 0
    while len(text) - at > most:
        found = re.compile(r"[ \n]").search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encoder(path: str, specials_are_text: bool = False) -> Callable[[list[str]], list[bytes]]:
    """Encodes texts to little-endian 16-bit ids with the tokenizer file at ``path`` (a lower-case BPE of words, which keeps white-space-separated words apart).

    Plain texts are lower-cased and split here, and each piece goes to the BPE model once and is remembered: the last pieces used, in two
    generations. Other texts, and those that may hold a special token, go to the tokenizer itself.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = specials_are_text
    model, letters = tokenizer.model, _byte_letters()
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}

    def learn(pieces: set[str]) -> None:
        for piece in pieces:
            found = old.get(piece)
            if found is None:
                known = piece if piece.isascii() else "".join([letters[b] for b in piece.encode()])
                found = array("H", [t.id for t in model.tokenize(known)]).tobytes()
            young[piece] = found

    def plain(text: str) -> bytes:
        nonlocal young, old
        out = []
        for run in _runs(text, RUN):
            pieces = _SPLIT.findall(run.lower())
            new = set(pieces).difference(young)
            learn(new)
            out.append(b"".join(map(young.__getitem__, pieces)))
            for piece in [x for x in new if len(x) > LONGEST]:
                del young[piece]
            if len(young) > CACHED:
                young, old = {}, young if len(young) <= 2 * CACHED else {}
        return b"".join(out)

    def other(text: str) -> bytes:
        # Special tokens are found in the whole text; any other text may be cut at white space.
        runs = [text] if any(s in text for s in specials) else _runs(text, RUN)
        return b"".join([array("H", tokenizer.encode(run, add_special_tokens=False).ids).tobytes() for run in runs])

    def encode(texts: list[str]) -> list[bytes]:
        return [plain(t) if _PLAIN.fullmatch(t) and not any(s in t for s in specials) else other(t) for t in texts]

    return encode


def _tokenise(path: str, end: int, specials_are_text: bool):
    schema = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("queue", pa.string()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = (path, specials_are_text)
        if key not in _encoders:
            _encoders[key] = encoder(*key)
        part, served, tail = TaskContext.get().partitionId(), {}, np.array([end], "<u2").tobytes()
        for whole in batches:
            for batch in _text.slices(whole, "text"):
                queues, before, sizes, ids = batch.column(1).to_pylist(), [], [], []
                for queue, own in zip(queues, _encoders[key]([t or "" for t in batch.column(2).to_pylist()]), strict=True):
                    own += tail
                    before.append(served.get(queue, 0))
                    sizes.append(len(own) // 2)
                    served[queue] = before[-1] + sizes[-1]
                    ids.append(own)
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([part] * len(ids), pa.int32()), batch.column(1).cast(pa.string()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return _text.frugal(work), "id long, part int, queue string, before long, n long, ids binary"


class Schedule:
    """The windows of deficit round-robin over queues of the given sizes, by targets (the sizes themselves without them)."""

    def __init__(self, sizes: list[int], length: int = LENGTH, window: int = WINDOW, targets: list[float] | None = None):
        self.sizes, self.length, self.total = np.array(sizes, np.int64), length, int(sum(sizes))
        self.windows = max(1, -(-self.total // (length * window)))
        self.targets = np.array(sizes if targets is None else targets, np.float64)
        if (self.targets[self.sizes > 0] <= 0).any():
            # Queues without a target come when the others are empty.
            self.targets = np.where(self.targets > 0, self.targets, self.targets.max(initial=1.0) * 1e-12)
        ends = np.divide(self.sizes, self.targets, out=np.zeros(len(self.sizes)), where=self.targets > 0)
        order = np.argsort(ends, kind="stable")
        # Virtual times at which queues end, the tokens served by then, and the targets of those still open after.
        self.ends = ends[order].tolist()
        done = np.cumsum(self.sizes[order])
        open_ = self.targets.sum() - np.cumsum(self.targets[order])
        self.by_then = (done + np.maximum(open_, 0.0) * ends[order]).tolist()
        self.rates = np.maximum(open_, 0.0).tolist()
        self.all = float(self.targets.sum())
        self.layout = lru_cache(max(4, (1 << 18) // max(1, len(sizes))))(self._layout)
        self.last: dict[int, int] = {}

    def time(self, windows: int) -> float:
        """The virtual time after so many windows."""
        tokens = self.total * windows / self.windows
        k = bisect_left(self.by_then, tokens)
        if k == len(self.by_then):
            return float("inf")
        before, at, rate = (self.by_then[k - 1], self.ends[k - 1], self.rates[k - 1]) if k else (0.0, 0.0, self.all)
        return min(self.ends[k], at + (tokens - before) / rate) if rate > 0 else self.ends[k]

    def served(self, queue: int, windows: int) -> int:
        """Tokens of the queue in the first windows; the deficit carried on is the fraction that is cut off."""
        size = int(self.sizes[queue])
        if windows >= self.windows:
            return size
        return int(min(float(size), float(self.targets[queue]) * self.time(windows)))

    def _served(self, windows: int) -> np.ndarray:
        """As ``served``, of all queues."""
        if windows >= self.windows:
            return self.sizes
        return np.minimum(self.sizes.astype(np.float64), self.targets * self.time(windows)).astype(np.int64)

    def _layout(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each queue what it served before the window and after it, and where its run starts, in tokens from the first sequence on."""
        before, after = self._served(window), self._served(window + 1)
        return before, after, int(before.sum()) + np.cumsum(after - before) - (after - before)

    def window(self, queue: int, place: int) -> int:
        """The window that serves the queue's token at the place."""
        last = self.last.get(queue, 0)
        for w in (last, last + 1):
            if w < self.windows and self.served(queue, w) <= place < self.served(queue, w + 1):
                break
        else:
            low, high = 0, self.windows - 1
            while low < high:
                middle = (low + high) // 2
                if self.served(queue, middle + 1) > place:
                    high = middle
                else:
                    low = middle + 1
            w = low
        self.last[queue] = w
        return w

    def pieces(self, queue: int, first: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) of the n tokens of the queue from the first-th on."""
        done = 0
        while done < n:
            place = first + done
            before, after, starts = self.layout(self.window(queue, place))
            left = min(n - done, int(after[queue]) - place)
            at = int(starts[queue]) + place - int(before[queue])
            while left:
                sequence, offset = divmod(at, self.length)
                take = min(left, self.length - offset)
                yield done, take, sequence, offset
                done, at, left = done + take, at + take, left - take


def _cut(plan: Broadcast, length: int, window: int):
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([("id", pa.int64()), *[(x, pa.int64()) for x in names], ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, targets = plan.value
        schedule = Schedule(sizes, length, window, targets)
        for batch in batches:
            docs, queues, firsts, ns, ids = (batch.column(i) for i in range(5))
            rows: list[tuple] = []
            for doc, queue, first, n, own in zip(docs.to_pylist(), queues.to_pylist(), firsts.to_pylist(), ns.to_pylist(), ids, strict=True):
                tokens = np.frombuffer(own.as_buffer(), "<u2")
                for start, take, sequence, offset in schedule.pieces(queue, first, n):
                    cut = tokens[start : start + take]
                    rows.append((doc, start, take, zlib.crc32(cut.astype("<u4").tobytes()), n, sequence, offset, cut.tobytes()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return _text.frugal(work), "id long, " + ", ".join(f"{x} long" for x in names) + ", ids binary"


def pack(docs: DataFrame, tokenizer: str, end: int = 2, length: int = LENGTH, window: int = WINDOW, targets: dict[str | None, float] | None = None, specials_are_text: bool = False, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids (little-endian, 16 bits).

    ``tokenizer`` is the path of a tokenizer file with ids below 65536; ``end`` closes every document. ``targets`` are the proportions of the
    sources in every window (a source without one, or of 0, comes when the others are empty); without them they are the corpus's own. With
    ``specials_are_text``, the strings of special tokens in a text are ordinary text, else what the tokenizer makes of them.
    """
    spark = docs.sparkSession
    ship(spark)
    queue = F.col(source).cast("string")
    if docs.select(queue).distinct().limit(MOST_QUEUES + 1).count() > MOST_QUEUES:
        if targets is not None:
            raise ValueError(f"targets are for {MOST_QUEUES} sources at most")
        queue = F.pmod(F.xxhash64(queue), F.lit(MOST_QUEUES)).cast("string")
    work, types = _tokenise(tokenizer, end, specials_are_text)
    tokens = materialize(docs.select(F.col(ident).cast("long").alias("id"), queue.alias("queue"), F.col(text).alias("text")).mapInArrow(work, types), "tokens")
    places = materialize(tokens.groupBy("part", "queue").agg(F.sum("n").alias("own")), "places")
    totals = places.groupBy("queue").agg(F.sum("own").alias("total")).collect()  # at most MOST_QUEUES rows and one for null
    totals.sort(key=lambda r: (r["queue"] is None, r["queue"] or ""))
    shares = None if targets is None else [float(targets.get(r["queue"], 0.0)) for r in totals]
    plan = spark.sparkContext.broadcast(([r["total"] for r in totals], shares))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbers = spark.createDataFrame([(r["queue"], i) for i, r in enumerate(totals)], "_cf_queue string, number int")
    known = places.withColumn("earlier", F.coalesce(F.sum("own").over(earlier), F.lit(0))).join(F.broadcast(numbers), F.col("queue").eqNullSafe(F.col("_cf_queue"))).select(F.col("part").alias("_cf_part"), "_cf_queue", "number", "earlier")
    if places.count() <= BROADCAST_PLACES:
        known = F.broadcast(known)
    placed = tokens.join(known, (F.col("part") == F.col("_cf_part")) & F.col("queue").eqNullSafe(F.col("_cf_queue")))
    cut, kind = _cut(plan, length, window)
    return placed.select("id", "number", (F.col("earlier") + F.col("before")).alias("first"), "n", "ids").mapInArrow(cut, kind).withColumnRenamed("id", ident)
