"""The primitives by name: what the query language can call.

A name is looked up as it is, then without a leading ``mysql.``, then without its first part up to an underscore, so
names with a library's prefix (``xyz_reduce``) resolve too. Leading type names (``'xyz_double'``) of the array primitives are
accepted and taken as casts of the result only where the output type differs from the input type.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import aggregate
from . import arrays, index, signal, stats


@dataclass(frozen=True)
class Primitive:
    name: str
    build: Callable[..., Column]
    #: Least and most arguments, without leading type names (None: any number more).
    least: int
    most: int | None
    #: simple: a Column of a row. aggregate: built from the elements at a position, an aggregate over the rows of a group, which
    #: gives an element of the result. rows: built from the cells and the row keys, an aggregate that gives the whole result.
    kind: str = "simple"
    #: integer, real, or array.
    returns: str = "array"


REGISTRY: dict[str, Primitive] = {}
TYPE_NAMES = frozenset([*arrays.TYPES, "string", "complex"])


def register(name: str, build: Callable[..., Column], least: int, most: int | None = -1, kind: str = "simple", returns: str = "array") -> None:
    """Add a primitive, an aggregate one too; ``most`` of -1 means as many as ``least``."""
    REGISTRY[name] = Primitive(name, build, least, least if most == -1 else most, kind, returns)


def resolve(name: str) -> Primitive:
    key = name.lower().removeprefix("mysql.")
    for found in (key, key.partition("_")[2]):
        if found in REGISTRY:
            return REGISTRY[found]
    raise ValueError(f"unknown function {name!r}")


def is_type(value: Any) -> bool:
    return isinstance(value, str) and value.lower().rsplit("_", 1)[-1] in TYPE_NAMES


def call(primitive: Primitive, args: list[Any]) -> Column:
    """The primitive on arguments: Columns, numbers and strings."""
    if primitive.kind in ("aggregate", "rows"):
        raise ValueError("an aggregate primitive stands at the top of a field, or under simple primitives")
    kinds = []
    while args and primitive.kind != "index" and is_type(args[0]) and len(kinds) < 2:
        kinds.append(arrays._tail(args[0]))
        args = args[1:]
    if len(args) < primitive.least or (primitive.most is not None and len(args) > primitive.most):
        raise ValueError(f"{primitive.name} takes {primitive.least}" + ("" if primitive.most == primitive.least else f" to {primitive.most or 'more'}") + f" arguments, not {len(args)}")
    out = primitive.build(*args)
    if len(kinds) == 2 and kinds[0] != kinds[1] and primitive.returns == "array" and kinds[1] in arrays.TYPES:
        out = out.cast(f"array<{arrays.TYPES[kinds[1]]}>")
    return out


def _column(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _int(x: Any) -> int:
    if isinstance(x, Column):
        raise ValueError("a literal number is needed here")
    return int(x)


def _list(x: Any) -> list:
    """A literal list: '1,2,3', or a number alone."""
    return list(ast.literal_eval(f"[{x}]")) if isinstance(x, str) else [x]


def _ranges(x: Any) -> list[tuple[int, int, int]]:
    """'1:2:9,12' is the positions 1, 3, ..., 9 and 12."""
    out = []
    for part in str(x).split(","):
        n = [int(v) for v in part.split(":")]
        out.append((n[0], n[1], n[2]) if len(n) == 3 else (n[0], 1, n[-1]))
    return out


def _element(text: Any) -> Callable[[Column], Column]:
    """An expression of ``x`` (and ``y``), or a number, as a function of the element."""
    from ..plans.expression import compile_expression

    return lambda x, *y: compile_expression(str(text), {"x": x, **({"y": y[0]} if y else {})}.__getitem__)


def _chain(test: Any, then: Any, other: Any = "NULL") -> tuple[Callable, Callable, Callable]:
    holds = _element(test)
    return lambda *x: holds(*x).cast("double") != 0, _element(then), _element(other)


for _name, _build, _least, _most in (
    ("id", index.block_id, 2, -1),
    ("id2", index.block_id2, 3, -1),
    ("id3", lambda k, s, b: index.block_id3(k, s if isinstance(s, Column) else F.array(*[F.lit(int(v)) for v in _list(s)]), b), 3, -1),
    ("id_to_index", index.id_to_index, 2, None),
    ("id_to_index2", index.id_to_index2, 3, -1),
    ("is_in_subset", index.is_in_subset, 4, -1),
    ("id_of_subset", index.id_of_subset, 3, 4),
):
    register(_name, _build, _least, _most, "index", "integer")

for _name, _build, _least, _most in (
    ("abs_array", arrays.abs_array, 1, -1),
    ("accumulate", arrays.accumulate, 1, -1),
    ("append", arrays.concat, 1, None),
    ("arg_array", arrays.arg_array, 1, -1),
    ("cast", lambda m, kind="double": arrays.cast(m, kind), 1, 2),
    ("ccluster_kcluster", lambda m, k, rounds=50: signal.kcluster(m, _int(k), _int(rounds)), 2, 3),
    ("compress", arrays.compress, 1, -1),
    ("concat", arrays.concat, 1, None),
    ("concat2", arrays.concat, 1, None),
    ("deaccumulate", arrays.deaccumulate, 1, -1),
    ("div_array", arrays.div_array, 2, -1),
    ("dump", arrays.dump, 1, 2),
    ("expand", lambda m, n: arrays.expand(m, _int(n)), 2, -1),
    ("extend", lambda m, n: arrays.extend(m, _int(n)), 2, -1),
    ("extract", lambda m, at: arrays.extract(m, at if isinstance(at, Column) else F.array(*[F.lit(int(v)) for v in _list(at)])), 2, -1),
    ("filter", lambda m, taps: signal.convolve(m, [float(v) for v in _list(taps)]), 2, -1),
    ("get_index_array", arrays.get_index_array, 1, -1),
    ("get_subarray", lambda m, start=1, count=None, step=1: arrays.get_subarray(m, _int(start), None if count is None else _int(count), _int(step)), 1, 4),
    ("get_subarray2", lambda m, r: arrays.get_subarray2(m, _ranges(r)), 2, -1),
    ("get_subarray3", lambda m, *dims: arrays.get_subarray3(m, [(_int(b), _int(n), 0, _ranges(r)) for r, b, n in zip(dims[::3], dims[1::3], dims[2::3], strict=True)]), 4, None),
    ("gsl_boxplot", stats.boxplot, 1, -1),
    ("gsl_complex_get_abs", stats.complex_get_abs, 1, -1),
    ("gsl_complex_get_arg", stats.complex_get_arg, 1, -1),
    ("gsl_complex_get_imag", stats.complex_get_imag, 1, -1),
    ("gsl_complex_get_real", stats.complex_get_real, 1, -1),
    ("gsl_complex_to_polar", stats.complex_to_polar, 1, -1),
    ("gsl_complex_to_rect", stats.complex_to_rect, 1, -1),
    ("gsl_correlation", stats.correlation, 2, -1),
    ("gsl_dwt", signal.dwt, 1, -1),
    ("gsl_fft", signal.fft, 1, -1),
    ("gsl_fit_linear", stats.fit_linear, 1, 2),
    ("gsl_fit_linear_coeff", stats.fit_linear_coeff, 1, 2),
    ("gsl_histogram", lambda m, n, low=None, high=None: stats.histogram(m, _int(n), low, high), 2, 4),
    ("gsl_idwt", signal.idwt, 1, -1),
    ("gsl_ifft", signal.ifft, 1, -1),
    ("gsl_quantile", lambda m, *q: stats.quantile(m, *[float(v) for x in q for v in _list(x)]), 2, None),
    ("gsl_sd", stats.sd, 1, -1),
    ("gsl_sort", stats.sort, 1, -1),
    ("gsl_spline", lambda m, n: signal.spline(m, _int(n)), 2, -1),
    ("gsl_stats", stats.stats, 1, -1),
    ("interlace", arrays.interlace, 1, None),
    ("interlace2", arrays.interlace, 1, None),
    ("mask_array", arrays.mask_array, 2, -1),
    ("math", lambda m, f: arrays.math(m, str(f)), 2, -1),
    ("max_array", arrays.max_array, 2, None),
    ("min_array", arrays.min_array, 2, None),
    ("moving_avg", lambda m, w: arrays.moving_avg(m, _int(w)), 2, -1),
    ("mul_array", arrays.mul_array, 2, None),
    ("mul_scalar", arrays.mul_scalar, 1, 2),
    ("mul_scalar2", arrays.mul_scalar, 1, 2),
    ("normalize", arrays.normalize, 1, -1),
    ("operation_array", lambda op, *m: arrays.operation_array(str(op), *m), 2, None),
    ("operator", lambda m, op: arrays.operator(m, str(op)), 2, -1),
    ("operator_array", lambda a, b, op="sum": arrays.operator_array(a, b, str(op)), 2, 3),
    ("padding", lambda m, n, v=0.0, before=0: arrays.padding(m, _int(n), v, _int(before)), 2, 4),
    ("permute", lambda m, sizes, order: arrays.permute(m, _list(sizes), _list(order)), 3, -1),
    ("predicate", lambda m, *c: arrays.predicate(m, *_chain(*c)), 3, 4),
    ("predicate2", lambda a, b, *c: arrays.predicate2(a, b, *_chain(*c)), 4, 5),
    ("quantize", arrays.quantize, 3, -1),
    ("reduce", lambda m, op="avg", block=0, *_: arrays.reduce(m, str(op), _int(block)), 1, 4),
    ("reduce2", lambda m, op, block, inner: arrays.reduce2(m, str(op), _int(block), _int(inner)), 4, -1),
    ("reduce3", lambda m, op, sizes: arrays.reduce3(m, str(op), _list(sizes)), 3, -1),
    ("replace", arrays.replace, 3, -1),
    ("reverse", arrays.reverse, 1, -1),
    ("rotate", lambda m, n=1: arrays.rotate(m, _int(n)), 1, 2),
    ("sequence", lambda start, step, n: arrays.sequence(float(start), float(step), _int(n)), 3, -1),
    ("shift", lambda m, n=1, v=0.0: arrays.shift(m, _int(n), v), 1, 3),
    ("sub_array", arrays.sub_array, 2, -1),
    ("sum_array", arrays.sum_array, 2, None),
    ("sum_scalar", arrays.sum_scalar, 1, 2),
    ("sum_scalar2", arrays.sum_scalar, 1, 2),
    ("to_bin", lambda t, sep=",": arrays.to_bin(_column(t), "double", sep), 1, 2),
    ("uncompress", arrays.uncompress, 1, -1),
    ("value_to_bin", lambda x: arrays.value_to_bin(_column(x)), 1, -1),
):
    register(_name, _build, _least, _most)

for _name, _build, _least, _most, _returns in (
    ("compare", arrays.compare, 2, -1, "integer"),
    ("convert_d", arrays.convert_d, 1, -1, "real"),
    ("convert_l", arrays.convert_l, 1, -1, "integer"),
    ("count_array", arrays.count_array, 1, -1, "integer"),
    ("find", arrays.find, 2, -1, "integer"),
    ("size_array", arrays.size_array, 1, -1, "integer"),
):
    register(_name, _build, _least, _most, returns=_returns)


def _operator(x: Column, name: Any = "sum") -> Column:
    return aggregate.OPERATORS[str(name).lower().rsplit("_", 1)[-1]](x).cast("double")


def _stats(x: Column, *_: Any) -> Column:
    """A struct of the statistics by name, where numbers in a fixed order would need their meaning remembered."""
    return F.struct(*[c.alias(n) for n, c in aggregate.full_stats(x).items()])


def _state(x: Column, *_: Any) -> Column:
    return F.struct(*[c.alias(n) for n, c in aggregate.partial_state(x).items()])


for _name, _build in (("aggregate_operator", _operator), ("aggregate_stats", _stats), ("aggregate_stats_partial", _state), ("aggregate_stats_final", _stats)):
    register(_name, _build, 1, 2, "aggregate")
register("roll_up", aggregate.in_order, 1, 2, "rows")
