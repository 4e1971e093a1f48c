"""The queries of the array engine on the driver's tables, and the SQL they are held against.

Arrays are returned a row per element (id_dim, pos, v), rounded, so that neither the order of sums nor the form of lists matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arrays, index, registry, signal, stats
from .operators import aggregate, extra, select
from .plans.session import Session, fragment_size
from .sources import cube, generate
from .streaming import windows

DIGITS = 4
HOURS = [cube.Dim("user", 1 << 20, True), cube.Dim("hour", 24, False)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("id_dim"), F.col("embedding").cast("array<double>").alias("measure"))


def order_lines(spark: SparkSession, sf_dir: str, value: str = "l_extendedprice") -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col(value).alias("v"))))
    return _table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") + 1).alias("id_dim")).agg(F.transform(cells, lambda s: s["v"]).alias("measure"))


def hour_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table user, hour, value: sums of events.

    Values are added one by one in the order of the events, as a sum of doubles depends on it and a cut like ``floor`` shows its last bit; so the
    files and partitions that events lie in don't matter. The last running sum of a cell is its sum (sorted on disk if need be, never gathered).
    """
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.hour("ts").alias("hour"), "event_id", "value")
    own = Window.partitionBy("user", "hour").orderBy("event_id", "value")
    sums = F.sum("value").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return events.select("user", "hour", sums.alias("value"), F.lead(F.lit(1)).over(own).alias("_cf_next")).where("_cf_next IS NULL").drop("_cf_next")


def user_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.from_long(hour_rows(spark, sf_dir), "value", HOURS, fill=0.0)


def exploded(rows: DataFrame, measure: Column | str = "measure") -> DataFrame:
    """A row per element. Rows without any are left out after the explosion: for an inner one Spark would ask for the size of the cells below it, and so compute them twice."""
    return rows.select("id_dim", F.posexplode_outer(measure).alias("pos", "v")).where("pos IS NOT NULL").select("id_dim", F.col("pos").cast("long").alias("pos"), (F.round(F.col("v").cast("double"), DIGITS) + 0.0).alias("v"))


_EMB = "SELECT vec_id + 1 AS id_dim, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings"
_LINES = "SELECT l_orderkey + 1 AS id_dim, list(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS m FROM lineitem GROUP BY l_orderkey"
_HOURS = """SELECT u + 1 AS id_dim, list(coalesce(s, 0.0) ORDER BY h) AS m
    FROM (SELECT DISTINCT user_id AS u FROM events) CROSS JOIN range(24) t(h) LEFT JOIN (SELECT user_id, hour(ts) AS eh, sum(value) AS s FROM events GROUP BY ALL) ON user_id = u AND eh = h GROUP BY u"""


def _unfold(source: str, expression: str) -> str:
    return f"""WITH f AS ({source}), r AS (SELECT id_dim, {expression} AS a FROM f),
        e AS (SELECT id_dim, unnest(range(len(a))) AS pos, unnest(a) AS v FROM r)
        SELECT id_dim, CAST(pos AS BIGINT) AS pos, round(CAST(v AS DOUBLE), {DIGITS}) + 0.0 AS v FROM e"""


def _scalar(source: str, expression: str) -> str:
    return f"WITH f AS ({source}) SELECT id_dim, {expression} AS v FROM f"


_MEAN = "list_avg(m)"
#: name: (fragment, its SQL, measure to Column, its SQL).
_E, _L, _H = (embeddings, _EMB), (order_lines, _LINES), (user_hours, _HOURS)
_call = lambda name, *args: lambda m: registry.call(registry.resolve(name), [m, *args])
#: What math and the binary operators compute, in SQL of the elements x and m[65 - i].
_MATH = {
    "abs": "abs(x)", "atan": "atan(x)", "ceil": "ceil(x)", "floor": "floor(x)", "cos": "cos(x)", "sin": "sin(x)", "tan": "tan(x)", "exp": "exp(x)", "sign": "sign(x)", "neg": "-x", "pow2": "x * x", "degrees": "degrees(x)",
    "radians": "radians(x)", "rint": "round_even(x, 0)", "cosh": "(exp(x) + exp(-x)) / 2", "sinh": "(exp(x) - exp(-x)) / 2", "tanh": "(exp(x) - exp(-x)) / (exp(x) + exp(-x))", "nan2zero": "x",
}
_PAIRS = {
    "sum": "x + m[65 - i]", "sub": "x - m[65 - i]", "mul": "x * m[65 - i]", "max": "greatest(x, m[65 - i])", "min": "least(x, m[65 - i])", "avg": "(x + m[65 - i]) / 2", "abs": "abs(x - m[65 - i])", "arg": "atan2(x, m[65 - i])",
}
ARRAY_CASES: dict[str, tuple[tuple, Callable[[Column], Column], str]] = {
    "abs_array": (_E, _call("abs_array"), "list_transform(m, lambda x: abs(x))"),
    "accumulate": (_L, _call("accumulate"), "list_transform(m, lambda x, i: list_sum(m[1:i]))"),
    "append": (_L, lambda m: arrays.concat(m, F.reverse(m)), "list_concat(m, list_reverse(m))"),
    "arg_array": (_E, _call("arg_array"), "list_transform(m, lambda x: CASE WHEN x < 0 THEN pi() ELSE 0.0 END)"),
    "cast": (_L, _call("cast", "long"), "list_transform(m, lambda x: trunc(x))"),
    "compress": (_E, lambda m: arrays.uncompress(arrays.compress(m)), "m"),
    "concat": (_E, lambda m: arrays.concat(m, m), "list_concat(m, m)"),
    "concat2": (_L, lambda m: arrays.concat(m, m, m), "list_concat(list_concat(m, m), m)"),
    "deaccumulate": (_L, _call("deaccumulate"), "list_transform(m, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - m[i - 1] END)"),
    "div_array": (_E, lambda m: arrays.div_array(m, F.transform(m, lambda x: x * x + 1)), "list_transform(m, lambda x: x / (x * x + 1))"),
    "expand": (_L, _call("expand", 3), "flatten(list_transform(m, lambda x: [x, x, x]))"),
    "extend": (_L, _call("extend", 2), "list_concat(m, m)"),
    "extract": (_E, _call("extract", "1,64,7"), "[m[1], m[64], m[7]]"),
    "fit_linear": (_H, _call("gsl_fit_linear"), "list_transform(range(1, 25), lambda k: {mean} + (list_sum(list_transform(m, lambda x, i: (i - 12.5) * x)) / 1150.0) * (k - 12.5))".replace("{mean}", _MEAN)),
    "fit_linear_coeff": (_H, _call("gsl_fit_linear_coeff"), "[list_avg(m) - 12.5 * list_sum(list_transform(m, lambda x, i: (i - 12.5) * x)) / 1150.0, list_sum(list_transform(m, lambda x, i: (i - 12.5) * x)) / 1150.0]"),
    "get_index_array": (_L, _call("get_index_array"), "range(1, len(m) + 1)"),
    "get_subarray": (_E, _call("get_subarray", 3, 4), "m[3:6]"),
    "get_subarray2": (_E, _call("get_subarray2", "1:2:9,12"), "[m[1], m[3], m[5], m[7], m[9], m[12]]"),
    "get_subarray3": (_E, _call("get_subarray3", "2", 8, 8, "1:1:3", 1, 8), "m[9:11]"),
    "gsl_boxplot": (_E, _call("gsl_boxplot"), "[list_min(m), list_aggregate(m, 'quantile_cont', 0.25), list_aggregate(m, 'quantile_cont', 0.5), list_aggregate(m, 'quantile_cont', 0.75), list_max(m)]"),
    "gsl_complex_get_abs": (_E, lambda m: stats.complex_get_abs(stats.complex_array(m, F.reverse(m))), "list_transform(m, lambda x, i: sqrt(x * x + m[65 - i] * m[65 - i]))"),
    "gsl_complex_get_arg": (_E, lambda m: stats.complex_get_arg(stats.complex_array(m, F.reverse(m))), "list_transform(m, lambda x, i: atan2(m[65 - i], x))"),
    "gsl_complex_get_imag": (_E, lambda m: stats.complex_get_imag(stats.complex_array(m, F.reverse(m))), "list_reverse(m)"),
    "gsl_complex_get_real": (_E, lambda m: stats.complex_get_real(stats.complex_array(m, F.reverse(m))), "m"),
    "gsl_complex_to_polar": (_E, lambda m: stats.complex_get_imag(stats.complex_to_polar(stats.complex_array(m, F.reverse(m)))), "list_transform(m, lambda x, i: atan2(m[65 - i], x))"),
    "gsl_complex_to_rect": (_E, lambda m: stats.complex_get_real(stats.complex_to_rect(stats.complex_to_polar(stats.complex_array(m, F.reverse(m))))), "m"),
    "gsl_correlation": (_E, lambda m: stats.correlation(m, F.reverse(m)), "[(64 * list_sum(list_transform(m, lambda x, i: x * m[65 - i])) - list_sum(m) * list_sum(m)) / (64 * list_sum(list_transform(m, lambda x: x * x)) - list_sum(m) * list_sum(m))]"),
    "gsl_histogram": (_E, _call("gsl_histogram", 5, -0.5, 0.5), "list_transform(range(5), lambda k: len(list_filter(m, lambda x: x >= -0.5 AND x <= 0.5 AND least(floor((x + 0.5) * 5 / 1.0), 4) = k)))"),
    "gsl_quantile": (_L, _call("gsl_quantile", 0.1, 0.9), "[list_aggregate(m, 'quantile_cont', 0.1), list_aggregate(m, 'quantile_cont', 0.9)]"),
    "gsl_sd": (_E, _call("gsl_sd"), "[list_stddev_samp(m)]"),
    "gsl_sort": (_L, _call("gsl_sort"), "list_sort(m)"),
    "gsl_stats": (_E, lambda m: F.slice(stats.stats(m), 1, 3), "[list_avg(m), list_var_samp(m), list_stddev_samp(m)]"),
    "interlace": (_E, lambda m: arrays.interlace(m, F.reverse(m)), "flatten(list_transform(m, lambda x, i: [x, m[65 - i]]))"),
    "interlace2": (_L, lambda m: arrays.interlace(m, m, m), "flatten(list_transform(m, lambda x: [x, x, x]))"),
    "mask_array": (_E, lambda m: arrays.replace(arrays.mask_array(m, F.transform(m, lambda x: F.when(x > 0, 1).otherwise(0))), float("nan"), 9.0), "list_transform(m, lambda x: CASE WHEN x > 0 THEN x ELSE 9.0 END)"),
    "math": (_E, _call("math", "exp"), "list_transform(m, lambda x: exp(x))"),
    "max_array": (_E, lambda m: arrays.max_array(m, F.reverse(m)), "list_transform(m, lambda x, i: greatest(x, m[65 - i]))"),
    "min_array": (_E, lambda m: arrays.min_array(m, F.reverse(m)), "list_transform(m, lambda x, i: least(x, m[65 - i]))"),
    "moving_avg": (_L, _call("moving_avg", 3), "list_transform(m, lambda x, i: list_avg(m[greatest(i - 2, 1):i]))"),
    "mul_array": (_E, lambda m: arrays.mul_array(m, m), "list_transform(m, lambda x: x * x)"),
    "mul_scalar": (_E, _call("mul_scalar", 3), "list_transform(m, lambda x: x * 3)"),
    "mul_scalar2": (_L, _call("mul_scalar2", 0.5), "list_transform(m, lambda x: x * 0.5)"),
    "normalize": (_E, _call("normalize"), "list_transform(m, lambda x: (x - list_avg(m)) / list_stddev_pop(m))"),
    "operation_array": (_E, lambda m: arrays.operation_array("avg", m, F.reverse(m), m), "list_transform(m, lambda x, i: (x + m[65 - i] + x) / 3)"),
    "operator": (_L, _call("operator", "sum"), "[list_sum(m)]"),
    "operator_array": (_E, lambda m: arrays.operator_array(m, F.reverse(m), "sub"), "list_transform(m, lambda x, i: x - m[65 - i])"),
    "padding": (_L, _call("padding", 2, 7.0, 1), "list_concat(list_concat([7.0::DOUBLE], m), [7.0::DOUBLE, 7.0::DOUBLE])"),
    "permute": (_E, _call("permute", "8,8", "2,1"), "list_transform(range(64), lambda k: m[(k % 8) * 8 + k // 8 + 1])"),
    "predicate": (_E, _call("predicate", "x > 0", "x * 2", "0 - x"), "list_transform(m, lambda x: CASE WHEN x > 0 THEN x * 2 ELSE -x END)"),
    "predicate2": (_E, lambda m: registry.call(registry.resolve("predicate2"), [m, F.reverse(m), "x > y", "x", "y"]), "list_transform(m, lambda x, i: greatest(x, m[65 - i]))"),
    "quantize": (_E, _call("quantize", -1, 0.25), "list_transform(m, lambda x: floor((x + 1) / 0.25))"),
    "reduce": (_H, _call("reduce", "sum", 6), "list_transform(range(4), lambda g: list_sum(m[g * 6 + 1:g * 6 + 6]))"),
    "reduce2": (_H, _call("reduce2", "max", 2, 3), "list_transform(range(12), lambda g: greatest(m[(g // 3) * 6 + g % 3 + 1], m[(g // 3) * 6 + g % 3 + 4]))"),
    "reduce3": (_H, _call("reduce3", "sum", "7,12,5"), "[list_sum(m[1:7]), list_sum(m[8:19]), list_sum(m[20:24])]"),
    "replace": (_H, _call("replace", 0.0, -1.0), "list_transform(m, lambda x: CASE WHEN x = 0 THEN -1.0 ELSE x END)"),
    "reverse": (_L, _call("reverse"), "list_reverse(m)"),
    "rotate": (_L, _call("rotate", 1), "list_concat(m[2:len(m)], m[1:1])"),
    "sequence": (_L, lambda m: arrays.sequence(1, 0.5, 4), "[1.0, 1.5, 2.0, 2.5]"),
    "shift": (_L, _call("shift", 1, 0.0), "list_concat([0.0::DOUBLE], m[1:len(m) - 1])"),
    "sub_array": (_E, lambda m: arrays.sub_array(m, F.reverse(m)), "list_transform(m, lambda x, i: x - m[65 - i])"),
    "sum_array": (_E, lambda m: arrays.sum_array(m, m, m), "list_transform(m, lambda x: x + x + x)"),
    "sum_scalar": (_E, _call("sum_scalar", 2), "list_transform(m, lambda x: x + 2)"),
    "sum_scalar2": (_L, _call("sum_scalar2", -1), "list_transform(m, lambda x: x - 1)"),
    "to_bin": (_L, lambda m: arrays.to_bin(arrays.dump(m)), "m"),
    "value_to_bin": (_L, lambda m: arrays.value_to_bin(F.element_at(m, 1)), "[m[1]]"),
    "math_all": (_E, lambda m: F.concat(*[arrays.math(m, f) for f in _MATH]), "flatten([" + ", ".join(f"list_transform(m, lambda x: CAST({sql} AS DOUBLE))" for sql in _MATH.values()) + "])"),
    "operator_all": (_L, lambda m: F.concat(*[arrays.operator(m, f"XYZ_{o}") for o in ("sum", "avg", "max", "min", "count")]), "[list_sum(m), list_avg(m), list_max(m), list_min(m), CAST(len(m) AS DOUBLE)]"),
    "operator_spread": (_H, lambda m: F.concat(*[arrays.operator(m, o) for o in ("std", "var")]), "[list_stddev_samp(m), list_var_samp(m)]"),
    "operator_array_all": (_E, lambda m: F.concat(*[arrays.operator_array(m, F.reverse(m), o) for o in _PAIRS]), "flatten([" + ", ".join(f"list_transform(m, lambda x, i: {sql})" for sql in _PAIRS.values()) + "])"),
    "operation_array_all": (_E, lambda m: F.concat(*[arrays.operation_array(o, m, F.reverse(m), m) for o in ("sum", "mul", "max", "min")]), "flatten([list_transform(m, lambda x, i: x + m[65 - i] + x), list_transform(m, lambda x, i: x * m[65 - i] * x), list_transform(m, lambda x, i: greatest(x, m[65 - i])), list_transform(m, lambda x, i: least(x, m[65 - i]))])"),
    "gsl_stats_all": (_E, _call("gsl_stats"), "[list_avg(m), list_var_samp(m), list_stddev_samp(m), list_avg(list_transform(m, lambda x: pow(x - list_avg(m), 3))) / pow(list_var_pop(m), 1.5), list_avg(list_transform(m, lambda x: pow(x - list_avg(m), 4))) / pow(list_var_pop(m), 2) - 3, list_min(m), list_max(m)]"),
    "normalize_far": (_E, lambda m: arrays.normalize(F.transform(m, lambda x: x + 1e6)), "list_transform(m, lambda x: (x - list_avg(m)) / list_stddev_pop(m))"),
    "empty_cells": (_L, lambda m: F.concat(arrays.reduce2(F.filter(m, lambda x: x < 0), "sum", 2, 2), arrays.reduce3(F.filter(m, lambda x: x < 0), "sum", [2]), arrays.sequence(1, 1, 0), arrays.accumulate(F.filter(m, lambda x: x < 0)), m), "m"),
}
SCALAR_CASES: dict[str, tuple[tuple, Callable[[Column], Column], str]] = {
    "compare": (_E, lambda m: arrays.compare(m, F.reverse(m)), "CAST(CASE WHEN m = list_reverse(m) THEN 0 WHEN m < list_reverse(m) THEN -1 ELSE 1 END AS BIGINT)"),
    "convert_d": (_L, _call("convert_d"), "m[1]"),
    "convert_l": (_L, _call("convert_l"), "CAST(trunc(m[1]) AS BIGINT)"),
    "count_array": (_L, _call("count_array"), "CAST(len(m) AS BIGINT)"),
    "find": (_H, _call("find", 0.0), "CAST(coalesce(list_position(m, 0.0), 0) AS BIGINT)"),
    "size_array": (_L, _call("size_array"), "CAST(len(m) AS BIGINT)"),
    "dump": (_H, lambda m: arrays.dump(F.transform(m, lambda x: F.floor(x))), "array_to_string(list_transform(m, lambda x: CAST(CAST(floor(x) AS BIGINT) AS VARCHAR)), ', ')"),
}
#: Those without SQL are held against numpy in the tests.
SIGNAL_CASES: dict[str, Callable[[Column], Column]] = {
    "gsl_fft": lambda m: stats.complex_get_abs(signal.fft(m)),
    "gsl_ifft": lambda m: signal.ifft(signal.fft(m)),
    "gsl_dwt": signal.dwt,
    "gsl_idwt": lambda m: signal.idwt(signal.dwt(m)),
    "filter": lambda m: signal.convolve(m, [0.5, 0.3, 0.2]),
    "gsl_spline": lambda m: signal.spline(m, 127),
    "ccluster_kcluster": lambda m: signal.kcluster(m, 3),
}
_ROUND_TRIPS = ("gsl_ifft", "gsl_idwt")
#: By definition: sums of cosines and sines, sums over halves of blocks, the taps one by one.
_SIGNAL_SQL = {
    "gsl_fft": "list_transform(range(64), lambda k: sqrt(pow(list_sum(list_transform(m, lambda x, i: x * cos(2 * pi() * k * (i - 1) / 64))), 2) + pow(list_sum(list_transform(m, lambda x, i: x * sin(2 * pi() * k * (i - 1) / 64))), 2)))",
    "gsl_dwt": """list_transform(range(64), lambda p: CASE WHEN p = 0 THEN list_sum(m) / 8 ELSE
        (list_sum(m[(p - (1 << CAST(floor(log2(p)) AS INT))) * (64 >> CAST(floor(log2(p)) AS INT)) + 1:(p - (1 << CAST(floor(log2(p)) AS INT))) * (64 >> CAST(floor(log2(p)) AS INT)) + (32 >> CAST(floor(log2(p)) AS INT))])
        - list_sum(m[(p - (1 << CAST(floor(log2(p)) AS INT))) * (64 >> CAST(floor(log2(p)) AS INT)) + (32 >> CAST(floor(log2(p)) AS INT)) + 1:(p - (1 << CAST(floor(log2(p)) AS INT)) + 1) * (64 >> CAST(floor(log2(p)) AS INT))]))
        / sqrt(64 >> CAST(floor(log2(p)) AS INT)) END)""",
    "filter": "list_transform(m, lambda x, i: 0.5 * x + 0.3 * (CASE WHEN i > 1 THEN m[i - 1] ELSE 0 END) + 0.2 * (CASE WHEN i > 2 THEN m[i - 2] ELSE 0 END))",
}


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("id_dim"), "o_totalprice")


def index_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id_dim")
    sizes = F.array(*[F.lit(n).cast("long") for n in (7, 8, 5)])
    return _keys(spark, sf_dir).select(
        "id_dim", index.block_id(k, 10).alias("i1"), index.block_id2(k, 4, 3).alias("i2"), index.block_id3(k, sizes, 2).alias("i3"), index.id_to_index(k, 5, 7, 11).alias("i4"),
        index.id_to_index2(k, 10, 12).alias("i5"), index.is_in_subset(k, 3, 2, 1000).alias("i6"), index.id_of_subset(k, 3, 2).alias("i7"),
    )


def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a cube of events, hours reduced to quarters of the day."""
    return exploded(user_hours(spark, sf_dir).select("id_dim", arrays.reduce(F.col("measure"), "sum", 6).alias("measure")))


def _session(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark)
    s.create_database("d")
    s.use("d")
    s.store("emb", embeddings(spark, sf_dir))
    s.store("lines", order_lines(spark, sf_dir))
    s.store("qty", order_lines(spark, sf_dir, "l_quantity"))
    s.store("hours", user_hours(spark, sf_dir))
    return s


def language_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subset by start and stride, up to the last row."""
    s = _session(spark, sf_dir)
    last = s.execute("operation=select;field=id_dim;from=d.emb").agg(F.max("id_dim")).first()[0] or 0
    q = f"operation=select;field=id_dim|xyz_reduce('xyz_double','xyz_double',measure,'XYZ_MAX',16);select_alias=id_dim|measure;from=d.emb;where=xyz_is_in_subset(id_dim,2,3,{last})"
    return exploded(s.execute(q))


def language_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "operation=select;field=id_dim|size_array(measure) + 1;select_alias=id_dim|v;from=lines;where=is_in_subset(id_to_index2(id_dim,10,10),1,1,1) AND NOT id_dim % 2 = 0 OR id_dim = ?"
    return _session(spark, sf_dir).execute(q, [4])


def language_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "operation=select;field=a.id_dim|mul_array(a.measure,b.measure);select_alias=id_dim|measure;from=d.lines|d.qty;from_alias=a|b;where=a.id_dim = b.id_dim"
    return exploded(_session(spark, sf_dir).execute(q))


def language_join_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fragments, of which one lacks keys."""
    s = _session(spark, sf_dir)
    s.store("large", order_lines(spark, sf_dir).where(F.size("measure") > 3))
    q = "operation=select;field=a.id_dim|sum_array(a.measure,b.measure,c.measure);select_alias=id_dim|measure;from=d.lines|d.qty|d.large;from_alias=a|b|c;where=a.id_dim = b.id_dim"
    return exploded(s.execute(q))


def language_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as one group, with two aggregates in a field."""
    q = "operation=select;field=sub_array(aggregate_operator(measure,'MAX'),aggregate_operator(measure,'MIN'));select_alias=measure;from=d.emb"
    return exploded(_session(spark, sf_dir).execute(q).withColumn("id_dim", F.lit(1).cast("long")))


def language_offset_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).execute("operation=select;field=id_dim;from=d.emb;limit=1000000000|5")


def aggregate_stats_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of values far from zero, from the states of two halves."""
    rows = _table(spark, sf_dir, "orders").select(index.block_id(F.col("o_orderkey") + 1, 500).alias("g"), "o_orderkey", F.array(F.col("o_orderkey") + 1e9).alias("measure"))
    halves = [aggregate.stats_partial(rows.where(F.col("o_orderkey") % 2 == k), ["g"]) for k in (0, 1)]
    found = aggregate.stats_final(halves[0].unionByName(halves[1]), ["g"])
    return found.select("g", F.col("count").alias("n"), F.round("avg", 2).alias("x_avg"), F.round("std", DIGITS).alias("x_std"))


def language_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "operation=select;field=id(id_dim,10)|sum_scalar(aggregate_operator(measure,'SUM'),1);select_alias=id_dim|measure;from=hours;group=id(id_dim,10)"
    return exploded(_session(spark, sf_dir).execute(q))


def language_limit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "operation=select;field=id_dim|convert_d(measure);select_alias=id_dim|v;from=lines;limit=5|20;order=v;order_dir=desc"
    return _session(spark, sf_dir).execute(q)


def sequential_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    s.subset("d.lines", 100, "reverse(measure)", "part", "size_array(measure) > 2")
    return exploded(s.export("part"))


def aggregate_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).withColumn("g", index.block_id(F.col("id_dim"), 100))
    return exploded(aggregate.aggregate_operator(rows, ["g"], "avg").withColumnRenamed("g", "id_dim"))


def aggregate_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).withColumn("g", index.block_id(F.col("id_dim"), 100))
    return exploded(aggregate.aggregate_fixed(rows, ["g"], "max", 64).withColumnRenamed("g", "id_dim"))


def aggregate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).withColumn("g", index.block_id(F.col("id_dim"), 100))
    found = aggregate.aggregate_stats(rows, ["g"])
    return found.select("g", F.col("pos").cast("long").alias("pos"), F.col("count").alias("n"), *[(F.round(c, DIGITS) + 0.0).alias(f"x_{c}") for c in ("sum", "avg", "std", "min", "max")])


def aggregate_stats_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of two halves, merged: as the whole at once."""
    rows = embeddings(spark, sf_dir).withColumn("g", index.block_id(F.col("id_dim"), 100))
    halves = [aggregate.stats_partial(rows.where(F.col("id_dim") % 2 == k), ["g"]) for k in (0, 1)]
    found = aggregate.stats_final(halves[0].unionByName(halves[1]), ["g"])
    return found.select("g", F.col("pos").cast("long").alias("pos"), F.col("count").alias("n"), *[(F.round(c, DIGITS) + 0.0).alias(f"x_{c}") for c in ("sum", "avg", "std", "min", "max")])


def roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_lines(spark, sf_dir).withColumn("g", index.block_id(F.col("id_dim"), 50))
    return exploded(aggregate.roll_up(rows, ["g"]).withColumnRenamed("g", "id_dim"))


def group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain columns give the group's first row, functions its last."""
    rows = _keys(spark, sf_dir)
    out = select.grouped(rows, index.block_id(F.col("id_dim"), 25), {"first_price": F.col("o_totalprice")}, {"last_price": F.round("o_totalprice")})
    return out.select(F.col("_group").alias("g"), "first_price", "last_price")


def cube_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = [cube.Dim("user", 1 << 20, True, 0, 99), cube.Dim("hour", 24, False, 6, 11)]
    return exploded(cube.from_long(hour_rows(spark, sf_dir), "value", dims, fill=0.0))


def cube_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours become rows, users the places of the array."""
    rows = hour_rows(spark, sf_dir)
    users = rows.agg(F.max("user")).first()[0]
    dims = [cube.Dim("hour", 24, True), cube.Dim("user", (users or 0) + 1, False)]
    return exploded(cube.from_long(rows, "value", dims, fill=0.0))


def cube_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = hour_rows(spark, sf_dir)
    both = cube.concatenated([day, day], "hour", [24, 24])
    return exploded(cube.from_long(both, "value", [cube.Dim("user", 1 << 20, True), cube.Dim("hour", 48, False)], fill=0.0))


def reduce_at_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(cube.reduced_at_source(hour_rows(spark, sf_dir), "value", HOURS, "max"))


def cube_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = cube.to_long(user_hours(spark, sf_dir), HOURS).where("value != 0")
    return back.select(F.col("user").cast("long").alias("user"), F.col("hour").cast("long").alias("hour"), F.round("value", DIGITS).alias("v"))


def random_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generate.random_fragment(spark, 200, 50, "double", "default", 1, 3)
    return rows.select("id_dim", F.size("measure").cast("long").alias("n"), (F.forall("measure", lambda x: (x >= 0) & (x < 1000))).alias("inside"))


def random_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generate.random_fragment(spark, 200, 50, "float", "temperatures", 11, 3)
    return rows.select("id_dim", F.size("measure").cast("long").alias("n"), (F.forall("measure", lambda x: (x >= -5) & (x < 35))).alias("inside"))


def fragment_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_size(order_lines(spark, sf_dir))


def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    for q in ("operation=create_database;db_name=d", "operation=use_database;db_name=d", "operation=create_frag;frag_name=f;column_name=id_dim|measure;column_type=long|blob"):
        s.execute(q)
    for i in range(1, 6):
        s.execute("operation=insert;frag_name=f;field=id_dim|measure;value=?|?", [i, [i * 1.0, i * 2.0]])
    s.execute("operation=multi_insert;frag_name=f;field=id_dim|measure;value=6|'6,12'|7|'7,14';final_statement=yes")
    return exploded(s.export("f"))


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_k(_keys(spark, sf_dir), "o_totalprice", 25)


def existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir)
    some = keys.where("o_totalprice > 250000")
    return extra.union(extra.members(keys, some).select("id_dim", F.lit("in").alias("side")), extra.strangers(keys, some).select("id_dim", F.lit("out").alias("side")))


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    prices = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("price"))
    return extra.asof(events.select("event_id", "user_id", "ts"), prices, "ts", "user_id", "price").select("event_id", F.round("price_asof", DIGITS).alias("price"))


def running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra.running(_table(spark, sf_dir, "events"), "value", "user_id", "event_id").select("event_id", F.round("running", 3).alias("running"))


def window_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.windowed(_table(spark, sf_dir, "events"), "ts", "user_id", "value")
    return out.select("user_id", F.unix_timestamp("start").alias("start"), "n", F.round("total", DIGITS).alias("total"))


def _signal(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: exploded(embeddings(spark, sf_dir).select("id_dim", SIGNAL_CASES[name](F.col("measure")).alias("measure")))


def _array(name: str) -> Callable[[SparkSession, str], DataFrame]:
    (rows, _), build, _ = ARRAY_CASES[name]
    return lambda spark, sf_dir: exploded(rows(spark, sf_dir).select("id_dim", build(F.col("measure")).alias("measure")))


def _one(name: str) -> Callable[[SparkSession, str], DataFrame]:
    (rows, _), build, _ = SCALAR_CASES[name]
    return lambda spark, sf_dir: rows(spark, sf_dir).select("id_dim", build(F.col("measure")).alias("v"))


_STATS = f"""WITH e AS (SELECT 1 + (vec_id // 100) AS g, unnest(range(64)) AS pos, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings)
    SELECT g, pos, count(*) AS n, round(sum(x), {DIGITS}) + 0.0 AS x_sum, round(avg(x), {DIGITS}) + 0.0 AS x_avg, round(stddev_samp(x), {DIGITS}) + 0.0 AS x_std, round(min(x), {DIGITS}) + 0.0 AS x_min, round(max(x), {DIGITS}) + 0.0 AS x_max
    FROM e GROUP BY g, pos"""


def _by_position(operator: str) -> str:
    return f"""WITH e AS (SELECT 1 + (vec_id // 100) AS id_dim, unnest(range(64)) AS pos, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings)
        SELECT id_dim, pos, round({operator}(x), {DIGITS}) + 0.0 AS v FROM e GROUP BY id_dim, pos"""


_NAMED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "minimum_slice": (minimum_slice, _unfold(f"SELECT * FROM ({_HOURS})", "list_transform(range(4), lambda g: list_sum(m[g * 6 + 1:g * 6 + 6]))")),
    "index_functions": (index_functions, """SELECT k AS id_dim, 1 + (k - 1) // 10 AS i1, 1 + (k - 1) % 3 + ((k - 1) // 12) * 3 AS i2,
        (k - 1) % 2 + (CASE WHEN ((k - 1) // 2) % 20 < 7 THEN 0 WHEN ((k - 1) // 2) % 20 < 15 THEN 1 ELSE 2 END + (((k - 1) // 2) // 20) * 3) * 2 + 1 AS i3,
        ((k - 1) // 35) % 11 + 1 AS i4, 1 + ((k - 1) // 10) % 12 AS i5, CAST((k - 3) % 2 = 0 AND k BETWEEN 3 AND 1000 AS BIGINT) AS i6,
        CASE WHEN k >= 3 AND (k - 3) % 2 = 0 THEN 1 + (k - 3) // 2 END AS i7 FROM (SELECT o_orderkey + 1 AS k FROM orders)"""),
    "language_select": (language_select, _unfold(f"SELECT * FROM ({_EMB}) WHERE (id_dim - 2) % 3 = 0 AND id_dim >= 2", "list_transform(range(4), lambda g: list_max(m[g * 16 + 1:g * 16 + 16]))")),
    "language_where": (language_where, f"WITH f AS ({_LINES}) SELECT id_dim, CAST(len(m) + 1 AS DOUBLE) AS v FROM f WHERE ((1 + ((id_dim - 1) // 10) % 10) = 1 AND NOT id_dim % 2 = 0) OR id_dim = 4"),
    "language_join": (language_join, _unfold("SELECT l_orderkey + 1 AS id_dim, list(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS m, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY l_orderkey", "list_transform(m, lambda x, i: x * q[i])")),
    "language_join_three": (language_join_three, _unfold("SELECT * FROM (SELECT l_orderkey + 1 AS id_dim, list(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS m, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY l_orderkey) WHERE len(m) > 3", "list_transform(m, lambda x, i: x + q[i] + x)")),
    "language_aggregate": (language_aggregate, f"""WITH e AS (SELECT unnest(range(64)) AS pos, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings)
        SELECT CAST(1 AS BIGINT) AS id_dim, pos, round(max(x) - min(x), {DIGITS}) + 0.0 AS v FROM e GROUP BY pos"""),
    "language_offset_past_end": (language_offset_past_end, "SELECT vec_id + 1 AS id_dim FROM embeddings WHERE false"),
    "aggregate_stats_far": (aggregate_stats_far, f"SELECT 1 + o_orderkey // 500 AS g, count(*) AS n, round(avg(o_orderkey) + 1e9, 2) AS x_avg, round(stddev_samp(o_orderkey), {DIGITS}) AS x_std FROM orders GROUP BY 1 + o_orderkey // 500"),
    "language_group": (language_group, f"""WITH e AS (SELECT 1 + (id_dim - 1) // 10 AS id_dim, unnest(range(24)) AS pos, unnest(m) AS x FROM ({_HOURS}))
        SELECT id_dim, pos, round(sum(x) + 1, {DIGITS}) + 0.0 AS v FROM e GROUP BY id_dim, pos"""),
    "language_limit_order": (language_limit_order, f"WITH f AS ({_LINES}) SELECT id_dim, m[1] AS v FROM (SELECT * FROM f ORDER BY id_dim LIMIT 20 OFFSET 5)"),
    "sequential_id": (sequential_id, _unfold(f"SELECT 99 + row_number() OVER (ORDER BY id_dim) AS id_dim, m FROM ({_LINES}) WHERE len(m) > 2", "list_reverse(m)")),
    "aggregate_operator": (aggregate_operator, _by_position("avg")),
    "aggregate_fixed": (aggregate_fixed, _by_position("max")),
    "aggregate_stats": (aggregate_stats, _STATS),
    "aggregate_stats_parts": (aggregate_stats_parts, _STATS),
    "roll_up": (roll_up, _unfold(f"SELECT 1 + (id_dim - 1) // 50 AS id_dim, flatten(list(m ORDER BY id_dim)) AS m FROM ({_LINES}) GROUP BY ALL", "m").replace("GROUP BY ALL", "GROUP BY 1 + (id_dim - 1) // 50")),
    "group_by": (group_by, "SELECT 1 + o_orderkey // 25 AS g, arg_min(o_totalprice, o_orderkey) AS first_price, round(arg_max(o_totalprice, o_orderkey)) AS last_price FROM orders GROUP BY 1 + o_orderkey // 25"),
    "cube_subset": (cube_subset, f"""WITH u AS (SELECT DISTINCT user_id FROM events WHERE user_id < 100 AND hour(ts) BETWEEN 6 AND 11)
        SELECT u.user_id + 1 AS id_dim, h - 6 AS pos, round(coalesce(sum(value), 0), {DIGITS}) + 0.0 AS v FROM u CROSS JOIN range(6, 12) t(h) LEFT JOIN events e ON e.user_id = u.user_id AND hour(e.ts) = h GROUP BY u.user_id, h"""),
    "cube_transposed": (cube_transposed, f"""WITH hs AS (SELECT DISTINCT hour(ts) AS h FROM events), us AS (SELECT unnest(range(max(user_id) + 1)) AS u FROM events)
        SELECT h + 1 AS id_dim, u AS pos, round(coalesce(sum(value), 0), {DIGITS}) + 0.0 AS v FROM hs CROSS JOIN us LEFT JOIN events e ON e.user_id = u AND hour(e.ts) = h GROUP BY h, u"""),
    "cube_concat": (cube_concat, _unfold(_HOURS, "list_concat(m, m)")),
    "reduce_at_source": (reduce_at_source, f"SELECT user_id + 1 AS id_dim, CAST(0 AS BIGINT) AS pos, round(max(s), {DIGITS}) + 0.0 AS v FROM (SELECT user_id, hour(ts) AS h, sum(value) AS s FROM events GROUP BY ALL) GROUP BY user_id"),
    "cube_round_trip": (cube_round_trip, f'SELECT user_id AS "user", hour(ts) AS "hour", round(sum(value), {DIGITS}) AS v FROM events GROUP BY ALL HAVING sum(value) <> 0'),
    "random_default": (random_default, "SELECT k AS id_dim, CAST(50 AS BIGINT) AS n, true AS inside FROM range(1, 201) t(k)"),
    "random_temperatures": (random_temperatures, "SELECT k AS id_dim, CAST(50 AS BIGINT) AS n, true AS inside FROM range(11, 211) t(k)"),
    "fragment_bytes": (fragment_bytes, "SELECT CAST(sum(16 + 8 * n) AS BIGINT) AS frag_size FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)"),
    "insert_rows": (insert_rows, "SELECT k AS id_dim, p AS pos, CAST(k * (p + 1) AS DOUBLE) AS v FROM range(1, 8) t(k), range(2) s(p)"),
    "top_k": (top_k, "SELECT o_orderkey + 1 AS id_dim, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "existence": (existence, "SELECT o_orderkey + 1 AS id_dim, CASE WHEN o_totalprice > 250000 THEN 'in' ELSE 'out' END AS side FROM orders"),
    "asof_join": (asof_join, f"""WITH p AS (SELECT user_id, ts, max(value) AS price FROM events WHERE event_type = 'purchase' GROUP BY ALL)
        SELECT event_id, round(price, {DIGITS}) AS price FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts"""),
    "running_sum": (running_sum, "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 3) AS running FROM events"),
    "window_sums": (window_sums, f"SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, count(*) AS n, round(sum(value), {DIGITS}) AS total FROM events GROUP BY ALL"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{n: q for n, (q, _) in _NAMED.items()},
    **{f"array_{n}": _array(n) for n in ARRAY_CASES},
    **{f"array_{n}": _one(n) for n in SCALAR_CASES},
    **{f"array_{n}": _signal(n) for n in SIGNAL_CASES},
}
ORACLE: dict[str, str] = {
    **{n: sql for n, (_, sql) in _NAMED.items() if sql},
    **{f"array_{n}": _unfold(s[1], sql) for n, (s, _, sql) in ARRAY_CASES.items()},
    **{f"array_{n}": _scalar(s[1], sql) for n, (s, _, sql) in SCALAR_CASES.items()},
    **{f"array_{n}": _unfold(_EMB, "m") for n in _ROUND_TRIPS},
    **{f"array_{n}": _unfold(_EMB, sql) for n, sql in _SIGNAL_SQL.items()},
}
