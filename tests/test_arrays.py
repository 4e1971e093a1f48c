import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubeframe.functions import arrays, registry, signal, stats

#: Ten values of own choice, out of order and of both signs.
SOME = [4.0, -2.5, 17.25, 0.5, 8.0, -11.0, 3.75, 64.0, 1.125, -0.25]


def run(spark, build, *cells):
    rows = spark.createDataFrame([(i, list(c) if c is not None else None) for i, c in enumerate(cells)], "i long, m array<double>")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("m"))).collect()]


def test_sorted(spark):
    assert run(spark, stats.sort, SOME) == [[-11.0, -2.5, -0.25, 0.5, 1.125, 3.75, 4.0, 8.0, 17.25, 64.0]]


@pytest.mark.parametrize(("build", "wanted"), [
    (lambda m: arrays.get_subarray(m, 3, 4), SOME[2:6]),
    (lambda m: arrays.reduce(m, "XYZ_AVG", 2), [np.mean(SOME[i : i + 2]) for i in range(0, 10, 2)]),
    (lambda m: arrays.reduce(m, "sum", 4), [sum(SOME[:4]), sum(SOME[4:8]), sum(SOME[8:])]),
    (lambda m: arrays.rotate(m, 3), SOME[3:] + SOME[:3]),
    (lambda m: arrays.shift(m, -2, 0.5), SOME[2:] + [0.5, 0.5]),
    (lambda m: stats.quantile(m, 0.3), [np.quantile(SOME, 0.3)]),
    (stats.boxplot, np.quantile(SOME, [0, 0.25, 0.5, 0.75, 1])),
    (lambda m: arrays.reduce3(m, "sum", [3, 2]), [sum(SOME[:3]), sum(SOME[3:5]), sum(SOME[5:8]), sum(SOME[8:])]),
    (stats.fit_linear_coeff, np.polyfit(range(1, 11), SOME, 1)[::-1]),
    (lambda m: signal.spline(m, 10), SOME),
    (lambda m: signal.convolve(m, [0.5, 0.25]), np.convolve(SOME, [0.5, 0.25])[:10]),
    (lambda m: stats.complex_get_abs(signal.fft(m)), np.abs(np.fft.fft(SOME))),
])
def test_against_numpy(spark, build, wanted):
    assert np.allclose(run(spark, build, SOME)[0], wanted)


def test_stats(spark):
    x = np.array(SOME)
    c = x - x.mean()
    want = [x.mean(), x.var(ddof=1), x.std(ddof=1), (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2 - 3, x.min(), x.max()]
    assert np.allclose(run(spark, stats.stats, SOME)[0], want)


def test_haar_keeps_energy_and_wants_a_power_of_two(spark):
    assert math.isclose(sum(v * v for v in run(spark, signal.dwt, SOME[:8])[0]), sum(v * v for v in SOME[:8]))
    with pytest.raises(Exception, match="power of two"):
        run(spark, signal.dwt, SOME)


def test_clusters(spark):
    assert run(spark, lambda m: signal.kcluster(m, 2), [1.0, 1.1, 9.0, 9.2, 0.9])[0] == [1, 1, 2, 2, 1]


def test_edges(spark):
    for build in (arrays.accumulate, arrays.deaccumulate, arrays.reverse, lambda m: arrays.reduce(m, "sum", 3), lambda m: arrays.moving_avg(m, 2)):
        assert run(spark, build, [], [5.0], None) == [[], [5.0], None]
    assert run(spark, arrays.count_array, [1.0, None, float("nan")])[0] == 1
    assert run(spark, lambda m: arrays.find(m, 9.0), [1.0, 9.0], [1.0]) == [2, 0]
    assert run(spark, arrays.normalize, [2.0, 2.0])[0] == [None, None]


def test_empty_cells(spark):
    for build in (lambda m: arrays.reduce2(m, "sum", 2, 3), lambda m: arrays.reduce3(m, "sum", [2, 1]), lambda m: arrays.sequence(3, 1, 0) if m is not None else m, arrays.normalize, lambda m: signal.convolve(m, [1.0])):
        assert run(spark, build, [])[0] == []
    for bad in (lambda m: arrays.get_subarray(m, 0, 2), lambda m: arrays.reduce3(m, "sum", [2, 0])):
        with pytest.raises(ValueError):
            run(spark, bad, [1.0])


def test_large_means(spark):
    far = [1e9 + i for i in range(5)]
    assert np.allclose(run(spark, arrays.normalize, far)[0], (np.arange(5) - 2) / np.sqrt(2))
    assert run(spark, arrays.normalize, [1.0, None, 3.0])[0] == [-1.0, None, 1.0]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 10, 50, 1000])
def test_running_sums_of_any_length(spark, n):
    cell = [float((i * 37) % 11 - 5) for i in range(n)]
    assert np.allclose(run(spark, arrays.accumulate, cell)[0], np.cumsum(cell))
    decayed, y = [], 0.0
    for x in cell:
        y = 0.9 * y + x
        decayed.append(y)
    assert np.allclose(run(spark, lambda m: arrays.running(m, 0.9), cell)[0], decayed)


def test_long_cells_take_time_in_proportion(spark):
    import time

    start = time.perf_counter()
    long = spark.range(10).select(arrays.accumulate(F.transform(F.sequence(F.lit(1), F.lit(16_000)), lambda x: x.cast("double"))).alias("m"))
    assert [r[0] for r in long.select(F.element_at("m", -1)).collect()] == [16_000 * 16_001 / 2] * 10
    assert time.perf_counter() - start < 20


def test_spline_is_the_dense_solution(spark):
    y = np.array(SOME)
    n = len(y)
    second = np.zeros(n)
    second[1:-1] = np.linalg.solve(4 * np.eye(n - 2) + np.eye(n - 2, k=1) + np.eye(n - 2, k=-1), 6 * (y[2:] - 2 * y[1:-1] + y[:-2]))
    at = np.linspace(0, n - 1, 31)
    low = np.minimum(at.astype(int), n - 2)
    b = at - low
    wanted = (1 - b) * y[low] + b * y[low + 1] + (((1 - b) ** 3 - (1 - b)) * second[low] + (b**3 - b) * second[low + 1]) / 6
    assert np.allclose(run(spark, lambda m: signal.spline(m, 31), SOME)[0], wanted)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1000, 1000).map(float), min_size=1, max_size=12))
def test_laws(spark, cell):
    same = [lambda m: arrays.deaccumulate(arrays.accumulate(m)), lambda m: arrays.reverse(arrays.reverse(m)), lambda m: arrays.rotate(arrays.rotate(m, 2), -2), lambda m: F.concat(arrays.get_subarray(m, 1, 3), arrays.get_subarray(m, 4)), lambda m: arrays.to_bin(arrays.dump(m)), lambda m: signal.ifft(signal.fft(m))]
    rows = spark.createDataFrame([(cell,)], "m array<double>")
    for got in rows.select(*[b(F.col("m")) for b in same]).first():
        assert np.allclose(got, cell)
    assert np.isclose(rows.select(F.aggregate(arrays.reduce(F.col("m"), "sum", 3), F.lit(0.0), lambda a, x: a + x)).first()[0], sum(cell))


def test_registry_has_all_primitives():
    assert sum(p.kind != "index" or p.name in ("id3", "id_of_subset", "id_to_index") for p in registry.REGISTRY.values()) == 88
    assert registry.resolve("mysql.abc_reduce").name == "reduce"
    with pytest.raises(ValueError):
        registry.resolve("nothing")


def test_signal_work_runs_once_in_bounded_batches(spark):
    """Transforms get batches of some megabytes, and an exploded one is computed once, not again for a filter below it."""
    from cubeframe import catalog_of_queries as catalog

    rows = spark.range(3000).select((F.col("id") + 1).alias("id_dim"), F.transform(F.sequence(F.lit(1), F.lit(2048)), lambda i: (i * 1.5 + F.col("id"))).alias("measure")).coalesce(1)

    @F.arrow_udf("array<long>")
    def seen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([[len(b)]] * len(b), pa.list_(pa.int64()))

    for name in ("gsl_fft", "gsl_ifft", "gsl_dwt", "gsl_idwt", "gsl_spline", "ccluster_kcluster"):
        work = catalog.SIGNAL_CASES[name](F.col("measure"))
        plan = catalog.exploded(rows.select("id_dim", work.alias("measure")))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
    assert rows.select(F.explode(seen("measure")).alias("n")).agg(F.max("n")).first()[0] <= 512


def test_signals_of_odd_cells(spark):
    """Null, empty and ragged cells, and null elements, in one batch."""
    cells = [None, [], [1.0, 2.0, 3.0], [4.0], [None, 1.0], [5.0, 6.0, 7.0], [0.0, -1.0, 2.0, 8.0]]
    rows = spark.createDataFrame(list(enumerate(cells)), "k int, m array<double>").coalesce(1)
    got = {r["k"]: r for r in rows.select("k", signal.fft(F.col("m")).alias("z"), signal.ifft(signal.fft(F.col("m"))).alias("b"), signal.spline(F.col("m"), 5).alias("s")).collect()}
    assert all(got[0][c] is None for c in "zbs") and all(got[1][c] == [] for c in "zbs")
    for k, cell in enumerate(cells):
        if cell and None in cell:
            assert all(v["re"] is None for v in got[k]["z"]) and got[k]["b"] == [None] * len(cell)
        elif cell:
            assert np.allclose([complex(v["re"], v["im"]) for v in got[k]["z"]], np.fft.fft(cell))
            assert np.allclose(got[k]["b"], cell) and len(got[k]["s"]) == 5
