import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeframe.operators import aggregate, extra, select
from cubeframe.plans.session import Session, SessionError
from cubeframe.sources import cube, generate, netcdf

LAT, LON, TIME = 4, 5, 24


@pytest.fixture(scope="module")
def long(spark):
    rows = [(a, o, t, 100.0 * a + 10 * o + t) for a in range(LAT) for o in range(LON) for t in range(TIME)]
    return spark.createDataFrame(rows, "lat int, lon int, time int, v double").cache()


@pytest.fixture
def session(spark, long):
    s = Session(spark)
    s.execute("operation=create_database;db_name=d")
    s.use("d")
    s.attach_file("grid", long)
    s.execute("operation=file_import;frag_name=c;src_path=grid;measure=v;dim_type=1|1|0;dim_index=0|1|2;dim_start=0|0|0;dim_end=3|4|23")
    return s


def test_cube(session):
    rows = session.export("c").collect()
    assert len(rows) == LAT * LON
    for r in rows:
        a, o = divmod(r["id_dim"] - 1, LON)
        assert r["measure"] == [100.0 * a + 10 * o + t for t in range(TIME)]


def test_subset_and_order_of_dims(spark, long):
    dims = [cube.Dim("time", TIME, True, 2, 4), cube.Dim("lon", LON, False), cube.Dim("lat", LAT, False, 1, 1)]
    rows = cube.from_long(long, "v", dims).orderBy("id_dim").collect()
    assert [r["measure"] for r in rows] == [[100.0 + 10 * o + t for o in range(LON)] for t in (2, 3, 4)]
    assert cube.to_long(cube.from_long(long, "v", dims), dims).count() == 15
    with pytest.raises(ValueError):
        cube.from_long(long, "v", [cube.Dim("lat", LAT, True, 3, 9)])


def test_reduction_has_a_closed_form(session):
    got = session.execute("operation=select;field=id_dim|reduce('xyz_double','xyz_double',measure,'XYZ_AVG',12);select_alias=id_dim|measure;from=c;order=id_dim").collect()
    for r in got:
        a, o = divmod(r["id_dim"] - 1, LON)
        assert r["measure"] == [100.0 * a + 10 * o + 5.5, 100.0 * a + 10 * o + 17.5]


def test_ctas_join_and_drop(session):
    session.execute("operation=create_frag_select;frag_name=e;field=id_dim|mul_scalar(measure,2);select_alias=id_dim|measure;from=d.c;where=id_dim <= 3")
    got = session.execute("operation=select;field=a.id_dim|sub_array(b.measure,a.measure);select_alias=id_dim|m;from=d.c|d.e;from_alias=a|b;where=a.id_dim > 1").collect()
    assert sorted(r["id_dim"] for r in got) == [2, 3]
    with pytest.raises(SessionError):
        session.execute("operation=create_frag_select;frag_name=e;field=id_dim|measure;from=c")
    with pytest.raises(SessionError):
        session.execute("operation=create_frag_select;frag_name=z;field=id_dim|measure;from=c;where=id_dim > 999")
    session.execute("operation=drop_frag;frag_name=e")
    session.execute("operation=drop_frag;frag_name=e")
    assert not session.exists("e")


def test_limit_comes_first(session):
    got = session.execute("operation=select;field=id_dim|convert_d(measure);select_alias=id_dim|v;from=c;limit=2|3;order=v;order_dir=desc").collect()
    assert [r["id_dim"] for r in got] == [5, 4, 3]
    assert session.execute("operation=select;field=id_dim;from=c;limit=100|5").count() == 0


def test_a_large_limit_numbers_the_rows(monkeypatch, session):
    q = "operation=select;field=id_dim;from=c;limit={}"
    monkeypatch.setattr(select, "MOST_TAKEN", 4)
    assert sorted(r[0] for r in session.execute(q.format("3|6")).collect()) == [4, 5, 6, 7, 8, 9]
    assert sorted(r[0] for r in session.execute(q.format("17|0")).collect()) == [18, 19, 20]
    assert session.execute(q.format("100|5")).count() == 0


def test_groups(session):
    got = session.execute("operation=select;field=id(id_dim,5)|aggregate_operator(measure,'MAX')|id_dim;select_alias=g|m|first;from=c;group=id(id_dim,5)").collect()
    assert sorted((r["first"], r["m"][0]) for r in got) == [(1, 40.0), (6, 140.0), (11, 240.0), (16, 340.0)]


def test_several_aggregates_in_one_pass(session):
    q = "operation=select;field=id(id_dim,5)|sub_array(aggregate_operator(measure,'MAX'),aggregate_operator(measure,'MIN'))|aggregate_operator(get_subarray(measure,1,2),'count')|size_array(roll_up(measure))|aggregate_stats(measure);select_alias=g|spread|n|all|stats;from=c;group=id(id_dim,5);order=g"
    got = session.execute(q).collect()
    assert [r["g"] for r in got] == [1, 2, 3, 4] and all(r["spread"] == [40.0] * TIME and r["n"] == [5.0, 5.0] and r["all"] == 5 * TIME for r in got)
    assert got[1]["stats"][0].asDict() == {"count": 5, "sum": 600.0, "avg": 120.0, "std": pytest.approx(np.std([100, 110, 120, 130, 140], ddof=1)), "min": 100.0, "max": 140.0}
    assert session.execute("operation=select;field=aggregate_operator(measure,'SUM');select_alias=m;from=c").first()["m"][0] == sum(100.0 * a + 10 * o for a in range(LAT) for o in range(LON))


def test_a_registered_aggregate(session):
    from cubeframe.functions import registry

    registry.register("span_of_rows", lambda x: F.max(x) - F.min(x), 1, kind="aggregate")
    try:
        got = session.execute("operation=select;field=lib_span_of_rows(measure);select_alias=m;from=c;group=id(id_dim,5)").collect()
        assert [r["m"] for r in got] == [[40.0] * TIME] * 4
        with pytest.raises(ValueError):
            session.execute("operation=select;field=id_dim;from=c;where=span_of_rows(measure)")
    finally:
        del registry.REGISTRY["span_of_rows"]


def test_joins_of_three_and_of_none(session):
    session.execute("operation=create_frag_select;frag_name=low;field=id_dim|measure;select_alias=id_dim|measure;from=c;where=id_dim < 8")
    session.execute("operation=create_frag_select;frag_name=high;field=id_dim|measure;select_alias=id_dim|measure;from=c;where=id_dim > 5")
    q = "operation=select;field=a.id_dim|sum_array(a.measure,b.measure,c.measure);select_alias=id_dim|m;from=low|c|high;from_alias=a|b|c;where={}"
    assert sorted((r["id_dim"], r["m"][0]) for r in session.execute(q.format("a.id_dim > 0")).collect()) == [(6, 300.0), (7, 330.0)]
    assert session.execute(q.format("a.id_dim > 7")).count() == 0


@pytest.mark.parametrize("name", ["need", "schema", "files", "rows", "_select", "place"])
def test_only_statements_run(session, name):
    with pytest.raises(SessionError, match="unknown operation"):
        session.execute(f"operation={name};frag_name=c")


def test_import_as_a_type(session):
    session.execute("operation=file_import;frag_name=t;src_path=grid;measure=v;measure_type=int;dim_type=1|1|0;dim_index=0|1|2;dim_start=0|0|0;dim_end=3|4|23")
    assert dict(session.fragment("t").dtypes)["measure"] == "array<int>"


def test_import_concat_and_reduce(session):
    session.execute("operation=file_import;frag_name=long;src_path=grid|grid;measure=v;dim_type=1|1|0;dim_index=0|1|2;dim_start=0|0|0;dim_end=3|4|47;dim_unlim=2")
    assert session.export("long").first()["measure"] == [float(t % 24) for t in range(48)]
    session.execute("operation=esdm_import;frag_name=r;src_path=grid;measure=v;dim_type=1|1|0;dim_index=0|1|2;dim_start=0|0|0;dim_end=3|4|23;sub_operation=max")
    assert session.export("r").first()["measure"] == [23.0]


def test_prepared_insert_and_select_from_a_file(session):
    session.execute("operation=create_frag;frag_name=w;column_name=id_dim|measure;column_type=long|blob")
    session.execute_many("operation=insert;frag_name=w;field=id_dim|measure;value=?|?", [[k, [float(k)] * TIME] for k in range(1, 4)])
    assert session.export("w").count() == 3
    with pytest.raises(SessionError):
        session.execute("operation=insert;frag_name=w;field=id_dim|measure;value=4|'1'")
    load = "src_path=grid;measure=v;dim_type=1|1|0;dim_index=0|1|2;dim_start=0|0|0;dim_end=3|4|23"
    session.execute(f"operation=create_frag_select_file;frag_name=j;field=a.id_dim|sum_array(a.measure,b.measure);select_alias=id_dim|measure;from=@file|d.w;from_alias=a|b;where=a.id_dim > 1;{load}")
    assert [(r["id_dim"], r["measure"][1]) for r in session.export("j").collect()] == [(2, 13.0), (3, 24.0)]
    session.execute("operation=select;field=id_dim|xyz_dump('xyz_double','xyz_double',measure,'/');select_alias=i|t;from=w;where=id_dim = 2;limit=1")
    assert session.fetch() == [(2, "/".join(["2.0"] * TIME))]


def test_size_subset_and_errors(session):
    session.execute("operation=function;func=xyz_subset;arg='d.c'|10|'reverse(measure)'|'s'|'id_dim % 2 = 0'")
    assert [r["id_dim"] for r in session.export("s").collect()] == list(range(10, 20))
    assert session.execute("operation=function;func=xyz_size;arg='c'|'s'").first()[0] == 30 * (16 + 24 * 8)
    for bad in ("operation=fly", "operation=select;field=id_dim;from=nothing", "operation=select;field=id_dim|measure;from=c;order=measure", "operation=create_frag;frag_name=x;column_name=a;column_type=long", "operation=function;func=no;arg='c'"):
        with pytest.raises(ValueError):
            session.execute(bad)


def test_parquet_device(spark):
    s = Session(spark, "parquet")
    s.create_database("cubeframe_test")
    s.use("cubeframe_test")
    try:
        s.execute("operation=random_import;frag_name=r;measure_type=int;nrows=5;array_len=4;seed=3")
        assert s.export("r").count() == 5
    finally:
        s.drop_database("cubeframe_test")
    assert s.current is None


def test_random_is_the_same_again(spark):
    a, b = (generate.random_fragment(spark, 20, 8, "double", "temperatures", seed=4) for _ in range(2))
    assert a.exceptAll(b.repartition(7)).count() == 0
    with pytest.raises(ValueError):
        generate.random_fragment(spark, 0, 8)


def test_stats_of_parts(spark, long):
    rows = cube.from_long(long, "v", [cube.Dim("lat", LAT, True), cube.Dim("lon", LON, True), cube.Dim("time", TIME, False)]).withColumn("g", F.lit(1))
    whole = aggregate.aggregate_stats(rows, ["g"])
    parts = aggregate.stats_partial(rows.where("id_dim < 7"), ["g"]).unionByName(aggregate.stats_partial(rows.where("id_dim >= 7"), ["g"]))
    assert whole.exceptAll(aggregate.stats_final(parts, ["g"])).count() == 0
    assert aggregate.roll_up(rows, ["g"]).select(F.size("measure")).first()[0] == LAT * LON * TIME


def test_stats_far_from_zero(spark):
    rows = spark.createDataFrame([(1, [1e9 + i]) for i in range(5)] + [(2, [7.0])], "g int, measure array<double>")
    half = [aggregate.stats_partial(rows.where(f"cast(measure[0] as long) % 2 = {k}"), ["g"]) for k in (0, 1)]
    for table in (aggregate.aggregate_stats(rows, ["g"]), aggregate.stats_final(half[0].unionByName(half[1]), ["g"])):
        assert {r["g"]: r["std"] for r in table.collect()} == {1: pytest.approx(np.sqrt(2.5)), 2: None}


def test_several_values_of_a_place(spark):
    rows = spark.createDataFrame([(0, 1, 2.0), (0, 1, 5.0), (0, 1, None), (0, 3, 1.0), (1, 0, None), (2, 4, 9.0)], "x int, t int, v double")
    dims = [cube.Dim("x", 3, True), cube.Dim("t", 5, False)]
    got = [r["measure"] for r in cube.from_long(rows, "v", dims, fill=0.0).orderBy("id_dim").collect()]
    assert got == [[0.0, 5.0, 0.0, 1.0, 0.0], [0.0] * 5, [0.0, 0.0, 0.0, 0.0, 9.0]]


def test_many_places_take_time_in_proportion(spark):
    import time

    start = time.perf_counter()
    long = spark.range(20 * 4000).select((F.col("id") % 20).cast("int").alias("x"), F.expr("cast(id div 20 as int)").alias("t"), F.col("id").cast("double").alias("v"))
    rows = cube.from_long(long, "v", [cube.Dim("x", 20, True), cube.Dim("t", 4000, False)])
    assert {r[0] for r in rows.select(F.size("measure")).collect()} == {4000} and time.perf_counter() - start < 15


def test_numbers_of_uneven_keys(monkeypatch, spark):
    monkeypatch.setattr(select, "MOST_ROWS", 10)
    keys = spark.range(1, 500).unionByName(spark.createDataFrame([(10**18,)], "id long")).withColumnRenamed("id", "id_dim").withColumn("k", F.col("id_dim"))
    got = select.renumbered(keys, 1).orderBy("k").collect()
    assert [r["id_dim"] for r in got] == list(range(1, 501)) and got[0].asDict().keys() == {"id_dim", "k"}


def test_extras(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 4, 1.0), (1, 9, 2.0)], "k int, t int, v double")
    assert sorted(map(tuple, extra.asof(left, right, "t", "k", "v").collect()), key=str) == [(1, 5, 1.0), (1, 9, 2.0), (2, 1, None)]
    keys = spark.range(10).withColumnRenamed("id", "id_dim")
    assert [r[0] for r in select.renumbered(keys.where("id_dim % 3 = 0"), 7).orderBy("id_dim").collect()] == [7, 8, 9, 10]


def _netcdf(values: np.ndarray) -> bytes:
    name = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 2) + name("y") + struct.pack(">i", 2) + name("x") + struct.pack(">i", 3) + struct.pack(">ii", 0, 0)
    var = struct.pack(">ii", 11, 1) + name("t") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 6, 48)
    return head + var + struct.pack(">i", len(head) + len(var) + 4) + values.astype(">f8").tobytes()


def test_netcdf(spark, tmp_path):
    values = np.arange(6.0).reshape(2, 3)
    (tmp_path / "a.nc").write_bytes(_netcdf(values))
    rows = netcdf.read_variable(spark, str(tmp_path / "a.nc"), "t")
    assert sorted(map(tuple, rows.collect())) == [(y, x, values[y, x]) for y in range(2) for x in range(3)]
    with pytest.raises(ValueError):
        netcdf.variable(b"HDF....", "t")


def test_stream(spark, tmp_path):
    from cubeframe.streaming import windows

    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 00:50:00", 3.0), (2, "2024-01-01 01:10:00", 4.0)], "k int, ts string, v double").select("k", F.to_timestamp("ts").alias("ts"), "v")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = windows.windowed(stream, "ts", "k", "v").writeStream.format("memory").queryName("cf_windows").outputMode("complete").start()
    try:
        run.processAllAvailable()
        assert sorted((r["k"], r["n"], r["total"]) for r in spark.table("cf_windows").collect()) == [(1, 2, 5.0), (2, 1, 4.0)]
    finally:
        run.stop()
    assert windows.sessions(rows, "ts", "k", "v", "45 minutes").count() == 2


def test_sequential_ids_compute_rows_twice(spark):
    """Numbering, storing and exporting a fragment run over its rows for the keys and for the result, not once more per step."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def odd(k):
        seen.add(1)
        return k % 2 == 1

    s = Session(spark)
    s.create_database("d")
    s.use("d")
    s.store("rows", spark.range(200).where(odd("id")).select(F.col("id").alias("id_dim"), F.array(F.col("id") * 1.0).alias("measure")))
    s.subset("rows", 10, "reverse(measure)", "part", "size_array(measure) > 0")
    got = s.export("part").collect()
    assert [(r["id_dim"], r["measure"]) for r in got] == [(10 + i, [2.0 * i + 1]) for i in range(100)]
    assert seen.value <= 2 * 200
