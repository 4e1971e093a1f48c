import pytest
from pyspark.sql import functions as F

from cubeframe.functions import index
from cubeframe.plans import language
from cubeframe.plans.expression import ExpressionError, compile_expression, condition, parse, variables


def value(spark, text, args=None, **columns):
    rows = spark.range(1).select(*[F.lit(v).alias(n) for n, v in columns.items()])
    return rows.select(compile_expression(text, F.col, args)).first()[0]


@pytest.mark.parametrize(("text", "wanted"), [("1 + 2 * 3", 7.0), ("(1 + 2) * 3", 9.0), ("7 / 2", 3.5), ("7 % 4", 3), ("1 = 1 AND NOT 2 = 3", 1), ("a = b + 1", 1), ("-a + 3", 0.0), ("a-1", 2.0), ("1 > 2 or a >= 3", 1), ("NULL", None), ("3 / 0", None), ("'x' = \"x\"", 1)])
def test_values(spark, text, wanted):
    assert value(spark, text, a=3, b=2) == wanted


#: A grid of 7 rows and 11 columns: id_dim = 11 * (row - 1) + column.
ROW, COLUMN = "id_to_index2(id_dim, 11, 7)", "id_to_index2(id_dim, 1, 11)"


@pytest.mark.parametrize(("text", "wanted"), [
    (f"{ROW} = 3 AND {COLUMN} <= 2", [23, 24]),
    (f"is_in_subset({ROW}, 2, 3, 7) AND is_in_subset({COLUMN}, 4, 5, 11)", [15, 20, 48, 53]),
    (f"(is_in_subset({ROW}, 6, 1, 6) OR {ROW} = 1) AND NOT is_in_subset({COLUMN}, 1, 1, 9)", [10, 11, 65, 66]),
    ("is_in_subset(id_dim, 70, 4, 77)", [70, 74]),
])
def test_subsets_of_a_grid(spark, text, wanted):
    grid = spark.range(1, 78).withColumnRenamed("id", "id_dim")
    assert [r[0] for r in grid.where(condition(text, F.col)).orderBy("id_dim").collect()] == wanted


def test_groups_of_uneven_sizes(spark):
    """Groups of 2, 1 and 4 ids, repeating: 1 2 | 3 | 4 5 6 7 | 8 9 | 10 | ..."""
    rows = spark.range(1, 11).orderBy("id").select(index.block_id3(F.col("id"), F.array(*[F.lit(n) for n in (2, 1, 4)]), 1))
    assert [r[0] for r in rows.collect()] == [1, 1, 2, 3, 3, 3, 3, 4, 4, 5]


@pytest.mark.parametrize("text", ["(1 + 2", "1 +", "a ~ b", "f(1,", "id_to_index2(id_dim, 11, 7, 1)", "id_to_index2(id_dim)", "id_to_index(id_dim)", "nosuch(1)", "missing + 1"])
def test_errors(spark, text):
    with pytest.raises(ValueError):
        compile_expression(text, {"id_dim": F.col("id_dim")}.__getitem__)


def test_variables():
    assert variables("?3 * lat - reverse(lon, ?1) / lat") == {"lat", "lon", "?1", "?3"}
    assert variables("7 + 'lat'") == set()


def test_condition_takes_any_number(spark):
    assert [r[0] for r in spark.range(4).where(condition("id - 2", F.col)).collect()] == [0, 1, 3]


def test_statement():
    q = language.statement("operation=select;field=a|f('x|y;z', b);from=d.f;field=other;")
    assert language.values(q["field"]) == ["a", "f('x|y;z', b)"]
    for bad in ("field=a", "operation", "operation=select;field='a"):
        with pytest.raises(language.LanguageError):
            language.statement(bad)


def test_parse_is_a_tree():
    assert parse("a = 1 + 2") == ("op", "=", ("name", "a"), ("op", "+", ("num", 1), ("num", 2)))
    with pytest.raises(ExpressionError):
        parse("")
