"""A session: the current database, its fragments, and the statements of the query language on them.

Fragments on the device ``memory`` live in the session as lazy DataFrames; on ``parquet`` they are tables of the Spark catalog. Every statement
compiles to DataFrame operations; nothing is collected but what ``fetch`` returns.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import select as sel
from ..sources import cube, generate
from . import expression as ex
from . import language as la

#: Column types of the language (fixed values). A blob is an array of doubles.
COLUMN_TYPES: dict[str, T.DataType] = {
    **dict.fromkeys(("int", "integer", "long"), T.LongType()),
    **dict.fromkeys(("double", "float", "real"), T.DoubleType()),
    **dict.fromkeys(("char", "varchar", "string"), T.StringType()),
    "blob": T.ArrayType(T.DoubleType()),
}


class SessionError(ValueError):
    """A statement that cannot run: an unknown name, a wrong argument."""


class Session:
    def __init__(self, spark: SparkSession, device: str = "memory"):
        if device not in ("memory", "parquet"):
            raise SessionError(f"unknown device {device!r}")
        self.spark, self.device = spark, device
        self.databases: dict[str, dict[str, DataFrame]] = {}
        self.current: str | None = None
        self.result: DataFrame | None = None
        self._pending: dict[str, tuple[T.StructType, list[tuple]]] = {}
        self._files: dict[str, DataFrame] = {}
        #: Whether the last query numbered rows, and the fragments that were found to have rows when stored.
        self._numbered = False
        self._filled: set[tuple[str, str]] = set()

    # The catalog.

    def create_database(self, name: str) -> None:
        self.databases.setdefault(name.lower(), {})
        if self.device == "parquet":
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name.lower()}`")

    def drop_database(self, name: str) -> None:
        self.databases.pop(name.lower(), None)
        if self.device == "parquet":
            self.spark.sql(f"DROP DATABASE IF EXISTS `{name.lower()}` CASCADE")
        if self.current == name.lower():
            self.current = None

    def use(self, name: str) -> None:
        if name.lower() not in self.databases:
            raise SessionError(f"unknown database {name!r}")
        self.current = name.lower()

    def _place(self, name: str) -> tuple[str, str]:
        db, _, frag = name.strip().lower().rpartition(".")
        db = db or self.current or ""
        if db not in self.databases:
            raise SessionError(f"no database for {name!r}")
        return db, frag

    def exists(self, name: str) -> bool:
        db, frag = self._place(name)
        return frag in self.databases[db]

    def fragment(self, name: str) -> DataFrame:
        db, frag = self._place(name)
        if frag not in self.databases[db]:
            raise SessionError(f"unknown fragment {name!r}")
        return self.databases[db][frag]

    def store(self, name: str, rows: DataFrame, replace: bool = False) -> None:
        db, frag = self._place(name)
        if frag in self.databases[db] and not replace:
            raise SessionError(f"fragment {name!r} exists")
        if self.device == "parquet":
            rows.write.mode("overwrite").saveAsTable(f"`{db}`.`{frag}`")
            rows = self.spark.table(f"`{db}`.`{frag}`")
        self.databases[db][frag] = rows
        self._filled.discard((db, frag))

    def drop_fragment(self, name: str) -> None:
        db, frag = self._place(name)
        if self.databases[db].pop(frag, None) is not None and self.device == "parquet":
            self.spark.sql(f"DROP TABLE IF EXISTS `{db}`.`{frag}`")

    def attach_file(self, name: str, rows: DataFrame) -> None:
        """Give the long table that ``src_path=name`` of an import means, instead of a path."""
        self._files[name] = rows

    # Statements.

    def execute(self, text: str, args: list[Any] | None = None) -> DataFrame | None:
        """Run a statement; a query's rows are returned and kept as ``result``."""
        q = la.statement(text)
        name = q["operation"].lower()
        if name not in STATEMENTS:
            raise SessionError(f"unknown operation {q['operation']!r}")
        return STATEMENTS[name](self, q, list(args or []))

    def execute_many(self, text: str, runs: list[list[Any]]) -> None:
        """Run an insert once per list of arguments, and store the fragment after the last."""
        q = la.statement(text)
        for args in runs:
            self.execute(text, args)
        (name,) = self._need(q, "frag_name")
        if name.lower() in self._pending:
            self.finish(name)

    def fetch(self) -> list[tuple]:
        """The rows of the last query."""
        return [] if self.result is None else [tuple(r) for r in self.result.collect()]

    @staticmethod
    def _need(q: dict[str, str], *keys: str) -> list[str]:
        for k in keys:
            if not q.get(k):
                raise SessionError(f"{q['operation']} needs {k}=")
        return [q[k] for k in keys]

    def _create_database(self, q: dict, _: list) -> None:
        self.create_database(*self._need(q, "db_name"))

    def _drop_database(self, q: dict, _: list) -> None:
        self.drop_database(*self._need(q, "db_name"))

    def _use_database(self, q: dict, _: list) -> None:
        self.use(*self._need(q, "db_name"))

    def _schema(self, q: dict) -> T.StructType:
        names, types = (la.values(v) for v in self._need(q, "column_name", "column_type"))
        if len(names) != len(types) or any(t.lower() not in COLUMN_TYPES for t in types):
            raise SessionError("column_name and column_type must match, with known types")
        return T.StructType([T.StructField(n, COLUMN_TYPES[t.lower()]) for n, t in zip(names, types, strict=True)])

    def _create_frag(self, q: dict, _: list) -> None:
        (name,) = self._need(q, "frag_name")
        if self.exists(name):
            raise SessionError(f"fragment {name!r} exists")
        schema = self._schema(q)
        if len(schema) != 2:
            raise SessionError("a fragment has two columns")
        self._pending[name.lower()] = (schema, [])

    def _drop_frag(self, q: dict, _: list) -> None:
        self.drop_fragment(*self._need(q, "frag_name"))

    def _rows(self, q: dict, args: list) -> tuple[str, list[tuple]]:
        name, fields, given = self._need(q, "frag_name", "field", "value")
        if name.lower() not in self._pending:
            raise SessionError(f"no fragment {name!r} is being made")
        schema, _ = self._pending[name.lower()]
        names, parts = la.values(fields), la.values(given)
        if [n.lower() for n in names] != [f.name.lower() for f in schema] or len(parts) % len(names):
            raise SessionError("fields must be the fragment's columns, and values a whole number of rows")
        rows, bound = [], 0
        for start in range(0, len(parts), len(names)):
            row = []
            for part, field in zip(parts[start : start + len(names)], schema, strict=True):
                if part.startswith("?"):
                    bound += 1
                    value = args[int(part[1:] or bound) - 1]
                else:
                    value = None if part.lower() == "null" else la.unquoted(part)
                kind = field.dataType
                if value is not None:
                    value = [float(v) for v in (value.split(",") if isinstance(value, str) else value)] if isinstance(kind, T.ArrayType) else int(value) if isinstance(kind, T.LongType) else float(value) if isinstance(kind, T.DoubleType) else str(value)
                row.append(value)
            rows.append(tuple(row))
        return name.lower(), rows

    def finish(self, name: str) -> None:
        """Store a fragment whose rows were inserted."""
        schema, rows = self._pending.pop(name.lower())
        self.store(name, self.spark.createDataFrame(rows, schema))

    def _insert(self, q: dict, args: list) -> None:
        name, rows = self._rows(q, args)
        if len(rows) != 1:
            raise SessionError("insert takes one row")
        self._pending[name][1].extend(rows)
        if q.get("final_statement", "no").lower() == "yes":
            self.finish(name)

    def _multi_insert(self, q: dict, args: list) -> None:
        name, rows = self._rows(q, args)
        self._pending[name][1].extend(rows)
        if q.get("final_statement", "no").lower() == "yes":
            self.finish(name)

    def _source(self, q: dict, args: list, extra: DataFrame | None = None) -> tuple[DataFrame, Any]:
        """The joined and filtered rows, and the lookup of their columns."""
        names = la.values(*self._need(q, "from"))
        aliases = la.values(q["from_alias"]) if q.get("from_alias") else [n.rpartition(".")[2] for n in names]
        if len(aliases) != len(names):
            raise SessionError("from and from_alias must match")
        frames = [extra if n.lower() in ("@file", "@esdm") else self.fragment(n) for n in names]
        if len(names) == 1:
            rows = frames[0]
            columns = {c.lower(): c for c in rows.columns} | {f"{aliases[0].lower()}.{c.lower()}": c for c in rows.columns}
        else:
            if not q.get("where"):
                raise SessionError("several fragments need where=")
            named, columns = [], {sel.KEY: sel.KEY}
            for alias, f in zip(aliases, frames, strict=True):
                own = {c: c if c == sel.KEY else f"{alias.lower()}__{c}" for c in f.columns}
                named.append(f.withColumnsRenamed(own))
                columns |= {f"{alias.lower()}.{c.lower()}": n for c, n in own.items()}
            rows = sel.aligned(*named)

        def lookup(name: str) -> Column:
            return F.col(columns[name.lower()])

        if q.get("where"):
            rows = rows.where(ex.condition(q["where"], lookup, args))
        return rows, lookup

    def _query(self, q: dict, args: list, extra: DataFrame | None = None) -> DataFrame:
        rows, lookup = self._source(q, args, extra)
        (field,) = self._need(q, "field")
        texts = la.values(field)
        names = la.values(q["select_alias"]) if q.get("select_alias") else [""] * len(texts)
        if len(names) != len(texts):
            raise SessionError("field and select_alias must match")
        names = [n or t for n, t in zip(names, texts, strict=True)]
        trees = [ex.parse(t) for t in texts]
        limits = [max(0, int(v)) for v in la.values(q["limit"])] if q.get("limit") else [0]
        rows = sel.limited(rows, limits[-1], limits[0] if len(limits) > 1 else 0)
        self._numbered = False
        if q.get("sequential_id"):
            given, rows = rows, sel.renumbered(rows, int(q["sequential_id"]))
            self._numbered = rows is not given
        if q.get("group") or any(ex.aggregates(t) for t in trees):
            out = self._grouped(q, rows, lookup, trees, names, args)
        else:
            columns = []
            for tree, name in zip(trees, names, strict=True):
                c = ex.build(tree, lookup, args)
                columns.append((c if isinstance(c, Column) else F.lit(c)).alias(name))
            extra_key = [F.col(sel.KEY).alias("_cf_key")] if q.get("order") and sel.KEY in rows.columns else []
            out = rows.select(*columns, *extra_key)
        if q.get("order"):
            out = sel.ordered(out, q["order"], q.get("order_dir", "asc").lower() == "desc", "_cf_key")
        return out.drop("_cf_key")

    def _grouped(self, q: dict, rows: DataFrame, lookup: Any, trees: list, names: list[str], args: list) -> DataFrame:
        """One row per group, in no order but the one asked for: all aggregates over rows are taken in one pass over the exploded cells."""
        by = ex.compile_expression(q["group"], lookup, args) if q.get("group") else F.lit(1)
        rows = rows.withColumn("_group", by)
        plain, simple, over = {}, {}, []
        for i, tree in enumerate(trees):
            calls = ex.aggregates(tree)
            over += [(f"_a{len(over) + n}", call) for n, call in enumerate(calls)]
            if not calls:
                c = ex.build(tree, lookup, args)
                (simple if tree[0] == "call" else plain)[f"_f{i}"] = c if isinstance(c, Column) else F.lit(c)
        out = sel.grouped(rows, F.col("_group"), plain, simple)
        cells, states, whole = {}, {}, {}
        for name, call in over:
            primitive = ex.registry.resolve(call[1])
            parts = [p for p in (ex.build(a, lookup, args) for a in call[2]) if not ex.registry.is_type(p)]
            if primitive.kind == "rows":
                whole[name] = primitive.build(parts[0], F.col(sel.KEY), *parts[1:]).alias(name)
            else:
                cells[name], states[name] = parts[0], primitive.build(F.col(f"x.{name}"), *parts[1:])
        tables = []
        if whole:
            tables.append(rows.groupBy("_group").agg(*whole.values()))
        if cells:
            zipped = F.arrays_zip(*[c.alias(n) for n, c in cells.items()])
            long = rows.select("_group", F.posexplode(zipped).alias("pos", "x"), F.struct(*[F.size(c).alias(n) for n, c in cells.items()]).alias("n"))
            # A cell shorter than the others of its row ends where it ends.
            taken = long.groupBy("_group", "pos").agg(*[F.struct((F.max(f"n.{n}") > F.col("pos")).alias("there"), s.alias("v")).alias(n) for n, s in states.items()])
            sorted_ = {n: F.array_sort(F.collect_list(F.when(F.col(f"{n}.there"), F.struct("pos", F.col(f"{n}.v").alias("v"))))) for n in states}
            tables.append(taken.groupBy("_group").agg(*[F.transform(c, lambda s: s["v"]).alias(n) for n, c in sorted_.items()]))
        for table in tables:
            own = table.withColumnRenamed("_group", "_g")
            out = out.join(own, out["_group"].eqNullSafe(own["_g"]), "left").drop("_g")
        columns = []
        for i, (tree, name) in enumerate(zip(trees, names, strict=True)):
            if f"_f{i}" in plain or f"_f{i}" in simple:
                columns.append(F.col(f"_f{i}").alias(name))
            else:
                marked = _with(tree, {id(call): ("name", column) for column, call in over})
                columns.append(ex.build(marked, lambda n: F.col(n), args).alias(name))
        return out.select(*columns, F.col("_first").alias("_cf_key"))

    def _select(self, q: dict, args: list) -> DataFrame:
        self.result = self._query(q, args)
        return self.result

    def _create_frag_select(self, q: dict, args: list, extra: DataFrame | None = None) -> None:
        (name,) = self._need(q, "frag_name")
        if self.exists(name):
            raise SessionError(f"fragment {name!r} exists")
        rows = self._query(q, args, extra)
        if len(rows.columns) != 2:
            raise SessionError("a fragment has two columns")
        # Numbering has counted the rows; the lazy ones aren't computed again to see one.
        if not self._numbered and not rows.head(1):
            raise SessionError("the selection is empty")
        self.store(name, rows)
        self._filled.add(self._place(name))

    def _imported(self, q: dict) -> DataFrame:
        """The fragment of an import: from a long table, whose columns are the dimensions and the measure."""
        path, measure = self._need(q, "src_path", "measure")
        kinds, order, starts, ends = ([int(v) for v in la.values(v)] for v in self._need(q, "dim_type", "dim_index", "dim_start", "dim_end"))
        if not len(kinds) == len(order) == len(starts) == len(ends):
            raise SessionError("dim_type, dim_index, dim_start and dim_end must match")
        if sorted(order) != list(range(len(order))):
            raise SessionError("dim_index must be a permutation of the levels")
        tables = []
        for part in la.values(path):
            if ".." in part:
                raise SessionError("a path must not lead upwards")
            if part in self._files:
                tables.append(self._files[part])
            elif part.endswith(".nc"):
                from ..sources.netcdf import read_variable

                tables.append(read_variable(self.spark, part, measure))
            else:
                tables.append(self.spark.read.parquet(part))
        names = la.values(q["dim_name"]) if q.get("dim_name") else [c for c in tables[0].columns if c != measure]
        if len(names) != len(kinds):
            raise SessionError("the table must have a column per dimension")
        rows = tables[0]
        if len(tables) > 1:
            along = names[int(self._need(q, "dim_unlim")[0])]
            sizes = [t.agg(F.max(along)).first()[0] + 1 for t in tables]
            rows = cube.concatenated(tables, along, sizes)
        dims = [cube.Dim(names[i], ends[i] + 1, kinds[i] == 1, starts[i], ends[i]) for i in sorted(range(len(names)), key=order.__getitem__)]
        kind = q.get("measure_type", "double").lower().rpartition("_")[2]
        if kind not in generate.TYPES:
            raise SessionError(f"unknown measure_type {kind!r}")
        if q.get("sub_operation"):
            return cube.reduced_at_source(rows, measure, dims, q["sub_operation"])
        return cube.from_long(rows, measure, dims, row_start=int(q.get("row_start", 1)), nrows=int(q["nrows"]) if q.get("nrows") else None, kind=generate.TYPES[kind])

    def _file_import(self, q: dict, _: list) -> None:
        self.store(*self._need(q, "frag_name"), self._imported(q))

    _esdm_import = _file_import

    def _create_frag_select_file(self, q: dict, args: list) -> None:
        self._create_frag_select(q, args, self._imported(q))

    _create_frag_select_esdm = _create_frag_select_file

    def _random_import(self, q: dict, _: list) -> None:
        name, kind, nrows, length = self._need(q, "frag_name", "measure_type", "nrows", "array_len")
        self.store(name, generate.random_fragment(self.spark, int(nrows), int(length), kind, q.get("algorithm", "default"), int(q.get("row_start", 1)), int(q.get("seed", 0))))

    # Procedures.

    def _function(self, q: dict, args: list) -> DataFrame | None:
        name, given = self._need(q, "func", "arg")
        parts = [la.unquoted(v) for v in la.values(given)]
        run = {"subset": self.subset, "export": self.export, "size": self.size}.get(name.lower().rpartition("_")[2])
        if run is None:
            raise SessionError(f"unknown procedure {name!r}")
        return run(*parts)

    def subset(self, source: str, id_start: str | int, field: str, target: str, where: str = "") -> None:
        """A new fragment of an expression over another's rows; with ``where`` the ids start anew from ``id_start``."""
        q = {"operation": "create_frag_select", "field": f"{sel.KEY}|{field}", "select_alias": f"{sel.KEY}|measure", "from": source, "frag_name": target}
        if where:
            q |= {"where": where, "sequential_id": str(id_start)}
        self._create_frag_select(q, [])

    def export(self, source: str) -> DataFrame:
        """All rows of a fragment by id."""
        rows = self.fragment(source)
        if self._place(source) not in self._filled and not rows.head(1):
            raise SessionError(f"fragment {source!r} is empty")
        self.result = rows.orderBy(sel.KEY)
        return self.result

    def size(self, *names: str) -> DataFrame:
        """One row frag_size: the bytes of all cells of the fragments, looked up in every database."""
        total = None
        for name in names:
            found = [d[name.lower()] for d in self.databases.values() if name.lower() in d] or [self.fragment(name)]
            for rows in found:
                part = fragment_size(rows)
                total = part if total is None else total.unionByName(part)
        self.result = total.agg(F.sum("frag_size").alias("frag_size"))
        return self.result


#: The statements of the language.
STATEMENTS = {
    "create_database": Session._create_database, "drop_database": Session._drop_database, "use_database": Session._use_database,
    "create_frag": Session._create_frag, "drop_frag": Session._drop_frag, "insert": Session._insert, "multi_insert": Session._multi_insert,
    "select": Session._select, "create_frag_select": Session._create_frag_select, "create_frag_select_file": Session._create_frag_select_file, "create_frag_select_esdm": Session._create_frag_select_esdm,
    "file_import": Session._file_import, "esdm_import": Session._esdm_import, "random_import": Session._random_import, "function": Session._function,
}


def fragment_size(rows: DataFrame) -> DataFrame:
    """One row frag_size: 8 bytes per key and array, plus the elements (of 8 bytes, or of their type)."""
    width = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "boolean": 1}
    cells = F.lit(0)
    for name, kind in rows.dtypes:
        if kind.startswith("array"):
            cells += F.coalesce(F.size(name), F.lit(0)) * width.get(kind[6:-1], 8) + 8
        elif kind == "string":
            cells += F.coalesce(F.octet_length(name), F.lit(0)) + 8
        else:
            cells += 8
    return rows.agg(F.coalesce(F.sum(cells), F.lit(0)).cast("long").alias("frag_size"))


def _with(tree: Any, new: dict[int, Any]) -> Any:
    """The tree with the parts of these identities replaced."""
    if id(tree) in new:
        return new[id(tree)]
    if isinstance(tree, tuple):
        return tuple(_with(x, new) for x in tree)
    return [_with(x, new) for x in tree] if isinstance(tree, list) else tree
