"""The engine's surface: statements in, DataFrames out."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import dml
from lodestone.plans import nodes as n
from lodestone.plans import values as v
from lodestone.plans.explain import described
from lodestone.plans.parser import DialectError, parse
from lodestone.plans.select import Compiler, groupable
from lodestone.sources.catalog import RID, Catalog, Collection, Conflict, Counter

EMPTY = f"(SELECT CAST(NULL AS BIGINT) AS `{RID}` WHERE FALSE)"


@dataclass
class Result:
    """df: a query's rows, not yet computed. Changes say how many documents they touched and the last new one's id."""

    df: DataFrame | None = None
    rows_affected: int = 0
    last_insert_id: int | None = None

    def rows(self) -> list[Row]:
        return self.df.collect() if self.df is not None else []


class Session:
    """A database: in `root` if one is given, else for as long as the session lasts."""

    def __init__(self, spark: SparkSession, root: str | None = None, read_only: bool = False):
        self.spark, self.catalog = spark, Catalog(spark, root, read_only)
        self._open: list[str] = []
        self._transaction = None

    # Statements

    def execute(self, sql: str, params: tuple | list = ()) -> Result:
        statement, wanted = parse(sql)
        if wanted != len(params):
            raise DialectError(f"{wanted} parameters wanted, {len(params)} given")
        return self.run(statement, tuple(params))

    def query(self, sql: str, params: tuple | list = ()) -> DataFrame:
        df = self.execute(sql, params).df
        if df is None:
            raise DialectError("not a query")
        return df

    def compiler(self, params: tuple = ()) -> Compiler:
        return Compiler(self, params, self.draw)

    def compiled(self, statement: n.Select | n.Union, params: tuple = ()) -> DataFrame:
        if isinstance(statement, n.Union):
            left, right = self.compiled(statement.left, params), self.compiled(statement.right, params)
            return united(left, right, statement.all)
        if any(h == "NO_CACHE" for h, _ in statement.hints):
            for name in (statement.table, *[j.table for j in statement.joins]):
                if (df := self.catalog.frame(name)) is not None:
                    df.unpersist()
        out = self.spark.sql(Compiler(self, params, None).select(statement)[0])
        if not self._open:
            self.catalog.passed()
        return out

    def run(self, s, params: tuple = ()) -> Result:
        if isinstance(s, n.Select | n.Union):
            return Result(self.compiled(s, params))
        if isinstance(s, n.Explain):
            said = described(self, s.statement)
            return Result(self.spark.createDataFrame([Row(**said)]))
        with self.changing():
            return self.change(s, params)

    @contextmanager
    def changing(self) -> Iterator[None]:
        """The one way to a change: refused when reading only, whole or not at all, and committed unless a transaction is open."""
        self.catalog.writable()
        before = self.catalog.state.snapshot()
        sequences = self.catalog.state.sequences
        try:
            yield
            if self._transaction is None:
                self.catalog.save()
        except Conflict:
            self.catalog.load()
            raise
        except BaseException:
            before.sequences = sequences  # numbers that were drawn stay drawn
            self.catalog.state = before
            self.catalog.forget()
            raise
        finally:
            self.catalog.passed()

    def change(self, s, params: tuple) -> Result:
        state, compiler = self.catalog.state, self.compiler(params)
        match s:
            case n.Insert():
                if s.table in state.views:
                    raise DialectError(f"{s.table} is a view")
                if s.select:
                    count, last = dml.insert_select(self.catalog, s.table, self.compiled(s.select, params))
                else:
                    rows = [dml.document(r, compiler, self.catalog) for r in s.rows]
                    count, last = (dml.upsert if s.replace else dml.insert_rows)(self.catalog, s.table, rows)
                return Result(None, count, last)
            case n.Update():
                return Result(None, dml.update(self.catalog, compiler, s))
            case n.Delete():
                return Result(None, dml.delete(self.catalog, compiler, s))
            case n.Truncate(table):
                self.known(table)
                c = state.collections[table]
                count = self.catalog.rows(table)
                state.collections[table] = Collection(c.schema)
                self.catalog.forget(table)
                return Result(None, count)
            case n.Drop("TABLE", table, _, lenient):
                if table not in state.collections and lenient:
                    return Result()
                self.known(table)
                del state.collections[table]
                state.indexes = [i for i in state.indexes if i[0] != table]
                self.catalog.forget(table)
            case n.Create("VIEW"):
                state.views[s.name] = s.text
            case n.Drop("VIEW", name, _, lenient):
                if name not in state.views and not lenient:
                    raise DialectError(f"no view {name}")
                state.views.pop(name, None)
            case n.Create("INDEX"):
                if (s.name, s.path) in state.indexes:
                    if not s.lenient:
                        raise DialectError(f"there is an index on {s.name}({s.path})")
                else:
                    state.indexes.append((s.name, s.path))
                    self.catalog.sort(s.name, s.path)
            case n.Drop("INDEX", table, path, lenient):
                if (table, path) not in state.indexes:
                    if not lenient:
                        raise DialectError(f"no index on {table}({path})")
                else:
                    state.indexes.remove((table, path))
            case n.Create("SEQUENCE"):
                if s.name.lower() in state.sequences:
                    raise DialectError(f"there is a sequence {s.name}")
                state.sequences[s.name.lower()] = Counter(**s.options)
            case n.Drop("SEQUENCE", name, _, lenient):
                if name.lower() not in state.sequences and not lenient:
                    raise DialectError(f"no sequence {name}")
                state.sequences.pop(name.lower(), None)
        return Result()

    def known(self, table: str) -> None:
        if table not in self.catalog.state.collections:
            raise DialectError(f"no collection {table}")

    def draw(self, name: str, how: str) -> int:
        c = self.catalog.state.sequences.get(name.lower())
        if c is None:
            raise DialectError(f"no sequence {name}")
        if how == "CURRVAL":
            if c.now is None:
                raise DialectError(f"{name} hasn't been drawn from")
            return c.now
        new = c.start if c.now is None else c.now + c.increment
        if not c.minvalue <= new <= c.maxvalue:
            if not c.cycle:
                raise DialectError(f"{name} is used up")
            new = c.minvalue if c.increment > 0 else c.maxvalue
        c.now = new
        return new

    # Names

    def frame(self, name: str) -> DataFrame | None:
        if name in self.catalog.state.views:
            if name in self._open:
                raise DialectError(f"the view {name} is made of itself")
            self._open.append(name)
            try:
                return self.compiled(parse(self.catalog.state.views[name])[0])
            finally:
                self._open.pop()
        return self.catalog.frame(name)

    def source(self, name: str) -> tuple[str, T.StructType]:
        if name in self.catalog.state.views:
            df = self.frame(name)
            return self.catalog.view(df), df.schema
        return self.catalog.table(name) or (EMPTY, T.StructType([]))

    # Other ways in and out

    def register(self, name: str, df: DataFrame, documents: dict[str, str | None] | None = None) -> None:
        """df as a collection. documents: text columns that hold JSON, with their type; None: as observed over all rows."""
        for column, type_ in (documents or {}).items():
            if type_ is None:
                said = df.select(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]
                type_ = said.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
            df = df.withColumn(column, F.from_json(column, type_))
        self.catalog.register(name, df)

    def insert_json(self, table: str, text: str) -> Result:
        """A JSON object, or an array of them; whole numbers become integers."""
        said = json.loads(text, parse_float=lambda x: int(float(x)) if float(x).is_integer() else float(x))
        rows = said if isinstance(said, list) else [said]
        if not all(isinstance(r, dict) for r in rows):
            raise DialectError("only objects are documents")
        with self.changing():
            return Result(None, *dml.insert_rows(self.catalog, table, rows))

    def import_json(self, table: str, path: str) -> Result:
        """A file or folder of JSON, one object or array of objects a file, read by Spark."""
        with self.changing():
            df = self.spark.read.option("multiLine", True).option("prefersDecimal", False).json(path)
            return Result(None, *dml.insert_select(self.catalog, table, df))

    def documents(self, table: str, ids: list[int]) -> DataFrame:
        """The documents with these record ids, which INSERT says and no other document ever gets; the ids themselves as `_rid`."""
        self.known(table)
        if self.catalog.state.collections[table].registered:
            raise DialectError(f"{table} is a registered frame; its rows have no ids yet")
        return self.catalog.frame(table).where(F.col(RID).isin(list(ids)))

    def begin(self) -> Transaction:
        self.catalog.writable()
        if self._transaction is not None:
            raise DialectError("a transaction is open")
        self._transaction = Transaction(self)
        return self._transaction

    def collections(self) -> list[str]:
        return sorted(self.catalog.state.collections)

    def views(self) -> dict[str, str]:
        return dict(self.catalog.state.views)

    def indexes(self) -> list[tuple[str, str]]:
        return list(self.catalog.state.indexes)

    def sequences(self) -> list[str]:
        return sorted(self.catalog.state.sequences)

    def cache_stats(self) -> dict[str, int]:
        """Spark's storage stands for a page cache: partitions that are held count as hits."""
        held = sum(i.numCachedPartitions() for i in self.spark.sparkContext._jsc.sc().getRDDStorageInfo())
        return {"cache_hits": held, "cache_misses": 0}

    def schema(self, table: str) -> list[dict]:
        """A row for each leaf path: the kinds observed, and how many documents have it. One pass over the collection."""
        self.known(table)
        df = self.catalog.frame(table)
        leaves: list[tuple[str, str, T.DataType]] = []

        def walk(name: str, sql: str, t: T.DataType) -> None:
            if isinstance(t, T.StructType):
                for f in t:
                    walk(f"{name}.{f.name}" if name else f.name, f"{sql}.`{f.name}`" if sql else f"`{f.name}`", f.dataType)
            elif name != RID:
                leaves.append((name, sql, t))

        walk("", "", df.schema)
        kinds = {T.StringType: "string", T.LongType: "int64", T.IntegerType: "int64", T.DoubleType: "float64", T.BooleanType: "bool", T.NullType: "null"}
        columns = [F.count(F.lit(1)).alias("n")]
        for i, (_, sql, t) in enumerate(leaves):
            columns.append(F.expr(f"count({sql})").alias(f"c{i}"))
            if isinstance(t, T.VariantType):
                columns.append(F.expr(f"sort_array(collect_set(schema_of_variant({sql})))").alias(f"t{i}"))
        found = df.agg(*columns).first()
        names = {"BIGINT": "int64", "STRING": "string", "BOOLEAN": "bool", "DOUBLE": "float64"}
        out = []
        for i, (name, _, t) in enumerate(leaves):
            said = [names.get(x, "float64" if x.startswith("DECIMAL") else "unknown") for x in found[f"t{i}"]] if isinstance(t, T.VariantType) else [kinds.get(type(t), "unknown")]
            out.append({"path": name, "types": sorted(set(said)), "count": found[f"c{i}"], "total": found["n"]})
        return out

    def dump(self) -> Iterator[str]:
        """Statements that make the database again, an INSERT a document, a partition at a time."""
        for table, path in self.catalog.state.indexes:
            yield f"CREATE INDEX ON {table} ({path});"
        for name, text in self.catalog.state.views.items():
            yield f"CREATE VIEW {name} AS {text};"
        for name in self.collections():
            df = self.catalog.frame(name)
            plain = df.drop(RID)
            for row in plain.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in plain.columns]), {"ignoreNullFields": "true"})).toLocalIterator():
                yield f"INSERT INTO {name} VALUES {row[0]};"

    def vacuum(self) -> int:
        """Refused in a transaction: a rollback needs the parts that it would delete."""
        if self._transaction is not None:
            raise DialectError("vacuum runs outside of transactions")
        try:
            return self.catalog.vacuum()
        except Conflict:
            self.catalog.load()
            raise


class Transaction:
    """Statements that count together or not at all; readers of the manifest see none until commit."""

    def __init__(self, session: Session):
        self.session, self.before = session, session.catalog.state.snapshot()

    def _check(self) -> None:
        if self.session._transaction is not self:
            raise DialectError("the transaction is over")

    def execute(self, sql: str, params: tuple | list = ()) -> Result:
        self._check()
        return self.session.execute(sql, params)

    def commit(self) -> None:
        self._check()
        self.session._transaction = None
        try:
            self.session.catalog.save()
        except Conflict:
            self.session.catalog.load()
            raise

    def rollback(self) -> None:
        self._check()
        self.session._transaction = None
        self.session.catalog.state = self.before
        self.session.catalog.forget()


def united(left: DataFrame, right: DataFrame, every: bool) -> DataFrame:
    """By name if the names are the same, by place if only their number is, else by name with nulls for what one side lacks. Kinds that differ meet as text."""
    if set(left.columns) == set(right.columns):
        right = right.select(*[F.col(v.quoted(c)) for c in left.columns])
    elif len(left.columns) == len(right.columns):
        right = right.toDF(*left.columns)
    other = {f.name: f.dataType for f in right.schema}
    mixed = [f.name for f in left.schema if f.name in other and v.common([f.dataType, other[f.name]]) is None]
    if mixed:
        left, right = (df.select(*[F.expr(v.as_string(v.Value(v.quoted(f.name), f.dataType)) if f.name in mixed else v.quoted(f.name)).alias(f.name) for f in df.schema]) for df in (left, right))
    if every:
        return left.unionByName(right, allowMissingColumns=True)
    if all(groupable(f.dataType) for df in (left, right) for f in df.schema):
        return left.unionByName(right, allowMissingColumns=True).distinct()
    # Rows of the same canonical strings are one, and the left side's stands.
    both = left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    shown = [v.Value(v.quoted(f.name), f.dataType) for f in both.schema if f.name != "__side"]
    same = [F.expr(f"if({v.is_null(x)}, NULL, {v.as_string(x)})").alias(f"k{i}") for i, x in enumerate(shown)]
    ranks = [r for x in shown for r in (v.rank(x) if x.kind == "variant" else [])]
    row = F.expr(f"min_by(struct({', '.join(x.sql for x in shown)}), struct({', '.join(['__side', *ranks])}))").alias("row")
    return both.groupBy(*same).agg(row).select("row.*")
