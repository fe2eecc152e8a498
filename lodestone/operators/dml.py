"""INSERT, INSERT OR REPLACE, UPDATE, DELETE: new parts from old ones."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans import nodes as n
from lodestone.plans import values as v
from lodestone.plans.parser import DialectError
from lodestone.plans.select import Compiler, Scope, Source
from lodestone.sources import schema as sch
from lodestone.sources.catalog import FILE, PART, RID, Catalog


def constant(e: n.Expr, compiler: Compiler, catalog: Catalog) -> object:
    match e:
        case n.Literal(value, _):
            return value
        case n.Param(i):
            return compiler.params[i]
        case n.Sequence(name, how):
            return compiler.draw(name, how)
        case n.Array(items):
            return [constant(x, compiler, catalog) for x in items]
        case n.Document():
            return document(e, compiler, catalog)
    out = catalog.spark.sql(f"SELECT {compiler.value(e, Scope([])).sql} AS x").first()[0]
    return out.asDict(True) if hasattr(out, "asDict") else out


def document(d: n.Document, compiler: Compiler, catalog: Catalog) -> dict:
    """A dotted name makes the documents on its way, in place of what isn't one."""
    out: dict = {}
    for path, e in d.fields:
        at = out
        for p in path[:-1]:
            if not isinstance(at.get(p), dict):
                at[p] = {}
            at = at[p]
        at[path[-1]] = constant(e, compiler, catalog)
    return out


def frame_of(catalog: Catalog, rows: list[dict], first_id: int) -> DataFrame:
    """A statement's documents as a DataFrame. Conflicting kinds travel as JSON and become VARIANT."""
    s = T.StructType([])
    for r in rows:
        s = sch.merged_fields(s, sch.inferred(r))
    s = sch.settled(s)
    variant = {f.name for f in s if isinstance(f.dataType, T.VariantType)}
    carried = T.StructType([T.StructField(RID, T.LongType()), *[T.StructField(f.name, T.StringType() if f.name in variant else f.dataType) for f in s]])

    def fit(value: object, t: T.DataType) -> object:
        if value is None:
            return None
        if isinstance(t, T.StructType):
            return tuple(fit(value.get(f.name), f.dataType) for f in t)
        if isinstance(t, T.ArrayType):
            return [fit(x, t.elementType) for x in value]
        return float(value) if isinstance(t, T.DoubleType) else value

    data = [(first_id + i, *[json.dumps(r.get(f.name)) if f.name in variant and f.name in r else None if f.name in variant else fit(r.get(f.name), f.dataType) for f in s]) for i, r in enumerate(rows)]
    df = catalog.spark.createDataFrame(data, carried).coalesce(1)  # a statement's rows are one file
    return df.select(RID, *[(F.parse_json(F.col(f"`{f.name}`")) if f.name in variant else F.col(f"`{f.name}`")).alias(f.name) for f in s])


def insert_rows(catalog: Catalog, table: str, rows: list[dict]) -> tuple[int, int | None]:
    return catalog.append(table, frame_of(catalog, rows, catalog.first_free(table))) if rows else (0, None)


def insert_select(catalog: Catalog, table: str, df: DataFrame) -> tuple[int, int | None]:
    return catalog.append(table, df.drop(RID))


def upsert(catalog: Catalog, table: str, rows: list[dict]) -> tuple[int, int | None]:
    """Each row's first field is its key. The first document with an equal key takes the row's fields over, and without one the row is new. Rows of one key field and different keys are one join; a row that repeats a key waits for those before."""
    batches: list[list[dict]] = []
    seen: set = set()
    for r in rows:
        if not r:
            raise DialectError("INSERT OR REPLACE needs a field")
        key, value = next(iter(r.items()))
        if isinstance(value, dict | list):
            raise DialectError("the key of INSERT OR REPLACE is a plain value")
        if not batches or next(iter(batches[-1][0])) != key or value in seen:
            batches.append([])
            seen = set()
        batches[-1].append(r)
        seen.add(value)
    last = None
    for batch in batches:
        last = upsert_batch(catalog, table, batch)
    return len(rows), last


def upsert_batch(catalog: Catalog, table: str, rows: list[dict]) -> int | None:
    key, at = next(iter(rows[0])), {}
    if table in catalog.state.collections:
        catalog.own(table)
        view, schema = catalog.view(catalog.frame(table, at=True)), catalog.state.collections[table].schema
        found = Source(table, schema).column((key,))
        if found is not None and found.kind in ("int", "float", "bool", "str", "variant"):
            keys = ", ".join(f"({i}, {'CAST(NULL AS STRING)' if r[key] is None else v.key(v.literal(r[key]))})" for i, r in enumerate(rows))
            least = f"min(struct(`{RID}`, `{PART}`, `{FILE}`))"
            said = f"SELECT /*+ BROADCAST(k) */ k.i, {least} AS at FROM {view} AS {v.quoted(table)} JOIN (VALUES {keys}) AS k(i, key) ON {v.key(found, 'o')} <=> k.key GROUP BY k.i"
            at = {r.i: r.at for r in catalog.spark.sql(said).collect()}  # a row for each row of the statement at most
    last = at[len(rows) - 1][RID] if len(rows) - 1 in at else None
    if at:
        hit: dict[int, set[str]] = {}
        for where in at.values():
            hit.setdefault(where[PART], set()).add(where[FILE])
        values = frame_of(catalog, [rows[i] for i in at], 0)
        fields = [f for f in values.columns if f != RID]
        has = {k: [i for i, r in zip(at.values(), (rows[i] for i in at), strict=True) if k in r] for k in fields}
        ids = {n: where[RID] for n, where in enumerate(at.values())}
        number = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])[F.col(RID)]
        new = values.select(number.cast("bigint").alias("__id"), *[F.col(v.quoted(k)).alias(f"__v_{k}") for k in fields])
        df = touched(catalog, table, hit).join(F.broadcast(new), F.col(RID) == F.col("__id"), "left")
        for k in fields:
            mine = ", ".join(str(where[RID]) + "L" for where in has[k]) or "NULL"
            df = put(df.withColumn("__hit", F.expr(f"coalesce(`{RID}` IN ({mine}), FALSE)")), (k,), v.Value(v.quoted(f"__v_{k}"), values.schema[k].dataType))
        catalog.replace(table, hit, df.drop("__hit", "__id", *[f"__v_{k}" for k in fields]))
    fresh = [r for i, r in enumerate(rows) if i not in at]
    if fresh:
        _, new_last = insert_rows(catalog, table, fresh)
        last = new_last if len(rows) - 1 not in at else last
    return last


def touched(catalog: Catalog, table: str, hit: dict[int, set[str]]) -> DataFrame:
    """The rows of the files that are hit. Those of a registered frame get ids below those of rows that were inserted, as they are about to be written."""
    c = catalog.state.collections[table]
    where = " OR ".join(f"(`{PART}` = {k} AND `{FILE}` IN ({', '.join(v.text(x) for x in sorted(files))}))" for k, files in hit.items())
    df = catalog.frame(table, at=True).where(where).drop(PART, FILE)
    if any(c.parts[k].frame is not None for k in hit):
        c.next_id = catalog.first_free(table)
        new = F.monotonically_increasing_id() - (1 << 62)
        df = df.withColumn(RID, F.coalesce(RID, new) if RID in df.columns else new)
    return df


def hits(catalog: Catalog, table: str, condition: str, own: str) -> tuple[int, dict[int, set[str]]]:
    """How many rows a condition without null holds for, and the files they stand in. One scan of the columns it names; a row for each file reaches the driver."""
    view = catalog.view(catalog.frame(table, at=True))
    found = catalog.spark.sql(f"SELECT `{PART}` AS p, `{FILE}` AS f, count(1) AS n FROM {view} AS {own} WHERE {condition} GROUP BY `{PART}`, `{FILE}`").collect()
    out: dict[int, set[str]] = {}
    for r in found:
        out.setdefault(r.p, set()).add(r.f)
    return sum(r.n for r in found), out


def rewrite(catalog: Catalog, table: str, condition: Callable[[], str], sets: list[tuple[tuple[str, ...], n.Expr]], compiler: Compiler) -> int:
    """The files that have rows the condition holds for, with fields of those rows set in turn, each on what the ones before left."""
    spark, own = catalog.spark, v.quoted(table)
    count, hit = hits(catalog, table, condition(), own)
    if not count:
        return 0
    df = spark.sql(f"SELECT *, {condition()} AS `__hit` FROM {catalog.view(touched(catalog, table, hit))} AS {own}")
    for path, new in sets:
        view = catalog.view(df)
        found = compiler.value(new, Scope([Source(table, df.schema)]))
        df = spark.sql(f"SELECT *, {found.sql} AS `__value` FROM {view} AS {own}")
        df = put(df, path, v.Value("`__value`", found.type)).drop("__value")
    catalog.replace(table, hit, df.drop("__hit"))
    return count


def put(df: DataFrame, path: tuple[str, ...], value: v.Value) -> DataFrame:
    """value at path in the rows that are hit; kinds that conflict become VARIANT."""

    def changed(sql: str, t: T.DataType | None, rest: tuple[str, ...]) -> tuple[str, T.DataType]:
        if not rest:
            old = t or T.NullType()
            both = sch.settled(T.StructType([T.StructField("x", sch.merged(old, value.type))]))["x"].dataType
            if isinstance(both, T.NullType):
                return "NULL", both
            return f"if(`__hit`, {sch.converted(value.sql, value.type, both)}, {sch.converted(sql, old, both) if t else f'CAST(NULL AS {both.simpleString()})'})", both
        fields = {f.name: f.dataType for f in t} if isinstance(t, T.StructType) else {}
        out, types = [], []
        for f in [*fields, *([rest[0]] if rest[0] not in fields else [])]:
            said, type_ = changed(f"{sql}.{v.quoted(f)}", fields.get(f), rest[1:]) if f == rest[0] else (f"{sql}.{v.quoted(f)}", fields[f])
            out.append(f"{v.text(f)}, {said}")
            types.append(T.StructField(f, type_))
        made, type_ = f"named_struct({', '.join(out)})", T.StructType(types)
        if isinstance(t, T.StructType):
            return f"if({sql} IS NULL AND NOT `__hit`, NULL, {made})", type_
        if t is None or isinstance(t, T.NullType):
            return f"if(`__hit`, {made}, NULL)", type_
        return f"if(`__hit`, to_variant_object({made}), {sch.converted(sql, t, T.VariantType())})", T.VariantType()

    own = next((f.dataType for f in df.schema if f.name == path[0]), None)
    said, _ = changed(v.quoted(path[0]), own, path[1:])
    return df.withColumn(path[0], F.expr(said))


def update(catalog: Catalog, compiler: Compiler, u: n.Update) -> int:
    if u.table not in catalog.state.collections:
        return 0
    scope = Scope([Source(u.table, catalog.state.collections[u.table].schema)])
    condition = lambda: compiler.predicate(u.where, scope, False) if u.where else "TRUE"  # noqa: E731  compiled when it is used: its subqueries name views of the collection as it is then
    sets = [(path, n.Literal(compiler.draw(e.name, e.draw)) if isinstance(e, n.Sequence) else e) for path, e in u.sets]
    return rewrite(catalog, u.table, condition, sets, compiler)


def delete(catalog: Catalog, compiler: Compiler, d: n.Delete) -> int:
    if d.table not in catalog.state.collections:
        return 0
    own = v.quoted(d.table)
    scope = Scope([Source(d.table, catalog.state.collections[d.table].schema)])
    condition = lambda: compiler.predicate(d.where, scope, False) if d.where else "TRUE"
    count, hit = hits(catalog, d.table, condition(), own)
    if count:
        left = catalog.spark.sql(f"SELECT * FROM {catalog.view(touched(catalog, d.table, hit))} AS {own} WHERE NOT {condition()}")
        catalog.replace(d.table, hit, left, count)
    return count
