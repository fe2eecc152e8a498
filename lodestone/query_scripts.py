"""Queries that change collections first, or go in and out by another way, with the same end in DuckDB's SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.query_base import Query, named, script, session
from lodestone.repl import Repl
from lodestone.server import answer
from lodestone.session import Session

#: Documents whose field v holds numbers, texts, booleans, nulls, a document and an array, and documents three levels deep.
MIXED = '[{"id": 1, "v": 1}, {"id": 2, "v": "x"}, {"id": 3, "v": "y"}, {"id": 4, "v": 1.5}, {"id": 5, "v": true}, {"id": 6, "v": null}, {"id": 7}, {"id": 8, "v": {"a": 1}}, {"id": 9, "v": "1"}, {"id": 10, "v": "x"}, {"id": 11, "v": 1.5}, {"id": 12, "v": [1]}]'
MIXED_SQL = "(values (1, 'n', 1.0, null), (2, 's', null, 'x'), (3, 's', null, 'y'), (4, 'n', 1.5, null), (5, 'b', 1.0, null), (6, null, null, null), (7, null, null, null), (8, 'd', null, null), (9, 's', null, '1'), (10, 's', null, 'x'), (11, 'n', 1.5, null), (12, 'd', null, null))"
A, B = f"{MIXED_SQL} a(id, kind, num, txt)", f"{MIXED_SQL} b(id, kind, num, txt)"
SAME = "(coalesce(a.num = b.num, false) or coalesce(a.txt = b.txt, false) or (a.kind is null and b.kind is null))"
DEEP = '[{"id": 1, "p": {"a": {"b": {"k": 5}}, "k": 1}}, {"id": 2, "p": {"a": {"k": 15}}}, {"id": 3, "p": {"a": {"b": {"k": 25, "z": "far"}}}}, {"id": 4, "p": {"z": "near"}}, {"id": 5, "q": 9}]'
ARRAYS = '[{"id": 1, "l": [1, 2, 3]}, {"id": 2, "l": [], "d": {"m": ["x", "y"]}}, {"id": 3}]'


def documents(text: str, *statements: str, then: str) -> Query:
    """Documents inserted as JSON into t, statements, and the query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, *named(*statements, then))
        s.insert_json("t", text)
        for x in statements:
            s.execute(x)
        return s.query(then)

    return run


def transaction(commit: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, "customer")
        t = s.begin()
        t.execute("UPDATE customer SET c_acctbal = 0 WHERE c_custkey < 100")
        t.commit() if commit else t.rollback()
        return s.query("SELECT c_custkey, c_acctbal FROM customer")

    return run


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the row that EXPLAIN yields what doesn't depend on files and plans."""
    said = session(spark, sf_dir, "nation", "region").query("EXPLAIN SELECT /*+ PARALLEL(2) */ n_name, r_name FROM nation N JOIN region R ON N.n_regionkey = R.r_regionkey WHERE n_nationkey > 3 ORDER BY n_name LIMIT 5")
    return said.select("type", "collection", "estimated_rows", "scan", "filter", "selectivity", "estimated_after_filter", "join_1", "join_1_cost", "join_1_right_rows", "join_1_estimated_output", "orderBy", "limit", "hint_1")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = session(spark, sf_dir, "events", observe=True).schema("events")
    return spark.createDataFrame([(x["path"], ",".join(x["types"]), x["count"], x["total"]) for x in found], "path string, types string, n bigint, total bigint")


def observed_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.insert_json("t", MIXED)
    return spark.createDataFrame([(x["path"], ",".join(x["types"]), x["total"]) for x in s.schema("t")], "path string, types string, total bigint")


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers written as JSON files, an array of objects each, and read again as documents."""
    s = Session(spark)
    path = f"{s.catalog.root}-json"
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.to_json(F.struct("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")).alias("c"))).alias("value"))
    arrays = lines.groupBy(F.pmod(F.xxhash64("value"), F.lit(8)).alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("k").text(path)
    s.import_json("c", f"{path}/k=*")
    return s.query("SELECT c_custkey, c.name AS name, c.bal AS bal FROM c")


def dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database made again from its dump."""
    s, again = session(spark, sf_dir, "region"), Session(spark)
    s.insert_json("t", DEEP)
    s.execute("CREATE VIEW far AS SELECT id, p.a.b.k AS k FROM t WHERE p.**.k > 4")
    s.execute("CREATE INDEX ON t (id)")
    for statement in s.dump():
        again.execute(statement)
    return again.query("SELECT id, k, r_name, (SELECT COUNT(*) FROM t) AS n FROM far LEFT JOIN region ON id = r_regionkey")


def by_record_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.execute("INSERT INTO t VALUES (a='x'), (a='y'), (a='z')")
    last = s.execute("INSERT INTO t VALUES (a='w')").last_insert_id
    s.execute("DELETE FROM t WHERE a = 'y'")
    s.execute("UPDATE t SET a = 'zz' WHERE a = 'z'")
    return s.documents("t", [2, 3, last, 99]).select(F.col("_rid").alias("id"), "a")


def vacuumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "part")
    s.execute("INSERT INTO p SELECT p_partkey, p_size FROM part WHERE p_size < 40")
    s.execute("INSERT INTO p SELECT p_partkey, p_size FROM part WHERE p_size >= 40")
    gone = s.execute("DELETE FROM p WHERE p_size = 11").rows_affected
    back = s.vacuum()
    return s.query(f"SELECT p_partkey, p_size, {back} AS back, {int(gone == back)} AS same FROM p")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "region")
    for x in ("INSERT INTO t VALUES (a=1)", "CREATE VIEW v AS SELECT a FROM t", "CREATE INDEX ON t (a)", "CREATE SEQUENCE q", "CREATE INDEX ON region (r_name)", "DROP INDEX ON region (r_name)"):
        s.execute(x)
    found = [("collection", x) for x in s.collections()] + [("view", x) for x in s.views()] + [("index", f"{t}.{p}") for t, p in s.indexes()] + [("sequence", x) for x in s.sequences()]
    return spark.createDataFrame(found, "kind string, name string")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the HTTP facade."""
    s = session(spark, sf_dir, "region")
    ask = lambda *x: json.loads("".join(answer(s, *x)))
    new = ask("POST", "/insert/t", '[{"a": 1}, {"a": 2}]')["rows_affected"]
    docs = ask("POST", "/query", '{"sql": "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > ?", "params": [1]}')["docs"]
    return spark.createDataFrame([(d["r_regionkey"], d["r_name"], new, len(ask("GET", "/dump", "").splitlines())) for d in docs], "r_regionkey int, r_name string, new bigint, dumped bigint")


def prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the prompt says, line by line, up to a colon."""
    r = Repl(session(spark, sf_dir, "nation"))
    said = [x for line in ("CREATE VIEW v AS SELECT n_name AS name", "FROM nation WHERE n_nationkey < 2;", ".tables", ".views", "SELECT COUNT(*) AS n FROM v;", "SELEC;") for x in r.feed(line)]
    return spark.createDataFrame([(i, x.split(":")[0].replace("'", "")) for i, x in enumerate(said)], "i bigint, said string")


EXPLAIN_SQL = """select 'SELECT' as type, 'nation' as collection, n as estimated_rows, 'FULL SCAN' as scan, 'n_nationkey > 3' as filter, 0.33::double as selectivity, cast(floor(n * 0.33) as bigint) as estimated_after_filter,
  'HASH JOIN INNER region ON N.n_regionkey = R.r_regionkey' as join_1, n + r as join_1_cost, r as join_1_right_rows, greatest(n, r) as join_1_estimated_output, 'n_name ASC' as "orderBy", 5::bigint as "limit", 'PARALLEL(2)' as hint_1
from (select (select count(*) from nation) as n, (select count(*) from region) as r)"""

SCRIPTS: dict[str, tuple[Query, str]] = {
    "view_query": (script("CREATE VIEW rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0", then="SELECT c_custkey FROM rich WHERE c_acctbal < 1000"), "with v as (select c_custkey, c_acctbal from customer where c_acctbal > 0) select c_custkey from v where c_acctbal < 1000"),
    "view_join": (script("CREATE VIEW asian AS SELECT n_nationkey FROM nation N JOIN region R ON N.n_regionkey = R.r_regionkey WHERE r_name = 'ASIA'", then="SELECT COUNT(*) AS n FROM customer C JOIN asian A ON C.c_nationkey = A.n_nationkey"), "select count(*) as n from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey where r_name = 'ASIA'"),
    "drop_view": (script("CREATE VIEW v AS SELECT r_regionkey FROM region", "DROP VIEW v", then="SELECT COUNT(*) AS n FROM v"), "select 0::bigint as n"),
    "join_shape_star": (script("CREATE VIEW j AS SELECT * FROM nation N JOIN region R ON N.n_regionkey = R.r_regionkey", then="SELECT n_nationkey, r_name, N.n_name AS inner_name, R.r_regionkey AS inner_key FROM j"), "select n_nationkey, r_name, n_name as inner_name, r_regionkey as inner_key from nation join region on n_regionkey = r_regionkey"),
    "dml_insert_values": (script("INSERT INTO t VALUES (id=1, a.b=\"x\"), (id=2, n=1.5)", 'INSERT INTO t VALUES {"id": 3, "a": {"b": "y", "c": 4}}', then="SELECT id, a.b AS b, a.c AS c, n FROM t"), "select * from (values (1::bigint, 'x', null::bigint, null::double), (2, null, null, 1.5), (3, 'y', 4, null)) t(id, b, c, n)"),
    "dml_insert_select": (script("INSERT INTO done SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'", then="SELECT * FROM done"), "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'"),
    "dml_insert_registered": (script("INSERT INTO region VALUES (r_regionkey=90, r_name='new')", then="SELECT r_regionkey, r_name FROM region"), "select r_regionkey::bigint as r_regionkey, r_name from region union all select 90, 'new'"),
    "dml_update_expr": (script("UPDATE part SET p_size = p_size + 1 WHERE p_size < 10", then="SELECT p_partkey, p_size FROM part"), "select p_partkey, cast(case when p_size < 10 then p_size + 1 else p_size end as bigint) as p_size from part"),
    "dml_update_sequential": (script("UPDATE supplier SET s_nationkey = s_nationkey + 1, copy = s_nationkey WHERE s_suppkey > 10", then="SELECT s_suppkey, s_nationkey, copy FROM supplier"), "select s_suppkey, cast(case when s_suppkey > 10 then s_nationkey + 1 else s_nationkey end as bigint) as s_nationkey, cast(case when s_suppkey > 10 then s_nationkey + 1 end as bigint) as copy from supplier"),
    "dml_update_nested": (script("UPDATE events SET props.k = props.k * 2, props.seen = true WHERE value > 50", then="SELECT event_id, props.k AS k, props.seen AS seen FROM events"), "select event_id, case when value > 50 then 2 else 1 end * cast(json_extract(props,'$.k') as bigint) as k, case when value > 50 then true end as seen from events"),
    "dml_update_subquery": (script("UPDATE customer SET c_acctbal = 0 WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", then="SELECT c_custkey, c_acctbal FROM customer"), "select c_custkey, case when c_nationkey in (select n_nationkey from nation where n_regionkey = 2) then 0 else c_acctbal end as c_acctbal from customer"),
    "dml_update_self_in": (script("UPDATE supplier SET s_acctbal = 0 WHERE s_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)", then="SELECT s_suppkey, s_acctbal FROM supplier"), "select s_suppkey, case when s_nationkey in (select s_nationkey from supplier where s_acctbal > 5000) then s_acctbal else 0 end as s_acctbal from supplier"),
    "dml_delete": (script("DELETE FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 300000", then="SELECT o_orderkey FROM orders"), "select o_orderkey from orders where not coalesce(o_orderstatus = 'F' or o_totalprice > 300000, false)"),
    "dml_delete_self_in": (script("DELETE FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)", then="SELECT s_suppkey FROM supplier"), "select s_suppkey from supplier where s_nationkey not in (select s_nationkey from supplier where s_acctbal < 0)"),
    "dml_upsert": (script("INSERT OR REPLACE INTO region VALUES (r_regionkey=2, r_name='new'), (r_regionkey=77, r_name='far')", then="SELECT r_regionkey, r_name FROM region"), "select cast(r_regionkey as bigint) as r_regionkey, case when r_regionkey = 2 then 'new' else r_name end as r_name from region union all select 77, 'far'"),
    "dml_upsert_many": (script("INSERT INTO s SELECT s_suppkey, s_name, s_acctbal FROM supplier", "INSERT OR REPLACE INTO s VALUES " + ", ".join(f"(s_suppkey={k}, s_acctbal={k}.5)" for k in range(0, 3000, 7)), then="SELECT s_suppkey, s_name, s_acctbal FROM s"), "select coalesce(s_suppkey, k) as s_suppkey, s_name, case when k is null then s_acctbal else k + 0.5 end as s_acctbal from supplier full join (select unnest(range(0, 3000, 7)) as k) on s_suppkey = k"),
    "dml_truncate": (script("INSERT INTO t VALUES (a=1)", "TRUNCATE TABLE t", "INSERT INTO t VALUES (a=2)", then="SELECT a FROM t"), "select 2::bigint as a"),
    "drop_table": (script("INSERT INTO t VALUES (a=1)", "DROP TABLE t", "DROP TABLE IF EXISTS t", then="SELECT COUNT(*) AS n FROM t"), "select 0::bigint as n"),
    "seq_nextval": (script("CREATE SEQUENCE s START 10 INCREMENT 5", "INSERT INTO t VALUES (id=s.NEXTVAL), (id=s.NEXTVAL), (id=s.CURRVAL)", then="SELECT id FROM t"), "select * from (values (10::bigint), (15), (15)) t(id)"),
    "seq_cycle": (script("CREATE SEQUENCE s START WITH 3 INCREMENT BY 2 MINVALUE 2 MAXVALUE 6 CYCLE", "INSERT INTO t VALUES (id=s.NEXTVAL), (id=s.NEXTVAL), (id=s.NEXTVAL), (id=s.NEXTVAL)", then="SELECT id FROM t"), "select * from (values (3::bigint), (5), (2), (4)) t(id)"),
    "index_lookup": (script("INSERT INTO c SELECT c_custkey, c_nationkey, c_name FROM customer", "CREATE INDEX ON c (c_nationkey)", then="SELECT /*+ FORCE_INDEX(c_nationkey) */ c_custkey, c_name FROM c WHERE c_nationkey = 7"), "select c_custkey, c_name from customer where c_nationkey = 7"),
    "index_join": (script("INSERT INTO c SELECT c_custkey, c_nationkey FROM customer", "CREATE INDEX ON c (c_nationkey)", then="SELECT n_name, C.c_custkey AS c_custkey FROM nation N JOIN c C ON N.n_nationkey = C.c_nationkey WHERE n_nationkey < 4"), "select n_name, c_custkey from nation join customer on n_nationkey = c_nationkey where n_nationkey < 4"),
    "index_after_changes": (script("INSERT INTO c SELECT c_custkey, c_nationkey FROM customer", "CREATE INDEX ON c (c_nationkey)", "INSERT INTO c VALUES (c_custkey=-5, c_nationkey=7)", "UPDATE c SET c_nationkey = 8 WHERE c_nationkey = 7 AND c_custkey > 700", then="SELECT c_custkey FROM c WHERE c_nationkey = 7"), "select c_custkey from customer where c_nationkey = 7 and c_custkey <= 700 union all select -5"),
    "tx_commit": (transaction(True), "select c_custkey, case when c_custkey < 100 then 0 else c_acctbal end as c_acctbal from customer"),
    "tx_rollback": (transaction(False), "select c_custkey, c_acctbal from customer"),
    "mixed_equal": (documents(MIXED, then="SELECT id FROM t WHERE v = 1"), "select * from (values (1::bigint), (5)) t(id)"),
    "mixed_fields_equal": (documents(MIXED, then="SELECT A.id AS a, B.id AS b FROM t A JOIN t B ON A.id < B.id WHERE A.v = B.v"), f"select a.id::bigint as a, b.id::bigint as b from {A}, {B} where a.id < b.id and {SAME}"),
    "mixed_less": (documents(MIXED, then="SELECT A.id AS a, B.id AS b FROM t A JOIN t B ON A.v < B.v"), f"select a.id::bigint as a, b.id::bigint as b from {A}, {B} where a.num < b.num or a.txt < b.txt"),
    "mixed_join": (documents(MIXED, then="SELECT A.id AS a, B.id AS b FROM t A JOIN t B ON A.v = B.v"), f"select a.id::bigint as a, b.id::bigint as b from {A}, {B} where a.num = b.num or a.txt = b.txt"),
    "mixed_in": (documents(MIXED, then="SELECT id FROM t WHERE v IN (SELECT v FROM t WHERE id IN (1, 2, 6))"), f"select a.id::bigint as id from {A} where exists (select 1 from {B} where b.id in (1, 2, 6) and {SAME})"),
    "mixed_not_in": (documents(MIXED, then="SELECT id FROM t WHERE v NOT IN (SELECT v FROM t WHERE id IN (1, 2, 6))"), f"select a.id::bigint as id from {A} where not exists (select 1 from {B} where b.id in (1, 2, 6) and {SAME})"),
    "mixed_in_typed": (documents(MIXED, then="SELECT r_regionkey FROM region WHERE r_regionkey IN (SELECT v FROM t)"), "select r_regionkey from region where r_regionkey = 1"),
    "mixed_min_max": (documents(MIXED, then="SELECT CAST(MIN(v) AS TEXT) AS a, CAST(MAX(v) AS TEXT) AS b FROM t WHERE id IN (2, 3, 4, 9)"), "select '1' as a, 'y' as b"),
    "mixed_distinct": (documents(MIXED, "CREATE VIEW d AS SELECT DISTINCT v FROM t", then="SELECT TYPEOF(v) AS k, CAST(v AS TEXT) AS v FROM d WHERE TYPEOF(v) != 'unknown'"), "select * from (values ('integer', '1'), ('text', 'x'), ('text', 'y'), ('real', '1.5'), ('boolean', 'true'), ('null', null), ('text', '1')) t(k, v)"),
    "mixed_union": (documents(MIXED, "CREATE VIEW u AS SELECT v FROM t WHERE id < 8 UNION SELECT v FROM t WHERE id > 8 AND id < 12", then="SELECT TYPEOF(v) AS k, CAST(v AS TEXT) AS v FROM u"), "select * from (values ('integer', '1'), ('text', 'x'), ('text', 'y'), ('real', '1.5'), ('boolean', 'true'), ('null', null)) t(k, v)"),
    "mixed_group": (documents(MIXED, "CREATE VIEW g AS SELECT v, COUNT(*) AS n FROM t GROUP BY v", then="SELECT TYPEOF(v) AS k, CAST(v AS TEXT) AS v, n FROM g WHERE TYPEOF(v) != 'unknown'"), "select * from (values ('integer', '1', 2::bigint), ('text', 'x', 2), ('text', 'y', 1), ('real', '1.5', 2), ('boolean', 'true', 1), ('null', null, 2)) t(k, v, n)"),
    "mixed_order": (documents(MIXED, then="SELECT id FROM t WHERE id < 8 ORDER BY v DESC, id LIMIT 4"), "select * from (values (3::bigint), (2), (4), (1)) t(id)"),
    "wildcard_depths": (documents(DEEP, then="SELECT id FROM t WHERE p.**.k > 4"), "select * from (values (1::bigint), (2), (3)) t(id)"),
    "wildcard_child_of_child": (documents(DEEP, then="SELECT id FROM t WHERE p.*.k > 4"), "select 2::bigint as id"),
    "wildcard_any": (documents(DEEP, then="SELECT id FROM t WHERE p.** LIKE '%AR'"), "select * from (values (3::bigint), (4)) t(id)"),
    "array_documents": (documents(ARRAYS, 'INSERT INTO t VALUES {"id": 4, "l": [7], "d": {"m": ["z"]}}', then="SELECT id, CAST(l AS TEXT) AS l, CAST(d.m AS TEXT) AS m FROM t"), """select * from (values (1::bigint, '[1,2,3]', null), (2, '[]', '["x","y"]'), (3, null, null), (4, '[7]', '["z"]')) t(id, l, m)"""),
    "json_documents": (documents('{"id": 1, "a": {"b": 2.0}}', then="SELECT id, a.b AS b, TYPEOF(a.b) AS k FROM t"), "select 1::bigint as id, 2::bigint as b, 'integer' as k"),
    "json_import": (imported, "select c_custkey, c_name as name, c_acctbal as bal from customer"),
    "dump_and_reload": (dumped, "select id::bigint as id, k::bigint as k, r_name, 5::bigint as n from (values (1, 5), (2, null), (3, 25)) t(id, k) left join region on id = r_regionkey"),
    "record_ids": (by_record_id, "select * from (values (3::bigint, 'zz'), (4, 'w')) t(id, a)"),
    "vacuum": (vacuumed, "select p_partkey, p_size, (select count(*) from part where p_size = 11) as back, 1::bigint as same from part where p_size <> 11"),
    "listings": (listed, "select * from (values ('collection', 'region'), ('collection', 't'), ('view', 'v'), ('index', 't.a'), ('sequence', 'q')) t(kind, name)"),
    "http_answers": (asked, "select r_regionkey, r_name, 2::bigint as new, (select count(*) from region) + 2 as dumped from region where r_regionkey > 1"),
    "prompt": (prompted, "select * from (values (0::bigint, '0 documents'), (1, 'nation'), (2, 'v'), (3, '{n'), (4, '1 rows'), (5, 'error')) t(i, said)"),
    "explain": (explained, EXPLAIN_SQL),
    "schema_observed": (observed, "select p as path, t as types, count(*) as n, count(*) as total from events, (values ('event_id', 'int64'), ('ts', 'unknown'), ('user_id', 'int64'), ('event_type', 'string'), ('value', 'float64'), ('props.k', 'int64')) x(p, t) group by p, t"),
    "schema_mixed": (observed_mixed, "select * from (values ('id', 'int64', 12::bigint), ('v', 'bool,float64,int64,string,unknown', 12)) t(path, types, total)"),
}
