import json
import urllib.request
from threading import Thread

import pytest

from lodestone.plans.parser import DialectError
from lodestone.repl import Repl
from lodestone.server import serve
from lodestone.session import Session


def rows(s, sql):
    return sorted((tuple(x.toJson() if hasattr(x, "toJson") else x for x in r) for r in s.execute(sql).rows()), key=repr)


def test_insert_update_delete(spark):
    s = Session(spark)
    out = s.execute('INSERT INTO jobs VALUES (type="a", retry=5, params.timeout=30), (type="b")')
    assert (out.rows_affected, out.last_insert_id) == (2, 2)
    assert s.execute('INSERT INTO jobs VALUES {"type": "c", "retry": 1.5, "tags": ["x"]}').last_insert_id == 3
    assert rows(s, "SELECT type, retry, params.timeout FROM jobs") == [("a", 5.0, 30), ("b", None, None), ("c", 1.5, None)]
    assert s.execute("UPDATE jobs SET retry = retry + 1, params.timeout = retry, note.by = UPPER(type) WHERE type != 'c'").rows_affected == 2
    assert rows(s, "SELECT type, retry, params.timeout, note.by FROM jobs") == [("a", 6.0, 6.0, "A"), ("b", None, None, "B"), ("c", 1.5, None, None)]
    assert s.execute("DELETE FROM jobs WHERE retry > 5 OR retry IS NULL").rows_affected == 2
    assert rows(s, "SELECT type FROM jobs") == [("c",)]
    assert s.execute("INSERT INTO jobs VALUES (type='d')").last_insert_id == 4  # ids aren't used again
    assert s.vacuum() == 2 and rows(s, "SELECT type FROM jobs") == [("c",), ("d",)]


def test_kinds_that_conflict(spark):
    s = Session(spark)
    s.execute("INSERT INTO t VALUES (a=1), (a='x')")
    s.execute("UPDATE t SET a = 2.5 WHERE a = 1")
    s.execute('INSERT INTO t VALUES {"a": {"deep": 1}}')
    assert rows(s, "SELECT TYPEOF(a) AS k FROM t") == [("real",), ("text",), ("unknown",)]
    assert s.schema("t")[0]["types"] == ["float64", "string", "unknown"]


def test_names_of_tables_and_documents(spark):
    s = Session(spark)
    s.execute("INSERT INTO t VALUES (t.a=1, u.a=2), (t.a=5, u.a=6)")
    s.execute("UPDATE t SET t.a = t.a + u.a, b = t.u.a WHERE t.a = 1 AND t.u.a = 2")
    assert rows(s, "SELECT t.a AS x, b FROM t") == [(3, 2), (5, None)]
    assert rows(s, "SELECT x.t.a AS x FROM t x WHERE u.a > 2") == [(5,)]
    s.execute("DELETE FROM t WHERE t.t.a = 3")
    assert rows(s, "SELECT t.a AS x FROM t") == [(5,)]


def test_upsert(spark):
    s = Session(spark)
    s.execute("INSERT INTO t VALUES (k='a', v=1, w=9), (k='a', v=2), (k='b', v=3)")
    out = s.execute("INSERT OR REPLACE INTO t VALUES (k='a', v=7, x={y: 1}), (k='z', v=0)")
    assert out.rows_affected == 2
    assert rows(s, "SELECT k, v, w, x.y FROM t") == [("a", 2, None, None), ("a", 7, 9, 1), ("b", 3, None, None), ("z", 0, None, None)]


def test_views_see_changes_and_nest(spark):
    s = Session(spark)
    s.execute("INSERT INTO t VALUES (a=1, b=2), (a=5, b=6)")
    s.execute("CREATE VIEW big AS SELECT a, b FROM t WHERE a > 2")
    s.execute("CREATE VIEW total AS SELECT SUM(b) AS s FROM big")
    s.execute("INSERT INTO t VALUES (a=7, b=8)")
    assert rows(s, "SELECT s FROM total") == [(14,)]
    with pytest.raises(DialectError):
        s.execute("INSERT INTO big VALUES (a=1)")
    s.execute("CREATE VIEW big AS SELECT s AS b FROM total")
    with pytest.raises(DialectError, match="made of itself"):
        s.execute("SELECT * FROM total")
    s.execute("DROP VIEW big")
    s.execute("DROP VIEW IF EXISTS big")
    with pytest.raises(DialectError):
        s.execute("DROP VIEW big")


def test_sequences(spark):
    s = Session(spark)
    s.execute("CREATE SEQUENCE q START WITH 1 INCREMENT BY 2 MAXVALUE 4 CYCLE")
    s.execute("INSERT INTO t VALUES (a=q.NEXTVAL), (a=Q.NEXTVAL), (a=q.NEXTVAL), (a=q.CURRVAL)")
    assert rows(s, "SELECT a FROM t") == [(1,), (1,), (1,), (3,)]
    s.execute("UPDATE t SET b = q.NEXTVAL")
    assert rows(s, "SELECT DISTINCT b FROM t") == [(3,)]  # once a statement
    s.execute("CREATE SEQUENCE r MAXVALUE 1")
    with pytest.raises(DialectError, match="drawn from"):
        s.execute("INSERT INTO t VALUES (a=r.CURRVAL)")
    s.execute("INSERT INTO t VALUES (a=r.NEXTVAL)")
    with pytest.raises(DialectError, match="used up"):
        s.execute("INSERT INTO t VALUES (a=r.NEXTVAL)")
    with pytest.raises(DialectError):
        s.execute("SELECT q.NEXTVAL FROM t")


def test_transactions(spark):
    s = Session(spark)
    s.execute("CREATE SEQUENCE q")
    s.execute("INSERT INTO t VALUES (a=q.NEXTVAL)")
    t = s.begin()
    with pytest.raises(DialectError):
        s.begin()
    t.execute("UPDATE t SET a = q.NEXTVAL + 10")
    t.execute("INSERT INTO u VALUES (b=1)")
    t.rollback()
    assert rows(s, "SELECT a FROM t") == [(1,)] and s.collections() == ["t"] and s.draw("q", "NEXTVAL") == 2
    t = s.begin()
    t.execute("DELETE FROM t")
    t.commit()
    assert rows(s, "SELECT COUNT(*) AS n FROM t") == [(0,)]
    with pytest.raises(DialectError):
        t.execute("DELETE FROM t")


def test_kept_on_disk(spark, tmp_path):
    root = str(tmp_path / "db")
    s = Session(spark, root)
    s.execute("INSERT INTO t VALUES (a=1, n=null), (a=2)")
    s.execute("CREATE INDEX ON t (a)")
    s.execute("CREATE VIEW v AS SELECT a FROM t WHERE a > 1")
    t = s.begin()
    t.execute("DELETE FROM t")
    again = Session(spark, root, read_only=True)  # sees what was committed
    assert rows(again, "SELECT a FROM t") == [(1,), (2,)] and rows(again, "SELECT a FROM v") == [(2,)] and again.indexes() == [("t", "a")]
    with pytest.raises(PermissionError):
        again.execute("DELETE FROM t")
    with pytest.raises(PermissionError):
        again.insert_json("t", "{}")
    t.commit()
    assert rows(Session(spark, root), "SELECT COUNT(*) AS n FROM t") == [(0,)]


def test_registered_frames_stay_as_they_are(spark, tmp_path):
    spark.createDataFrame([(1, '{"k": 5}'), (2, None)], "id long, j string").write.parquet(str(tmp_path / "x"))
    s = Session(spark)
    s.register("x", spark.read.parquet(str(tmp_path / "x")), {"j": None})
    assert rows(s, "SELECT id, j.k FROM x") == [(1, 5), (2, None)]
    s.execute("UPDATE x SET j.k = 6 WHERE id = 1")
    assert rows(s, "SELECT id, j.k FROM x") == [(1, 6), (2, None)]
    assert spark.read.parquet(str(tmp_path / "x")).filter("id = 1").first().j == '{"k": 5}'


def test_dump_makes_it_again(spark):
    s = Session(spark)
    s.insert_json("t", json.dumps([{"a": 'q"uo\'te\n\\', "b": [1, [2]], "c": {"d": None, "e": True}}, {"a": None, "f": 1.5}]))
    s.execute("CREATE VIEW v AS SELECT f FROM t")
    s.execute("CREATE INDEX ON t (c.e)")
    again = Session(spark)
    for statement in s.dump():
        again.execute(statement)
    q = "SELECT a, b, c.e, f FROM t"
    assert rows(s, q) == rows(again, q) and again.views() == s.views() and again.indexes() == s.indexes()


def test_schema(spark):
    s = Session(spark)
    s.insert_json("t", '[{"name": "x", "age": 3, "c": {"m": "y"}}, {"name": "z", "l": [1]}]')
    found = {x["path"]: (x["types"], x["count"], x["total"]) for x in s.schema("t")}
    assert found == {"name": (["string"], 2, 2), "age": (["int64"], 1, 2), "c.m": (["string"], 1, 2), "l": (["unknown"], 1, 2)}


def test_json_import_and_numbers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": {"c": "x"}}, {"a": 2}]')
    s = Session(spark)
    assert s.import_json("t", str(tmp_path)).rows_affected == 2
    s.insert_json("t", '{"a": 3.0}')
    assert rows(s, "SELECT a, b.c FROM t") == [(1, "x"), (2, None), (3, None)]
    with pytest.raises(DialectError):
        s.insert_json("t", "[1]")


def test_truncate_drop_index(spark):
    s = Session(spark)
    s.execute("INSERT INTO t VALUES (a=1), (a=2)")
    assert s.execute("TRUNCATE t").rows_affected == 2
    assert s.execute("INSERT INTO t VALUES (a=3)").last_insert_id == 1
    s.execute("CREATE INDEX ON t (a)")
    s.execute("CREATE INDEX IF NOT EXISTS ON t (a)")
    with pytest.raises(DialectError):
        s.execute("CREATE INDEX ON t (a)")
    row = s.execute("EXPLAIN SELECT a FROM t WHERE a = 3").rows()[0]
    assert row.scan == "INDEX LOOKUP" and row.index_matches == 1 and row.selectivity == 0.1
    s.execute("DROP TABLE t")
    assert s.indexes() == [] and s.collections() == []
    for bad in ("DROP TABLE t", "TRUNCATE t", "DROP INDEX ON t (a)", "DROP SEQUENCE s"):
        with pytest.raises(DialectError):
            s.execute(bad)
    s.execute("DROP TABLE IF EXISTS t")


def test_explain_of_changes(spark):
    s = Session(spark)
    assert s.execute("EXPLAIN UPDATE t SET a = 1 WHERE b = 2").rows()[0].asDict() == {"type": "UPDATE", "collection": "t", "scan": "FULL SCAN", "filter": "b = 2"}
    assert s.execute("EXPLAIN INSERT INTO t SELECT a FROM u").rows()[0].source == "SELECT"
    assert s.execute("EXPLAIN SELECT a FROM t UNION SELECT a FROM u").rows()[0].type == "UNION"


def test_prompt(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 5}')
    r = Repl(Session(spark))
    said = [x for line in ("INSERT INTO t VALUES", "(a=1);", f".import t {tmp_path}/a.json", "SELECT a FROM t WHERE a > 2;", ".tables", ".schema", "SELEC;", ".what", ".vacuum", ".cache", ".help") for x in r.feed(line)]
    assert said[:4] == ["1 documents, last id 1", "1 documents", "{'a': 5}", "1 rows"] and said[4] == "t" and "a: int64 (100 %)" in said[6] and said[7].startswith("error")
    with pytest.raises(EOFError):
        list(r.feed(".quit"))


def test_http(spark):
    server = serve(Session(spark), 0)
    Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None):
        return json.load(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else body.encode()))

    try:
        assert ask("/insert/t", '[{"a": 1}, {"a": 2}]') == {"rows_affected": 2, "last_insert_id": 2}
        assert ask("/query", json.dumps({"sql": "SELECT a FROM t WHERE a > ?", "params": [1]})) == {"docs": [{"a": 2}]}
        assert "error" in ask("/query", '{"sql": "SELEC"}') and ask("/collections") == ["t"] and ask("/schema")["t"][0]["path"] == "a"
        assert ask("/dump").count("INSERT") == 2 and ask("/views") == {} and "cache_hits" in ask("/cache") and "error" in ask("/nothing")
    finally:
        server.shutdown()
