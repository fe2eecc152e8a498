"""The store: what counts after crashes, conflicts and rollbacks, and which files a change leaves alone."""

import os

import pytest

from lodestone.plans.parser import DialectError
from lodestone.session import Session
from lodestone.sources.catalog import Conflict


def rows(s, sql):
    return sorted((tuple(r) for r in s.execute(sql).rows()), key=repr)


def files(root, name):
    return {os.path.join(d, x) for d, _, names in os.walk(os.path.join(root, name)) for x in names if x.endswith(".parquet")}


def live(s, name):
    return {(p.path, p.gone) for p in s.catalog.state.collections[name].parts}


def test_a_crash_leaves_the_manifest_before(spark, tmp_path):
    root = str(tmp_path / "db")
    s = Session(spark, root)
    s.execute("INSERT INTO t VALUES (a=1)")
    s.execute("INSERT INTO t VALUES (a=2)")
    assert sorted(x for x in os.listdir(root) if x.startswith("manifest")) == ["manifest-000000000001.json", "manifest-000000000002.json"]
    (tmp_path / "db" / ".half.new").write_text('{"collections": {')  # cut off while it was written
    assert rows(Session(spark, root), "SELECT a FROM t") == [(1,), (2,)]
    for x in ("manifest-000000000002.json", ".manifest-000000000002.json.crc"):  # cut off before it was in place
        os.remove(tmp_path / "db" / x)
    again = Session(spark, root)
    assert rows(again, "SELECT a FROM t") == [(1,)]
    again.execute("INSERT INTO t VALUES (a=3)")
    assert rows(Session(spark, root), "SELECT a FROM t") == [(1,), (3,)]


def test_two_sessions(spark, tmp_path):
    root = str(tmp_path / "db")
    one = Session(spark, root)
    one.execute("INSERT INTO t VALUES (a=1)")
    two = Session(spark, root)
    one.execute("INSERT INTO t VALUES (a=2)")
    with pytest.raises(Conflict):
        two.execute("DELETE FROM t")
    assert rows(two, "SELECT a FROM t") == [(1,), (2,)]  # read anew
    assert two.execute("DELETE FROM t WHERE a = 2").rows_affected == 1
    t = one.begin()
    t.execute("INSERT INTO t VALUES (a=9)")
    with pytest.raises(Conflict):
        t.commit()
    assert rows(one, "SELECT a FROM t") == rows(Session(spark, root), "SELECT a FROM t") == [(1,)]


def test_vacuum_and_rollback(spark, tmp_path):
    root = str(tmp_path / "db")
    s = Session(spark, root)
    s.execute("INSERT INTO t VALUES (a=1), (a=2), (a=3)")
    t = s.begin()
    t.execute("DELETE FROM t WHERE a < 3")
    with pytest.raises(DialectError, match="vacuum"):
        s.vacuum()
    t.rollback()
    assert rows(s, "SELECT a FROM t") == rows(Session(spark, root), "SELECT a FROM t") == [(1,), (2,), (3,)]
    s.execute("DELETE FROM t WHERE a < 3")
    assert s.vacuum() == 2 and len(files(root, "t")) == 1 and [x for x in os.listdir(root) if x.startswith("manifest")] == ["manifest-000000000003.json"]
    assert rows(Session(spark, root), "SELECT a FROM t") == [(3,)]


def test_reading_only(spark, tmp_path):
    root = str(tmp_path / "db")
    Session(spark, root).execute("INSERT INTO t VALUES (a=1)")
    (tmp_path / "a.json").write_text('{"a": 5}')
    s = Session(spark, root, read_only=True)
    for change in (
        lambda: s.execute("INSERT INTO t VALUES (a=2)"), lambda: s.execute("CREATE VIEW v AS SELECT a FROM t"), lambda: s.insert_json("t", "{}"), lambda: s.import_json("t", str(tmp_path / "a.json")),
        s.begin, s.vacuum, s.catalog.save,
    ):
        with pytest.raises(PermissionError):
            change()
    assert rows(s, "SELECT a FROM t") == rows(Session(spark, root), "SELECT a FROM t") == [(1,)]


def test_a_statement_that_fails_changes_nothing(spark):
    s = Session(spark)
    s.execute("INSERT INTO t VALUES (a=1), (a=0)")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        s.execute("UPDATE t SET a = 1 / a")
    assert rows(s, "SELECT a FROM t") == [(0,), (1,)]
    with pytest.raises(DialectError):
        s.execute("INSERT OR REPLACE INTO t VALUES (a=1, b=2), (a={x: 1})")
    assert rows(s, "SELECT a, b FROM t") == [(0, None), (1, None)]


def test_files_without_hits_stay(spark, tmp_path):
    root = str(tmp_path / "db")
    s = Session(spark, root)
    spark.range(400).selectExpr("id", "id % 7 as m").repartitionByRange(4, "id").write.parquet(str(tmp_path / "x"))
    s.register("x", spark.read.parquet(str(tmp_path / "x")))
    s.execute("INSERT INTO t SELECT id, m FROM x")
    s.execute("INSERT INTO t VALUES (id=1000, m=1)")
    first, second = s.catalog.state.collections["t"].parts
    assert s.execute("UPDATE t SET m = 99 WHERE id = 5").rows_affected == 1
    parts = s.catalog.state.collections["t"].parts
    assert parts[0].path == first.path and len(parts[0].gone) == 1 and parts[1] == second and parts[2].rows + parts[0].rows == 400
    assert s.execute("DELETE FROM t WHERE id = 1000").rows_affected == 1
    assert second.path not in {p.path for p in s.catalog.state.collections["t"].parts}
    assert rows(s, "SELECT COUNT(*) AS n, SUM(m) AS s FROM t") == rows(Session(spark, root), "SELECT COUNT(*) AS n, SUM(m) AS s FROM t") == [(400, sum(i % 7 for i in range(400)) - 5 + 99)]
    assert s.execute("DELETE FROM t WHERE id >= 0").rows_affected == 400 and s.catalog.state.collections["t"].parts == []
    assert rows(s, "SELECT id FROM t") == [] and s.execute("INSERT INTO t VALUES (id=1)").last_insert_id > 401


def test_an_insert_leaves_a_registered_frame_where_it_is(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "x"))
    s = Session(spark)
    s.register("x", spark.read.parquet(str(tmp_path / "x")))
    assert s.execute("INSERT INTO x VALUES (id=70), (id=71)").last_insert_id == 52
    assert [p.frame is not None for p in s.catalog.state.collections["x"].parts] == [True, False]
    assert rows(s, "SELECT COUNT(*) AS n, MAX(id) AS m FROM x") == [(52, 71)]
    assert s.execute("UPDATE x SET id = id + 100 WHERE id > 70").rows_affected == 1  # the frame has no hit
    assert s.catalog.state.collections["x"].parts[0].frame is not None and rows(s, "SELECT MAX(id) AS m FROM x") == [(171,)]
    assert s.execute("DELETE FROM x WHERE id = 3 OR id = 70").rows_affected == 2
    assert not s.catalog.state.collections["x"].registered and rows(s, "SELECT COUNT(*) AS n FROM x") == [(50,)]


def test_many_rows_are_replaced_at_once(spark):
    s = Session(spark)
    s.insert_json("t", str([{"k": i, "v": 0} for i in range(30)]).replace("'", '"'))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("upsert", "")
    out = s.execute("INSERT OR REPLACE INTO t VALUES " + ", ".join(f"(k={i}, v={i})" for i in range(20, 60)))
    many = len(tracker.getJobIdsForGroup("upsert"))
    spark.sparkContext.setJobGroup("one", "")
    s.execute("INSERT OR REPLACE INTO t VALUES (k=5, v=5), (k=700, v=7)")
    assert many <= len(tracker.getJobIdsForGroup("one")) + 2  # jobs don't grow with the rows
    spark.sparkContext.setJobGroup("tests", "")
    assert out.rows_affected == 40 and rows(s, "SELECT COUNT(*) AS n, SUM(v) AS s FROM t") == [(61, sum(range(20, 60)) + 12)]
    s.execute("INSERT OR REPLACE INTO t VALUES (k=5, w='a'), (k=5, v=50, w='b'), (k=5.0, z=true)")
    assert rows(s, "SELECT v, w, z FROM t WHERE k = 5") == [(50, "b", True)]
    s.execute("INSERT INTO t VALUES (w='null key'), (k=800, k2='x')")
    s.execute("INSERT OR REPLACE INTO t VALUES (k=null, v=-1), (k='x', v=-2)")
    assert rows(s, "SELECT v, w FROM t WHERE k IS NULL") == [(-1, "null key")] and rows(s, "SELECT v FROM t WHERE k = 'x'") == [(-2,)]


def test_an_index_sorts_what_a_lookup_reads(spark, tmp_path):
    s = Session(spark)
    spark.range(4000).selectExpr("id", "hash(id) % 1000 as h", "named_struct('x', cast(id as string)) as d").repartition(4).write.parquet(str(tmp_path / "x"))
    s.register("x", spark.read.parquet(str(tmp_path / "x")))
    s.execute("INSERT INTO t SELECT id, h, d FROM x")
    s.execute("CREATE INDEX ON t (h)")
    found = spark.read.parquet(s.catalog.state.collections["t"].parts[0].path).selectExpr("h", "_metadata.file_name as f").groupBy("f").agg({"h": "min", "*": "count"}).collect()
    ranges = spark.read.parquet(s.catalog.state.collections["t"].parts[0].path).selectExpr("h", "_metadata.file_name as f").groupBy("f").agg({"h": "max"}).collect()
    low = sorted(r["min(h)"] for r in found)
    assert len(low) > 1 and all(a <= b for a, b in zip(sorted(r["max(h)"] for r in ranges)[:-1], low[1:], strict=True))  # no two files hold one value's neighbours
    s.execute("CREATE INDEX ON t (d.x)")
    plan = s.query("SELECT /*+ FORCE_INDEX(h) */ id FROM t WHERE h = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(h,5)" in plan
    assert rows(s, "SELECT id FROM t WHERE d.x = '77'") == [(77,)]
    s.execute("INSERT INTO t VALUES (id=5000, h=5)")
    assert s.execute("EXPLAIN SELECT id FROM t WHERE h = 5").rows()[0].scan == "INDEX LOOKUP"


def test_views_of_a_statement_are_dropped(spark):
    s = Session(spark)
    s.execute("INSERT INTO t VALUES (a=1)")
    s.execute("CREATE VIEW v AS SELECT a FROM t")
    for _ in range(3):
        s.query("SELECT a FROM v").collect()
        s.execute("UPDATE t SET a = a + 1, b = a")
    assert len([t for t in spark.catalog.listTables() if t.name.startswith(s.catalog.tag)]) <= 1
