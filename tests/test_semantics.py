"""The rules on small documents: two-valued logic, kinds, wildcards, names, aggregates, functions."""

import pytest

from lodestone.plans.parser import DialectError
from lodestone.session import Session


@pytest.fixture(scope="module")
def s(spark):
    s = Session(spark)
    s.insert_json("t", '[{"id": 1, "n": 10, "s": "10", "b": true, "f": 2.5, "p": {"x": 7, "y": "deep", "q": {"x": 40}}, "l": [1, 2]},'
                       '{"id": 2, "n": null, "s": "Abc_%", "b": false, "f": -2.5, "p": {"x": null, "y": "top"}},'
                       '{"id": 3, "s": "", "n": 0}]')  # fmt: skip
    s.insert_json("k", '[{"id": 1, "w": "one"}, {"id": 1, "w": "uno"}, {"id": null, "w": "none"}, {"id": 9.0, "w": "nine"}]')
    s.insert_json("m", '[{"v": 1}, {"v": "1"}, {"v": 2.5}, {"v": true}, {"v": null}, {}]')
    return s


def ids(s, where, params=()):
    return sorted(r[0] for r in s.execute(f"SELECT id FROM t WHERE {where}", params).rows())


@pytest.mark.parametrize(
    "where, want",
    [
        ("n = NULL", [2, 3][:1]), ("n != 10", [2, 3]), ("n = nosuch", [2]), ("NOT (n > 5)", [2, 3]), ("n > 5 OR NOT n >= 0", [1, 2]), ("b = 1", [1]), ("s = 10", []), ("s != 10", [1, 2, 3]), ("s < 11", []),
        ("p = 1", []), ("l != 1", [1, 2, 3]), ("n", [1]), ("s", [1, 2]), ("p", [1, 2]), ("NOT p", [3]), ("n IN (10, NULL)", [1, 2]), ("n NOT IN (10)", [2, 3]), ("n NOT BETWEEN 5 AND 20", [2, 3]),
        ("s BETWEEN 9 AND 11", [1]), ("s LIKE 'aBC\\\\_%'", []), ("s LIKE 'ABC%'", [2]), ("s LIKE '_0'", [1]), ("nosuch NOT LIKE 'x'", []), ("n LIKE '1%'", [1]), ("s NOT LIKE '1%'", [2, 3]), ("p.x IS NULL", [2, 3]), ("p.q.x IS NOT NULL", [1]), ("1 = 1.0", [1, 2, 3]),
        ("f = -2.5", [2]), ("f > -n", [1]), ("p.* > 5", [1]), ("p.** > 30", [1]), ("p.**.x = 40", [1]), ("p.* LIKE 'DEEP'", [1]), ("p.** IN ('top')", [2]), ("p.* BETWEEN 6 AND 8", [1]), ("p.* IS NOT NULL", [1, 2]), ("p.** != 7", [1, 2]), ("p.* NOT IN (7)", [2, 3]), ("nosuch.* = 1", []),
        ("CASE WHEN n > 5 THEN 1 END = 1", [1]), ("n / 2 = 5", [1]), ("n + 's' IS NULL", [1, 2, 3]), ("id IN (SELECT id FROM k)", [1]), ("n IN (SELECT id FROM k)", [2]), ("n NOT IN (SELECT id FROM k)", [1, 3]), ("id = (SELECT id FROM k WHERE w = 'uno')", [1]), ("id = (SELECT id FROM k WHERE w = 'nobody')", []),
    ],
)
def test_where(s, where, want):
    assert ids(s, where) == want


def test_parameters(s):
    assert ids(s, "s LIKE ? AND n = ?", ("1%", 10)) == [1]
    with pytest.raises(DialectError):
        s.execute("SELECT id FROM t WHERE id = ?", ())


def test_joins(s):
    both = s.execute("SELECT t.id AS id, w FROM t JOIN k ON t.id = k.id").rows()
    assert sorted(r.w for r in both) == ["one", "uno"]
    left = s.execute("SELECT t.id AS a, k.w AS w FROM t LEFT JOIN k ON t.id = k.id").rows()
    assert sorted((r.a, r.w or "") for r in left) == [(1, "one"), (1, "uno"), (2, ""), (3, "")]
    assert s.execute("SELECT w FROM t RIGHT JOIN k ON k.id = t.id").df.count() == 4  # null keys join nothing
    with pytest.raises(DialectError):
        s.execute("SELECT * FROM t JOIN t ON t.id = t.id")
    row = s.execute("SELECT * FROM t A JOIN k B ON A.id = B.id WHERE w = 'one'").rows()[0]
    assert row.A.n == 10 and row.B.w == "one" and row.w == "one"


def test_mixed_kinds_are_variants(s):
    assert s.execute("SELECT COUNT(*) AS c FROM m WHERE v = 1").rows()[0].c == 2  # 1 and true
    assert s.execute("SELECT COUNT(*) AS c FROM m WHERE v = '1'").rows()[0].c == 1
    assert s.execute("SELECT COUNT(*) AS c FROM m WHERE v IS NULL").rows()[0].c == 2
    kinds = sorted(r.TYPEOF for r in s.execute("SELECT TYPEOF(v) FROM m").rows())
    assert kinds == ["boolean", "integer", "null", "null", "real", "text"]
    groups = {str(r.v): r.n for r in s.execute("SELECT v, COUNT(*) AS n FROM m GROUP BY v").rows()}
    assert groups["1"] == 2 and groups["2.5"] == 1
    assert s.execute("SELECT SUM(v) AS s FROM m").rows()[0].s == 4.5


@pytest.fixture(scope="module")
def x(spark):
    x = Session(spark)
    x.insert_json("t", '[{"id": 1, "v": 1}, {"id": 2, "v": "x"}, {"id": 3, "v": "y"}, {"id": 4, "v": 1.5}, {"id": 5, "v": true}, {"id": 6, "v": null}, {"id": 7}, {"id": 8, "v": {"a": 1}}, {"id": 9, "v": "1"}]')
    x.insert_json("k", '[{"g": 1, "x": 10}, {"g": 1, "x": 20}, {"g": 2, "x": 30}, {"g": null, "x": 40}]')
    return x


MIXED = [
    ("SELECT A.id AS a, B.id AS b FROM t A JOIN t B ON A.v = B.v WHERE A.id < B.id", {(1, 5)}),
    ("SELECT A.id AS a, B.id AS b FROM t A JOIN t B ON A.id != B.id WHERE A.v = B.v", {(1, 5), (5, 1), (6, 7), (7, 6)}),
    ("SELECT A.id AS a FROM t A WHERE A.v IN (SELECT B.v FROM t B WHERE B.id IN (2, 6))", {(2,), (6,), (7,)}),
    ("SELECT A.id AS a FROM t A WHERE A.v NOT IN (SELECT B.v FROM t B WHERE B.id IN (2, 6))", {(1,), (3,), (4,), (5,), (8,), (9,)}),
    ("SELECT id FROM t WHERE v IN (SELECT g FROM k)", {(1,), (5,), (6,), (7,)}),
    ("SELECT x FROM k WHERE g IN (SELECT v FROM t)", {(10,), (20,), (40,)}),
    ("SELECT id FROM t WHERE v > 'w'", {(2,), (3,)}),
    ("SELECT A.id AS a FROM t A JOIN t B ON A.id = B.id WHERE A.v < B.id", {(4,), (5,)}),
    ("SELECT x FROM k WHERE g IN (SELECT g FROM k WHERE x = 30)", {(30,)}),
    ("SELECT x FROM k WHERE g NOT IN (SELECT g FROM k WHERE x = 30)", {(10,), (20,), (40,)}),
    ("SELECT g, COUNT(*) AS n FROM k GROUP BY g HAVING COUNT(*) > (SELECT COUNT(*) FROM k GROUP BY g HAVING g = 2)", {(1, 2)}),
    ("SELECT CAST(MIN(v) AS TEXT) AS a, CAST(MAX(v) AS TEXT) AS b FROM t", {("1", "1.5")}),
    ("SELECT CAST(MIN(v) AS TEXT) AS a, CAST(MAX(v) AS TEXT) AS b FROM t WHERE id IN (2, 3, 4)", {("x", "y")}),  # the kind that came first
]


@pytest.mark.parametrize("sql, want", MIXED)
def test_mixed_kinds_and_the_same_collection(x, sql, want):
    found = [tuple(r) for r in x.execute(sql).rows()]
    assert set(found) == want and len(found) == len(want)


def test_sets_of_mixed_kinds(x):
    values = lambda sql: [None if r[0] is None else str(r[0]) for r in x.execute(sql).rows()]
    found = values("SELECT DISTINCT v FROM t ORDER BY v")
    assert [found[0], *sorted(found[1:3]), *found[3:]] == ["null", "1", "true", "1.5", '"1"', '"x"', '"y"', '{"a":1}']
    assert sorted(values("SELECT v FROM t UNION SELECT v FROM t"), key=str) == sorted([None, "1", "true", "1.5", '"x"', '"y"', '{"a":1}'], key=str)  # 1 and "1" read alike
    assert [r[0] for r in x.execute("SELECT id FROM t WHERE id < 8 ORDER BY v, id DESC").rows()] == [7, 6, 5, 1, 4, 2, 3]
    groups = {str(r.v): r.n for r in x.execute("SELECT v, COUNT(*) AS n FROM t GROUP BY v").rows()}
    assert groups == {"None": 2, "1": 2, "true": 1, "1.5": 1, '"x"': 1, '"y"': 1, '{"a":1}': 1}


def test_distinct_ordered_by_what_it_does_not_select(x):
    assert [r.g for r in x.execute("SELECT DISTINCT g FROM k ORDER BY x DESC").rows()] == [None, 2, 1]
    assert [r.g for r in x.execute("SELECT DISTINCT g FROM k ORDER BY x LIMIT 2").rows()] == [1, 2]


def test_changes_that_ask_the_same_collection(spark):
    s = Session(spark)
    s.insert_json("k", '[{"g": 1, "x": 10}, {"g": 1, "x": 20}, {"g": 2, "x": 30}, {"g": null, "x": 40}]')
    assert s.execute("DELETE FROM k WHERE g IN (SELECT g FROM k WHERE x = 30)").rows_affected == 1
    assert s.execute("UPDATE k SET x = x + 1 WHERE g NOT IN (SELECT g FROM k WHERE x = 10)").rows_affected == 1
    assert sorted(r.x for r in s.execute("SELECT x FROM k").rows()) == [10, 20, 41]


def test_aggregates(s):
    r = s.execute("SELECT COUNT(*), COUNT(n), SUM(n), AVG(n), MIN(s), MAX(f), COUNT(DISTINCT b) AS d FROM t").rows()[0]
    assert (r.COUNT, r.COUNT_2, r.SUM, r.MIN, r.MAX, r.d) == (3, 2, 10, "", 2.5, 2) and abs(r.AVG - 10 / 3) < 1e-9
    empty = s.execute("SELECT COUNT(*) AS c, SUM(n) AS s, AVG(n) AS a, MIN(n) AS m FROM t WHERE id > 9").rows()
    assert [tuple(x) for x in empty] == [(0, 0, 0.0, None)]
    grouped = s.execute("SELECT p.x, b, COUNT(*) AS n, f FROM t GROUP BY p.x, b").df
    assert grouped.columns == ["p.x", "b", "n", "f"] and {r.f for r in grouped.collect()} == {None}
    assert s.execute("SELECT id, COUNT(*) AS n FROM t").df.columns == ["n"]
    assert s.execute("SELECT b, SUM(id) AS s FROM t GROUP BY b HAVING SUM(id) > 1 AND s < 9 ORDER BY s DESC").rows()[0].s == 3
    assert s.execute("SELECT COUNT(*) * 2 + 1 AS z FROM t").rows()[0].z == 7


def test_nothing_there(s):
    assert s.execute("SELECT a, b.c FROM nowhere WHERE a = 1").rows() == []
    assert s.execute("SELECT COUNT(*) AS c FROM nowhere").rows()[0].c == 0
    assert s.execute("SELECT id FROM t WHERE id IN (SELECT * FROM nowhere)").rows() == []
    assert s.execute("UPDATE nowhere SET a = 1").rows_affected == 0


FUNCTIONS = [
    ("UPPER('aé')", "AÉ"), ("LOWER(5)", "5"), ("TRIM('\\t x \\n')", "x"), ("LTRIM(' \\tx ')", "x "), ("RTRIM('x\\r\\n')", "x"), ("LENGTH('aé😀')", 3), ("SUBSTR('hello', 2, 3)", "ell"), ("SUBSTR('hello', 0, 2)", "he"), ("SUBSTR('hello', 4)", "lo"), ("SUBSTRING('hello', 2, -1)", ""),
    ("CONCAT('a', null, 1, 2.0)", "a12"), ("REPLACE('aXbX', 'X', '-')", "a-b-"), ("INSTR('éa', 'a')", 3), ("INSTR('abc', 'z')", 0), ("REVERSE('aé')", "éa"), ("REPEAT('ab', 2)", "abab"), ("REPEAT('ab', -1)", ""), ("HEX(255)", "323535"), ("ABS(-3)", 3), ("ABS(-2.5)", 2.5), ("ROUND(2.5)", 3), ("ROUND(-2.5)", -3), ("ROUND(1.25, 1)", 1.3),
    ("CEIL(1.2)", 2), ("FLOOR(-1.2)", -2), ("COALESCE(null, 'x')", "x"), ("COALESCE(null, 1, 'x')", "1"), ("IFNULL(null, 4)", 4), ("NULLIF(1, '1')", None), ("NULLIF(1, 2)", 1), ("TYPEOF(1.5)", "real"), ("TYPEOF(null)", "null"), ("UPPER(null)", None), ("7 / 2", 3.5), ("2 + 3 * 4 - -1", 15), ("true + 1", 2.0), ("1 + null", None), ("CAST('12' AS INTEGER)", 12),
]


def test_functions(s):
    q = ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(FUNCTIONS))
    row = s.execute(f"SELECT {q} FROM t WHERE id = 1").rows()[0]
    assert {e: row[i] for i, (e, _) in enumerate(FUNCTIONS)} == dict(FUNCTIONS)


@pytest.mark.parametrize("e", ["UPPER()", "ROUND('x')", "NOSUCH(1)", "LENGTH(1, 2)", "PRINTF('x')"])
def test_refused_functions(s, e):
    with pytest.raises(ValueError):
        s.execute(f"SELECT {e} FROM t")


def test_division_by_zero_is_an_error(s):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        s.execute("SELECT 1 / n AS x FROM t WHERE id = 3").rows()


def test_clock(s):
    r = s.execute("SELECT SYSDATE AS a, NOW() AS b, CURRENT_DATE AS c, CURRENT_TIMESTAMP AS d FROM t").rows()[0]
    assert len(r.a) == len(r.b) == 19 and len(r.c) == 10 and r.d.startswith(r.c + "T")


def test_order(s):
    assert [r.id for r in s.execute("SELECT id FROM t ORDER BY n").rows()] == [2, 3, 1]
    assert [r.id for r in s.execute("SELECT id, n * 2 AS z FROM t ORDER BY z DESC, id LIMIT 2").rows()] == [1, 3]
    assert [r.b for r in s.execute("SELECT DISTINCT b FROM t ORDER BY b DESC LIMIT 1 OFFSET 1").rows()] == [False]


def test_unions(s):
    rows = s.execute("SELECT id, s FROM t WHERE id = 1 UNION ALL SELECT s, id FROM t WHERE id = 1").rows()
    assert [tuple(r) for r in rows] == [(1, "10"), (1, "10")]  # by name
    assert s.execute("SELECT id FROM t UNION SELECT id FROM t").df.count() == 3
    wide = s.execute("SELECT id FROM t WHERE id = 1 UNION ALL SELECT id, w FROM k WHERE w = 'one'").df
    assert wide.columns == ["id", "w"]


def test_literals_that_look_like_variables(spark):
    s = Session(spark)
    s.execute('INSERT INTO t VALUES (a="${x} b", n=1), (a=" b", n=2), (a="$x", n=3)')
    said = lambda where: sorted(r.n for r in s.query(f"SELECT n FROM t WHERE {where}").collect())
    assert [said(w) for w in ('a = "${x} b"', 'a IN ("${x} b", "$x")', 'a LIKE "%{x} b"', 'a LIKE "${X}%"', 'a = " b"')] == [[1], [1, 3], [1], [1], [2]]
    assert s.query('SELECT CONCAT("${env:HOME}", "-") AS c FROM t LIMIT 1').first().c == "${env:HOME}-"
