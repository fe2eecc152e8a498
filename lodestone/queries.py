"""The engine's queries over the driver's tables: dialect text, and the same in DuckDB's SQL."""

from __future__ import annotations

from lodestone.query_base import Query, dialect
from lodestone.query_scripts import SCRIPTS

#: name -> (dialect text, DuckDB text)
SELECTS: dict[str, tuple[str, str]] = {
    "scan_project": ("SELECT n_nationkey, n_name AS name FROM nation", "select n_nationkey, n_name as name from nation"),
    "select_star": ("SELECT * FROM region", "select * from region"),
    "qualified_star": ("SELECT N.* FROM nation N WHERE N.n_regionkey = 1", "select * from nation where n_regionkey = 1"),
    "computed_columns": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, 'x' AS tag, 1 + 3 AS four FROM lineitem", "select l_orderkey, l_linenumber, l_extendedprice*(1-l_discount) as net, 'x' as tag, cast(1+3 as bigint) as four from lineitem"),
    "default_names": ("SELECT p_partkey, p_size*2, UPPER(p_brand) FROM part", 'select p_partkey, cast(p_size*2 as bigint) as "p_size*2", upper(p_brand) as "UPPER" from part'),
    "filter_compare": ("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice >= 200000) AND o_orderpriority != '5-LOW'", "select o_orderkey, o_totalprice from orders where (o_orderstatus = 'F' or o_totalprice >= 200000) and o_orderpriority <> '5-LOW'"),
    "filter_not": ("SELECT event_id FROM events WHERE NOT (value > 100)", "select event_id from events where not coalesce(value > 100, false)"),
    "filter_in": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "select c_custkey from customer where c_mktsegment in ('BUILDING','MACHINERY')"),
    "filter_not_in": ("SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view')", "select event_id from events where event_type not in ('click','view')"),
    "filter_between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15", "select p_partkey from part where p_size between 5 and 15"),
    "filter_not_between": ("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45", "select p_partkey from part where not coalesce(p_size >= 5 and p_size <= 45,false)"),
    "filter_like": ("SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE 'nation_1%'", "select n_nationkey, n_name from nation where n_name ilike 'nation_1%'"),
    "filter_not_like": ("SELECT n_nationkey FROM nation WHERE n_name NOT LIKE '%_1%'", "select n_nationkey from nation where n_name is not null and not n_name ilike '%_1%'"),
    "filter_kinds_differ": ("SELECT p_partkey FROM part WHERE p_brand != 5 AND NOT (p_name > 3)", "select p_partkey from part"),
    "filter_truthy": ("SELECT p_partkey FROM part WHERE p_size - 1 AND p_name", "select p_partkey from part where p_size <> 1 and p_name <> ''"),
    "filter_absent": ("SELECT r_regionkey FROM region WHERE nosuch IS NULL AND nosuch != 1", "select r_regionkey from region"),
    "is_null_left_join": ("SELECT D.doc_id AS doc_id FROM documents D LEFT JOIN labels L ON D.doc_id = L.doc_id WHERE L.quality IS NULL", "select d.doc_id from documents d left join labels l on d.doc_id=l.doc_id where l.quality is null"),
    "null_comparison": ("SELECT D.doc_id AS doc_id, L.toxic AS toxic FROM documents D LEFT JOIN labels L ON D.doc_id = L.doc_id WHERE L.toxic != 1", "select d.doc_id, l.toxic from documents d left join labels l on d.doc_id=l.doc_id where l.toxic is distinct from 1"),
    "inner_join": ("SELECT n_name, r_name FROM nation N JOIN region R ON N.n_regionkey = R.r_regionkey", "select n.n_name, r.r_name from nation n join region r on n.n_regionkey=r.r_regionkey"),
    "left_join": ("SELECT D.doc_id AS doc_id, L.quality AS quality FROM documents D LEFT JOIN labels L ON D.doc_id = L.doc_id", "select d.doc_id, l.quality from documents d left join labels l on d.doc_id=l.doc_id"),
    "right_join": ("SELECT L.quality AS quality, D.doc_id AS doc_id FROM labels L RIGHT JOIN documents D ON L.doc_id = D.doc_id", "select l.quality, d.doc_id from labels l right join documents d on l.doc_id=d.doc_id"),
    "theta_join": ("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey > r_regionkey", "select n.n_nationkey, r.r_regionkey from nation n join region r on n.n_nationkey > r.r_regionkey"),
    "multi_join": ("SELECT c_name, n_name, r_name FROM customer C JOIN nation N ON C.c_nationkey = N.n_nationkey JOIN region R ON N.n_regionkey = R.r_regionkey WHERE c_acctbal > 5000", "select c.c_name, n.n_name, r.r_name from customer c join nation n on c.c_nationkey=n.n_nationkey join region r on n.n_regionkey=r.r_regionkey where c.c_acctbal > 5000"),
    "self_join": ("SELECT A.n_name AS a_name, B.n_name AS b_name FROM nation A JOIN nation B ON A.n_regionkey = B.n_regionkey WHERE A.n_nationkey < B.n_nationkey", "select a.n_name as a_name, b.n_name as b_name from nation a join nation b on a.n_regionkey=b.n_regionkey where a.n_nationkey < b.n_nationkey"),
    "join_hash_hint": ("SELECT /*+ HASH_JOIN */ n_name, r_name FROM nation N JOIN region R ON N.n_regionkey = R.r_regionkey", "select n.n_name, r.r_name from nation n join region r on n.n_regionkey=r.r_regionkey"),
    "join_nested_loop_hint": ("SELECT /*+ NESTED_LOOP */ n_name, r_name FROM nation N JOIN region R ON N.n_regionkey = R.r_regionkey", "select n.n_name, r.r_name from nation n join region r on n.n_regionkey=r.r_regionkey"),
    "parallel_hint": ("SELECT /*+ PARALLEL(4) */ c_custkey FROM customer WHERE c_acctbal > 0", "select c_custkey from customer where c_acctbal > 0"),
    "qualified_stars": ("SELECT N.*, R.* FROM nation N JOIN region R ON N.n_regionkey = R.r_regionkey", "select n.*, r.* from nation n join region r on n.n_regionkey=r.r_regionkey"),
    "group_by_count": ("SELECT event_type, COUNT(*) AS cnt FROM events GROUP BY event_type", "select event_type, count(*) as cnt from events group by event_type"),
    "group_by_multi": ("SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(AVG(l_extendedprice), 2) AS avg_price, MIN(l_discount) AS mn, MAX(l_tax) AS mx, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", "select l_returnflag, l_linestatus, round(sum(l_quantity)*100)/100 as sum_qty, round(coalesce(sum(l_extendedprice),0)/count(*)*100)/100 as avg_price, min(l_discount) as mn, max(l_tax) as mx, count(*) as n from lineitem group by l_returnflag, l_linestatus"),
    "global_agg": ("SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, AVG(l_linenumber) AS a, MIN(l_shipdate) AS d0, MAX(l_shipdate) AS d1 FROM lineitem", "select count(*) as n, cast(sum(l_linenumber) as bigint) as s, sum(l_linenumber)/count(*) as a, min(l_shipdate) as d0, max(l_shipdate) as d1 from lineitem"),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "select count(*) as n, coalesce(sum(o_totalprice),0::double) as s, max(o_orderkey) as m from orders where o_orderkey < 0"),
    "count_field": ("SELECT COUNT(L.doc_id) AS matched, COUNT(*) AS total FROM documents D LEFT JOIN labels L ON D.doc_id = L.doc_id", "select count(l.doc_id) as matched, count(*) as total from documents d left join labels l on d.doc_id=l.doc_id"),
    "avg_counts_nulls": ("SELECT AVG(L.quality) AS a FROM documents D LEFT JOIN labels L ON D.doc_id = L.doc_id", "select coalesce(sum(l.quality),0)/count(*) as a from documents d left join labels l on d.doc_id=l.doc_id"),
    "count_distinct": ("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS supp FROM lineitem GROUP BY l_returnflag", "select l_returnflag, count(distinct l_suppkey) as supp from lineitem group by l_returnflag"),
    "agg_distinct": ("SELECT SUM(DISTINCT p_size) AS s, AVG(DISTINCT p_size) AS a FROM part", "select cast(sum(distinct p_size) as bigint) as s, avg(distinct p_size) as a from part"),
    "having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12"),
    "having_alias": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12 AND MAX(o_totalprice) > 1000", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and max(o_totalprice) > 1000"),
    "agg_expr": ("SELECT l_shipdate, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS rev FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_shipdate", "select l_shipdate, round(sum(l_extendedprice*(1-l_discount))*100)/100 as rev from lineitem where l_returnflag='R' group by l_shipdate"),
    "agg_names": ("SELECT p_brand, MIN(p_size), MIN(p_retailprice), COUNT(*) FROM part GROUP BY p_brand", 'select p_brand, min(p_size) as "MIN", min(p_retailprice) as "MIN_2", count(*) as "COUNT" from part group by p_brand'),
    "order_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10"),
    "order_limit_offset": ("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10 OFFSET 5", "select event_id, value from events order by value desc, event_id limit 10 offset 5"),
    "order_multi": ("SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey, s_suppkey DESC LIMIT 20", "select s_suppkey, s_nationkey from supplier order by s_nationkey, s_suppkey desc limit 20"),
    "order_alias": ("SELECT p_partkey, p_retailprice * p_size AS worth FROM part ORDER BY worth DESC, p_partkey LIMIT 15", "select p_partkey, p_retailprice*p_size as worth from part order by worth desc, p_partkey limit 15"),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "select distinct l_returnflag, l_linestatus from lineitem"),
    "union_all": ("SELECT n_name AS name FROM nation UNION ALL SELECT r_name AS name FROM region", "select n_name as name from nation union all select r_name as name from region"),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", "select c_nationkey as k from customer union select s_nationkey as k from supplier"),
    "union_three": ("SELECT n_name AS name FROM nation UNION SELECT r_name AS name FROM region UNION ALL SELECT c_mktsegment AS name FROM customer", "(select n_name as name from nation union select r_name as name from region) union all select c_mktsegment as name from customer"),
    "case_when": ("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS tier FROM orders", "select o_orderkey, case when o_totalprice >= 200000 then 'high' when o_totalprice >= 100000 then 'mid' else 'low' end as tier from orders"),
    "case_no_else": ("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' END AS label FROM part", "select p_partkey, case when p_size > 25 then 'big' end as label from part"),
    "case_in_where": ("SELECT p_partkey FROM part WHERE CASE WHEN p_size > 25 THEN p_retailprice ELSE p_size * 60 END > 950", "select p_partkey from part where case when p_size > 25 then p_retailprice else p_size*60 end > 950"),
    "sub_in": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment='BUILDING')"),
    "sub_not_in": ("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id is not distinct from d.doc_id)"),
    "sub_scalar": ("SELECT event_id, value FROM events WHERE value > (SELECT AVG(value) FROM events)", "select event_id, value from events where value > (select avg(value) from events)"),
    "sub_scalar_select": ("SELECT r_regionkey, (SELECT MAX(n_nationkey) FROM nation) AS mx FROM region", "select r_regionkey, (select max(n_nationkey) from nation) as mx from region"),
    "sub_correlated_where": ("SELECT o_orderkey FROM orders O WHERE O.o_totalprice > (SELECT AVG(I.o_totalprice) FROM orders I WHERE I.o_custkey = O.o_custkey)", "select o_orderkey from orders o where o.o_totalprice > (select avg(i.o_totalprice) from orders i where i.o_custkey=o.o_custkey)"),
    "sub_correlated_select": ("SELECT R.r_name, (SELECT COUNT(*) FROM nation N WHERE N.n_regionkey = R.r_regionkey) AS nations FROM region R", "select r.r_name, (select count(*) from nation n where n.n_regionkey=r.r_regionkey) as nations from region r"),
    "sub_correlated_in": ("SELECT C.c_custkey FROM customer C WHERE C.c_custkey IN (SELECT O.o_custkey FROM orders O WHERE O.o_custkey = C.c_custkey AND O.o_totalprice > 150000)", "select c.c_custkey from customer c where c.c_custkey in (select o.o_custkey from orders o where o.o_custkey=c.c_custkey and o.o_totalprice>150000)"),
    "sub_nested": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))", "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey in (select r_regionkey from region where r_name='ASIA'))"),
    "sub_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT MAX(r_regionkey) FROM region)", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > (select max(r_regionkey) from region)"),
    "fn_string": ("SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, LENGTH(p_name) AS len, SUBSTR(p_name, 0, 3) AS s3, CONCAT(p_brand, ' - ', p_type) AS c, REPLACE(p_brand, 'Brand', 'B') AS rp, REVERSE(p_brand) AS rv, REPEAT(p_brand, 2) AS r2, HEX(p_brand) AS hx FROM part", "select p_partkey, upper(p_name) as u, lower(p_brand) as l, cast(length(p_name) as bigint) as len, substring(p_name, 1, 3) as s3, concat_ws('', p_brand, ' - ', p_type) as c, replace(p_brand,'Brand','B') as rp, reverse(p_brand) as rv, repeat(p_brand,2) as r2, hex(p_brand) as hx from part"),
    "fn_trim": ("SELECT n_nationkey, TRIM(CONCAT('\\t ', n_name, ' \\n')) AS t, LTRIM(CONCAT('\\t ', n_name)) AS lt, RTRIM(CONCAT(n_name, ' \\n')) AS rt FROM nation", "select n_nationkey, n_name as t, n_name as lt, n_name as rt from nation"),
    "fn_instr_bytes": ("SELECT doc_id, INSTR(text, 'a') AS pos FROM documents", "select doc_id, cast(case when instr(text,'a')>0 then strlen(substring(text,1,instr(text,'a')-1))+1 else 0 end as bigint) as pos from documents"),
    "fn_math": ("SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(c_acctbal) AS r0, ROUND(c_acctbal, 1) AS r1, CEIL(c_acctbal) AS ce, FLOOR(c_acctbal) AS fl FROM customer", "select c_custkey, abs(c_acctbal) as a, cast(round(c_acctbal) as bigint) as r0, round(c_acctbal*10)/10 as r1, cast(ceil(c_acctbal) as bigint) as ce, cast(floor(c_acctbal) as bigint) as fl from customer"),
    "fn_null": ("SELECT D.doc_id AS doc_id, COALESCE(L.quality, -1) AS q, IFNULL(L.toxic, 0) AS t, NULLIF(D.lang, 'en') AS nl FROM documents D LEFT JOIN labels L ON D.doc_id = L.doc_id", "select d.doc_id, cast(coalesce(l.quality, -1) as bigint) as q, cast(ifnull(l.toxic, 0) as bigint) as t, nullif(d.lang, 'en') as nl from documents d left join labels l on d.doc_id=l.doc_id"),
    "fn_typeof": ("SELECT p_partkey, TYPEOF(p_name) AS a, TYPEOF(p_size) AS b, TYPEOF(p_retailprice) AS c, TYPEOF(nosuch) AS d FROM part", "select p_partkey, 'text' as a, 'integer' as b, 'real' as c, 'null' as d from part"),
    "fn_where": ("SELECT p_partkey FROM part WHERE LENGTH(UPPER(p_name)) > 6", "select p_partkey from part where length(upper(p_name)) > 6"),
    "cast_text": ("SELECT o_orderkey, CAST(o_totalprice AS INTEGER) AS i, CAST(o_custkey AS TEXT) AS t FROM orders", "select o_orderkey, cast(trunc(o_totalprice) as bigint) as i, cast(o_custkey as varchar) as t from orders"),
    "nested_path": ("SELECT event_id, props.k AS k FROM events WHERE props.k > 50", "select event_id, cast(json_extract(props,'$.k') as bigint) as k from events where cast(json_extract(props,'$.k') as bigint) > 50"),
    "nested_group": ("SELECT props.k AS k, COUNT(*) AS n FROM events GROUP BY props.k", "select cast(json_extract(props,'$.k') as bigint) as k, count(*) as n from events group by 1"),
    "nested_star": ("SELECT event_id, props.* FROM events", "select event_id, cast(json_extract(props,'$.k') as bigint) as k from events"),
    "wildcard_child": ("SELECT event_id FROM events WHERE props.* > 50", "select event_id from events where cast(json_extract(props,'$.k') as bigint) > 50"),
    "wildcard_deep": ("SELECT event_id FROM events WHERE props.**.k BETWEEN 10 AND 20", "select event_id from events where cast(json_extract(props,'$.k') as bigint) between 10 and 20"),
    "array_passthrough": ("SELECT vec_id, embedding FROM embeddings WHERE label != 3", "select vec_id, embedding from embeddings where label <> 3"),
    "star_and_columns": ("SELECT *, n_nationkey * 2 AS twice, 'x' AS n_name FROM nation", "select n_nationkey, 'x' as n_name, n_regionkey, cast(n_nationkey * 2 as bigint) as twice from nation"),
    "sub_in_self": ("SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 2)", "select n_nationkey from nation where n_regionkey in (select n_regionkey from nation where n_nationkey < 2)"),
    "sub_not_in_self": ("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)", "select o_orderkey from orders where o_custkey not in (select o_custkey from orders where o_totalprice > 100000)"),
    "sub_group_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12)", "select c_custkey from customer where c_custkey in (select o_custkey from orders group by o_custkey having count(*) > 12)"),
    "distinct_order_hidden": ("SELECT DISTINCT o_custkey FROM orders ORDER BY o_totalprice DESC LIMIT 20", "select o_custkey from orders group by o_custkey order by max(o_totalprice) desc limit 20"),
    "fn_substring": ("SELECT p_partkey, SUBSTRING(p_name, 2, 4) AS a, SUBSTRING(p_name, 3) AS b FROM part", "select p_partkey, substring(p_name, 2, 4) as a, substring(p_name, 3) as b from part"),
    "fn_clocks": ("SELECT r_regionkey, LENGTH(SYSDATE) AS a, LENGTH(NOW()) AS b, LENGTH(CURRENT_DATE) AS c FROM region WHERE CURRENT_TIMESTAMP LIKE '20%T%'", "select r_regionkey, 19::bigint as a, 19::bigint as b, 10::bigint as c from region"),
    "comments": ("SELECT r_regionkey -- the key\nFROM region /* all\nof them */ WHERE r_regionkey > 1", "select r_regionkey from region where r_regionkey > 1"),
    "no_cache_hint": ("SELECT /*+ NO_CACHE */ c_custkey FROM customer WHERE c_nationkey = 3", "select c_custkey from customer where c_nationkey = 3"),
    "full_scan_hint": ("SELECT /*+ FULL_SCAN */ c_custkey FROM customer WHERE c_nationkey = 3", "select c_custkey from customer where c_nationkey = 3"),
    "nested_order": ("SELECT event_id, props.k AS k FROM events ORDER BY props.k DESC, event_id LIMIT 12", "select event_id, cast(json_extract(props,'$.k') as bigint) as k from events order by 2 desc, 1 limit 12"),
    "nested_join": ("SELECT E.event_id AS event_id, N.n_name AS n_name FROM events E JOIN nation N ON E.props.k = N.n_nationkey", "select e.event_id, n.n_name from events e join nation n on cast(json_extract(e.props,'$.k') as bigint) = n.n_nationkey"),
    "flagship": ("SELECT n_name, ROUND(SUM(L.l_extendedprice * (1 - L.l_discount)), 2) AS revenue, COUNT(*) AS items, SUM(CASE WHEN L.l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM customer C JOIN orders O ON C.c_custkey = O.o_custkey JOIN lineitem L ON L.l_orderkey = O.o_orderkey JOIN nation N ON C.c_nationkey = N.n_nationkey WHERE O.o_orderstatus IN ('F', 'O') GROUP BY n_name HAVING COUNT(*) > 5 ORDER BY revenue DESC", "select n.n_name as n_name, round(sum(l.l_extendedprice*(1-l.l_discount))*100)/100 as revenue, count(*) as items, cast(sum(case when l.l_returnflag='R' then 1 else 0 end) as bigint) as returned from customer c join orders o on c.c_custkey=o.o_custkey join lineitem l on l.l_orderkey=o.o_orderkey join nation n on c.c_nationkey=n.n_nationkey where o.o_orderstatus in ('F','O') group by n.n_name having count(*) > 5"),
}

PARAMS = {
    "params_filter": (("SELECT c_custkey FROM customer WHERE c_mktsegment = ? AND c_acctbal BETWEEN ? AND ?", ("BUILDING", 0, 5000.5)), "select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal between 0 and 5000.5"),
    "params_like": (("SELECT n_nationkey FROM nation WHERE n_name LIKE ?", ("%_2%",)), "select n_nationkey from nation where n_name ilike '%_2%'"),
}

QUERIES: dict[str, Query] = {
    **{k: dialect(q) for k, (q, _) in SELECTS.items()},
    **{k: dialect(*q) for k, (q, _) in PARAMS.items()},
    **{k: q for k, (q, _) in SCRIPTS.items()},
}
ORACLE_SQL = {k: sql for part in (SELECTS, PARAMS, SCRIPTS) for k, (_, sql) in part.items()}
