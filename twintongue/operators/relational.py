"""Scans, projections, joins, aggregates, windows, sorting, set operations, recursion and views.

SAME holds queries whose text both systems run; OWN those with a text of their own
for the oracle, as (Spark, oracle).
"""

from __future__ import annotations

SAME = {
    # The flagship: a pricing summary over the largest table.
    "agg_flagship": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 4) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "scan_table": "SELECT * FROM customer",
    "scan_dual": "SELECT 1 AS one, 'text' AS t",
    "scan_empty": "SELECT c_custkey, c_name FROM customer WHERE 1 = 0",
    "scan_cte": "WITH rich AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000) SELECT r.c_custkey, s.c_acctbal FROM rich r JOIN rich s ON r.c_custkey = s.c_custkey",
    "index_scan": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 500",
    "index_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 77 AND o_totalprice > 1000",
    "index_lookup": "SELECT l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 42 AND l_linenumber = 1",
    "project_star": "SELECT * FROM nation",
    "project_expr": "SELECT o_orderkey, o_totalprice * 2 AS twice, 'x' AS tag, -o_custkey AS neg FROM orders",
    "filter": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03",
    "compare": "SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size > 10 AS gt, p_size <= 10 AS le, p_size >= 10 AS ge FROM part",
    "logical": "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING') AND c_nationkey > 3",
    "logical_nulls": "SELECT c_custkey, (NULLIF(c_nationkey, 3) > 2) AND (c_acctbal > 0) AS a, (NULLIF(c_nationkey, 3) > 2) OR (c_acctbal > 0) AS o FROM customer",
    "like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_name NOT LIKE '_b%'",
    "is_null": "SELECT c_custkey, NULLIF(c_nationkey, 5) IS NULL AS is_n, NULLIF(c_nationkey, 5) IS NOT NULL AS not_n FROM customer",
    "between": "SELECT p_partkey, p_size BETWEEN 5 AND 15 AS yes, p_size NOT BETWEEN 5 AND 15 AS no FROM part",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS level FROM orders",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders",
    "in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "exists_subquery": "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000)",
    "exists_correlated": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey",
    "join_full": "SELECT n_name, s_suppkey FROM nation FULL OUTER JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey * 4",
    "join_multi": """SELECT c_custkey, n_name, r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY c_custkey, n_name, r_name""",
    "semi_join": "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)",
    "anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "self_join": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "group_by": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey",
    "agg_global": "SELECT count(*) AS n, round(avg(l_quantity), 4) AS q FROM lineitem",
    "agg_global_empty": "SELECT count(*) AS n, max(l_quantity) AS q FROM lineitem WHERE l_quantity < 0",
    "count_star": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment",
    "count_col": "SELECT count(NULLIF(c_nationkey, 3)) AS n, count(*) AS every FROM customer",
    "avg": "SELECT p_brand, round(avg(p_retailprice), 4) AS a FROM part GROUP BY p_brand",
    "min_max": "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 8 AND sum(o_totalprice) > 100000",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "sort": "SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey DESC, c_custkey",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 15",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "setop_chain": "(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "cte": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT o_custkey, n FROM per WHERE n > 3",
    "cte_columns": "WITH x(k, v) AS (SELECT n_nationkey, n_name FROM nation) SELECT k, v FROM x WHERE k > 10",
    "cte_setop": "WITH x AS (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) SELECT k, count(*) AS n FROM x GROUP BY k",
    "recursive_cte": "WITH RECURSIVE t(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 60) SELECT n FROM t",
    "recursive_node": """WITH RECURSIVE reach(src, dst) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation UNION SELECT reach.src, (e.n_nationkey * 7 + 3) % 25 FROM reach JOIN nation e ON e.n_nationkey = reach.dst)
        SELECT src, dst FROM reach""",
    "recursive_ref": "WITH RECURSIVE fib(a, b) AS (SELECT 0 AS a, 1 AS b UNION ALL SELECT b, a + b FROM fib WHERE b < 500) SELECT a FROM fib",
    "stratify_node": """WITH RECURSIVE base(k) AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), down(k) AS (SELECT k FROM base UNION SELECT k - 1 FROM down WHERE k > 0) SELECT r.r_name, count(*) AS n FROM down JOIN nation ON n_nationkey = k JOIN region r ON r_regionkey = n_regionkey GROUP BY r.r_name""",
    "fn_upper_lower": "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l FROM customer",
    "fn_replace": "SELECT c_custkey, replace(c_name, '0', 'o') AS r FROM customer",
    "fn_abs": "SELECT s_suppkey, abs(s_acctbal) AS a FROM supplier",
    "fn_coalesce": "SELECT c_custkey, coalesce(NULLIF(c_nationkey, 3), NULLIF(c_nationkey, 4), -1) AS v FROM customer",
    "fn_nullif": "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS v FROM customer",
    "fn_ifnull": "SELECT c_custkey, ifnull(NULLIF(c_nationkey, 3), 99) AS v FROM customer",
}

OWN = {
    "arith": (
        "SELECT p_partkey, p_size + 3 AS a, p_size - 3 AS s, p_size * 3 AS m, p_size DIV 3 AS d, try_mod(p_size, 7) AS r, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size DIV (p_size % 2) END AS z, -p_size AS neg FROM part",
        "SELECT p_partkey, p_size + 3 AS a, p_size - 3 AS s, p_size * 3 AS m, CAST(p_size // 3 AS BIGINT) AS d, p_size % 7 AS r, CASE WHEN p_size % 2 = 0 THEN NULL ELSE CAST(p_size // (p_size % 2) AS BIGINT) END AS z, -p_size AS neg FROM part",
    ),
    "sum": ("SELECT o_orderstatus, sum(o_custkey) AS s, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS s, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_orderstatus"),
    "sum_compound": ("SELECT c_nationkey, sum(c_custkey) + count(*) * 2 AS v FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, CAST(sum(c_custkey) + count(*) * 2 AS BIGINT) AS v FROM customer GROUP BY c_nationkey"),
    "nongroup_first": ("SELECT n_regionkey, min_by(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey"),
    "arith_dialect": (
        "SELECT p_partkey, p_size / 7 AS q, p_size % 7 AS r, p_size / 0 AS z, p_size / 2.0 AS f, concat(p_name, NULL, p_size) AS c, trim(concat(' ', p_name, '  ')) AS t FROM part",
        "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS q, p_size % 7 AS r, CAST(NULL AS BIGINT) AS z, p_size / 2.0::DOUBLE AS f, p_name || p_size::VARCHAR AS c, trim(p_name) AS t FROM part",
    ),
    "group_expr": ("SELECT c_custkey % 10 AS b, count(*) AS n FROM customer GROUP BY c_custkey % 10", "SELECT c_custkey % 10 AS b, count(*) AS n FROM customer GROUP BY c_custkey % 10"),
    "win_row_number": ("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS rn FROM orders", None),
    "win_rank": ("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r FROM part", None),
    "win_dense_rank": ("SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS r FROM part", None),
    "win_partition": ("SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS BIGINT) AS rn, CAST(rank() OVER (ORDER BY n_regionkey) AS BIGINT) AS rk FROM nation", None),
    "win_multi_order": ("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_custkey DESC, o_orderkey ASC) AS BIGINT) AS rn FROM orders", None),
    "win_no_partition": ("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS rn FROM supplier", None),
    "fn_length": ("SELECT doc_id, octet_length(text) AS bytes, char_length(text) AS chars FROM documents", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes, CAST(length(text) AS INTEGER) AS chars FROM documents"),
    "fn_round": ("SELECT s_suppkey, round(s_acctbal) AS r0, round(s_acctbal, 1) AS r1 FROM supplier", None),
    "fn_ceil_floor": ("SELECT s_suppkey, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(ceiling(s_acctbal) AS BIGINT) AS c2, CAST(floor(s_acctbal) AS BIGINT) AS f FROM supplier", None),
}
