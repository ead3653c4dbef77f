"""Queries over the benchmark tables, one for each operator, with the same question in DuckDB's SQL.

Where the dialect's text means the same in DuckDB, it is its own oracle; sums are cast there, as DuckDB widens
them, and descending NULLs are put first.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .sources.catalog import parquet_tables

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]

#: Views with NULLs and with types that the dialect doesn't have, defined alike on both sides.
VIEWS = {
    "orders_n": "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus FROM orders",
    "customer_n": "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS nationkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer",
    "line_cents": "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_partkey, l_suppkey, CAST(FLOOR(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents, CAST(FLOOR(l_quantity + 0.5) AS BIGINT) AS quantity, l_orderkey % 100 AS bucket, l_orderkey % 10 AS decile, l_orderkey % 2 AS half, l_orderkey % 8 AS few FROM lineitem",
    "wide_left": "SELECT l_orderkey % 16 AS k1, l_partkey % 16 AS k2, l_partkey % 256 AS k, l_suppkey % 128 AS part_of, l_orderkey % 100 AS filter_key, l_orderkey AS payload FROM lineitem",
    "narrow_right": "SELECT p_partkey % 16 AS k1, CAST(FLOOR(p_partkey / 16) AS BIGINT) % 16 AS k2, p_partkey % 256 AS k, p_partkey + 9999 AS payload FROM part WHERE p_partkey <= 256",
}

_WITH = "WITH " + ", ".join(f"{name} AS ({body})" for name, body in VIEWS.items()) + " "


def _same(sql: str) -> tuple[str, str]:
    return sql, sql


def _summed(sql: str) -> tuple[str, str]:
    """The sum that is called total is cast for DuckDB."""
    return sql, re.sub(r"(SUM\(\S+\)(?: OVER \([^)]*\))?) AS total", r"CAST(\1 AS BIGINT) AS total", sql)


#: name: (query of the dialect, oracle); an oracle of None means that the question has no SQL.
DEFINED: dict[str, tuple[str, str | None]] = {
    # scans and projections
    "scan_project": _same("SELECT n_name, n_nationkey FROM nation"),
    "scan_alias": _same("SELECT n.n_name AS name FROM nation AS n"),
    "literal_projection": ("SELECT r_regionkey AS k, 99 AS n, -7 AS m, 'it''s' AS s, NULL AS nothing FROM region", "SELECT r_regionkey AS k, 99 AS n, -7 AS m, 'it''s' AS s, CAST(NULL AS BIGINT) AS nothing FROM region"),
    "projection_names": ("SELECT nation.n_name, COUNT(*), 5 FROM nation GROUP BY nation.n_name", 'SELECT n_name AS "nation.n_name", COUNT(*) AS "COUNT(*)", 5 AS "5" FROM nation GROUP BY n_name'),
    # filters
    "filter_eq": _same("SELECT o_orderkey FROM orders WHERE o_custkey = 37"),
    "filter_ne": _same("SELECT n_nationkey FROM nation WHERE n_regionkey <> 2"),
    "filter_lt": _same("SELECT c_custkey FROM customer WHERE c_custkey < 40"),
    "filter_le": _same("SELECT c_custkey FROM customer WHERE 40 >= c_custkey"),
    "filter_gt": _same("SELECT p_partkey FROM part WHERE p_size > 45"),
    "filter_ge": _same("SELECT p_partkey FROM part WHERE p_size >= 45"),
    "filter_string_cmp": _same("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'FURNITURE' AND c_mktsegment < 'MACHINERZ'"),
    "filter_col_col": _same("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey"),
    "filter_literal_literal": _same("SELECT r_name FROM region WHERE 1 = 1 AND 'a' < 'b'"),
    "filter_is_null": _same("SELECT o_orderkey FROM orders_n WHERE custkey IS NULL"),
    "filter_is_not_null": _same("SELECT o_orderkey FROM orders_n WHERE priority IS NOT NULL"),
    "filter_and_or_paren": _same("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_custkey < 100) AND (o_orderpriority = '1-URGENT' OR o_orderkey < 50 AND o_custkey > 3)"),
    "filter_null_3vl": _same("SELECT o_orderkey FROM orders_n WHERE custkey <> 5 OR priority = '1-URGENT' AND custkey >= 0"),
    # order and limit
    "order_by_multi": _same("SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey"),
    "order_by_nulls": ("SELECT custkey, o_orderkey FROM orders_n ORDER BY custkey DESC, o_orderkey LIMIT 300", "SELECT custkey, o_orderkey FROM orders_n ORDER BY custkey DESC NULLS FIRST, o_orderkey LIMIT 300"),
    "order_by_nulls_asc": ("SELECT priority, o_orderkey FROM orders_n ORDER BY priority, o_orderkey DESC LIMIT 300", "SELECT priority, o_orderkey FROM orders_n ORDER BY priority NULLS LAST, o_orderkey DESC LIMIT 300"),
    "order_by_hidden_col": _same("SELECT c_name FROM customer ORDER BY c_custkey DESC LIMIT 25"),
    "order_by_alias": _same("SELECT c_custkey AS k, c_nationkey AS c_custkey FROM customer ORDER BY k LIMIT 20"),
    "limit_total_order": _same("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100"),
    "limit_zero": _same("SELECT o_orderkey FROM orders LIMIT 0"),
    "limit_beyond": _same("SELECT n_name FROM nation ORDER BY n_name LIMIT 9999999999"),
    # distinct
    "distinct_rows": _same("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "distinct_nulls": _same("SELECT DISTINCT priority, o_orderstatus FROM orders_n"),
    "distinct_order_limit": _same("SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey DESC LIMIT 17"),
    "distinct_over_group": _same("SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey"),
    # joins
    "join_inner_equi": _same("SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join_multi_key": _same("SELECT a.l_orderkey AS k, a.l_linenumber AS n, b.cents AS cents FROM lineitem AS a INNER JOIN line_cents b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"),
    "join_residual": _same("SELECT o.o_orderkey AS k, l.l_linenumber AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND (l.l_suppkey < o.o_custkey OR l.l_linenumber = 1)"),
    "join_theta": _same("SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey"),
    "join_cross": _same("SELECT n_name, r_name FROM nation JOIN region ON 1 = 1"),
    "join_null_keys": _same("SELECT o.o_orderkey AS k, c.c_custkey AS c FROM orders_n o JOIN customer_n c ON o.custkey = c.nationkey"),
    "join_left": _same("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "join_left_residual_on": _same("SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'"),
    "join_right": _same("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderpriority = '2-HIGH'"),
    "join_chain_mixed": _same("SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey AND c_custkey < 300 RIGHT JOIN orders ON c_custkey = o_custkey"),
    "self_join": _same("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "left_join_null_rejecting_where": _same("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey > 100"),
    "anti_unlabelled": _same("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "left_join_labels": _same("SELECT d.doc_id AS id, l.quality AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality = 0"),
    # aggregates
    "agg_global": ("SELECT COUNT(*) AS n, SUM(quantity) AS q, MIN(cents) AS lo, MAX(cents) AS hi FROM line_cents", "SELECT COUNT(*) AS n, CAST(SUM(quantity) AS BIGINT) AS q, MIN(cents) AS lo, MAX(cents) AS hi FROM line_cents"),
    "agg_global_empty": ("SELECT COUNT(*) AS n, COUNT(n_name) AS m, SUM(n_nationkey) AS s, MAX(n_name) AS hi FROM nation WHERE n_nationkey < 0", "SELECT COUNT(*) AS n, COUNT(n_name) AS m, CAST(SUM(n_nationkey) AS BIGINT) AS s, MAX(n_name) AS hi FROM nation WHERE n_nationkey < 0"),
    "agg_group_multi": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(cents) AS total FROM line_cents GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(cents) AS BIGINT) AS total FROM line_cents GROUP BY l_returnflag, l_linestatus"),
    "agg_count_star_vs_col": _same("SELECT o_orderstatus, COUNT(*) AS n, COUNT(custkey) AS keys, COUNT(priority) AS priorities FROM orders_n GROUP BY o_orderstatus"),
    "agg_sum": ("SELECT l_suppkey, SUM(quantity) AS q, SUM(cents) AS c FROM line_cents GROUP BY l_suppkey", "SELECT l_suppkey, CAST(SUM(quantity) AS BIGINT) AS q, CAST(SUM(cents) AS BIGINT) AS c FROM line_cents GROUP BY l_suppkey"),
    "agg_min_max_string": _same("SELECT c_nationkey, MIN(c_name) AS lo, MAX(c_mktsegment) AS hi FROM customer GROUP BY c_nationkey"),
    "group_by_only": _same("SELECT o_orderpriority FROM orders GROUP BY o_orderpriority"),
    "group_null_keys": ("SELECT nationkey, segment, COUNT(*) AS n, SUM(c_custkey) AS s FROM customer_n GROUP BY nationkey, segment", "SELECT nationkey, segment, COUNT(*) AS n, CAST(SUM(c_custkey) AS BIGINT) AS s FROM customer_n GROUP BY nationkey, segment"),
    "having_agg": _same("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12"),
    "having_hidden_agg": _same("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_orderkey) < 9000 AND MIN(o_orderpriority) = '1-URGENT'"),
    "having_key_or_agg": _same("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey HAVING n_regionkey = 1 OR (COUNT(*) >= 5 AND n_regionkey > 2)"),
    "having_global": _same("SELECT 1 AS one FROM orders HAVING COUNT(*) > 0"),
    "having_global_none": _same("SELECT COUNT(*) AS n FROM orders HAVING MIN(o_orderkey) > 1000000000"),
    "having_in_subquery": _same("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) IN (SELECT n_regionkey FROM nation) AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)"),
    "having_exists_scalar": _same("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING EXISTS (SELECT c_custkey FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 3) AND COUNT(*) >= (SELECT MAX(r_regionkey) FROM region)"),
    # windows
    "win_row_number": _same("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders"),
    "win_rank": _same("SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part"),
    "win_dense_rank": _same("SELECT p_partkey, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part"),
    "win_global_rank": _same("SELECT n_nationkey, RANK() OVER (ORDER BY n_regionkey) AS r, DENSE_RANK() OVER (ORDER BY n_regionkey DESC) AS d FROM nation"),
    "win_rank_unordered": ("SELECT n_name, RANK() OVER (PARTITION BY n_regionkey) AS r, DENSE_RANK() OVER () AS d FROM nation", "SELECT n_name, CAST(1 AS BIGINT) AS r, CAST(1 AS BIGINT) AS d FROM nation"),
    "win_rank_frame_ignored": ("SELECT n_name, RANK() OVER (ORDER BY n_regionkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM nation", "SELECT n_name, RANK() OVER (ORDER BY n_regionkey) AS r FROM nation"),
    "win_agg_partition": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY custkey) AS n, COUNT(priority) OVER (PARTITION BY custkey) AS m, SUM(o_orderkey) OVER (PARTITION BY custkey) AS s, MIN(priority) OVER (PARTITION BY custkey) AS lo, MAX(o_orderkey) OVER (PARTITION BY custkey) AS hi FROM orders_n", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY custkey) AS n, COUNT(priority) OVER (PARTITION BY custkey) AS m, CAST(SUM(o_orderkey) OVER (PARTITION BY custkey) AS BIGINT) AS s, MIN(priority) OVER (PARTITION BY custkey) AS lo, MAX(o_orderkey) OVER (PARTITION BY custkey) AS hi FROM orders_n"),
    "win_whole_table": ("SELECT n_name, SUM(n_nationkey) OVER () AS s, COUNT(*) OVER () AS n FROM nation", "SELECT n_name, CAST(SUM(n_nationkey) OVER () AS BIGINT) AS s, COUNT(*) OVER () AS n FROM nation"),
    "win_running_range": ("SELECT p_partkey, SUM(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size) AS s, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM part", "SELECT p_partkey, CAST(SUM(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part"),
    "win_running_rows": ("SELECT o_orderkey, SUM(o_custkey) OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM orders", "SELECT o_orderkey, CAST(SUM(o_custkey) OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders"),
    "win_range_no_order": ("SELECT n_name, SUM(n_nationkey) OVER (PARTITION BY n_regionkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM nation", "SELECT n_name, CAST(SUM(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS s FROM nation"),
    "win_over_group": ("SELECT o_custkey, SUM(COUNT(*)) OVER () AS total, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM orders GROUP BY o_custkey", "SELECT o_custkey, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM orders GROUP BY o_custkey"),
    "win_null_keys": ("SELECT c_custkey, RANK() OVER (PARTITION BY segment ORDER BY nationkey DESC) AS r FROM customer_n", "SELECT c_custkey, RANK() OVER (PARTITION BY segment ORDER BY nationkey DESC NULLS FIRST) AS r FROM customer_n"),
    "win_order_by_output": _same("SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part ORDER BY r DESC, p_partkey LIMIT 40"),
    "win_distinct": _same("SELECT DISTINCT p_brand, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part"),
    "win_in_subquery": _same("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT RANK() OVER (ORDER BY r_name) FROM region)"),
    # subqueries without correlation
    "sub_scalar": _same("SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT MAX(c_custkey) FROM customer) OR o_orderkey = (SELECT MIN(o_orderkey) FROM orders)"),
    "sub_scalar_empty": _same("SELECT n_name FROM nation WHERE (SELECT r_regionkey FROM region WHERE r_regionkey > 99) IS NULL"),
    "sub_in": _same("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "sub_not_in": _same("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "sub_not_in_null_set": _same("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT custkey FROM orders_n)"),
    "sub_not_in_null_value": _same("SELECT o_orderkey FROM orders_n WHERE custkey NOT IN (SELECT s_suppkey FROM supplier)"),
    "sub_not_in_empty_set": _same("SELECT o_orderkey FROM orders_n WHERE custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 0)"),
    "sub_exists": _same("SELECT n_name FROM nation WHERE EXISTS (SELECT r_name FROM region WHERE r_regionkey = 4)"),
    "sub_exists_limit_zero": _same("SELECT n_name FROM nation WHERE NOT EXISTS (SELECT r_name FROM region LIMIT 0)"),
    "sub_not_exists": _same("SELECT n_name FROM nation WHERE NOT EXISTS (SELECT r_name FROM region WHERE r_regionkey = 4)"),
    "sub_under_or": _same("SELECT o_orderkey FROM orders_n WHERE custkey IN (SELECT s_suppkey FROM supplier) OR priority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderkey < 3) OR EXISTS (SELECT n_name FROM nation WHERE n_nationkey > 900)"),
    "sub_in_join_on": _same("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)"),
    "sub_in_left_join_on": _same("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)"),
    "nested_subqueries": _same("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = (SELECT MAX(r_regionkey) FROM region WHERE r_name < 'F'))"),
    # correlated subqueries
    "corr_scalar_max": _same("SELECT o_orderkey FROM orders o WHERE o_orderkey = (SELECT MAX(i.o_orderkey) FROM orders i WHERE i.o_custkey = o.o_custkey)"),
    "corr_scalar_count": _same("SELECT c_custkey FROM customer WHERE (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) = 0"),
    "corr_exists": _same("SELECT c_custkey FROM customer WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "corr_not_exists": _same("SELECT c_custkey FROM customer_n c WHERE NOT EXISTS (SELECT n_name FROM nation WHERE n_nationkey = c.nationkey AND n_regionkey < 3)"),
    "corr_in": _same("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_suppkey IN (SELECT o_custkey FROM orders o WHERE o.o_orderkey = l.l_orderkey)"),
    "corr_not_in": _same("SELECT c.c_custkey AS k FROM customer_n c WHERE c.nationkey NOT IN (SELECT o.custkey FROM orders_n o WHERE o.o_orderkey = c.c_custkey)"),
    "corr_non_equi": _same("SELECT n_name FROM nation n WHERE EXISTS (SELECT s_name FROM supplier s WHERE s.s_suppkey < n.n_nationkey AND s.s_nationkey > n.n_nationkey)"),
    "corr_or": _same("SELECT n_name FROM nation n WHERE n.n_regionkey = 2 OR EXISTS (SELECT s_name FROM supplier s WHERE s.s_nationkey = n.n_nationkey OR s.s_suppkey = n.n_regionkey)"),
    "corr_agg_having_on": _same("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT o.o_orderstatus FROM orders o JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_custkey = c.c_custkey GROUP BY o.o_orderstatus HAVING COUNT(*) > c.c_nationkey)"),
    "corr_grandparent": _same("SELECT n_name FROM nation n WHERE EXISTS (SELECT s_suppkey FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND EXISTS (SELECT c_custkey FROM customer c WHERE c.c_custkey = s.s_suppkey AND c.c_nationkey <> n.n_nationkey))"),
    "corr_outer_agg_arg": ("SELECT n_nationkey AS k FROM nation WHERE n_nationkey = (SELECT MAX(nation.n_nationkey) FROM region)", "SELECT n_nationkey AS k FROM nation"),
    "corr_order_by_outer": ("SELECT n_nationkey AS k FROM nation n WHERE n.n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey <= n.n_nationkey ORDER BY n.n_name, r_regionkey LIMIT 1)", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0"),
    "corr_limit": ("SELECT c_custkey FROM customer c WHERE c.c_custkey IN (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey <= c.c_nationkey ORDER BY o.o_orderkey LIMIT 3)", "SELECT c_custkey FROM customer c JOIN (SELECT n, k FROM (SELECT n_nationkey AS n, o_orderkey AS k, row_number() OVER (PARTITION BY n_nationkey ORDER BY o_orderkey) AS rn FROM nation JOIN orders ON o_custkey <= n_nationkey) WHERE rn <= 3) t ON t.n = c.c_nationkey AND t.k = c.c_custkey"),
    "corr_two_sided_on": ("SELECT c.c_custkey AS c, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND EXISTS (SELECT l.l_linenumber FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber > c.c_nationkey)", "SELECT c.c_custkey AS c, p.o_orderkey AS o FROM customer c LEFT JOIN (SELECT DISTINCT x.c_custkey, o.o_orderkey FROM customer x JOIN orders o ON x.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber > x.c_nationkey) p ON p.c_custkey = c.c_custkey"),
    "corr_distinct_window": ("SELECT n_name FROM nation n WHERE 2 IN (SELECT DENSE_RANK() OVER (ORDER BY s.s_suppkey) FROM supplier s WHERE s.s_nationkey = n.n_nationkey)", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING COUNT(*) >= 2)"),
    # plans as text
    "explain_report": ("EXPLAIN SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY n_name", None),
    # the published workloads in their shapes, on these tables: selectivities, sizes of the sides, ORDER BY and HAVING
    "bench_scan_filter_1pct": _same("SELECT l_orderkey, l_linenumber FROM line_cents WHERE bucket = 7"),
    "bench_scan_filter_10pct": _same("SELECT l_orderkey, l_linenumber FROM line_cents WHERE decile = 3"),
    "bench_scan_filter_50pct": _same("SELECT l_orderkey, l_linenumber FROM line_cents WHERE half = 1"),
    "bench_multi_key_hash_join": _same("SELECT l.payload AS left_payload, r.payload AS right_payload FROM wide_left l JOIN narrow_right r ON l.k1 = r.k1 AND l.k2 = r.k2"),
    "bench_aggregate_few_groups": _summed("SELECT few, SUM(cents) AS total, COUNT(*) AS n FROM line_cents GROUP BY few ORDER BY few"),
    "bench_aggregate_many_groups": _summed("SELECT l_orderkey, SUM(cents) AS total FROM line_cents GROUP BY l_orderkey ORDER BY l_orderkey"),
    "bench_sort": _same("SELECT l_orderkey, l_linenumber, cents FROM line_cents ORDER BY cents DESC, l_orderkey, l_linenumber LIMIT 1000"),
    "bench_join_group_sort_limit": _summed("SELECT l.part_of AS part_of, SUM(r.payload) AS total FROM wide_left l JOIN narrow_right r ON l.k = r.k WHERE l.filter_key < 80 GROUP BY l.part_of HAVING SUM(r.payload) > 0 ORDER BY total DESC, part_of LIMIT 20"),
    "bench_string_group_by": _same("SELECT event_type, COUNT(*) AS n, MIN(props) AS lo, MAX(props) AS hi FROM events GROUP BY event_type ORDER BY event_type ASC"),
    "bench_selective_in_semi_join": _same("SELECT l.payload AS payload FROM wide_left l WHERE l.k1 IN (SELECT r.k1 FROM narrow_right r WHERE r.payload = 10000)"),
    "bench_window_row_number_sum": _summed("SELECT l_orderkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn, SUM(cents) OVER (PARTITION BY l_suppkey) AS total FROM line_cents"),
    "bench_window_running_sum": _summed("SELECT l_orderkey, l_linenumber, SUM(cents) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS total FROM line_cents"),
    "bench_selective_not_in_null_aware_anti": _same("SELECT l.payload AS payload FROM wide_left l WHERE l.k1 NOT IN (SELECT r.k1 FROM narrow_right r WHERE r.k2 = l.k2 AND r.payload < 10016)"),
    # outer columns, windows and limits without an order
    "sub_projects_outer": _same("SELECT n_name FROM nation n WHERE n.n_regionkey IN (SELECT n.n_regionkey FROM region WHERE r_regionkey = n.n_nationkey)"),
    "win_number_without_order": _same("SELECT ROW_NUMBER() OVER () AS rn FROM orders"),
    "win_rows_without_order": _same("SELECT COUNT(*) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders"),
    "win_three_orders": _summed("SELECT o_orderkey, RANK() OVER (ORDER BY o_custkey) AS a, COUNT(*) OVER (ORDER BY o_orderpriority) AS b, SUM(o_custkey) OVER (ORDER BY o_orderstatus DESC, o_orderkey) AS total FROM orders"),
    "limit_beyond_int": _same("SELECT o_orderkey FROM orders ORDER BY o_custkey LIMIT 3000000000"),
    # the order of the tables' rows kept (strict_order): orders lie in the order of their keys
    "strict_row_number_ties": ("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderstatus) AS rn FROM orders", "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderstatus, o_orderkey) AS rn FROM orders"),
    "strict_running_rows": ("SELECT o_orderkey, SUM(o_custkey) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM orders", "SELECT o_orderkey, CAST(SUM(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM orders"),
    "strict_limit": ("SELECT o_orderkey, o_custkey FROM orders LIMIT 70", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 70"),
    "strict_first_of_ties": ("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority LIMIT 50", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 50"),
    "strict_sum": _summed("SELECT o_orderstatus, SUM(o_custkey) AS total FROM orders GROUP BY o_orderstatus"),
}

FLAGSHIP = (
    "SELECT c.c_nationkey AS nation, o.o_orderpriority AS priority, COUNT(*) AS n, SUM(l.quantity) AS quantity, RANK() OVER (PARTITION BY o.o_orderpriority ORDER BY SUM(l.quantity) DESC) AS r "
    "FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN line_cents l ON l.l_orderkey = o.o_orderkey "
    "WHERE o.o_orderstatus <> 'P' GROUP BY c.c_nationkey, o.o_orderpriority HAVING COUNT(*) > 1 ORDER BY r, priority, nation LIMIT 100"
)
DEFINED["flagship"] = (FLAGSHIP, FLAGSHIP.replace("SUM(l.quantity) AS quantity", "CAST(SUM(l.quantity) AS BIGINT) AS quantity"))


#: The views as DataFrames: the table they read, and their columns.
_VIEW_COLUMNS = {
    "orders_n": ("orders", lambda: ["o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("custkey"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), "o_orderstatus"]),
    "customer_n": ("customer", lambda: ["c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")).alias("nationkey"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment")]),
    "line_cents": ("lineitem", lambda: ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("cents"), F.floor(F.col("l_quantity") + 0.5).alias("quantity"), *((F.col("l_orderkey") % n).alias(name) for name, n in (("bucket", 100), ("decile", 10), ("half", 2), ("few", 8)))]),
    "wide_left": ("lineitem", lambda: [*((F.col(c) % n).alias(name) for name, c, n in (("k1", "l_orderkey", 16), ("k2", "l_partkey", 16), ("k", "l_partkey", 256), ("part_of", "l_suppkey", 128), ("filter_key", "l_orderkey", 100))), F.col("l_orderkey").alias("payload")]),
    "narrow_right": ("part", lambda: [(F.col("p_partkey") % 16).alias("k1"), (F.floor(F.col("p_partkey") / 16) % 16).alias("k2"), (F.col("p_partkey") % 256).alias("k"), (F.col("p_partkey") + 9999).alias("payload")]),
}
#: Rows of a view, where not all of its table's.
_VIEW_ROWS = {"narrow_right": "p_partkey <= 256"}


def engine(spark: SparkSession, folder: str, strict_order: bool = False, only: set[str] | None = None) -> Engine:
    """An engine over a folder's tables and the views above; only: names of those that are wanted."""
    wanted = [n for n in [*TABLES, *_VIEW_COLUMNS] if only is None or n in only]
    base = {_VIEW_COLUMNS[n][0] if n in _VIEW_COLUMNS else n for n in wanted}
    tables = parquet_tables(spark, folder, [n for n in TABLES if n in base])
    out = Engine(spark, strict_order)
    for name in wanted:
        if name in _VIEW_COLUMNS:
            table, columns = _VIEW_COLUMNS[name]
            rows = tables[table].where(_VIEW_ROWS[name]) if name in _VIEW_ROWS else tables[table]
            out.register(name, rows.select(*columns()))
        else:
            out.register(name, tables[name])
    return out


def _runner(name: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    names = set(re.findall(r"\w+", sql))
    return lambda spark, folder: engine(spark, folder, name.startswith("strict_"), names).sql(sql)


QUERIES = {name: _runner(name, sql) for name, (sql, _) in DEFINED.items()}
ORACLE_SQL = {name: _WITH + oracle for name, (_, oracle) in DEFINED.items() if oracle is not None}
