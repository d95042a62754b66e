"""Scans, projections, filters and predicates: each as Spark SQL and, where it differs, its twin."""

from __future__ import annotations

_NATIONS = "SELECT n_nationkey, n_name, n_regionkey FROM nation"

QUERIES: dict[str, tuple[str, str | None]] = {
    "scan_full": (_NATIONS, None),
    "scan_point": ("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7", None),
    "scan_range": ("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey BETWEEN 100 AND 200", None),
    "scan_index": ("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 5 AND c_acctbal > 0", None),
    "scan_index_composite": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 33 AND l_linenumber >= 2", None),
    "scan_index_merge": ("SELECT p_partkey, p_name FROM part WHERE p_size = 11 AND p_brand = 'Brand#2'", None),
    "scan_hash_index": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'", None),
    "scan_partial_index": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey < 50", None),
    "scan_expr_index": ("SELECT p_partkey, upper(p_name) AS u FROM part WHERE upper(p_name) LIKE '%E%' AND p_partkey * 2 < 400", None),
    "scan_gin": (
        "SELECT p_partkey, p_name FROM part WHERE array_contains(split(p_name, ' '), (SELECT min(split(p_name, ' ')[0]) FROM part))",
        "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), (SELECT min(string_split(p_name, ' ')[1]) FROM part))",
    ),
    "scan_columnar": (
        "SELECT count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM events WHERE event_id >= 500 AND event_type = 'click'", None
    ),
    "scan_fromless": ("SELECT 1 + 1 AS two, 'x' AS x, CAST(NULL AS INT) AS nothing", None),
    "scan_derived": ("SELECT d.k, d.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) d WHERE d.n > 10", None),
    "scan_cte": (
        "WITH a(k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey), b AS (SELECT k, n FROM a WHERE n >= 10) "
        "SELECT b.k, b.n, c_name FROM b JOIN customer ON c_custkey = b.k", None
    ),
    "proj_star": ("SELECT * FROM region", None),
    "proj_cols": ("SELECT n.n_name, n.n_regionkey FROM nation n", None),
    "proj_expr": (
        "SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey div 7 AS d, l_orderkey % 7 AS m FROM lineitem",
        "SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey // 7 AS d, l_orderkey % 7 AS m FROM lineitem",
    ),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "filter_cmp": ("SELECT p_partkey FROM part WHERE p_size > 20 AND p_size <= 40 AND p_size <> 30 AND NOT p_brand = 'Brand#11'", None),
    "filter_bool": ("SELECT p_partkey, p_size FROM part WHERE p_size > 20 AND (p_name LIKE '%a%' OR NOT p_type LIKE 'S%')", None),
    "filter_between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20", None),
    "filter_isnull": (
        "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL", None
    ),
    "filter_like": ("SELECT n_name FROM nation WHERE n_name LIKE 'NATION%1_'", None),
    "filter_notlike": ("SELECT n_name FROM nation WHERE n_name NOT LIKE '%1%'", None),
    "filter_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", None),
    "filter_notin": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", None),
    "filter_exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)", None),
    "filter_notexists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", None),
    "filter_scalar_subq": ("SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)", None),
    "filter_correlated": (
        "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)", None
    ),
    "filter_expr": ("SELECT p_partkey FROM part WHERE abs(p_size - 25) * 2 < 10", None),
    "filter_any": (
        "SELECT p_partkey FROM part WHERE exists(array(5, 10, 15), e -> p_size = e)",
        "SELECT p_partkey FROM part WHERE p_size = ANY([5, 10, 15])",
    ),
    "filter_all": (
        "SELECT p_partkey, forall(CAST(array() AS ARRAY<INT>), e -> p_size > e) AS of_none FROM part WHERE forall(array(5, 10, 15), e -> p_size > e)",
        "SELECT p_partkey, TRUE AS of_none FROM part WHERE p_size > 5 AND p_size > 10 AND p_size > 15",
    ),
    "filter_func_bool": ("SELECT n_name FROM nation WHERE CAST(length(n_name) % 2 AS BOOLEAN)", None),
    "src_kv": ("SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 20", None),
}
