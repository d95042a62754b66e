"""Aggregates. Integer averages truncate toward zero; ordered collections keep NULLs and the order of the key."""

from __future__ import annotations

_SETS = "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY "
_SMALL = "(SELECT o_orderkey AS id, o_custkey % 1000 AS g, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 2 END AS flag, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS bits, o_orderpriority AS word FROM orders) AS t"

QUERIES: dict[str, tuple[str, str | None]] = {
    "agg_count_star": ("SELECT count(*) AS n FROM lineitem", None),
    "agg_count": ("SELECT count(o_orderkey) AS n, count(*) AS every FROM customer LEFT JOIN orders ON c_custkey = o_custkey", None),
    "agg_sum": (
        "SELECT l_returnflag, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, sum(l_linenumber) AS lines FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_min": ("SELECT n_regionkey, min(n_name) AS low FROM nation GROUP BY n_regionkey", None),
    "agg_max": ("SELECT n_regionkey, max(n_name) AS high, max(n_nationkey) AS k FROM nation GROUP BY n_regionkey", None),
    "agg_avg": (
        "SELECT l_returnflag, sum(l_partkey) div count(l_partkey) AS mean FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, CAST(sum(l_partkey) // count(l_partkey) AS BIGINT) AS mean FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_distinct": (
        "SELECT l_returnflag, count(DISTINCT l_linenumber) AS n, sum(DISTINCT l_linenumber) AS s, sum(DISTINCT l_linenumber) div count(DISTINCT l_linenumber) AS m FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, count(DISTINCT l_linenumber) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, CAST(sum(DISTINCT l_linenumber) // count(DISTINCT l_linenumber) AS BIGINT) AS m FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_filter": ("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open_n, max(l_linenumber) FILTER (WHERE l_quantity > 30) AS top FROM lineitem GROUP BY l_returnflag", None),
    "agg_array": (
        f"SELECT g, transform(array_sort(collect_list(struct(id, flag))), e -> e.flag) AS flags FROM {_SMALL} GROUP BY g",
        f"SELECT g, list(flag ORDER BY id) AS flags FROM {_SMALL} GROUP BY g",
    ),
    "agg_json": (
        "SELECT g, to_json(transform(array_sort(collect_list(struct(id, bits))), e -> e.bits), map('ignoreNullFields', 'false')) AS j, "
        f"to_json(transform(array_sort(collect_list(struct(id, word || chr(34) || chr(92) AS w))), e -> e.w), map('ignoreNullFields', 'false')) AS words FROM {_SMALL} GROUP BY g",
        f"SELECT g, CAST(to_json(list(bits ORDER BY id)) AS VARCHAR) AS j, CAST(to_json(list(word || chr(34) || chr(92) ORDER BY id)) AS VARCHAR) AS words FROM {_SMALL} GROUP BY g",
    ),
    "agg_string": (
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    ),
    "agg_bool_and": (
        f"SELECT g, CAST(bool_and(flag <> 0) AS BIGINT) AS b FROM {_SMALL} GROUP BY g", None
    ),
    "agg_bool_or": (f"SELECT g, CAST(bool_or(flag <> 0) AS BIGINT) AS b FROM {_SMALL} GROUP BY g", None),
    "agg_bit_and": (f"SELECT g, bit_and(bits) AS b FROM {_SMALL} GROUP BY g", None),
    "agg_bit_or": (f"SELECT g, bit_or(bits) AS b FROM {_SMALL} GROUP BY g", None),
    "agg_group": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "agg_having": ("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50 AND max(l_linenumber) >= 5", None),
    "agg_grouping_sets": (_SETS + "GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", None),
    "agg_rollup": (_SETS + "ROLLUP (l_returnflag, l_linestatus)", None),
    "agg_cube": (_SETS + "CUBE (l_returnflag, l_linestatus)", None),
    "agg_joined": (
        "SELECT n_name, count(*) AS n, max(o_orderkey) AS top, count(DISTINCT o_orderstatus) AS kinds FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", None
    ),
    "agg_global_distinct": ("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem", None),
    "agg_partial_merge": (
        "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(event_id) AS low, max(event_id) AS high FROM events GROUP BY event_type", None
    ),
    "agg_fused": (
        "SELECT min(l_linenumber) AS low, max(l_linenumber) AS high, sum(l_linenumber) AS s, count(l_linenumber) AS n FROM lineitem",
        "SELECT min(l_linenumber) AS low, max(l_linenumber) AS high, CAST(sum(l_linenumber) AS BIGINT) AS s, count(l_linenumber) AS n FROM lineitem",
    ),
    "bench_scan_agg": (
        "SELECT count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS s, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem",
        "SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem",
    ),
    "bench_groupby_cat": (
        "SELECT l_linenumber, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS s FROM lineitem GROUP BY l_linenumber",
        "SELECT l_linenumber, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY l_linenumber",
    ),
    "bench_groupby_region": (
        "SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS s FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag",
    ),
    "bench_filtered_agg": (
        "SELECT count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS s FROM lineitem WHERE l_quantity > 40",
        "SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem WHERE l_quantity > 40",
    ),
    "bench_zone_skip": (
        "SELECT count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM events WHERE ts >= (SELECT CAST(date_trunc('DAY', max(ts)) AS TIMESTAMP_NTZ) FROM events)",
        "SELECT count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM events WHERE ts >= (SELECT CAST(date_trunc('day', max(ts)) AS TIMESTAMP) FROM events)",
    ),
}
