"""Window functions. Every frame is written out; without one the whole partition counts. Ties end in the primary key."""

from __future__ import annotations

_O = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
_P = "OVER (PARTITION BY n_regionkey)"
_WHOLE = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _orders(what: str) -> str:
    return f"SELECT o_orderkey, {what} AS w FROM orders"


QUERIES: dict[str, tuple[str, str | None]] = {
    "win_row_number": (_orders(f"CAST(row_number() {_O} AS BIGINT)"), None),
    "win_rank": (_orders("CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT)"), None),
    "win_dense_rank": (_orders("CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT)"), None),
    "win_ntile": (_orders(f"CAST(ntile(4) {_O} AS BIGINT)"), None),
    "win_lag": (_orders(f"lag(o_orderkey) {_O}"), None),
    "win_lead": (_orders(f"lead(o_orderkey) {_O}"), None),
    "win_first_value": (_orders(f"first_value(o_orderkey) {_WHOLE}"), None),
    "win_last_value": (_orders(f"last_value(o_orderkey) {_WHOLE}"), None),
    "win_sum": (f"SELECT n_name, sum(n_nationkey) {_P} AS w FROM nation", f"SELECT n_name, CAST(sum(n_nationkey) {_P} AS BIGINT) AS w FROM nation"),
    "win_count": (f"SELECT n_name, count(n_nationkey) {_P} AS w FROM nation", None),
    "win_count_star": (f"SELECT n_name, count(*) {_P} AS w FROM nation", None),
    "win_min": (f"SELECT n_nationkey, min(n_name) {_P} AS w FROM nation", None),
    "win_max": (f"SELECT n_nationkey, max(n_name) {_P} AS w FROM nation", None),
    "win_avg": (
        f"SELECT n_name, sum(n_nationkey) {_P} div count(n_nationkey) {_P} AS w FROM nation",
        f"SELECT n_name, CAST(sum(n_nationkey) {_P} // count(n_nationkey) {_P} AS BIGINT) AS w FROM nation",
    ),
    "win_frame": (
        "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, "
        "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 3 PRECEDING) AS back FROM orders",
        "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near, "
        "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 3 PRECEDING) AS back FROM orders",
    ),
}
