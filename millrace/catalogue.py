"""Every query of the relational engine, by name, with its SQL twin."""

from __future__ import annotations

from .functions import scalars
from .operators import aggregates, filters, joins, recursive, search, sessions, sorts, stored, windows
from .plans.registry import registered
from .plans.star import ORACLE_STAR, join_star_shuffle

QUERIES = {
    "join_star_shuffle": join_star_shuffle,
    "scan_cte_recursive": recursive.scan_cte_recursive,
    "scan_cte_recursive_union": recursive.scan_cte_recursive_union,
}
ORACLES = {
    "join_star_shuffle": ORACLE_STAR,
    "scan_cte_recursive": recursive.ORACLE_RECURSIVE,
    "scan_cte_recursive_union": recursive.ORACLE_RECURSIVE_UNION,
}
for _part in (filters, joins, aggregates, windows, sorts, scalars):
    _queries, _oracles = registered(_part.QUERIES)
    QUERIES |= _queries
    ORACLES |= _oracles
for _part in (search, stored, sessions):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
