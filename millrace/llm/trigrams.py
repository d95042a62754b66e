"""Boolean trigram queries of regular expressions, and an inverted index of trigrams.

A query is TRUE (nothing is mandatory) or a set of alternatives, each a set of trigrams that must all occur.
"""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

TRUE = frozenset([frozenset()])
#: Strings followed at most while a query is derived; beyond that a part's trigrams are taken and a new part begins.
STRINGS = 64
#: Rows for each block of postings, about.
BLOCK = 8192


def _least(query: frozenset) -> frozenset:
    """Without alternatives that ask more than another one."""
    return frozenset(a for a in query if not any(b < a for b in query))


def both(a: frozenset, b: frozenset) -> frozenset:
    return _least(frozenset(x | y for x in a for y in b))


def either(a: frozenset, b: frozenset) -> frozenset:
    return _least(a | b)


def _of_strings(strings: frozenset[str]) -> frozenset:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _derive(parts) -> tuple[frozenset[str] | None, frozenset]:
    """(all strings a sequence can match, if few; else None; the query of what else is mandatory)."""
    now, query, whole = frozenset([""]), TRUE, True
    for op, arg in parts:
        strings, own = _part(op, arg)
        if strings is None or len(now) * len(strings) > STRINGS:
            query, whole = both(query, _of_strings(now)), False
            now = strings or frozenset([""])
        else:
            now = frozenset(a + b for a, b in product(now, strings))
        query = both(query, own)
    return (now, query) if whole else (None, both(query, _of_strings(now)))


def _part(op, arg) -> tuple[frozenset[str] | None, frozenset]:
    if op is C.LITERAL:
        return frozenset([chr(arg).lower()]), TRUE
    if op is C.IN:
        chars = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                chars.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, TRUE
        return (frozenset(chars), TRUE) if len(chars) <= 8 else (None, TRUE)
    if op is C.SUBPATTERN:
        return _derive(arg[-1])
    if op is C.ATOMIC_GROUP:
        return _derive(arg)
    if op is C.BRANCH:
        found = [_derive(x) for x in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= STRINGS and all(q == TRUE for _, q in found):
            return frozenset().union(*(s for s, _ in found)), TRUE
        query = None
        for s, q in found:
            q = both(q, _of_strings(s)) if s is not None else q
            query = q if query is None else either(query, q)
        return None, query
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = arg
        strings, query = _derive(body)
        if low == 0:
            return (strings | {""}, TRUE) if high == 1 and strings is not None and query == TRUE else (None, TRUE)
        if low == high and strings is not None and len(strings) ** low <= STRINGS:
            return frozenset("".join(x) for x in product(strings, repeat=low)), query
        return None, both(query, _of_strings(strings)) if strings is not None else query
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return frozenset([""]), TRUE
    return None, TRUE


def query_of(pattern: str) -> frozenset:
    """What every match of a pattern contains, in lower case."""
    strings, query = _derive(P.parse(pattern))
    return both(query, _of_strings(strings)) if strings is not None else query


def build_index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(block, trigram, postings): sorted doc_ids of the rows whose text has a trigram, in blocks of about BLOCK rows.

    Only the trigrams that some rule asks for are indexed. Rows without a doc_id are not in it.
    """
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    # Through a lambda's argument the text is lower-cased once for all trigrams.
    hits = F.transform(F.array(low), lambda x: F.array_compact(F.array(*[F.when(F.contains(x, F.lit(t)), F.lit(t)) for t in wanted])))
    named = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.element_at(hits, 1).alias("trigrams"))
    rows = written(named, "postings")
    blocks = max(1, rows.count() // BLOCK)
    one = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), F.explode("trigrams").alias("trigram"), "doc_id")
    return one.groupBy("block", "trigram").agg(F.array_sort(F.collect_set("doc_id")).alias("postings"))


def _evaluated(query: frozenset, postings: Column) -> Column:
    none = F.array().cast("array<bigint>")
    out = None
    for alternative in sorted(query, key=sorted):
        ids = None
        for t in sorted(alternative):
            of = F.coalesce(F.try_element_at(postings, F.lit(t)), none)
            ids = of if ids is None else F.array_intersect(ids, of)
        out = ids if out is None else F.array_union(out, ids)
    return none if out is None else out


def candidates(index: DataFrame, queries: dict[str, frozenset]) -> DataFrame:
    """(doc_id, rules): the rules whose query a row fulfils, by intersecting and uniting postings block by block."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("postings"))
    found = [F.struct(F.lit(name).alias("rule"), _evaluated(q, F.col("postings")).alias("ids")) for name, q in queries.items()]
    each = blocks.select(F.explode(F.array(*found)).alias("x")).select("x.rule", F.explode("x.ids").alias("doc_id"))
    return each.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))
