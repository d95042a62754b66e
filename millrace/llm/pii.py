"""Personal data by weak supervision, on built-in functions only.

Patterns propose spans. Labelers vote on each (1 for, -1 against, 0 abstains): its format,
a gazetteer of its kind, the words before it, what it touches. Expectation-maximisation
over the counts of vote patterns, which are few whatever the input, estimates how
reliable each labeler is and how likely each span is personal data. These posteriors train the final span classifier,
a logistic model of the span itself and of its context: kind, length, separators, letters and digits, the characters beside it, the
word before it, and the votes. So it carries what the labelers agree on to features that none of them looks at. It is fitted over counts
of feature patterns, the MOST most frequent of them. Its score is an expression on the spans' own columns and is returned with them.
Spans of the base kinds always stay; further kinds stay where the classifier scores one half or more.

Defined results: a null text counts as empty and has no spans; a null doc_id is
carried along; repeated rows repeat; an empty table gives an empty result (with no
spans at all the classifier is its starting point).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table, written
from .spans import chunks, cut, joined, larger, let, matches, running

#: Kinds, their patterns (possessive, and anchored at run starts, so that no text takes more than linear time) and a test that says if there is any.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "local": r"(?<![0-9A-Za-z+)(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])",
    "mac": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:])",
}
BASE = ("email", "ip", "card", "phone")
#: Domain endings, card issuers' first digits, country calling codes, IBAN countries.
DOMAINS = "com org net edu gov io co info biz de fr es en uk us it nl be ch at pt pl ru cn jp br in ca au se no dk fi example"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65|62|35)"
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1238]|35\d|37\d|38\d|42[013]|85[2356]|88[06]|96\d|97\d|99\d)"
IBAN = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR"
CUES = r"(?:mail|contact|write|phone|call|tel|fax|mobile|card|visa|credit|pay|address|host|server|ssn|social|security|iban|account|bank|login|user|name|reach|mac|device|correo|telefon|téléphone|adresse|konto|compte|cuenta|tarjeta|carte|karte)"
AGAINST = r"(?:version|release|isbn|issn|order|invoice|serial|part|section|chapter|figure|table|page|build|sku|doi|ratio)"
WINDOW = 32
LABELERS = ("format", "gazetteer", "context", "border")
LENGTHS = (10, 15, 20)
ROUNDS = 30
#: Feature patterns (with their counts) that the classifier is fitted on at most.
MOST = 20_000
#: Buckets of the word before a span.
BUCKETS = 16
#: Features of a span and its context, and their values.
FEATURES = {"size": range(len(LENGTHS) + 1), "separator": range(5), "shape": range(8), "left": range(5), "right": range(5), "word": range(-1, BUCKETS)}


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 13 to 19 digits fulfils the Luhn check."""
    back = F.reverse(number)
    at = F.sequence(F.lit(1), F.length(number))

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(at, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    """What a match must fulfil beyond its pattern."""
    n = F.length(digits(found))
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
        return F.rlike(found, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(found))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _votes(kind: str, found: Column, before: Column, after: Column) -> list[Column]:
    like = lambda c, p: F.rlike(c, F.lit(p))
    never = F.lit(False)
    format_ = {
        "email": _vote(like(found, r"\.[A-Za-z]{2,24}$"), like(found, r"^\.|\.\.|\.@|@-|-\.")),
        "ip": _vote(like(found, r"^[1-9]"), like(found, r"(?:^|\.)0[0-9]")),
        "card": _vote(like(found, r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$"), like(found, r"[ -].*(?<![ -])[0-9]{7}")),
        "phone": _vote(like(found, r"^\+[0-9]{1,3}[ .-]?\(?[0-9]"), like(found, r"[ .-]{2}|\)\)|\(\(")),
        "ssn": _vote(like(found, r"^[0-8]"), like(found, r"^(?:000|666|9)|-00-|-0000$")),
        "iban": _vote(F.length(F.regexp_replace(found, " ", "")).between(15, 34), never),
        "local": _vote(like(found, r"^\(?[2-9]"), like(found, r"^\(?[01]")),
        "mac": _vote(like(found, r"^[0-9A-F:]+$|^[0-9a-f:]+$"), never),
    }[kind]
    gazetteer = {
        "email": _vote(like(found, rf"(?i)\.(?:{DOMAINS.replace(' ', '|')})$"), never),
        "ip": _vote(~like(found, r"^(?:0|127|255)\."), like(found, r"^(?:0|255)\.")),
        "card": _vote(like(digits(found), ISSUERS), ~like(digits(found), ISSUERS)),
        "phone": _vote(like(digits(found), CALLING), ~like(digits(found), CALLING)),
        "ssn": F.lit(0),
        "iban": _vote(like(found, rf"^(?:{IBAN.replace(' ', '|')})"), ~like(found, rf"^(?:{IBAN.replace(' ', '|')})")),
        "local": _vote(~like(digits(found), "^[0-9]11|^.{3}[01]"), like(digits(found), "^[0-9]11|^.{3}[01]")),
        "mac": _vote(~like(found, r"^(?:00:){5}|^(?:ff:){5}|^(?:FF:){5}"), like(found, r"^(?:00:){5}|^(?:ff:){5}|^(?:FF:){5}")),
    }[kind]
    context = _vote(like(before, rf"(?i)(?<![a-z]){CUES}"), like(before, rf"(?i)(?<![a-z]){AGAINST}"))
    border = _vote(~like(before, r"[\w@]$") & ~like(after, r"^[\w@]"), like(before, r"\w$") & like(after, r"^\w"))
    return [format_, gazetteer, context, border]


SPANS = f"array<struct<order: int, start: int, end: int, kind: string, {', '.join(f'{c}: int' for c in (*FEATURES, *LABELERS))}>>"


def _beside(c: Column) -> Column:
    """The class of a neighbouring character: none, white space, bracket or quote or sign of equality, other mark, letter or digit."""
    kinds = [(c == "", 0), (F.rlike(c, F.lit(r"^\s")), 1), (F.rlike(c, F.lit(r"^[\w]")), 4), (F.rlike(c, F.lit(r"""^[()\[\]{}<>"':=]""")), 2)]
    out = F.lit(3)
    for test, value in reversed(kinds):
        out = F.when(test, value).otherwise(out)
    return out


def _described(found: Column, before: Column, after: Column) -> list[Column]:
    """The values of FEATURES, in their order."""
    has = lambda c, p: F.rlike(c, F.lit(p)).cast("int")
    marks = F.regexp_replace(found, r"[A-Za-z0-9@+]", "")
    same = lambda c: F.rlike(marks, F.lit(f"^[{c}]+$"))
    word = F.lower(F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    return [
        sum(((F.length(found) >= n).cast("int") for n in LENGTHS), F.lit(0)),
        F.when(marks == "", 0).when(same(r"\x20"), 1).when(same("-"), 2).when(same("."), 3).otherwise(4),
        has(found, "[A-Z]") + 2 * has(found, "[a-z]") + 4 * has(found, "[0-9]"),
        _beside(F.substring(before, -1, 1)),
        _beside(after),
        F.when(word == "", -1).otherwise(F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")),
    ]


def _spans(text: Column, kind: str, order: int) -> Column:
    def described(s: Column) -> Column:
        after = F.coalesce(s["after"], F.lit(""))
        values = [v.cast("int").alias(n) for n, v in zip(FEATURES, _described(s["found"], s["before"], after))]
        votes = [v.cast("int").alias(n) for n, v in zip(LABELERS, _votes(kind, s["found"], s["before"], after))]
        return F.struct(F.lit(order).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), *values, *votes)

    return F.transform(F.filter(matches(text, PATTERNS[kind], WINDOW), lambda s: _holds(kind, s["found"])), described)


def candidates(docs: DataFrame, name: str = "_spans") -> DataFrame:
    """docs with a column `name` of all candidates, their features and votes, by kind, then start."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn(name, F.array_sort(F.concat(*[_spans(text, k, i) for i, k in enumerate(PATTERNS)]).cast(SPANS)))


_VALUES = {**FEATURES, **{name: range(-1, 2) for name in LABELERS}}


@dataclass
class SpanClassifier:
    """A logistic model: weights by (kind), (feature, value) and (labeler, vote); reliabilities as estimated."""

    weights: dict[tuple, float]
    reliability: dict[str, float]

    def score(self, s: Column) -> Column:
        total = F.lit(self.weights[("bias",)])
        total = total + self._of(s["kind"], {k: self.weights[("kind", k)] for k in PATTERNS})
        for name, values in _VALUES.items():
            total = total + self._of(s[name], {v: self.weights[(name, v)] for v in values})
        return 1 / (1 + F.exp(-total))

    @staticmethod
    def _of(column: Column, values: dict) -> Column:
        out = F.lit(0.0)
        for k, w in values.items():
            out = F.when(column == F.lit(k), F.lit(float(w))).otherwise(out)
        return out


def fit(rows: DataFrame, name: str = "_spans", rounds: int = ROUNDS, most: int = MOST) -> SpanClassifier:
    """From all candidates of `rows` (a column `name`): counts by pattern in Spark, the rest on at most a few thousand counts."""
    one = rows.select(F.explode(name).alias("s")).select("s.kind", *[F.col(f"s.{c}") for c in _VALUES])
    patterns = written(one.groupBy("kind", *_VALUES).agg(F.count(F.lit(1)).alias("n")), "span_patterns")
    by = ["kind", *LABELERS]
    counts = patterns.groupBy(*by).agg(F.sum("n").alias("n")).orderBy(*by).collect()
    n = np.array([r["n"] for r in counts], dtype=float)
    votes = np.array([[r[c] for c in LABELERS] for r in counts], dtype=int).reshape(-1, len(LABELERS)) + 1
    kinds = list(PATTERNS)
    kind = np.array([kinds.index(r["kind"]) for r in counts], dtype=int)
    # chance[j, y, v]: that labeler j votes v - 1 on a span whose truth is y. It starts a little better than guessing.
    chance = np.tile(np.array([[0.45, 0.35, 0.2], [0.1, 0.3, 0.6]]), (len(LABELERS), 1, 1))
    prior = np.full(len(kinds), 0.7)
    posterior = np.full(len(n), 0.7)
    for _ in range(rounds if len(n) else 0):
        log1 = np.log(prior[kind]) + sum(np.log(chance[j, 1, votes[:, j]]) for j in range(len(LABELERS)))
        log0 = np.log(1 - prior[kind]) + sum(np.log(chance[j, 0, votes[:, j]]) for j in range(len(LABELERS)))
        posterior = 1 / (1 + np.exp(np.clip(log0 - log1, -50, 50)))
        for k in range(len(kinds)):
            at = kind == k
            prior[k] = (7 + (n * posterior)[at].sum()) / (10 + n[at].sum())
        for j in range(len(LABELERS)):
            for y, weight in enumerate((n * (1 - posterior), n * posterior)):
                share = np.bincount(votes[:, j], weights=weight, minlength=3)
                start = np.array([[4.5, 3.5, 2.0], [1.0, 3.0, 6.0]])[y]
                chance[j, y] = (share + start) / (share.sum() + 10)
    likely = {tuple(r[c] for c in by): p for r, p in zip(counts, posterior)}
    seen = patterns.orderBy(F.desc("n"), "kind", *_VALUES).limit(most).collect()
    n = np.array([r["n"] for r in seen], dtype=float)
    posterior = np.array([likely[tuple(r[c] for c in by)] for r in seen])
    names = [("bias",), *(("kind", k) for k in kinds), *((c, v) for c, values in _VALUES.items() for v in values)]
    place = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(n), len(names)))
    for i, r in enumerate(seen):
        for f in [("bias",), ("kind", r["kind"]), *((c, r[c]) for c in _VALUES)]:
            x[i, place[f]] = 1
    w = np.zeros(len(names))
    w[0] = math.log(0.7 / 0.3)
    total = max(n.sum(), 1.0)
    for _ in range(25 if len(n) else 0):  # Newton steps; the ridge keeps them defined
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n / total * (posterior - p)) - 1e-4 * w
        curve = (x * (n / total * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(names))
        step = np.linalg.solve(curve, gradient)
        w = w + np.clip(step, -2, 2)
    reliability = {c: float(0.5 * (chance[j, 1, 2] / (chance[j, 1, 2] + chance[j, 1, 0]) + chance[j, 0, 0] / (chance[j, 0, 2] + chance[j, 0, 0]))) for j, c in enumerate(LABELERS)}
    return SpanClassifier({f: float(w[i]) for f, i in place.items()}, reliability)


def decided(spans: Column, model: SpanClassifier) -> Column:
    """The spans that stay, each with its score: the base kinds, and others that touch none of them and score one half or more."""
    base = lambda s: s["order"] < len(BASE)
    far = 1 << 40

    def apart(found: Column) -> Column:
        """`found` by start: a span of a further kind must begin after all base spans before it end, and end before the next one begins."""
        ends = running(F.transform(found, lambda s: F.when(base(s), s["end"]).otherwise(0)), larger)
        nexts = running(F.transform(F.reverse(found), lambda s: F.when(base(s), -s["start"].cast("long")).otherwise(-far)), larger, -far)
        clear = lambda s, i, e, b: (F.get(e, i) <= s["start"]) & (-F.get(b, F.size(found) - 1 - i) >= s["end"])
        kept = let(ends, lambda e: let(nexts, lambda b: F.filter(found, lambda s, i: base(s) | (clear(s, i, e, b) & (s["score"] >= 0.5)))))
        return kept

    scored = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), model.score(s).alias("score")))
    chosen = let(scored, lambda x: F.when(F.exists(x, lambda s: ~base(s)), let(F.array_sort(x), apart)).otherwise(x))
    # Back to the order of kinds, then starts.
    placed = lambda s: F.struct(s["order"].alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score"))
    return F.array_sort(F.transform(chosen, placed))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of docs; a span has order, start, end, kind and score."""
    rows = written(candidates(docs.select(F.col("doc_id").cast("long"), F.col("text"))).select("doc_id", "_spans"), "pii_spans")
    return rows.select("doc_id", decided(F.col("_spans"), fit(rows)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """text with each span, overlapping ones together, replaced by the first one's kind in angle brackets."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def whole(found: Column, ends: Column, parts: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0).cast("int")
        places = F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), before(i).alias("from")))
        firsts = F.filter(places, lambda s: s["start"] >= s["from"])
        pieces = F.transform(firsts, lambda s: F.concat(cut(parts, s["from"], s["start"] - s["from"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        last = F.get(ends, F.size(ends) - 1).cast("int")
        return F.concat(F.array_join(pieces, ""), cut(parts, last, F.length(text) - last))

    ends_of = lambda found: running(F.transform(found, lambda s: -s["back"]), larger)
    return let(order, lambda found: let(ends_of(found), lambda ends: let(chunks(text), lambda parts: whole(found, ends, parts))))


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data in `text` masked and `n_chars`, if there is one, counted anew. Null texts stay null."""
    names, spans = docs.columns, free(docs, "spans")
    rows = written(candidates(docs, spans), "pii_documents")
    model = fit(rows, spans)
    out = rows.withColumn(spans, decided(F.col(spans), model))
    hit = F.size(spans) > 0
    out = out.withColumn("text", F.when(hit, masked(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in names])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["order"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 3)), ",").alias("scores"),
    )
