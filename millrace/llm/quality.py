"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is described by its words and its runs of three bytes, hashed to
buckets, and by what its characters and words are like (never by label, language, source or id), encoded by a learned layer, and
weighted by a gated attention a = softmax(w . (tanh(V h) * sigmoid(U h))). The weighted sum of
encodings is scored by a logistic unit. All weights are learned together from document labels only.

Training takes at most MOST labelled rows, chosen by a hash of doc_id, from rows whose crc32(doc_id) mod 3 is
not 1; the fit runs on the driver over descriptions of at most FIT_PASSAGES passages of each, evenly over the text, so
its memory is bounded. Scoring reads every row's whole text.

Defined results: a null or blank text is one passage of no words and gets a score too; a null doc_id is not held out
and never trains; repeated rows repeat; of several labels of one doc_id the least counts; an empty table gives an empty result; without
labels of both kinds the score is the share of label 1 (one half if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, map_arrow, slices, table

PASSAGE = 100
#: Labelled rows used for training at most.
MOST = 4000
#: Passages of each of them at most.
FIT_PASSAGES = 16
#: Buckets of words and of runs of three bytes.
WORD_BUCKETS, GRAM_BUCKETS = 64, 64
ENCODED, ATTENTION = 16, 8
#: Bytes of text described at a time: arrays of eight bytes for each byte of text stand side by side.
SLICE = 1 << 20
EPOCHS = 150
RIDGE = 1e-3
SEED = 7

#: Classes of bytes, each a share of the passage: lower, upper, digit, full stop or comma, other marks one by one, space, line end, beyond ASCII, control.
_MARKS = b"!#$%&*|@/:;?-_=<>()[]{}\"'"
N_CLASSES = 9 + 12


def _byte_classes() -> np.ndarray:
    out = np.full(256, 8, dtype=np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 7
    out[[44, 46]], out[32], out[10] = 3, 5, 6
    for i, c in enumerate(_MARKS):
        out[c] = 9 + min(i, 11)
    rest = [c for c in range(33, 127) if out[c] == 8]
    out[rest] = 4
    return out


_CLASS = _byte_classes()
N_OTHER = N_CLASSES + 7
N_FEATURES = N_OTHER + WORD_BUCKETS + GRAM_BUCKETS
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
_POWERS = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64), dtype=np.uint64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) % buckets


def _shares(of: np.ndarray, bucket: np.ndarray, passages: int, buckets: int) -> np.ndarray:
    counts = np.bincount(of * buckets + bucket, minlength=passages * buckets).reshape(-1, buckets)
    return counts / np.maximum(counts.sum(axis=1), 1)[:, None]


def hashed(data: np.ndarray, of: np.ndarray, passages: int) -> np.ndarray:
    """Of bytes and the passage of each: shares of words (runs of bytes above the space) and of runs of three bytes, by bucket, letters in lower case."""
    low = _LOWER[data]
    inside = data > 32
    if len(data):
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (of[1:] != of[:-1])
        starts = np.flatnonzero(first)
    else:
        starts = np.zeros(0, dtype=np.int64)
    if len(starts):
        begin = np.concatenate([np.zeros(starts[0], dtype=np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))])
        offset = np.arange(len(data)) - begin
        hashes = np.add.reduceat(np.where(inside, (low + np.uint64(1)) * _POWERS[offset & 63], np.uint64(0)), starts)
        words = _shares(of[starts], _bucket(hashes, WORD_BUCKETS), passages, WORD_BUCKETS)
    else:
        words = np.zeros((passages, WORD_BUCKETS))
    if len(data) > 2:
        same = of[2:] == of[:-2]
        grams = (low[:-2] << np.uint64(16)) + (low[1:-1] << np.uint64(8)) + low[2:]
        grams = _shares(of[2:][same], _bucket(grams[same], GRAM_BUCKETS), passages, GRAM_BUCKETS)
    else:
        grams = np.zeros((passages, GRAM_BUCKETS))
    return np.sqrt(np.concatenate([words, grams], axis=1))


def describe(texts: list[str], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(passages x N_FEATURES, passages of each text): at least one passage for each text. most: only so many of a text, evenly spaced."""
    raw, sizes, counts, words_of = [], [], [], []
    for text in texts:
        words = text.encode("utf-8", "replace").split(b" ") if text else []
        n = max(1, -(-len(words) // PASSAGE))
        chosen = range(n) if most is None or n <= most else [i * (n - 1) // (most - 1) for i in range(most)]
        counts.append(len(chosen))
        for i in chosen:
            part = words[i * PASSAGE : (i + 1) * PASSAGE]
            whole = b" ".join(part)
            raw.append(whole)
            sizes.append(len(whole))
            tokens = whole.split()
            k = len(tokens)
            if k:
                distinct = len(set(tokens))
                again = sum(map(bytes.__eq__, tokens, tokens[1:]))
                lines = whole.split(b"\n")
                words_of.append((distinct / k, again / k, len(whole) / k / 10, max(map(len, tokens)) / 100, len(set(lines)) / len(lines), sum(t.isalpha() or t[:-1].isalpha() for t in tokens) / k, min(k, PASSAGE) / PASSAGE))
            else:
                words_of.append((0.0,) * 7)
    size = np.array(sizes, dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    of = np.repeat(np.arange(len(size)), size)
    shares = np.bincount(of * N_CLASSES + _CLASS[data], minlength=len(size) * N_CLASSES).reshape(-1, N_CLASSES) / np.maximum(size, 1)[:, None]
    return np.concatenate([np.sqrt(shares), np.array(words_of).reshape(-1, 7), hashed(data, of, len(size))], axis=1).astype(np.float32), np.array(counts, dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class BagModel:
    """Weights of the encoder, the gated attention and the score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts = np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(counts)), counts)
        f = (x - self.mean) / self.scale
        h = np.tanh(f @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        logit = (t * g) @ w["a"]
        top = np.maximum.reduceat(logit, starts)
        raw = np.exp(logit - top[of])
        share = raw / np.add.reduceat(raw, starts)[of]
        z = np.add.reduceat(share[:, None] * h, starts, axis=0)
        return {"f": f, "h": h, "t": t, "g": g, "share": share, "z": z, "p": _sigmoid(z @ w["c"] + w["b"]), "of": of, "starts": starts}

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        return self.forward(*describe(texts))["p"].astype(float)


def fit_bags(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> BagModel:
    """Adam on the mean log loss of the bags."""
    if len(y) == 0 or y.min() == y.max():
        return BagModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    shapes = {"E": (N_FEATURES, ENCODED), "e": (ENCODED,), "V": (ENCODED, ATTENTION), "U": (ENCODED, ATTENTION), "a": (ATTENTION,), "c": (ENCODED,), "b": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "eb" else np.zeros(s) for k, s in shapes.items()}
    x = x.astype(np.float32)
    w = {k: a.astype(np.float32) for k, a in w.items()}
    model = BagModel(x.mean(axis=0), x.std(axis=0) + np.float32(1e-3), w)
    m, v = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        r = model.forward(x, counts)
        of, h, t, g, share = r["of"], r["h"], r["t"], r["g"], r["share"]
        error = (r["p"] - y) / len(y)
        d = {"c": r["z"].T @ error, "b": np.array([error.sum()])}
        dz = error[:, None] * w["c"]
        along = (dz[of] * h).sum(axis=1)
        dlogit = share * (along - np.add.reduceat(share * along, r["starts"])[of])
        d["a"] = (t * g).T @ dlogit
        dt, dg = dlogit[:, None] * w["a"] * g * (1 - t**2), dlogit[:, None] * w["a"] * t * g * (1 - g)
        d["V"], d["U"] = h.T @ dt, h.T @ dg
        dh = share[:, None] * dz[of] + dt @ w["V"].T + dg @ w["U"].T
        de = dh * (1 - h**2)
        d["E"], d["e"] = r["f"].T @ de, de.sum(axis=0)
        for k in shapes:
            d[k] = d[k] + (RIDGE * w[k] if k not in "eb" else 0)
            m[k] = 0.9 * m[k] + 0.1 * d[k]
            v[k] = 0.999 * v[k] + 0.001 * d[k] ** 2
            w[k] -= 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, target: str = "quality") -> BagModel:
    """Learns from at most `most` labelled rows that are not held out."""
    named = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = named.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(target).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                x, counts = describe([t or "" for t in part.column(2).to_pylist()], FIT_PASSAGES)
                bags = [b.tobytes() for b in np.split(x, np.cumsum(counts)[:-1])]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(bags, pa.binary())], names=["doc_id", "y", "bag"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    # A doc_id that many rows repeat still trains once, so what comes to the driver is bounded.
    bags = map_arrow(texts.select("doc_id", "y", "text"), run, "doc_id long, y double, bag binary")
    rows = sorted(bags.groupBy("doc_id").agg(F.min(F.struct("y", "bag")).alias("r")).collect(), key=lambda r: r["doc_id"])
    x = [np.frombuffer(r["r"]["bag"], dtype=np.float32).reshape(-1, N_FEATURES) for r in rows]
    whole = np.concatenate(x) if x else np.zeros((0, N_FEATURES), dtype=np.float32)
    return fit_bags(whole, np.array([len(b) for b in x], dtype=np.int64), np.array([r["r"]["y"] for r in rows]))


def scored(docs: DataFrame, model: BagModel, name: str = "_score") -> DataFrame:
    """docs with a column `name`, which docs must not have, of the score of every row."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for part in slices(batch, at, SLICE):
                p = model.score([t or "" for t in part.column(at).to_pylist()])
                yield pa.record_batch([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, run, f"{schema}, `{name}` double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that score `least` or more."""
    score = free(docs, "score")
    return scored(docs, train(docs, labels), score).filter(F.col(score) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    thin = scored(docs, model).select("doc_id", F.col("_score").alias("score"))
    return thin.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
