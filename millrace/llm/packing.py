"""Bounded-space online packing of tokenised documents into sequences.

Each partition keeps at most OPEN open windows. A document's full windows leave
at once; its rest goes to the open window with the least space that still
holds it. When none does, a new window is opened while there are fewer than OPEN;
else the fullest is topped up with a cut of the document (unless the gap is below LEAST_CUT)
and leaves. What is open at the end of a partition is merged: the leftovers of MERGED
neighbouring partitions are laid end to end and cut at the sequence length. So no
task holds more than OPEN windows, or plans more than OPEN * MERGED leftovers.

Defined results: a null or empty text is its end mark alone; a null doc_id is
packed like any other; repeated rows are packed once each; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import give_back, map_arrow, slices, table, written
from .kept import Kept, segments, slice_ids

LENGTH = 4096
OPEN = 32
LEAST_CUT = 16
MERGED = 64
#: Words, and as many pieces between white space, kept in each worker.
WORDS = 600_000

#: Bytes of text tokenised at a time: the more, the fewer lookups of words that repeat.
SLICE = 8 << 20

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("leftover", T.BooleanType()),
])


class WordTokenizer:
    """A tokenizers file of the kind that lower-cases, cuts at a pattern and drops white space, with results kept.

    The pattern never crosses white space, so a text is the sum of its pieces between white space, and a
    piece the sum of its words; both repeat. Only texts up to Latin-1 without special tokens' strings go by pieces; all others go
    whole to the library.
    """

    _loaded: dict[str, WordTokenizer] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        # The vocabulary's own pattern, for Latin-1 without its superscripts and fractions.
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
        self.odd = re.compile("[^\x09-\x0d\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]")
        self.space = re.compile(r"[\x09-\x0d\x20]")
        self.words = Kept(WORDS, self._encode_words)
        self.pieces = Kept(WORDS, self._encode_pieces)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = list(map(self.cut.findall, pieces))
        counts = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        ids, ends = self.words.joined(list(chain.from_iterable(cut)), counts)
        return ids, np.diff(ends, prepend=0)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words at a time as one text: white space separates them, and a word's last token is one that ends words."""
        parts = [words[at : at + 500] for at in range(0, len(words), 500)]
        ids, sizes = [], []
        for at in range(0, len(parts), 40):
            some = parts[at : at + 40]
            for part, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(p) for p in some], add_special_tokens=False)):
                found = np.array(e.ids, dtype="<u4")
                ends = np.flatnonzero(self.last[found]) + 1
                if len(ends) == len(part):
                    ids.append(found)
                    sizes.append(np.diff(ends, prepend=0))
                else:
                    each = [x.ids for x in self.tokenizer.encode_batch(part, add_special_tokens=False)]
                    ids.append(np.fromiter(chain.from_iterable(each), dtype="<u4"))
                    sizes.append(np.fromiter(map(len, each), dtype=np.int64, count=len(each)))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plain = [not self.odd.search(t) and not any(s in t for s in self.special) for t in texts]
        parts = [segments(t, SLICE, self.space) if p else [""] for t, p in zip(texts, plain)]
        if all(len(p) == 1 for p in parts):
            lower = pc.utf8_lower(pa.array([p[0] for p in parts], pa.string()))
            out = slice_ids(*self.pieces.lists(pc.utf8_split_whitespace(lower)))
        else:
            one = lambda t: self.pieces.lists(pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t], pa.string()))))[0].tobytes()
            out = [b"".join(map(one, p)) for p in parts]
        for i, p in enumerate(plain):
            if not p:
                out[i] = array("I", self.tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return out


class Packer:
    """The open windows of one partition. A window is [fill, pieces]; a piece is (doc_id, start, ids, doc_tokens).

    Open windows are kept sorted by fill: best fit and the fullest are found by bisection and at the end.
    """

    def __init__(self, length: int = LENGTH, open_windows: int = OPEN, least_cut: int = LEAST_CUT):
        self.length, self.most, self.least = length, open_windows, least_cut
        self.open: list[list] = []
        self.done: list[list] = []

    def _put(self, window: list, doc_id, start: int, end: int, ids: bytes, n: int) -> None:
        """Into a window that is not among the open ones; it joins them unless it is full."""
        window[1].append((doc_id, start, ids[4 * start : 4 * end], n))
        window[0] += end - start
        if window[0] == self.length:
            self.done.append(window)
        else:
            insort(self.open, window, key=_fill)

    def add(self, doc_id, ids: bytes, end: bytes = b"") -> None:
        """A document; `end`, if given, is the id laid behind its last one."""
        n, at = (len(ids) + len(end)) // 4, 0
        while n - at >= self.length:
            if n - at == self.length:
                ids, end = ids + end, b""
            self._put([0, []], doc_id, at, at + self.length, ids, n)
            at += self.length
        ids += end
        while at < n:
            best = bisect_right(self.open, self.length - (n - at), key=_fill) - 1
            if best >= 0:
                self._put(self.open.pop(best), doc_id, at, n, ids, n)
                return
            if len(self.open) < self.most:
                self._put([0, []], doc_id, at, n, ids, n)
                return
            fullest = self.open.pop()
            gap = self.length - fullest[0]
            if gap >= self.least:
                self._put(fullest, doc_id, at, at + gap, ids, n)
                at += gap
            else:
                self.done.append(fullest)


def _fill(window: list) -> int:
    return window[0]


def pack(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, open_windows: int = OPEN, least_cut: int = LEAST_CUT) -> DataFrame:
    """Pieces: doc_id, start, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    sequence_id is the partition's number times 2^32 plus a running number; merged leftovers count from 2^62.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [f.name for f in PIECES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer, number = WordTokenizer.of(path), Packer(length, open_windows, least_cut), TaskContext.get().partitionId() << 32
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("leftover", pa.bool_())])

        def emit(windows: list[list], leftover: bool) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for _, pieces in windows:
                offset = 0
                for doc_id, start, ids, n in pieces:
                    rows.append((doc_id, start, ids, n, number, offset, leftover))
                    offset += len(ids) // 4
                number += 1
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for part in slices(batch, 1, SLICE):
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.encode_batch([t or "" for t in part.column(1).to_pylist()])):
                    packer.add(doc_id, ids, end)
                if packer.done:
                    yield emit(packer.done, False)
                    packer.done = []
                give_back()
        yield emit(packer.open, True)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = written(map_arrow(texts, run, PIECES.simpleString()[7:-1].replace(":", " ")), "pieces", "zstd")
    left = pieces.filter("leftover").withColumn("n", (F.octet_length("ids") / 4).cast("long"))
    fills = left.groupBy("sequence_id").agg(F.sum("n").alias("fill")).withColumn("area", F.shiftright("sequence_id", 32) / F.lit(MERGED))
    fills = fills.withColumn("area", F.floor("area"))
    before = Window.partitionBy("area").orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, -1)
    bases = fills.select("sequence_id", "area", F.coalesce(F.sum("fill").over(before), F.lit(0)).alias("base"))
    laid = left.join(bases, "sequence_id").withColumn("at", F.col("base") + F.col("offset"))
    cut = laid.withColumn("k", F.explode(F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + n - 1) div {length}"))))
    low, high = F.greatest("at", F.col("k") * length), F.least(F.col("at") + F.col("n"), (F.col("k") + 1) * length)
    merged = cut.withColumns({"low": low, "size": high - low}).select(
        "doc_id",
        (F.col("start") + F.col("low") - F.col("at")).alias("start"),
        F.substring("ids", ((F.col("low") - F.col("at")) * 4 + 1).cast("int"), (F.col("size") * 4).cast("int")).alias("ids"),
        "doc_tokens",
        (F.lit(1 << 62) + F.col("area") * F.lit(1 << 32) + F.col("k")).alias("sequence_id"),
        (F.col("low") - F.col("k") * length).alias("offset"),
    )
    return pieces.filter("NOT leftover").drop("leftover").unionByName(merged)


def op10_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return piece_digests(pack(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json")))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
