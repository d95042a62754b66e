"""Byte-pair encoding by speculation and verification, and decoding.

A text is cut at special tokens and into words. For a word not met before,
greedy longest match proposes tokens. The proposal is right exactly if every
token is what merging makes of its own bytes and no merge would cross the border of
two adjacent tokens: up to its first crossing merge a word evolves as its
tokens do apart, and whether one crosses depends on two neighbours only. All
adjacent pairs of a batch are tested at once, on arrays. Words that fail
are merged exactly, in rank order. Words repeat, so results are kept by word, up to a bound.

Defined results: a null text counts as empty and has no tokens; white space, control characters
and special tokens' strings are encoded as the vocabulary's own library does; repeated rows repeat.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table
from .kept import Kept, slice_ids

#: Words, and as many pieces between spaces, kept in each worker.
WORDS = 500_000
#: Bytes of text encoded at a time.
SLICE = 8 << 20
#: Pairs of tokens kept.
PAIRS = 1_000_000


def byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else the next free one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """A byte-level vocabulary file, with what verification needs as arrays."""

    _loaded: dict[str, Codec] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        names = byte_names()
        model = data["model"]
        if model.get("ignore_merges") or model.get("end_of_word_suffix") or data.get("normalizer"):
            raise ValueError("not a plain byte-level vocabulary")
        self.path = path
        spelt = {w: bytes(names[c] for c in w) for w in model["vocab"]}
        self.id_of = {spelt[w]: i for w, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.longest: dict[bytes, int] = {}  # by first three bytes
        for b in self.id_of:
            if len(b) > 2:
                self.longest[b[:3]] = max(len(b), self.longest.get(b[:3], 0))
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.rank = np.full(size, -1)
        self.made: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.made[x, y] = r, z
            self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([x * size + y for x, y in self.made], dtype=np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.ranks = size, keys[order], np.array([r for r, _ in self.made.values()])[order]
        self.right_edge = self._edge(self.right)
        self.left_edge = self._edge(self.left)
        ids = np.flatnonzero(self.rank >= 0)
        whole = ~self._crossed(self.left[ids], self.right[ids], self.rank[ids])
        self.sound = np.ones(size, dtype=bool)
        self.sound[ids] = whole
        for z in ids[np.argsort(self.rank[ids])]:
            self.sound[z] &= self.sound[self.left[z]] and self.sound[self.right[z]]
        self.pairs: dict[int, bool] = {}
        self.words = Kept(WORDS, self._encode_words)
        self.pieces = Kept(WORDS, self._encode_pieces)
        # The vocabulary's own pattern, for Latin-1 without its superscripts and fractions.
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self.odd = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]")
        self.crowded = re.compile(r"\s\s|\A\s|\s\Z")
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _edge(self, child: np.ndarray) -> np.ndarray:
        """For each token the pieces that lie at one edge of it while it is merged, from the whole inwards; -1 beyond."""
        out = [np.arange(self.size)]
        while (out[-1] >= 0).any():
            out.append(np.where(out[-1] >= 0, child[out[-1]], -1))
        return np.stack(out[:-1], axis=1)

    def _crossed(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge joins a piece of a's right edge with one of b's left edge while both stand.

        own: ranks of the merges of a with b themselves, which do not count.
        """
        never = np.iinfo(np.int64).max
        crossed = np.zeros(len(a), dtype=bool)
        x_end = np.full(len(a), never)
        for i in range(self.right_edge.shape[1]):
            x = self.right_edge[a, i]
            y_end = np.full(len(a), never)
            if not (x >= 0).any():
                break
            for j in range(self.left_edge.shape[1]):
                y = self.left_edge[b, j]
                there = (x >= 0) & (y >= 0)
                if not there.any():
                    break
                key = x * self.size + y
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(there & (self.keys[at] == key), self.ranks[at], never)
                hit = (rank < x_end) & (rank <= y_end) & (rank < never)
                if own is not None and i == j == 0:
                    hit &= rank != own
                crossed |= hit
                y_end = np.where(y >= 0, self.rank[y], y_end)
            x_end = np.where(x >= 0, self.rank[x], x_end)
        return crossed

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, get, longest = [], 0, len(word), self.id_of.get, self.longest.get
        while at < n:
            end = min(n, at + longest(word[at : at + 3], 2))
            while (found := get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, of equal ranks the leftmost."""
        if len(word) <= 24:
            piece = [self.id_of[word[i : i + 1]] for i in range(len(word))]
            get, none = self.made.get, (1 << 40, 0)
            found = [get(p, none) for p in zip(piece, piece[1:])]
            while found:
                best = min(found)
                if best is none or best[0] == none[0]:
                    break
                i = found.index(best)
                piece[i : i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = get((piece[i - 1], piece[i]), none)
                if i < len(found):
                    found[i] = get((piece[i], piece[i + 1]), none)
            return piece
        piece = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        after = list(range(1, len(piece) + 1))
        before = list(range(-1, len(piece) - 1))
        heap = [(self.made[p][0], i) for i, p in enumerate(zip(piece, piece[1:])) if p in self.made]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if piece[i] >= 0 else len(piece)
            if j >= len(piece) or self.made.get((piece[i], piece[j]), (-1,))[0] != rank:
                continue
            piece[i], piece[j] = self.made[piece[i], piece[j]][1], -1
            after[i] = after[j]
            if after[i] < len(piece):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(piece) and (found := self.made.get((piece[k], piece[after[k]]))):
                    heapq.heappush(heap, (found[0], k))
        return [p for p in piece if p >= 0]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words: all ids end to end, and how many each word has."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, proposed), dtype=np.int64, count=len(words))
        ids = np.fromiter((i for p in proposed for i in p), dtype=np.int64, count=int(lengths.sum()))
        of = np.repeat(np.arange(len(words)), lengths)
        wrong = np.zeros(len(words), dtype=bool)
        wrong[of[~self.sound[ids]]] = True
        inside = of[1:] == of[:-1]
        keys = ids[:-1][inside] * self.size + ids[1:][inside]
        distinct, back = np.unique(keys, return_inverse=True)
        new = np.array([k for k in distinct.tolist() if k not in self.pairs], dtype=np.int64)
        if len(new):
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
                new = distinct
            self.pairs.update(zip(new.tolist(), self._crossed(new // self.size, new % self.size).tolist()))
        if len(keys):
            crossed = np.array([self.pairs[k] for k in distinct.tolist()], dtype=bool)
            wrong[of[1:][inside][crossed[back]]] = True
        if not wrong.any():
            return ids.astype("<u4"), lengths
        exact = [self.merge(r) if x else p for r, x, p in zip(raw, wrong.tolist(), proposed)]
        return np.fromiter(chain.from_iterable(exact), dtype="<u4"), np.fromiter(map(len, exact), dtype=np.int64, count=len(exact))

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, ends = self._joined([self.cut.findall(f" {p}") for p in pieces])
        return ids, np.diff(ends, prepend=0)

    def _joined(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        return self.words.joined(list(chain.from_iterable(cut)), np.fromiter(map(len, cut), dtype=np.int64, count=len(cut)))

    def cut_words(self, text: str) -> list[str]:
        if self.odd.search(text):
            return [text[a:b] for _, (a, b) in self._library().pre_tokenizer.pre_tokenize_str(text)]
        return self.cut.findall(text)

    def _library(self):
        if not hasattr(self, "_tokenizer"):
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def _special_batch(self, text: str) -> bytes:
        """A text with special tokens' strings in it."""
        encoded = lambda part: self._joined([self.cut_words(part)])[0].tobytes()
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += [encoded(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, encoded(text[at:])])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Where white space stands alone between words, a word begins at each space, so that a text is the sum of its pieces
        between spaces. Other texts are cut into words as a whole.
        """
        special = [self.cut_special is not None and self.cut_special.search(t) is not None for t in texts]
        plain = [not s and not self.odd.search(t) and not self.crowded.search(t) for t, s in zip(texts, special)]
        at = [t.find(" ") if p else -1 for t, p in zip(texts, plain)]
        heads = [[] if s else self.cut.findall(t[:i] if i >= 0 else t) if p else self.cut_words(t) for t, i, p, s in zip(texts, at, plain, special)]
        rest = pa.array([t[i + 1 :] if i >= 0 else None for t, i in zip(texts, at)], pa.string())
        out = [a + b for a, b in zip(slice_ids(*self._joined(heads)), slice_ids(*self.pieces.lists(pc.split_pattern(rest, " "))))]
        for i, s in enumerate(special):
            if s:
                out[i] = self._special_batch(texts[i])
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): a row for each row of docs; ids is binary, little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids = codec.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [codec.decode(x or b"") for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): encode and decode in one pass of one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids = codec.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())], names=["doc_id", "ids", "text"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids binary, text string")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return round_trip(table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )
