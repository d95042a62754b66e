"""Token ids of texts put together from results kept by word, in bounded memory and on arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Of distinct words: their ids end to end, and how many ids each word has.
Learn = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

#: New words learned at a time, as Python strings take several times their bytes.
STEP = 50_000


class Kept:
    """Words met so far as one Arrow array, with their ids in flat arrays beside it.

    A dictionary encoding of the words at hand, and one of the words kept and these, finds what is repeated, known and new. Above `most`
    words only those of the last call stay, so that common words stay and memory is bounded by `most` and one call's words.
    """

    def __init__(self, most: int, learn: Learn):
        self.most, self.learn = most, learn
        self.words = pa.array([], pa.string())
        self._set(np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int32))

    def _set(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes = ids, sizes
        self.starts = np.cumsum(sizes, dtype=np.int32) - sizes

    def of(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, in their order, end to end (less than 2^31), and where each word's ids end."""
        here = words.dictionary_encode()
        coded = pa.concat_arrays([self.words, here.dictionary]).dictionary_encode()
        every, at = coded.dictionary, coded.indices.to_numpy()[len(self.words) :][here.indices.to_numpy()]
        if len(every) > len(self.words):
            learned = [self.learn(every.slice(a, STEP).to_pylist()) for a in range(len(self.words), len(every), STEP)]
            self._set(np.concatenate([self.flat, *[ids for ids, _ in learned]]), np.concatenate([self.sizes, *[sizes.astype(np.int32) for _, sizes in learned]]))
            self.words = every
        out = self._gathered(at)
        if len(self.words) > self.most:
            used = np.unique(at)
            flat, _ = self._gathered(used)
            self.words = self.words.take(pa.array(used))
            self._set(flat, self.sizes[used])
        return out

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        place = np.repeat(self.starts[at] - (ends - sizes).astype(np.int32), sizes)
        place += np.arange(len(place), dtype=np.int32)
        return self.flat[place], ends

    def joined(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For lists of words, laid end to end and `counts` long: their ids, and where each list's ids end."""
        ids, ends = self.of(pa.array(words, pa.string()))
        return ids, np.concatenate([[0], ends])[np.cumsum(counts)]

    def lists(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """As `joined`, of an Arrow array of lists."""
        ids, ends = self.of(words.flatten())
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        return ids, np.concatenate([[0], ends])[offsets[1:]]


def slice_ids(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = ids.tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def segments(text: str, most: int, space) -> list[str]:
    """A text cut before white space (a compiled pattern) into parts of about `most` characters; a longer word stays whole."""
    out, at = [], 0
    while len(text) - at > most and (m := space.search(text, at + most)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]
