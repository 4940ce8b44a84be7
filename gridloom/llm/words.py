"""Token ids of texts by their distinct words.

A text is cut before each space that follows something other than white space:
there a match of a byte-level pattern ends, and what follows matches as it
would alone. The words of a batch are told apart by Arrow's dictionary
encoding, the distinct ones are encoded, those with a space before them as one
text whose ids are cut where the bytes are, and every word takes its ids. What
a task holds is one part of a batch, of about ``part_bytes``, and the ids of at
most ``kept`` words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts with white space before a space; Arrow's \s is ASCII's.
_BEFORE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_ENDS = _BEFORE[:-1] + "$|^$"
_CUT = re.compile(r"(?<=\S)(?= )")
_JOINED = 20_000  # words encoded as one text


def parts_by_bytes(texts: pa.Array, part_bytes: int) -> Iterator[pa.Array]:
    """Slices of about ``part_bytes``, of a text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        had = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, had + part_bytes, side="right")))
        yield texts.slice(at, to - at)
        at = to


def lists(parts: Sequence[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)))


class WordEncoder:
    """Ids of every text of an Arrow array, as a list array.

    ``encode`` gives one text's ids, ``id_bytes`` the number of bytes that each
    id stands for. ``whole`` tells texts that must not be cut, and ``joined``
    whether words may be encoded as one text.
    """

    def __init__(self, encode: Callable[[str], np.ndarray], id_bytes: np.ndarray, whole: Callable[[str], bool] | None = None, joined: bool = True, part_bytes: int = 8 << 20, kept: int = 300_000) -> None:
        self.encode, self.id_bytes, self.whole, self.joined, self.part_bytes, self.kept = encode, id_bytes, whole, joined, part_bytes, kept
        self.words, self.ids = pa.array([], pa.string()), lists([])

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        texts = texts.cast(pa.string())
        out = [self._part(x) for x in parts_by_bytes(texts, self.part_bytes)]
        return pa.concat_arrays(out) if out else lists([])

    def _part(self, texts: pa.Array) -> pa.ListArray:
        odd = pc.match_substring_regex(texts, _BEFORE).to_numpy(zero_copy_only=False)
        alone = np.zeros(len(texts), bool)
        if self.whole:
            alone[[i for i, t in enumerate(texts.to_pylist()) if self.whole(t)]] = True
        kinds = [np.flatnonzero(k) for k in (~odd & ~alone, odd & ~alone, alone)]
        even, cut, uncut = (texts.take(pa.array(k)) for k in kinds)
        pieces = [_CUT.split(t) for t in cut.to_pylist()]
        words = pa.array([[p[0], *(w[1:] for w in p[1:])] for p in pieces], pa.list_(pa.string()))
        found = pa.concat_arrays([self._by_words(pc.split_pattern(even, " ")), self._by_words(words), lists([self.encode(t) for t in uncut.to_pylist()])])
        return found.take(pa.array(np.argsort(np.concatenate(kinds), kind="stable")))

    def _by_words(self, words: pa.ListArray) -> pa.ListArray:
        """Each text's first word stands alone, the others follow a space."""
        ends = words.offsets.to_numpy()
        flat = words.flatten()
        first = ends[:-1] - ends[0]
        spaced, alone = flat.dictionary_encode(), flat.take(pa.array(first)).dictionary_encode()
        at = spaced.indices.to_numpy().copy()
        at[first] = alone.indices.to_numpy() + len(spaced.dictionary)
        known = pa.concat_arrays([self._after_space(spaced.dictionary), lists([self.encode(w) for w in alone.dictionary.to_pylist()])])
        taken = known.take(pa.array(at))
        return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[ends - ends[0]]), taken.values)

    def _after_space(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of distinct words with a space before each; of ``kept`` of them, those met first, the ids are kept."""
        had = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(had)
        new = words.filter(missing)
        plain = pc.invert(pc.match_substring_regex(new, _ENDS)).to_numpy(zero_copy_only=False) & self.joined
        parts = [self._as_one_text(new.take(pa.array(p))) for k in [np.flatnonzero(plain)] for p in np.array_split(k, -(-len(k) // _JOINED) or 1)]
        rest = np.flatnonzero(~plain)
        found = pa.concat_arrays([*parts, lists([self.encode(" " + w) for w in new.take(pa.array(rest)).to_pylist()])])
        found = found.take(pa.array(np.argsort(np.r_[np.flatnonzero(plain), rest], kind="stable")))
        at = had.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[missing.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        out = pa.concat_arrays([self.ids, found]).take(pa.array(at))
        if (room := min(self.kept - len(self.words), len(new))) > 0:
            self.words, self.ids = pa.concat_arrays([self.words, new.slice(0, room)]), pa.concat_arrays([self.ids, found.slice(0, room)])
        return out

    def _as_one_text(self, words: pa.StringArray) -> pa.ListArray:
        if not len(words):
            return lists([])
        ids = self.encode(" " + " ".join(words.to_pylist()))
        size = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) + 1)
        stops = np.searchsorted(np.cumsum(self.id_bytes[ids]), size) + 1
        return pa.ListArray.from_arrays(pa.array(np.r_[0, stops].astype(np.int32)), pa.array(ids.astype(np.int32)))
