"""Encoding batches of texts by their distinct words.

Byte-level BPE splits a text by a pattern before it merges, and no match of that
pattern runs over a space that follows a non-space, except that it may begin with it.
So a text can be cut before each such space, and only distinct pieces meet the pattern.
A text with a space after white space is split as a whole. Texts, pieces and words are
Arrow arrays and index arrays; the ids of a text are gathered from those of its words.

An encoder keeps the words it has encoded with their ids, in Arrow arrays of at most
``KEPT_BYTES`` and what one batch adds; when they are full it starts anew. This changes
speed alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_BYTES = 24_000_000
#: Characters of text that are encoded together.
TEXT_CHARS = 4_000_000


class Ids(NamedTuple):
    """The ids of several items one after another, and how many each has."""

    flat: np.ndarray  # uint32
    sizes: np.ndarray

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.sizes[:i].sum() :][: self.sizes[i]]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _gathered(ids: Ids, index: np.ndarray) -> Ids:
    """The ids of the items at an index array."""
    lists = pa.LargeListArray.from_arrays(pa.array(_starts(ids.sizes)), pa.array(ids.flat, pa.uint32()))
    return Ids(lists.take(pa.array(index)).flatten().to_numpy(zero_copy_only=False), ids.sizes[index])


def _summed(sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sums of runs of ``sizes``; ``groups`` has the length of each run."""
    return np.diff(_starts(sizes)[_starts(groups)])


def uneven(piece: str) -> bool:
    """A piece that ends in white space joins the space behind it."""
    return not piece or piece[-1].isspace()


class TextEncoder:
    """Ids of texts, from a function that encodes new distinct words; with ``lead`` each text gets a space in front."""

    def __init__(self, split: Callable[[str], list[str]], encode_words: Callable[[pa.Array], Ids], kept_bytes: int = KEPT_BYTES, lead: bool = False):
        self._split, self._encode_words, self._kept_bytes, self._lead = split, encode_words, kept_bytes, " " if lead else ""
        self._forget()

    def _forget(self) -> None:
        self._known, self._ids = pa.array([], pa.string()), Ids(np.empty(0, np.uint32), np.empty(0, np.int64))

    def _of_words(self, words: pa.Array) -> Ids:
        """The ids of distinct words."""
        if self._known.nbytes + self._ids.flat.nbytes + self._ids.sizes.nbytes > self._kept_bytes:
            self._forget()
        at = pc.index_in(words, value_set=self._known)
        unseen = at.is_null()
        new = words.filter(unseen)
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            place[unseen.to_numpy(zero_copy_only=False)] = len(self._known) + np.arange(len(new))
            found = self._encode_words(new)
            self._known = pa.concat_arrays([self._known, new])
            self._ids = Ids(np.concatenate([self._ids.flat, found.flat]), np.concatenate([self._ids.sizes, found.sizes]))
        return _gathered(self._ids, place)

    def _parts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(words, words of each part, parts of all texts as indexes, parts of each text)."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        sizes = np.diff(pieces.offsets.to_numpy())
        starts = _starts(sizes)[:-1]
        coded = pieces.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        # Pieces of ASCII letters are one word each and come first; the pattern reads all others.
        letters = pc.ascii_is_alpha(coded.dictionary)
        plain, rest = coded.dictionary.filter(letters), coded.dictionary.filter(pc.invert(letters)).to_pylist()
        is_plain = letters.to_numpy(zero_copy_only=False)
        n = len(is_plain)
        place = np.where(is_plain, np.cumsum(is_plain) - 1, len(plain) + np.cumsum(~is_plain) - 1)
        code = place[code]
        odd = np.zeros(n, dtype=bool)
        odd[len(plain) :] = np.fromiter(map(uneven, rest), bool, len(rest))
        whole = np.logical_or.reduceat(odd[code], starts)

        found = [() if uneven(piece) else self._split(" " + piece) for piece in rest]
        # A text's first part is its own: what stands before the first cut, or all of it.
        found += [self._split(self._lead + (text if w else text.partition(" ")[0])) for text, w in zip(texts, whole.tolist(), strict=True)]
        counts = np.ones(n + len(texts), dtype=np.int64)
        counts[len(plain) :] = np.fromiter(map(len, found), np.int64, len(found))
        others = pa.array([w for words in found for w in words], pa.large_string())
        spaced = pc.binary_join_element_wise(pa.scalar("", plain.type), plain, pa.scalar(" ", plain.type))
        words = pa.concat_arrays([spaced, others]).cast(pa.string())
        code[starts] = n + np.arange(len(texts))
        stays = ~np.repeat(whole, sizes)
        stays[starts] = True
        return words, counts, code[stays], np.where(whole, 1, sizes)

    def encode(self, texts: list[str]) -> Ids:
        """The ids of each text."""
        if not texts:
            return Ids(np.empty(0, np.uint32), np.empty(0, np.int64))
        words, counts, parts, parts_of_text = self._parts(texts)
        coded = words.dictionary_encode()
        in_order = _gathered(self._of_words(coded.dictionary), coded.indices.to_numpy().astype(np.int64))
        of_parts = Ids(in_order.flat, _summed(in_order.sizes, counts))
        found = _gathered(of_parts, parts)
        return Ids(found.flat, _summed(found.sizes, parts_of_text))


def runs(texts: list[str], size: int = TEXT_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters each."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
