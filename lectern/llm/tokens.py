"""Token ids of whole texts by the installed tokenizer libraries, with a memory for repeated pieces.

A text is cut where the vocabulary's own pre-tokenization always cuts, so that the ids of the whole
are the ids of its pieces in order. Each worker remembers short pieces that it has met (about
``MEMORY_BYTES``; then it starts anew) and hands only new ones to the library, many in one call.
Texts in which a cut could change the result go to the library whole; neither they nor pieces of more
than ``LONGEST`` characters are remembered.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from lectern.llm.text import releases, slices

#: Pieces are counted with ``_PIECE_BYTES`` for their entries besides their characters and ids.
MEMORY_BYTES, LONGEST = 192 << 20, 64
_PIECE_BYTES = 160
_SLICE = 2 << 20

_RUNS = re.compile(r"\s\s\s|\s\s\Z")
#: White space beside the blank and the line feed; and characters that a library's rules for white space may see otherwise.
_ODD = [chr(i) for i in (0x00, 0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

_WHITE = re.compile("[\\s" + "".join(map(re.escape, _ODD)) + "]")


def leading_space_pieces(text: str) -> list[str] | None:
    """Pieces for vocabularies whose words carry one leading blank; None where the text must stay whole.

    White space of up to two characters between words never spans a cut before a blank, before a line
    feed or after one; longer runs, runs at the end and rarer white space do not follow that rule, nor
    does white space beside a special token.
    """
    if "<|" in text:
        return None
    if ("  " in text or "\n\n" in text or "\n " in text or " \n" in text) and _RUNS.search(text):
        return None
    if any(c in text for c in _ODD):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def blank_pieces(text: str) -> list[str] | None:
    """Pieces for vocabularies that drop white space."""
    return text.replace("\n", " ").split(" ")


class _Places(dict):
    """Numbers each new key in order of its first look-up, and lists the new ones.

    Long keys are not kept: each look-up lists them again, numbered downwards from -1.
    """

    def __init__(self):
        super().__init__({"": 0})
        self.new: list[str] = []
        self.long: list[str] = []

    def __missing__(self, piece: str) -> int:
        if len(piece) > LONGEST:
            self.long.append(piece)
            return -len(self.long)
        self[piece] = place = len(self)
        self.new.append(piece)
        return place


def _doubled(x: np.ndarray, need: int) -> np.ndarray:
    while len(x) < need:
        x = np.concatenate([x, np.zeros_like(x)])
    return x


class PieceMemory:
    """Ids of texts: ``cut`` gives a text's pieces, ``encode`` turns new pieces into (the places of the
    pieces in an order of its own, all their ids in that order, how many each has)."""

    def __init__(self, cut: Callable[[str], list[str] | None], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = MEMORY_BYTES):
        self.cut, self.encode, self.most = cut, encode, most
        self._reset()

    def _reset(self) -> None:
        self.place = _Places()
        self.ids = np.zeros(1 << 14, np.uint32)
        self.start = np.zeros(1 << 14, np.int32)  # ``most`` bounds the ids: far from 2^31
        self.count = np.zeros(1 << 14, np.int32)
        self.size = self.held = 0

    def _learn(self) -> None:
        if not self.place.new:
            return
        order, ids, counts = self.encode(self.place.new)
        first, total = len(self.place) - len(counts), self.size + len(ids)
        self.start, self.count = _doubled(self.start, len(self.place)), _doubled(self.count, len(self.place))
        self.ids = _doubled(self.ids, total)
        self.ids[self.size : total] = ids
        self.start[first + order] = self.size + np.cumsum(counts) - counts
        self.count[first + order] = counts
        self.size = total
        self.held += sum(map(len, self.place.new)) + _PIECE_BYTES * len(counts) + 4 * len(ids)
        self.place.new = []

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of each text's ids)."""
        if self.held > self.most:
            self._reset()
        cuts = [c if (c := self.cut(t)) is not None else [t] for t in texts]
        flat = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cuts)), np.int64)
        self._learn()
        start, count, ids = self.start[: len(self.place)], self.count[: len(self.place)], self.ids[: self.size]
        if self.place.long:  # behind the others, last first, so that numbers below 0 find them
            order, more, counts = self.encode(self.place.long)
            at = len(ids) + np.cumsum(counts) - counts
            back = np.argsort(order)[::-1]
            start, count, ids = np.append(start, at[back]), np.append(count, counts[back]), np.append(ids, more)
            self.place.long = []
        n = count[flat].astype(np.int64)
        ends = np.append(0, np.cumsum(n))
        found = ids[np.repeat(start[flat] - ends[:-1], n) + np.arange(ends[-1])]
        return found, ends[np.append(0, np.cumsum(np.fromiter(map(len, cuts), np.int64, len(cuts))))]


@lru_cache(maxsize=4)
def library_memory(path: str, drops_space: bool) -> PieceMemory:
    """A memory over the ``tokenizers`` library for the vocabulary file at ``path``; one a Python worker.

    Special tokens' strings in a text give those tokens, as the library does by itself. New words that carry
    their blank go to it as one text, in which tokens are dealt to words by their bytes; other pieces joined by a
    special token; pieces that could hold or make one, or are long, singly.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    mark = "<|endoftext|>"
    mark_id = library.token_to_id(mark)

    lengths = np.array([len(library.id_to_token(k) or "") for k in range(library.get_vocab_size())], np.int64)

    def ids_of(text: str) -> np.ndarray:
        return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def in_a_row(group: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, how many each has) of words with a blank before each as one text; None where the tokens' bytes are not the words'."""
        found = ids_of("".join(group))
        at = np.append(0, np.cumsum(lengths[found]))
        ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in group])
        last = np.searchsorted(at, ends)
        if at[-1] != ends[-1] or (at[last] != ends).any():
            return None
        return found, np.diff(last, prepend=0)

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.array([not drops_space and p[0] == " " and 1 < len(p) <= LONGEST and not _WHITE.search(p, 1) and "<|" not in p and "|>" not in p for p in pieces], bool)
        single = np.array([len(p) > 1000 or "<|" in p or "|>" in p or p[0] == ">" or p[-1] == "<" for p in pieces], bool) & ~words
        ids, counts, order = [], [], []
        places = np.flatnonzero(words)
        for first in range(0, len(places), 4000):
            own = places[first : first + 4000]
            found = in_a_row([pieces[k] for k in own])
            if found is None:  # no vocabulary of bytes: one by one
                single[own] = True
                continue
            order.append(own)
            ids.append(found[0])
            counts.append(found[1])
        joined, apart = np.flatnonzero(~single & ~words), np.flatnonzero(single)
        for first in range(0, len(joined), 4000):
            group = [pieces[k] for k in joined[first : first + 4000]]
            found = ids_of(mark.join(group))
            breaks = found == mark_id
            ids.append(found[~breaks])
            counts.append(np.diff(np.flatnonzero(breaks), prepend=-1, append=len(found)) - 1)
            assert len(counts[-1]) == len(group)
        for k in apart:
            ids.append(ids_of(pieces[k]))
            counts.append(np.array([len(ids[-1])]))
        return np.concatenate([*order, joined, apart]), np.concatenate(ids), np.concatenate(counts)

    return PieceMemory(blank_pieces if drops_space else leading_space_pieces, encode)


releases.append(library_memory.cache_clear)


def id_columns(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of ids as a binary column of little-endian unsigned 32-bit integers."""
    if at[-1] * 4 >= 1 << 31:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def with_end(ids: np.ndarray, at: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text's."""
    if end is None:
        return ids, at
    return np.insert(ids, at[1:], np.uint32(end)), at + np.arange(len(at))


def encoded_slices(batches: Iterator[pa.RecordBatch], memory: PieceMemory, end: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets) of slices of batches that have a column ``text``; a null text is empty."""
    for part in slices(batches, "text", _SLICE, keeps=True):
        texts = part.column(part.schema.get_field_index("text")).fill_null("").to_pylist()
        yield part, *with_end(*memory.encode_texts(texts), end)
