"""Reads of an Arrow batch as flat numpy arrays: all bases end to end, and of each read the part that is still kept.

Trimming moves ``begin`` and ``end`` only; strings are cut once, at the end. Every step is a few passes over the flat
arrays, whatever the lengths of the reads, so one long read costs its length and not a padded matrix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bases that are held as numpy arrays at a time, about; one read may be longer.
MOST_BASES = 2_000_000
REASONS = np.array([None, "UMI_TOO_SHORT", "TOO_SHORT"], object)
_bytes = np.arange(256, dtype=np.uint8)
UPPER = np.where((_bytes >= 97) & (_bytes <= 122), _bytes - 32, _bytes).astype(np.uint8)
#: Upper case, with anything but A, C, G, T as N; and its complement.
NORMAL = np.where(np.isin(UPPER, np.frombuffer(b"ACGT", np.uint8)), UPPER, 78).astype(np.uint8)
COMPLEMENT = np.full(256, 78, np.uint8)
COMPLEMENT[np.frombuffer(b"ACGTacgt", np.uint8)] = np.frombuffer(b"TGCATGCA", np.uint8)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, the n + 1 places where they begin and end); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return own, at - at[0]


def texts(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The inverse of ``flat``."""
    if at[-1] < 2**31:
        return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def places(lengths: np.ndarray) -> np.ndarray:
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return at


def ranges(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every place of the ranges that begin at ``begin`` and have ``length`` places."""
    row = np.repeat(np.arange(len(begin)), length)
    return row, np.arange(len(row)) - places(length)[row] + begin[row]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "sequence", most: int = MOST_BASES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bases, a row at least."""
    for batch in batches:
        _, at = flat(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def _first(found: np.ndarray, at: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The first of the sorted places ``found`` that is at ``at`` or behind it and before ``none``, else ``none``."""
    return np.minimum(np.append(found, np.iinfo(np.int64).max)[np.searchsorted(found, at)], none)


def _last(found: np.ndarray, before: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The last of the sorted places before ``before`` and not below ``none``, else ``none``."""
    return np.maximum(np.insert(found, 0, -1)[np.searchsorted(found, before)], none)


def first_adapters(s: np.ndarray, begin: np.ndarray, end: np.ndarray, adapters: list[bytes], min_match: int) -> np.ndarray:
    """Place (in the flat array) at which an adapter is found first in each read, -1 for none.

    An adapter may run over the end of the read; of the bases that then lie on each other, ``min_match`` or more, every
    full eight admit a mismatch. The kept parts are laid out with gaps as wide as an adapter, so that all places of all
    reads are compared with a base of an adapter at once, block by block.
    """
    adapters = [a for a in adapters if len(a) >= min_match]
    found = np.full(len(begin), -1, np.int64)
    length = end - begin
    if not adapters or not len(begin):
        return found
    gap = max(map(len, adapters))
    start = places(length + gap)[:-1]
    row, here = ranges(start, length)
    laid = np.zeros(int(start[-1] + length[-1] + gap), np.uint8)
    laid[here] = UPPER[s[ranges(begin, length)[1]]]
    reach = np.zeros(len(laid), np.int32)  # bases from a place to the end of its read
    reach[here] = (start + length)[row] - here
    hits = []
    wide, last = 1 << 17, len(laid) - gap
    for at in range(0, last, wide):
        n = min(wide, last - at)
        some, any_hit = reach[at : at + n], np.zeros(n, bool)
        equal = np.empty(n, bool)
        for a in adapters:
            same = np.zeros(n, np.uint8 if len(a) < 256 else np.uint16)
            for k, base in enumerate(a):
                np.equal(laid[at + k : at + k + n], base, out=equal)
                np.add(same, equal.view(np.uint8), out=same, casting="unsafe")
            lying = np.minimum(some, len(a))
            any_hit |= lying - same <= lying >> 3
        hits.append(at + np.flatnonzero(any_hit & (some >= min_match)))
    hit = np.concatenate(hits)
    got = _first(hit, start, start + length)
    there = got < start + length
    found[there] = (got - start + begin)[there]
    return found


class Reads:
    """The reads of a batch and what the steps did to them."""

    def __init__(self, sequence: pa.Array, quality: pa.Array) -> None:
        (self.s, at), (self.q, of_quality) = flat(sequence), flat(quality)
        if not np.array_equal(at, of_quality):
            raise ValueError("sequence and quality of a read differ in length")
        n = len(at) - 1
        self.begin, self.end = at[:-1].copy(), at[1:].copy()
        self.original = self.end - self.begin
        self.quality_trimmed, self.poly_g_trimmed, self.poly_x_trimmed = (np.zeros(n, bool) for _ in range(3))
        self.adapter, self.corrected = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.failed = np.zeros(n, np.int8)
        self.umi_length = 0

    @property
    def open(self) -> np.ndarray:
        """Reads that no step failed; the others are left as they are."""
        return self.failed == 0

    def keep(self, begin: np.ndarray, end: np.ndarray, flag: np.ndarray | None = None) -> None:
        begin, end = np.where(self.open, begin, self.begin), np.where(self.open, end, self.end)
        if flag is not None:
            flag |= end - begin < self.end - self.begin
        self.begin, self.end = begin, end

    def umi(self, n: int) -> None:
        self.umi_length = n
        self.failed[self.end - self.begin < n] = 1
        self.keep(self.begin + n, self.end)

    def quality_steps(self, c) -> None:
        if c.front:
            self.keep(np.minimum(self.begin + c.front, self.end), self.end)
        if c.tail:
            self.keep(self.begin, np.maximum(self.end - c.tail, self.begin))
        if c.quality and (c.cut_front or c.cut_tail):
            good = np.flatnonzero(self.q >= 33 + c.quality)
            if c.cut_front:
                self.keep(_first(good, self.begin, self.end), self.end, self.quality_trimmed)
            if c.cut_tail:
                self.keep(self.begin, _last(good, self.end, self.begin - 1) + 1, self.quality_trimmed)
        if c.quality and c.cut_right and len(self.q) >= c.window:
            upto = places(self.q.astype(np.int64) - 33)
            low = np.flatnonzero(upto[c.window :] - upto[: -c.window] < c.quality * c.window)
            cut = _first(low, self.begin, self.end)
            self.keep(self.begin, np.where(cut + c.window <= self.end, cut, self.end), self.quality_trimmed)

    def cut_at(self, position: np.ndarray) -> None:
        """Cuts where ``position`` (from the begin of the kept part) isn't negative; an adapter was found there."""
        there = position >= 0
        self.end = np.where(there, self.begin + position, self.end)
        self.adapter = np.where(there, position, self.adapter)

    def adapters(self, own: list[bytes], min_match: int, among: np.ndarray | None = None) -> np.ndarray:
        """Position of the first adapter in each read, from the begin of its kept part; -1 for none."""
        among = np.flatnonzero(self.open if among is None else among)
        at, found = np.full(len(self.begin), -1, np.int64), first_adapters(self.s, self.begin[among], self.end[among], own, min_match)
        at[among] = np.where(found >= 0, found - self.begin[among], -1)
        return at

    def poly_g(self, least: int) -> None:
        other = np.flatnonzero(UPPER[self.s] != 71)
        self._tail(_last(other, self.end, self.begin - 1) + 1, least, self.poly_g_trimmed)

    def poly_x(self, least: int) -> None:
        up = UPPER[self.s]
        change = np.flatnonzero(np.append(True, up[1:] != up[:-1])[: len(up)])
        start = _last(change, self.end, self.begin)
        at_end = up[np.maximum(self.end - 1, 0)] if len(up) else np.zeros(len(self.end), np.uint8)
        self._tail(np.where(np.isin(at_end, np.frombuffer(b"ACGT", np.uint8)), start, self.end), least, self.poly_x_trimmed)

    def _tail(self, start: np.ndarray, least: int, flag: np.ndarray) -> None:
        start = np.minimum(start, self.end)
        self.keep(self.begin, np.where(self.end - start >= least, start, self.end), flag)

    def last_steps(self, c) -> None:
        if c.poly_g:
            self.poly_g(c.poly_g)
        if c.poly_x:
            self.poly_x(c.poly_x)
        self.failed[self.open & (self.end - self.begin < c.min_length)] = 2

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """(places of all kept bases in the flat arrays, where the reads begin among them)."""
        length = self.end - self.begin
        return ranges(self.begin, length)[1], places(length)

    def columns(self, header: pa.Array | None = None) -> dict[str, pa.Array]:
        """The trimmed texts and the flags."""
        where, at = self.kept()
        umi = pa.nulls(len(self.begin), pa.string())
        if self.umi_length:
            got = self.failed != 1
            first = self.begin_of_umi()
            umi = texts(self.s[ranges(first, np.where(got, self.umi_length, 0))[1]], places(np.where(got, self.umi_length, 0)))
            umi = pc.if_else(pa.array(got), umi, pa.scalar(None, umi.type))
            if header is not None:
                header = pc.if_else(pa.array(got), pc.binary_join_element_wise(header, umi, " UMI:", null_handling="skip"), header)
        made = {
            "sequence": texts(self.s[where], at), "quality": texts(self.q[where], at), "original_length": pa.array(self.original), "quality_trimmed": pa.array(self.quality_trimmed),
            "adapter_position": pa.array(self.adapter.astype(np.int32), mask=self.adapter < 0), "poly_g_trimmed": pa.array(self.poly_g_trimmed), "poly_x_trimmed": pa.array(self.poly_x_trimmed),
            "corrected_bases": pa.array(self.corrected), "umi": umi, "failed": pa.array(REASONS[self.failed], pa.string()), "passed": pa.array(self.open),
        }
        return made | ({"header": header} if header is not None else {})

    def begin_of_umi(self) -> np.ndarray:
        return places(self.original)[:-1]
