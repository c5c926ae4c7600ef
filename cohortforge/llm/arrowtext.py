"""Vectorised views of Arrow text batches, shared by the text operators.

All helpers work on the UTF-8 bytes of whole texts.  A null text counts as the
empty text.  Batches are cut into chunks of bounded size, so that the memory of
a task does not depend on how long the texts of one batch happen to be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
_U = np.uint64

#: ASCII lower-casing by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for the six ASCII white-space bytes.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: True for bytes of alphanumeric runs: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(batches, size: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text each; one text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offs, offs[start] + size, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True bytes; a run never crosses a row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(len(inside), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(len(inside), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def rows_of(positions: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Row that holds each byte position."""
    return np.searchsorted(offs, positions, "right") - 1


_BASE, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=_U)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each run; equal runs get equal values wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * _power("up", _BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", _INVERSE, n + 1)[starts]
    return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of ``size`` consecutive words of a row.

    A row with fewer words, but at least one, has one shingle: its whole sequence.
    """
    count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    first = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
    out, rows = [], []
    if len(words) >= size:
        h = np.zeros(len(words) - size + 1, dtype=_U)
        for j in range(size):
            h = mix(h * _U(31) + words[j : len(words) - size + 1 + j] + _U(1))
        whole = doc[: len(h)] == doc[size - 1 :]
        out.append(h[whole])
        rows.append(doc[: len(h)][whole])
    for row in np.flatnonzero((count > 0) & (count < size)):
        h = np.zeros(1, dtype=_U)
        for w in words[first[row] : first[row] + count[row]]:
            h = mix(h * _U(31) + w + _U(1))
        out.append(h)
        rows.append(np.array([row]))
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(rows).astype(np.int64)
