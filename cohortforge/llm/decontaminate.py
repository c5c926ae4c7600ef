"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.arrowtext import ALNUM, LOWER, chunks, hash_runs, rows_of, runs, shingle_hashes, utf8
from cohortforge.llm.shared import materialise, small_batches

_U = np.uint64
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_LOWER_TABLE = LOWER.tobytes()

#: Bytes of item text that one pass over the documents holds; more items take more passes.
BLOCK_BYTES = 16 << 20


def text_shingles(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the word shingles of each text: words are lower-cased runs of letters and digits."""
    low = LOWER[data]
    starts, ends = runs(ALNUM[data], offs)
    return shingle_hashes(hash_runs(low, starts, ends), rows_of(starts, offs), len(offs) - 1, size)


def word_shingles(text: bytes, size: int) -> set[bytes]:
    """The same shingles as words."""
    words = _WORD.findall(text.translate(_LOWER_TABLE))
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class ItemIndex:
    """MinHash sketches of a block of items, by size class.

    An item of q distinct shingles needs c = ceil(threshold * q) of them in a
    document.  Items whose q is of one power of two share a hash bound: the least that
    leaves each of them at least q - c + 1 hashes, its sketch.  The sketch of a
    document for that class is all its hashes up to the bound, so a long document has
    a longer sketch and the overlap of the two is that of their MinHashes.  Of an item's
    m sketched shingles at most q - c may be missing, so a document is a candidate if
    its sketch holds m - (q - c) of them, one at least; none that holds the item is lost.
    """

    def __init__(self, items: list[tuple[int, str | None]], size: int, threshold: float):
        self.size, self.threshold = size, threshold
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.texts = [(t or "").encode() for _, t in items]
        data, offs = utf8(pa.array([t for _, t in items], pa.string()))
        h, row = text_shingles(data, offs, size)
        pairs = np.unique(np.stack([row.astype(_U), h], axis=1), axis=0) if len(h) else np.zeros((0, 2), _U)
        row, h = pairs[:, 0].astype(np.int64), pairs[:, 1]
        self.count = np.bincount(row, minlength=len(items)).astype(np.int64)
        self.need = np.ceil(self.count * threshold - 1e-9).astype(np.int64)
        spare = self.count - self.need
        first = np.concatenate(([0], np.cumsum(self.count)[:-1])).astype(np.int64)
        size_class = np.frexp(np.maximum(self.count, 1))[1]
        self.shared = np.zeros(len(items), dtype=np.int64)  # sketched shingles that a document must hold
        self.classes = []
        for c in np.unique(size_class[row]) if len(row) else []:
            own = np.flatnonzero((size_class == c) & (self.count > 0))
            bound = h[(first + spare)[own]].max()
            of = (size_class[row] == c) & (h <= bound)
            self.shared[own] = np.bincount(row[of], minlength=len(items))[own] - spare[own]
            order = np.argsort(h[of], kind="stable")
            self.classes.append((bound, h[of][order], row[of][order]))

    @staticmethod
    def _pairs(h: np.ndarray, doc: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(doc, item) for every hash that stands among the sorted keys."""
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        n = hi - lo
        if not n.any():
            return np.zeros((0, 2), np.int64)
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.stack([np.repeat(doc, n), rows[at]], axis=1)

    def search(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of all texts that hold an item."""
        h, doc = text_shingles(data, offs, self.size)
        candidates = [np.zeros((0, 2), np.int64)]
        for bound, keys, rows in self.classes:
            low = np.flatnonzero(h <= bound)
            low = low[keys[np.minimum(np.searchsorted(keys, h[low]), len(keys) - 1)] == h[low]]  # of the sketch only what an item's has counts
            sketch = np.unique(np.stack([doc[low].astype(_U), h[low]], axis=1), axis=0)
            pairs, n = np.unique(self._pairs(sketch[:, 1], sketch[:, 0].astype(np.int64), keys, rows), axis=0, return_counts=True)
            candidates.append(pairs[n >= self.shared[pairs[:, 1]]])
        pairs = np.concatenate(candidates)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        # then word by word
        out, at, held = [], -1, set()
        for row, item in pairs.tolist():
            if row != at:
                at, held = row, word_shingles(data[offs[row] : offs[row + 1]].tobytes(), self.size)
            exact = len(held & word_shingles(self.texts[item], self.size))
            if exact >= self.need[item]:
                out.append((row, item, exact))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that hold benchmark items.

    One row per document and item of which at least ``threshold`` of the distinct
    shingles of ``size`` words stand in the document: doc_id, item_id, n_item,
    n_shared, containment.  Words are lower-cased runs of letters and digits, so that
    line breaks and punctuation do not hide a passage; a text of fewer words has one
    shingle, so that a shorter item matches only a text of just its words.  Nulls and
    texts without a word match nothing; an item without an id is left out; a document
    without one has a null doc_id.  Repeated rows of documents have a row each, repeated
    items one.  Other columns are not looked at.  The items go to the tasks in blocks of
    at most about ``block_bytes`` of text, one block at a time, whose result is written
    before the next is made; the documents are passed once per block and never shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index, last in _indexes(benchmark, size, threshold, block_bytes):
        found = texts.mapInArrow(_searcher(index), "doc_id long, item_id long, n_item long, n_shared long, containment double")
        found = found if last else materialise(found)
        out = found if out is None else out.union(found)
    return out


def _indexes(benchmark: DataFrame, size: int, threshold: float, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """Indexes of the items, in blocks dealt by hash, made when they are asked for; and whether it is the last."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # a block
        yield benchmark.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in part], size, threshold)), k + 1 == blocks


def _searcher(held: Broadcast):
    def run(batches):
        index = held.value
        for batch in chunks(batches):
            data, offs = utf8(batch.column("text"))
            hits = index.search(data, offs)
            if hits:
                row, item, shared = (np.array(c, dtype=np.int64) for c in zip(*hits, strict=True))
                n = index.count[item]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(index.ids[item]), pa.array(n), pa.array(shared), pa.array(shared / n)],
                    ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                )

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all rows and columns whatever their names, that hold no benchmark item.

    One pass for each block of items, written before the next, no shuffle.  Rows
    without an id or a text, and repeated rows, are judged by their texts like any other.
    """
    small_batches(docs.sparkSession)
    for index, last in _indexes(benchmark, size, threshold, block_bytes):
        docs = docs.mapInArrow(_cleaner(index), docs.schema)
        docs = docs if last else materialise(docs)
    return docs


def _cleaner(held: Broadcast):
    def run(batches):
        index = held.value
        for batch in chunks(batches):
            clean = np.ones(batch.num_rows, dtype=bool)
            clean[[row for row, _, _ in index.search(*utf8(batch.column("text")))]] = False
            yield batch.filter(pa.array(clean))

    return run


ORACLE_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\x00-\x7F])+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\x00-\x7F])+') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh
  FROM w WHERE len(ws) > 0
), n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n_item AS n_item, count(*) AS n_shared, count(*) / n.n_item::DOUBLE AS containment
FROM s d JOIN s b ON d.sh = b.sh AND d.kind = 'd' AND b.kind = 'b' JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n_item HAVING count(*) >= 0.8 * n.n_item
"""
