"""SimHash near-duplicates: byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.llm.arrowtext import LOWER, chunks, utf8
from cohortforge.llm.components import components
from cohortforge.llm.grouped import bounds, whole_groups
from cohortforge.llm.shared import join_keys, materialise, small_batches

SEED = 42
_LOWER_TABLE = LOWER.tobytes()
_U = np.uint64

#: Byte positions of a posting: lists grow with the fingerprints over 2^(8 * KEY_BYTES).  Four cost 70 postings a
#: fingerprint in place of 20 and are exact too; for over a thousand million different fingerprints.
KEY_BYTES = 3

#: For a byte, its bits as four 16-bit lanes: high nibble, low nibble.
_LANES = np.zeros((2, 256), dtype=_U)
for _byte in range(256):
    for _bit in range(8):
        if _byte >> _bit & 1:
            _LANES[_bit // 4, _byte] |= _U(1 << 16 * (_bit % 4))
_LANE_ROWS = 65_535


def shingle_digests(text: bytes, size: int) -> list[int]:
    """XXH64 of every run of ``size`` words, repeats included; fewer words: the whole sequence."""
    words = text.translate(_LOWER_TABLE).split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - size]]
    return [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[size - 1 :], strict=True)]


def majority(digests: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the digests; none: zero."""
    n = len(digests)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _LANE_ROWS):
        octets = digests[at : at + _LANE_ROWS].view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            column = octets[:, byte]
            for half in range(2):
                total = int(_LANES[half][column].sum(dtype=_U))
                for lane in range(4):
                    counts[byte * 8 + half * 4 + lane] += total >> 16 * lane & 0xFFFF
    return sum(1 << b for b in range(64) if 2 * counts[b] > n)


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and the 64-bit SimHash of its whole text, as a signed long ``fp``."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in chunks(batches):
            data, offs = utf8(batch.column("text"))
            raw = data.tobytes()
            fps = [majority(np.array(shingle_digests(raw[offs[i] : offs[i + 1]], size), dtype=_U)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, dtype=_U).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _links(fp: np.ndarray, ids: np.ndarray, start: int, stop: int, bits: int, least: int) -> list[np.ndarray]:
    """Spanning links among the rows [start, stop): a search from row to row, each step one vector comparison."""
    left = np.arange(start, stop)
    out = []
    while len(left):
        stack = [left[0]]
        left = left[1:]
        while stack and len(left):
            at = stack.pop()
            x = fp[left] ^ fp[at]
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            hit = shared >= least
            hit[hit] = np.bitwise_count(x[hit]) <= bits
            if hit.any():
                found = left[hit]
                out.append(np.stack([np.full(len(found), ids[at]), ids[found]], axis=1))
                stack.extend(found)
                left = left[~hit]
    return out


def link_edges(marks: DataFrame, bits: int = 4, key_bytes: int = KEY_BYTES, block: int = 4096) -> DataFrame:
    """Spanning links (a, b) between fingerprints of at most ``bits`` differing bits.

    ``marks`` has one row per distinct fingerprint ``fp``.  Two linked fingerprints share at least 8 - bits of their eight positional bytes.  The
    inverted index posts a fingerprint under sets of ``key_bytes`` positions; the
    chosen sets are such that any 8 - bits shared positions hold one of them.  Within
    a list the shared positional bytes of a pair are tallied, pairs that reach the
    guaranteed minimum are kept and their bits compared.  A list of more than
    ``block`` rows is dealt out as pairs of blocks, so that no task holds more than
    two blocks of it.
    """
    least = 8 - bits
    sets = position_sets(least, min(key_bytes, least))
    octet = [F.shiftrightunsigned(F.col("fp"), 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = []
    for k, positions in enumerate(sets):
        value = F.lit(k).cast("long")
        for p in positions:
            value = F.shiftleft(value, 8).bitwiseOR(octet[p])
        keys.append(value)
    posts = marks.select("fp", F.explode(F.array(*keys)).alias("key"))
    crowded = posts.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / F.lit(block / 2)).cast("int").alias("blocks"))
    dealt = posts.join(crowded, "key", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    dealt = dealt.select("key", "fp", "own", other.alias("other")).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def run(batches):
        for table in whole_groups(batches, ["key", "i", "j"]):
            key, i, j, ids = (table.column(c).to_numpy() for c in ("key", "i", "j", "fp"))
            fp = np.ascontiguousarray(ids).view(_U)
            at = bounds(key, i, j)
            size = np.diff(at)
            group = np.repeat(np.arange(len(size)), size)
            found = []
            step = 1
            small = np.repeat(size <= 16, size)
            while True:  # lists of up to 16 rows: all of them at once, by distance of rows
                a = np.flatnonzero(small[:-step] & (group[:-step] == group[step:])) if step < len(key) else np.zeros(0, np.int64)
                if not len(a):
                    break
                x = fp[a] ^ fp[a + step]
                hit = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= least
                hit[hit] = np.bitwise_count(x[hit]) <= bits
                if hit.any():
                    found.append(np.stack([ids[a[hit]], ids[a[hit] + step]], axis=1))
                step += 1
            for g in np.flatnonzero(size > 16):
                found += _links(fp, ids, at[g], at[g + 1], bits, least)
            if found:
                pairs = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def position_sets(shared: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` of the eight positions such that any ``shared`` positions hold one of them.

    All sets that are not needed are dropped one by one.  The positions stand in a
    ring of three blocks; sets other than those inside one block, or with two
    positions in a block and one in the next (Turan's system), are tried first.
    """
    need = [set(n) for n in combinations(range(8), shared)]
    block = (0, 0, 0, 1, 1, 1, 2, 2)

    def ring(s: tuple[int, ...]) -> bool:
        b = [block[x] for x in s]
        return len(s) != 3 or len(set(b)) == 1 or any(b.count(g) == 2 and b.count((g + 1) % 3) == 1 for g in range(3))

    chosen = list(combinations(range(8), size))
    for s in sorted(chosen, key=ring):
        rest = [c for c in chosen if c != s]
        if all(any(n.issuperset(c) for c in rest) for n in need):
            chosen = rest
    return chosen


def near_duplicates(docs: DataFrame, size: int = 4, bits: int = 4, key_bytes: int = KEY_BYTES) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document.

    Nulls and empty texts have the fingerprint zero and link like any other.  Equal
    fingerprints are one node, whatever their number; component_id is the smallest
    doc_id reachable by links, itself included.  A row without a doc_id links like any
    other and has the component_id of its group, null where no row of it has an id.
    Repeated rows have a row each; other columns of ``docs`` are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    marks = materialise(fingerprints(docs, size))
    nodes = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    joined = components(spark, link_edges(nodes.select("fp"), bits, key_bytes)).select(F.col("node").alias("fp"), "component")
    placed = materialise(nodes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(placed.select("fp", "n", "component").join(least, "component").select("fp", "n", "component_id"))
    return join_keys(marks, named, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = 4, bits: int = 4) -> DataFrame:
    """The documents, all columns whatever their names, less those that are not the component_id of their group.

    Rows that repeat a doc_id stay or go together, and go if any of them is not the
    component_id of its group; a row without a doc_id stays.
    """
    found = near_duplicates(docs, size, bits)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
