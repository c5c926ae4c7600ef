"""Centroid clustering of integer vectors by filtering through kd-trees.

Every partition cuts its vectors into blocks and builds a kd-tree of each, once.  A
node holds its count, the exact integer sums of its vectors and their box.  In a round
the candidates of a node are those of its parent less every one that another beats strictly
at each point of the box; a node with one candidate left is assigned as a whole, by its
count and sums, and in a leaf that keeps more each vector is compared with them exactly.
Only counts and sums by centroid leave a task, so nothing is shuffled by a key that grows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.shared import materialise, release

#: Vectors of one tree, and of one leaf.
TREE_ROWS, LEAF_ROWS = 8192, 32

#: Components are below this size, so that no distance or bound leaves 64 bits.
LIMIT = 1 << 26

#: Up to this size all sums of products of 64 components are exact in doubles too.
_EXACT = 1 << 21

_TREES = "ids array<bigint>, points binary, nodes binary, low binary, high binary, sums binary"


def quantise(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers; beyond ``LIMIT`` an error, as squared distances would not fit."""
    v = np.floor(x * scale)
    if len(v) and np.abs(v).max() >= LIMIT:
        raise ValueError(f"components reach {np.abs(v).max():.0f} after scaling, {LIMIT} is the bound")
    return v.astype(np.int32)


class Tree:
    """A kd-tree; nodes are rows of (start, stop, left child, right child), children -1 in a leaf."""

    def __init__(self, ids: pa.Array, points: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.ids, self.points, self.nodes, self.low, self.high, self.sums = ids, points, nodes, low, high, sums

    @classmethod
    def build(cls, ids: pa.Array, points: np.ndarray) -> Tree:
        """Halves at the median of the widest side, until a leaf is small or all its vectors are equal."""
        order = np.arange(len(points))
        nodes, low, high, sums = [[0, len(points), -1, -1]], [], [], []
        at = 0
        while at < len(nodes):
            start, stop = nodes[at][:2]
            rows = order[start:stop]
            inside = points[rows]
            low.append(inside.min(axis=0))
            high.append(inside.max(axis=0))
            sums.append(inside.sum(axis=0, dtype=np.int64))
            width = high[-1].astype(np.int64) - low[-1]
            if stop - start > LEAF_ROWS and width.any():
                half = (stop - start) // 2
                order[start:stop] = rows[np.argpartition(inside[:, int(width.argmax())], half)]
                nodes[at][2:] = [len(nodes), len(nodes) + 1]
                nodes += [[start, start + half, -1, -1], [start + half, stop, -1, -1]]
            at += 1
        return cls(ids.take(pa.array(order)), points[order], np.array(nodes, np.int32), np.array(low), np.array(high), np.array(sums))

    def row(self) -> list:
        return [self.ids.to_pylist(), *(a.tobytes() for a in (self.points, self.nodes, self.low, self.high, self.sums))]

    @classmethod
    def of_row(cls, batch: pa.RecordBatch, i: int, width: int) -> Tree:
        held = lambda name, kind, w: np.frombuffer(batch.column(name)[i].as_buffer(), kind).reshape(-1, w)
        return cls(batch.column("ids")[i].values, held("points", np.int32, width), held("nodes", np.int32, 4), held("low", np.int32, width), held("high", np.int32, width), held("sums", np.int64, width))

    def assign(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroid of each vector, and counts and sums by centroid, all exact; of equal distances the smaller number."""
        k = len(centres)
        size = max(int(np.abs(a).max(initial=0)) for a in (self.low[0], self.high[0], centres))
        number = np.float64 if size <= _EXACT else np.int64
        c = centres.astype(number)
        norm = (c * c).sum(axis=1)
        apart = [np.abs(c - b) for b in c]
        worst = np.inf if number is np.float64 else np.iinfo(np.int64).max
        label = np.empty(len(self.points), np.int32)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, centres.shape[1]), np.int64)
        level, live = np.zeros(1, np.int64), np.ones((1, k), bool)
        while len(level):
            low, high = self.low[level].astype(number), self.high[level].astype(number)
            middle, side = low + high, high - low
            toward = middle @ c.T
            best = np.where(live, norm - toward, worst).argmin(axis=1)
            reach = np.empty((len(level), k), number)
            for b in np.unique(best):
                reach[best == b] = side[best == b] @ apart[b].T
            # |p - best|^2 - |p - z|^2 is linear in p; its maximum over the box is at a corner
            most = norm[best][:, None] - norm + toward - np.take_along_axis(toward, best[:, None], axis=1) + reach
            live &= most >= 0
            start, stop, left, right = self.nodes[level].T
            one = live.sum(axis=1) == 1
            for i in np.flatnonzero(one):
                label[start[i] : stop[i]] = best[i]
            np.add.at(counts, best[one], stop[one] - start[one])
            np.add.at(sums, best[one], self.sums[level[one]])
            leaf = np.flatnonzero(~one & (left < 0))
            if len(leaf):
                at = np.concatenate([np.arange(start[i], stop[i]) for i in leaf])
                may = np.repeat(live[leaf], stop[leaf] - start[leaf], axis=0)
                points = self.points[at]
                label[at] = near = np.where(may, norm - 2 * (points.astype(number) @ c.T), worst).argmin(axis=1)
                counts += np.bincount(near, minlength=k)
                np.add.at(sums, near, points.astype(np.int64))
            inner = np.flatnonzero(~one & (left >= 0))
            level = np.concatenate((left[inner], right[inner])).astype(np.int64)
            live = np.concatenate((live[inner], live[inner]))
        return label, counts, sums


def _trees(kept: DataFrame, width: int, scale: float) -> DataFrame:
    """A row for each tree over at most ``TREE_ROWS`` vectors of a partition."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def trees(last: bool):
            table = pa.Table.from_batches(held).combine_chunks()
            cut = len(table) if last else len(table) // TREE_ROWS * TREE_ROWS
            for s in range(0, cut, TREE_ROWS):
                part = table.slice(s, min(TREE_ROWS, cut - s))
                flat = pa.concat_arrays(part.column("x").chunks).flatten().to_numpy(zero_copy_only=False)
                yield Tree.build(pa.concat_arrays(part.column("id").chunks), quantise(flat.reshape(-1, width), scale)).row()
            held[:] = table.slice(cut).to_batches()

        names = [f.split()[0] for f in _TREES.split(", ")]
        kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5]
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= TREE_ROWS:
                for row in trees(False):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)
        if held:
            for row in trees(True):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    return kept.mapInArrow(run, _TREES)


def _round(trees: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floored means of their vectors, empty ones as they were."""
    width = centres.shape[1]

    def run(batches):
        counts, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, n, s = Tree.of_row(batch, i, width).assign(centres)
                counts += n
                sums += s
        every = np.concatenate((counts[:, None], sums), axis=1)
        at, of = np.nonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(of.astype(np.int32)), pa.array(every[at, of])], ["cluster", "at", "total"])

    found = np.zeros((len(centres), width + 1), np.int64)
    for r in trees.mapInArrow(run, "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect():  # centroids times components
        found[r["cluster"], r["at"]] = r["total"]
    return np.where(found[:, :1] > 0, found[:, 1:] // np.maximum(found[:, :1], 1), centres)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: float = 64.0, start: str = "1:", id_col: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """vec_id, cluster and distance of every kept vector; and the centroids: cluster, centroid, n and inertia.

    Kept are vectors with exactly ``width`` components, none null or non-finite; others have
    no row.  Components become floor(scale * x).  The first centroids are the ``k`` vectors of the least
    SHA-256 of ``start`` and the id, all if there are fewer; equal hashes (repeated ids) go by
    the vectors, and vectors without an id start no centroid but are assigned.  Every row that repeats
    counts.  A distance is squared Euclidean; of equal ones the smaller number is taken.  Without
    a vector to start from, both tables are empty.
    """
    spark = vectors.sparkSession
    x = F.col(column).cast("array<double>")
    fine = (F.size(x) == width) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    first = kept.where("id is not null").orderBy(F.sha2(F.concat(F.lit(start), F.col("id").cast("string")), 256), "x").limit(k).collect()  # k rows
    centres = quantise(np.array([r["x"] for r in first], np.float64).reshape(len(first), width), scale).astype(np.int64)
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), spark.createDataFrame([], "cluster int, centroid array<long>, n long, inertia long")
    trees = materialise(_trees(kept, width, scale))
    for _ in range(rounds):
        centres = _round(trees, centres)

    def assigned(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree.of_row(batch, i, width)
                label, _, _ = tree.assign(centres)
                off = tree.points.astype(np.int64) - centres[label]
                yield pa.RecordBatch.from_arrays([tree.ids, pa.array(label), pa.array((off * off).sum(axis=1))], ["vec_id", "cluster", "distance"])

    out = materialise(trees.mapInArrow(assigned, "vec_id long, cluster int, distance long"))
    release(trees)
    facts = {r["cluster"]: r for r in out.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia")).collect()}  # k rows
    rows = [(i, c.tolist(), facts[i]["n"] if i in facts else 0, facts[i]["inertia"] if i in facts else 0) for i, c in enumerate(centres)]
    return out, spark.createDataFrame(rows, "cluster int, centroid array<long>, n long, inertia long")


def clustered(vectors: DataFrame, **parameters) -> DataFrame:
    """``cluster`` with the inertia of the row's cluster and of all, and the SHA-256 of its centroid's components."""
    out, centroids = cluster(vectors, **parameters)
    held = centroids.collect()  # k rows
    total = sum(r["inertia"] for r in held)
    digest = [(r["cluster"], r["inertia"], total, hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()) for r in held]
    facts = out.sparkSession.createDataFrame(digest, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle_sql(rounds: int = 3) -> str:
    """The production query in SQL, every round a pair of tables."""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16)",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, k, d FROM (SELECT vec_id, v, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM kept, c{r}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if r < rounds:
            mean = f"SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS dims(i) GROUP BY k, i"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, old.c) AS c FROM c{r} AS old LEFT JOIN (SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM ({mean}) GROUP BY k) AS m USING (k))")
    return f"""WITH {", ".join(steps)}
 SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


ORACLE_SQL = oracle_sql()
