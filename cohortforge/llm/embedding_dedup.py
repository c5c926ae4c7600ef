"""Embedding near-duplicates: inverted lists, product-quantised residuals, exact cosine rerank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.components import components
from cohortforge.llm.grouped import bounds, whole_groups
from cohortforge.llm.shared import join_keys, materialise, small_batches

#: The quantisers are fitted on at most so many vectors (those of the least hash of vec_id).
SAMPLE = 32_768
#: Vectors for one inverted list on average, and most coarse centroids.  Where these are too few,
#: lists are parted by the codewords of their first subspaces, as many as it takes.
PER_LIST, CENTROIDS = 4096, 8192
SUBSPACES, CODEWORDS = 8, 64
#: Base and query rows that one group of a task holds on average at most.
BASE_BLOCK, QUERY_BLOCK = 8192, 1024
#: Rows whose distances to all centroids or codes are held at once.
ROWS = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids of Lloyd's algorithm; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_index(x, centre)
        n = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[n > 0] = total[n > 0] / n[n > 0][:, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid, and all squared distances (rows of x by centroids)."""
    d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(axis=1)[None, :], 0)
    return d.argmin(axis=1), d


def nearest_index(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid, ``ROWS`` rows of x at a time."""
    return np.concatenate([nearest(x[at : at + ROWS], centre)[0] for at in range(0, len(x), ROWS)]) if len(x) else np.zeros(0, np.int64)


def near_planes(d: np.ndarray, own: int, centre: np.ndarray, radius: float) -> np.ndarray:
    """Which centroids can be nearest to a vector within ``radius`` of one whose squared distances are ``d`` and whose nearest is ``own``.

    A vector belongs to its nearest centroid, so c holds one near x only if x is at
    most ``radius`` from the plane between c and x's own centroid.
    """
    gap = centre - centre[own]
    apart = np.sqrt((gap * gap).sum(axis=1))
    out = (d - d[own]) / (2 * np.maximum(apart, 1e-12)) <= radius + 1e-9
    out[own] = True
    return out


class Quantiser:
    """Coarse centroids, and codewords of the residuals in each subspace; a list is a centroid and ``depth`` first codewords."""

    def __init__(self, sample: np.ndarray, lists: int, depth: int = 0):
        self.depth = depth
        self.centre = kmeans(sample, lists)
        residual = sample - self.centre[nearest_index(sample, self.centre)]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        self.words = [kmeans(np.ascontiguousarray(residual[:, p]), CODEWORDS) for p in self.parts]
    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each residual is from what its code stands for."""
        codes = np.stack([nearest(residual[:, p], w)[0] for p, w in zip(self.parts, self.words, strict=True)], axis=1).astype(np.uint8)
        rest = residual.copy()
        for m, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            rest[:, p] -= w[codes[:, m]]
        return codes, np.sqrt((rest * rest).sum(axis=1))

    def lists(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Number of the list of each vector."""
        out = own.astype(np.int64)
        for m in range(self.depth):
            out = out * CODEWORDS + codes[:, m]
        return out

    def probes(self, x: np.ndarray, d: np.ndarray, own: np.ndarray, radius: float) -> list[np.ndarray]:
        """Lists that can hold a vector within ``radius``, by the planes between centroids and between codewords.

        The residual of such a vector to one centroid is within ``radius`` of x's to the
        same centroid, and so it is in each subspace.
        """
        out = []
        for i, a in enumerate(own):
            found = [np.flatnonzero(near_planes(d[i], int(a), self.centre, radius))]
            for m in range(self.depth):
                part, w = self.parts[m], self.words[m]
                deeper = []
                for at in found[-1].tolist():
                    rest = x[i : i + 1] - self.centre[at // CODEWORDS**m]
                    nearest_word, to_words = nearest(rest[:, part], w)
                    deeper.append(at * CODEWORDS + np.flatnonzero(near_planes(to_words[0], int(nearest_word[0]), w, radius)))
                found.append(np.concatenate(deeper))
            out.append(found[-1].astype(np.int64))
        return out

    def distances(self, query: np.ndarray, lst: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances from tables: exact query residual to the coded residuals of a list."""
        residual = query - self.centre[lst // CODEWORDS**self.depth]
        total = np.zeros((len(query), len(codes)))
        for m, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            total += nearest(residual[:, p], w)[1][:, codes[:, m]]
        return np.sqrt(total)


class Forest:
    """Components of nodes whose links come in parts."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.unique(ids)
        self.root = np.arange(len(self.ids))
        self.seen = np.zeros(len(self.ids), bool)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        a, b = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)
        self.seen[a] = self.seen[b] = True
        root = self.root
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            for at in (a, b, root[a], root[b]):
                np.minimum.at(new, at, low)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        self.root = root

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each node that has a link, and the least node that it reaches."""
        return self.ids[self.seen], self.ids[self.root[self.seen]]


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter rows filled with zeros."""
    n = len(column)
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return values.reshape(n, width)
    out = np.zeros((n, width))
    for i, (s, e) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)):
        out[i, : e - s] = values[s:e]
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Two vectors link if their labels are equal and not null, their lengths are equal
    and their cosine in double precision is at least ``threshold``.  A vector that is
    null, empty, zero or holds a null or non-finite component links with nothing.
    Equal vectors of one label are one node with a multiplicity, and link with each
    other, so repeated rows do too.  n_links counts the other rows linked directly;
    component_id is the least vec_id reachable; kept marks the row that is it.  A row
    without a vec_id links like any other: it is kept only where no row of its group has
    an id, and component_id is null then.  Other columns are not looked at.

    Each vector stands once, in the list of its nearest centroid, and its code is sent to
    all lists that can hold a neighbour.  There the vectors of the list meet the codes:
    the table-lookup distance, less the known error of the code, is a lower bound.
    Vectors whose code it lets through are then sent too and compared exactly, so no
    link is lost.  Lists of many vectors are dealt out in blocks.  Of the
    links inside a group only a spanning forest is passed on, and their number.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("lab"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("lab").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(valid)
    # nodes are numbered by their place in the written table: a vec_id may be null
    reps = materialise(good.groupBy("lab", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult")).withColumn("rep", F.monotonically_increasing_id()))
    n, width = reps.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not n:
        return alone.withColumn("kept", F.lit(True))
    sample = reps.select("v").orderBy(F.xxhash64("lab", "v"), "lab").limit(SAMPLE).toArrow().column("v").combine_chunks()
    unit = _matrix(sample, width)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    lists, depth = max(round(n / PER_LIST), 1), 0
    while lists > CENTROIDS * CODEWORDS**depth and depth < min(SUBSPACES, width):
        depth += 1
    held = spark.sparkContext.broadcast(Quantiser(unit, min(lists, CENTROIDS), depth))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def place(batches):
        q = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _matrix(batch.column("v"), width)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                own, d = nearest(x, q.centre)
                codes, error = q.encode(x - q.centre[own])
                probes = q.probes(x, d, own, radius)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("lab", "rep", "mult", "v")), pa.array(q.lists(own, codes)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int64()))],
                    ["lab", "rep", "mult", "v", "list", "code", "error", "probes"],
                )

    kind = dict(reps.dtypes)["v"]
    placed = materialise(reps.mapInArrow(place, f"lab string, rep long, mult long, v {kind}, list long, code binary, error double, probes array<long>").withColumn("dim", F.size("v")))
    key = ["lab", "dim", "list"]
    groups = [*key, "b", "q"]

    def dealt(base: DataFrame, query: DataFrame) -> DataFrame:
        """Base and query rows of each list in blocks, each base block beside each query block."""
        size = lambda table, block, name: table.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name))
        sizes = materialise(size(base, BASE_BLOCK, "nb").join(size(query, QUERY_BLOCK, "nq"), key))
        deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rest = [c for c in base.columns if c not in key]
        b = base.join(sizes, key).select(*key, deal("nb").alias("b"), each("nq").alias("q"), F.lit(0).alias("kind"), *rest)
        q = query.join(sizes, key).select(*key, each("nb").alias("b"), deal("nq").alias("q"), F.lit(1).alias("kind"), *(F.col(c) if c in query.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in rest))
        return b.union(q).repartition(*groups).sortWithinPartitions(*groups, "kind")

    def parts(batches):
        """Whole groups of base and query rows."""
        for table in whole_groups(batches, groups, 8192):
            cols = [table.column(c).to_numpy(zero_copy_only=False) for c in groups]
            kinds = table.column("kind").to_numpy()
            at = bounds(*cols)
            for s, e in zip(at[:-1], at[1:], strict=True):
                cut = s + int((kinds[s:e] == 0).sum())
                if cut not in (s, e):
                    yield table.slice(s, cut - s), table.slice(cut, e - cut), int(cols[2][s])

    def unit_rows(table) -> np.ndarray:
        x = _matrix(table.column("v").combine_chunks(), width)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def meet(batches):
        """(rep, list, side) of the base rows and query rows that have a partner by the lower bound; base rows are codes from any list."""
        quantiser = held.value
        for base, query, lst in parts(batches):
            base = base.sort_by("own")
            codes = np.frombuffer(b"".join(base.column("code").to_pylist()), np.uint8).reshape(len(base), -1)
            error, own = base.column("error").to_numpy(), base.column("own").to_numpy()
            x, ids, asks = unit_rows(query), base.column("rep").to_numpy(), query.column("rep").to_numpy()
            found, asking, runs = np.zeros(len(base), bool), np.zeros(len(query), bool), bounds(own)
            for at in range(0, len(x), ROWS):
                apart = [quantiser.distances(x[at : at + ROWS], int(own[s]), codes[s:e]) for s, e in zip(runs[:-1], runs[1:], strict=True)]
                near = np.concatenate(apart, axis=1) - error[None, :] <= radius + 1e-7
                near &= asks[at : at + ROWS, None] != ids[None, :]
                found |= near.any(axis=0)
                asking[at : at + ROWS] = near.any(axis=1)
            some = np.concatenate((ids[found], asks[asking]))
            if len(some):
                side = np.concatenate((np.zeros(found.sum(), np.int32), np.ones(asking.sum(), np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), lst, np.int64)), pa.array(side)], ["rep", "list", "kind"])

    coded = placed.select("lab", "dim", F.explode("probes").alias("list"), "rep", F.col("list").alias("own"), "code", "error", F.lit(None).cast(kind).alias("v"))
    passed = materialise(dealt(coded, placed.select(*key, "rep", "v")).mapInArrow(meet, "rep long, list long, kind int").distinct())

    def search(batches):
        for base, query, _ in parts(batches):
            x, y, ids, asks, mult = unit_rows(query), unit_rows(base), base.column("rep").to_numpy(), query.column("rep").to_numpy(), base.column("mult").to_numpy()
            linked, root = np.zeros(len(query), np.int64), Forest(np.concatenate((asks, ids)))
            for at in range(0, len(x), ROWS):
                qi, bi = np.nonzero((x[at : at + ROWS] @ y.T >= threshold - 1e-9) & (asks[at : at + ROWS, None] != ids[None, :]))
                keep = np.einsum("ij,ij->i", x[qi + at], y[bi]) >= threshold
                qi, bi = qi[keep] + at, bi[keep]
                linked += np.bincount(qi, weights=mult[bi], minlength=len(query)).astype(np.int64)
                root.join(asks[qi], ids[bi])
            some = linked > 0
            if some.any():
                nodes, least = root.links()
                a, b = np.concatenate((asks[some], nodes)), np.concatenate((asks[some], least))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate((linked[some], np.zeros(len(nodes), np.int64)))), pa.array(b)], ["a", "n", "b"])

    whole = placed.select("lab", "dim", "rep", "mult", "v")
    side = lambda k: passed.where(F.col("kind") == k).select("rep", "list").join(whole, "rep").select(*key, "rep", "mult", "v")
    found = materialise(dealt(side(0), side(1)).mapInArrow(search, "a long, n long, b long"))
    linked = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(spark, found.select("a", "b")).withColumnRenamed("node", "rep")
    named = materialise(reps.join(linked, "rep", "left").join(joined, "rep", "left").select("lab", "v", "mult", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(named.drop("least").join(least, "component").select(F.struct("lab", "v").alias("key"), "mult", "n_links", "component_id"))
    out = join_keys(good.select("vec_id", F.struct("lab", "v").alias("key")), named, "key", "mult").select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
good AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach(node, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT r.node AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(r.other) AS component_id, r.node = min(r.other) AS kept
FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) k ON k.a = r.node GROUP BY r.node
"""
