"""Suffix-array dedup: remove bytes that a long string covers which also starts earlier.

Where two texts can share a string of ``LENGTH`` bytes at all is found first.  Each
window of LENGTH bytes has an anchor: the least hash among its grams of ``GRAM`` bytes,
the leftmost of equals.  Equal windows have equal anchors at one place, so only
windows whose anchors hold the same gram need be compared.  The windows of one anchor
follow one another, and make up a stretch of at most 2 * LENGTH - GRAM bytes.

Stretches that are equal as a whole are told by hash and order alone.  Those that
share a gram and part of their surroundings, that is the rims of repeated passages,
are laid end to end in blocks, suffix-sorted in two stages, and windows whose
common prefix with a neighbour in that order reaches LENGTH are repeats of the
earliest of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.arrowtext import _BASE, _INVERSE, _power, chunks, hash_runs, mix, utf8
from cohortforge.llm.grouped import bounds, whole_groups
from cohortforge.llm.shared import materialise, small_batches
from cohortforge.llm.suffix_sort import adjacent_prefixes, suffix_array, words

LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1
#: Offsets of an anchor in its window, in four bands; windows of one band share a core around the anchor.
BANDS = ((0, 16), (17, 33), (34, 50), (51, 68))

#: An anchor gram is crowded if it has over so many different stretches in one task, and over this share of all anchors together.
CROWDED_IN_TASK, CROWDED_SHARE = 64, 1e-6
HELD = 1_500_000
_U = np.uint64
_POS_BITS, _LEN_BITS = 40, 7


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, place, first and last window of each anchor; places count from the start of ``data``."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(_U), none, none, none
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * _power("up", _BASE, n), out=sums[1:])
    least = mix((sums[GRAM:] - sums[:-GRAM]) * _power("down", _INVERSE, n + 1)[: n - GRAM + 1])
    grams = least
    at = np.zeros(len(least), dtype=np.uint8)
    span = 1
    while span < GRAMS:
        step = min(span, GRAMS - span)
        take = least[step:] < least[:-step]
        at = np.where(take, at[step:] + np.uint8(step), at[:-step])
        least = np.where(take, least[step:], least[:-step])
        span += step
    whole = np.zeros(n + 1, dtype=np.int32)
    sizes = np.diff(offs)
    some = sizes >= LENGTH
    np.add.at(whole, offs[:-1][some], 1)
    np.add.at(whole, (offs[:-1] + sizes - LENGTH + 1)[some], -1)
    window = np.flatnonzero(np.cumsum(whole)[: len(at)] > 0)
    if not len(window):
        return none.astype(_U), none, none, none
    place = window + at[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(window)) - 1
    return grams[place[start]], place[start], window[start], window[end]


def _cores(data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Four 16-bit marks, one for each band that the stretch has windows in (else 0), of the band's core."""
    out = np.zeros(len(place), dtype=_U)
    for k, (lo, hi) in enumerate(BANDS):
        has = (place - first >= lo) & (place - last <= hi)
        p = place[has]
        mark = (hash_runs(data, p - lo, p - hi + LENGTH) >> _U(48)) | _U(1)
        out[has] |= mark << _U(16 * k)
    return out


def _stretches(batch: pa.RecordBatch):
    """Anchors of a batch: gram, mark of the stretch, cores, doc_id, packed place, and the parts for crowded grams."""
    data, offs = utf8(batch.column("text"))
    gram, place, first, last = anchors(data, offs)
    row = np.searchsorted(offs, first, "right") - 1
    stretch = hash_runs(data, first, last + LENGTH) ^ mix((place - first).astype(_U) + _U(77))
    doc = batch.column("doc_id").to_numpy()[row]
    mark = batch.column("mark").to_numpy()[row]
    return data, gram, place, first, last, stretch, doc, mark, first - offs[row]


def _pack(mark: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (mark << _POS_BITS) | (start << _LEN_BITS) | length


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> _POS_BITS, (packed & ((1 << _POS_BITS) - 1)) >> _LEN_BITS, packed & ((1 << _LEN_BITS) - 1)


def crowded_grams(texts: DataFrame) -> np.ndarray:
    """Anchor grams with so many different stretches that they must not meet in one task.

    At most 1 / CROWDED_SHARE of them can be: each has over that share of all anchors.
    """

    def run(batches):
        total, grams, stretches = 0, [], []

        def count():
            g, s = np.concatenate(grams), np.concatenate(stretches)
            order = np.lexsort((s, g))
            g, s = g[order], s[order]
            new = np.ones(len(g), dtype=bool)
            new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
            values, n = np.unique(g[new], return_counts=True)
            many = n > CROWDED_IN_TASK
            return values[many].view(np.int64), n[many]

        def out(g, n, total):
            return pa.RecordBatch.from_arrays([pa.array(np.append(g, 0)), pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(g), np.int64), total))], ["gram", "n", "total"])

        held = 0
        for batch in chunks(batches, 1 << 20):
            _, gram, _, _, _, stretch, _, _, _ = _stretches(batch)
            grams.append(gram)
            stretches.append(stretch)
            held += len(gram)
            total += len(gram)
            if held > HELD:
                yield out(*count(), 0)
                grams, stretches, held = [], [], 0
        if held:
            yield out(*count(), total)
        elif total:
            yield out(np.zeros(0, np.int64), np.zeros(0, np.int64), total)

    counted = materialise(texts.mapInArrow(run, "gram long, n long, total long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    total = counted.agg(F.sum("total")).first()[0] or 0
    found = counted.where(F.col("n") > max(1024, int(total * CROWDED_SHARE))).select("gram").toArrow()
    return np.sort(found.column("gram").to_numpy())


def _posts(texts: DataFrame, crowded: np.ndarray) -> DataFrame:
    """One row for each different stretch of a task: gram, stretch, cores, doc_id, place.

    Later copies within the task are settled at once: rows with cores -1 that only
    pass through, windows from the packed place on to ``stretch``.  The windows of a
    crowded gram are posted one by one under their own hash.
    """
    held = texts.sparkSession.sparkContext.broadcast(crowded)

    def run(batches):
        crowd = held.value
        store: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in chunks(batches, 1 << 20):
            data, gram, place, first, last, stretch, doc, mark, start = _stretches(batch)
            cores = _cores(data, place, first, last)
            pos = _pack(mark, start, last - first)
            if len(crowd):
                at = np.searchsorted(crowd, gram.view(np.int64))
                hot = crowd[np.minimum(at, len(crowd) - 1)] == gram.view(np.int64)
                if hot.any():
                    h = np.flatnonzero(hot)
                    size = (last - first + 1)[h]
                    rep = np.repeat(h, size)
                    shift = np.arange(len(rep)) - np.repeat(np.cumsum(size) - size, size)
                    one = hash_runs(data, first[rep] + shift, first[rep] + shift + LENGTH)
                    store.append((one, mix(one), np.zeros(len(rep), _U), doc[rep], _pack(mark[rep], start[rep] + shift, np.zeros(len(rep), np.int64))))
                    n += len(rep)
                    cold = ~hot
                    gram, stretch, cores, doc, pos = gram[cold], stretch[cold], cores[cold], doc[cold], pos[cold]
            store.append((gram, stretch, cores, doc, pos))
            n += len(gram)
            if n > HELD:
                yield from settle(store)
                store, n = [], 0
        if n:
            yield from settle(store)

    def settle(store):
        gram, stretch, cores, doc, pos = (np.concatenate(c) for c in zip(*store, strict=True))
        order = np.lexsort((pos, doc, stretch, gram))
        gram, stretch = gram[order], stretch[order]
        later = np.zeros(len(order), dtype=bool)
        later[1:] = (gram[1:] == gram[:-1]) & (stretch[1:] == stretch[:-1])
        lead = ~later
        keep = order[lead]
        of = np.repeat(np.flatnonzero(lead), np.diff(np.append(np.flatnonzero(lead), len(order))))
        later &= (doc[order] != doc[order[of]]) | (pos[order] != pos[order[of]])  # a row that comes twice is no earlier start
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (gram[lead].view(np.int64), stretch[lead].view(np.int64), cores[keep].view(np.int64), doc[keep], pos[keep])], _POST)
        d, p = doc[order[later]], pos[order[later]]
        if len(d):
            order = np.lexsort((p, d))
            mark, start, length = _unpack(p[order])
            d, start, end = _joined(d[order], mark, start, start + length)
            mark, d = d[1], d[0]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (mix(d.astype(_U)).view(np.int64), end, np.full(len(d), -1), d, _pack(mark, start, np.zeros(len(d), np.int64)))], _POST)

    return texts.mapInArrow(run, "gram long, stretch long, cores long, doc_id long, pos long")


_POST = ["gram", "stretch", "cores", "doc_id", "pos"]


def _joined(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Neighbouring ranges of windows of a text put together, where one starts right behind the other or before its end."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] > end[:-1] + 1)
    at = np.flatnonzero(new)
    return (doc[at], mark[at]), start[at], np.maximum.reduceat(end, at) if len(at) else end


def _settled(posts: DataFrame) -> DataFrame:
    """Repeats (gram null) and rims (gram set) among the posts of all tasks: gram, doc_id, mark, first, last."""

    def run(batches):
        for table in whole_groups(batches, ["gram"]):
            gram, stretch, cores, doc, pos = (table.column(c).to_numpy() for c in _POST)
            passing = cores == -1
            mark, first, length = _unpack(pos)
            last = np.where(passing, stretch, first + length)
            order = np.lexsort((pos, doc, stretch, gram, passing))
            k = int((~passing).sum())
            o = order[:k]
            g, s = gram[o], stretch[o]
            later = np.zeros(k, dtype=bool)
            later[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
            # the same place can come twice where a row of the table is repeated: that is no earlier start
            same = np.zeros(k, dtype=bool)
            same[1:] = later[1:] & (doc[o[1:]] == doc[o[:-1]]) & (pos[o[1:]] == pos[o[:-1]])
            lead = np.flatnonzero(~later)
            of = np.repeat(lead, np.diff(np.append(lead, k)))
            is_first = (doc[o] == doc[o[of]]) & (pos[o] == pos[o[of]])
            repeats = np.concatenate((o[later & ~is_first & ~same], order[k:]))
            lead = o[~later]
            rim = np.zeros(len(lead), dtype=bool)
            for band in range(4):
                m = (cores[lead].view(_U) >> _U(16 * band)) & _U(0xFFFF)
                by = np.lexsort((m, gram[lead]))
                equal = (gram[lead[by[1:]]] == gram[lead[by[:-1]]]) & (m[by[1:]] == m[by[:-1]]) & (m[by[1:]] != 0)
                rim[by[1:][equal]] = True
                rim[by[:-1][equal]] = True
            rims = lead[rim]
            order = np.lexsort((first[repeats], mark[repeats], doc[repeats]))
            r = repeats[order]
            (d, mk), f, e = _joined(doc[r], mark[r], first[r], last[r])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((np.zeros(len(d), np.int64), gram[rims])), mask=np.concatenate((np.ones(len(d), bool), np.zeros(len(rims), bool)))),
                    *(pa.array(np.concatenate(c)) for c in ((d, doc[rims]), (mk, mark[rims]), (f, first[rims]), (e, last[rims]))),
                ],
                ["gram", "doc_id", "mark", "first", "last"],
            )

    return posts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "gram long, doc_id long, mark long, first long, last long")


def _sorted_rims(rims: DataFrame, texts: DataFrame) -> DataFrame:
    """Windows of rims that start with a string that an earlier one starts with too: doc_id, mark, first, last."""

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offs = utf8(batch.column("text"))
            first, last = batch.column("first").to_numpy(), batch.column("last").to_numpy()
            raw = data.tobytes()
            parts = [raw[o + f : o + e + LENGTH] for o, f, e in zip(offs[:-1].tolist(), first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("gram", "doc_id", "mark", "first")), pa.array(parts, pa.binary())], ["gram", "doc_id", "mark", "first", "part"])

    parts = rims.join(texts, ["doc_id", "mark"]).select("gram", "doc_id", "mark", "first", "last", "text").mapInArrow(cut, "gram long, doc_id long, mark long, first long, part binary")

    def compare(batches):
        for table in whole_groups(batches, ["gram"], 4096):
            column = table.column("part").combine_chunks()
            sizes = np.array([len(p) for p in column.to_pylist()], dtype=np.int64)
            data = np.frombuffer(b"\0".join([*column.to_pylist(), b""]), np.uint8)
            starts = np.cumsum(sizes + 1) - sizes - 1
            w = words(data, LENGTH + 8)
            order = suffix_array(data, LENGTH, w)
            part = np.searchsorted(starts, order, "right") - 1
            inside = order + LENGTH <= starts[part] + sizes[part]
            order, part = order[inside], part[inside]
            same = adjacent_prefixes(w, order, LENGTH) == LENGTH
            doc, mark, first = (table.column(c).to_numpy()[part] for c in ("doc_id", "mark", "first"))
            place = first + order - starts[part]
            run = np.cumsum(~same)
            by = np.lexsort((place, mark, doc, run))
            run, doc, mark, place = run[by], doc[by], mark[by], place[by]
            lead = bounds(run)
            of = np.repeat(lead[:-1], np.diff(lead))
            later = (doc != doc[of]) | (mark != mark[of]) | (place != place[of])
            doc, mark, place = doc[later], mark[later], place[later]
            if len(doc):
                by = np.lexsort((place, mark, doc))
                (doc, mark), f, e = _joined(doc[by], mark[by], place[by], place[by])
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(mark), pa.array(f), pa.array(e)], ["doc_id", "mark", "first", "last"])

    return parts.repartition("gram").sortWithinPartitions("gram").mapInArrow(compare, "doc_id long, mark long, first long, last long")


def _removed_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, text (null: empty), ``rest`` (a struct of the columns to keep), and first and last of the removed windows."""
    small_batches(docs.sparkSession)
    rest = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("boolean")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    every = every.withColumn("mark", F.xxhash64("text").bitwiseAND(F.lit((1 << 23) - 1)))
    texts = every.where(F.col("doc_id").isNotNull())
    bare = texts.drop("rest")
    found = materialise(_settled(_posts(bare, crowded_grams(bare))))
    dealt = texts.repartition("doc_id", "mark")
    rims = found.where(F.col("gram").isNotNull())
    spans = found.where(F.col("gram").isNull()).drop("gram").union(_sorted_rims(rims, dealt))
    spans = spans.groupBy("doc_id", "mark").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    joined = dealt.join(spans, ["doc_id", "mark"], "left")
    alone = every.where(F.col("doc_id").isNull()).withColumns({c: F.lit(None).cast("array<long>") for c in ("first", "last")})
    columns = ["doc_id", "text", "rest", "first", "last"]
    return joined.select(*columns).union(alone.select(*columns))


def _kept(batch: pa.RecordBatch):
    """Number of bytes, removed bytes, removed runs and remaining bytes of each text of a batch."""
    data, offs = utf8(batch.column("text"))
    firsts, lasts = batch.column("first"), batch.column("last")
    for i in range(batch.num_rows):
        own = data[offs[i] : offs[i + 1]]
        if not firsts[i].is_valid or not len(firsts[i]):
            yield len(own), 0, 0, own.tobytes()
            continue
        depth = np.zeros(len(own) + 1, dtype=np.int32)
        np.add.at(depth, firsts[i].values.to_numpy(), 1)
        np.add.at(depth, lasts[i].values.to_numpy() + LENGTH, -1)
        gone = np.cumsum(depth[:-1]) > 0
        yield len(own), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), own[~gone].tobytes()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A byte goes if a string of LENGTH bytes covers it that also starts earlier: in a
    document of smaller doc_id, or before in the same one.  Strings are those of the
    input, overlaps count, and none crosses documents.  Null texts are empty.  Rows
    that repeat a doc_id and its text are one document, each with its result; other
    texts of one doc_id come in the order of a hash.  A row without a doc_id is
    compared with none.
    """

    def run(batches):
        for batch in chunks(batches):
            n, removed, spans, left = zip(*_kept(batch), strict=True)
            digests = [hashlib.sha256(raw).hexdigest() for raw in left]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(removed), pa.array(spans), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _removed_spans(docs, []).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """The documents, all rows and columns, with the text that ``remove_repeats`` leaves.

    What is left of a character that was cut in two is dropped.  ``n_chars``, where
    there is such a column, is counted anew.  Null texts become empty.
    """

    def run(batches):
        for batch in chunks(batches):
            left = [raw.decode("utf-8", "ignore") for _, _, _, raw in _kept(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(left, pa.string())], ["rest", "text"])

    keep = [c for c in docs.columns if c != "text"]
    spans = _removed_spans(docs, keep)
    stripped = spans.mapInArrow(run, "rest " + spans.schema["rest"].dataType.simpleString() + ", text string")
    count = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in keep else None
    return stripped.select(*(F.col("text") if c == "text" else count.alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, s, md5(t[s + 1 : s + 100]) AS k FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 99)) AS s FROM d WHERE octet_length(t) >= 100)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM w) WHERE nth > 1),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM r)),
g AS (SELECT doc_id, island, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY ALL),
c AS (SELECT doc_id, coalesce(lag(b) OVER o, 0) AS a, a AS b FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY island) UNION ALL SELECT d.doc_id, coalesce(m.b, 0), octet_length(t) FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM g GROUP BY 1) m ON m.doc_id = d.doc_id),
p AS (SELECT d.doc_id, sha256(unhex(string_agg(hex(t[c.a + 1 : c.b]), '' ORDER BY c.a))) AS kept_sha256 FROM d JOIN c ON c.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256
FROM d JOIN p ON p.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM g GROUP BY 1) q ON q.doc_id = d.doc_id
"""
