"""LM scoring: Brown class-based bigrams with exchange clustering.

Every word of the corpus is placed by the exchange criterion.  The commonest words and
the endings of the others are exchanged one by one on the driver, which gives the
classes to start from.  Then all other words move at once, in Spark, each to the class
that most raises the likelihood of the class bigrams, by the starting classes to its left
and right over the whole corpus.  Head words are placed from counts that tasks hold, the rest from
all places where they stand, by the same tables, so results do not depend on how many
words a task holds.  Only a word that was never learned from has the class of its ending.

Texts are split twice, to count their words and to number them; all else reads the numbers.
Counts of cells and places of words travel packed, a row for each part or text.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.arrowtext import LOWER, SPACE, chunks, utf8
from cohortforge.llm.grouped import bounds, whole_groups
from cohortforge.llm.shared import materialise, release, small_batches

#: Words, of the highest counts, whose counts every task holds; the others are joined.
HEAD = 1 << 18
#: Items that are exchanged one by one: words of the highest counts, endings of all other words, the end, and the rest.
ITEMS = 1024
CLASSES = 64
SWEEPS = 6
ALPHA = 0.5  # added to each class transition

#: The end of a text among the words; a word never holds a space.
END = b" "
_END, _REST = 0, 1
#: Distinct words, and bytes of them, that a task counts before it sends them on.
_COUNTED, _COUNTED_BYTES = 400_000, 32 << 20
#: Bytes of text, and numbers of words, that a task works on at once.
_TEXT, _NUMBERS = 2 << 20, 1 << 18
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def ending(word: bytes) -> bytes:
    """What decides the class of a word that is no item itself: its last letters and the mark behind them."""
    core = word.rstrip(_MARKS)
    return core[-3:] + b" " + word[len(core) : len(core) + 1]


def words_of(column) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of all texts of a column, and how many each text has."""
    data, offs = utf8(column)
    data = LOWER[data]
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < len(data)]
    first[at] = inside[at]  # a word never goes on in the next text
    starts = np.flatnonzero(first)
    body = data[inside]
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, len(body)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return words, np.diff(np.searchsorted(starts, offs))


def word_counts(docs: DataFrame) -> DataFrame:
    """word and c: how often each word, and the end, stands in the texts."""

    def run(batches):
        words: list[pa.Array] = []
        times: list[np.ndarray] = []

        def add(some: pa.Array, n: np.ndarray | None):
            code = some.dictionary_encode()
            words.append(code.dictionary)
            times.append(np.bincount(code.indices.to_numpy(), weights=n, minlength=len(code.dictionary)).astype(np.int64))

        def merge():
            some, n = pa.concat_arrays(words), np.concatenate(times)
            words.clear()
            times.clear()
            add(some, n)

        def flush():
            out = pa.RecordBatch.from_arrays([words[0].cast(pa.string()), pa.array(times[0])], ["word", "n"])
            words.clear()
            times.clear()
            return out

        ends = 0
        for batch in chunks(batches, _TEXT):
            add(words_of(batch.column("text"))[0], None)
            ends += batch.num_rows
            if sum(map(len, words)) > 2 * _COUNTED or sum(w.nbytes for w in words) > 2 * _COUNTED_BYTES:
                merge()
                if len(words[0]) > _COUNTED or words[0].nbytes > _COUNTED_BYTES:
                    yield flush()
        if ends:
            words.append(pa.array([END], pa.binary()))
            times.append(np.array([ends]))
            merge()
            yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def head_words(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray, int]:
    """At most ``most`` words with the highest counts, none left out of those with one count; the end besides; the least count."""
    by_count = counts.groupBy("c").count().toArrow()
    c, n = by_count.column("c").to_numpy(), by_count.column("count").to_numpy()
    order = np.argsort(-c)
    fits = np.cumsum(n[order]) <= most
    least = int(c[order][fits].min()) if fits.any() else (int(c.max()) + 1 if len(c) else 1)
    table = counts.where((F.col("c") >= least) | (F.col("word") == END.decode())).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    return [w.encode() for w in table.column("word").to_pylist()], table.column("c").to_numpy(), least


class Items:
    """The items and the item of every word."""

    def __init__(self, words: list[bytes], endings: list[bytes]):
        self.of = {END: _END} | {w: 2 + i for i, w in enumerate(words)}
        self.by_ending = {e: 2 + len(words) + i for i, e in enumerate(endings)}
        self.n = 2 + len(words) + len(endings)

    def item(self, word: bytes) -> int:
        found = self.of.get(word)
        return self.by_ending.get(ending(word), _REST) if found is None else found


def choose_items(counts: DataFrame, n: int) -> Items:
    """The n / 2 commonest words, by name among equals, and the commonest endings of all others."""
    common = counts.where(F.col("word") != END.decode()).orderBy(F.desc("c"), "word").limit(n // 2)
    words = [r["word"].encode() for r in common.collect()]  # items
    own = set(words) | {END}

    def run(batches):
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for w, c in zip(batch.column("word").cast(pa.binary()).to_pylist(), batch.column("c").to_pylist(), strict=True):
                if w not in own:
                    seen[ending(w)] += c
            if len(seen) > 400_000:
                yield from rows(seen)
        yield from rows(seen)

    def rows(seen):
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["ending", "n"])
            seen.clear()

    found = counts.mapInArrow(run, "ending binary, n long").groupBy("ending").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "ending").limit(n - 2 - len(words)).toArrow()
    return Items(words, [bytes(e) for e in top.column("ending").to_pylist()])


def numbered(texts: DataFrame, head: list[bytes], items: Items) -> DataFrame:
    """The words of each text by number, in ``ids`` (binary, 32-bit integers), and its words that are no head words, in ``tails``.

    The number of a head word is its place among these, that of another word minus one less its item.
    ``texts`` has doc_id, d, h, learned and text; all but the text are kept.
    """
    held = texts.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(head) if w != END}, items))

    def run(batches):
        index, items = held.value
        none = len(index) + 1  # the end is a head word as well
        for batch in chunks(batches, _TEXT):
            words, size = words_of(batch.column("text"))
            code = words.dictionary_encode()
            names = code.dictionary.to_pylist()
            number = np.fromiter(map(index.get, names, repeat(none)), np.int32, len(names))
            for i in np.flatnonzero(number == none).tolist():
                number[i] = -1 - items.item(names[i])
            ids = number[code.indices.to_numpy()]
            tail = np.concatenate(([0], np.cumsum(ids < 0)))
            ends = np.concatenate(([0], np.cumsum(size)))
            own = pa.ListArray.from_arrays(pa.array(tail[ends], pa.int32()), words.take(pa.array(np.flatnonzero(ids < 0))).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "d", "h", "learned")), packed(ids, ends), pc.binary_join(own, " ")], ["doc_id", "d", "h", "learned", "ids", "tails"])

    return texts.select("doc_id", "d", "h", "learned", "text").mapInArrow(run, "doc_id long, d long, h long, learned boolean, ids binary, tails string")


def packed(values: np.ndarray, at: np.ndarray) -> pa.BinaryArray:
    """The values from each place of ``at`` up to the next, as bytes."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def unpacked(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a column of ``packed``, and where each row begins, and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.cast(pa.binary()).buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), (offs - offs[0]) // size


def numbers_of(batches):
    """Slices of the batches of about ``_NUMBERS`` words, texts never cut; the numbers of their words, an end (-1) behind each text; where ends stand."""
    for batch in batches:
        ids, offs = unpacked(batch.column("ids"), np.int32)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offs, offs[start] + _NUMBERS, "right")) - 1)
            ends = offs[start + 1 : stop + 1] - offs[start] + np.arange(stop - start)
            word = np.ones(int(ends[-1]) + 1, bool)
            word[ends] = False
            out = np.full(len(word), -1 - _END, np.int64)
            out[word] = ids[offs[start] : offs[stop]]
            yield batch.slice(start, stop - start), out, ends
            start = stop


def by_number(of_items: np.ndarray, of_head: np.ndarray) -> np.ndarray:
    """A table of what items and head words have, looked up at number + how many items there are."""
    return np.concatenate((of_items[::-1], of_head))


def cell_sums(rows: DataFrame, width: int) -> DataFrame:
    """part and cells (binary, ``width`` 64-bit integers): counts of ``packed_cells``, added up by part."""

    def run(batches):
        for table in whole_groups(batches, ["part"], 1):
            part, cell, n = (table.column(c) for c in ("part", "cell", "n"))
            part = part.to_numpy()
            at = bounds(part)
            (cell, offs), n = unpacked(cell, np.int32), unpacked(n, np.int32)[0]
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = slice(offs[lo], offs[hi])
                total = np.zeros(width, np.int64)
                np.add.at(total, cell[own], n[own].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(part[lo : lo + 1]), packed(total, np.array([0, width]))], ["part", "cells"])

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, cells binary")


def packed_cells(key: np.ndarray, n: np.ndarray, width: int):
    """Counts of cells (``key``, rising) as a row for each part, of ``width`` cells: part, cell and n (binary, 32-bit integers)."""
    part = key // width
    at = bounds(part)
    for lo in range(0, len(at) - 1, 64):
        some = at[lo : lo + 65]
        own = slice(some[0], some[-1])
        yield pa.RecordBatch.from_arrays([pa.array(part[some[:-1]].astype(np.int32)), *(packed(x.astype(np.int32), some - some[0]) for x in (key[own] % width, n[own]))], ["part", "cell", "n"])


_CELLS = "part int, cell binary, n binary"


def item_bigrams(docs: DataFrame, items: Items) -> np.ndarray:
    """How often one item follows another in the texts, each text between two ends."""
    texts = docs.select(*(F.lit(0).cast("long").alias(c) for c in ("doc_id", "d", "h")), F.lit(True).alias("learned"), "text")
    return numbered_bigrams(numbered(texts, [], items), items, np.zeros(0, np.int64))


def numbered_bigrams(learned: DataFrame, items: Items, of_head: np.ndarray) -> np.ndarray:
    """The same from the numbers of words and the items of head words."""
    m = items.n
    held = learned.sparkSession.sparkContext.broadcast(by_number(np.arange(m), of_head))

    def run(batches):
        item = held.value
        total = np.zeros(m * m, dtype=np.int64)
        for _, numbers, _ in numbers_of(batches):
            at = item[np.concatenate(([-1 - _END], numbers)) + m]
            np.add.at(total, at[:-1] * m + at[1:], 1)
        used = np.flatnonzero(total)
        yield from packed_cells(used, total[used], m)

    table = cell_sums(learned.select("ids").mapInArrow(run, _CELLS), m).toArrow()  # a row for each item
    out = np.zeros((m, m), dtype=np.int64)
    for part, cells in zip(table.column("part").to_pylist(), table.column("cells").to_pylist(), strict=True):
        out[part] = np.frombuffer(cells, np.int64)
    return out


def exchange_clusters(bigrams: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each item, by the exchange algorithm.

    Items are moved, one after the other by falling count, to the class that most
    raises the likelihood of the class bigram model, until a sweep moves none.  The
    end keeps a class of its own.
    """
    m = len(bigrams)
    count = bigrams.sum(axis=0)
    order = np.argsort(-count, kind="stable")
    order = order[order != _END]
    k = min(classes, m)
    cls = np.zeros(m, dtype=np.int64)
    cls[order] = 1 + np.arange(m - 1) % max(1, k - 1)
    if k < 3:
        return cls

    def f(x):
        return x * np.log(np.maximum(x, 1))

    onehot = np.zeros((m, k))
    onehot[np.arange(m), cls] = 1
    g = onehot.T @ bigrams @ onehot
    size = onehot.T @ count
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not count[w]:
                continue
            own = cls[w]
            right = np.bincount(cls, weights=bigrams[w], minlength=k)
            left = np.bincount(cls, weights=bigrams[:, w], minlength=k)
            self_n = float(bigrams[w, w])
            right[own] -= self_n
            left[own] -= self_n
            g[own, :] -= right
            g[:, own] -= left
            g[own, own] -= self_n
            size[own] -= count[w]
            gain = (f(g + right[None, :]) - f(g)).sum(axis=1) + (f(g + left[:, None]) - f(g)).sum(axis=0)
            d = np.diag(g)
            gain += f(d + right + left + self_n) - f(d + right) - f(d + left) + f(d)
            gain -= 2 * (f(size + count[w]) - f(size))
            gain[0] = -np.inf  # the end's
            new = int(np.argmax(gain))
            if gain[new] <= gain[own] + 1e-9:
                new = int(own)
            moved += new != own
            cls[w] = new
            g[new, :] += right
            g[:, new] += left
            g[new, new] += self_n
            size[new] += count[w]
        if not moved:
            break
    return cls


def place(contexts: np.ndarray, c: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """Class of each word that most raises the likelihood when the word moves there, in first order.

    ``contexts``: how often each class stands right of the word, then left of it, a row
    for each word; ``c``: its count.  The likelihood of class bigrams g with class sizes
    s is sum g log g - 2 sum s log s, so a few tokens with contexts R and L raise it in
    class b by R . log g(b, .) + L . log g(., b) - 2 c log s(b).  The end's class takes no word.
    """
    g = bigrams + ALPHA
    log_g = np.log(g)
    gain = contexts @ np.concatenate((log_g.T, log_g), axis=0) - 2 * c[:, None] * np.log(g.sum(axis=1))[None, :]
    if gain.shape[1] > 1:
        gain[:, 0] = -np.inf
    return gain.round(9).argmax(axis=1)


def class_bigrams(cls: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    k = int(cls.max()) + 1
    onehot = np.zeros((len(cls), k))
    onehot[np.arange(len(cls)), cls] = 1
    return onehot.T @ bigrams @ onehot


class Classes:
    """The items, the head words and the classes of both."""

    def __init__(self, items: Items, cls: np.ndarray, head: list[bytes], head_c: np.ndarray):
        self.items, self.cls, self.k, self.m = items, cls, int(cls.max()) + 1, len(cls)
        self.head_c = head_c
        self.head_item = np.array([items.item(w) for w in head], dtype=np.int64)
        #: Classes of the head words to start from, and those that they get.
        self.seed = self.head_class = cls[self.head_item]
        #: Head words that were exchanged one by one, and the end.
        self.settled = np.array([w in items.of for w in head], dtype=bool)
        self.end_c = int(head_c[head.index(END)]) if END in head else 0


#: Parts that the contexts of head words are dealt out in, and places of cells that a task holds before it counts them and sends them on.
_PARTS, _PLACES = 1024, 1 << 22


def head_classes(learned: DataFrame, start: Classes, bigrams: np.ndarray) -> np.ndarray:
    """Class of each head word, from the classes beside it in all texts; settled words keep theirs."""
    spark, n, k, m = learned.sparkSession, len(start.seed), start.k, start.m
    size = -(-n // _PARTS)
    width = max(size * 2 * k, 1)
    kind = np.int32 if _PARTS * width < 1 << 31 else np.int64
    held = spark.sparkContext.broadcast((by_number(start.cls, start.seed), start.head_c))

    def run(batches):
        cls = held.value[0]
        keys: list[np.ndarray] = []

        def counted():
            found = np.unique(np.concatenate(keys), return_counts=True)
            keys.clear()
            return packed_cells(*found, width)

        for _, at, _ in numbers_of(batches):
            of = cls[at + m]
            mine = np.flatnonzero(at >= 0)
            left = np.concatenate((cls[[m - 1 - _END]], of[:-1]))  # ahead of a text stands the end of the one before
            row = (at[mine] % _PARTS * size + at[mine] // _PARTS) * (2 * k)
            keys += [(row + of[mine + 1]).astype(kind), (row + k + left[mine]).astype(kind)]
            if sum(map(len, keys)) > _PLACES:
                yield from counted()
        if keys:
            yield from counted()

    def choose(batches):
        head_c = held.value[1]
        for batch in batches:
            for p, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                word = np.arange(size) * _PARTS + p
                word = word[word < n]
                found = place(np.frombuffer(cells, np.int64).reshape(size, 2 * k)[: len(word)].astype(np.float64), head_c[word], bigrams)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(found)], ["word", "class"])

    cells = cell_sums(learned.select("ids").mapInArrow(run, _CELLS), width)
    found = cells.mapInArrow(choose, "word long, class long").toArrow()  # a row for each head word
    out = start.head_class.copy()
    word, new = found.column("word").to_numpy(), found.column("class").to_numpy()
    out[word] = np.where(start.settled[word], out[word], new)
    return out


def _near(learned: DataFrame, classes: Classes) -> np.ndarray:
    """Class bigrams of neighbours that are head words or ends."""
    k, m = classes.k, classes.m
    held = learned.sparkSession.sparkContext.broadcast(by_number(classes.cls, classes.head_class))

    def run(batches):
        cls = held.value
        pairs = np.zeros(k * k, dtype=np.int64)
        for _, numbers, _ in numbers_of(batches):
            at = np.concatenate(([-1 - _END], numbers))
            known, of = at >= -1 - _END, cls[at + m]
            both = known[:-1] & known[1:]
            pairs += np.bincount(of[:-1][both] * k + of[1:][both], minlength=k * k)
        used = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(pairs[used])], ["pair", "n"])

    return _summed(learned.select("ids").mapInArrow(run, "pair int, n long"), k * k).reshape(k, k)


def _summed(rows: DataFrame, most: int) -> np.ndarray:
    table = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most ``most`` rows
    out = np.zeros(most)
    out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out


_TAIL = "d long, h long, pos int, word string, left int, right int, beside int, learned boolean"


def _scan(coded: DataFrame, classes: Classes) -> DataFrame:
    """Every place of a word that is no head word.

    ``left`` and ``right`` are the classes beside it; of a neighbour that is no head word
    either, minus one less the class of its ending.  ``beside``: the starting classes to the left, times k, and to the right.
    """
    k, m = classes.k, classes.m
    held = coded.sparkSession.sparkContext.broadcast((by_number(classes.cls, classes.head_class), by_number(classes.cls, classes.seed)))
    names = [c.split()[0] for c in _TAIL.split(", ")]

    def run(batches):
        final, start = held.value
        for batch, at, ends in numbers_of(batches):
            tail = np.flatnonzero(at < -1 - _END)
            if not len(tail):
                continue
            words, _ = words_of(batch.column("tails"))
            row = np.searchsorted(ends, tail)
            left, right = np.where(tail > 0, at[tail - 1], -1 - _END), at[tail + 1]
            beside = start[left + m] * k + start[right + m]
            left, right = (np.where(x < -1 - _END, -1 - final[x + m], final[x + m]) for x in (left, right))
            pos = tail - np.concatenate(([0], ends[:-1] + 1))[row]
            d, h, learned = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("d", "h", "learned"))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(h), pa.array(pos.astype(np.int32)), words.cast(pa.string()), *(pa.array(x.astype(np.int32)) for x in (left, right, beside)), pa.array(learned)], names)

    return coded.where("tails != ''").select("d", "h", "learned", "ids", "tails").mapInArrow(run, _TAIL)


def _placed(tail: DataFrame, classes: Classes, bigrams: np.ndarray) -> DataFrame:
    """The places of all words that are no head words, with count (0: never learned from) and class of the word.

    ``lead``: the count at one place of each word, else 0.
    """
    k = classes.k
    held = tail.sparkSession.sparkContext.broadcast((classes.items, classes.cls))

    def run(batches):
        items, cls = held.value
        own = pa.array([w for w in items.of if w != END], pa.binary()).cast(pa.string())
        for table in whole_groups(batches, ["word"], 1 << 15):
            code = table.column("word").combine_chunks().dictionary_encode()
            of, names = code.indices.to_numpy(), code.dictionary
            beside, learned = (table.column(c).to_numpy() for c in ("beside", "learned"))
            some, near = of[learned].astype(np.int64) * (2 * k), beside[learned]
            c = np.bincount(of[learned], minlength=len(names))
            contexts = np.bincount(np.concatenate((some + near % k, some + k + near // k)), minlength=len(names) * 2 * k)
            found = place(contexts.reshape(len(names), 2 * k).astype(np.float64), c, bigrams)
            for i in np.flatnonzero((c == 0) | pc.is_in(names, own).to_numpy(zero_copy_only=False)).tolist():  # never learned from, or exchanged one by one
                found[i] = cls[items.item(names[i].as_py().encode())]
            lead = np.zeros(len(of), np.int64)
            lead[np.unique(of, return_index=True)[1]] = c
            yield pa.RecordBatch.from_arrays([*(table.column(x).combine_chunks() for x in ("d", "h", "pos", "left", "right", "learned")), pa.array(c[of]), pa.array(found[of].astype(np.int32)), pa.array(lead)], _PLACED_NAMES)

    # whole_groups keeps the places of one word together: fewer than the least head word has, but for texts not learned from
    return tail.repartition("word").sortWithinPartitions("word").mapInArrow(run, _PLACED)


_PLACED = "d long, h long, pos int, left int, right int, learned boolean, c long, class int, lead long"
_PLACED_NAMES = [c.split()[0] for c in _PLACED.split(", ")]


def _in_order(placed: DataFrame, k: int) -> DataFrame:
    """Places packed by text, and sums over all of them.

    A text (d, h) has a row, or several if it goes over batches: ``known`` and ``base`` of its places, and packed in ``into`` and
    ``out`` the class bigrams that each place adds, from the left and to a head word on the right (else -1).
    In rows with ``pair``, ``n`` is to be added up: how often a class bigram is learned, then (from k * k on) the
    counts of the words of each class, then (from k * k + k on) the words.

    Places come in the order of their text, so the class of a left neighbour that is no
    head word is that of the place before.  A row of the table that is repeated gives each place
    several times: one is kept, but all are learned from.
    """
    keys = ["d", "h", "pos"]

    def run(batches):
        last, held = 0, None
        sums = np.zeros(k * k + 2 * k, np.int64)
        for batch in chain(batches, [None]):
            parts = ([] if held is None else held.to_batches()) + ([] if batch is None else [batch])
            table = pa.Table.from_batches(parts).combine_chunks() if parts else None
            if table is None or not len(table):
                continue
            d, h, pos, left, right, cls, c, learned, lead = (np.asarray(table.column(x)) for x in ("d", "h", "pos", "left", "right", "class", "c", "learned", "lead"))
            at = bounds(d, h, pos)
            if batch is not None:  # the last place may go on in the next batch
                held = table.slice(int(at[-2]))
                at = at[:-1]
                if len(at) < 2:
                    continue
            first, times = at[:-1], np.diff(at)
            own, before = cls[first].astype(np.int64), left[first].astype(np.int64)
            previous = np.concatenate(([last], own[:-1]))
            before = np.where(before < 0, previous, before)
            after = right[first].astype(np.int64)
            last = int(own[-1])
            into, out = before * k + own, np.where(after < 0, -1, own * k + after)
            seen = learned[first]
            np.add.at(sums, into[seen], times[seen])
            seen = seen & (out >= 0)
            np.add.at(sums, out[seen], times[seen])
            whole = slice(0, at[-1])
            np.add.at(sums, k * k + cls[whole], lead[whole])
            np.add.at(sums, k * k + k + cls[whole], (lead[whole] > 0).astype(np.int64))
            text = bounds(d[first], h[first])
            begin, n = text[:-1], len(text) - 1
            add = lambda x: pa.array(np.add.reduceat(x, begin))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(d[first][begin]), pa.array(h[first][begin]), add((c[first] > 0).astype(np.int64)), add(np.log10(c[first] + 1.0)), packed(into.astype(np.int32), text), packed(out.astype(np.int32), text), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], _ORDERED_NAMES)
        used = np.flatnonzero(sums)
        n = len(used)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(n, x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())), pa.array(used.astype(np.int32)), pa.array(sums[used])], _ORDERED_NAMES)

    return placed.repartition("d", "h").sortWithinPartitions(*keys).mapInArrow(run, _ORDERED)


_ORDERED = "d long, h long, known long, base double, into binary, out binary, pair int, n long"
_ORDERED_NAMES = [c.split()[0] for c in _ORDERED.split(", ")]


def score(docs: DataFrame, train: Column, head_size: int = HEAD, n_items: int = ITEMS, classes: int = CLASSES) -> DataFrame:
    """log10 probability of every whole text under the class bigram model, and under the unigram base.

    Learned from all rows where ``train`` holds.  A token's probability is that of its
    class after the class before it, (n + ALPHA) / (sum + ALPHA * classes), times
    (c + 1) / (N_class + V_class + 1) in its class, so the known words of a class and
    one unknown word make up one.  A text starts after an end and closes with one.
    Null texts count as empty, and learn like any other.  Returns doc_id, n_tokens,
    n_known, train_tokens, base_score, score, perplexity, a row for each row of
    ``docs``; rows that repeat a doc_id and its text, or have no doc_id and one text,
    have equal values.  Other columns are not looked at but by ``train``.
    """
    spark = docs.sparkSession
    small_batches(spark, 1 << 14)  # most of its rows are narrow
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("learned"))
    texts = texts.withColumns({"d": F.coalesce("doc_id", F.lit(0).cast("long")), "h": F.xxhash64("doc_id", "text")})
    counts = materialise(word_counts(texts.where("learned")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    head, head_c, _ = head_words(counts, head_size)
    items = choose_items(counts, n_items)
    release(counts)
    coded = materialise(numbered(texts, head, items))
    learned = coded.where("learned")
    pairs = numbered_bigrams(learned, items, np.array([items.item(w) for w in head], dtype=np.int64))
    cls = exchange_clusters(pairs, classes, SWEEPS)
    start = Classes(items, cls, head, head_c)
    k, m = start.k, start.m
    first = class_bigrams(cls, pairs)
    start.head_class = head_classes(learned, start, first)
    near = _near(learned, start)
    ordered = materialise(_in_order(_placed(_scan(coded, start), start, first), k))
    sums = _summed(ordered.where("pair is not null"), k * k + 2 * k)
    bigrams = near + sums[: k * k].reshape(k, k) + ALPHA
    transition = np.log10(bigrams / bigrams.sum(axis=1, keepdims=True))
    total = np.bincount(start.head_class, weights=head_c + 1.0, minlength=k) if len(head) else np.zeros(k)
    divisor = np.log10(total + sums[k * k :].reshape(2, k).sum(axis=0) + 1)
    known = np.zeros(m, bool)
    known[_END] = start.end_c > 0
    log_c = np.zeros(m)
    log_c[_END] = np.log10(start.end_c + 1.0)
    tables = by_number(cls, start.head_class), by_number(known, np.ones(len(head), bool)), by_number(log_c, np.log10(head_c + 1.0))
    held = spark.sparkContext.broadcast((tables, transition, divisor))

    def heads(batches):
        (cls, known, log_c), transition, divisor = held.value
        for batch, at, ends in numbers_of(batches):
            starts = np.concatenate(([0], ends[:-1] + 1))
            of, here = cls[at + m], at >= -1 - _END
            before = np.concatenate((cls[[m - 1 - _END]], of[:-1]))
            both = here & np.concatenate(([True], here[:-1]))
            per = np.where(both, transition[before, of], 0.0) - np.where(here, divisor[of], 0.0)
            add = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
            size, own_known, base, own = ends - starts + 1, add(known[at + m].astype(np.int64)), add(log_c[at + m]), add(per)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "d", "h")), pa.array(size, pa.int64()), pa.array(own_known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], ["doc_id", "d", "h", "n_tokens", "known", "base", "own"])

    def tails(batches):
        _, transition, divisor = held.value
        flat = np.append(transition.ravel(), 0.0)  # -1 is nothing
        for batch in batches:
            if batch.num_rows:
                (into, offs), out = unpacked(batch.column("into"), np.int32), unpacked(batch.column("out"), np.int32)[0]
                own = np.add.reduceat(flat[into] + flat[out] - divisor[into % k], offs[:-1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("d", "h", "known", "base")), pa.array(own)], ["d", "h", "known", "base", "own"])

    rest = ordered.where("pair is null").select("d", "h", "known", "base", "into", "out").mapInArrow(tails, "d long, h long, known long, base double, own double")
    rest = rest.groupBy("d", "h").agg(F.sum("known").alias("k2"), F.sum("base").alias("b2"), F.sum("own").alias("o2"))
    base = coded.select("doc_id", "d", "h", "ids").mapInArrow(heads, "doc_id long, d long, h long, n_tokens long, known long, base double, own double")
    joined = base.join(rest, ["d", "h"], "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    log_base = plus("base", "b2")
    whole = log_base + plus("own", "o2")
    return joined.select(
        "doc_id",
        "n_tokens",
        plus("known", "k2").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (log_base - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        whole.alias("score"),
        F.pow(F.lit(10.0), -whole / F.col("n_tokens")).alias("perplexity"),
    )
