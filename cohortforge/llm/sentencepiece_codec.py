"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

The distinct marked words of a batch are sorted, which is the order of a depth-first
walk through their trie: the next word keeps the forward states of the prefix that
it shares with the word before, and only the characters behind it are worked out.

For a unigram vocabulary the state of a prefix is its best score and the last piece
on that path.  For a merge vocabulary (BPE) there is exactly one encoding of every
prefix; its last piece is the one vocabulary piece that ends here and that stays
unmerged behind the last piece of the rest, i.e. the merges of the two pieces'
characters give back the two pieces.  Both give the ids of the model's own encoder.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.arrowtext import chunks
from cohortforge.llm.shared import small_batches

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"

#: Distinct words, and bytes of them and their ids, that a task remembers from batch to batch.
REMEMBER, REMEMBER_BYTES = 400_000, 64 << 20


class Vocabulary:
    """Pieces, scores and byte pieces of a model file; small, sent to every task."""

    def __init__(self, pieces: dict[str, int], scores: dict[int, float], byte_ids: dict[int, int], unknown: int, merges: bool):
        self.pieces, self.scores, self.byte_ids, self.unknown, self.merges = pieces, scores, byte_ids, unknown, merges
        self.key = hashlib.sha256(repr((sorted(pieces.items()), sorted(scores.items()), sorted(byte_ids.items()), unknown, merges)).encode()).hexdigest()

    @classmethod
    def load(cls, model_file: str = MODEL_FILE, merges: bool = True) -> Vocabulary:
        """Read a model file on the driver.  ``merges``: it is a BPE model, else unigram."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces, scores, octets = {}, {}, {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                octets[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = i
                scores[i] = model.get_score(i)
        return cls(pieces, scores, octets, model.unk_id(), merges)


class Codec:
    """Encoder and decoder."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text_of = {i: p for p, i in vocabulary.pieces.items()}
        size = 1 + max(chain(self.text_of, vocabulary.byte_ids.values(), [vocabulary.unknown]))
        self.bytes_of = [b""] * size
        for i, p in self.text_of.items():
            self.bytes_of[i] = p.replace(MARK, " ").encode()
        for value, i in vocabulary.byte_ids.items():
            self.bytes_of[i] = bytes([value])
        self.ending: dict = {}  # pieces by their characters from the last to the first; "" holds the id
        for p, i in vocabulary.pieces.items():
            node = self.ending
            for ch in reversed(p):
                node = node.setdefault(ch, {})
            node[""] = i
        self.stays: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0  # bytes of ``known``, about
        free = {ch for p in vocabulary.pieces for ch in p}
        self.breaks = "\n" not in free  # then a line break never merges, and words end before it
        self.split = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if self.breaks else rf"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.plain = not any(MARK in p.lstrip(MARK) for p in vocabulary.pieces)

    def merge(self, text: str) -> list[int]:
        """Ids by merging: always the adjacent pair whose joined piece scores highest, the leftmost of equals.

        A character that is no piece gets -1 - its code point.
        """
        pieces, scores = self.v.pieces, self.v.scores
        part = list(text)
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n:
                joined = part[i] + part[j]
                at = pieces.get(joined)
                if at is not None:
                    heapq.heappush(heap, (-scores[at], i, joined))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = right[i]
            if part[i] is None or j >= n or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [pieces.get(p, -1 - ord(p[0])) for p in part if p is not None]

    def _stays(self, a: int, b: int) -> bool:
        found = self.stays.get((a, b))
        if found is None:
            found = self.stays[a, b] = self.merge(self.text_of[a] + self.text_of[b]) == [a, b]
        return found

    def forget(self) -> None:
        """Let go of the words where they are many, or long, as lines without a space are."""
        if len(self.known) > REMEMBER or self.held > REMEMBER_BYTES:
            self.known.clear()
            self.held = 0

    def encode_words(self, words) -> None:
        """Remember the ids of new words, walking through their trie depth-first."""
        self.forget()
        if len(self.stays) > 4 * REMEMBER:
            self.stays.clear()
        ending, stays, merges, scores, text_of = self.ending, self.stays, self.v.merges, self.v.scores, self.text_of
        last: list[int] = [0]  # last piece of each prefix; below zero: a character that is no piece
        best: list[float] = [0.0]
        before = ""
        floor = min(scores.values(), default=0.0) - 10.0
        for word in sorted(words):
            if merges and word.startswith(MARK + MARK):  # pieces of marks alone have one score: merged directly
                self.known[word] = self._ids(self.merge(word))
                continue
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            before = word
            del last[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                node, j, take, top = ending, i, None, None
                while j:
                    j -= 1
                    node = node.get(word[j])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is None:
                        continue
                    if not merges:
                        value = best[j] + scores[piece]
                        if top is None or value > top:
                            take, top = piece, value
                        continue
                    if j:
                        prev = last[j]
                        if prev >= 0:
                            ok = stays.get((prev, piece))
                            if ok is None:
                                ok = self._stays(prev, piece)
                            if not ok:
                                continue
                        elif self.merge(text_of[piece]) != [piece]:
                            continue
                    elif self.merge(text_of[piece]) != [piece]:
                        continue
                    take = piece
                    break
                if take is None:
                    take, top = -1 - ord(word[i - 1]), best[i - 1] + floor
                last.append(take)
                best.append(top if top is not None else 0.0)
            ids, i = [], len(word)
            while i:
                piece = last[i]
                ids.append(piece)
                i -= len(text_of[piece]) if piece >= 0 else 1
            self.known[word] = self._ids(ids[::-1])

    def _ids(self, found: list[int]) -> tuple[int, ...]:
        """Characters that are no piece become their bytes, or the unknown id where the model has no byte pieces."""
        if all(p >= 0 for p in found):
            return tuple(found)
        out: list[int] = []
        for p in found:
            if p >= 0:
                out.append(p)
            elif self.v.byte_ids:
                out += [self.v.byte_ids[b] for b in chr(-1 - p).encode()]
            elif not out or out[-1] != self.v.unknown:
                out.append(self.v.unknown)
        return tuple(out)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts] if self.plain else [[MARK + t.replace(" ", MARK)] if t else [] for t in texts]
        new = set(chain.from_iterable(split))
        self.forget()
        new.difference_update(self.known)
        if new:
            self.encode_words(new)
            self.held += sum(100 + 4 * len(w) + 8 * len(self.known[w]) for w in new)
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]

    def decode(self, ids) -> str:
        """The text: pieces joined, marks as spaces, without the space that encoding puts first."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_built: dict[str, Codec] = {}


def codec_of(vocabulary: Vocabulary) -> Codec:
    """The codec of a vocabulary; a worker process keeps it, and the words it knows, from task to task."""
    if vocabulary.key not in _built:
        _built.clear()
        _built[vocabulary.key] = Codec(vocabulary)
    return _built[vocabulary.key]


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every whole text.

    Null and empty texts have no ids.  ``round_trip``: decoding the ids gives back the
    text (it does not where a text holds the mark U+2581, which decodes to a space).
    Rows that repeat and rows without a doc_id have a row each; other columns are not
    looked at.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())

    def run(batches):
        codec = codec_of(held.value)
        for batch in chunks(batches, 2 << 20):
            texts = batch.column("text").to_pylist()
            ids = codec.encode(texts)
            n = np.array([len(x) for x in ids], dtype=np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat))
            same = [codec.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), arrays, pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id and the text of each list of ``ids``; null ids give a null text, ids outside the model nothing."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())
    small_batches(encoded.sparkSession)

    def run(batches):
        codec = codec_of(held.value)
        top = len(codec.bytes_of)
        for batch in batches:
            texts = [None if ids is None else codec.decode([i for i in ids if i is not None and 0 <= i < top]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
