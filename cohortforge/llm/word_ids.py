"""Ids of whole texts by a tokenizer of the library ``tokenizers``, its words remembered from text to text.

Any definition works: texts go to the library as they are.  For definitions that lower-case,
split into words and drop white space, a word's ids depend on the word alone.  Their texts are
split here, where all characters are in the first 256 of Unicode (which normalisation leaves as
they are), and each distinct word goes to the library once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from itertools import count

import numpy as np

#: Words, and bytes of them and their ids, that a task remembers; beyond them those met once are forgotten.
REMEMBER, REMEMBER_BYTES, LONG_WORD = 600_000, 96 << 20, 64

# The steps of the definitions whose texts are split here.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

# The same split for lower-cased text in one byte a character.
_LETTER, _DIGIT, _BLANK = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\x09-\x0d\x20\x85\xa0"
_words = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[%b]+|[%b]|[^%b]+" % (_LETTER, _DIGIT, _BLANK + _LETTER + _DIGIT)).findall

Key = bytes | str  # a split word, or what stands between white space and goes to the library as it is


class WordIds:
    """Encoder of one definition (the text of its JSON file)."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        held = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t["content"] for t in held.get("added_tokens", [])]
        split = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, _BYTES]}
        self.by_words = held.get("normalizer") == _NORMALIZER and held.get("pre_tokenizer") == split and held["model"].get("end_of_word_suffix") == "</w>"
        if self.by_words:
            plain = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _BYTES]}
            self.of_words = Tokenizer.from_str(json.dumps({**held, "normalizer": None, "added_tokens": [], "pre_tokenizer": plain}))
            vocabulary = held["model"]["vocab"]
            self.ends = np.zeros(1 + max(vocabulary.values()), bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._start()

    def _start(self) -> None:
        self.index: dict[Key, int] = defaultdict(count().__next__)
        self.first, self.length, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.held = 0

    def _forget(self) -> None:
        """Keep the words met more than once, where words or bytes are many; none of them where these alone are."""
        if len(self.index) <= REMEMBER and self.held <= REMEMBER_BYTES:
            return
        keep = {k: i for k, i in self.index.items() if self.used[i] > 1 and len(k) <= LONG_WORD}
        first, length, flat = self.first, self.length, self.flat
        self._start()
        if len(keep) <= REMEMBER // 2:
            at = np.fromiter(keep.values(), np.int64, len(keep))
            for k in keep:
                self.index[k]
            self._append(list(keep), _gather(flat, first[at], length[at]), length[at])

    def _append(self, words: list[Key], ids: np.ndarray, length: np.ndarray) -> None:
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.used = np.concatenate((self.used, np.zeros(len(length), np.int64)))
        self.flat = np.concatenate((self.flat, ids))
        self.held += 200 * len(words) + sum(map(len, words)) + 4 * len(ids)

    def _keys(self, text: str) -> list[Key]:
        plain = not any(s in text for s in self.special)
        if plain:
            try:
                return _words(text.lower().encode("latin-1"))
            except UnicodeEncodeError:
                pass
        out: list[Key] = []
        for chunk in text.encode().split():
            word = chunk.decode()
            if plain:
                try:
                    out += _words(word.lower().encode("latin-1"))
                    continue
                except UnicodeEncodeError:
                    pass
            out.append(word)
        return out

    def _learn(self, words: list[Key]) -> None:
        """Ids of new words, in the order of their numbers."""
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        split = [i for i, w in enumerate(words) if isinstance(w, bytes)]
        blocks = [split[i : i + 500] for i in range(0, len(split), 500)]
        for block, coded in zip(blocks, self.of_words.encode_batch_fast([" ".join(words[i].decode("latin-1") for i in b) for b in blocks], add_special_tokens=False), strict=True):
            found = np.array(coded.ids, np.uint32)
            for i, part in zip(block, np.split(found, np.flatnonzero(self.ends[found])[:-1] + 1), strict=True):
                ids[i] = part
        whole = [i for i, w in enumerate(words) if isinstance(w, str)]
        for i, coded in zip(whole, self.tokenizer.encode_batch([words[i] for i in whole], add_special_tokens=False), strict=True):
            ids[i] = np.array(coded.ids, np.uint32)
        self._append(words, np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.array([len(i) for i in ids], np.int64))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none of a null."""
        if not self.by_words:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        self._forget()
        before = len(self.index)
        number = self.index.__getitem__
        found = []
        for t in texts:
            keys = self._keys(t or "")
            found.append(np.fromiter(map(number, keys), np.int64, len(keys)))
        if len(self.index) > before:
            self._learn(list(self.index)[before:])
        if found:
            self.used += np.bincount(np.concatenate(found), minlength=len(self.index))
        return [_gather(self.flat, self.first[at], self.length[at]) for at in found]


def _gather(flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``first``, one behind the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first - ends + length, length) + np.arange(total)]


_built: dict[str, WordIds] = {}


def encoder(definition: str) -> WordIds:
    """The encoder of a definition; a worker process keeps it, and its words, from task to task."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = WordIds(definition)
    return _built[key]
