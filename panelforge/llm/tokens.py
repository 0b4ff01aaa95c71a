"""Exact encoding with a public tokenizer file, word by word.

A byte-level or word-level BPE file splits a text into words before it merges, so the ids of a text are the ids of its
words in a row. Words repeat far more often than texts, hence each distinct word goes through the ``tokenizers`` library
once and its ids are kept in a bounded table. Texts outside the characters for which the split is known to agree with the
library's (anything beyond printable Latin-1, runs of white space, special-token strings) go through the library whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters and digits, white space, and signs for which Python and the library agree; ``_KIND`` names a character's class.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzªµºÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_KIND = bytearray(b"?" * 256)
for _c in range(33, 127):
    _KIND[_c] = ord("%")
for _c in "¡¢£¤¥¦§¨©«¬\xad®¯°±´¶·¸»¿×÷":
    _KIND[ord(_c)] = ord("%")
for _c in _LETTERS + "0123456789":
    _KIND[ord(_c)] = ord("a")
for _c in "\t\n\r ":
    _KIND[ord(_c)] = ord(" ")
for _c in ".,":
    _KIND[ord(_c)] = ord(".")
_MARKS = frozenset("\n\r\t\x01")


class _Codes(dict):
    """Numbers of words; those asked for the first time get the next number and are kept in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        code = self[word] = len(self)
        return code


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: how each character of the first 256 is written in the files' vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(256)}


class Encoder:
    """Ids of whole texts by one tokenizer file, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    ``most_words`` bounds the table of known words; when it is full, it is started anew.
    """

    def __init__(self, path: str, most_words: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = spec.get("normalizer") is not None
        self.by_word = self._known(spec)
        self.most_words = most_words
        self.alphabet = _alphabet()
        self.spaced = np.zeros(1 + max(self.library.get_vocab().values()), bool)
        self.spaced[[i for word, i in self.library.get_vocab().items() if word.startswith(self.alphabet[ord(" ")])]] = True
        self._clear()

    @staticmethod
    def _known(spec: dict) -> bool:
        """Whether the file is of one of the two kinds whose words can be split here."""
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") is None:
            return split.get("type") == "ByteLevel" and bool(split.get("use_regex")) and not split.get("add_prefix_space")
        kinds = [x.get("type") for x in spec["normalizer"].get("normalizers", [])]
        parts = [x.get("type") for x in split.get("pretokenizers", [])]
        return kinds == ["NFC", "Replace", "Lowercase"] and parts == ["Split", "ByteLevel"]

    def _clear(self) -> None:
        self.codes = _Codes()
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        is_marked = [self.lower or not w or w[0] in _MARKS for w in new]
        plain, marked = ([i for i, m in enumerate(is_marked) if m is kind] for kind in (False, True))
        first, sizes = self._in_a_row([new[i] for i in plain])
        which, got, apart = self._apart([new[i] for i in marked])
        lengths = np.concatenate([sizes, np.array(apart, np.int64)])
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        # new words have the next numbers in a row
        order = np.concatenate([np.array(plain, np.int64), np.array(marked, np.int64)[which]])
        lengths[order], starts[order] = lengths.copy(), starts.copy()
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, first, np.array(got, np.uint32)])

    def _in_a_row(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words with a space before them, many in a text: only a word's first id begins with a space."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = [" " + " ".join(words[i : i + 200]) for i in range(0, len(words), 200)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != len(words):
            raise ValueError("the tokenizer file doesn't split words at spaces")
        return ids, np.diff(at, append=len(ids))

    def _apart(self, words: list[str]) -> tuple[np.ndarray, list[int], list[int]]:
        """Which words, all their ids one word after the other, and how many each has; every word by itself.

        Words of letters are whole in the split and go straight to the library's merges, all others through its split. A list
        of ids for each word would keep Python's garbage collector busy.
        """
        merge, signs = self.library.model.tokenize, self.alphabet
        words = [(w or " ").removeprefix("\x01") for w in words]
        letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        which, rest = np.flatnonzero(letters), np.flatnonzero(~letters)
        ids: list[int] = []
        ends = [0]
        for i in which.tolist():
            ids += [t.id for t in merge(words[i].translate(signs))]
            ends.append(len(ids))
        for e in self.library.encode_batch_fast([words[i] for i in rest.tolist()], add_special_tokens=False):
            ids += e.ids
            ends.append(len(ids))
        return np.concatenate([which, rest]), ids, [b - a for a, b in zip(ends, ends[1:])]

    def _words(self, text: str) -> list[str] | None:
        """The words of a text, or None if it has to go through the library whole.

        In the byte-level split a space stood before a word unless it begins with \x01, a line break or a tab.
        """
        try:
            kinds = text.encode("latin-1").translate(_KIND)
        except UnicodeEncodeError:
            return None
        if not self.by_word or b"?" in kinds or "<|" in text or (not self.lower and b"  " in kinds):
            return None
        kinds = b" " + kinds + b" "
        # a comma or full stop after another sign belongs to that sign's word; elsewhere it is a word of its own
        if b"%. " not in kinds and b".. " not in kinds and b" . " not in kinds:
            glue = " " if self.lower else " \x01"
            text = text.replace(", ", glue + ", ").replace(". ", glue + ". ").replace(".\n", glue + ".\n")
            if text.endswith("."):
                text = text[:-1] + glue + "."
        if self.lower:
            return text.lower().split()
        for c in "\n\r\t":
            text = text.replace(c, f" {c} \x01")
        return ("\x01" + text).split(" ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one uint32 array, and where each text's begin (n + 1 offsets). Null counts as empty."""
        split = [self._words(t) if t else [] for t in texts]
        if len(self.codes) > self.most_words:
            self._clear()
        counts = np.fromiter((len(w) if w else 0 for w in split), np.int64, len(split))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(w for w in split if w)), np.int64, int(counts.sum()))
        if self.codes.new:
            self._learn()
        sizes = self.lengths[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))] if len(codes) else np.zeros(0, np.uint32)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        whole = [i for i, w in enumerate(split) if w is None]
        if not whole:
            return ids, bounds
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        for i, e in zip(whole, self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            parts[i] = np.array(e.ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_encoders: dict[str, Encoder] = {}


def encoder(path: str, most_words: int = 500_000) -> Encoder:
    """One encoder a worker process and file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, most_words)
    return _encoders[path]
