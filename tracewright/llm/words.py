"""Whole-text encoding with a public BPE vocabulary of words: white space is dropped, a word's last
token carries the word's end.

Such a vocabulary cuts a text before it looks at it (white space, runs of letters, digits, marks), so
words between spaces can be encoded once and remembered.  Words of letters, with one mark after them
or none, go to the library's model directly; others through the whole tokenizer.  Both give the
library's ids (tested).
"""

from __future__ import annotations

import gc
import json
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracewright.llm.arrays import ramps
from tracewright.llm.tokens import ALPHABET, _grown

#: Letters below U+0250 whose lower case is one letter (that of U+0130 is not), for a character class.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: Marks that end words; a run of them is one pre-token.
MARKS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Words that an encoder remembers at most, in two generations: a word stays while it is met again.
KNOWN_WORDS = 500_000
#: A word that ends a text; texts that hold it are encoded whole.
END = "\x00"


class WordEncoder:
    """ids of whole texts; remembers the ids of the words between spaces, tabs and line ends."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        # only with these steps words are independent of their neighbours, and letters one pre-token
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", ())]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())
        pattern = ((cuts[0].get("pattern") or {}).get("Regex", "") if cuts else "").split("|")
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and r"[\p{L}]+" in pattern and r"[^\s\p{L}\p{N}]+" in pattern
        self.lettered = re.compile(rf"([{LETTERS}]+)([{MARKS}]*)")
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.length = np.zeros(1 << 14, dtype=np.int64)
        self.met = np.zeros(1 << 14, dtype=bool)
        self.used = 0
        self._learn(["", END], [[], []])

    def _age(self) -> None:
        """Keeps the words met since the last call, and as few as half of the room at most."""
        stay = self.met[: len(self.known)].copy()
        stay[:2] = False
        old = np.flatnonzero(stay)
        if 2 * len(old) > KNOWN_WORDS:
            return self.forget()
        names = [w for w, k in zip(self.known, stay.tolist()) if k]
        flat, size = self._stored(old)
        self.forget()
        self._add(names, flat, size)

    def _add(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        first, n = len(self.known), len(words)
        self.flat = _grown(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start, self.length, self.met = (_grown(x, first + n) for x in (self.start, self.length, self.met))
        self.start[first : first + n], self.length[first : first + n] = self.used + np.cumsum(size) - size, size
        self.met[first : first + n] = False
        self.used += len(flat)
        self.known.update(zip(words, range(first, first + n)))

    def _learn(self, words: list[str], ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(words))
        self._add(words, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size)

    def _places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _stored(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of words by number, one after another, and how many each has."""
        size = self.length[places]
        return self.flat[np.repeat(self.start[places], size) + ramps(size)], size

    def _bare(self, words: list[str]) -> None:
        """Learns words that are one pre-token: letters only, or marks only."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if fresh:
            shown = "\n".join(fresh).lower().encode("utf-8").decode("latin-1").translate(ALPHABET).split(ALPHABET[10])
            tokenize = self.model.tokenize
            self._learn(fresh, [[t.id for t in tokenize(w)] for w in shown])

    def _new(self, words: list[str]) -> None:
        split = [m and m.groups() for m in map(self.lettered.fullmatch, words)]
        both = [(w, *m) for w, m in zip(words, split) if m and m[1]]
        self._bare([m[0] for m in split if m])
        self._bare([marks for *_, marks in both])
        # stem and mark by turns
        ids, size = self._stored(self._places([x for _, *parts in both for x in parts]))
        self._add([w for w, *_ in both], ids, size.reshape(-1, 2).sum(axis=1))
        rest = [w for w, m in zip(words, split) if not m]
        self._learn(rest, [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)] if rest else [])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after another (uint32), and how many each text has."""
        if len(self.known) > KNOWN_WORDS:
            self._age()
        whole = [k for k, t in enumerate(texts) if not self.by_word or END in t]
        apart = dict(zip(whole, [e.ids for e in self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)] if whole else []))
        text = "".join(f"{'' if k in apart else t} {END} " for k, t in enumerate(texts)) if apart else f" {END} ".join(texts) + f" {END} "
        for c in "\n\t\r":
            text = text.replace(c, " ")
        # the last space ends the last mark
        words = pc.split_pattern(pa.array([text], pa.large_string()), " ").flatten().dictionary_encode()
        del text
        # no word holds a space: the distinct ones come over as one string
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary.cast(pa.string())), " ")[0].as_py().split(" ")
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        self.met[at[at >= 0]] = True
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = [names[k] for k in fresh.tolist()]
            # what is made for each word is freed by its count alone: searching it for cycles took a fifth of the time
            searched = gc.isenabled()
            gc.disable()
            try:
                self._new(new)
            finally:
                if searched:
                    gc.enable()
            at[fresh] = self._places(new)
        place = at[words.indices.to_numpy()]
        flat, size = self._stored(place)
        sizes = np.diff(np.r_[0, np.cumsum(size)[place == self.known[END]]])
        if apart:
            flat = np.insert(flat, np.repeat([int(sizes[:k].sum()) for k in apart], [len(e) for e in apart.values()]), [x for e in apart.values() for x in e])
            for k, e in apart.items():
                sizes[k] = len(e)
        return flat, sizes


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
