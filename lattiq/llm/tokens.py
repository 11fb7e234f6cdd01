"""Token ids of whole texts with the tokenizers library, word by word through a bounded cache.

For a tokenizer whose normalizer and pre-tokenizer never join or look across white space, the ids of a text
are the ids of its space-separated words in order. WordEncoder cuts texts at space, tab, line feed and
carriage return only (anything else is left to the library), encodes each new word once with the library and
keeps its ids. Byte-level tokenizers that mark spaces are encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept in each of the cache's two generations.
CACHE_WORDS = 200_000
#: A lower-cased word and its space: Latin letters that no normal form changes, then marks that are one token group
#: (no digit, apostrophe or angle bracket); or anything else.
_PARTS = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?|)(*$%&#+=-]*) |([^ ]*) ")
_LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
_ENCODERS: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> WordEncoder:
    """The process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs of the given sizes from the given starts, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Pool:
    """Words by number, and their ids one word after another in a growing array."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Take in new words; gives their numbers."""
        base, n = len(self.index), len(words)
        while base + n > len(self.starts):
            self.starts, self.sizes = np.append(self.starts, self.starts), np.append(self.sizes, self.sizes)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, self.ids)
        self.index.update(zip(words, range(base, base + n)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[base : base + n], self.sizes[base : base + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(flat)
        return np.arange(base, base + n)

    def find(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[numbers]
        return self.ids[_spread(self.starts[numbers], sizes)], sizes


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.by_word = _drops_space(spec)
        self.ends = _word_ends(spec) if self.by_word else None
        #: For words of lower-case letters alone: the same model without the steps that leave such words as they are.
        self.letters = Tokenizer.from_file(path)
        if self.ends is not None:
            from tokenizers import normalizers, pre_tokenizers

            self.letters.normalizer = normalizers.Sequence([])
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.young, self.old = _Pool(), _Pool()

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.fromiter(chain.from_iterable(parts), "<u4", int(sizes.sum())), sizes

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of lower-case letters go to the library joined by spaces, many in one call; the tokens that end a word
        tell them apart again."""
        flats, sizes = [], []
        for at in range(0, len(words), 5000):
            some = words[at : at + 5000]
            flat = np.array(self.letters.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[flat]) + 1
            size = np.diff(stops, prepend=0)
            if len(stops) != len(some) or stops[-1] != len(flat):
                flat, size = self._plain(some)
            flats.append(flat)
            sizes.append(size)
        return np.concatenate([np.zeros(0, "<u4"), *flats]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words in the young pool, new words taken in."""
        numbers = self.young.find(words)
        miss = np.flatnonzero(numbers < 0)
        if not len(miss):
            return numbers
        lost = [words[k] for k in miss.tolist()]
        known = self.old.find(lost)
        back = known >= 0
        if back.any():
            numbers[miss[back]] = self.young.add([w for w, ok in zip(lost, back.tolist()) if ok], *self.old.take(known[back]))
            miss = miss[~back]
            lost = [w for w, ok in zip(lost, back.tolist()) if not ok]
        if self.ends is None or not lost:
            numbers[miss] = self.young.add(lost, *self._plain(lost))
            return numbers
        letters = pc.match_substring_regex(pa.array(lost, pa.large_string()), _LETTERS).to_numpy(zero_copy_only=False)
        some = [w for w, ok in zip(lost, letters.tolist()) if ok]
        numbers[miss[letters]] = self.young.add(some, *self._letters(some))
        if not letters.all():
            rest = [w for w, ok in zip(lost, letters.tolist()) if not ok]
            numbers[miss[~letters]] = self.young.add(rest, *self._marked(rest))
        return numbers

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Other words. Capitals are folded and marks at the end split off where that changes no id."""
        parts = _PARTS.findall(" ".join(words).lower() + " ")
        if len(parts) != len(words):  # lower-casing made a space
            return self._plain(words)
        simple = [k for k, p in enumerate(parts) if p[0]]
        odd = [k for k, p in enumerate(parts) if not p[0]]
        cores = list(dict.fromkeys([parts[k][0] for k in simple]))
        tails = list(dict.fromkeys([parts[k][1] for k in simple]))
        cut = []
        for names, encode in ((cores, self._core), (tails, self._plain)):
            flat, sizes = encode(names)
            raw, ends = flat.tobytes(), (4 * np.cumsum(sizes)).tolist()
            cut.append(dict(zip(names, [raw[i:j] for i, j in zip([0, *ends], ends)])))
        out: list[bytes] = [b""] * len(words)
        for k in simple:
            out[k] = cut[0][parts[k][0]] + cut[1][parts[k][1]]
        flat, sizes = self._plain([words[k] for k in odd])
        raw, ends = flat.tobytes(), (4 * np.cumsum(sizes)).tolist()
        for k, i, j in zip(odd, [0, *ends], ends):
            out[k] = raw[i:j]
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def _core(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of lower-case letters, from the young pool where it has them."""
        numbers = self.young.find(words)
        new = [w for w, k in zip(words, numbers.tolist()) if k < 0]
        numbers[numbers < 0] = self.young.add(new, *self._letters(new))
        return self.young.take(numbers)

    def encode(self, texts: list[str] | pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text begins (one number more than texts).

        Arrow cuts the texts into words and numbers the distinct ones; only those are looked up, and the ids of all
        words are gathered by number. Nulls are empty texts. An end id is put after each text where one is given.
        """
        flat, cuts = self._flat(texts)
        if end_id is not None:
            flat = np.insert(flat, cuts[1:], end_id)
            cuts = cuts + np.arange(len(cuts))
        return flat, cuts

    def _flat(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        if not self.by_word or not len(column):
            flat, sizes = self._plain(column.to_pylist())
            return flat, np.append(0, np.cumsum(sizes))
        for space in "\n\t\r":
            column = pc.replace_substring(column, space, " ")
        lists = pc.split_pattern(column, " ")
        coded = lists.values.dictionary_encode()
        every = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))
        numbers = self._numbers(pc.binary_join(every, pa.scalar(" "))[0].as_py().split(" "))[coded.indices.to_numpy()]
        flat, sizes = self.young.take(numbers)
        if len(self.young.index) > CACHE_WORDS or self.young.used > 16 * CACHE_WORDS:
            self.old, self.young = self.young, _Pool()
        return flat, np.append(0, np.cumsum(sizes))[lists.offsets.to_numpy()]


def _word_ends(spec: dict) -> np.ndarray | None:
    """Whether each id ends a word, for a model that marks word ends; else None."""
    suffix = spec["model"].get("end_of_word_suffix")
    if spec["model"].get("type") != "BPE" or not suffix:
        return None
    vocab = spec["model"]["vocab"]
    ends = np.zeros(max(vocab.values()) + 1, bool)
    for token, k in vocab.items():
        ends[k] = token.endswith(suffix)
    return ends


def _drops_space(spec: dict) -> bool:
    """Whether no token spans white space: the pre-tokenizer splits by a pattern that leaves it out."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    norm = spec.get("normalizer") or {}
    kinds = {n.get("type") for n in norm.get("normalizers", [norm]) if n}
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and r"[^\s" in first.get("pattern", {}).get("Regex", "")
        and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in steps[1:])
        and kinds <= {"NFC", "Replace", "Lowercase", None}
    )
