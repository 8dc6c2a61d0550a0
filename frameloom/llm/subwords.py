"""Token ids of whole texts for a lower-casing BPE with word ends, from remembered words.

Such a file's pre-tokenizer never keeps white space, so a text's ids are those of its words in a row. Commas and
full stops that touch no other mark are pre-tokens of their own, and are set apart from their words first. A word's
ids are remembered; only new pre-tokens reach the library's merges, many at once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np

from frameloom.llm.common import quiet_tokenizers

#: Words that a worker remembers, besides those of the texts at hand.
REMEMBERED = 400_000
#: In this range the classes of letters and digits are the same in every Unicode version in use, composed forms
#: stand for themselves, and a letter's small form is one letter (but that of U+0130).
SIMPLE = re.compile("[^\x00-\u012f\u0131-\u024f]")
MARKS = re.escape("".join(c for c in map(chr, range(0x250)) if c not in "\t\n\x0b\x0c\r \x85\xa0" and unicodedata.category(c)[0] not in "LN"))
#: A comma or full stop beside another mark, with which it is one pre-token.
JOINED = re.compile(f"[.,](?:(?<=[{MARKS}].)|[{MARKS}])")
#: The pre-tokens of such a file, for the simple range; checked against the file before use.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_made: dict[str, WordBpe] = {}


class WordBpe:
    def __init__(self, path: str):
        quiet_tokenizers()
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == PATTERN and spec["model"].get("end_of_word_suffix") == "</w>"
        # Pre-tokens of small letters need no normalizer and no pattern, only the bytes' alphabet.
        self.plain = self.library
        if self.by_word and spec["pre_tokenizer"]["pretokenizers"][1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]:
            self.plain = Tokenizer.from_file(path)
            self.plain.no_truncation()
            self.plain.no_padding()
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.findall = regex.compile(PATTERN).findall
        self.last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merge(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens: runs of letters many at a time (a merge's last token tells where one ends), others alone."""
        found = {}
        plain = [p for p in new if p.isalpha()]
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for group, made in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) == len(group):
                raw = ids.tobytes()
                found.update(zip(group, [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], strict=True))
        found.update((p, self._library(p)) for p in new if p not in found)
        return found

    def _learn(self, new: set[str]) -> None:
        """Ids of words that are not known yet."""
        known = self.known
        plain = [w for w in new if w.isalpha() and w.islower() and (w.isascii() or not SIMPLE.search(w))]
        known.update(self._merge(plain))
        split = {}
        for w in new.difference(plain):
            if "<|" in w or not w.isascii() and SIMPLE.search(w):
                known[w] = self._library(w)
            else:
                split[w] = self.findall(w.lower())
        made = self._merge(list(set(chain.from_iterable(split.values())) - known.keys()))
        of = lambda p: made[p] if p in made else known[p]
        known.update((w, b"".join(map(of, own))) for w, own in split.items())

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, little-endian unsigned 32-bit; null is empty."""
        if not self.by_word:
            return [self._library(t) if t else b"" for t in texts]
        split = list(map(self._words, texts))
        words = set().union(*split)
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.known[""] = b""
        if new := words - self.known.keys():
            self._learn(new)
        of = self.known.__getitem__
        return [b"".join(map(of, parts)) for parts in split]

    def _words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if text.isascii() or not SIMPLE.search(text):
            text = text.lower()
            if not JOINED.search(text):
                text = text.replace(",", " ,").replace(".", " .")
        return text.replace("\n", " ").split(" ")


def word_bpe(path: str) -> WordBpe:
    if path not in _made:
        _made[path] = WordBpe(path)
    return _made[path]
