"""Token counts by whole-token shortcut.

A SentencePiece BPE model without pieces that continue past a word's end never merges across the
start of a word, so a text's count is the sum over its pre-tokens (a run of spaces and the word
behind it). Which vocabulary strings encode alone as one token is proved once, before any text is
read, by encoding every vocabulary string alone with the library. Pre-tokens among the proved ones
count 1 without a merge; the rest are merged by the library, once for each distinct one while it is
remembered.

Edge cases: null and empty texts have 0 tokens and 0 bytes; a null id is kept, and ids that are no whole numbers are cast to them or null; repeated rows are each
counted; an empty table gives an empty result; extra columns are not read; text length is not bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import quiet_tokenizers, Remembered, small_batches, text_groups

SPACE = "▁"
#: Distinct pre-tokens that a Python worker remembers ; memory, not results, depends on it.
REMEMBERED = 400_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"

_counters: dict[str, PieceCounter | FileCounter] = {}


class PieceCounter:
    """Counts for a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        #: The two proofs that pre-tokens are independent; a model that fails one is counted text by text.
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain) and self._plain_spaces()
        self.line_splits = self.splits and not any("\n" in p for p in plain)
        self.proved = self._prove(plain) if self.splits else frozenset()
        self.words = Remembered(REMEMBERED, self._count_word, dict.fromkeys(sorted(self.proved), 1))
        self.inner = Remembered(REMEMBERED // 4, self._count_inner)
        self.runs = Remembered(REMEMBERED // 4, self._count_run)
        self.line_tokens = len(self.model.encode("\n"))

    def _plain_spaces(self) -> bool:
        """Whether the library turns each space into SPACE, puts one before the text, and changes nothing else."""
        probes = ["a", " a", "a  b", "a ", " ", "a ﬁ Ⅷb", "Å a\tb"]
        return all("".join(self.model.encode(x, out_type=str)).replace(SPACE, " ") == " " + x or self._bytes(x) for x in probes)

    def _bytes(self, text: str) -> bool:
        """As above for texts with characters that are written as bytes."""
        out = b"".join(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.encode() for p in self.model.encode(text, out_type=str))
        return out.decode().replace(SPACE, " ") == " " + text

    def _prove(self, plain: list[str]) -> frozenset[str]:
        """Words that, encoded alone, are one token."""
        words = [p[1:] for p in plain if p.startswith(SPACE) and len(p) > 1 and SPACE not in p[1:] and "\n" not in p]
        return frozenset(w for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True) if len(ids) == 1)

    def _count_word(self, word: str) -> int:
        """Of a word with one space before it."""
        if "\n" in word and self.line_splits:
            head, *rest = word.split("\n")
            return self._spaced(head) + sum(self.line_tokens - 1 + (self.inner[x] if x else 0) for x in rest)
        return len(self.model.encode(word))

    def _spaced(self, word: str) -> int:
        return self.words[word] if word else 1

    def _count_inner(self, word: str) -> int:
        """Of a word right after a line end, so without a space before it."""
        return len(self.model.encode("\n" + word)) - self.line_tokens

    def _count_run(self, run: str) -> int:
        """Of a pre-token with more than one space before it, or none behind; the library adds the first."""
        head, *rest = run.split("\n") if self.line_splits else [run]
        return len(self.model.encode(head[1:])) + sum(self.line_tokens - 1 + (self.inner[x] if x else 0) for x in rest)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.model.encode(text))
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return sum(map(self.words.__getitem__, parts))
        total, spaces = 0, 0
        for part in parts:
            spaces += 1
            if part:
                total += self.words[part] if spaces == 1 else self.runs[SPACE * spaces + part]
                spaces = 0
        return total + (self._count_tail(spaces) if spaces else 0)

    def _count_tail(self, spaces: int) -> int:
        """Of spaces at the text's end; the library adds the first, except to an empty text."""
        return len(self.model.encode(" " * (spaces - 1))) if spaces > 1 else 1


class FileCounter:
    """Counts for a tokenizers .json file: by the library, one whole text at a time."""

    def __init__(self, path: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids) if text else 0


def counter(path: str) -> PieceCounter | FileCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path) if path.endswith(".model") else FileCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row's whole text. tokenizer: a .model or .json file
    at the same path on every executor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer)
        for part, texts in text_groups(batches):
            n = [of.count(t) if t else 0 for t in texts]
            yield pa.record_batch([part.column(0), pa.compute.binary_length(part.column(1)).fill_null(0).cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return small_batches(docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(rows, SCHEMA)
