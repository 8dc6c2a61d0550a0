"""Benchmark decontamination with an FM-index for each shard of training texts.

A benchmark item's windows are its runs of ``window`` consecutive words (an item of fewer words is one
window). A shard's texts are written over the benchmark's words: every other word ends a run, and a run
shorter than the shortest window is left out, since no window fits into it. The shard's FM-index finds
all windows by backward search, locates their occurrences by sampled suffix positions, and the hit
words are merged into removal spans.

The benchmark reaches executors in blocks of bounded size; each block is one pass over the documents,
without a shuffle, and passes add to the same spans. One block is held at a time: what a pass found is written
before the next block is read.

Edge cases: null, empty and blank texts and items have no words; repeated rows are each searched;
items of equal text are all reported; the windows of an item without an id are hit, but there is no id to report; an
empty table on either side gives no hits; contamination() renames columns of the documents named like a result to
end with _own, and cleaned() returns all columns as they are; text length is not bounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.llm.common import small_batches, text_groups, written
from frameloom.llm.fm_index import FmIndex

WINDOW = 10
#: Characters of benchmark text in one block, which bounds what is broadcast (words, ids and items: some 20 bytes a character).
BLOCK_CHARS = 2_000_000
#: A shard is searched when it holds so many words or characters.
SHARD_WORDS, SHARD_CHARS = 1_600_000, 12_000_000
#: Occurrences located at a time.
LOCATED_AT_ONCE = 1_000_000

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: For UTF-8: A-Z to a-z, other ASCII but digits and letters to space; bytes of longer characters stay.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
RESULTS = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split() if text else []


class Block:
    """Windows of some benchmark items, as symbols of their words."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            for at in range(max(1, len(own) - window + 1) if own else 0):
                of = found.setdefault(tuple(own[at : at + window]), set())
                if item is not None:
                    of.add(item)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for i, w in enumerate(found):
            self.patterns[i, window - len(w) :] = w
        self.shortest = int(self.lengths.min(initial=window))

    def search(self, texts: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text (as words): merged spans of hit words, and the items that occur."""
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        sizes = np.array([len(t) for t in texts], np.int64)
        symbols = np.fromiter(map(self.ids.get, chain.from_iterable(texts), repeat(0)), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        word = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        known = np.flatnonzero(symbols)
        if not len(known) or not len(self.lengths):
            return spans, items
        starts = np.flatnonzero(np.r_[True, (np.diff(known) > 1) | (np.diff(doc[known]) > 0)])
        runs = np.diff(np.r_[starts, len(known)])
        kept = known[np.repeat(runs >= self.shortest, runs)]
        runs = runs[runs >= self.shortest]
        if not len(kept):
            return spans, items
        ends = np.cumsum(runs)
        seq = np.insert(symbols[kept], np.r_[0, ends], 0)
        source = np.insert(kept, np.r_[0, ends], -1)
        index = FmIndex(seq, len(self.ids) + 1)
        lo, hi = index.ranges(self.patterns, self.lengths)
        counts = hi - lo
        edges = np.zeros(len(seq) + 1, np.int64)
        pairs = []
        hit = np.flatnonzero(counts)
        groups = np.split(hit, np.flatnonzero(np.diff(np.cumsum(counts[hit]) // LOCATED_AT_ONCE)) + 1)
        for group in groups:
            of = np.repeat(group, counts[group])
            rows = np.repeat(lo[group], counts[group]) + np.arange(len(of)) - np.repeat(np.cumsum(counts[group]) - counts[group], counts[group])
            places = index.locate(rows)
            np.add.at(edges, places, 1)
            np.add.at(edges, places + self.lengths[of], -1)
            pairs.append(np.unique(doc[source[places]] * len(self.lengths) + of))
        for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
            items[pair // len(self.lengths)].update(self.items[pair % len(self.lengths)])
        covered = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        at = source[covered]
        at.sort()
        if len(at):
            first = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(doc[at]) > 0)])
            last = np.r_[first[1:], len(at)] - 1
            for d, a, b in zip(doc[at[first]].tolist(), word[at[first]].tolist(), word[at[last]].tolist(), strict=True):
                spans[d].append((a, b + 1))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of words (and what stands between words of one span)."""
    places = [m.span() for m in WORD.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : places[a][0]])
        end = places[b - 1][1]
    return "".join([*out, text[end:]])


def blocks(bench: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, id_col: str = "item_id", text_col: str = "text") -> list[Callable[[], Block]]:
    """What makes each block when it is wanted."""
    own = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    chars = own.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = -(-chars // block_chars)
    return [lambda i=i: Block([tuple(r) for r in own.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()], window) for i in range(n)]


def _pass(shared: Broadcast, text_col: str, text: str):
    """text: what becomes of the texts: keep, drop, or clean."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list, list[list[bytes]]]] = []
        chars = 0

        def flush():
            spans, items = shared.value.search([t for *_, split in held for t in split])
            at = 0
            for part, texts, split in held:
                rows = {f: part.column(f) for f in part.schema.names if not (text == "drop" and f == text_col)}
                own, to = range(at, at + len(texts)), [part.column("hit_words").to_pylist(), part.column("items").to_pylist()]
                at += len(texts)
                rows["n_words"] = pa.array([len(t) for t in split], pa.int64())
                hit = [merged([*((x["start"], x["end"]) for x in old), *spans[i]]) for i, old in zip(own, to[0], strict=True)]
                rows["hit_words"] = pa.array([[{"start": a, "end": b} for a, b in own] for own in hit], part.schema.field("hit_words").type)
                if text == "clean":
                    rows[text_col] = pa.array([without(t, h) if h else t for t, h in zip(texts, hit, strict=True)], part.schema.field(text_col).type)
                rows["items"] = pa.array([sorted({*old, *items[i]}) for i, old in zip(own, to[1], strict=True)], part.schema.field("items").type)
                yield pa.record_batch(list(rows.values()), names=list(rows))
            held.clear()

        symbols = 0
        for part, texts in text_groups(batches, text_col):
            split = [words_of(t) for t in texts]
            held.append((part, texts, split))
            chars += sum(len(t) for t in texts if t)
            symbols += sum(map(len, split))
            if symbols >= SHARD_WORDS or chars >= SHARD_CHARS:
                yield from flush()
                chars = symbols = 0
        if held:
            yield from flush()

    return search


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, text_col: str = "text", text: str = "keep") -> DataFrame:
    """docs (with their texts, without if text is "drop", with the texts' spans taken out if it is "clean") with n_words, hit_words (spans start <= word < end) and
    items (ids of items with windows in the text)."""
    names = {f.name.lower() for f in RESULTS}
    docs = docs.withColumnsRenamed({c: f"{c}_own" for c in docs.columns if c.lower() in names})
    n_words = F.when(F.length(F.col(text_col)) > 0, F.regexp_count(F.col(text_col), F.lit(WORD.pattern))).otherwise(0).cast("long")
    found = blocks(bench, window, block_chars)
    if not found:
        docs = docs.withColumn("__n", n_words)
        docs = docs.drop(text_col) if text == "drop" else docs
        return docs.withColumnRenamed("__n", "n_words").select("*", F.array().cast(SPANS).alias("hit_words"), F.array().cast("array<string>").alias("items"))
    out = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("hit_words"), F.array().cast("array<string>").alias("items"))
    schema = T.StructType([*docs.schema.fields, *RESULTS])
    for i, make in enumerate(found):
        now = text if i + 1 == len(found) else "keep"
        own = T.StructType([f for f in schema.fields if not (now == "drop" and f.name == text_col)])
        shared = docs.sparkSession.sparkContext.broadcast(make())
        out = small_batches(out).mapInArrow(_pass(shared, text_col, now), own)
        if i + 1 < len(found):
            out = written(out, "searched")
            shared.destroy()
    return out


def n_hit() -> Column:
    return F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def cleaned(docs: DataFrame, bench: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """docs without the benchmark's passages: the removal spans leave the texts; a document of which no
    word is left goes."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    found = contamination(docs.toDF(*names.values()), bench, window, text_col=names[text_col], text="clean")
    return found.filter((F.size("hit_words") == 0) | (n_hit() < F.col("n_words"))).select(*[F.col(x).alias(c) for c, x in names.items()])
