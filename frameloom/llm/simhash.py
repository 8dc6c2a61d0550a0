"""SimHash near-duplicates by pigeonhole blocks.

Each whole text gets a 64-bit fingerprint. Equal fingerprints are one class at once; classes link at
``radius`` or fewer differing bits. A fingerprint is split into ``blocks`` blocks: of two that differ
in at most ``radius`` bits, blocks - radius blocks agree, so every choice of so many blocks is a join
key, and no link is lost. Within a key's members the Hamming distance is verified and only the edges
of a spanning forest are handed on: a member that is reached is not compared again, so a group of
near copies costs far less than its pairs. A key of more than ``LARGE`` members is dealt anew: what it leaves open
is split into radius + 1 parts, of which two near members share one, so that each becomes a longer key, up to ``SPLITS`` times; what is large still is searched whole. Components are found by alternating large-star and small-star steps over written
tables, until a step changes nothing.

Edge cases: null, empty and blank texts have no words and fingerprint zero, which links like any
other; fewer words than a shingle are one shingle; repeated rows fall into one class; ids are whole numbers (others
are cast, and null where that fails); a null id never becomes a component's id unless it has no other; an empty
table gives an empty result; extra columns are not read, and one_of_each() returns them as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import small_batches, text_groups, unused, written

SHINGLE, RADIUS, SEED = 4, 4, 42
WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Members of a key up to which all are compared at once; larger keys are searched member by member.
DENSE = 24
#: Mean members wanted for a key; more classes get more blocks and so longer keys.
MEMBERS = 2.0
#: Members of a key that one task searches, and how often larger ones are split (each time into radius + 1 keys a member).
LARGE, SPLITS = 20_000, 2


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half the hashes of the text's shingles."""
    words = WORDS.findall(text.translate(LOWER)) if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(" ".join(words[i : i + shingle]), SEED) for i in range(n)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's bits as a long) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches):
            own = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(own)], names=["doc_id", "text_hash", "fp"])

    own = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return small_batches(own).mapInArrow(rows, "doc_id long, text_hash long, fp long")


def block_count(classes: int, radius: int = RADIUS) -> int:
    """Fewest blocks whose keys have few members on average; any choice finds the same links."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if classes / 2.0 ** (64 * (blocks - radius) / blocks) <= MEMBERS / comb(blocks, radius):
            return blocks
    return 2 * radius


def block_masks(blocks: int, radius: int) -> list[int]:
    """The bits of every choice of blocks - radius blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(bits, blocks - radius)]


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join what links among a key's members, each member reached once."""
    out, rest = [], members
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = _near(rest, at, radius)
            if near.any():
                reached, rest = rest[near], rest[~near]
                out.extend((at, x) for x in reached)
                frontier.extend(reached)
    return out


def key_edges(keys: np.ndarray, fps: np.ndarray, radius: int) -> list[np.ndarray]:
    """Edges (two rows) within equal keys; keys are sorted."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    out = []
    small = np.repeat(sizes <= DENSE, sizes)
    for step in range(1, min(DENSE, int(sizes.max())) if len(sizes) else 0):
        hit = small[:-step] & (keys[:-step] == keys[step:]) & _near(fps[:-step], fps[step:], radius)
        out.append(np.stack([fps[:-step][hit], fps[step:][hit]]))
    for start, size in zip(starts[sizes > DENSE], sizes[sizes > DENSE], strict=True):
        if own := forest(fps[start : start + size], radius):
            out.append(np.array(own, np.uint64).T)
    return out


def parts_of(mask: int, n: int) -> list[int]:
    """The bits that a mask leaves open, in n parts of equal size."""
    bits = [1 << i for i in range(64) if not mask >> i & 1]
    return [sum(bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def signed(mask: int) -> int:
    return int(np.uint64(mask).view(np.int64))


def small_keys(classes: DataFrame, masks: list[int], radius: int, large: int = LARGE) -> DataFrame:
    """key and fp of all classes, under every mask; keys of more than ``large`` members are split."""
    spark = classes.sparkSession
    with_key = lambda df: df.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "mask", "fp")
    keyed = with_key(classes.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask")))
    out = []
    for split in range(SPLITS + 1):
        heavy_masks = []
        if split < SPLITS:
            heavy = written(keyed.groupBy("key", "mask").agg(F.count("*").alias("n")).filter(F.col("n") > large).select("key", "mask"), "heavy")
            # One row for a mask at most. Under a mask that leaves no more bits open than may differ, all members link.
            heavy_masks = [m for r in heavy.select("mask").distinct().collect() if (m := r.mask & (1 << 64) - 1).bit_count() < 64 - radius]
        if not heavy_masks:
            out.append(keyed)
            break
        heavy = heavy.filter(F.col("mask").isin([signed(m) for m in heavy_masks])).select("key")
        out.append(keyed.join(heavy, "key", "left_anti"))
        again = written(keyed.join(heavy, "key", "left_semi").select("mask", "fp"), "split")
        longer = [(m, m | p) for m in heavy_masks for p in parts_of(m, radius + 1)]
        table = spark.createDataFrame([(signed(m), signed(x)) for m, x in longer], "mask long, longer long")  # radius + 1 rows for a mask
        keyed = with_key(again.join(F.broadcast(table), "mask").select("fp", F.col("longer").alias("mask")))
    found = out[0].select("key", "fp")
    for x in out[1:]:
        found = found.union(x.select("key", "fp"))
    return found


def links(classes: DataFrame, radius: int = RADIUS, blocks: int | None = None, large: int = LARGE) -> DataFrame:
    """Edges a < b over distinct fingerprints fp whose components are those of all links."""
    blocks = blocks or block_count(classes.count(), radius)
    keyed = small_keys(classes, block_masks(blocks, radius), radius, large)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(keys, fps):
            for pair in key_edges(keys, fps, radius):
                if pair.shape[1]:
                    pair = np.unique(np.sort(pair.view(np.int64), axis=0), axis=1)
                    yield pa.record_batch([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            last = held[-1][0][-1]
            if held[-1][0][0] == last and len(held) > 1 and held[-2][0][-1] == last:
                continue  # a key goes on over batches
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(keys, last))
            yield from flush(keys[:cut], fps[:cut])
            held = [(keys[cut:], fps[cut:])]
        if held:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return keyed.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(edges, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) of every node in edges (a, b), by alternating stars."""
    star = written(edges, "edges")
    before = None
    while True:
        both = star.select("a", "b").union(star.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b")).distinct()
        star = written(small, "stars")
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return star.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp, root (the component's own mark) and component_id (the smallest doc_id
    reachable over links) of every row."""
    own = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "root", "component_id")
    return own.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the smallest id (null last), then of the least text hash."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n")).alias("r"))
    id_, hash_, again = (unused(docs, x) for x in ("id", "hash", "again"))
    first = written(first.select(F.col("r.doc_id").alias(id_), F.col("r.text_hash").alias(hash_), (F.col("r.n") > 1).alias(again)), "first")
    kept = docs.join(first, F.col(f"`{id_col}`").try_cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(hash_)))
    twice = kept.filter(again).dropDuplicates([id_, hash_])
    return kept.filter(~F.col(again)).unionByName(twice).select(*[F.col(f"`{c}`") for c in docs.columns])


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
