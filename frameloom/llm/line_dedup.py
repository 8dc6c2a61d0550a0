r"""Near-duplicate lines by a deletion-neighbourhood join, coarse to fine.

A line (trimmed of ASCII white space; one without a letter or digit always stays) goes if an equal line stands
earlier, or if it is within the edit bound of a different line that first stands before its own first place.
Edits are counted in words: one put in, taken out or replaced. The bound grows with the shorter line, one edit
for each ``EDIT_WORDS`` words and ``edits`` at most, so that lines of fewer words go as equal lines only. Order is
by doc_id (null last), text hash and line number. The rule asks for an earlier line, not for one that stays: of
A, B and C, each near the next, B and C go.

With k edits allowed, a line is cut into k + 1 pieces, and its variants are what is left when k of them are
deleted: edits touch k pieces at most, so two near lines have an equal variant. Piece i, with i edits in front
of it and k - i or fewer behind it, is counted from the nearer end and shifted by the edits there. Variants are
hashed with their bucket of lengths, equal ones joined, and the distance of a line to the earlier ones of its
variant is verified on the words. First each line meets the earliest line of each of its variants, a pair of
lines once in however many variants it is: a line near it is settled, so a group of near copies costs as much as it
has lines. Lines that are not settled meet all earlier lines of their variants, settled ones too. No pair leaves its
task. A variant with over ``HOT`` different lines, as many of them not settled, is dealt anew by its lines' rare
words: near lines share one of the k + 1 words that are rarest in the variant, so each line goes to those of its
own, and begins with the earliest again; up to ``LEVELS`` times. A variant with fewer of them, and what is left then, is
compared whole, in blocks of about ``HOT`` lines by ``HOT`` of those not settled, so none is one task.

Edge cases: null and empty texts have no lines; rows of equal id and text are one document that is there more
than once, and keep the same lines; rows of equal (or null) id and different text are documents of their own;
an empty table gives an empty result; extra columns stay as they are, whatever their names; lines are compared
whole, at any length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import small_batches, text_groups, unused, written

#: Words of a line for each edit allowed, and the most edits.
EDIT_WORDS, MOST_EDITS = 8, 3
#: Ratio of the buckets of line lengths; each is as wide as the edits allowed there.
STEP = 1.25
BLANK = " \t\x0b\x0c\r"
#: A letter or digit.
SIGN = re.compile(r"[^\W_]")
#: Seed of a line's second hash: the hash of the number 7, as when the columns 7 and line are hashed together.
SEED2 = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)
#: Hash buckets of shared keys that are broadcast (so many rows at most), to drop other lines before the exact join.
BUCKETS = 1 << 20
#: Different lines of one variant that are compared in one place without dealing them anew, and how often they are dealt.
HOT, LEVELS = 400, 3


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the row's text), line_no, line, and h1 and h2 that tell lines apart, of lines that are not blank."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "raw"))
    own = own.select("doc_id", "text_key", "line_no", F.btrim("raw", F.lit(BLANK)).alias("line")).filter("line <> ''")
    return own.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def words_of(line: str) -> list[str]:
    for c in BLANK[1:]:
        if c in line:
            line = line.replace(c, " ")
    words = line.split(" ")
    return [w for w in words if w] if "" in words else words


def bound(n: int, edits: int = MOST_EDITS) -> int:
    """Edits allowed for a pair of which the shorter line has n words."""
    return min(n // EDIT_WORDS, edits)


def shifts(t: int) -> list[int]:
    """Numbers from 0 of which some two differ by d, for every d up to t."""
    s = max(1, math.isqrt(t))
    return [*range(s), *range(s, s * math.ceil(t / s) + 1, s)]


@cache
def bucket(n: int) -> tuple[int, int, int]:
    """The bucket of lines of n words: its number, the least words of its lines, and the most."""
    b = next(b for b in count() if n < math.ceil(EDIT_WORDS * STEP ** (b + 1) - 1e-6))
    return b, math.ceil(EDIT_WORDS * STEP**b - 1e-6), math.ceil(EDIT_WORDS * STEP ** (b + 1) - 1e-6) - 1


@lru_cache(4096)
def pieces(n: int, edits: int) -> list[tuple[int, int, int]]:
    """Seed, start and end of what is left in each coarse variant of a line of n words."""
    out = []
    # A near line that is shorter, by the edits allowed at most, may be in the bucket before.
    for b, first, last in sorted({bucket(n), bucket(max(n - bound(n, edits), EDIT_WORDS))}):
        k = bound(last, edits)
        q = first // (k + 1)
        for i in range(k + 1):
            front = 2 * i <= k
            own = shifts(i if front else k - i)
            for a in own:
                start = i * q + a if front else n - (k + 1 - i) * q + a
                out.append((b << 8 | i, start, start + q - own[-1]))
    return out


def variants(words: list[str], edits: int) -> set[int]:
    """Hashes of a line's coarse variants; none for a line that must be equal to go."""
    n = len(words)
    if bound(n, edits) < 1:
        return set()
    return {xxhash.xxh64_intdigest(" ".join(words[a:b]), seed) for seed, a, b in pieces(n, edits)}


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, edits: int) -> DataFrame:
    """doc_id, text_key, line_no, h1, h2 as in lines_of(), and keys (hashes of variants), of every line that can go."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches):
            row, no, h1, h2, keys, ends = [], [], [], [], [], [0]
            for i, text in enumerate(texts):
                for j, line in enumerate(text.split("\n")):
                    line = line.strip(BLANK)
                    if not SIGN.search(line):
                        continue
                    raw = line.encode()
                    row.append(i)
                    no.append(j)
                    h1.append(xxhash.xxh64_intdigest(raw, 42))
                    h2.append(xxhash.xxh64_intdigest(raw, SEED2))
                    if len(raw) >= 2 * EDIT_WORDS - 1:
                        keys.extend(variants(words_of(line), edits))
                    ends.append(len(keys))
            at = pa.array(row, pa.int32())
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), pa.array(no, pa.int32()), signed(h1), signed(h2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(keys))], names=["doc_id", "text_key", "line_no", "h1", "h2", "keys"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return small_batches(own).mapInArrow(rows, f"doc_id {own.schema[0].dataType.simpleString()}, text_key long, line_no int, h1 long, h2 long, keys array<long>")


def order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key"), F.col("line_no"))


def within(a: list[str], b: list[str], k: int) -> bool:
    """Whether the edit distance of two lists is k or less: furthest places reached on each diagonal."""
    if abs(len(a) - len(b)) > k:
        return False

    def run(i: int, j: int) -> int:
        """i behind the items that agree from a[i] and b[j] on."""
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        return i

    goal = len(b) - len(a)
    reached = {0: run(0, 0)}
    for _ in range(k):
        if reached.get(goal) == len(a):
            return True
        further: dict[int, int] = {}
        for d, i in reached.items():
            for e, x in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                if x <= len(a) and x + e <= len(b):
                    further[e] = max(further.get(e, 0), x)
        reached = {d: run(i, i + d) for d, i in further.items()}
    return reached.get(goal) == len(a)


def near_pairs(found: DataFrame, edits: int) -> DataFrame:
    """h1 and h2 of the lines near the other line of their row. found: h1, h2, line, other."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = words_of(a), words_of(b)
                keep.append(within(b, a, bound(min(len(a), len(b)), edits)))
            yield pa.record_batch([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], names=["h1", "h2"])

    return small_batches(found).mapInArrow(rows, "h1 long, h2 long")


def near_in_keys(found: DataFrame, edits: int) -> DataFrame:
    """h1 and h2 of the lines asked for that are near an earlier line of their key. found: key, h1, h2, line, asked, held (whether later
    lines are compared to it) dealt by key, sorted by key and place, of one line those not held first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, earlier = None, []
        for batch in batches:
            gone = []
            for k, h1, h2, line, asked, held in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if k != key:
                    key, earlier = k, []
                own = words_of(line)
                n = len(own)
                if asked and any(within(x, own, bound(min(len(x), n), edits)) for x in earlier):
                    gone.append((h1, h2))
                if held:
                    earlier.append(own)
            if gone:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*gone, strict=True)], names=["h1", "h2"])

    return small_batches(found).mapInArrow(rows, "h1 long, h2 long")


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (key, h1, h2, asked, n and q, a key's lines and those asked for) dealt so that each line asked for meets each line
    of its key in one block (key, h1, h2, asked, held), of about HOT lines of either sort."""
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "h1", "h2"), n).cast("int")
    many = lambda c: F.ceil(F.col(c) / HOT).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    rows = rows.withColumns({"of_held": many("n"), "of_asked": many("q")})
    held = rows.select("key", "h1", "h2", part(1, F.col("of_held")).alias("x"), F.explode(upto(F.col("of_asked"))).alias("y"), F.lit(False).alias("asked"), F.lit(True).alias("held"))
    asked = rows.filter("asked").select("key", "h1", "h2", F.explode(upto(F.col("of_held"))).alias("x"), part(2, F.col("of_asked")).alias("y"), F.lit(True).alias("asked"), F.lit(False).alias("held"))
    return held.union(asked).select(F.xxhash64("key", "x", "y").alias("key"), "h1", "h2", "asked", "held")


def dealt_anew(hits: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """key, h1 and h2: each line of a key under the key and each of its k + 1 words that are rarest there."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, h1, h2, line in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own, seen = words_of(line), Counter()
                out = []
                for w in own:  # the second time a word stands in a line it is another token
                    seen[w] += 1
                    out.append(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seen[w]) - (1 << 63))
                n = len(out)
                yield pa.record_batch([pa.array([x] * n, t) for x, t in ((key, pa.int64()), (h1, pa.int64()), (h2, pa.int64()), (bound(n, edits) + 1, pa.int32()))] + [pa.array(out, pa.int64())], names=["key", "h1", "h2", "most", "token"])

    own = written(small_batches(hits.join(texts, ["h1", "h2"]).select("key", "h1", "h2", "line")).mapInArrow(tokens, "key long, h1 long, h2 long, most int, token long"), "tokens")
    counted = own.join(own.groupBy("key", "token").agg(F.count("*").alias("n")), ["key", "token"])
    rare = counted.groupBy("key", "h1", "h2", "most").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("all"))
    first = rare.select("key", "h1", "h2", F.explode(F.slice("all", F.lit(1), F.col("most"))).alias("t")).filter("t.n > 1")
    return first.select(F.xxhash64("key", "t.token").alias("key"), "h1", "h2").distinct()


def near_lines(docs_lines: DataFrame, keyed: DataFrame, edits: int = MOST_EDITS) -> DataFrame:
    """h1 and h2 of every line that has an earlier line within the bound. docs_lines: of lines_of(); keyed: h1, h2 and keys."""
    each = keyed.select("h1", "h2", F.explode("keys").alias("key"))
    ends = each.groupBy("key").agg(*[f(h).alias(f"{f.__name__}_{h}") for h in ("h1", "h2") for f in (F.min, F.max)])
    active = written(ends.filter("min_h1 <> max_h1 OR min_h2 <> max_h2").select("key"), "keys")
    bucket = lambda c: F.pmod(F.col(c), F.lit(BUCKETS)).cast("int")
    some = lambda df, c: F.broadcast(df.select(bucket(c).alias("bucket")).distinct())  # noqa: E731  at most BUCKETS rows
    # Different lines only, before the join by key.
    passed = each.join(some(active, "key"), bucket("key") == F.col("bucket"), "left_semi").distinct()
    hits = written(passed.join(active, "key", "left_semi"), "hits")
    wanted = hits.select("h1", "h2").distinct()
    near = docs_lines.select("h1", "h2", "line", order().alias("at")).join(some(wanted, "h1"), bucket("h1") == F.col("bucket"), "left_semi")
    firsts = near.groupBy("h1", "h2").agg(F.min(F.struct("at", "line")).alias("f"))
    texts = written(firsts.join(wanted, ["h1", "h2"], "left_semi").select("h1", "h2", F.col("f.at").alias("o"), F.col("f.line").alias("line")), "texts")
    near = None
    for level in range(LEVELS + 1):
        hits = written(hits.join(texts.select("h1", "h2", "o"), ["h1", "h2"]), "placed")
        lead = hits.groupBy("key").agg(F.min(F.struct("o", "h1", "h2")).alias("lead"))
        later = hits.join(lead, "key").filter(F.col("o") > F.col("lead.o"))
        # Each line against the earliest of its keys, a pair once: it settles nearly all lines of a large group.
        open_ = later if near is None else later.join(near, ["h1", "h2"], "left_anti")
        pairs = open_.select("h1", "h2", F.col("lead.h1").alias("l1"), F.col("lead.h2").alias("l2")).distinct()
        both = pairs.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(texts.select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), F.col("line").alias("other")), ["l1", "l2"])
        found = written(near_pairs(both.select("h1", "h2", "line", "other"), edits).distinct(), "found")
        near = found if near is None else near.union(found)
        # The others are asked for among their keys' lines, those that went too, up to the last one asked for.
        rows = later.select("key", "h1", "h2", "o").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").withColumn("asked", F.col("near").isNull())
        keys = rows.groupBy("key").agg(F.min("o").alias("least"), F.max(F.when(F.col("asked"), F.col("o"))).alias("last"), F.count("*").alias("n"), F.count_if("asked").alias("q")).filter("last > least")
        rows = written(rows.join(keys, "key").filter("o <= last").select("key", "h1", "h2", "asked", "n", "q"), "rows")
        hot = (F.col("n") > HOT) & (F.col("q") > HOT) if level < LEVELS else F.lit(False)
        again = level < LEVELS and not rows.filter(hot).isEmpty()
        here = rows.filter(F.col("n") <= HOT).select("key", "h1", "h2", "asked", F.lit(True).alias("held")).union(in_blocks(rows.filter((F.col("n") > HOT) & ~hot)))
        dealt = here.join(texts, ["h1", "h2"]).repartition("key").sortWithinPartitions("key", "o", "held")
        found = written(near_in_keys(dealt.select("key", "h1", "h2", "line", "asked", "held"), edits).distinct(), "found")
        near = near.union(found)
        if not again:
            break
        hits = written(dealt_anew(rows.filter(hot).select("key", "h1", "h2"), texts, edits), "hits")
    return near.distinct()


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MOST_EDITS) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) and gone (numbers of the lines that go, rising) of every row's id and text that lose a line."""
    lines = written(keyed_lines(docs, id_col, text_col, edits), "lines")
    near = written(near_lines(lines_of(docs, id_col, text_col), lines.select("h1", "h2", "keys"), edits), "near").withColumn("near", F.lit(True))
    short = lines.select("h1", "h2", "doc_id", "text_key", "line_no")
    firsts = short.groupBy("h1", "h2").agg(F.min(order()).alias("first"), F.max(order()).alias("last"))
    wanted = written(firsts.join(near, ["h1", "h2"], "left").filter("first < last OR near").select("h1", "h2", "first", "near"), "wanted")
    gone = short.join(wanted, ["h1", "h2"]).filter(F.coalesce("near", F.lit(False)) | (order() > F.col("first")))
    return gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MOST_EDITS) -> DataFrame:
    """docs, the lines that go taken out of their texts; a document of which no word is left goes, unless it had none."""
    id_, key, gone, left = (unused(docs, x) for x in ("id", "key", "gone", "left"))
    found = written(removals(docs, id_col, text_col, edits), "gone").toDF(id_, key, gone)
    # A sorted merge at any size: both sides grow with the documents.
    met = F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(key))
    kept = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = docs.join(found.hint("merge"), met, "left").withColumn(left, F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(kept))
    out = out.filter(F.col(gone).isNull() | (F.length(F.btrim(left, F.lit(BLANK + "\n"))) > 0))
    return out.select(*[F.col(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
