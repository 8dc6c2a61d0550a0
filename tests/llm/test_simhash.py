import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from frameloom.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [words[i : i + 4] for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def test_fingerprints(spark, odd, none):
    for r in odd.collect():
        assert simhash.fingerprint(r.text) == plain_fingerprint(r.text)
    assert simhash.near_duplicates(none).count() == 0
    found = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd.withColumn("fp", odd.n_chars)).collect()}
    assert found[1, 0] == found[2, 0] == found[3, 0] == 1


@pytest.mark.parametrize("blocks", [None, 5, 6, 8])
def test_components_equal_all_pairs(spark, blocks, monkeypatch):
    rng = random.Random(blocks)
    fps = []
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 60])):
            base ^= sum({1 << rng.randrange(64) for _ in range(rng.choice([0, 1, 3, 4, 5]))}) if rng.random() < 0.8 else 0
            fps.append(base)
    rows = list(enumerate(fps))
    rng.shuffle(rows)
    if blocks:
        monkeypatch.setattr(simhash, "block_count", lambda *a: blocks)
    own = spark.createDataFrame([(d, int(np.uint64(f).view(np.int64))) for d, f in rows], "doc_id long, fp long").withColumn("text_hash", F.lit(0))
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: docs)
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(own).collect())
    assert got == plain_components(rows)


@pytest.mark.parametrize("large", [9, 60])
def test_large_keys_are_split_without_loss(spark, large):
    rng = random.Random(large)
    start = rng.getrandbits(40) << 24  # all agree on five of eight bytes
    fps = {start ^ sum({1 << rng.randrange(24) for _ in range(12)}) for _ in range(150)} | {start ^ sum({1 << rng.randrange(64) for _ in range(3)}) for _ in range(60)}
    rows = list(enumerate(sorted(fps)))
    classes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for _, f in rows], "fp long").withColumn("x", F.lit(0)).select("fp")
    edges = [(r.a, r.b) for r in simhash.links(classes, 4, 8, large).collect()]
    number = {int(np.uint64(f).view(np.int64)): i for i, f in rows}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        x, y = sorted((find(number[a]), find(number[b])))
        root[y] = x
    assert [(i, find(i)) for i, _ in rows] == plain_components(rows)


def test_one_of_each(spark, odd):
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(odd.withColumns({"root": F.lit("x"), "__id": F.lit(1), "__HASH": F.lit(2), "__again": F.lit(True)})).collect()), key=str)
    rows = plain_components([(r.doc_id if r.doc_id is not None else 99, plain_fingerprint(r.text)) for r in odd.collect()])
    assert [d for d, _ in kept if d is not None] == sorted({c for _, c in rows} - {99}) and len(kept) == len({c for _, c in rows})


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(-60, 60)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {-60}
