import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import decontam
from frameloom.llm.fm_index import FmIndex


def plain(docs, bench, window=10):
    windows = {}
    for item, text in bench:
        own = decontam.words_of(text)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            windows.setdefault(tuple(own[k : k + window]), set()).update([] if item is None else [str(item)])
    out = []
    for doc, text in docs:
        own, hit, items = decontam.words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if (found := windows.get(tuple(own[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= found
        out.append((doc, len(own), len(hit), sorted(items)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_chars", [10**6, 700])
def test_equals_plain_search(spark, block_chars):
    rng = random.Random(block_chars)
    bench = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 40])))) for i in range(30)]
    bench += [(30, bench[5][1]), (None, "w1 w2"), (None, bench[7][1]), (31, None), (32, "É-ab_C9")]
    docs = []
    for i in range(80):
        words = [f"W{rng.randrange(60)}" for _ in range(rng.choice([0, 5, 60]))]
        if i % 3 == 0 and words:
            words[2:2] = bench[rng.randrange(30)][1].split()
        docs.append((i, rng.choice([" ", "\n", ", "]).join(words)))
    docs += [(90, None), (90, "xÉ é ab c9 É ab c9"), (91, "É, AB c9")]
    found = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("x")), spark.createDataFrame(bench, "item_id long, text string"), block_chars=block_chars)
    got = sorted(((r.doc_id, r.n_words, r.n, r["items"]) for r in found.select("doc_id", "n_words", decontam.n_hit().alias("n"), "items").collect()), key=str)
    assert got == plain(docs, bench)


def test_index_equals_plain_places():
    rng = np.random.default_rng(4)
    for sigma in (2, 3, 20):
        runs = [rng.integers(1, sigma, rng.integers(1, 70)) for _ in range(30)]
        runs += runs[:5]
        seq = np.concatenate([[0], *[np.r_[r, 0] for r in runs]])
        index = FmIndex(seq, sigma)
        patterns = np.array([np.pad(p := rng.integers(1, sigma, n), (6 - len(p), 0)) for n in rng.integers(1, 7, 50)])
        lengths = (patterns > 0).sum(1)
        lo, hi = index.ranges(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, lo, hi, strict=True):
            want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p[6 - n :]).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_cleaning(spark, odd, none):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before. {item.upper()}! After it."), (2, item), (3, None), (4, "clean")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in decontam.cleaned(docs, bench).collect()) == [(1, "Before. ! After it."), (3, None), (4, "clean")]
    assert decontam.cleaned(odd, bench).count() == odd.count()
    clashing = docs.withColumns({"items": F.lit("mine"), "N_words": F.lit(5), "hit_words": F.lit(1.5), "n_words_own": F.lit("a"), "__0": F.lit(7)})
    rows = decontam.cleaned(clashing, bench)
    assert rows.columns == clashing.columns and {tuple(r)[2:] for r in rows.collect()} == {("mine", 5, 1.5, "a", 7)}
    kept = decontam.contamination(docs.withColumn("items", F.lit("mine")), bench)
    assert kept.columns == ["doc_id", "text", "items_own", "n_words", "hit_words", "items"] and kept.filter("items_own = 'mine'").count() == 4
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).agg(F.sum(decontam.n_hit())).first()[0] == 0
