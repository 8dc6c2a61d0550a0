import random

import numpy as np

from frameloom.llm import toxicity


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.randrange(30)}" for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            words[1:1] = rng.sample(["moron", "badstem" + rng.choice("abc"), "vileword", "zounds", "trash"], 2)
        docs.append((i, " ".join(words), i))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_quality(spark):
    docs, labels = corpus()
    out = toxicity.toxicity_by_id(spark.createDataFrame(docs, "doc_id long, text string, score long"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    import zlib

    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held) > 0.97


def votes_and_truth(n=40_000):
    rng = np.random.default_rng(1)
    y = rng.random(n) < 0.2
    votes = np.zeros((n, toxicity.VOTERS), int)
    accuracy = [0.9, 0.7, 0.5, 0.4]
    for j, a in enumerate(accuracy):
        votes[:, j] = np.where(y, rng.random(n) < a, rng.random(n) < 0.03)
    votes[:, 4] = votes[:, 3]  # the same voter again
    return y, votes, accuracy


def model_of(votes, y, labelled):
    codes = votes @ (1 << np.arange(toxicity.VOTERS))
    patterns, counts = np.unique(codes, return_counts=True)
    known = np.stack([[(codes[:labelled][y[:labelled] == c] == p).sum() for p in patterns] for c in (0, 1)]).astype(float)
    return patterns, toxicity.LabelModel(patterns, counts.astype(float), known)


def test_label_model_recovers_rates_and_correlation():
    y, votes, accuracy = votes_and_truth()
    for labelled in (1000, 8000):
        _, model = model_of(votes, y, labelled)
        assert np.allclose(model.rates[1, :4], accuracy, atol=0.06) and abs(model.prior - 0.2) < 0.03
        assert model.correlations[3, 4] > 0.9 and (model.parents[4] == 3 or model.parents[3] == 4)
    # A voter that only repeats another adds nothing.
    got = model.posterior(np.array([0b11000, 0b00001]))
    want = 0.2 * 0.1 * 0.3 * 0.5 * 0.4 / (0.2 * 0.1 * 0.3 * 0.5 * 0.4 + 0.8 * 0.97**3 * 0.03)
    assert abs(got[0] - want) < 0.05 < got[1]
    assert (np.diff(model.posterior(np.array([0, 1, 3, 7]))) > 0).all()


def test_posterior_equals_bayes_by_hand():
    y, votes, _ = votes_and_truth(4000)
    patterns, model = model_of(votes, y, 500)
    for code in [*patterns.tolist(), (1 << toxicity.VOTERS) - 1]:
        bits = [code >> j & 1 for j in range(toxicity.VOTERS)]
        joint = []
        for c, p in ((0, 1 - model.prior), (1, model.prior)):
            for j, parent in enumerate(model.parents):
                fires = model.table[c, j, bits[parent] if parent >= 0 else 0]
                p *= fires if bits[j] else 1 - fires
            joint.append(p)
        assert np.isclose(model.posterior(np.array([code]))[0], joint[1] / sum(joint), atol=1e-9)


def voters(own, text):
    return {j for j in range(toxicity.VOTERS) if own.judged(text)[1] >> j & 1}


def test_lexicon_and_voters():
    own = toxicity.Lexicon(["moron", "badst*", "badste*", "other"])
    assert own.held("A Moron, badstem! (OTHER)") == [0, 1, 2, 3] and own.held("badst") == [] and own.held(None) == []
    assert own.judged(None) == ([], 0) and own.judged("a b") == ([], 0)
    fixed, first = toxicity.FIXED_VOTER, toxicity.FIXED_VOTER + 1
    assert voters(own, "the moron") == {fixed} and voters(own, "badstem x") == {5, 6} and voters(own, "other") == {0}
    tail = "calm words " * 3000
    assert voters(own, (tail + "and more " * 9).upper()) == {first} and voters(own, tail + "what!! no!! stop?!?") == {first + 1}
    assert voters(own, tail + "sooo nice") == {first + 2} and voters(own, tail + "m0ron") == {first + 3}
    assert voters(own, tail + "you are a moron") == {fixed, first + 4} and voters(own, "moron " + tail + " you") == {fixed}


def test_entries_are_counted_over_all_labelled_rows(spark):
    docs, labels = corpus(400)
    texts = dict((i, t) for i, t, _ in docs)
    learned = spark.createDataFrame([(texts[i], bool(x)) for i, x in labels], "text string, toxic boolean")
    want = {c: {} for c in (True, False)}
    for i, x in labels:
        for e in toxicity.candidates(toxicity.words_of(texts[i])):
            want[bool(x)][e] = want[bool(x)].get(e, 0) + 1
    for c in (True, False):
        assert {r.entry: r.n for r in toxicity.entry_counts(learned.filter(f"toxic = {c}")).collect()} == want[c]
    wanted = np.zeros(toxicity.BUCKETS, bool)
    wanted[toxicity.bucket_of("moron")] = True
    got = {r.entry for r in toxicity.entry_counts(learned, wanted).collect()}
    assert "moron" in got and got == {e for e in {**want[True], **want[False]} if wanted[toxicity.bucket_of(e)]}


def test_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    for docs, own in ((odd, labels), (odd, labels.limit(0)), (none, labels), (none, labels.limit(0))):
        rows = toxicity.toxicity_by_id(docs.withColumn("toxic", docs.n_chars), own).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
