import random

from pyspark.sql import functions as F

import corpus_pipeline
from frameloom.llm import line_dedup

DOCS = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(docs, edits=3):
    """(id, text): numbers of the lines that go, by comparing all pairs of lines. Equal rows are one document."""
    rank = {row: i for i, row in enumerate(dict.fromkeys(docs))}
    first, lines = {}, []
    for (doc, text), at in rank.items():
        for no, line in enumerate(text.split("\n") if text is not None else []):
            line = line.strip(" \t\x0b\x0c\r")
            if any(c.isalnum() for c in line):
                lines.append(((doc, text), no, line, (at, no)))
                first[line] = min(first.get(line, (at, no)), (at, no))
    words = {x: x.split() for x in first}
    near = set()
    for a in first:
        for b in first:
            k = min(min(len(words[a]), len(words[b])) // 8, edits)
            if k and first[b] < first[a] and abs(len(words[a]) - len(words[b])) <= k and distance(words[a], words[b]) <= k:
                near.add(a)
    gone = {}
    for row, no, line, at in lines:
        if line in near or at > first[line]:
            gone.setdefault(row, set()).add(no)
    return {row: sorted(x) for row, x in gone.items()}


def edited(rng, words, most):
    words = list(words)
    for _ in range(rng.randint(0, most)):
        i, kind = rng.randrange(len(words) + 1), rng.randrange(3)
        words[i : i + (kind != 0)] = [rng.choice("abc") * rng.randint(1, 9)] if kind < 2 else []
    return words


def found(docs, **how):
    texts = {}
    for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect():
        texts[r.doc_id, r.k] = (r.doc_id, r.text)
    return {texts[r.doc_id, r.text_key]: r.gone for r in line_dedup.removals(docs, **how).collect()}


def some_lines(seed, vocabulary):
    rng = random.Random(seed)
    pool = [[rng.choice(vocabulary) for _ in range(n)] for n in (1, 2, 7, 8, 9, 12, 15, 16, 17, 19, 20, 23, 24, 25, 31, 40, 77, 130) for _ in range(2)]
    lines = [" ".join(edited(rng, rng.choice(pool), 4)) for _ in range(420)]
    return list(enumerate("\n".join(lines[i : i + 4]) for i in range(0, 420, 4)))


def test_equals_all_pairs(spark):
    for seed, vocabulary in ((5, ["a", "b"]), (6, "der die und été 日本 \U0001f642 x1 y2 z3 , . foo bar".split())):
        docs = some_lines(seed, vocabulary)
        assert found(spark.createDataFrame(docs, DOCS)) == plain(docs)
    docs = some_lines(7, "abcdefgh")
    one = found(spark.createDataFrame(docs, DOCS), edits=1)
    assert one == plain(docs, 1) and one != plain(docs)


def test_hot_variants_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    rng = random.Random(3)
    start = "every line of this large group begins with the same long stretch of words and goes on with"
    docs = [(i, f"{start} {' '.join(rng.choice('abcdef') * rng.randint(1, 6) for _ in range(rng.randint(5, 9)))}") for i in range(150)]
    assert found(spark.createDataFrame(docs, DOCS)) == plain(docs)
    docs = some_lines(11, ["a", "b", "c"])
    assert found(spark.createDataFrame(docs, DOCS)) == plain(docs)


def test_a_large_group_of_near_copies_costs_as_much_as_it_has_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 12)
    made = []
    for name in ("near_pairs", "near_in_keys"):
        if own := getattr(line_dedup, name, None):
            monkeypatch.setattr(line_dedup, name, lambda lines, edits, own=own: made.append(own(lines, edits)) or made[-1])
    rng = random.Random(21)
    base = [f"w{rng.randrange(1000)}" for _ in range(40)]
    # Too far from the base, but not from each other: these are found among the lines that were settled first.
    other = [*base[:30], *(f"x{i}" for i in range(8)), *base[38:]]
    docs = [(0, " ".join(base))] + [(i, " ".join(edited(rng, other if i % 20 == 7 else base, 3))) for i in range(1, 160)]
    gone = found(spark.createDataFrame(docs, DOCS))
    assert gone == plain(docs) and len(gone) > 140
    assert sum(rows.count() for rows in made) < 1.2 * len(docs)


def test_within_and_shifts():
    rng = random.Random(9)
    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 14))] for _ in range(2))
        k = rng.randint(0, 5)
        assert line_dedup.within(a, b, k) == (distance(a, b) <= k)
    for t in range(20):
        assert {abs(a - b) for a in line_dedup.shifts(t) for b in line_dedup.shifts(t)} >= set(range(t + 1))


def test_a_line_near_an_earlier_one_goes_even_if_that_goes_too(spark):
    a = "one two three four five six seven eight nine"
    docs = [(1, a), (2, a.replace("two", "2")), (3, a.replace("two", "2").replace("six", "6")), (4, "one two")]
    assert set(found(spark.createDataFrame(docs, DOCS))) == {docs[1], docs[2]}


def test_odd_tables(odd, none):
    assert line_dedup.removals(none).count() == 0
    assert line_dedup.deduped(none).columns == none.columns
    clashing = odd.withColumns({"line_no": F.lit(1), "gone": F.lit(2), "__id": F.lit("x"), "__GONE": F.lit("y"), "__left": F.lit(0), "text_key": F.lit(3)})
    out = line_dedup.deduped(clashing)
    assert out.columns == clashing.columns and {tuple(r)[5:] for r in out.collect()} == {(1, 2, "x", "y", 0, 3)}
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert (1, None) in rows and (2, "") in rows and len([r for r in rows if r[0] == 4]) == 2
    assert not [r for r in rows if r[0] == 5 and "All was well" in r[1]]


def test_one_very_common_line(spark):
    same = "this very common line stands in every single document"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(same + "\n"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    assert line_dedup.removals(docs).count() == 2999


def test_unique_text_of_repeated_and_null_ids_stays(spark):
    same = "this line stands in two of the documents"
    docs = [(1, same), (None, f"a first line of some length, once\n{same}"), (None, "another first line, not seen elsewhere\nand its second line is unique as well"), (None, "b"), (5, f"{same}\nthe rest of five"), (5, "the start of a longer version\nthe rest of five"), (7, "a"), (7, "a")]
    out = [(r.doc_id, r.text) for r in line_dedup.deduped(spark.createDataFrame(docs, DOCS)).collect()]
    left = [(1, same), (None, "a first line of some length, once"), docs[2], (None, "b"), (7, "a"), (7, "a")]
    five = [[(5, "the rest of five"), (5, "the start of a longer version")], [docs[5]]]  # which text of an id is first is settled by its hash
    assert sorted(out, key=str) in [sorted(left + x, key=str) for x in five]
    lines = {x.strip() for _, t in docs for x in t.split("\n")}
    assert {x.strip() for _, t in out for x in t.split("\n")} == lines


def test_exact_repeats_of_short_lines(spark):
    docs = [(1, "Contents\n--\nshort line A"), (2, " Contents\n--\nshort line B"), (3, "7\n7\n\n\n日")]
    docs = spark.createDataFrame(docs, DOCS)
    assert {k[0]: x for k, x in found(docs).items()} == {2: [0], 3: [1]}
    stage = corpus_pipeline.lines(spark, docs, "")
    assert {r.doc_id: r.text for r in stage.collect()} == {1: "Contents\n--\nshort line A", 2: "--\nshort line B", 3: "7\n\n\n日"}
