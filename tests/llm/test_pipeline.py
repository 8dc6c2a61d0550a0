import random
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frameloom.llm import decontam, langid, line_dedup

sys.path.insert(0, str(Path(__file__).parent))
from test_line_dedup import plain as plain_lines  # noqa: E402
from test_packing import WORD, check_places  # noqa: E402
from test_simhash import plain_components, plain_fingerprint  # noqa: E402

import corpus_pipeline  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"en": ["the", "ing", "on", "st", "er"], "de": ["sch", "ung", "ei", "tz", "ver"]}


def sentence(rng, lang, n=12):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    bench = [(i, sentence(rng, "en", 15)) for i in range(4)]
    texts, common = [], sentence(rng, "en")
    for i in range(150):
        lang = "de" if i % 4 == 0 else "en"
        lines = [sentence(rng, lang) for _ in range(rng.randint(3, 8))]
        if i % 5 == 0:
            lines.insert(1, common)
        if i % 10 == 3:
            lines.append(bench[rng.randrange(4)][1].upper())
        texts.append(("\n".join(lines), lang))
    texts += [texts[7], (texts[8][0] + " end", "en"), (None, "en"), ("", "en"), ("1234 5678", "en"), ("日本語の長い文章です。" * 60, None)]
    docs = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_language_stage_drops_no_ngram_of_a_large_model(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, folder).collect())

    def dropped(*_):
        raise AssertionError("n-grams are dropped")

    monkeypatch.setattr(langid, "fitting", dropped)
    monkeypatch.setattr(langid, "MODEL_BYTES", 12_000)
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, folder).collect()) == whole and len(langid.fit_by_id(docs).parts) > 1


def test_lines_stage_makes_few_rows_of_a_near_group(spark, monkeypatch):
    made = []
    for name in ("near_pairs", "near_in_keys"):
        if own := getattr(line_dedup, name, None):
            monkeypatch.setattr(line_dedup, name, lambda lines, edits, own=own: made.append(own(lines, edits)) or made[-1])
    base = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join([*base[: i % 40], f"x{i}", *base[i % 40 + 1 :]]), "en", "a", 0) for i in range(120)]
    left = corpus_pipeline.lines(spark, spark.createDataFrame(docs, DOCS), "").collect()
    assert [r.doc_id for r in left] == [0] and sum(rows.count() for rows in made) < 3 * len(docs)


def test_stages_equal_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        rows[name] = (before, docs.collect())
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = rows["language"]
    assert {r.doc_id for r in after} == set(range(152))
    before, after = rows["lines"]
    gone = {row[0]: x for row, x in plain_lines(sorted(before.items())).items()}
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, [])) for d, t in before.items()}
    assert {r.doc_id: r.text for r in after} == {d: t for d, t in want.items() if t.strip() or not before[d].strip()}
    before, after = rows["near_duplicates"]
    component = dict(plain_components([(d, plain_fingerprint(t)) for d, t in before.items()]))
    assert {r.doc_id: r.text for r in after} == {d: t for d, t in before.items() if component[d] == d}
    before, after = rows["decontaminate"]
    assert any("\n" in r.text for r in after) and {r.doc_id for r in after} <= set(before)
    windows = {tuple(decontam.words_of(t)[k : k + 10]) for _, t in bench for k in range(6)}
    for r in after:
        own = decontam.words_of(r.text)
        assert not any(tuple(own[k : k + 10]) in windows for k in range(len(own) - 9))
        assert r.text == before[r.doc_id] or len(own) < len(decontam.words_of(before[r.doc_id]))
    before, after = rows["pack"]
    check_places(after, 2048)
    library = Tokenizer.from_file(WORD)
    for r in after:
        ids = library.encode(before[r.doc_id], add_special_tokens=False).ids + [0]
        own = ids[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)) and r.start == 2048 * r.piece
    assert {r.doc_id for r in after} == set(before)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 100


def test_stages_take_odd_tables(spark, odd, none, folder):
    clashing = odd.withColumns({c: F.lit(1) for c in ("items", "hit_words", "gone", "__id", "__text", "rejected", "component_id")})
    for docs in (clashing, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            rows = out.collect()
            if name != "pack":
                assert out.columns == docs.columns and {tuple(r)[5:] for r in rows} <= {(1,) * 7}
