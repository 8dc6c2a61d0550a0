"""The queries' columns and cases, on small tables with odd rows."""

import hashlib

import pytest

import __spark_entry__ as entry
from frameloom.llm.queries import queries

COLUMNS = {
    "op1_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op3_": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op4_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "removed_lines": "string"},
    "op6_": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9_": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op10_": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


@pytest.fixture(scope="module")
def folder(odd, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    more = spark.createDataFrame([(50, 'mail a@b.cd from 10.0.0.1, password = "hunter22"', "en", "a", 1), (51, None, None, None, None)], odd.schema)
    odd.unionByName(more).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "the cat sat on the mat and the dog sat"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_one_query_for_each_operator():
    names = sorted(queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n[: n.index("_") + 1] for n in names] == list(COLUMNS)
    assert set(queries()) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_columns_and_rows(spark, folder, name):
    df = queries()[name](spark, folder)
    want = COLUMNS[name[: name.index("_") + 1]]
    assert {c: t for c, t in df.dtypes if c in want} == want
    rows = df.collect()
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert len(rows) >= n if name.startswith("op8") else len(rows) == n
    by = {r.doc_id: r for r in rows}
    if name.startswith(("op6", "op9")):
        assert by[50].base_sha256 == hashlib.sha256(by[50].spans.encode()).hexdigest()
        assert by[50].spans == ("assign:27:47" if name.startswith("op6") else "email:5:11,ip:17:25")
        assert by[51].base_sha256 == hashlib.sha256(b"").hexdigest()
    if name.startswith("op2"):
        assert by[4].n_hit == 10 and by[4].items_sha256 == hashlib.sha256(b"1").hexdigest() and not by[51].contaminated
    if name.startswith("op8"):
        assert {r.length for r in rows if r.doc_id == 51} == {1}
