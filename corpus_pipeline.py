"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet into the
shared folder and reads again for the next. All but the last return the columns of documents.

1. language: documents whose language is rejected (or that have no letters) go.
2. lines: exact repeats of lines and lines within a few words of an earlier one go; documents of which no word is left go.
3. near_duplicates: of each SimHash component the document of the smallest id stays.
4. decontaminate: spans of benchmark passages leave the texts; documents of which no word is left go.
5. pack: the rest as token pieces in sequences.

Odd input: a null text or one without letters goes in the first stage; an empty text can't come further. Rows of equal
id and text, and rows without an id, are documents of their own in stages 1, 2 and 4; in stage 3 they are copies like
others, and one stays. An empty table gives an empty result in every stage. Other columns, whatever their names, stay as
they are until pack, which reads doc_id and text. Texts are whole at any length; ties go by doc_id, then by text hash.

Near copies meet the third stage without the lines that they share with an earlier document, so what is left of them
is seldom near its original there: they are thinned by the second stage rather than dropped by the third.

SQL can't express the stages (models, fingerprints, tokens), so each is tested against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import decontam, langid, line_dedup, packing, simhash
from frameloom.llm.common import table, written
from frameloom.llm.queries import tokenizer_path

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    columns = docs.columns
    names = {"lang_pred": "__pred", "score": "__score", "rejected": "__rejected"}
    safe = docs.withColumnsRenamed({c: f"__own_{c}" for c in columns})
    found = langid.predictions(safe, langid.fit_by_id(docs), safe.columns, "__own_text").withColumnsRenamed(names)
    return found.filter("NOT __rejected").select(*[F.col(f"`__own_{c}`").alias(c) for c in columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their near-duplicate lines."""
    return line_dedup.deduped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(packing.pieces_of(docs, tokenizer_path("word_bpe_49k.json")).drop("ids"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
