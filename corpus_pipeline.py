"""From raw documents to token ids: a pipeline of five operators.

``STAGES`` lists (name, function) in order.  Each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.

* language identification learns from the documents' own labels (four of five folds) and
  drops what it rejects: texts without a letter and texts far from every language;
* near-duplicate detection (five-word shingles, similarity 0.8) keeps the document of the
  smallest id of each group;
* decontamination drops documents that overlap a benchmark item;
* the secret scan replaces credentials in the texts and drops nothing;
* BPE encoding gives each document's ids and what they decode to.

Verdicts are on rows, not on ids: of rows that repeat an id, or have none, each is judged by
its own text, and of equal rows one stays.  An empty table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.llm import bpe_codec, decontaminate, language_id, minmax_dedup, secret_grammar, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(language_id.fold() != 0).select("text", "lang"))
    told = language_id.identify(docs.select(*COLUMNS), model, lang_out="__lang", score_out="__score", rejected_out="__rejected")
    return told.where("not __rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = store.row_keys(docs, "doc_id", "__key")
    found = minmax_dedup.near_duplicates(rows, id_col="__key", k=5).where("not kept").select(F.col("doc_id").alias("__key"))
    return rows.join(store.written(found, "pipeline-copies"), "__key", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = store.row_keys(docs, "doc_id", "__key")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.overlaps(rows, benchmark, id_col="__key").select(F.col("doc_id").alias("__key")).distinct()
    return rows.join(store.written(found, "pipeline-contaminated"), "__key", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = store.written(secret_grammar.scan(docs), "pipeline-secrets")
    model = secret_grammar.learn(scanned, docs)
    return secret_grammar.redact(docs.select(*COLUMNS), model, "text", "n_chars")


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe_codec.round_trip(docs, vocabulary)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", redact_secrets),
    ("BPE encoding", encode_bpe),
]

#: No stage is expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
