"""The corpus pipeline: language ID, line dedup, n-gram Jaccard dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) with docs as written by the stage before, works on all rows it gets, and returns the columns of documents (the last
one its pieces). run() writes each stage's result to shared storage and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import langid, line_dedup, ngram_join, packing, secrets
from kinelake.llm.common import Scratch, table
from kinelake.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is undetermined, or predicted with less than this score, are rejected.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; null and empty texts, those without letters and those with a score below LEAST_SCORE go.

    Whole texts are judged, very long ones too. Rows that repeat are judged alike, each by itself, whatever their id. Without any label to train on, all
    documents with letters stay. An empty table stays empty; columns beyond those of documents are left out, whatever their names.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    return langid.predict(docs, model).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three-line windows; documents left without text go, as nothing of their own is in them.

    Null, empty and short texts stay as they are. Of equal windows the one with the smallest id, then place, is the first; rows that repeat id and text are kept
    alike. An empty table stays empty; columns beyond those of documents are left out, whatever their names.
    """
    d = line_dedup.deduplicated(Scratch(spark), docs, size=3)
    return d.where((F.col("n_removed") == 0) | (F.trim("text") != "")).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the one with the smallest id.

    Texts without words have no links and stay, null ones and those of null ids too. Of rows that repeat both id and text one stays; other texts under the same id are
    one node of the graph and stay or go together. Ties cannot arise, as ids are told apart; columns beyond those of documents are left out.
    """
    out = ngram_join.joined(Scratch(spark), docs, percent=80, k=5)
    gone = out.where("component_id <> doc_id").select("doc_id").distinct()
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(COLUMNS)
    if again.isEmpty():
        return kept
    twice = kept.join(again, "doc_id", "left_semi").select(COLUMNS).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(COLUMNS).union(twice)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; every document stays, null and empty texts as they are, repeated rows alike.

    n_chars is counted anew where a text changed. Overlapping secrets become one mark. An empty table stays empty; other columns are left out.
    """
    d = secrets.redacted(docs.select(*COLUMNS, F.col("text").alias("__old")))
    return d.withColumn("n_chars", F.when(F.col("text") != F.col("__old"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens: null and empty texts as their end token alone, rows that repeat as documents each; see packing.packed."""
    return packing.packed(docs, tokenizer_file("word_bpe_49k.json").decode(), end=1)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("secret scans", redact), ("packing", pack)]
#: The language model and the tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch, before = Scratch(spark), None
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
