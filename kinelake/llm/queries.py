"""The thin queries of this subpackage, their production parameters, and their SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import bitslice, langid, licenses, line_dedup, ngram_join, packing, permutation, pieces, secrets, substring_dedup
from kinelake.llm.common import Scratch, table


def tokenizer_file(name: str) -> bytes:
    """A public tokenizer's file, read on the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(Scratch(spark), table(spark, sf_dir, "documents"), percent=80, k=5)


def op2_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), digests=True)


def op4_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.spans(Scratch(spark), table(spark, sf_dir, "documents"), percent=80)


def op6_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda x: x.k == secrets.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return d.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(3), 256).alias("base_sha256"), secrets.listed().alias("spans"))


def op7_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return bitslice.top_k(Scratch(spark), v, v.where(F.col("vec_id") % 50 == 0), k=5, scale=256.0)


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.deduplicated(Scratch(spark), table(spark, sf_dir, "documents").select("doc_id", "text"), size=3)
    return d.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op9_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json").decode(), end=1)


def op10_permutation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return permutation.neighbours(Scratch(spark), v, v.where(F.col("vec_id") % 50 == 0), k=5)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_byte_cnn_language, op3_sentencepiece, op4_license_digests, op5_paragraph_minhash, op6_markov_secrets, op7_bit_sliced_topk, op8_line_windows, op9_lexical_packing, op10_permutation_neighbours)}

ORACLE_SQL = {
    "op4_license_digests": licenses.sql(),
    "op8_line_windows": """
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS line FROM documents),
        l AS (SELECT doc_id, unnest(line) AS x, generate_subscripts(line, 1) - 1 AS i FROM d),
        w AS (SELECT doc_id, trim(x) AS a, i, lead(trim(x), 1) OVER o AS b, lead(i, 1) OVER o AS j, lead(trim(x), 2) OVER o AS c, lead(i, 2) OVER o AS k
              FROM l WHERE trim(x) <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi, first_value(k) OVER o AS fk
              FROM w WHERE k IS NOT NULL WINDOW o AS (PARTITION BY a, b, c ORDER BY doc_id, i)),
        later AS (SELECT *, unnest([i, j, k]) AS g FROM f WHERE NOT (doc_id = fd AND i = fi)),
        gone AS (SELECT DISTINCT doc_id, g FROM later WHERE doc_id <> fd OR g > fk),
        n AS (SELECT l.doc_id, count(*) AS n_lines, count(g) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE g IS NULL), '') AS t
              FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.g GROUP BY l.doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(t) AS text_md5 FROM d LEFT JOIN n USING (doc_id)""",
    "op7_bit_sliced_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
