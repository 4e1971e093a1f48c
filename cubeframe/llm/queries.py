"""The queries of this subpackage: each operator, with production parameters, on its whole table; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, exact_dedup, html_extract, langid, license_scan, minhash_dedup, mixing, packing, quality, sharding


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public 49k word BPE, where the box has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.ratings_of(_table(spark, sf_dir, "labels")))
    return quality.graded(docs, model, ["doc_id"]).withColumn("kept", F.col("p_top") >= model.least)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, docs.where(langid.fold(F.col("doc_id")) != 1))
    return found.select("doc_id", (langid.fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: source/language/block of ids/name, where every 64th id is its directory's licence file."""
    ident = F.col("doc_id")
    name = F.when(ident % 64 == 0, F.concat(F.lit("LICENSE."), ident.cast("string"))).otherwise(F.concat(ident.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.expr("cast(doc_id div 256 AS string)"), name)
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.minhash_dedup(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_html_extraction, op3_sharding, op4_embeddings, op5_quality, op6_language, op7_mixing, op8_licenses, op9_minhash, op10_packing)
}

ORACLE: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n
            FROM documents
        ), placed AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM placed""",
    # Classes of equal sets, links between them by shared shingles, and what is reachable.
    "op9_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
            FROM words
        ), classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
        entries AS (SELECT rep, n, unnest(s) AS x FROM classes),
        links AS (
            SELECT a.rep AS u, b.rep AS v FROM entries a JOIN entries b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach AS (SELECT rep AS u, rep AS v FROM classes UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u),
        comps AS (SELECT u AS rep, min(v) AS component_id FROM reach GROUP BY u)
        SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
        FROM sets d LEFT JOIN classes k ON k.s = d.s LEFT JOIN comps c ON c.rep = k.rep""",
}
