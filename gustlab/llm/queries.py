"""Registered queries of this subpackage: each numbered operator over its whole table, and the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustlab.llm import (decontaminate, embeddings, fill_middle, html_text, jaccard, language, lm, merkle, mixing,
                         sentence_pieces, token_counts, toxicity, warc)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def remainder(id, by: int) -> F.Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(id.cast("string")) % by


def _held_out(id, by: int, value: int) -> F.Column:
    return F.coalesce(remainder(id, by) == value, F.lit(False))


def op1_embedding_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Operator 1 over all embeddings: equal labels, cosine of 0.98 or more."""
    return embeddings.near_duplicates(_table(spark, d, "embeddings"))


def op2_warc_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Operator 2: all pages written to WARC archives and read back."""
    return warc.roundtrip(_table(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_html_text(spark: SparkSession, d: str) -> DataFrame:
    """Operator 3: the main text of all pages."""
    return html_text.extract(_table(spark, d, "pages"), keep=["page_id", "url"])


def op5_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Operator 5: tokens of all documents, by scanning flat token files for the end-of-document id."""
    return token_counts.count_tokens(_table(spark, d, "documents"))


def op7_backoff_automaton(spark: SparkSession, d: str) -> DataFrame:
    """Operator 7 over all documents; learns from the ids whose crc32 leaves no 2 modulo 7 (a null id is neither learned from
    nor held out)."""
    got = lm.score(_table(spark, d, "documents"), learn=lambda id: remainder(id, 7) != 2)
    return got.withColumn("held_out", _held_out(F.col("doc_id"), 7, 2))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Operator 4 over all documents; learns from labelled ids whose crc32 leaves 0 or 2 modulo 3."""
    docs = _table(spark, d, "documents")
    model = toxicity.fit(docs, _table(spark, d, "labels"), learn=lambda id: remainder(id, 3) != 1)
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", _held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op6_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    """Operator 6 over all documents: weights 3, 1, 2 in turn, 150 % of all words, at most twice a source's size."""
    return mixing.mix(_table(spark, d, "documents"), keep=["doc_id"])


def op8_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    """Operator 8: all passages of all documents against the whole benchmark."""
    return decontaminate.annotate(_table(spark, d, "documents"), _table(spark, d, "benchmark"), keep=["doc_id"])


def op9_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Operator 9 over all documents: five-word shingles, similarity of 0.8 or more."""
    return jaccard.join(_table(spark, d, "documents"))


def op10_language(spark: SparkSession, d: str) -> DataFrame:
    """Operator 10 over all documents; learns from the ids whose crc32 leaves no 0 modulo 5."""
    docs = _table(spark, d, "documents")
    model = language.fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    return language.identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id", _held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op11_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Operator 11 over all documents; the texts of the ids whose crc32 5 divides are lower-cased after the fact."""
    got = merkle.proofs(_table(spark, d, "documents"), changed={"text": merkle.lower_ascii(F.col("text"))},
                        tampered=remainder(F.col("doc_id"), 5) == 0)
    return got.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def fill_middle_digests(docs: DataFrame) -> DataFrame:
    """Operator 12 with digests in place of its outputs and of the texts rebuilt from them."""
    got = fill_middle.transform(docs, keep=["doc_id"])
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_fill_middle(spark: SparkSession, d: str) -> DataFrame:
    """Operator 12 over all documents: 90 of a hundred cut, 20 of a hundred of these with the suffix first."""
    return fill_middle_digests(_table(spark, d, "documents"))


def op13_sentence_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Operator 13 over all documents: encoded with begin and end ids, decoded again; ``covered_bytes`` is how many bytes of
    the text the spans of the pieces cover."""
    import public_tokenizers

    model = sentence_pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    got = sentence_pieces.encode(_table(spark, d, "documents"), model, keep=["doc_id"], decoded="decoded")
    covered = F.aggregate(F.zip_with("ends", "begins", lambda e, b: e - b), F.lit(0).cast("long"), lambda s, x: s + x)
    return got.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"), covered.alias("covered_bytes"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_warc_roundtrip, op3_html_text, op4_toxicity, op5_token_counts, op6_mix_sources,
    op7_backoff_automaton, op8_decontaminate, op9_ngram_jaccard, op10_language, op11_merkle_manifest,
    op12_fill_middle, op13_sentence_pieces)}

_OP1_SQL = """
    WITH RECURSIVE e AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e),
    link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
             WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
    ids AS (SELECT vec_id FROM embeddings),
    c AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
    k AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
           vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
    FROM ids LEFT JOIN c ON vec_id = c.a LEFT JOIN k ON vec_id = k.a
"""

_OP2_SQL = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
               FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)
"""

ORACLE = {"op1_embedding_near_dedup": _OP1_SQL, "op2_warc_roundtrip": _OP2_SQL, "op6_mix_sources": mixing.ORACLE,
          "op11_merkle_manifest": merkle.ORACLE, "op12_fill_middle": fill_middle.ORACLE}
