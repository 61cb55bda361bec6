"""The corpus pipeline: toxicity, language, near duplicates, benchmark passages, source mix.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustlab.llm import decontaminate, jaccard, language, mixing, toxicity
from gustlab.llm.queries import remainder
from gustlab.session import cut_lineage, scratch_path

#: A text whose best language profile is below this cosine is no text of a learned language.
MIN_LANGUAGE_SCORE = 0.05


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that operator 4 predicts toxic; it learns from the labelled documents outside its held-out third."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=lambda id: remainder(id, 3) != 1)
    return _only(toxicity.score(_boxed(docs), model).where("predicted = 0"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language (operator 10): null texts, texts without a letter, or a cosine with every
    profile below ``MIN_LANGUAGE_SCORE``. Profiles are learned outside the held-out fifth."""
    model = language.fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    if not model:  # nothing was learned: nothing can be rejected but texts without letters
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return _only(language.identify(_boxed(docs), model).where(
        F.col("lang_pred") != "und").where(F.col("score") >= MIN_LANGUAGE_SCORE))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of each component of operator 9; of rows that share an id one stays. Rows with
    a null id stay."""
    found = jaccard.join(docs)
    copies = found.where("not kept").select("doc_id")
    left = docs.join(copies, "doc_id", "left_anti")
    many = cut_lineage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    if many.isEmpty():
        return left.select(*docs.columns)
    once = left.join(many, "doc_id", "left_anti").select(*docs.columns)
    # ties among rows of one id: the first text, and so on through the columns
    again = left.join(many, "doc_id", "left_semi").select(*docs.columns)
    first = again.groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("r"))
    return once.unionAll(first.select(*["doc_id" if c == "doc_id" else F.col(f"r.`{c}`").alias(c) for c in docs.columns]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which operator 8 verifies a passage of the benchmark."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _only(decontaminate.annotate(_boxed(docs), bench).where("not contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents with their copies in the mix (0: left out), and the words taken."""
    return mixing.mix(docs)


def _boxed(docs: DataFrame) -> DataFrame:
    """The row in one struct beside its text, so no result column can replace a column of the documents."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def _only(df: DataFrame) -> DataFrame:
    return df.select("row.*")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mix_sources", mix_sources),
]

#: Trained models and the search of passages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
