"""From raw documents to token ids: five stages of the corpus operators.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept; the
runner writes a stage's result as Parquet and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrec.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from lumenrec.llm.storage import materialize, restrict

#: Documents with this score or more are rejected.
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; empty texts stay. A column ``score`` of the documents is kept."""
    settings = toxicity.Settings()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, "toxic", settings), settings)
    aside = f"_{uuid.uuid4().hex}"
    scored = toxicity.score(docs.withColumnRenamed("score", aside), model).where(F.col("score") < TOXIC_FROM).drop("score")
    return scored.withColumnRenamed(aside, "score").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those left without words go."""
    return line_dedup.remove_lines(docs, materialize(line_dedup.line_components(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the smallest id."""
    classes = jaccard_join.jaccard_components(docs)
    copies = materialize(classes.where("doc_id <> component_id").select("doc_id").distinct())
    return restrict(docs, copies, "doc_id", "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say, rounded at random, so that small sources weigh more; each at least once."""
    rates = mixing.fit_rates(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.apply_rates(docs, rates)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(docs, path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokenize),
]

#: A trained model and fuzzy matching are not SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
