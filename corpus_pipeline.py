"""From documents to packed sequences: toxicity, SimHash near-dedup, PII, mixing, packing.

Every stage takes (spark, docs, sf_dir), reads what its predecessor wrote, and works on all of it. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltspan.llm import mixing, near_copies, packing, pii, toxicity
from quiltspan.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold. Null texts stay."""
    score = toxicity.score_column(*toxicity.train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score("text") < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, five-word shingles at a similarity of 0.8 or more, found by SimHashes."""
    return near_copies.survivors(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; n_chars follows the text."""
    return pii.mask_pii(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, which may be none."""
    mixed = mixing.mix(docs, whole_rows=True).where("repeats > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL has the toxicity grammar, SimHash or the tokenizer; tests compare the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
