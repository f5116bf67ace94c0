"""From documents to training tokens, in stages that each read what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opslens.llm import decontamination, jaccard_join, mixing, queries, token_files, toxicity
from opslens.llm.staging import shared_folder, staged, table


#: Near copies share four fifths of their runs of five words.
NEAR_WIDTH, NEAR_THRESHOLD = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return toxicity.clean(docs, queries.toxicity_model(spark, docs, sf_dir))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    return jaccard_join.deduplicated(docs, width=NEAR_WIDTH, threshold=NEAR_THRESHOLD)


def reject_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what each document has there."""
    folder = shared_folder(spark, "corpus-tokens")
    token_files.write(docs, folder, queries.vocabulary())
    return token_files.documents(token_files.files(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


STAGES = [
    ("toxicity", reject_toxic), ("near copies", keep_one_of_near_copies), ("benchmark", reject_benchmark), ("mix", mix_sources),
    ("tokens", write_tokens)]

#: The toxicity machine and the alignment of passages have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
