"""One query per operation, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.llm import (
    bisectors, chat, decontamination, edit_counts, fingerprints, jaccard_join, main_text, mixing, periodic_runs, sharding, token_files,
    toxicity, warc)
from opslens.llm.staging import shared_folder, staged, table


def vocabulary() -> str:
    """The vocabulary file that documents are encoded with."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return main_text.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, with the places of those passages."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from the token files written for them."""
    folder = shared_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, vocabulary())
    return token_files.documents(token_files.files(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix; texts are read once, only their sizes are kept for the two passes after."""
    docs = table(spark, sf_dir, "documents")
    sizes = staged(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "mix-sizes")
    return mixing.mix(sizes, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; texts are read once, only size and checksum go through the rankings."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard(staged(slim, "shard-sizes"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """The model learned from the labels that are not held out."""
    return toxicity.trained(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"))))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scored(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text."""
    docs = table(spark, sf_dir, "documents")
    return fingerprints.edited_fingerprints(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of each document."""
    return jaccard_join.near_components(table(spark, sf_dir, "documents")).drop("text_hash")


CONTROL = "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and one of control strings, as read back from their formatted pieces."""
    rows = table(spark, sf_dir, "conversations")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    folder = shared_folder(spark, "chat")
    chat.write(chat.canonical_rows(rows).unionByName(own), folder)
    return chat.digests(spark.read.parquet(folder))


def op10_edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each document before and after three edits: its middle third's first 40 characters replaced by its
    own first 24, a line put in at its middle, its last 10 characters cut off."""
    docs = table(spark, sf_dir, "documents")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda start, end, text: F.struct(start.alias("start"), end.alias("end"), text.alias("replacement"))
    edits = F.array(
        edit(F.floor(n / 3), F.floor(n / 3) + 40, F.substring("text", 1, 24)),
        edit(F.floor(n / 2), F.floor(n / 2), F.lit("\nOne more line.\n")),
        edit(n - 10, n + 100, F.lit("")))
    return edit_counts.count_edited(docs.select("doc_id", "text", edits.alias("edits")), vocabulary())


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as read back from the archives written for them: first one gzip stream an archive, then a member a record."""
    streams, members = shared_folder(spark, "warc-streams"), shared_folder(spark, "warc-members")
    warc.write_streams(table(spark, sf_dir, "pages"), streams)
    warc.normalised(spark, streams, members)
    return warc.pages_of(spark, members).drop("url")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of each document, of which one in ten has runs planted."""
    docs = table(spark, sf_dir, "documents")
    return periodic_runs.digests(periodic_runs.with_runs(docs, periodic_runs.planted(F.col("doc_id"), F.col("text")), ["doc_id"]))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of each vector."""
    return bisectors.clustered(table(spark, sf_dir, "embeddings"))


QUERIES = (op1_main_text, op2_benchmark_passages, op3_token_files, op4_toxicity, op5_mix_sources, op6_fingerprints, op7_shards, op8_near_copies, op9_chat, op10_edited_counts,
           op11_warc, op12_periodic_runs, op13_centroid_clusters)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {q.__name__: q for q in QUERIES}
