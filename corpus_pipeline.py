"""A corpus pipeline of five stages: toxicity, line dedup, near-dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of documents;
where a stage changes texts, n_chars follows.

Edge cases: a null text is an empty text from the line dedup on; documents without words are near duplicates of nothing and stay;
rows without a doc_id are treated by their text; of rows repeated in full the near-dedup keeps one. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import line_dedup, minhash_dedup, mixing, pieces, toxicity
from tessella.llm.common import Scratch, pick
from tessella.llm.token_counts import public_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that score this or more are rejected.
TOXIC = 0.5


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows outside the held-out fold; rows that score TOXIC or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, COLUMNS).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose key stands in ten documents or more go everywhere."""
    return line_dedup.dedup_lines(docs, COLUMNS).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id."""
    return minhash_dedup.keep_one(docs, COLUMNS)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.mix(docs, COLUMNS)


def encode_pieces(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document taken: doc_id, source, piece_ids and n_pieces; round_trip says whether the ids decode to the text."""
    encoded = pieces.encode(docs, public_path(pieces.MODEL), ("doc_id", "source", "text"))
    return encoded.select("doc_id", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Learned scores, near duplicates and piece ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), *COLUMNS)
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
