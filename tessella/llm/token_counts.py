"""Operator 10: token counts through a digest cache.

A count belongs to the SHA-256 of the text (null: the empty text) and the SHA-256 of the tokenizer file, so a new version of the
file starts afresh. Digests that the cache has are not encoded. Of the others each distinct text is encoded once and its count is
appended to the cache: texts that occur once where they are read, repeated ones after a shuffle that brings one text a digest.
Nothing else about the text is normalised, because any other change could change its count.

Edge cases: a null text counts as the empty text (0 tokens); strings of special tokens inside a text are treated as the library does
by default; null doc_ids and rows repeated in full are counted each; a digest that two jobs appended at the same time counts once; an
empty table leaves the cache as it is and gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, pick, small_enough

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Texts handed to the library at once.
CHUNK = 64
CACHE = "tokenizer string, digest string, n_tokens long"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@functools.lru_cache(maxsize=1)
def counter(path: str, version: str | None = None):
    """A function from a list of texts to their token counts; a worker keeps the last one for its next tasks.

    ``version`` is the digest of the file: a worker that has an older version of the same file loads it anew.
    """
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def _encoder(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, version)
        for batch in batches:
            out: list[int] = []
            for at in range(0, batch.num_rows, CHUNK):
                out += count(batch.column("text").slice(at, CHUNK).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.int64())], ["digest", "n_tokens"])

    return run


class CountCache:
    """The stored counts: Parquet files under ``path``, by tokenizer digest, that only grow."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], CACHE).write.mode("append").parquet(path)

    def counts(self, tokenizer: str) -> DataFrame:
        """One row a digest, also where jobs at the same time appended the same one."""
        return self.stored(tokenizer).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def stored(self, tokenizer: str) -> DataFrame:
        return self.spark.read.schema(CACHE).parquet(self.path).where(F.col("tokenizer") == tokenizer).select("digest", "n_tokens")

    def append(self, tokenizer: str, counted: DataFrame) -> None:
        counted.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(self.path)


def count_tokens(docs: DataFrame, path: str, cache: CountCache | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, digest, n_tokens. ``path`` names the tokenizer file on every machine."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cache = cache or CountCache(spark, f"{scratch.path}/cache")  # of this call alone: it goes with the other tables
    version = file_digest(path)
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"))
    keys = scratch.table(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "keys")

    known = cache.stored(version)
    repeated = keys.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest").join(known, "digest", "left_anti")
    repeated = scratch.table(repeated, "repeated")
    elsewhere = small_enough(scratch.table(keys.join(known, "digest", "left_semi").select("digest").distinct().union(repeated), "elsewhere"))
    once = rows.join(elsewhere, "digest", "left_anti").select("digest", "text")
    one = rows.join(small_enough(repeated), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    encode = lambda df: df.mapInArrow(_encoder(path, version), "digest string, n_tokens long")
    cache.append(version, scratch.table(encode(once).unionByName(encode(one)), "new"))
    counts = scratch.table(cache.counts(version), "counts")  # written, so that the join can split a digest that very many rows have
    scratch.drop_all_but("keys", "counts")
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "digest", "n_tokens")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """The table comes in twice: first half of it, as an earlier batch, then all of it, of which the cache knows that half."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    cache = CountCache(spark, f"{scratch.path}/cache")
    count_tokens(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), public_path(TOKENIZER), cache)
    counted = count_tokens(docs, public_path(TOKENIZER), cache)
    scratch.drop_all_but()
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
