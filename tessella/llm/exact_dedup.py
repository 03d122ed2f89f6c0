"""Operator 6: exact duplicates through a log-structured merge index.

* Texts are read and hashed once; what follows works on (digest, length, id, row) and, at the end, on the texts of duplicates alone.
* The rows go into the index in batches. Every task keeps a memtable (digest -> rows seen, best row) for what it reads and flushes it
  sorted; a batch's flushes become a run, sorted by digest. Each run has Bloom filters, one a shard of the hashes.
* A new run's digests are looked up in the filters of the runs before it, shard by shard. Only what a filter reports is looked up in the
  runs themselves. A digest is a hit if it is in an earlier run or has several rows in its own.
* TIER runs of a level are compacted to one of the next level: counts add up and the best row (longest text, then smallest id) stays.
* Rows that hit are compared byte by byte with the text of the row that stays, SITE_ROWS rows a copy of that text. Texts of one digest
  that differ are told apart by their whole text, so a collision cannot merge two texts.

Edge cases: a null text is the empty text, which is a text like any other; null doc_ids come last among equals; of rows equal in digest,
length and doc_id one is kept; empty tables give empty results. Rows find their text by id and 64-bit hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.bloom import Bloom
from tessella.llm.common import BROADCAST_ROWS, WHITE, Scratch, pick, small_enough

#: Rows that a memtable takes before it is flushed.
MEMTABLE_ROWS = 200_000
#: A table is inserted in BATCHES batches at least, of BATCH_ROWS rows at most.
BATCHES, BATCH_ROWS = 5, 500_000_000
#: Runs of a level that are compacted to one.
TIER = 4
#: Members of a group that are compared with one copy of the text that stays.
SITE_ROWS = 200
#: Stands for a null doc_id inside the index, so that it sorts last and stays an integer.
NO_ID = 2**63 - 1
RUN = "digest string, len long, id long, row long, n long"


def without_white(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def sha256(normal: Column) -> Column:
    return F.sha2(normal.cast("binary"), 256)


def _memtables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows, one a digest, for every MEMTABLE_ROWS rows of a task."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch.assign(n=1))
        if sum(map(len, held)) >= MEMTABLE_ROWS:
            yield _best(pd.concat(held, ignore_index=True))
            held = []
    if held:
        yield _best(pd.concat(held, ignore_index=True))


def _best(rows: pd.DataFrame) -> pd.DataFrame:
    """One row a digest, in order: the longest, then the smallest id, then the smallest row."""
    rows = rows.sort_values(["digest", "len", "id", "row"], ascending=[True, False, True, True])
    total = rows.groupby("digest", sort=True)["n"].sum()
    return rows.drop_duplicates("digest").assign(n=total.to_numpy())[["digest", "len", "id", "row", "n"]]


def merged(rows: DataFrame) -> DataFrame:
    """One row a digest of (digest, len, id, row, n) rows."""
    best = F.min(F.struct((-F.col("len")).alias("len"), "id", "row")).alias("best")
    out = rows.groupBy("digest").agg(best, F.sum("n").alias("n"))
    return out.select("digest", (-F.col("best.len")).alias("len"), "best.id", "best.row", "n")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, hash) rows as (shard, kind 1, hashes)."""
    for batch in batches:
        shard, hashes = batch.column("shard").to_numpy(), batch.column("hash").to_numpy()
        order = np.argsort(shard, kind="stable")
        ids, starts = np.unique(shard[order], return_index=True)
        parts = [p.tobytes() for p in np.split(hashes[order], starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([1] * len(ids), pa.int32()), pa.array(parts if len(ids) else [], pa.binary())], ["shard", "kind", "bytes"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, kind): a shard's filters of earlier runs (0), then the hashes of the new run (1).

    Gives the new run's filter of the shard (0) and the hashes that an earlier filter reports (1).
    """

    def closed(shard: int, filters: list[bytes], hashes: list[bytes]) -> pa.RecordBatch:
        every = np.frombuffer(b"".join(hashes), np.uint64)
        own = Bloom(1 << max(8, (len(every) - 1).bit_length()))
        own.add(every)
        found = np.zeros(len(every), bool)
        for bits in filters:
            found |= Bloom.of(bits).has(every)
        packed = [own.parts[0].tobytes() if own.parts else b"", every[found].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([shard] * 2, pa.int32()), pa.array([0, 1], pa.int32()), pa.array(packed, pa.binary())], ["shard", "kind", "bytes"])

    at, filters, hashes = None, [], []
    for batch in batches:
        for shard, kind, packed in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "bytes")), strict=True):
            if shard != at:
                if hashes:
                    yield closed(at, filters, hashes)
                at, filters, hashes = shard, [], []
            (hashes if kind else filters).append(packed)
    if hashes:
        yield closed(at, filters, hashes)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column("bytes").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(packed, np.int64))], ["hash"])


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (digest, site), the text that stays first: digests with a text that is another one."""
    at, kept = None, None
    for batch in batches:
        out, texts = set(), batch.column("normal")
        for i, (digest, site, keeps) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("digest", "site", "keeps")), strict=True)):
            if (digest, site) != at:
                at, kept = (digest, site), texts[i].as_buffer() if keeps else None
            if kept is not None and not keeps and not texts[i].as_buffer().equals(kept):
                out.add(digest)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], ["digest"])


class MergeIndex:
    """Digest index: levels of runs in the shared folder. A run is a table (RUN), one row a digest, and its filters (shard, kind, bytes)."""

    def __init__(self, scratch: Scratch, name: str = "index", tier: int = TIER):
        self.scratch, self.name, self.tier = scratch, name, tier
        self.shards = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[DataFrame, DataFrame]]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _ in level]

    def _write(self, rows: DataFrame, probed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """A run, its filters, and the hashes that filters of other runs report (none unless probed)."""
        name = f"{self.name}-{self.scratch.serial()}"
        run = self.scratch.table(merged(rows).sortWithinPartitions("digest"), name)
        hash_ = F.xxhash64("digest")
        both = run.select(F.pmod(hash_, F.lit(self.shards)).cast("int").alias("shard"), hash_.alias("hash")).mapInArrow(_pack, "shard int, kind int, bytes binary")
        if probed:
            both = reduce(DataFrame.unionByName, (filters for level in self.levels for _, filters in level), both)
        found = both.repartitionById(self.shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_probe, "shard int, kind int, bytes binary")
        found = self.scratch.table(found, f"{name}-filters")
        return run, found.where("kind = 0"), found.where("kind = 1")

    def insert(self, rows: DataFrame) -> DataFrame:
        """Take in the (digest, len, id, row) rows as a run; returns the digests that hit, each once, read from written runs."""
        run, filters, reported = self._write(rows.mapInPandas(_memtables, RUN), True)
        hits, before = run.where("n > 1").select("digest"), self.runs()
        n = reported.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
        if before and n:  # at most n / 8 digests are looked up
            few = F.broadcast if n // 8 <= BROADCAST_ROWS else lambda df: df
            hashes = reported.mapInArrow(_hashes, "hash long")
            asked = run.where("n = 1").join(few(hashes), F.xxhash64("digest") == F.col("hash"), "left_semi").select("digest")
            every = reduce(DataFrame.unionByName, before)
            hits = hits.unionByName(every.join(few(asked), "digest", "left_semi").select("digest").distinct())
        self.levels[0].append((run, filters))
        self._tidy()
        return hits

    def lookup(self, asked: DataFrame) -> DataFrame:
        """What the runs hold of these distinct digests (a written table), merged."""
        every = reduce(DataFrame.unionByName, self.runs())
        return merged(every.join(small_enough(asked), "digest", "left_semi"))

    def _tidy(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.tier:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                run, filters, _ = self._write(reduce(DataFrame.unionByName, (run for run, _ in level)), False)
                self.levels[k + 1].append((run, filters))
                self.levels[k] = []


def assign_keepers(docs: DataFrame, digest=sha256, batches: int | None = None) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, digest. ``digest`` maps the normalised text to a string column."""
    scratch = Scratch(docs.sparkSession)
    normal = without_white(F.col("text"))
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("tid"), "text")
    keys = rows.select("id", "tid", F.length(text).cast("long").alias("len"), digest(normal).alias("digest"), F.monotonically_increasing_id().alias("row"))
    keys = scratch.table(keys, "keys")  # row stays what it is once it is written
    n = batches or max(BATCHES, -(-keys.count() // BATCH_ROWS))

    index, hits = MergeIndex(scratch), []
    for b in range(n):
        hits.append(index.insert(keys.where(F.pmod(F.xxhash64("row"), F.lit(n)) == b).select("digest", "len", "id", "row")))
    hits = scratch.table(reduce(DataFrame.unionByName, hits).distinct(), "hits")
    groups = index.lookup(hits).select("digest", F.col("len").alias("keep_len"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    groups = scratch.table(groups, "groups")

    placed = keys.join(small_enough(groups), "digest", "left")
    members = placed.where("group_size is not null").select("id", "tid", "digest", (F.col("row") == F.col("keep_row")).alias("keeps"), "group_size")
    parts = F.ceil(F.max("group_size") / SITE_ROWS).cast("int").alias("parts")
    members = scratch.table(members.groupBy("id", "tid", "digest").agg(F.max("keeps").alias("keeps"), parts), "members")
    named = small_enough(members.withColumnsRenamed({"id": "of", "tid": "of_tid"}))
    texts = rows.join(named, (F.col("id") == F.col("of")) & (F.col("tid") == F.col("of_tid"))).select("id", "tid", "digest", "keeps", "parts", normal.alias("normal"))
    sites = F.when(F.col("keeps"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "tid"), F.col("parts")).cast("int")))
    sited = texts.select("digest", F.explode(sites).alias("site"), "keeps", "normal").repartition("digest", "site").sortWithinPartitions("digest", "site", F.desc("keeps"))
    differs = sited.mapInArrow(_differing, "digest string").distinct()
    differs = scratch.table(differs, "differs")

    if differs.isEmpty():
        scratch.drop_all_but("keys", "groups")
    else:  # texts that share a digest: their key is the digest and the whole text
        apart = texts.join(differs, "digest").select("id", "tid", F.concat_ws(":", "digest", "normal").alias("key")).distinct()
        keyed = keys.join(apart, ["id", "tid"])
        again = keyed.select(F.col("key").alias("digest"), "len", "id", "row", F.lit(1).cast("long").alias("n"))
        groups = merged(again).select(F.col("digest").alias("key"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
        same = placed.join(differs, "digest", "left_anti")
        placed = same.unionByName(keyed.join(groups, "key"), allowMissingColumns=True)
    shown = lambda c: F.nullif(c, F.lit(NO_ID))
    alone = F.col("group_size").isNull()
    return placed.select(
        shown(F.col("id")).alias("doc_id"),
        shown(F.when(alone, F.col("id")).otherwise(F.col("keep_id"))).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "digest",
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_keepers(docs).withColumnRenamed("digest", "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place FROM d
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM g
"""
