"""Operator 5: drop lines that repeat across documents.

1. Tasks hash the distinct line keys of each document and send the hashes, packed by shard, to their shard. There a Bloom filter of
   the hashes seen once picks out the suspects. It never forgets, so no repeated key is missed. Reports of the same suspect are cut down
   by an exact table: a filter in its place would lose suspects by its false positives.
2. The suspects fill a second Bloom filter, of what was seen twice, that every task gets. Its size follows their number up to FILTER_BITS.
   Only lines that it holds are shuffled, with their whole key: exact document counts, and the first occurrence. A false positive of
   either filter is a line counted for nothing. Suspects that would fill it up are dealt by ranges of their hashes to several filters of
   that size, each with a pass of its own over the texts, so that a filter never holds more than its bits allow.
3. Confirmed keys are dropped from the texts. They are broadcast only if their size shows that they are few; else lines join them by shuffle.

Edge cases: a null text is one empty line and comes back as an empty text; a document whose lines all go keeps an empty text;
keys under min_chars code points (empty lines too) are never dropped; a key counts once a document, rows repeated in full count
each; null doc_ids come last when the first occurrence is chosen; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.bloom import TwiceSeen, probes
from tessella.llm.common import Scratch, gives_back, lower_ascii, pick, slices

MIN_DOCS = 10
MIN_CHARS = 1
#: Size of the filter of suspects at most, a power of two, and its bits a suspect as long as it is smaller.
FILTER_BITS, BITS_EACH = 1 << 28, 16
#: With fewer bits a suspect the suspects are dealt to several filters.
BITS_LEAST = 8
#: Beyond so many bytes of confirmed keys, lines join them by shuffle.
FEW_KEY_BYTES = 16_000_000
_STRIP = b" \t\n\x0b\x0c\r"
NO_ID = 2**63 - 1


def line_keys(text: str | None, min_chars: int) -> list[bytes]:
    """The key of each line; b'' for lines too short to count."""
    keys = [line.strip(_STRIP).lower() for line in (text or "").encode().split(b"\n")]  # bytes.lower() maps A-Z only
    return keys if min_chars <= 1 else [k if len(k) >= min_chars and len(k.decode()) >= min_chars else b"" for k in keys]


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _packed(shards: int, min_chars: int):
    """(shard, hashes): the hashes of a batch. Two of a hash say all about it, so that the commonest lines are no load for their shard."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for text in batch.column("text") if len(h := _hashes({k for k in line_keys(text.as_py(), min_chars) if k}))]
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                every = np.repeat(values, np.minimum(counts, 2))
                shard = (every % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                ids, starts = np.unique(shard[order], return_index=True)
                parts = np.split(every[order], starts[1:])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([p.tobytes() for p in parts], pa.binary())], ["shard", "hashes"])

    return run


@gives_back
def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, TwiceSeen] = {}
    for batch in batches:
        for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            new = seen.setdefault(shard, TwiceSeen()).repeats(np.frombuffer(packed, np.uint64))
            if len(new):
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64))], ["hash"])


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range that a hash is in, of equal ranges of its upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _filter_words(bits: int):
    """(word, mask) of the bits that suspects set in a filter of so many bits."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(list(probes(batch.column("hash").to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "mask"])

    return run


def suspect_filter(suspects: DataFrame, most_bits: int = FILTER_BITS) -> np.ndarray:
    """The Bloom filter of the distinct hashes in a written table, as 64-bit words. Its words are put together by Spark."""
    bits = min(most_bits, 1 << max(10, (BITS_EACH * suspects.count() - 1).bit_length()))
    words = suspects.mapInArrow(_filter_words(bits), "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def _held(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in probes(hashes, 64 * len(words)):
        found &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return found


def _occurrences(suspects, min_chars: int, part: int = 0, parts: int = 1):
    """(key, doc, at): each distinct key of a document whose hash is in this part of all hashes and in the broadcast filter of its suspects,
    and the key's first line."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = suspects.value
        for batch in slices(batches):
            every: list[tuple] = []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                first = {k: i for i, k in reversed(list(enumerate(line_keys(text.as_py(), min_chars)))) if k}
                every += [(k, doc, i) for k, i in first.items()]
            hashes = _hashes([x[0] for x in every])
            out = [every[i] for i in np.flatnonzero(_held(wanted, hashes) & (_part_of(hashes, parts) == part)).tolist()]
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "at"])

    return run


def _dropper(bad, min_chars: int, keep_first: bool, names: list[str], id_name: str):
    """Texts without the lines of the broadcast dict ``bad`` (key -> (doc, line) of the first occurrence)."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = bad.value
        for batch in slices(batches):
            ids, texts, lines, dropped = batch.column(id_name).to_pylist(), [], [], []
            for doc, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                keys, doc = line_keys(text, min_chars), NO_ID if doc is None else doc
                gone = {i for i, k in enumerate(keys) if k in drop and not (keep_first and drop[k] == (doc, i))}
                lines.append(len(keys))
                dropped.append(len(gone))
                texts.append("\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone) if gone else text or "")
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text"), min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False,
                filter_bits: int = FILTER_BITS, few_key_bytes: int = FEW_KEY_BYTES) -> DataFrame:
    """The given columns of docs with repeated lines dropped from text, and n_lines, n_dropped.

    A key in min_docs documents or more loses its lines everywhere; with keep_first its first line (smallest doc_id, then the
    first line in it) stays.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = pick(docs, *columns)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = source.select("text").mapInArrow(_packed(shards, min_chars), "shard int, hashes binary")
    suspects = scratch.table(packed.repartitionById(shards, "shard").mapInArrow(_suspects, "hash long"), "suspects").distinct()
    suspects = scratch.table(suspects, "distinct-suspects")

    parts = max(1, -(-suspects.count() * BITS_LEAST // filter_bits))
    upper = F.shiftrightunsigned("hash", 32)
    rows = None
    for part in range(parts):
        inside = suspects if parts == 1 else suspects.where(F.shiftrightunsigned(upper * parts, 32) == part)
        held = spark.sparkContext.broadcast(suspect_filter(inside, filter_bits))
        found = source.mapInArrow(_occurrences(held, min_chars, part, parts), "key binary, doc long, at int")
        rows = found if rows is None else rows.unionByName(found)
    counted = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first"))
    confirmed = scratch.table(counted.where(F.col("n") >= min_docs).select("key", "first.doc", "first.at"), "confirmed")
    scratch.drop_all_but("confirmed")
    size = confirmed.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    if size <= few_key_bytes:
        bad = spark.sparkContext.broadcast({bytes(r.key): (r.doc, r.at) for r in confirmed.collect()})
        schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        return docs.mapInArrow(_dropper(bad, min_chars, keep_first, list(columns), "doc_id"), schema)
    return _drop_by_join(docs, confirmed, columns, min_chars, keep_first)


def _drop_by_join(docs: DataFrame, confirmed: DataFrame, columns: tuple[str, ...], min_chars: int, keep_first: bool) -> DataFrame:
    """The same as the broadcast way, for any number of confirmed keys: lines find their key by a join, texts their line numbers."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    keyed = docs.withColumns({"__lines": lines, "__id": id_, "__text": F.md5(F.coalesce("text", F.lit("")).cast("binary"))})
    white = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"  # $ would match before a final U+0085, U+2028 or U+2029 too
    rows = keyed.select("__id", "__text", F.posexplode("__lines").alias("at", "line")).withColumn("text_key", lower_ascii(F.regexp_replace("line", white, "")))
    rows = rows.where(F.length("text_key") >= max(1, min_chars)).select("__id", "__text", "at", F.col("text_key").cast("binary").alias("key"))
    found = rows.join(confirmed.select("key", F.col("doc").alias("first_doc"), F.col("at").alias("first_at")), "key")
    if keep_first:
        found = found.where((F.col("__id") != F.col("first_doc")) | (F.col("at") != F.col("first_at")))
    drops = found.groupBy("__id", "__text").agg(F.collect_set("at").alias("__drop"))
    joined = keyed.join(drops, ["__id", "__text"], "left").withColumn("__drop", F.coalesce("__drop", F.array().cast("array<int>")))
    kept = F.filter("__lines", lambda _, i: ~F.array_contains(F.col("__drop"), i))
    text = F.array_join(kept, "\n")
    return joined.select(*(text.alias("text") if c == "text" else F.col(c) for c in columns), F.size("__lines").cast("long").alias("n_lines"), F.size("__drop").cast("long").alias("n_dropped"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM (SELECT DISTINCT doc_id, key FROM k WHERE length(key) >= {MIN_CHARS}) GROUP BY key HAVING count(*) >= {MIN_DOCS})
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(bad.key) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN bad.key IS NULL THEN k.line END, chr(10) ORDER BY k.i), '')) AS kept_sha256
FROM k LEFT JOIN bad ON k.key = bad.key GROUP BY k.doc_id
"""
