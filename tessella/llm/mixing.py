"""Operator 1: mix sources to target weights.

Tokens (words) are summed per source, the targets are filled up to a repetition limit, and each document is emitted
floor(rate) times plus one copy that a hash of its identity draws with probability rate - floor(rate).

Edge cases: a null text has size 0; a null source is a source of its own, ordered last; a source without words has rate 0
and its documents are not emitted; rows repeated in full draw the same number; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, pick, small_enough, word_count

CYCLE = (5, 2, 1)
MAX_REPEAT = 3
SEED = 17


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, max_repeat: int = MAX_REPEAT, share: float = 1.0) -> DataFrame:
    """Targets of (source, source_size) rows, one row a source.

    Weights repeat in the code point order of the sources. A target stops at max_repeat times its source; what is cut off goes
    to the others by weight until none is above. That fixed point is found in one sorted pass: in order of limit / weight the
    sources that stop form a prefix, and prefix sums tell its end. The windows see one row a source, never documents.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (F.col("rank") % len(cycle) + 1).cast("int"))
    limit = F.col("source_size").cast("double") * float(max_repeat)
    ranked = (
        sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumns({"weight": weight, "limit": limit})
        .withColumn("at", F.row_number().over(W.orderBy(F.col("limit") / F.col("weight"), "rank")))
    )
    before = W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    zero = F.lit(0.0)
    filled = ranked.withColumns(
        {
            "left": F.sum(F.col("source_size").cast("double")).over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), zero),
            "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero),
        }
    ).withColumn("stops", F.col("limit") * F.col("weights") <= F.col("weight") * F.col("left"))
    filled = filled.withColumn("first", F.min(F.when(~F.col("stops"), F.col("at"))).over(every))
    filled = filled.withColumn("level", F.max(F.when(F.col("at") == F.col("first"), F.col("left") / F.col("weights"))).over(every))
    free = F.col("first").isNotNull() & (F.col("at") >= F.col("first"))
    return filled.select("source", "source_size", F.when(free, F.col("weight") * F.col("level")).otherwise(F.col("limit")).alias("target"))


def copies(doc_id: Column, size: Column, source_size: Column, target: Column, seed: int = SEED) -> Column:
    """floor(rate) plus the hash-seeded draw; the draw is the first 52 bits of an MD5, so that any engine can repeat it."""
    rate = F.when(source_size > 0, target / source_size.cast("double")).otherwise(F.lit(0.0))
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    drawn = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    whole = F.floor(rate)
    return (whole + F.when(drawn < rate - whole, F.lit(1)).otherwise(F.lit(0))).cast("long")


def _planned(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """docs with __size, and the targets as a written table, broadcast when its count allows."""
    scratch = Scratch(docs.sparkSession)
    sized = pick(docs, "source", "text").select("source", word_count(F.col("text")).alias("size"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = scratch.table(source_targets(totals, **options), "targets")
    return docs.withColumn("__size", word_count(F.col("text"))), small_enough(targets, 50_000)


def mix_plan(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken (words taken, repeats counted)."""
    sized, targets = _planned(pick(docs, "doc_id", "source", "text"), **options)
    sized = sized.select("doc_id", "source", F.col("__size").alias("size"))
    joined = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    n = copies(F.col("doc_id"), F.col("size"), F.col("source_size"), F.col("target"), seed)
    return joined.select("doc_id", "source", "size", "source_size", "target", n.alias("copies"), (F.col("size") * n).alias("taken"))


def mix(docs: DataFrame, columns: tuple[str, ...], seed: int = SEED, **options) -> DataFrame:
    """The mixed corpus: the given columns of each document, once for each copy."""
    sized, targets = _planned(pick(docs, *dict.fromkeys((*columns, "doc_id", "source", "text"))), **options)
    targets = targets.toDF("__of", "__total", "__target")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("__of")))
    n = copies(F.col("doc_id"), F.col("__size"), F.col("__total"), F.col("__target"), seed)
    return joined.withColumn("__n", n).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size::DOUBLE * 3.0::DOUBLE AS lim FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY lim / weight, rank) AS pos FROM w),
f AS (SELECT *, sum(source_size::DOUBLE) OVER () - coalesce(sum(lim) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights FROM o),
g AS (SELECT *, min(CASE WHEN NOT (lim * weights <= weight * rest) THEN pos END) OVER () AS first FROM f),
h AS (SELECT *, max(CASE WHEN pos = first THEN rest / weights END) OVER () AS lvl FROM g),
t AS (SELECT source, source_size, CASE WHEN first IS NOT NULL AND pos >= first THEN weight * lvl ELSE lim END AS target FROM h),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
  CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || CAST(d.size AS VARCHAR)), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""
