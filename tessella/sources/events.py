"""Reading and writing event tables, and the naming of their files.

Event tables are Parquet, partitioned where a registry of selections, processes and variations is wanted, so that the lookup of one is
partition pruning. Row order matters for text columns that stand beside a table only; index_rows numbers rows for those.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.schema import CODE, FEATURES, PRIMARY, UNKNOWN
from tessella.sources.scratch import cut

SHIFTS = ("tes", "jes", "met")
DEFAULTS = (1.0, 1.0, 0.0)
# Parts of a file name that mark a toy as no plain nominal one.
VETOED = ("nominal", "ttbar", "htautau", "diboson", "ztautau")


# -- scans ---------------------------------------------------------------------------------------------------------------
def read_events(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    missing = [c for c in columns or () if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*columns) if columns else df


def index_rows(df: DataFrame, order: list[Column], name: str = "row_idx") -> DataFrame:
    """df with row numbers from 0 in a given order, without sorting all rows in one task: ranges are sorted on their own and each
    adds the sizes of those before it. Ranges and sizes come from one written table."""
    part, at = F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part, at))
    sizes = {r["__part"]: (r.n, r.first) for r in ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).collect()}  # one row a partition
    rows, before = [], 0
    for k in sorted(sizes):
        rows.append((k, before - sizes[k][1]))
        before += sizes[k][0]
    offsets = df.sparkSession.createDataFrame(rows, "__part int, __offset long")
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__offset")).drop("__part", "__at", "__offset")


#: Files whose offsets are broadcast; more are joined by shuffle.
BROADCAST_FILES = 400_000


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, first): the rows of each Parquet file and of those before it, by name. Counts come from the files' footers."""
    counts = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))  # one row a file
    return counts.withColumn("first", F.coalesce(before, F.lit(0)))


def numbered_rows(spark: SparkSession, path: str, name: str = "row_idx") -> DataFrame:
    """The rows of a Parquet table numbered from 0, by the names of its files and their places in them: no sort and no shuffle of rows."""
    offsets = cut(file_offsets(spark, path).select(F.col("file").alias("__of"), "first"))
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_FILES else offsets
    rows = spark.read.parquet(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return placed.join(offsets, F.col("__file") == F.col("__of")).withColumn(name, F.col("first") + F.col("__row")).select(*rows.columns, name)


def pick_numbered(spark: SparkSession, path: str, indices: Iterable[int], name: str = "row_idx") -> DataFrame:
    """The rows with these numbers; only the files that hold one are read. Numbers beyond the table find nothing."""
    wanted = spark.createDataFrame([(int(i),) for i in set(indices)], "wanted long")
    inside = (F.col("wanted") >= F.col("first")) & (F.col("wanted") < F.col("first") + F.col("n"))
    found = file_offsets(spark, path).join(F.broadcast(wanted), inside).select("file", "first", (F.col("wanted") - F.col("first")).alias("row")).collect()  # as many as asked for
    if not found:
        return spark.read.parquet(path).where("false").withColumn(name, F.lit(0).cast("long"))
    rows = spark.read.parquet(*sorted({r.file for r in found}))
    places = spark.createDataFrame([(r.file, r.row, r.first + r.row) for r in found], f"__of string, __at long, {name} long")
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return placed.join(F.broadcast(places), (F.col("__file") == F.col("__of")) & (F.col("__row") == F.col("__at"))).select(*rows.columns, name)


def read_lines(spark: SparkSession, path: str, name: str, kind: str = "double") -> DataFrame:
    """(row_idx, name): one value a line; strings are stripped. The order is that of the files' names and of the lines within each."""
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line")]
    lines = spark.read.text(path, wholetext=False).select(F.trim("value").alias("v"), *place)
    indexed = index_rows(lines, [F.col("__file"), F.col("__block"), F.col("__line")])
    return indexed.select("row_idx", F.col("v").cast(kind).alias(name))


def zip_columns(table: DataFrame, *others: DataFrame) -> DataFrame:
    """Tables joined by row_idx; rows that one of them lacks go."""
    for other in others:
        table = table.join(other, "row_idx")
    return table


def read_train(spark: SparkSession, folder: str) -> DataFrame:
    """Primary events with label (1 signal), weight and detailed_label from the files that stand beside each other in a folder.

    Events are numbered by the name of their file and their row in it, however the scan splits and packs the files.
    """
    data = numbered_rows(spark, f"{folder}/data/data.parquet")
    at = data.select(*(F.col(c).alias(p) for c, p in zip(data.columns[:-1], PRIMARY, strict=True)), "row_idx")
    sides = (("labels", "is_signal", "double"), ("weights", "weight", "double"), ("detailed_labels", "detailed_label", "string"))
    return zip_columns(at, *(read_lines(spark, f"{folder}/{n}/data.{n}", c, k) for n, c, k in sides))


def read_test(spark: SparkSession, folder: str, processes: Iterable[str] = ("ztautau", "diboson", "ttbar", "htautau")) -> DataFrame:
    """The events of one Parquet file a process, with label and process."""
    parts = [
        spark.read.parquet(f"{folder}/data/{p}_data.parquet").select(*PRIMARY, F.col("weights").cast("double").alias("weight"), F.lit(CODE[p]).alias("label"), F.lit(p).alias("process"))
        for p in processes
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def pick_rows(df: DataFrame, rows: Iterable[int]) -> DataFrame:
    """The rows with these row_idx."""
    wanted = df.sparkSession.createDataFrame([(int(r),) for r in dict.fromkeys(rows)], "row_idx long")
    return df.join(wanted, "row_idx", "left_semi")


def batches(df: DataFrame, size: int | None = None, n_split: int | None = None) -> DataFrame:
    """df with batch, the number of the slice of row_idx that a row is in. size wins over n_split."""
    if size is None and n_split is None:
        raise ValueError("give size or n_split")
    if size is None:
        size = max(1, -(-df.count() // n_split))
    return df.withColumn("batch", F.floor(F.col("row_idx") / size).cast("long"))


def toy_events(df: DataFrame) -> DataFrame:
    """Features and weight of unknown events in the order of the event table; missing columns raise."""
    return df.select(*(F.col(f) for f in FEATURES), F.col("weight").cast("double").alias("weight")).withColumn("label", F.lit(UNKNOWN))


def features_of(df: DataFrame) -> DataFrame:
    return df.select(*FEATURES)


# -- names ---------------------------------------------------------------------------------------------------------------
# A name is a process (or none) and pairs of a shift and its value, or the word nominal; underscores stand between all of them, and p
# stands for the decimal point.
def file_name(process: str | None = None, values: tuple[float, float, float] | None = None, suffix: str = ".h5") -> str:
    """The name of a sample; shifts at their default are left out."""
    tokens = [process] if process else []
    for shift, default, value in zip(SHIFTS, DEFAULTS, values or DEFAULTS, strict=True):
        if value != default:
            tokens += [shift, str(value).replace(".", "p")]
    if len(tokens) == bool(process):
        tokens.append("nominal")
    return "_".join(tokens) + suffix


def parse_file_name(name: Column, suffix: str = ".h5") -> dict[str, Column]:
    """process (null if there is none), tes, jes and met, token by token."""
    stem = F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix))).otherwise(name)
    tokens = F.split(stem, "_")
    first = F.element_at(tokens, 1)
    is_process = ~first.isin("", "nominal", *SHIFTS)

    def value(shift: str, default: float) -> Column:
        after = F.try_element_at(tokens, (F.array_position(tokens, F.lit(shift)) + 1).cast("int"))
        number = F.when(F.array_contains(tokens, shift) & after.rlike("^[0-9]+(p[0-9]+)?$"), F.translate(after, "p", "."))
        return F.coalesce(number.cast("double"), F.lit(default))

    return {"process": F.when(is_process, first), **{s: value(s, d) for s, d in zip(SHIFTS, DEFAULTS, strict=True)}}


def mu_name(mu: Column) -> Column:
    """1.25 as 1p250."""
    return F.replace(F.format_string("%.3f", mu), F.lit("."), F.lit("p"))


def plain_toys(files: DataFrame, name: str = "file") -> DataFrame:
    """Files whose names hold no vetoed part."""
    condition = F.lit(True)
    for part in VETOED:
        condition = condition & ~F.col(name).contains(part)
    return files.where(condition)


def missing_jobs(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found, key, "left_anti")


# -- registry and sinks --------------------------------------------------------------------------------------------------
def write_events(df: DataFrame, path: str, by: Iterable[str] = ("selection", "process", *SHIFTS), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def lookup(spark: SparkSession, path: str, selection: str, process: str, values: tuple[float, float, float] = DEFAULTS) -> DataFrame:
    """The events of one registered sample. A KeyError names what there is."""
    every = spark.read.parquet(path)
    wanted = (F.col("selection") == selection) & (F.col("process") == process)
    for s, v in zip(SHIFTS, values, strict=True):
        wanted = wanted & (F.col(s).cast("double") == float(v))
    found = every.where(wanted)
    if found.isEmpty():
        keys = sorted({tuple(map(str, r)) for r in every.select("selection", "process", *SHIFTS).distinct().collect()})  # one row a sample
        raise KeyError(f"no {(selection, process, *values)} in {keys}")
    return found.drop("selection", "process", *SHIFTS)


def list_samples(events: DataFrame) -> DataFrame:
    return events.groupBy("selection", "process").agg(F.count("*").alias("n"))


def copy_with_selection(events: DataFrame, condition: Column, path: str, process: str | None = None, overwrite: bool = False, limit: int | None = None) -> None:
    """The rows that fit, written to path; an existing path is left alone unless overwrite."""
    out = events.where(condition)
    if process is not None:
        out = out.where(F.col("label") == CODE[process])
    if limit is not None:  # any rows, numbered range by range
        ranked = index_rows(out.withColumn("__r", F.xxhash64(*out.columns)), [F.col("__r")], "__rank")
        out = ranked.where(F.col("__rank") < limit).drop("__r", "__rank")
    out.write.mode("overwrite" if overwrite else "ignore").parquet(path)


NTUPLE = T.StructType(
    [T.StructField("selection", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("weight", T.DoubleType())]
    + [T.StructField(f"p_{p}", T.DoubleType()) for p in CODE]
    + [T.StructField(f"d_{p}", T.ArrayType(T.DoubleType())) for p in CODE]
)


def write_ntuple(scored: DataFrame, path: str, provenance: dict[str, str], mode: str = "append") -> None:
    """Scored events by selection, with where their scores come from in column provenance."""
    tagged = scored.withColumn("provenance", F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in sorted(provenance.items())))))
    tagged.select(*NTUPLE.fieldNames(), "provenance").write.mode(mode).partitionBy("selection").parquet(path)


def read_ntuple(spark: SparkSession, path: str, provenance: dict[str, str] | None = None) -> DataFrame:
    """The same; with provenance given, rows of any other origin raise."""
    df = spark.read.parquet(path)
    if provenance is not None:
        import json

        found = {r.provenance for r in df.select("provenance").distinct().collect()}  # a few
        if found - {json.dumps(dict(sorted(provenance.items())), separators=(",", ":"))}:
            raise ValueError(f"scores come from {sorted(found)}")
    return df.drop("provenance")


def write_result(result: dict, path: str, spark: SparkSession) -> None:
    """One JSON line, replacing what was there."""
    spark.createDataFrame([{k: float(v) for k, v in result.items()}]).coalesce(1).write.mode("overwrite").json(path)


def inspect(df: DataFrame) -> DataFrame:
    """(column, type, rows) of a table."""
    rows = df.count()
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), rows) for f in df.schema.fields], "column string, type string, rows long")
