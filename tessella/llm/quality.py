"""Operator 9: quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model is of characters (the order is ORDER), one for each language, so that it also judges scripts without spaces and words never
seen. It is trained on all trusted text: rows labelled of good quality, but for a fold that stays out for the thresholds.

1. Counts: tasks count the n-grams of what they read; a shuffle adds them up. Counts of lower orders are numbers of distinct left
   neighbours, discounts come from counts of counts, and each order is joined with the weights of its contexts and the probabilities of
   the order below. All of that is grouping and joining of n-gram rows, sharded by n-gram.
2. Each task packs the documents it reads into blocks of about BLOCK_BYTES, a compressed row each, so no text is dealt out by a key. The
   distinct n-grams of each block are joined with the model, so a frequent n-gram is one row a block, and what comes back meets the
   block again, where its documents are scored.
3. Thresholds: of each language, the LOW and HIGH quantiles of the perplexity of trusted documents outside the training fold. Texts of few
   repeated words have a low perplexity, junk a high one. The mean over a short text strays more, so SPREAD / sqrt(characters) is allowed
   for before quantiles are taken and texts compared; MARGIN is added on both sides (in log2) to leave clean documents alone.

An n-gram is a 64-bit number of four 16-bit characters; three line feeds stand in front of each text. Characters beyond U+FFFF take the
2,048 numbers that surrogates leave free, by their low 11 bits, which keeps all emoji (U+1F300 to U+1FAFF) apart.

Edge cases: null and empty texts have no perplexity (null) and are not kept; a null lang is a language of its own; languages without
trusted text have no model: their perplexity and thresholds are null and their documents are kept; a doc_id with several labels is
trusted if all of them are good; rows repeated in full are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, pick, small_enough
from tessella.llm.toxicity import held_out

ORDER = 4
#: Characters whose n-grams a task sorts at once.
CHUNK = 1_000_000
BLOCK_BYTES = 12_000_000
LOW, HIGH = 0.01, 0.99
#: log2 perplexity left beyond the quantiles, and the width of the steps in which quantiles are found.
MARGIN, STEP = 0.1, 0.001
#: Discounts are at least this, so that every context leaves something for what was not seen.
MIN_DISCOUNT = 0.1
#: Bits a character that a single character strays by.
SPREAD = 3.0
#: Stands for a null lang.
NO_LANG = "\0"
_PAD = np.full(ORDER - 1, 10, np.uint64)


def grams(text: str) -> np.ndarray:
    """The n-gram that ends at each character, as signed 64-bit numbers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    beyond = points > 0xFFFF
    points[beyond] = np.uint64(0xD800) + (points[beyond] & np.uint64(0x7FF))
    every = np.concatenate([_PAD, points])
    n = len(points)
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = out << np.uint64(16) | every[k : k + n]
    return out.view(np.int64)


def tally(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of texts and their counts, CHUNK characters at a time."""
    found, held, size = [], [], 0
    for i, text in enumerate(texts):
        held.append(grams(text))
        size += len(text)
        if size >= CHUNK or i == len(texts) - 1:
            found.append(np.unique(np.concatenate(held), return_counts=True))
            held, size = [], 0
    values, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[starts], np.add.reduceat(counts, starts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each batch; n counts the rows marked as training text only."""
    for batch in batches:
        by: dict[tuple[str, bool], list[str]] = {}
        for lang, train, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "train", "text")), strict=True):
            if text:
                by.setdefault((lang, train), []).append(text)
        for (lang, train), found in by.items():
            values, counts = tally(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts * train)], ["lang", "gram", "n"])


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of all texts of (lang, train, text) rows; n is 0 for n-grams outside the training text."""
    return docs.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounted(counts: DataFrame) -> DataFrame:
    """(lang, gram, n) with d, the discount of n: by the counts of counts of the language."""
    n = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    found = counts.groupBy("lang").agg(*n)
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    of = lambda k: F.least(F.lit(float(k)), F.greatest(F.lit(MIN_DISCOUNT), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(k / 2))))
    found = found.select(F.col("lang").alias("of"), of(1).alias("d1"), of(2).alias("d2"), of(3).alias("d3"))
    joined = counts.join(F.broadcast(found), F.col("lang") == F.col("of"))  # one row a language
    return joined.select("lang", "gram", "n", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))


def _suffix(gram: Column, size: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 16 * size) - 1))


class Model:
    """Written tables: probs[k] (lang, gram, p) of the k-grams seen, gammas[k] (lang, gram, gamma) of the contexts of k characters."""

    def __init__(self, counts: DataFrame, scratch: Scratch):
        """counts: (lang, gram, n) of the training text, n > 0."""
        name, self._scratch, self._tables = f"model-{scratch.serial()}", scratch, []
        write = lambda df, of: self._tables.append(f"{name}-{of}") or scratch.table(df, f"{name}-{of}")
        by_order = {ORDER: counts}
        for k in range(ORDER - 1, 0, -1):  # numbers of distinct left neighbours
            by_order[k] = write(by_order[k + 1].groupBy("lang", _suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")), k)
        self.probs: dict[int, DataFrame] = {}
        self.gammas: dict[int, DataFrame] = {}
        for k in range(1, ORDER + 1):
            rows = _discounted(by_order[k]).withColumn("context", F.shiftrightunsigned("gram", 16))
            totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"), F.count("*").alias("kinds"))
            totals = totals.withColumn("gamma", F.col("left") / F.col("total"))
            if k == 1:  # the characters of the language, and one for all others
                lower = lambda df: df.withColumn("lower", F.lit(1.0) / (F.col("kinds") + 1))
                self.unseen = write(totals.select("lang", (F.col("gamma") / (F.col("kinds") + 1)).alias("p")), "unseen")
            else:
                below = self.probs[k - 1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
                lower = lambda df, k=k, below=below: df.withColumn("suffix", _suffix(F.col("gram"), k - 1)).join(below, ["lang", "suffix"])
                self.gammas[k - 1] = write(totals.select("lang", F.col("context").alias("gram"), "gamma"), f"gamma-{k - 1}")
            joined = lower(rows.join(totals, ["lang", "context"]))
            p = (F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("lower")
            self.probs[k] = write(joined.select("lang", "gram", p.alias("p")), f"p-{k}")

    def drop(self) -> None:
        """Delete the tables."""
        while self._tables:
            self._scratch.drop(self._tables.pop())

    def logs(self, found: DataFrame) -> DataFrame:
        """(lang, gram, log2p) of distinct (lang, gram): the longest suffix seen, times the weights of the contexts that back off to it."""
        out = found
        factors, given = F.lit(1.0), F.lit(None).cast("double")
        for k in range(ORDER, 0, -1):
            p = self.probs[k].select("lang", F.col("gram").alias(f"g{k}"), F.col("p").alias(f"p{k}"))
            out = out.withColumn(f"g{k}", F.col("gram") if k == ORDER else _suffix(F.col("gram"), k)).join(p, ["lang", f"g{k}"], "left")
            given = F.coalesce(given, factors * F.col(f"p{k}"))
            if k > 1:
                gamma = self.gammas[k - 1].select("lang", F.col("gram").alias(f"c{k}"), F.col("gamma").alias(f"gamma{k}"))
                out = out.withColumn(f"c{k}", F.shiftrightunsigned(f"g{k}", 16)).join(gamma, ["lang", f"c{k}"], "left")
                factors = factors * F.coalesce(f"gamma{k}", F.lit(1.0))
        rest = self.unseen.select("lang", F.col("p").alias("p0"))
        out = out.join(F.broadcast(rest), "lang")  # one row a language; languages without a model end here
        return out.select("lang", "gram", F.log2(F.coalesce(given, factors * F.col("p0"))).alias("log2p"))


def _packer(block_bytes: int):
    """Blocks of the (doc_id, lang, text) rows of a task: number and compressed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        held, size = [], 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

        for batch in batches:
            at = 0
            for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()):
                if size and size + n > block_bytes:
                    held.append(batch.slice(at, i - at))
                    yield block()
                    held, size, at = [], 0, i
                size += n + 16
            held.append(batch.slice(at))
        if size:
            yield block()

    return run


def _unpacked(docs: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(docs.as_buffer()).read_all()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lang, gram) of each block, each once."""
    for batch in batches:
        for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs"), strict=True):
            by: dict[str, list[str]] = {}
            rows = _unpacked(docs)
            for lang, text in zip(rows["lang"].to_pylist(), rows["text"].to_pylist(), strict=True):
                if text:
                    by.setdefault(lang, []).append(text)
            for lang, found in by.items():
                values, _ = tally(found)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(values), pa.int64()), pa.array([lang] * len(values), pa.string()), pa.array(values)], ["block", "lang", "gram"])


def _score(block: pa.Table, logs: pa.Table) -> pa.Table:
    """Mean log2 probability of each document of a block."""
    docs = _unpacked(block["docs"][0])
    models: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    of = logs["lang"].combine_chunks().dictionary_encode()
    number = of.indices.to_numpy()
    gram, value = logs["gram"].to_numpy(), logs["log2p"].to_numpy().astype(np.float64)
    for i, lang in enumerate(of.dictionary.to_pylist()):
        here = np.flatnonzero(number == i)
        here = here[np.argsort(gram[here])]
        models[lang] = gram[here], value[here]
    means, sizes = [], []
    for lang, text in zip(docs["lang"].to_pylist(), docs["text"].to_pylist(), strict=True):
        sizes.append(len(text or ""))
        if text and lang in models:
            keys, values = models[lang]
            means.append(float(values[np.searchsorted(keys, grams(text))].mean()))
        else:
            means.append(None)
    return pa.table([docs["doc_id"], docs["lang"], pa.array(sizes, pa.int64()), pa.array(means, pa.float64())], ["doc_id", "lang", "chars", "log2p"])


def perplexity(docs: DataFrame, logs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of (doc_id, lang, text): doc_id, lang, chars, log2p (mean a character; null without text or model).

    logs: what Model.logs gives for the n-grams of docs. The blocks are written, so that a block keeps its documents if a task is
    repeated, and in buckets, so that only the n-grams are shuffled to meet them.
    """
    packed = docs.select("doc_id", "lang", "text").mapInArrow(_packer(block_bytes), "block long, docs binary")
    packed = scratch.bucketed(packed, "blocks", "block", **{"parquet.block.size": 16_000_000})
    known = logs.withColumn("log2p", F.col("log2p").cast("float"))
    here = packed.mapInArrow(_distinct, "block long, lang string, gram long").join(known, ["lang", "gram"])
    return packed.groupBy("block").cogroup(here.groupBy("block")).applyInArrow(_score, "doc_id long, lang string, chars long, log2p double")


def quantile(rows: DataFrame, by: str, value: Column, q: float) -> DataFrame:
    """(by, value): the smallest step of STEP that at least the share q of the rows reaches down to. Exact on steps, whatever the sizes."""
    counted = rows.select(by, F.ceil(value / STEP).alias("at")).groupBy(by, "at").agg(F.count("*").alias("n"))
    running = F.sum("n").over(W.partitionBy(by).orderBy("at"))
    share = running / F.sum("n").over(W.partitionBy(by))  # windows over the steps of a language, whose number does not grow with the rows
    return counted.withColumn("share", share).where(F.col("share") >= q).groupBy(by).agg((F.min("at") * F.lit(STEP)).alias("value"))


def judge(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, margin: float = MARGIN) -> DataFrame:
    """Per document: doc_id, lang, log2_perplexity (bits a character), least and most of its language (for long texts), kept."""
    scratch = Scratch(docs.sparkSession)
    good = pick(labels, "doc_id", "quality").where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    good = scratch.table(good.select(F.col("doc_id").cast("long").alias("of"), held_out(F.col("doc_id")).alias("out")), "trusted")
    rows = pick(docs, "doc_id", "lang", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "lang": F.coalesce("lang", F.lit(NO_LANG))})
    marked = rows.join(small_enough(good.where("not out")), F.col("doc_id") == F.col("of"), "left")
    counts = scratch.table(count_grams(marked.select("lang", F.col("of").isNotNull().alias("train"), "text")), "counts")
    model = Model(counts.where("n > 0"), scratch)
    logs = scratch.table(model.logs(counts.select("lang", "gram")), "logs")
    model.drop()
    scratch.drop("counts")
    scored = scratch.table(perplexity(rows, logs, scratch).withColumn("bits", -F.col("log2p")), "scores")
    scratch.drop("logs")
    scratch.drop_bucketed("blocks")

    outside = scored.join(small_enough(good.where("out")), F.col("doc_id") == F.col("of"), "left_semi").where("bits is not null")
    stray = F.lit(SPREAD) / F.sqrt(F.greatest("chars", F.lit(1)))
    least, most = (quantile(outside, "lang", F.col("bits") + sign * stray, q) for sign, q in ((1, low), (-1, high)))
    limits = least.select("lang", (F.col("value") - margin).alias("least")).join(most.select("lang", (F.col("value") + margin).alias("most")), "lang")
    limits = scratch.table(limits, "limits")
    scratch.drop_all_but("scores", "limits")
    joined = scored.join(F.broadcast(limits), "lang", "left")  # one row a language
    kept = (F.col("chars") > 0) & F.coalesce(F.col("bits").between(F.col("least") - stray, F.col("most") + stray), F.lit(True))
    return joined.select("doc_id", F.nullif("lang", F.lit(NO_LANG)).alias("lang"), F.round("bits", 9).alias("log2_perplexity"), "least", "most", kept.alias("kept"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
