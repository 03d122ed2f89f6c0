"""Operator 8: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a logistic score over its words and the beginnings of its words (so that inflected
forms count as their stem does), a document the noisy-or of its sentences: 1 - prod(1 - p). Labels exist for documents only; maximising their likelihood makes the sentences that explain a label score high,
so the same weights also locate the offending sentences.

Training takes at most SAMPLE_DOCS labelled rows (by a hash of their id; documented bound). Word counts by label choose the words,
and the weights come from gradient steps on the sentence bags of those words. Scoring reads every sentence of every text.

Edge cases: a null text, or one without words, is one sentence without words and gets the score of that; rows without a label, or
with a null one, are not trained on; if a doc_id has several labels any 1 counts; without both labels in the sample every score is
the share of 1 (0 without rows); equal texts get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, gives_back, pick, slices

SAMPLE_DOCS = 20_000
#: Words kept: at least so many labelled documents have them, and their G-test against the label reaches MIN_G (p about 1e-5).
MIN_DOCS, MIN_G, MAX_WORDS = 3, 20.0, 4096
STEPS, RATE, DECAY = 400, 0.1, 1e-4
FOLDS = 5
#: Beginnings of so many letters are features beside the whole words.
BEGINNINGS = range(3, 8)
#: Words whose features are remembered in a Python worker before the table is emptied.
WORDS_KEPT = 150_000

_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def sentences(text: str | None) -> list[str]:
    """The sentences with a word in them; one empty sentence where there is none."""
    return [s for s in _SENTENCE.split(text or "") if _WORD.search(s)] or [""]


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if k < len(word))]


def words(sentence: str) -> set[str]:
    return {f for w in _WORD.findall(sentence.lower()) for f in features(w)}


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS, is 0. A null id is in no fold and never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, column: str = "toxic", size: int = SAMPLE_DOCS) -> DataFrame:
    """(text, label) of at most ``size`` labelled rows outside the held-out fold."""
    marked = pick(labels, "doc_id", column).where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = marked.groupBy("doc_id").agg(F.max(column).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")  # at most ``size`` rows


def choose_words(sample: DataFrame) -> list[str]:
    """The words whose document counts differ between the labels, strongest first."""

    @gives_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                for w in words(text or ""):
                    counts.setdefault(w, [0, 0])[int(label > 0)] += 1
            columns = [pa.array(counts, pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "clean", "toxic"])

    totals = sample.groupBy().agg(F.sum(F.when(F.col("label") > 0, 0).otherwise(1)), F.sum(F.when(F.col("label") > 0, 1).otherwise(0))).first()
    n0, n1 = (float(x or 0) for x in totals)
    counted = sample.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    a, b, n = F.col("a"), F.col("b"), n0 + n1
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    have, lack = a + b, n - a - b
    gain = part(a, have * n0 / n) + part(b, have * n1 / n) + part(n0 - a, lack * n0 / n) + part(n1 - b, lack * n1 / n)
    strong = counted.where(have >= MIN_DOCS).withColumn("g", 2 * gain).where(F.col("g") >= MIN_G)
    return [r.word for r in strong.orderBy(F.desc("g"), "word").limit(MAX_WORDS).select("word").collect()]


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", size: int = SAMPLE_DOCS) -> Model:
    scratch = Scratch(docs.sparkSession)
    sample = scratch.table(sample_of(docs, labels, column, size), "sample")
    total = sample.agg(F.count("*"), F.avg("label")).first()
    if not total[0] or total[1] in (0.0, 1.0):
        share = min(max(total[1] or 0.0, 0.0), 1.0)
        return Model({}, 40.0 if share == 1.0 else -40.0)
    chosen = choose_words(sample)
    index = {w: i for i, w in enumerate(chosen)}

    @gives_back
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, plain = [], []
            for text in batch.column("text").to_pylist():
                ids = [sorted(index[w] for w in words(s) if w in index) for s in sentences(text)]
                found.append([x for x in ids if x])
                plain.append(sum(not x for x in ids))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(plain, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["label", "plain", "bags"])

    rows = sample.mapInArrow(bags, "label double, plain long, bags array<array<int>>").toArrow()  # at most ``size`` rows of word numbers
    scratch.drop_all_but()
    return _train(rows, chosen)


def _train(rows: pa.Table, chosen: list[str]) -> Model:
    """Adam on the noisy-or likelihood; one flat array of sentences and one of their words."""
    label, plain = rows["label"].to_numpy(), rows["plain"].to_numpy().astype(float)
    lists = rows["bags"].to_pylist()
    doc_of = np.array([d for d, bag in enumerate(lists) for _ in bag], np.int64)
    sentence_of = np.array([s for s, ids in enumerate(x for bag in lists for x in bag) for _ in ids], np.int64)
    word_of = np.array([w for bag in lists for ids in bag for w in ids], np.int64)
    n_docs, n_sentences, n_words = len(label), len(doc_of), len(chosen)
    theta = np.zeros(n_words + 1)
    theta[-1] = -6.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, bias = theta[:-1], theta[-1]
        z = np.clip(bias + np.bincount(sentence_of, w[word_of], n_sentences), -30, 30) if n_sentences else np.zeros(0)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-np.clip(bias, -30, 30)))
        none = plain * np.log1p(-min(p0, 1 - 1e-12)) + np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs)
        odds = np.where(label > 0, np.exp(none) / np.maximum(-np.expm1(none), 1e-12), -1.0)  # d log L / d(-none)
        at_sentence = odds[doc_of] * p
        gradient = np.append(np.bincount(word_of, at_sentence[sentence_of], n_words) if n_words else [], at_sentence.sum() + (odds * plain).sum() * p0) / n_docs
        gradient -= DECAY * np.append(w, 0.0)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(dict(zip(chosen, theta[:-1].tolist(), strict=True)), float(theta[-1]))


class Scorer:
    """A model with a table of the words seen and the features of the model that they have."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def known(self, word: str) -> tuple[str, ...]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= WORDS_KEPT:
                self.seen.clear()
            found = self.seen[word] = tuple(f for f in features(word) if f in self.model.weights)
        return found

    def sentence(self, sentence: str) -> float:
        found = {f for w in _WORD.findall(sentence.lower()) for f in self.known(w)}
        z = self.model.bias + sum(self.model.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))

    def document(self, text: str | None) -> float:
        """Noisy-or over the sentences. Sentences without a word of the model count at once."""
        parts = sentences(text)
        none, plain = 0.0, len(parts)
        if any(self.known(w) for w in set(_WORD.findall((text or "").lower()))):
            for s in parts:
                if any(self.known(w) for w in _WORD.findall(s.lower())):
                    none += np.log1p(-min(self.sentence(s), 1 - 1e-15))
                    plain -= 1
        none += plain * np.log1p(-min(self.sentence(""), 1 - 1e-15))
        return float(-np.expm1(none))


def score(docs: DataFrame, model: Model, columns: tuple[str, ...]) -> DataFrame:
    """The given columns and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MAX_WORDS weights at most
    docs = pick(docs, *columns)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            scores = [scorer.document(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*columns, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence_no, sentence, score) of the sentences that reach ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            rows = [(d, i, s, p) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for i, s in enumerate(sentences(t)) if (p := scorer.sentence(s)) >= least]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sentence_no", "sentence", "score"])

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, sentence_no int, sentence string, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, ("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
