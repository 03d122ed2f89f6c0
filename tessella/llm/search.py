"""Operator 2: exact top-k search by BM25 on an inverted index with block-max pruning.

* Index: a task inverts what it reads, SHARD_POSTINGS postings at a time. Such a shard is one row of the index: its documents numbered so
  that similar ones are neighbours (halved again and again along the direction in which their common words differ most; then by length),
  and its posting lists as packed arrays. Texts are not shuffled. Lengths and document counts are added up over all shards, so
  every shard scores with the same global statistics.
* Search: queries go in blocks of about QUERY_BYTES, each broadcast, to the tasks that read the shards. A task keeps the k best of each
  query over its shards, so the threshold of a query only rises from shard to shard. The tasks' results are merged by rank.
* Pruning: BLOCK documents with neighbouring numbers are a block. Lists that at least one in DENSE documents has (a few hundred of some
  400,000) are common; they are rows of a matrix, and each knows the largest impact it has in a block. All other lists are rare. Queries go in
  batches of BATCH that have the same common words, so that a batch uses few rows of the matrix and asks for the same blocks.
  1. The postings of a query's rare lists are added up; they are few.
  2. The most they give in a block, and the block maxima of the common lists, bound every score in it. Blocks whose bound is lower than the
     threshold are passed by. Without a threshold yet, the FIRST_BLOCKS blocks with the highest bounds are scored to get one.
  3. In each other block one product adds up the common lists for all queries of the batch that ask for the block.
  Sums and bounds are float32 up to here and are compared with room for all roundings.
  4. Documents that reach the threshold are scored anew in float64: copies once, from their own lists, or from the query's where those are less.
  Nothing is lost by that; cursors that move document by document would be slow in Python.

A query is a whole text with all its distinct words, each weighted by its frequency in the query. Words are runs of other than white
space, A-Z lower-cased; idf = ln(1 + (N - n + 0.5) / (n + 0.5)). Scores are rounded to 6 digits, then ties go to the smaller doc_id.

Edge cases: null and empty texts have length 0 and are never found; as queries they find nothing; documents without a word of the
query are not returned, so a query can have fewer than k rows; a row may find itself; repeated rows are found each; query rows
repeated in full are one query; null doc_ids come last among ties; an empty table finds nothing. Terms are 64-bit hashes of words.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, gives_back, pick, release_memory

K1, B = 1.2, 0.75
TOP = 10
#: Every row whose id it divides is a query.
QUERY_EVERY = 50
#: A shard ends after so many postings or documents (whose numbers have 16 bits).
SHARD_POSTINGS, SHARD_DOCS = 2_500_000, 60_000
#: Input partitions of fewer rows are read together.
PARTITION_ROWS = 5_000
#: Bytes of queries that are broadcast at once.
QUERY_BYTES = 32_000_000
#: Documents of a block; blocks that are scored when a query has no threshold yet.
BLOCK, FIRST_BLOCKS = 32, 8
DIGITS = 6
#: Lists of at least one in so many documents are kept as rows of a matrix.
DENSE = 24
#: Queries that are looked up at once; fewer where their scores would be more numbers than BATCH_CELLS.
BATCH, BATCH_CELLS = 256, 2_000_000
#: Documents, and queries, are put beside similar ones by so many common words, or as many as make a matrix of so many numbers, down to groups of LEAF.
ALIKE_WORDS, ALIKE_CELLS, LEAF = 400, 8_000_000, 2 * BLOCK
#: Postings that take as long as the calls for one document whose score is completed from its own lists.
DOC_COST = 400
#: Of more documents than this that reach a query's threshold, copies are scored once.
MANY_DOCS = 30
#: Bounds are compared with this slack, so that rounding cannot hide a result.
SLACK = 1e-5
NO_ID = 2**63 - 1

_FOUND = "query_id long, rank int, doc_id long, score double"
_INDEX = "docs int, words long, ids binary, lengths binary, terms binary, dfs binary, numbers binary, tfs binary"


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the distinct words, their frequencies, and the number of words."""
    counted = Counter((text or "").encode().lower().split())  # of bytes: A-Z only, split at ASCII white space
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counted), np.uint64, len(counted)).view(np.int64)
    order = np.argsort(hashes)
    tfs = np.fromiter(counted.values(), np.int32, len(counted))
    return hashes[order], tfs[order], int(tfs.sum())


def _inverter(postings: int, documents: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                one = terms(text.as_py())
                if held and (size + len(one[0]) > postings or len(held) >= documents):
                    yield invert(held)
                    held, size = [], 0
                held.append((NO_ID if doc is None else doc, *one))
                size += len(one[0])
        if held:
            yield invert(held)

    return run


def _neighbours(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which similar ones are near: halves along the direction of most variance, again and again. Any order would be right."""
    draw, out, open_ = np.random.default_rng(0), [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF:
            out.append(np.sort(rows))
            continue
        part = x[rows]
        mean, v = part.mean(axis=0), draw.standard_normal(x.shape[1]).astype(x.dtype)
        for _ in range(6):  # power iteration
            along = part @ v - mean @ v
            v = along @ part - along.sum() * mean
            v /= max(float(np.linalg.norm(v)), 1e-9)
        order = (part @ v).argsort(kind="stable")
        half = len(rows) // 2
        open_ += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _alike(n: int, number: np.ndarray, starts: np.ndarray, dfs: np.ndarray) -> np.ndarray:
    """The order of a shard's documents by their common words. number: the documents of the lists, one list after another."""
    common = np.flatnonzero(dfs * DENSE >= n)
    spread = dfs[common].astype(np.int64) * (n - dfs[common])
    common = common[(-spread).argsort(kind="stable")[: min(ALIKE_WORDS, ALIKE_CELLS // max(1, n))]]
    x = np.zeros((n, len(common)), np.float32)
    for k, i in enumerate(common.tolist()):
        x[number[starts[i] : starts[i] + dfs[i]], k] = math.log(n / dfs[i] + 0.5)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return _neighbours(x)


def invert(docs: list[tuple[int, np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    """The shard of documents (doc_id, terms, frequencies, length), as one row."""
    docs = sorted(docs, key=lambda d: (d[3], d[0]))
    every, tfs = (np.concatenate([d[i] for d in docs]) for i in (1, 2))
    number = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(d[1]) for d in docs])
    order = np.argsort(every, kind="stable")
    every, number, tfs = every[order], number[order], tfs[order]
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
    dfs = np.diff(np.append(starts, len(every))).astype(np.int32)
    order = _alike(len(docs), number, starts, dfs)
    docs = [docs[i] for i in order.tolist()]
    place = np.empty(len(docs), np.uint16)
    place[order] = np.arange(len(docs), dtype=np.uint16)
    number = place[number]
    order = (np.repeat(np.arange(len(dfs)) << 16, dfs) + number).argsort(kind="stable")
    number, tfs = number[order], tfs[order]
    lengths = np.array([d[3] for d in docs], np.int32)
    short = np.uint16 if tfs.max(initial=0) < 1 << 16 else np.int32
    packed = (np.array([d[0] for d in docs], np.int64), lengths, every[starts], dfs, number, tfs.astype(short))
    columns = [pa.array([len(docs)], pa.int32()), pa.array([int(lengths.sum(dtype=np.int64))], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)]
    return pa.RecordBatch.from_arrays(columns, ["docs", "words", "ids", "lengths", "terms", "dfs", "numbers", "tfs"])


def build_index(docs: DataFrame, scratch: Scratch, postings: int = SHARD_POSTINGS, documents: int = SHARD_DOCS) -> DataFrame:
    """The written index, a shard a row. Small input partitions are read together (no shuffle), so that shards are not tiny."""
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PARTITION_ROWS))
    index = rows.coalesce(tasks).mapInArrow(_inverter(postings, documents), _INDEX)
    index.write.option("parquet.block.size", 16_000_000).parquet(f"{scratch.path}/index")
    return scratch.read("index", index)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, dfs in zip(*(batch.column(c) for c in ("terms", "dfs")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_buffer(), np.int64)), pa.array(np.frombuffer(dfs.as_buffer(), np.int32))], ["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for query, tid, text in zip(*(batch.column(c).to_pylist() for c in ("query_id", "tid", "text")), strict=True):
            hashes, tfs, _ = terms(text)
            n = len(hashes)
            yield pa.RecordBatch.from_arrays([pa.array([query] * n, pa.int64()), pa.array([tid] * n, pa.int64()), pa.array(hashes), pa.array(tfs)], ["query_id", "tid", "term", "qtf"])


def weighted_queries(queries: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, tid, terms): per query the array of (term, weight), in order of the terms that the index has."""
    counts = index.select("terms", "dfs").mapInArrow(_counts, "term long, df int").groupBy("term").agg(F.sum("df").cast("double").alias("n"))
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    rows = queries.mapInArrow(_query_terms, "query_id long, tid long, term long, qtf int").join(counts, "term")
    weighed = rows.select("query_id", "tid", F.struct("term", (F.col("qtf") * idf).alias("weight")).alias("one"))
    return weighed.groupBy("query_id", "tid").agg(F.sort_array(F.collect_list("one")).alias("terms"))  # one text's words


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    sizes = ends - starts
    after = np.cumsum(sizes)
    out = np.repeat(starts - after + sizes, sizes)
    out += np.arange(len(out))
    return out


class Shard:
    """A shard's index in memory: rare lists by term, common ones as a matrix with the largest impact in each block, and all of them by document."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, term: np.ndarray, df: np.ndarray, docs: np.ndarray, tfs: np.ndarray, average: float):
        """term: sorted; df: the lengths of the lists, whose documents and frequencies follow one another in docs and tfs."""
        self.ids, self.term, self.n = ids, term, len(ids)
        self.begin = np.concatenate([[0], np.cumsum(df, dtype=np.int64)])
        self.doc, self.tf, self.norm = docs, tfs, K1 * (1 - B + B * lengths / average)
        impact = self._impact(slice(None))
        pair = np.empty((len(docs), 2), np.float32)  # document and impact of a posting in 8 bytes, so that one take has both
        pair.view(np.int32)[:, 0], pair[:, 1] = docs, impact
        self.pair = pair.view(np.int64).ravel()
        self.blocks = -(-self.n // BLOCK)
        common = np.flatnonzero(df * DENSE >= self.n)
        self.row = np.full(len(term), -1)
        self.row[common] = np.arange(len(common))
        at = _spread(self.begin[common], self.begin[common + 1])
        self.dense = np.zeros((self.blocks, len(common), BLOCK), np.float32)
        self.dense[docs[at] // BLOCK, np.arange(len(common)).repeat(df[common]), docs[at] % BLOCK] = impact[at]
        self.high = np.ascontiguousarray(self.dense.max(axis=2, initial=0).T)
        order = docs.argsort(kind="stable")
        self.own = np.arange(len(term), dtype=np.int32).repeat(df).take(order)  # a document's lists, one document after another
        self.own_impact = impact.take(order)
        self.own_begin = np.concatenate([[0], np.bincount(docs, minlength=self.n).cumsum()])

    def _impact(self, postings: np.ndarray | slice) -> np.ndarray:
        tf = self.tf[postings].astype(np.float64)
        return tf * (K1 + 1) / (tf + self.norm.take(self.doc[postings]))

    @functools.cached_property
    def same(self) -> np.ndarray:
        """For each document the first one that has the same lists and impacts."""
        first: dict[tuple[bytes, bytes], int] = {}
        ranges = enumerate(itertools.pairwise(self.own_begin.tolist()))
        return np.array([first.setdefault((xxhash.xxh3_128_digest(self.own[a:b]), xxhash.xxh3_128_digest(self.own_impact[a:b])), i) for i, (a, b) in ranges], np.int64)

    @classmethod
    def of(cls, row: dict[str, pa.Scalar], average: float) -> Shard:
        """Of a row of the index; the arrays are views of the row's buffers."""
        numbers = np.frombuffer(row["numbers"].as_buffer(), np.uint16)
        tfs = row["tfs"].as_buffer()
        kinds = (("ids", np.int64), ("lengths", np.int32), ("terms", np.int64), ("dfs", np.int32))
        return cls(*(np.frombuffer(row[c].as_buffer(), kind) for c, kind in kinds), numbers, np.frombuffer(tfs, np.int32 if len(numbers) * 4 == tfs.size else np.uint16), average)

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of the lists of these sorted terms; -1 where there is none."""
        at = np.minimum(self.term.searchsorted(terms), max(0, len(self.term) - 1))
        return np.where(self.term[at] == terms, at, -1) if len(self.term) else np.full(len(terms), -1)

    def find(self, number: np.ndarray, at: np.ndarray, w: np.ndarray, least: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each query numbers and scores of documents, with all of the k best that reach ``least`` among them; and in how many blocks scores
        were completed. number, at, w: the query, list and weight of each of the queries' terms, one query after another."""
        n = len(least)
        ends = number.searchsorted(np.arange(n + 1))
        # A sum of m positive float32 products is at most m + 2 roundings off, whatever their order; twice that where two such sums are compared.
        near = 1 - 2.0**-22 * (np.diff(ends) + 4)
        row = self.row.take(at)
        rare, common = (row < 0).nonzero()[0], (row >= 0).nonzero()[0]
        weights = np.zeros((n, len(self.high)), np.float32)
        weights[number.take(common), row.take(common)] = w.take(common)
        used = weights.any(axis=0).nonzero()[0]
        weights = weights.take(used, axis=1)
        given = np.zeros((n, self.blocks, BLOCK), np.float32)
        flat = given.reshape(n, -1)
        cuts = rare.searchsorted(ends).tolist()
        at_rare, w_rare = at.take(rare), w.take(rare).astype(np.float32)
        for q, (a, b) in enumerate(itertools.pairwise(cuts)):
            if b > a:
                flat[q, : self.n] = self._rare(at_rare[a:b], w_rare[a:b])
        bound = weights @ self.high[used]
        bound += np.maximum.reduceat(flat, np.arange(self.blocks) * BLOCK, axis=1)

        least = np.where(least > 0, least * near - SLACK, 0.0)
        scored = np.zeros(bound.shape, bool)
        if (new := (least <= 0).nonzero()[0]).size:
            first = (-bound[new]).argpartition(min(FIRST_BLOCKS, self.blocks) - 1, axis=1)[:, :FIRST_BLOCKS]
            scored[new[:, None], first] = True
            self._complete(given, weights, used, scored)
            for q, blocks in zip(new.tolist(), first, strict=True):
                least[q] = _reached(given[q, blocks].ravel(), k) * near[q] - SLACK
        least = np.nextafter(np.maximum(least, 0).astype(np.float32), np.float32(0))  # rounded down; bounds of 0 are no results
        more = (bound > least[:, None]) & ~scored
        self._complete(given, weights, used, more)
        hits = (flat > least[:, None]).ravel().nonzero()[0]
        query, doc = np.divmod(hits, flat.shape[1])
        cuts = query.searchsorted(np.arange(n + 1)).tolist()
        held, found = np.zeros(len(self.term)), []
        for q, (a, b) in enumerate(itertools.pairwise(cuts)):
            docs = doc[a:b]
            if b - a > k:
                score = flat[q].take(docs)
                docs = docs[score >= _reached(score, k) * near[q] - SLACK]
            found.append((docs, self._exact(at[ends[q] : ends[q + 1]], w[ends[q] : ends[q + 1]], docs, held)))
        return found, int(scored.sum() + more.sum())

    def _rare(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What these lists give each document."""
        begin, end = self.begin.take(at), self.begin.take(at + 1)
        pair = self.pair.take(_spread(begin, end))
        return np.bincount(pair.view(np.int32)[::2], pair.view(np.float32)[1::2] * weights.repeat(end - begin), self.n)

    def _complete(self, given: np.ndarray, weights: np.ndarray, used: np.ndarray, blocks: np.ndarray) -> None:
        """Adds what the used rows of the matrix give the documents of these blocks (queries x blocks)."""
        for b in blocks.any(axis=0).nonzero()[0].tolist():
            here = blocks[:, b].nonzero()[0]
            given[here, b] += weights[here] @ self.dense[b].take(used, axis=0)

    def _exact(self, at: np.ndarray, weights: np.ndarray, docs: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Scores of documents, of all their lists, in float64. held: zeros, as many as there are lists."""
        if not len(docs):
            return np.empty(0)
        if len(docs) > MANY_DOCS:
            one, back = np.unique(self.same.take(docs), return_inverse=True)
            if len(one) < len(docs):
                return self._exact(at, weights, one, held).take(back)
        begin, end = self.own_begin.take(docs), self.own_begin.take(docs + 1)
        first, last = self.begin.take(at), self.begin.take(at + 1)
        if (end - begin + DOC_COST).sum() > 2 * (last - first).sum():  # the query's lists are less than the documents'
            postings = _spread(first, last)
            return np.bincount(self.doc.take(postings), self._impact(postings) * weights.repeat(last - first), self.n).take(docs)
        out = np.empty(len(docs))
        held[at] = weights
        for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            out[i] = held.take(self.own[a:b]) @ self.own_impact[a:b]
        held[at] = 0
        return out


def _reached(scores: np.ndarray, k: int) -> float:
    """The k-th best score; 0 where there are fewer."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0.0


def _alike_queries(sizes: np.ndarray, at: np.ndarray, terms: int) -> np.ndarray:
    """An order of the queries in which those with the same common terms are near: they ask for the same blocks. at: the numbers of their terms."""
    common = (-np.bincount(at, minlength=terms)).argsort(kind="stable")[: min(ALIKE_WORDS, ALIKE_CELLS // max(1, len(sizes)))]
    column = np.full(terms, -1)
    column[common] = np.arange(len(common))
    column = column.take(at)
    x = np.zeros((len(sizes), len(common)), np.float32)
    x[np.arange(len(sizes)).repeat(sizes)[column >= 0], column[column >= 0]] = 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return _neighbours(x)


class Best:
    """The k best documents of each query so far. A query is its terms and weights."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int):
        self.k = k
        self.ids, self.scores = [np.empty(0, np.int64)] * len(queries), [np.empty(0)] * len(queries)
        self.blocks = self.scored = 0
        sizes = np.array([len(terms) for terms, _ in queries], np.int64)
        self.terms, at = np.unique(np.concatenate([np.empty(0, np.int64), *(q[0] for q in queries)]), return_inverse=True)
        self.order = _alike_queries(sizes, at, len(self.terms))
        begin = np.cumsum(sizes) - sizes
        at_term = _spread(begin[self.order], (begin + sizes)[self.order])
        self.at, self.weights = at[at_term], np.concatenate([np.empty(0), *(q[1] for q in queries)])[at_term]
        self.begin = np.concatenate([[0], sizes[self.order].cumsum()])

    def visit(self, shard: Shard) -> None:
        if not shard.n:
            return
        lists = shard.lists(self.terms)
        batch = max(1, min(BATCH, BATCH_CELLS // shard.n))
        for begin in range(0, len(self.order), batch):
            queries = self.order[begin : begin + batch].tolist()
            a, *_, b = cuts = self.begin[begin : begin + len(queries) + 1]
            at = lists.take(self.at[a:b])
            here = (at >= 0).nonzero()[0]
            number = np.arange(len(queries)).repeat(np.diff(cuts))
            least = np.array([self._least(q) for q in queries])
            found, scored = shard.find(number.take(here), at.take(here), self.weights[a:b].take(here), least, self.k)
            self.blocks += shard.blocks * len(queries)
            self.scored += scored
            for q, (docs, scores) in zip(queries, found, strict=True):
                if len(docs):
                    self._take(q, shard.ids[docs], np.round(scores, DIGITS))

    def _least(self, q: int) -> float:
        """What a document must reach to be among the k best."""
        return self.scores[q][-1] if len(self.scores[q]) == self.k else 0.0

    def _take(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        ids, scores = ids[scores > 0], scores[scores > 0]
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]


def _searcher(queries, k: int, average: float):
    """The k best over the shards a task reads, for each query of the broadcast block."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best([(a, b) for _, _, a, b in queries.value], k)
        release_memory()
        for batch in batches:
            for i in range(batch.num_rows):
                best.visit(Shard.of({c: batch.column(c)[i] for c in batch.schema.names}, average))
        for at in range(0, len(queries.value), 10_000):
            part = range(at, min(at + 10_000, len(queries.value)))
            n = [len(best.ids[q]) for q in part]
            names = [pa.array(np.repeat(np.array([queries.value[q][i] for q in part], np.int64), n)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*names, *(pa.array(np.concatenate([x[q] for q in part])) for x in (best.ids, best.scores))], ["query_id", "tid", "doc_id", "score"])

    return run


def _blocks(asked: DataFrame, scratch: Scratch, query_bytes: int) -> list[DataFrame]:
    """The weighted queries in written blocks of about query_bytes (a single query of more is a block that large)."""
    written = scratch.table(asked, "weighted")
    size = written.agg(F.sum(16.0 * F.size("terms") + 100)).first()[0] or 0
    n = max(1, math.ceil(size / query_bytes))
    dealt = written.withColumn("block", F.pmod(F.xxhash64("query_id", "tid"), F.lit(n)).cast("int"))
    dealt.write.partitionBy("block").parquet(f"{scratch.path}/queries")
    every = scratch.read("queries", dealt)
    return [every.where(F.col("block") == b).drop("block") for b in range(n)] if size else []


def _arrays(block: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    table = block.toArrow().combine_chunks()
    out = []
    for batch in table.to_batches():
        lists = batch.column("terms")
        offsets = lists.offsets.to_numpy()
        terms, weights = (lists.values.field(i).to_numpy() for i in (0, 1))
        out += [(q, t, terms[a:b], weights[a:b]) for q, t, a, b in zip(batch.column("query_id").to_pylist(), batch.column("tid").to_pylist(), offsets[:-1], offsets[1:], strict=True)]
    return out


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, postings: int = SHARD_POSTINGS, documents: int = SHARD_DOCS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents for each (query_id, text) row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    index = build_index(docs, scratch, postings, documents)
    n_docs, words = index.agg(F.sum("docs"), F.sum("words")).first()
    average = (words or 0) / max(1, n_docs or 0) or 1.0
    asked = pick(queries, "query_id", "text").select(F.coalesce(F.col("query_id").cast("long"), F.lit(NO_ID)).alias("query_id"), F.xxhash64("text").alias("tid"), "text")
    blocks = _blocks(weighted_queries(asked.dropDuplicates(["query_id", "tid"]), index, n_docs or 0), scratch, query_bytes)

    rank = F.row_number().over(W.partitionBy("query_id", "tid").orderBy(F.desc("score"), "doc_id"))  # k rows a task
    shards = index.coalesce(2 * spark.sparkContext.defaultParallelism)  # several shards a task, where there are many
    shown = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    found = spark.createDataFrame([], _FOUND)
    for block in blocks:
        asked = spark.sparkContext.broadcast(_arrays(block))
        best = shards.mapInArrow(_searcher(asked, k, average), "query_id long, tid long, doc_id long, score double").withColumn("rank", rank).where(F.col("rank") <= k)
        found = scratch.table(best.select(shown("query_id"), "rank", shown("doc_id"), "score"), "found", "append")
        asked.destroy()
    scratch.drop_all_but("found")
    return found


def op2_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, docs.where(F.col("doc_id") % QUERY_EVERY == 0).withColumnRenamed("doc_id", "query_id"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE / count(*) AS avgdl FROM d),
p AS (SELECT r, doc_id, len(w)::DOUBLE AS dl, unnest(w) AS term FROM d),
t AS (SELECT r, doc_id, term, any_value(dl) AS dl, count(*)::DOUBLE AS tf FROM p GROUP BY r, doc_id, term),
f AS (SELECT term, ln(1 + (any_value(g.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, g GROUP BY term),
q AS (SELECT t.doc_id AS query_id, t.term, t.tf * f.idf AS weight FROM t JOIN f USING (term) WHERE t.doc_id % {QUERY_EVERY} = 0),
s AS (SELECT q.query_id, t.r, t.doc_id, round(sum(q.weight * t.tf * {K1 + 1} / (t.tf + {K1} * ({1 - B} + {B} * t.dl / g.avgdl))), {DIGITS}) AS score
  FROM q JOIN t USING (term), g GROUP BY q.query_id, t.r, t.doc_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {TOP}
"""
