"""Operator 13: repeated passages by a radix sort of all suffixes that ends at the threshold.

Two suffixes are equal as far as this operator looks if their first ``threshold`` bytes (their window) are. The sort goes by
most-significant-digit passes and moves blocks of neighbouring suffixes instead of single ones, since neighbours share most bytes:

1. Every window holds ``width`` overlapping grams. The one with the smallest hash (the leftmost of equals) is the window's anchor, wherever
   the window stands. The windows of one anchor start at neighbouring places: a block. Its digit is the gram, which all of them hold.
2. A pass shuffles (digit, content, place) of each block and sorts. A block alone with its digit repeats nowhere. Of blocks with one
   digit and one content, that is the same bytes from the first window's start to the last one's end, all but the first (by doc_id and
   place) are repeats as a whole. The first of each content is split up if its digit has other contents.
3. The next pass has blocks of an eighth of the width; their digit is longer, as fewer windows share more bytes. At the last pass a block
   is one suffix and its digit the whole window: equal groups are exactly the repeated windows.

Digits and contents are two independent 64-bit hashes, compared together. Texts are shuffled once, in compressed blocks, to a bucketed
table that every later step reads without shuffling it. What a task itself sees twice is told apart before the shuffle, so that a common
passage gives one row a task; digits that a sample shows to be common are spread by their contents, and all their blocks are split.

Edge cases: null and empty texts, and texts shorter than the threshold, lose nothing; documents with one doc_id, or without one (they come
last), are in the order in which they were packed; rows repeated in full lose all but the first; matches never cross documents, also
where one text is cut into pieces; an empty table gives an empty result; columns with other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bloom import mix64
from tessella.llm.common import Scratch, pick

#: Bytes of a window, and at most.
THRESHOLD, LONGEST = 100, 4096
#: Widest block of suffixes, and what the width is divided by from pass to pass.
WIDEST, SPLIT = 64, 8
#: Bytes and documents of a block of texts; a longer text is a block of its own, hashed in pieces of this size.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 1 << 16
#: Rows in which a task looks for repeats of its own before it hands them on.
LOCAL_ROWS = 1 << 19
#: One in so many documents is looked at for common digits; a digit with so many rows there is common, the first so many are kept.
SAMPLE, COMMON_ROWS, COMMON_KEYS = 32, 64, 1000
NO_ID = 2**63 - 1
#: Bits of a block's first and last offset in a packed place.
_BITS = 8

_BLOCKS = "block long, docs int, ids binary, no_id binary, lengths binary, texts binary"
_ROWS = "key long, salt long, content long, id long, doc long, at long"
_STATUS = "block long, doc long, at long, splits boolean"
_random = np.random.default_rng(0x5EED)  # fixed weights of the hashes
_WEIGHTS = _random.integers(0, 2**63, (2, LONGEST), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _random.integers(0, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def widths(threshold: int) -> list[int]:
    """Of the blocks of each pass, ending with 1."""
    out = [1 << max(0, min(WIDEST, 2 * threshold // 3).bit_length() - 1)]
    while out[-1] > 1:
        out.append(max(1, out[-1] // SPLIT))
    return out


# -- hashes --------------------------------------------------------------------------------------------------------------
def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at each place, put together from hashes of powers of two."""
    power = (data.astype(np.uint64) + np.uint64(1)) * _STEP[0]
    out, done, span, level = None, 0, 1, 1

    def joined(a: np.ndarray, b: np.ndarray, step: np.uint64) -> np.ndarray:
        c = a * step
        c ^= c >> np.uint64(29)
        c += b
        c *= _STEP[63]
        return c

    while True:
        if size & span:
            out = power if out is None else joined(out[: len(power) - done], power[done:][: len(out)], _STEP[32 + level])
            done += span
        if done == size:
            return mix64(out[: len(data) - size + 1])
        power = joined(power[:-span], power[span:], _STEP[level])
        span, level = 2 * span, level + 1


def place_hashes(data: np.ndarray, starts: np.ndarray, size: int, which: int) -> np.ndarray:
    """The same for a few places: random weights times bytes."""
    out, rows = np.empty(len(starts), np.uint64), np.lib.stride_tricks.sliding_window_view(data, size)
    for at in range(0, len(starts), 8192):
        out[at : at + 8192] = (rows[starts[at : at + 8192]].astype(np.uint64) + np.uint64(1)) @ _WEIGHTS[which, :size]
    return mix64(out)


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, threshold: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last offset of its windows (anchor less start), and gram hash, of the texts at begin to end."""
    empty = np.empty(0, np.int64)
    if len(data) < threshold:
        return empty, empty, empty, empty.view(np.uint64)
    size = threshold - width + 1
    hashes = gram_hashes(data, size)
    place = np.uint64(0x7FFFFFFF)
    least = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    count = np.zeros(len(data) + 1, np.int8)
    long = end - begin >= threshold
    count[begin[long]] += 1
    count[end[long] - threshold + 1] -= 1
    starts = np.flatnonzero(np.cumsum(count[: len(least)]))
    if not len(starts):
        return empty, empty, empty, empty.view(np.uint64)
    anchor = (least[starts] & place).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[new[1:], len(starts)] - 1
    anchor = anchor[new]
    return anchor, anchor - starts[last], anchor - starts[new], hashes[anchor]


def _contents(data: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: int) -> np.ndarray:
    """Of all bytes from the first to the last window: both windows cover them."""
    first, last = (place_hashes(data, anchor - x, threshold, 1) for x in (high, low))
    return mix64(first * _STEP[60] + last * _STEP[61] + (low * 4096 + high).astype(np.uint64) * _STEP[62])


# -- blocks of texts -----------------------------------------------------------------------------------------------------
def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(3).compress

    def packed(rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        ids = np.array([NO_ID if i is None else i for i, _ in rows], np.int64)
        values = [number, len(rows), ids.tobytes(), bytes(i is None for i, _ in rows), np.array([len(t) for _, t in rows], np.int64).tobytes(), squeeze(b"".join(t for _, t in rows))]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], [c.split()[0] for c in _BLOCKS.split(", ")])

    held, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = (text.as_py() or "").encode()
            if held and (size + len(text) > BLOCK_BYTES or len(held) == BLOCK_DOCS):
                yield packed(held)
                held, size, number = [], 0, number + 1
            held.append((doc, text))
            size += len(text)
    if held:
        yield packed(held)


class _Texts:
    """A row of the table of blocks."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        read = lambda c: batch.column(c)[i].as_py()
        self.block = read("block")
        self.ids = np.frombuffer(read("ids"), np.int64)
        self.missing = np.frombuffer(read("no_id"), bool)
        self.end = np.cumsum(np.frombuffer(read("lengths"), np.int64))
        self.begin = np.r_[0, self.end[:-1]]
        self.packed = read("texts")

    def data(self) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.packed, int(self.end[-1]) or 1), np.uint8)

    def docs(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, places, "right")


def _marks(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, anchor, first and last offset of the blocks of suffixes marked in a block of texts."""
    marks = batch.column("marks")[i].values
    if marks is None or not len(marks):
        return (np.empty(0, np.int64),) * 4
    doc, at = (marks.field(c).to_numpy() for c in (0, 1))
    return doc, at >> 2 * _BITS, (at >> _BITS) & ((1 << _BITS) - 1), at & ((1 << _BITS) - 1)


# -- a pass --------------------------------------------------------------------------------------------------------------
class _Rows:
    """Rows of a task, told apart among themselves: repeats have a negative place, and a key that spreads them."""

    def __init__(self, common: np.ndarray):
        self.common, self.held, self.size = common, [], 0

    def add(self, key, content, ids, doc, at) -> Iterator[pa.RecordBatch]:
        self.held.append((key, content, ids, doc, at))
        self.size += len(key)
        if self.size >= LOCAL_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        key, content, ids, doc, at = (np.concatenate([h[i] for h in self.held]) for i in range(5))
        self.held, self.size = [], 0
        order = np.lexsort((at, doc, ids, content, key))
        key, content, ids, doc, at = (x[order] for x in (key, content, ids, doc, at))
        again = np.r_[False, (key[1:] == key[:-1]) & (content[1:] == content[:-1])]
        salt = np.where(np.isin(key, self.common), content | np.uint64(1), np.uint64(0))
        key, content, salt, at = np.where(again, mix64(doc.view(np.uint64)), key), np.where(again, 0, content), np.where(again, 0, salt), np.where(again, ~at, at)
        columns = [x.astype(np.uint64).view(np.int64) for x in (key, salt, content)] + [ids, doc, at]
        for begin in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[begin : begin + (1 << 16)]) for x in columns], [c.split()[0] for c in _ROWS.split(", ")])


def _sampled(texts: _Texts) -> np.ndarray:
    name = (np.uint64(texts.block) << np.uint64(16)) + np.arange(len(texts.ids), dtype=np.uint64)
    return mix64(name) % np.uint64(SAMPLE) == 0


def _first_pass(threshold: int, common: np.ndarray, sample: bool):
    """The rows of the anchors of all texts, or of a sample of the documents."""
    width = widths(threshold)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(common)
        for batch in batches:
            for i in range(batch.num_rows):
                texts = _Texts(batch, i)
                if sample and not (chosen := _sampled(texts)).any():
                    continue
                data = texts.data()
                for begin in range(0, max(1, len(data) - threshold + 1), BLOCK_BYTES):  # pieces of a long text, overlapping by what windows reach
                    piece = data[begin : begin + BLOCK_BYTES + threshold - 1]
                    a, b = np.maximum(texts.begin, begin) - begin, np.minimum(texts.end, begin + len(piece)) - begin
                    here = (b - a >= threshold) & chosen if sample else b - a >= threshold
                    anchor, low, high, gram = anchors(piece, a[here], b[here], threshold, width)
                    content = _contents(piece, anchor, low, high, threshold) if len(anchor) else gram
                    doc = texts.docs(anchor + begin)
                    at = (anchor + begin - texts.begin[doc]) << 2 * _BITS | low << _BITS | high
                    yield from rows.add(gram, content, texts.ids[doc], texts.block << 16 | doc, at)
        yield from rows.flush()

    return run


def _later_pass(threshold: int, width: int, common: np.ndarray, sample: bool):
    """The rows of marked blocks of suffixes, split to this width."""
    size = threshold - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(common)
        for batch in batches:
            for i in range(batch.num_rows):
                texts, (doc, anchor, low, high) = _Texts(batch, i), _marks(batch, i)
                if sample:
                    chosen = _sampled(texts)[doc]
                    doc, anchor, low, high = doc[chosen], anchor[chosen], low[chosen], high[chosen]
                if not len(doc):
                    continue
                parts = high // width - low // width + 1
                of = np.repeat(np.arange(len(doc)), parts)
                base = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts) + low[of] // width) * width
                doc, anchor, low, high = doc[of], anchor[of], np.maximum(low[of], base), np.minimum(high[of], base + width - 1)
                data, place = texts.data(), anchor + texts.begin[doc]
                key = mix64(place_hashes(data, place - base, size, 0) + base.astype(np.uint64) * _STEP[59])
                yield from rows.add(key, _contents(data, place, low, high, threshold), texts.ids[doc], texts.block << 16 | doc, anchor << 2 * _BITS | low << _BITS | high)
        yield from rows.flush()

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, content and place: repeats, and the first blocks of contents whose digit has others (splits).

    What waits from batch to batch is one row: the only content so far of the last key.
    """
    last, waiting, mixed = None, None, False
    for batch in batches:
        key, salt, content, doc, at = (batch.column(c).to_numpy() for c in ("key", "salt", "content", "doc", "at"))
        told = at < 0
        key, salt, content, place = key[~told], salt[~told], content[~told], np.column_stack([doc, at])[~told]
        repeats, splits = [np.column_stack([doc, ~at])[told]], []
        if len(key):
            goes_on = last is not None and key[0] == last[0]
            new_key = np.r_[not goes_on, key[1:] != key[:-1]]
            new = new_key | np.r_[not goes_on or content[0] != last[1], content[1:] != content[:-1]]
            repeats.append(place[~new])
            group = np.cumsum(new_key) - (0 if goes_on else 1)
            contents = np.bincount(group[new], minlength=group[-1] + 1)
            several = contents >= 2
            if goes_on:
                several[0] = mixed or contents[0] > 0
                if several[0] and waiting is not None:
                    splits.append(waiting[None])
            elif waiting is not None:
                waiting = None
            several[group[salt != 0]] = True
            splits.append(place[new & several[group]])
            mixed = bool(several[-1])
            if mixed:
                waiting = None
            elif new_key.any():
                waiting = place[np.flatnonzero(group == group[-1])[0]]
            last = (key[-1], content[-1])
        out = np.concatenate([*repeats, *splits])
        n = sum(map(len, repeats))
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0] >> 16), pa.array(out[:, 0] & 0xFFFF), pa.array(out[:, 1]), pa.array(np.arange(len(out)) >= n)], ["block", "doc", "at", "splits"])


def _marked(blocks: DataFrame, status: DataFrame, how: str) -> DataFrame:
    """blocks with the (doc, at) of the statuses as marks; blocks are not shuffled."""
    marks = status.groupBy("block").agg(F.collect_list(F.struct("doc", "at")).alias("marks"))  # of one block of texts
    return blocks.join(marks, "block", how)


def _common(rows: DataFrame) -> np.ndarray:
    counted = rows.where("at >= 0").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_ROWS)
    return np.array([r.key for r in counted.orderBy(F.desc("n"), "key").limit(COMMON_KEYS).collect()], np.int64).view(np.uint64)


def repeated_blocks(blocks: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    """(block, doc, at) of the blocks of suffixes that repeat earlier ones, from all passes."""
    parts, status = int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), None
    found = []
    for k, width in enumerate(widths(threshold)):
        if k == 0:
            rows = lambda common, sample: blocks.mapInArrow(_first_pass(threshold, common, sample), _ROWS)
        else:
            marked = _marked(blocks, status.where("splits"), "inner")
            rows = lambda common, sample, marked=marked, width=width: marked.mapInArrow(_later_pass(threshold, width, common, sample), _ROWS)
        common = _common(rows(np.empty(0, np.uint64), True))
        dealt = rows(common, False).repartition(parts, "key", "salt").sortWithinPartitions("key", "content", "id", "doc", "at")
        status = scratch.table(dealt.mapInArrow(_resolve, _STATUS), f"pass-{k}")
        found.append(status.where("not splits").select("block", "doc", "at"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# -- the result ----------------------------------------------------------------------------------------------------------
def _cut(threshold: int):
    """Per document: doc_id, n_bytes, the maximal removed runs, and the bytes that are left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts, (doc, anchor, low, high) = _Texts(batch, i), _marks(batch, i)
                data = texts.data()
                change = np.zeros(len(data) + 1, np.int32)
                place = anchor + texts.begin[doc]
                np.add.at(change, place - high, 1)
                np.add.at(change, place - low + threshold, -1)
                gone = np.cumsum(change[:-1]) > 0
                out, size = [], 0
                for d, (a, b) in enumerate(zip(texts.begin.tolist(), texts.end.tolist(), strict=True)):
                    edges = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False]))
                    kept = data[a:b][~gone[a:b]].tobytes() if len(edges) else data[a:b].tobytes()
                    out.append({"doc_id": None if texts.missing[d] else int(texts.ids[d]), "n_bytes": b - a, "begins": edges[::2].tolist(), "ends": edges[1::2].tolist(), "kept": kept})
                    size += len(kept)
                    if size > BLOCK_BYTES or len(out) == 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_bytes, begins, ends, kept): every byte goes that a window covers which also starts earlier. The result reads written tables."""
    if not 1 <= threshold <= LONGEST:
        raise ValueError(f"the threshold lies between 1 and {LONGEST} bytes")
    scratch = Scratch(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = rows.mapInArrow(_packer, _BLOCKS).repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), "block")
    blocks = scratch.bucketed(packed, "texts", "block")
    repeats = repeated_blocks(blocks, scratch, threshold)
    return _marked(blocks, repeats, "left").mapInArrow(_cut(threshold), "doc_id long, n_bytes long, begins array<long>, ends array<long>, kept binary")


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.octet_length("kept").cast("long")
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
