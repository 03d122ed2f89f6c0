"""Operator 3: near duplicates by MinHash with tensored banding.

* Documents with the same shingle set are one class, so copies cost nothing further.
* A class gets two collections of COLLECTION sub-keys, each of ROWS minhashes. Table key (i, j) combines sub-key i of the first with
  sub-key j of the second: COLLECTION ** 2 tables of 2 * ROWS rows each from 2 * COLLECTION * ROWS minhashes. A pair with Jaccard s
  shares no key with probability below 2 * (1 - s ** ROWS) ** COLLECTION: 0.12 % at s = 0.75, 0.02 % at 0.8.
* Candidates of a bucket: every class with the bucket's centre, never all pairs. Candidates are confirmed on their full shingle sets, and
  links are merged to components.
* That is repeated ROUNDS times with other centres, each time for the classes that are in another component than the larger part of
  their bucket.
* What that leaves is compared in full: where classes with the same sub-key of the first collection still belong to several components,
  every class outside the largest one is compared with all classes of other components there. Sketches come first: FINE further
  minhashes of each class that is left, SKETCH_ROWS of them held by a task while the group passes by. Texts are fetched only for classes
  with a pair that its sketches leave, PART_ROWS held at once, and their full sets are compared. No pairs are written, only the links
  that join two components. The work is that of the classes left over, not of the bucket; a family of templates below the threshold
  costs sketches, not texts.

What can be lost: pairs that share no table key, above; pairs whose minhashes agree in fewer than MIN_AGREE of HASHES places (3e-5 at
s = 0.75) or, if left over, in fewer than FINE_AGREE of the further ones (below 1e-5).

Edge cases: null and empty texts, and texts without words, have the empty set (n_shingles 0) and are linked with nothing, not even
with each other; fewer words than a shingle make one shingle of all words; rows repeated in full, or with equal ids, fall in the class
of their text; null doc_ids are ignored in a component's smallest id (it is null if all are), and kept is false for them.
Set equality and intersections use 64-bit shingle hashes and a 128-bit digest of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.bloom import mix64
from tessella.llm.common import Scratch, gives_back, pick, slices, small_enough
from tessella.llm.components import components

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
COLLECTION, ROWS = 9, 2
HASHES = 2 * COLLECTION * ROWS
MIN_AGREE = 16
ROUNDS = 3
#: Members that are compared with one copy of a bucket's centre.
SITE_ROWS = 2000
#: Classes left over in a group of which a task holds the sketches, or the full sets.
SKETCH_ROWS, PART_ROWS = 10_000, 1000
#: Classes of a group that pass by the classes held in one task; beyond, several tasks hold the same ones.
STREAM_ROWS = 100_000
#: Minhashes (a byte each) of a class left over, and how many of the first FINE_FIRST and of all of a pair's must agree: 4.5 deviations
#: below what s = 0.75 gives.
FINE, FINE_FIRST = 1024, 256
FINE_AGREE, FIRST_AGREE = 705, 160

#: Odd multipliers of a 64-bit hash: each permutes the shingles' hashes.
_FACTORS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_FINE_FACTORS = mix64(np.arange(1, FINE + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(64)]


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, split at ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    mixed = np.full(n, np.uint64(min(len(words), width)))
    for k in range(min(width, len(words))):
        mixed = mix64(mixed * _POWERS[1] + hashes[k : k + n])
    return np.unique(mixed)


def minhashes(shingles: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    out, step = np.full(len(factors), np.iinfo(np.uint64).max), max(1, 4096 * HASHES // len(factors))
    for at in range(0, len(shingles), step):
        out = np.minimum(out, (shingles[None, at : at + step] * factors[:, None]).min(axis=1))
    return out


def fine_sketch(shingles: np.ndarray) -> bytes:
    return (minhashes(shingles, _FINE_FACTORS) >> np.uint64(40)).astype(np.uint8).tobytes()


def sub_keys(mins: np.ndarray) -> np.ndarray:
    """The first collection's sub-keys, then the second's."""
    out = np.zeros(2 * COLLECTION, np.uint64)
    for r in range(ROWS):
        out = mix64(out ^ mins[r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _sketches(width: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, sizes, subs, sigs = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                m = minhashes(s) if len(s) else None
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                subs.append(sub_keys(m).view(np.int64) if len(s) else None)
                sigs.append((m >> np.uint64(20)).astype(np.uint16).view(np.int16) if len(s) else None)
            columns = [batch.column("doc_id"), batch.column("tid"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(subs, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tid", "n_shingles", "digest", "subs", "sig"])

    return run


def table_keys(subs: Column, size: int = COLLECTION) -> Column:
    """Array of (at, key) of the size ** 2 tables: sub-key i of the first collection with sub-key j of the second."""
    numbers = F.sequence(F.lit(0), F.lit(size - 1))
    one = lambda i, j: F.struct((i * size + j).cast("int").alias("at"), F.xxhash64(i, j, F.element_at(subs, i + 1), F.element_at(subs, j + size + 1)).alias("key"))
    return F.flatten(F.transform(numbers, lambda i: F.transform(numbers, lambda j: one(i, j))))


def _likely(a: str, b: str) -> Column:
    """Whether two classes (structs with n and sig) can be linked, by size and by agreement of their minhashes."""
    sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * PERCENT
    agree = F.aggregate(F.zip_with(f"{a}.sig", f"{b}.sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return sizes & (agree >= MIN_AGREE)


def _compare(width: int, percent: int):
    """Rows come sorted by (site, salt), the centre first: each member is compared with the centre, one set is held."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            a, b = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("site", "salt", "member", "node", "text")), strict=True)
            for site, salt, member, node, text in rows:
                s = shingle_set(text, width)
                if not member:
                    at, centre = (site, salt), s
                elif at == (site, salt):
                    both = np.intersect1d(centre, s, assume_unique=True).size
                    if 100 * both >= percent * (len(centre) + len(s) - both):
                        a.append(node)
                        b.append(site)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirm(pairs: DataFrame, source: DataFrame, classes: DataFrame, scratch: Scratch, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of (a, b) pairs of classes those whose full sets are similar enough.

    b is the centre of a site. A site's members are dealt by a salt to parts of about SITE_ROWS members, each with its own copy of
    the centre, so that a centre with very many members is no single task. Texts are shuffled once, to their sites.
    """
    hot = pairs.groupBy("b").agg(F.ceil(F.count("*") / SITE_ROWS).cast("int").alias("parts")).where("parts > 1").withColumnRenamed("b", "of")
    hot = scratch.table(hot, f"hot-{scratch.serial()}")  # one row for every SITE_ROWS pairs at most
    salted = pairs.join(small_enough(hot), F.col("b") == F.col("of"), "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int"))
    members = salted.select(F.col("a").alias("node"), F.col("b").alias("site"), "salt", F.lit(True).alias("member"))
    centres = salted.select(F.col("b").alias("node"), F.col("b").alias("site"), "salt", F.lit(False).alias("member")).distinct()
    roles = members.unionByName(centres).join(classes.select("node", F.col("one.doc_id").alias("rid"), F.col("one.tid").alias("rtid")), "node")
    roles = scratch.table(roles, f"roles-{scratch.serial()}")
    texts = _texts(source, roles, ["site", "salt", "member", "node"])
    placed = texts.repartition("site", "salt").sortWithinPartitions("site", "salt", "member")
    return placed.mapInArrow(_compare(width, percent), "a long, b long").distinct()


def _texts(source: DataFrame, roles: DataFrame, columns: list[str], then=None, schema: str | None = None) -> DataFrame:
    """The columns of roles (written, with rid and rtid) and the text that they name; of rows repeated in full a task passes on one.

    ``then`` is a batch function that takes these rows in the same worker.
    """
    found = source.join(small_enough(roles), F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("tid") == F.col("rtid"))).select(*columns, "text")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
            new = [r not in seen and not seen.add(r) for r in rows]
            yield batch if all(new) else batch.filter(pa.array(new, pa.bool_()))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(distinct(batches)) if then else distinct(batches)

    return found.mapInArrow(run, schema or found.schema)


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (smallest doc_id of its class), component_id, kept."""
    alone = F.col("node").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return _placed(docs, width, percent, rounds).select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def _placed(docs: DataFrame, width: int, percent: int, rounds: int) -> DataFrame:
    """Per document: doc_id, tid (hash of its text), n_shingles, node (its class; null without words), label, class_id, component_id."""
    scratch = Scratch(docs.sparkSession)
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tid"))
    sketches = source.mapInArrow(_sketches(width), "doc_id long, tid long, n_shingles long, digest binary, subs array<long>, sig array<short>")
    sketches = scratch.table(sketches.withColumn("node", F.xxhash64("digest")), "sketches")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "subs", "sig")]
    classes = sketches.where("digest is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("doc_id", "tid")).alias("one"), *firsts)
    classes = scratch.table(classes, "classes")
    shared = scratch.table(_shared(classes), "shared")

    labels, links, tested = None, None, None
    for step in range(rounds):
        open_ = _open_buckets(shared, labels)
        if labels is not None:
            open_ = scratch.table(open_, f"open-{step}")
            if open_.isEmpty():
                break
        pairs = _centre_pairs(open_, step).distinct()
        pairs = scratch.table(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), f"pairs-{step}")
        if pairs.isEmpty():
            break
        found = scratch.table(confirm(pairs, source, classes, scratch, width, percent), f"links-{step}")
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        labels = components(links, scratch) if labels is None or not found.isEmpty() else labels
    if labels is not None:
        found = scratch.table(_leftovers(shared, labels, source, classes, scratch, width, percent), "links-rest")
        if not found.isEmpty():
            labels = components(links.union(found), scratch)

    if labels is None:
        labels = classes.select("node", F.col("node").alias("label")).where("false")
    named = classes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    placed = scratch.table(named.join(lowest, "label").select("node", "label", F.col("doc_id").alias("class_id"), "component_id"), "placed")
    scratch.drop_all_but("sketches", "placed")
    return sketches.select("doc_id", "tid", "n_shingles", F.when(F.col("digest").isNotNull(), F.col("node")).alias("node")).join(placed, "node", "left")


def _shared(classes: DataFrame) -> DataFrame:
    """(key, at, node, n, sig) of the buckets with two classes or more. Keys alone are shuffled; signatures join what is left."""
    rows = classes.select("node", F.inline(table_keys(F.col("subs"))))
    held = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi")
    return held.join(classes.select("node", F.col("n_shingles").alias("n"), "sig"), "node").select("key", "at", "node", "n", "sig")


def _open_buckets(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold several components, with label and top, the label that most of a bucket has."""
    if labels is None:
        return shared.withColumns({"label": F.col("node"), "top": F.lit(None).cast("long")})
    named = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = named.groupBy("key", "label").agg(F.count("*").alias("n_label"))
    tops = counts.groupBy("key").agg(F.max(F.struct("n_label", "label")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    return named.join(tops.select("key", F.col("most.label").alias("top")), "key")


def _centre_pairs(open_: DataFrame, step: int) -> DataFrame:
    """(a, b): each class outside the top component of its bucket with the bucket's centre, another one in each step."""
    of = F.struct("n", "sig").alias("of")
    rows = open_.select("key", "label", "top", F.col("node").alias("a"), of)
    order = F.struct((F.col("node") if step == 0 else F.xxhash64("node", F.lit(step))).alias("rank"), "node", "label", "n", "sig")
    centres = open_.where("top is null or label = top").groupBy("key").agg(F.min(order).alias("c"))
    centres = centres.select("key", F.col("c.node").alias("b"), F.struct("c.n", "c.sig").alias("centre"), F.col("c.label").alias("centre_label"))
    return rows.join(centres, "key").where((F.col("label") != F.col("centre_label")) & _likely("of", "centre")).select("a", "b")


def _leftovers(shared: DataFrame, labels: DataFrame, source: DataFrame, classes: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """(a, b): links between the components that open buckets still hold.

    Pairs with a common table key have a common sub-key of the first collection, of which a class has COLLECTION only. The classes left
    over there are dealt to parts, each with all classes of the group as a stream: first by sketches, then what those leave by full sets.
    """
    nodes = scratch.table(_open_buckets(shared, labels).select("node").distinct(), "open-nodes")
    named = classes.select("node", F.col("one.doc_id").alias("rid"), F.col("one.tid").alias("rtid"))
    fine_roles = scratch.table(named.join(small_enough(nodes), "node"), "fine-roles")
    fine = scratch.table(_texts(source, fine_roles, ["node"], _fine(width), "node long, fine binary"), "fine").dropDuplicates(["node"])
    sub_key = F.posexplode(F.slice("subs", 1, COLLECTION)).alias("at", "sub")
    groups = classes.join(fine, "node").select("node", F.col("n_shingles").alias("n"), "sig", "subs", "fine", sub_key).withColumn("key", F.xxhash64("at", "sub")).drop("sub")
    rows = _open_buckets(groups, labels).withColumn("minor", F.col("label") != F.col("top"))
    rows = scratch.table(rows.select("key", "at", "node", "n", "sig", F.slice("subs", COLLECTION + 1, COLLECTION).alias("second"), "fine", "label", "minor"), "rest")
    number = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    minor = F.count(F.when(F.col("minor"), 1))
    parts = rows.groupBy("key").agg(number(minor, SKETCH_ROWS).alias("parts"), number(minor, PART_ROWS).alias("places"), number(F.count("*"), STREAM_ROWS).alias("streams"), minor.alias("minors"))
    parts = scratch.table(parts.where("minors > 0").drop("minors"), "parts")
    dealt = rows.join(small_enough(parts), "key").withColumn("place", F.pmod(F.xxhash64("node", F.lit(1)), F.col("places")).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    own = dealt.where("minor").withColumns({"part": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), "role": F.lit(0)}).withColumn("stream", each("streams"))
    every = dealt.withColumns({"part": each("parts"), "role": F.lit(1), "stream": of("streams", 2)})
    both = own.unionByName(every).drop("parts", "places", "streams").repartition("key", "part", "stream").sortWithinPartitions("key", "part", "stream", "role")
    left = scratch.table(both.mapInArrow(_sketched(percent), "key long, part int, role int, node long").distinct(), "left")
    streams = scratch.table(left.groupBy("key", "part").agg(number(F.sum("role"), STREAM_ROWS).alias("streams")).where("streams > 1"), "left-streams")
    placed = left.join(small_enough(streams), ["key", "part"], "left").withColumn("streams", F.coalesce("streams", F.lit(1)))
    placed = placed.where("role = 0").withColumn("stream", each("streams")).unionByName(placed.where("role = 1").withColumn("stream", of("streams", 3))).drop("streams")
    roles = scratch.table(placed.join(named, "node"), "left-roles")
    whole = _texts(source, roles, ["key", "part", "stream", "role", "node"]).join(rows, ["key", "node"])
    return whole.repartition("key", "part", "stream").sortWithinPartitions("key", "part", "stream", "role").mapInArrow(_cross(width, percent), "a long, b long")


def _fine(width: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fine_sketch(shingle_set(t.as_py(), width)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "fine"])

    return run


_ROW = ("key", "part", "stream", "role", "at", "node", "n", "label", "minor")


def _rows(batch: pa.RecordBatch, extra: tuple[str, ...] = ()) -> Iterator[tuple[tuple, dict]]:
    """(key, part, stream) and the values of each row of a batch."""
    if not batch.num_rows:
        return
    columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*_ROW, *extra)}
    columns |= {c: batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("sig", "second")}
    columns["fine"] = np.frombuffer(b"".join(batch.column("fine").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    for k in range(batch.num_rows):
        yield (columns["key"][k], columns["part"][k], columns["stream"][k]), {c: v[k] for c, v in columns.items()}


def _sketched(percent: int):
    """Rows come sorted by (key, part, stream, role). Gives the places (key, part, role, node) in which full sets have to be compared: the place of
    a class held that has a pair left, with this class in role 0 and the other in role 1. A class held is told once, however many pairs it
    has: what a batch gives is bounded by the classes held and the places of its rows, also in a group where everything is alike."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None
        for batch in batches:
            out: list[tuple] = []
            for here, row in _rows(batch, ("place",)):
                if here != at:
                    at, part = here, Part(percent)
                if row["role"] == 0:
                    part.hold(row)
                elif found := part.pairs(row):
                    place = part.own["place"]
                    out += [(here[0], int(place[k]), 0, int(part.own["node"][k])) for k in part.untold(found)]
                    out += [(here[0], p, 1, int(row["node"])) for p in np.unique(place[found]).tolist()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["key", "part", "role", "node"])

    return run


def _cross(width: int, percent: int):
    """Rows come sorted by (key, part, stream, role): a part's own classes are held with their sets, the classes that they may be linked with pass by."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None
        for batch in batches:
            texts, links = batch.column("text"), []
            for k, (here, row) in enumerate(_rows(batch)):
                if here != at:
                    at, part = here, Part(percent)
                read = lambda k=k, texts=texts: shingle_set(texts[k].as_py(), width)
                if row["role"] == 0:
                    part.hold(row, read())
                else:
                    links += part.links(row, read)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


class Part:
    """Classes left over in a group. A pair is compared at the first sub-key it shares, and only if nothing has joined its components yet."""

    def __init__(self, percent: int):
        self.percent, self.rows, self.sets, self.joined = percent, [], [], {}
        self._own: dict | None = None
        self._told: set[int] = set()

    @property
    def own(self) -> dict:
        if self._own is None:
            self._own = {c: np.array([r[c] for r in self.rows]) for c in (self.rows[0] if self.rows else ())}
        return self._own

    def hold(self, row: dict, shingles: np.ndarray | None = None) -> None:
        self.rows.append(row)
        self.sets.append(shingles)
        self._own = None

    def untold(self, found: list[int]) -> list[int]:
        """Those of the classes held that were not asked for here before."""
        new = [k for k in found if k not in self._told]
        self._told.update(new)
        return new

    def root(self, label: int) -> int:
        while label in self.joined:
            label = self.joined[label]
        return label

    def pairs(self, row: dict) -> list[int]:
        """The classes held that may be linked with this one, by size and sketches."""
        if not self.rows:
            return []
        own = self.own
        likely = (own["label"] != row["label"]) & (np.minimum(own["n"], row["n"]) * 100 >= np.maximum(own["n"], row["n"]) * self.percent)
        if row["minor"]:
            likely &= own["node"] < row["node"]
        at = np.flatnonzero(likely)
        same = own["sig"][at] == row["sig"]
        first = same[:, : COLLECTION * ROWS].reshape(len(at), COLLECTION, ROWS).all(axis=2).argmax(axis=1)
        at = at[(same.sum(axis=1) >= MIN_AGREE) & (first == row["at"]) & (own["second"][at] == row["second"]).any(axis=1)]
        for size, agree in ((FINE_FIRST, FIRST_AGREE), (FINE, FINE_AGREE)):
            if len(at):
                at = at[np.count_nonzero(own["fine"][at, :size] == row["fine"][:size], axis=1) >= agree]
        return at.tolist()

    def links(self, row: dict, shingles) -> list[tuple[int, int]]:
        found, mine = [], None
        for k in self.pairs(row):
            a, b = self.root(int(self.own["label"][k])), self.root(int(row["label"]))
            if a != b:
                mine = shingles() if mine is None else mine
                both = np.intersect1d(self.sets[k], mine, assume_unique=True).size
                if 100 * both >= self.percent * (len(self.sets[k]) + len(mine) - both):
                    self.joined[a] = b
                    found.append((int(self.own["node"][k]), int(row["node"])))
        return found


def keep_one(docs: DataFrame, columns: tuple[str, ...], width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The given columns of one document of each component: the smallest doc_id (null last), and of equal ids the text with the smallest
    hash. Documents without words all stay; of rows with the same doc_id and text one stays."""
    docs = pick(docs, *dict.fromkeys((*columns, "doc_id", "text")))
    placed = _placed(docs, width, percent, ROUNDS)
    group = F.coalesce(F.col("label").cast("string"), F.concat_ws(":", F.lit("alone"), "doc_id", "tid"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tid")).alias("first")
    chosen = placed.groupBy(group.alias("group")).agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.tid").alias("__tid"))
    named = docs.withColumns({"__of": F.col("doc_id").cast("long"), "__text": F.xxhash64("text")})
    kept = named.join(chosen, F.col("__of").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__tid")), "left_semi")
    return kept.dropDuplicates(["__of", "__text"]).select(*columns)


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
