"""Clustering, manifest and repeated passages: edge cases, and brute force."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import clustering, manifest, minhash_dedup, suffix_dedup
from tests.llm.test_operators import DOCS, ODD, prose

SF = "/root/testdata/sf0.001"


# -- clustering ----------------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int"


def brute_clusters(rows, k, rounds, dims, scale=64, seed=1):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            kept.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "~"
    first = sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        of = [nearest(v)[0] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), x in zip(kept, of, strict=True) if x == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = {c: sum(d for _, x, d in found if x == c) for c in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, total[c], sum(total.values()), digest[c]) for i, c, d in found), key=repr)


def vector_rows(n=400, dims=6, spread=0.02):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (5, dims))
    rows = [(i, [float(x) for x in centres[i % 5] + rng.normal(0, spread, dims)]) for i in range(n)]
    rows += [(1000 + i, [0.25] * dims) for i in range(150)]  # equal vectors
    rows += [(2000, None), (2001, []), (2002, [1.0] * (dims - 1)), (2003, [1.0] * (dims - 1) + [None]), (2004, [float("nan")] * dims), (2005, [float("inf")] + [0.0] * (dims - 1)), (2006, [-1.5] * dims), (7, [0.5] * dims), (None, [0.1] * dims)]
    return rows


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters_are_those_of_brute_force(spark, spread):
    rows = vector_rows(spread=spread)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).repartition(3).selectExpr("*", "'x' AS `Embedding`", "0 AS cluster")
    got = sorted((tuple(r) for r in clustering.cluster(df, 8, 3, 6).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)
    assert got == brute_clusters(rows, 8, 3, 6)


def test_balls_go_as_a_whole():
    """Tight groups are given to a centroid without looking at their vectors; nothing is lost by it."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-20, 20, (3000, 8)) + 1000 * k for k in range(4)])
    tree, order = clustering.BallTree.build(points)
    assert sorted(order.tolist()) == list(range(len(points))) and (tree.points == points[order]).all()
    assert [int(t) for t in tree.total[0]] == points.sum(axis=0).tolist() and tree.end[0] == len(points)
    centroids = np.array([[1000 * k + 3] * 8 for k in (2, 0, 1, 3)])
    cluster, whole, asked = tree.assign(centroids)
    assert asked == 0 and len(whole) == 4
    for ball, c in whole:
        cluster[tree.begin[ball] : tree.end[ball]] = c
    assert (cluster == clustering.squared(tree.points, centroids).argmin(axis=1)).all()
    near = rng.integers(-40, 40, (9, 8))
    cluster, whole, asked = tree.assign(near)
    for ball, c in whole:
        cluster[tree.begin[ball] : tree.end[ball]] = c
    assert (cluster == clustering.squared(tree.points, near).argmin(axis=1)).all()


def test_distances_beyond_floating_point():
    a, b = np.array([[2**27 - 1, -(2**27)], [2**27 - 2, -(2**27)]]), np.array([[-(2**27), 2**27]])
    assert clustering.squared(a, b).tolist() == [[(2**28 - 1) ** 2 + 2**56], [(2**28 - 2) ** 2 + 2**56]]


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)], VECTORS)
    got = clustering.cluster(df, 16, 2, 2).collect()
    assert len(got) == 3 and {r.distance for r in got} == {0} and {r.cluster for r in got} == {0}  # ties go to the smaller number
    assert clustering.cluster(df.where("false")).count() == 0
    assert clustering.cluster(df, dims=3).count() == 0


# -- manifest ------------------------------------------------------------------------------------------------------------
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, la, s, n: H(*(shown(v) for v in (d, s, la, n, t)))
    trees = {}
    for d, t, la, s, n in rows:
        changed = leaf(d, t, la, s, n + 1) if d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0 else leaf(d, t, la, s, n)
        trees.setdefault(la, []).append((d is not None, d or 0, leaf(d, t, la, s, n), d, changed))

    def build(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def way(levels, i):
        out = []
        for nodes in levels[:-1]:
            j = i ^ 1
            out.append((nodes[j] if j < len(nodes) else "", i % 2))
            i //= 2
        return out

    built = {la: build([n[2] for n in sorted(nodes)]) for la, nodes in trees.items()}
    order = sorted(built, key=lambda la: (la is not None, (la or "").encode()))
    top = build([built[la][-1][0] for la in order])
    root, out = top[-1][0], []
    for place, la in enumerate(order):
        for i, (_, _, leaf_, d, changed) in enumerate(sorted(trees[la])):
            steps, node = way(built[la], i) + way(top, place), changed
            for s, right in steps:
                node = H(s, node) if right else H(node, s)
            out.append((d, leaf_, built[la][-1][0], root, H(*(s for s, _ in steps)), node, node == root))
    return sorted(out, key=repr)


FIELDS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("height", "most"), [(None, manifest.TOP_BLOCKS), (1, 3), (2, 1)])
def test_manifest_is_that_of_brute_force(spark, height, most):
    rng = np.random.default_rng(0)
    langs = [None, "", "en", "de", "é", "x" * 3]
    rows = [(i, t, langs[i % 6] if i % 5 else "en", f"s{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate([*ODD, *(prose(rng, 5) for _ in range(60))])]
    rows += [(None, "no id", "en", None, 3), (None, "no id", "en", None, 3), (None, None, None, None, None), (4, "again", "de", "s", 1), (4, "again", "de", "s", 1), (77, "alone", "zz", "s", 2**31 - 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(4).selectExpr("*", "'x' AS `Text`", "1 AS tree", "2 AS key")
    got = manifest.manifest(manifest.tampered(df), height, most=most)
    assert sorted((tuple(r[f] for f in FIELDS) for r in got.collect()), key=repr) == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(5, "only", "en", "s", 4)], DOCS)
    got = manifest.manifest(manifest.tampered(df)).collect()
    assert [tuple(r[f] for f in FIELDS) for r in got] == brute_manifest([(5, "only", "en", "s", 4)])
    assert got[0].leaf == got[0].root and got[0].proof_sha256 == H()
    assert manifest.manifest(manifest.tampered(df.where("false"))).count() == 0


def test_wider_trees(spark):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(30)]
    levels = manifest.reduced(leaves, None, 3)
    for i, n in enumerate(leaves):
        assert manifest.folded(n, manifest.path(levels, i, 3)) == levels[-1][0]
    rows = spark.createDataFrame([("t", i, bytearray(n), None) for i, n in enumerate(leaves)], "tree string, key long, leaf binary, changed binary")
    got = manifest.manifest(rows, 1, 3).collect()
    assert {r.root for r in got} == {levels[-1][0].hex()} and all(r.verified for r in got)


# -- repeated passages ---------------------------------------------------------------------------------------------------
def brute_passages(texts, threshold):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - threshold + 1):
            w = b[s : s + threshold]
            if w in seen:
                gone[s : s + threshold] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False])).tolist()
        out.append((len(b), edges[::2], edges[1::2], np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def passages(df, threshold):
    return {r.doc_id: (r.n_bytes, r.begins, r.ends, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, threshold).collect()}


@pytest.mark.parametrize("threshold", [1, 7, 40, 100, 300])
def test_passages_are_those_of_brute_force(spark, threshold, monkeypatch):
    rng = np.random.default_rng(threshold)
    shared = [prose(rng, n) for n in (12, 30, 60)]
    texts = [None, "", "é" * 60, "a" * 700, "ab" * 400, "word " * 300]
    for i in range(60):
        parts = [prose(rng, int(rng.integers(1, 40)))]
        if i % 2:
            parts.insert(int(rng.integers(0, 2)), shared[i % 3])
        if i % 5 == 0:
            parts.append(shared[0][5:])
        texts.append("\n".join(parts))
    texts += texts[10:14] * 3 + [texts[20][:-3] + "xyz", "é" + texts[21]]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(5).selectExpr("*", "'x' AS `Text`", "1 AS block", "2 AS key")
    want = brute_passages(texts, threshold)
    assert passages(df, threshold) == dict(enumerate(want))


def test_common_digits_and_pieces(spark, monkeypatch):
    """One line in every document, with a low bound on what is common; texts longer than a piece."""
    monkeypatch.setattr(suffix_dedup, "COMMON_ROWS", 2)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    rng = np.random.default_rng(1)
    line = prose(rng, 14)
    texts = [f"{prose(rng, 6)} {line} {prose(rng, 5)}" for _ in range(120)] + [prose(rng, 3000)]
    texts.append(texts[-1][3000:9000] + texts[3])
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(4)
    want = dict(enumerate(brute_passages(texts, 60)))
    assert passages(df, 60) == want
    blocks = df.select("doc_id", "text").mapInArrow(suffix_dedup._packer, suffix_dedup._BLOCKS)
    assert len(suffix_dedup._common(blocks.mapInArrow(suffix_dedup._first_pass(60, np.empty(0, np.uint64), True), suffix_dedup._ROWS))) > 0


def test_pieces_of_long_texts_overlap():
    """Anchors of a text that is hashed in pieces cover every window once."""
    data = np.frombuffer(prose(np.random.default_rng(3), 400).encode(), np.uint8)
    seen = []
    for begin in range(0, len(data) - 99, 500):
        piece = data[begin : begin + 599]
        anchor, low, high, _ = suffix_dedup.anchors(piece, np.array([0]), np.array([len(piece)]), 100, 64)
        for a, x, y in zip(anchor, low, high, strict=True):
            seen += range(begin + a - y, begin + a - x + 1)
    assert sorted(seen) == list(range(len(data) - 99))


def test_ids_that_are_null_or_repeat(spark):
    text = prose(np.random.default_rng(8), 60)
    df = spark.createDataFrame([(None, text, "en", "s", 0), (3, text, "en", "s", 0), (3, text, "en", "s", 0), (9, "short", None, None, None)], DOCS).coalesce(1)
    got = [(r.doc_id, r.n_bytes - len(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()]
    n = len(text.encode())
    assert sorted(got, key=repr) == sorted([(None, n), (3, 0), (3, n), (9, 0)], key=repr)
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, 0)


def test_registered_passages(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want = brute_passages([t for _, t in rows], 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op13_suffix_dedup(spark, SF).collect()}
    assert got == {d: (n, n - len(kept), len(begins), hashlib.sha256(kept).hexdigest()) for (d, _), (n, begins, _, kept) in zip(rows, want, strict=True)}


# -- mends of earlier operators ------------------------------------------------------------------------------------------
def test_line_filters_by_ranges(spark, monkeypatch):
    """Filters far too small for the suspects: several of them, the same result, and few lines that are shuffled for nothing."""
    from tessella.llm import line_dedup
    from tests.llm.test_operators import brute_lines

    rng = np.random.default_rng(4)
    common = [prose(rng, 6) for _ in range(400)]
    texts = ["\n".join([prose(rng, 7) for _ in range(40)] + [common[int(k)] for k in rng.integers(0, 400, 30)]) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(4)
    seen = []
    real = line_dedup._occurrences
    monkeypatch.setattr(line_dedup, "_occurrences", lambda held, least, part=0, parts=1: seen.append((part, parts, held)) or real(held, least, part, parts))
    want = [t for _, _, t in brute_lines(texts, 10)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, filter_bits=1 << 10).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(seen) == seen[0][1] > 2 and [s[0] for s in seen] == list(range(len(seen)))
    keys = {k for t in texts for k in line_dedup.line_keys(t, 1)}
    hashes = line_dedup._hashes(sorted(keys))
    part = line_dedup._part_of(hashes, len(seen))
    passed = sum(int((line_dedup._held(h.value, hashes) & (part == p)).sum()) for p, _, h in seen)
    assert passed < 400 + 0.25 * (len(keys) - 400)


def test_streams_of_a_group_of_one_component(spark, monkeypatch):
    """One class left over among many of one component: what passes by it is dealt to several tasks, and the links are those of brute force."""
    from tessella.llm import minhash_dedup
    from tests.llm.test_operators import brute_groups

    for name, value in (("STREAM_ROWS", 3), ("SKETCH_ROWS", 2), ("PART_ROWS", 2), ("ROUNDS", 0)):
        monkeypatch.setattr(minhash_dedup, name, value)
    rng = np.random.default_rng(6)
    words = prose(rng, 80).split()
    texts = []
    for i in range(40):
        own = list(words)
        for k in rng.integers(0, 80, 1 + i % 3):
            own[int(k)] = f"w{i}"
        texts.append(" ".join(own))
    texts += [prose(rng, 60) for _ in range(10)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    _, want = brute_groups(texts)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, rounds=1).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_toxicity_by_brute_force(spark):
    """Noisy-or of sentence scores, and the choice of words by their G-test, from the definitions."""
    import math

    from tessella.llm import toxicity

    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        toxic = i % 4 == 0
        rows.append((prose(rng, 8) + ". " + ("vile " if toxic and i % 8 else "") + prose(rng, 6) + ".", float(toxic)))
    sample = spark.createDataFrame(rows, "text string, label double").repartition(3)
    have = {}
    for t, y in rows:
        for w in toxicity.words(t):
            have.setdefault(w, [0, 0])[int(y)] += 1
    n = [sum(y == k for _, y in rows) for k in (0, 1)]

    def g(w):
        total = 0.0
        for k in (0, 1):
            for seen, share in ((have[w][k], sum(have[w]) / 200), (n[k] - have[w][k], 1 - sum(have[w]) / 200)):
                total += seen * math.log(seen / (share * n[k])) if seen else 0.0
        return 2 * total

    strong = sorted((w for w in have if sum(have[w]) >= toxicity.MIN_DOCS and g(w) >= toxicity.MIN_G), key=lambda w: (-round(g(w), 9), w))
    assert toxicity.choose_words(sample) == strong and "vile" in strong
    model = toxicity.Model({"vile": 4.0, "alpha": 0.5, "vi*": -1.0}, -3.0)
    scorer = toxicity.Scorer(model)
    text = "Vile alpha. Beta gamma! vile\n..."
    p = [1 / (1 + math.exp(-z)) for z in (-3 + 4 + 0.5, -3, -3 + 4)]
    assert scorer.document(text) == pytest.approx(1 - math.prod(1 - x for x in p))
    assert scorer.document(None) == scorer.document("") == pytest.approx(1 / (1 + math.exp(3)))


def test_sketches_of_a_group_in_which_all_are_alike_take_bounded_memory():
    """Each of n classes passes by n classes held and has a pair with every one; what is told is n held ones and n times the places."""
    n, places = 600, 3
    ids = np.tile(np.arange(n, dtype=np.int64), 2)
    width = {"sig": minhash_dedup.HASHES, "second": minhash_dedup.COLLECTION}
    columns = {
        "key": pa.array(np.full(2 * n, 7)),
        "part": pa.array(np.zeros(2 * n, np.int32)),
        "stream": pa.array(np.zeros(2 * n, np.int32)),
        "role": pa.array(np.repeat(np.array([0, 1], np.int32), n)),
        "at": pa.array(np.zeros(2 * n, np.int32)),
        "node": pa.array(ids),
        "n": pa.array(np.full(2 * n, 50)),
        "label": pa.array(ids),
        "minor": pa.array(np.concatenate([np.ones(n, bool), np.zeros(n, bool)])),
        "place": pa.array((ids % places).astype(np.int32)),
        "sig": pa.array([[1] * width["sig"]] * (2 * n), pa.list_(pa.int16())),
        "second": pa.array([[1] * width["second"]] * (2 * n), pa.list_(pa.int64())),
        "fine": pa.array([bytes(minhash_dedup.FINE)] * (2 * n), pa.binary()),
    }
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    tracemalloc.start()
    (told,) = minhash_dedup._sketched(75)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = [tuple(r.values()) for r in told.to_pylist()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(7, i % places, 0, i) for i in range(n)} | {(7, p, 1, i) for p in range(places) for i in range(n)}
    assert peak < 12e6, peak
