"""The text operators on small hand-made tables: edge cases, and brute force where SQL has no form."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bloom, common, components, exact_dedup, line_dedup, minhash_dedup, mixing, pieces, quality, search, token_counts, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = {i: i + 32 for i in range(65, 91)}
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def table(spark, texts, start=0, **columns):
    """Documents with these texts, and columns whose names clash in case with theirs."""
    rows = [(start + i, t, columns.get("lang", "en"), f"s{i % 3}" if t is None or len(t) % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS `Text`", "1 AS `DOC_ID`", "true AS label", "0 AS node", "1 AS key", "2 AS score", "3 AS size")


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


ODD = [None, "", " ", "\n\n", "one", "A\tb\x0bc", "é È", "a" * 50_000, "word " * 20_000, "😀 \U0010ffff", "x\x00y", "same text here", "same text here"]


# -- mixing --------------------------------------------------------------------------------------------------------------
def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
        if not free:
            return target


def test_mixing_targets_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, prose(rng, int(rng.integers(1, 40))), "en", f"s{int(rng.integers(0, 7))}" if i % 3 else "hot", 0) for i in range(600)] + [(900 + i, t, "en", None, 0) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_plan(df).toPandas()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(sizes))
    for r in got.itertuples():
        s = None if r.source is None or r.source != r.source else r.source
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and r.taken <= 3 * r.size
    for s, g in got.groupby("source"):
        assert g.taken.sum() == pytest.approx(want[s], rel=0.15, abs=60)
    again = mixing.mix_plan(df.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    copies = mixing.mix(df, ("doc_id", "text")).groupBy("doc_id").count().toPandas()
    assert dict(zip(copies.doc_id, copies["count"], strict=True)) == {r.doc_id: r.copies for r in got.itertuples() if r.copies}


# -- search --------------------------------------------------------------------------------------------------------------
def brute_bm25(texts, query, k):
    docs = [Counter((t or "").encode().lower().split()) for t in texts]
    n, average = len(docs), sum(sum(d.values()) for d in docs) / len(docs)
    df = Counter(w for d in docs for w in d)
    out = []
    for i, d in enumerate(docs):
        dl = sum(d.values())
        s = sum(q * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * dl / average)) for w, q in Counter((query or "").encode().lower().split()).items() if w in d)
        if s > 0:
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def test_search_is_exact_over_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "FIRST_BLOCKS", 1)
    rng = np.random.default_rng(1)
    texts = ODD + [prose(rng, int(rng.integers(1, 30))) + (f" rare{i % 50}" if i % 4 == 0 else "") for i in range(900)]
    df = table(spark, texts)
    asked = {20: texts[20], 100: texts[100], 1: "", 7: texts[7], 5000: "rare3 rare7"}
    queries = spark.createDataFrame([(k, v) for k, v in asked.items()] * 2, "query_id long, text string")
    rows = search.search(df, queries, 5, documents=200, query_bytes=400).collect()
    got = defaultdict(dict)
    for r in rows:
        got[r.query_id][r["rank"]] = (r.doc_id, r.score)
    for k, text in asked.items():
        want = brute_bm25(texts, text, 5)
        found = [got[k][i] for i in sorted(got[k])]
        assert [d for d, _ in found] == [d for d, _ in want]
        assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=2e-6)


def shard_of(texts, average=None):
    docs = [(i, *search.terms(t)) for i, t in enumerate(texts)]
    row = search.invert(docs)
    return search.Shard.of({c: row.column(c)[0] for c in row.schema.names}, average or sum(d[3] for d in docs) / len(docs))


def asked(texts, queries):
    """Terms and weights of the queries over these texts."""
    df = Counter(h for t in texts for h in search.terms(t)[0].tolist())
    found = [search.terms(q)[:2] for q in queries]
    return [(h, tf * np.array([math.log(1 + (len(texts) - df[x] + 0.5) / (df[x] + 0.5)) for x in h.tolist()])) for h, tf in found]


def test_search_skips_blocks():
    """A selective query set: most blocks are never scored, and nothing is lost."""
    rng = np.random.default_rng(2)
    texts = [prose(rng, int(rng.integers(5, 40))) + (f" rare{i % 97} odd{i}" if i % 5 == 0 else "") for i in range(6000)]
    queries = [f"rare{k} alpha beta gamma" for k in range(20)] + [texts[i] for i in range(0, 100, 5)]
    best = search.Best(asked(texts, queries), 10)
    average = sum(len(t.split()) for t in texts) / len(texts)
    for at in range(0, 6000, 2000):
        best.visit(shard_of([""] * at + texts[at : at + 2000], average))
    assert 0 < best.scored < 0.5 * best.blocks
    for q, ids, scores in zip(queries, best.ids, best.scores, strict=True):
        want = brute_bm25(texts, q, 10)
        assert ids.tolist() == [d for d, _ in want] and scores == pytest.approx([s for _, s in want], abs=2e-6)


def test_search_completes_few_scores(monkeypatch):
    """Whole texts as queries: scores are completed for a part of the blocks only once a threshold is known."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(20_000)])
    texts = [" ".join(words[np.minimum(rng.zipf(1.3, int(rng.integers(50, 300))), 20_000) - 1]) for i in range(3000)]
    texts += [" ".join(w for w in texts[i].split() if rng.random() < 0.9) for i in range(0, 200, 10) for _ in range(12)]
    queries = [texts[i] for i in range(0, 200, 10)]
    best = search.Best(asked(texts, queries), 10)
    average = sum(len(t.split()) for t in texts) / len(texts)
    best.visit(shard_of([""] * 3000 + texts[3000:], average))
    best.blocks = best.scored = 0
    best.visit(shard_of(texts[:3000], average))
    assert best.scored < 0.5 * best.blocks
    for q, ids in zip(queries, best.ids, strict=True):
        assert ids.tolist() == [d for d, _ in brute_bm25(texts, q, 10)]


def test_search_passes_by_what_is_unlike():
    """Whole texts of four vocabularies, mixed: like texts are neighbours, so most blocks of a shard are passed by before its product."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{'abcd'[i % 4]}{w}" for w in rng.zipf(1.5, int(rng.integers(40, 60))) % 400) for i in range(3200)]
    queries = [texts[i] for i in range(0, 400, 17)]
    best = search.Best(asked(texts, queries), 10)
    average = sum(len(t.split()) for t in texts) / len(texts)
    best.visit(shard_of([""] * 1600 + texts[1600:], average))
    best.blocks = best.scored = 0
    best.visit(shard_of(texts[:1600], average))
    assert best.scored < 0.3 * best.blocks
    for q, ids, scores in zip(queries, best.ids, best.scores, strict=True):
        want = brute_bm25(texts, q, 10)
        assert ids.tolist() == [d for d, _ in want] and scores == pytest.approx([s for _, s in want], abs=2e-6)


def test_search_with_long_lists_only():
    texts = ["a b" if i % 10 == 0 else "c d" for i in range(6400)]
    shard = shard_of(texts)
    for word, want in (("a", [0, 10, 20, 30, 40]), ("never", [])):
        best = search.Best([(search.terms(word)[0], np.array([2.0]))], 5)
        best.visit(shard)
        assert best.ids[0].tolist() == want and len(set(best.scores[0].tolist())) <= 1


def test_search_takes_like_queries_together(monkeypatch):
    """Mixed queries of four vocabularies: a batch asks for the lists of about one, not of all four."""
    monkeypatch.setattr(search, "BATCH", 50)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"{'abcd'[i % 4]}{w}" for w in rng.integers(0, 100, 40)) for i in range(1600)]
    best, lists, find = search.Best(asked(texts, texts[:200]), 10), [], search.Shard.find

    def counted(shard, number, at, *others):
        lists.append(len(set(at.tolist())))
        return find(shard, number, at, *others)

    monkeypatch.setattr(search.Shard, "find", counted)
    best.visit(shard_of(texts))
    assert len(lists) == 4 and sum(lists) < 600
    for q in range(0, 200, 9):
        assert best.ids[q].tolist() == [d for d, _ in brute_bm25(texts, texts[q], 10)]


def test_search_of_many_copies():
    """Thousands of copies tie: they are scored once, and the smallest ids win in each shard and over all. So do documents that tie without being copies."""
    texts = [f"w{i} x y z" if i % 7 == 0 else "x y z" for i in range(6000)]
    best = search.Best(asked(texts, ["x y z", "w7 x"]), 10)
    for at in (3000, 0):
        shard = shard_of([""] * at + texts[at : at + 3000], 4.0)
        best.visit(shard)
        assert len(set(shard.same.tolist())) == len(set(texts[at : at + 3000])) + (at > 0)
    assert best.ids[0].tolist() == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11] and best.ids[1].tolist() == [7, 1, 2, 3, 4, 5, 6, 8, 9, 10]
    texts = [f"w{i} x" for i in range(3000)]
    best = search.Best(asked(texts, ["x"]), 10)
    best.visit(shard_of(texts))
    assert best.ids[0].tolist() == list(range(10)) and best.scores[0] == pytest.approx([s for _, s in brute_bm25(texts, "x", 10)], abs=2e-6)


def test_search_tells_scores_apart_that_float32_does_not():
    """Scores of common and rare words whose differences show in the sixth digit only, and ties, in several shards."""
    average = 2e6
    texts = [f"a a b c{i % 3} " + "z " * (i % 40) + f"rare{i % 9}" for i in range(900)]
    best = search.Best([(h, w * 40) for h, w in asked(texts, ["a b b c1 c2 rare4 rare5", "a", "rare7 rare8"])], 10)
    for at in range(0, 900, 300):
        best.visit(shard_of([""] * at + texts[at : at + 300], average))
    for q, words in enumerate(("a b b c1 c2 rare4 rare5", "a", "rare7 rare8")):
        (terms, weights), want = asked(texts, [words])[0], []
        for i, t in enumerate(texts):
            found = dict(zip(*(x.tolist() for x in search.terms(t)[:2]), strict=True))
            score = sum(w * 40 * found[h] * 2.2 / (found[h] + 1.2 * (0.25 + 0.75 * len(t.split()) / average)) for h, w in zip(terms.tolist(), weights, strict=True) if h in found)
            want += [(-round(score, 6), i)] if score > 0 else []
        assert best.ids[q].tolist() == [i for _, i in sorted(want)[:10]]


def test_search_of_odd_tables(spark):
    """Empty tables, null ids, rows repeated in full, frequencies beyond 16 bits."""
    empty = table(spark, []).limit(0)
    none = spark.createDataFrame([], "query_id long, text string")
    assert search.search(empty, none).count() == 0 and search.search(table(spark, ODD), none).count() == 0
    rows = [(None, "x y", "en", "s", 1)] * 2 + [(1, "x y", "en", "s", 1), (2, "x " * 70_000, "en", "s", 1), (3, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = search.search(docs, spark.createDataFrame([(None, "x y"), (7, "x")], "query_id long, text string"), 9).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got if r.query_id is None] == [(None, 1), (None, None), (None, None), (None, 2)]
    want = brute_bm25([r[1] for r in rows], "x", 9)
    assert [r.score for r in got if r.query_id == 7] == pytest.approx([s for _, s in want], abs=2e-6)


# -- near duplicates -----------------------------------------------------------------------------------------------------
def shingles(text):
    w = WORD.findall((text or "").translate(ASCII))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


def near_copies(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = base.split()
        for at in rng.choice(len(w), changes, replace=False):
            w[at] = f"new{int(rng.integers(0, 10_000))}"
        out.append(" ".join(w))
    return out


def test_templates_below_the_threshold_cost_no_texts(spark, monkeypatch):
    """A family of templates, 0.6 alike: what the left-over pass writes grows with the family, not with its square, and no text is fetched."""
    common_part = " ".join(f"t{i}" for i in range(64))
    written = {}

    def table_of(self, df, name, mode="errorifexists", write=common.Scratch.table):
        out = write(self, df, name, mode)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(common.Scratch, "table", table_of)
    sizes = []
    for n in (500, 2000):
        written.clear()
        texts = [f"{common_part} " + " ".join(f"u{i}x{k}" for k in range(20)) for i in range(n)]
        texts += [texts[7] + " more", texts[9] + " end"]
        got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(table(spark, texts)).collect()}
        assert [got[i] for i in range(n + 2)] == [*range(n), 7, 9]
        sizes.append({k: v for k, v in written.items() if not k.startswith("star")})
    assert sizes[1]["left"] <= 40 and sizes[1]["open-nodes"] >= 1900  # the pairs that are links, if the rounds left them
    assert all(sizes[1][k] <= 4.6 * v + 200 for k, v in sizes[0].items())


def test_left_over_links_are_found(spark, monkeypatch):
    """Without any round the left-over pass alone finds all links, over several parts."""
    for name, value in (("SKETCH_ROWS", 7), ("PART_ROWS", 3)):
        monkeypatch.setattr(minhash_dedup, name, value)
    rng = np.random.default_rng(14)
    base = [prose(rng, 60).split() for _ in range(4)]
    texts = []
    for i in range(60):
        words = list(base[i % 4])
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(0, 60))] = f"z{i}"
        texts.append(" ".join(words))
    sets, want = brute_groups(texts)
    monkeypatch.setattr(minhash_dedup, "_centre_pairs", lambda open_, step, keep=minhash_dedup._centre_pairs: keep(open_, step).where("a % 5 = 0"))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(table(spark, texts), rounds=1).collect()}
    assert [got[i] for i in range(60)] == [want[i] for i in range(60)]


def test_near_duplicates_of_rows_repeated_in_full(spark):
    rows = [(None, "one two three four five six")] * 30 + [(4, "one two three four five six seven")] * 5 + [(4, "other words altogether in this one here")] * 2
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id, r.n_shingles) for r in got) == {(None, None, 2): 30, (4, 4, 3): 7}


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SITE_ROWS", 7)
    monkeypatch.setattr(minhash_dedup, "PART_ROWS", 5)
    rng = np.random.default_rng(3)
    texts = list(ODD)
    for changes in (1, 2, 3, 4, 5):
        base = prose(rng, 120)
        texts += [base, base.upper(), base.replace(" ", "\n")] + near_copies(rng, base, 25, changes)
    texts += [prose(rng, 60) for _ in range(20)]
    sets, want = brute_groups(texts)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    wrong = [i for i in range(len(texts)) if got[i].component_id != want[i]]
    assert not wrong
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_cross_pairs_alone_find_all_links(spark):
    rng = np.random.default_rng(5)
    texts = near_copies(rng, prose(rng, 150), 40, 4)
    _, want = brute_groups(texts)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(table(spark, texts), rounds=1).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_keep_one_and_empty(spark):
    df = table(spark, ["a b c d e f", "a b c d e f", None, ""])
    assert sorted(r.doc_id for r in minhash_dedup.keep_one(df, ("doc_id", "text")).collect()) == [0, 2, 3]
    assert minhash_dedup.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    scratch = common.Scratch(spark)
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(50, 40), (60, 50), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(chain, scratch).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 50: 40, 60: 40}


# -- pieces --------------------------------------------------------------------------------------------------------------
def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = token_counts.public_path(pieces.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(6)
    texts = [*ODD, "  two  spaces   three ", "▁meta ▁▁x", "naïve café 12,345.67 http://a.b/c?d=e", "日本語のテキスト", *("".join(map(chr, rng.integers(32, 0x2FF, 80))) for _ in range(200)), *(prose(rng, 50) for _ in range(20))]
    rows = pieces.encode(table(spark, texts), path, ("doc_id", "text")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.piece_ids == sp.encode(texts[r.doc_id] or "")
        assert r.decoded == sp.decode(r.piece_ids)
    one = next(r for r in pieces.digests(table(spark, texts), path).collect() if r.doc_id == 4)
    ids = np.array(sp.encode("one"), "<i4")
    assert one.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and one.round_trip


def model_of(pieces_, kind, byte_fallback):
    """A model file in memory with the given (piece, score, type) vocabulary. Nothing is trained: only the file format is written out."""
    import struct

    def number(n):
        out = b""
        while n >= 128:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda i, data: number(i << 3 | 2) + number(len(data)) + data
    flag = lambda i, n: number(i << 3) + number(n)
    out = b"".join(field(1, field(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + flag(3, t)) for p, s, t in pieces_)
    return out + field(2, flag(3, kind) + flag(35, int(byte_fallback))) + field(3, field(1, b"identity") + flag(3, 1) + flag(4, 0) + flag(5, 1))


NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("spaces", [True, False])
def test_unigram_is_the_library(byte_fallback, spaces):
    """Random vocabularies, also with letters that are no pieces by themselves, and without the meta symbol as a piece."""
    import sentencepiece

    rng = np.random.default_rng(21)
    letters = "abcdefgh"
    for round_ in range(6):
        vocabulary = {"".join(rng.choice(list(letters), int(rng.integers(2, 6)))) for _ in range(60)}
        vocabulary |= {pieces.SPACE + w for w in sorted(vocabulary)[:25]} | set(letters[: 8 - round_]) | ({pieces.SPACE} if spaces else set())
        special = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL)] + [(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256) if byte_fallback]
        proto = model_of(special + [(w, float(-rng.uniform(1, 9)), NORMAL) for w in sorted(vocabulary)], 1, byte_fallback)
        library, own = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.Pieces(kind="unigram", proto=proto)
        texts = [" ".join("".join(rng.choice(list(letters + "zé☃"), int(rng.integers(1, 12)))) for _ in range(int(rng.integers(1, 9)))) for _ in range(60)]
        for text in [*texts, "", " ", "ΩΨ", "ab ☃☃☃ ☃ cd", "  ab   z", "☃", None]:
            assert own.encode(text).tolist() == library.encode(text or ""), text


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_bpe_unknowns_are_the_library(byte_fallback):
    import sentencepiece

    words = [pieces.SPACE, "a", "b", "c", "ab", "abc", pieces.SPACE + "a", pieces.SPACE + "ab", "bc", "ca"]
    special = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL)] + [(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256) if byte_fallback]
    proto = model_of(special + [(w, float(-i), NORMAL) for i, w in enumerate(sorted(words, key=len, reverse=True))], 2, byte_fallback)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.Pieces(proto=proto)
    rng = np.random.default_rng(22)
    for text in ["", "abcabc", "a☃☃b ☃", "ΩΨ", *("".join(rng.choice(list("abc z☃"), 20)) for _ in range(200))]:
        assert own.encode(text).tolist() == library.encode(text), text


# -- lines ---------------------------------------------------------------------------------------------------------------
def brute_lines(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("few", [(1 << 28, 10**9), (64, 10**9), (64, -1)])
def test_lines(spark, few):
    rng = np.random.default_rng(7)
    texts = ODD + ["\n".join(("  Common LINE\t", "common line", f"own {i}", *rng.choice(["red", "green", "", "Blue "], 3), "\x0c")) for i in range(40)] + ["red", "red\nred"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(table(spark, texts), filter_bits=few[0], few_key_bytes=few[1]).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, 10)


@pytest.mark.parametrize("few_key_bytes", [10**9, -1])
def test_lines_that_end_in_other_separators(spark, few_key_bytes):
    ends = ("\x85", " \x85", "  ", "  ", "\x85 ", "  ")
    texts = ["\n".join((*(f" abc {e}" for e in ends), f"own {i}\t")) for i in range(12)] + [f"abc{e}" for e in ends]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(table(spark, texts), few_key_bytes=few_key_bytes).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, 10)
    assert got[0] == (7, 6, "own 0\t") and got[12] == (1, 0, "abc\x85")


@pytest.mark.parametrize("shards", [1, 32, 211])
@pytest.mark.parametrize("places", [1, 64, bloom.REPORTED])
def test_every_repeated_hash_is_reported(shards, places):
    hashes = np.unique(np.random.default_rng(5).integers(0, 2**63, 100_000).astype(np.uint64) * np.uint64(shards))
    hashes[0] = 0
    seen = bloom.TwiceSeen(places)
    rounds = [[seen.repeats(part) for part in np.array_split(hashes, 100)] for _ in range(3)]
    assert set(np.concatenate(sum(rounds, [])).tolist()) == set(hashes.tolist())
    assert sum(map(len, rounds[0])) < 0.01 * len(hashes)  # reports of hashes seen once


def test_suspect_filter_holds_all_and_little_else(spark):
    hashes = bloom.mix64(np.arange(1, 5001, dtype=np.uint64))
    df = spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)[:2500]], "hash long")
    words = line_dedup.suspect_filter(df)
    held = line_dedup._held(words, hashes)
    assert held[:2500].all() and held[2500:].mean() < 0.02 and len(words) * 64 <= 32 * 2500
    assert line_dedup._held(line_dedup.suspect_filter(df, 256), hashes).all()  # a full filter lets all pass
    assert not line_dedup._held(line_dedup.suspect_filter(df.limit(0)), hashes).any()


def test_common_lines_are_no_load():
    """A line of every document sends two hashes a batch to its shard, not one a document."""
    batch = line_dedup.pa.RecordBatch.from_pydict({"text": [f"same\nown {i}" for i in range(1000)]})
    (out,) = line_dedup._packed(1, 1)(iter([batch]))
    assert len(out.column("hashes")[0].as_py()) == 8 * 1002


def test_lines_of_repeated_rows_and_null_ids(spark):
    rows = [(None, "x\ny")] * 4 + [(1, "x\nz")] * 6 + [(2, "y"), (None, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == {(None, "y", 2, 1): 4, (1, "z", 2, 1): 6, (2, "y", 1, 0): 1, (None, "", 1, 0): 1}


def test_first_line_can_stay(spark):
    rows = line_dedup.dedup_lines(table(spark, ["a\nx", "x\nb", "x"]), min_docs=3, keep_first=True).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["a\nx", "b", ""]
    assert line_dedup.dedup_lines(table(spark, []), min_docs=3).count() == 0


# -- exact duplicates ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda n: F.when(F.length(n) < 10, F.lit("clash")).otherwise(exact_dedup.sha256(n))])
def test_exact(spark, digest):
    texts = ODD + ["a b", "ab", "a  b ", "abc", "b c", "bc"]
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[strip(t)].append(i)
    keep = {i: min(g, key=lambda j: (-len(texts[j] or ""), j)) for g in groups.values() for i in g}
    got = {r.doc_id: r for r in exact_dedup.assign_keepers(table(spark, texts), digest).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {i: (keep[i], len(groups[strip(t)]), keep[i] == i) for i, t in enumerate(texts)}
    assert exact_dedup.assign_keepers(table(spark, []), digest).count() == 0


def test_exact_of_repeated_rows_and_null_ids(spark, monkeypatch):
    """One row of each group is kept, also of rows repeated in full and of rows without an id; groups go over several sites."""
    monkeypatch.setattr(exact_dedup, "SITE_ROWS", 3)
    rows = [(None, "p q"), (None, "pq"), (4, "pq"), (4, "pq"), (4, "pq"), (5, " pq")] + [(100 + i, "hot text" if i % 4 else "hottext") for i in range(40)] + [(None, "z")] * 3 + [(9, None), (8, "")]
    got = exact_dedup.assign_keepers(spark.createDataFrame(rows, "doc_id long, text string"), batches=3).toPandas()
    assert len(got) == len(rows) and got.groupby("digest").kept.sum().eq(1).all()
    kept = got[got.kept].set_index("group_size").sort_index()
    want = {2: 8, 3: None, 6: 5, 40: 101}
    assert {n: None if math.isnan(r.doc_id) else int(r.doc_id) for n, r in kept.iterrows()} == want
    ids = lambda c: [None if math.isnan(x) else int(x) for x in got[c]]
    assert all(k == want[n] for k, n in zip(ids("keep_id"), got.group_size, strict=True))


def test_index_in_batches_is_the_index_in_one(spark):
    """Runs, levels and lookups: many batches give the groups that one gives, and every digest seen before is a hit."""
    rng = np.random.default_rng(3)
    rows = [(f"d{int(rng.integers(0, 300))}" if i % 3 else "hot", int(rng.integers(1, 9)), int(rng.integers(0, 50)), i) for i in range(900)]
    df = spark.createDataFrame(rows, "digest string, len long, id long, row long")
    groups = lambda index, hits: {tuple(r) for r in index.lookup(common.Scratch(spark).table(hits.distinct(), "asked")).collect()}
    one = exact_dedup.MergeIndex(common.Scratch(spark))
    want = groups(one, one.insert(df))
    seen = defaultdict(list)
    for digest, size, id_, row in rows:
        seen[digest].append((-size, id_, row))
    assert want == {(d, -min(x)[0], min(x)[1], min(x)[2], len(x)) for d, x in seen.items() if len(x) > 1}
    many, hits, before = exact_dedup.MergeIndex(common.Scratch(spark), tier=2), None, Counter()
    for b in range(7):
        part = [r for r in rows if r[3] * 7 // 900 == b]
        found = many.insert(spark.createDataFrame(part, df.schema))
        now = Counter(r[0] for r in part)
        assert {r.digest for r in found.collect()} == {d for d, n in now.items() if n > 1 or before[d]}
        before += now
        hits = found if hits is None else hits.union(found)
    assert [len(level) for level in many.levels] == [1, 1, 1] and groups(many, hits) == want
    assert many.insert(df.limit(0)).isEmpty()


def test_filters_are_probed():
    """What an earlier filter holds is reported, and next to nothing else."""
    hashes = bloom.mix64(np.arange(1, 20_001, dtype=np.uint64))
    row = lambda kind, packed: exact_dedup.pa.RecordBatch.from_pydict({"shard": [0], "kind": [kind], "bytes": [packed]})
    ((first, none),) = (b.column("bytes").to_pylist() for b in exact_dedup._probe(iter([row(1, hashes[:10_000].tobytes())])))
    assert none == b""
    ((_, found),) = (b.column("bytes").to_pylist() for b in exact_dedup._probe(iter([row(0, first), row(1, hashes[9_000:].tobytes())])))
    found = set(np.frombuffer(found, np.uint64).tolist())
    assert set(hashes[9_000:10_000].tolist()) <= found and len(found) < 1_100


# -- urls ----------------------------------------------------------------------------------------------------------------
def brute_rank(edges, seeds, by):
    """Personalised PageRank by hand: by="src" divides a host's mass among its links, by="dst" weighs a link among those into its end."""
    total = Counter()
    for (a, b), n in edges.items():
        total[a if by == "src" else b] += n
    base = {h: 0.15 * v for h, v in seeds.items()}
    mass = dict(base)
    for _ in range(url_filters.STEPS):
        after = defaultdict(float, base)
        for (a, b), n in edges.items():
            if a in mass:
                after[b] += 0.85 * mass[a] * n / total[a if by == "src" else b]
        mass = dict(after)
    return mass


def test_propagation_is_page_rank(spark):
    """Cycles, hosts without links, a hot host that everything links to, and several links between the same hosts."""
    rng = np.random.default_rng(31)
    edges = Counter()
    for _ in range(300):
        a, b = (f"h{int(x)}" for x in rng.integers(0, 60, 2))
        if a != b and a not in ("h3", "h4"):  # two hosts without links of their own
            edges[a, b] += int(rng.integers(1, 4))
    edges |= {(f"h{i}", "hot"): 1 for i in range(60)} | {("hot", "h1"): 7, ("h1", "h2"): 1, ("h2", "h1"): 1}
    seeds = {"h1": 1.0, "hot": 1.0, "h3": 1.0, "far": 1.0}
    frame = spark.createDataFrame([(a, b, float(n)) for (a, b), n in edges.items()], "src string, dst string, links double")
    for by in ("src", "dst"):
        got = {r.host: r.mass for r in url_filters.propagate(spark.createDataFrame(list(seeds.items()), "host string, seed double"), frame, common.Scratch(spark), "x", by).collect()}
        want = brute_rank(edges, seeds, by)
        assert set(want) == set(got) and all(got[h] == pytest.approx(m, abs=1e-5) for h, m in want.items())


def test_verdicts_of_linked_pages_match_sql(spark):
    """Pages with links between hosts: the SQL, the propagation by hand and the verdicts agree; hosts that are only linked to are seeds."""
    import duckdb
    import pandas as pd

    rng = np.random.default_rng(32)
    names = [f"h{i}.com" for i in range(25)] + ["a.net", "b.net", "c.org", "d.org", "example.com", "example.net"]
    rows = []
    for i in range(150):
        links = "".join(f'<a href="{rng.choice(["http:", "https:", ""])}//{rng.choice([*names, "gone.net", "good.org"])}{rng.choice(["", "/fr/x", "/de/y", "/en/", "/z?q#f"])}">' for _ in range(int(rng.integers(0, 4))))
        rows.append((i, None if i % 37 == 0 else f"https://{rng.choice(names)}{rng.choice(['', '/fr/x', '/de/y', '/en/', '/z'])}", links if i % 11 else None))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    want = {r[0]: r[1:] for r in con.execute(url_filters.ORACLE).fetchall()}
    assert got == want and {v for _, _, rule, v in got.values() if rule is None} == {"allow", "block"}


def test_url_rules_and_trust(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)
    rows = [
        (0, "http://a.net/x", link("b.com")), (1, "http://example.net/en/a", ""), (2, "http://example.net/de", ""), (3, "https://EXAMPLE.com/de/q?x", ""), (4, "http://x.example.com/fr/", ""),
        (5, "http://w.org/fr/1", link("good.com")), (6, "nothing", None), (7, None, None), (8, "http://spam.com/", link("a.net", "a.net", "bad.net")), (9, "http://good.com#f", link("w.org")), (10, "x://H?q=/en/", ""), (11, "http://notnet/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS HOST", "1 AS verdict")
    got = {r.page_id: r for r in url_filters.judge(df).collect()}
    assert [got[i].rule for i in range(12)] == ["net/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None, None, None]
    assert (got[3].host, got[3].path) == ("example.com", "/de/q") and (got[10].host, got[10].path) == ("h", "") and (got[6].host, got[7].path) == ("", "")
    assert [got[i].verdict for i in (0, 1, 2, 3, 5)] == ["block", "allow", "block", "block", "allow"]
    assert got[8].verdict == "block" and got[8].distrust > got[8].trust  # it links to blocked hosts
    assert got[9].verdict == "allow" and got[9].trust > 0 and got[6].verdict == "allow"
    assert url_filters.judge(df.where("false")).count() == 0


def test_linkers_of_a_blocked_host_however_many(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)
    rows = [(i, f"http://s{i}.com/", link("bad.net")) for i in range(300)]
    rows += [(300, "http://bad.net/", ""), (301, "http://few.com/", link("bad.net", *(f"c{i}.com" for i in range(19)))), (302, "http://w.org/fr/", link("s0.com", *(f"t{i}.com" for i in range(49))))]
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i].verdict for i in range(300)} == {"block"} and got[301].verdict == "allow"
    assert got[0].trust == pytest.approx(0.15 * 0.85 / 50) and got[0].distrust < url_filters.THRESHOLD
    assert got[1].exposure == pytest.approx(0.15 * 0.85) and got[301].exposure == pytest.approx(0.15 * 0.85 / 20)


def test_hosts_that_are_only_linked_to_are_seeds(spark):
    link = lambda *urls: "".join(f'<a href="{u}">y</a>' for u in urls)
    rows = [
        (0, "http://a.com/", link("http://bad.net/x")), (1, "http://b.com/", link("//worse.net")), (2, "http://c.com/", link("http://X.Example.com/de/1")),
        (3, "http://d.com/", link(*["http://y.example.com/de/1", "http://y.example.com/"] * 2)), (4, "http://e.com/", link("http://mixed.example.com/de/1")),
        (5, "http://mixed.example.com/", ""), (6, "http://f.com/", link("http://w.org/fr/", "http://w.org/")), (7, "http://g.com/", link("https://two.net/?q", "http://w.org/fr/2")),
    ]
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # d's target is blocked in half of its links only; e's target has a page of its own, which no rule blocks
    assert [got[i].verdict for i in range(8)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "block"]
    assert got[0].exposure == pytest.approx(0.15 * 0.85) and got[7].exposure == pytest.approx(0.15 * 0.85 / 2) and not got[3].distrust


# -- toxicity ------------------------------------------------------------------------------------------------------------
def test_toxicity(spark):
    rng = np.random.default_rng(9)
    texts, marks = [], []
    for i in range(400):
        parts = [prose(rng, 8) for _ in range(int(rng.integers(1, 6)))]
        bad = i % 5 == 0
        if bad:
            parts[int(rng.integers(0, len(parts)))] += f" grumble{rng.choice(['ly', 'd', 'r'])} now"
        texts.append(". ".join(parts))
        marks.append(int(bad))
    df = table(spark, texts)
    labels = spark.createDataFrame([(i, m, None if i == 3 else m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    rows = {r.doc_id: r.score for r in toxicity.score(table(spark, texts + ODD), model, ("doc_id", "text")).collect()}
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(rows) == len(texts) + len(ODD) and all(0 <= s <= 1 for s in rows.values())
    assert np.mean([(rows[i] >= 0.5) == bool(marks[i]) for i in out]) > 0.95
    found = toxicity.offending(df, model).collect()
    assert found and all("grumble" in r.sentence for r in found)
    held = {r.doc_id: r.h for r in common.pick(df, "doc_id").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())
    plain = toxicity.fit(df, labels.where("toxic = 0"))
    assert toxicity.Scorer(plain).document("anything") < 1e-6 and toxicity.Scorer(model).document(None) < 0.5


# -- quality -------------------------------------------------------------------------------------------------------------
def brute_kneser_ney(texts, order=4):
    """Probability of (context, character) from the formulas, in dictionaries."""
    grams = [{} for _ in range(order + 1)]
    for t in texts:
        padded = "\n" * (order - 1) + t
        for i in range(order - 1, len(padded)):
            g = padded[i - order + 1 : i + 1]
            grams[order][g] = grams[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
    tables = []
    for k in range(1, order + 1):
        n = [sum(v == j for v in grams[k].values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [0.0] + [min(j, max(0.1, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else j / 2 for j in (1, 2, 3)]
        total, left = defaultdict(float), defaultdict(float)
        for g, v in grams[k].items():
            total[g[:-1]] += v
            left[g[:-1]] += d[min(v, 3)]
        tables.append((d, total, left))

    def prob(context, c):
        p = 1.0 / (len(grams[1]) + 1)
        for k in range(1, order + 1):
            h = context[len(context) - k + 1 :] if k > 1 else ""
            d, total, left = tables[k - 1]
            if h in total:
                v = grams[k].get(h + c, 0)
                p = (max(v - d[min(v, 3)], 0) if v else 0) / total[h] + left[h] / total[h] * p
        return p

    return prob


def test_kneser_ney_matches_the_formulas(spark):
    rng = np.random.default_rng(10)
    train, other = [prose(rng, 40) for _ in range(12)], ["alpha zzz beta", "Ω unknown", "", None, prose(rng, 30)]
    rows = [(i, t, "en", i < len(train)) for i, t in enumerate(train + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, train boolean")
    scratch = common.Scratch(spark)
    counts = scratch.table(quality.count_grams(df.select("lang", "train", "text")), "counts")
    logs = quality.Model(counts.where("n > 0"), scratch).logs(counts.select("lang", "gram"))
    got = {r.doc_id: r.log2p for r in quality.perplexity(df.select("doc_id", "lang", "text"), logs, scratch, block_bytes=500).collect()}
    prob = brute_kneser_ney(train)
    assert sum(prob("\nal", c) for c in set("".join(train))) + prob("\nal", "☃") == pytest.approx(1)
    for i, t, _, _ in rows:
        padded = "\n\n\n" + (t or "")
        want = np.mean([math.log2(prob(padded[k - 3 : k], padded[k])) for k in range(3, len(padded))]) if t else None
        assert got[i] == (pytest.approx(want) if t else None)


def test_quality_keeps_clean_text(spark):
    rng = np.random.default_rng(11)
    good = [prose(rng, int(rng.integers(20, 80))) for _ in range(200)]
    junk = ["".join(map(chr, rng.integers(33, 126, 300))) for _ in range(20)]
    texts = good + junk + ODD
    rows = [(i, t, None if i % 17 == 0 else "xx" if i == 5 else "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1 if i < 200 else 0, 0) for i in range(220) if i != 5], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    assert len(got) == len(texts)
    assert np.mean([got[i].kept for i in range(200)]) > 0.95
    assert not any(got[i].kept for i in range(200, 220) if i % 17)
    assert got[5].kept and got[5].log2_perplexity is None
    empty = [i for i in range(220, len(texts)) if not texts[i]]
    assert all(not got[i].kept and got[i].log2_perplexity is None for i in empty)
    assert quality.judge(df.where("false"), labels.where("false")).count() == 0


def test_quality_limits_by_brute_force(spark):
    """Quantiles, limits and what is kept, from the perplexities; labels repeat, some lack a value, and no language or id is left out."""
    rng = np.random.default_rng(12)
    texts = [prose(rng, int(rng.integers(1, 60))) if i % 9 else "".join(map(chr, rng.integers(33, 1000, 40))) for i in range(400)] + ODD
    rows = [(None if i == 7 else i, t, (None, "en", "xx")[i % 3], "s", 0) for i, t in enumerate(texts)] + [(50, texts[50], "xx", "s", 0)] * 2
    marks = [(i, int(i % 9 != 0), 0) for i in range(0, 400, 2)] + [(20, 0, 0), (22, None, 0), (None, 1, 0), (9999, 1, 1)]
    got = quality.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), 0.1, 0.8, 0.05).collect()
    assert sorted(((r.doc_id, r.lang) for r in got), key=repr) == sorted(((r[0], r[2]) for r in rows), key=repr)
    worst = {}
    for i, q, _ in marks:
        if i is not None and q is not None:
            worst[i] = min(q, worst.get(i, 1))
    out = {i for i, q in worst.items() if q == 1 and zlib.crc32(str(i).encode()) % 5 == 0}
    size = defaultdict(list)
    for r in rows:
        size[r[0]].append(len(r[1] or ""))
    stray = {i: 3.0 / math.sqrt(max(1, max(n))) for i, n in size.items()}
    limits = {}
    for lang in (None, "en", "xx"):
        bits = [(r.log2_perplexity, stray[r.doc_id]) for r in got if r.lang == lang and r.doc_id in out and r.log2_perplexity is not None]
        for name, sign, q, margin in (("least", 1, 0.1, -0.05), ("most", -1, 0.8, 0.05)):
            steps = sorted(math.ceil((b + sign * s) / quality.STEP) for b, s in bits)
            limits[lang, name] = next(x for i, x in enumerate(steps) if (sum(y <= x for y in steps)) >= q * len(steps)) * quality.STEP + margin
    for r in got:
        assert (r.least, r.most) == (pytest.approx(limits[r.lang, "least"]), pytest.approx(limits[r.lang, "most"]))
        b, chars = r.log2_perplexity, max(size[r.doc_id])
        assert r.kept == (chars > 0 and limits[r.lang, "least"] - stray[r.doc_id] <= b <= limits[r.lang, "most"] + stray[r.doc_id])


def test_quality_tells_emoji_apart():
    points = [chr(x) for x in range(0x1F300, 0x1FB00)] + ["\ufffd", "a", "\uffff"]
    assert len({int(quality.grams(c)[-1]) for c in points}) == len(points)


# -- token counts --------------------------------------------------------------------------------------------------------
def test_token_counts_and_cache(spark, tmp_path):
    from tokenizers import Tokenizer

    path = token_counts.public_path(token_counts.TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = [*ODD, "<|endoftext|> inside", "x <|endoftext|>"]
    cache = token_counts.CountCache(spark, f"{tmp_path}/cache")
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(table(spark, texts), path, cache).collect()}
        assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    stored = cache.counts(token_counts.file_digest(path))
    assert stored.count() == stored.distinct().count() == len({t or "" for t in texts})  # the second run found all of them
    model = token_counts.public_path(pieces.MODEL)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, texts), model, cache).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(table(spark, []), path, cache).count() == 0


def test_token_cache_filled_twice(spark, tmp_path):
    """Two jobs that appended the same digests: no document is returned twice; null ids and repeated rows are counted each."""
    path = token_counts.public_path(token_counts.TOKENIZER)
    docs = spark.createDataFrame([(None, "one two")] * 2 + [(1, "one two"), (2, "three"), (2, "three")], "doc_id long, text string")
    cache = token_counts.CountCache(spark, f"{tmp_path}/cache")
    want = sorted(map(repr, token_counts.count_tokens(docs, path, cache).collect()))
    version = token_counts.file_digest(path)
    for n in (1, 2):
        cache.append(version, common.Scratch(spark).table(cache.stored(version), "again"))
        assert cache.stored(version).count() == 2 ** (n + 1)
        assert sorted(map(repr, token_counts.count_tokens(docs, path, cache).collect())) == want and len(want) == 5
