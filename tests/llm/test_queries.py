"""The registered queries: against DuckDB, the library or brute force on the smallest tables, and the pipeline stage by stage."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessella.llm import pieces, token_counts
from tessella.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import brute_bm25, brute_groups, brute_lines, brute_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    return "nan" if isinstance(value, float) and math.isnan(value) else float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(ORACLE_SQL[name]).fetchall()
    names = [d[0] for d in duck.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want), key=repr)


def documents(duck):
    rows = duck.execute("select doc_id, text, source from documents order by doc_id").fetchall()
    assert [r[0] for r in rows] == list(range(len(rows)))
    return [r[1] for r in rows], [r[2] for r in rows]


def test_near_duplicates(spark, duck):
    texts, _ = documents(duck)
    sets, want = brute_groups(texts)
    got = {r.doc_id: r for r in QUERIES["op3_minhash_dedup"](spark, SF).collect()}
    assert [(got[i].component_id, got[i].n_shingles, got[i].kept) for i in range(len(texts))] == [(want[i], len(sets[i]), want[i] == i) for i in range(len(texts))]


def test_search(spark, duck):
    texts, _ = documents(duck)
    got = {}
    for r in QUERIES["op2_search"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    assert sorted(got) == list(range(0, len(texts), 50))
    for q, rows in got.items():
        want = brute_bm25(texts, texts[q], 10)
        assert [rows[i + 1][0] for i in range(len(rows))] == [d for d, _ in want]


def test_pieces_and_tokens(spark, duck):
    import hashlib

    import sentencepiece
    from tokenizers import Tokenizer

    texts, _ = documents(duck)
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.public_path(pieces.MODEL))
    ids = sp.encode(texts)
    got = {r.doc_id: (r.n_pieces, r.ids_sha256) for r in QUERIES["op4_pieces"](spark, SF).collect()}
    assert got == {i: (len(x), hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest()) for i, x in enumerate(ids)}
    tokenizer = Tokenizer.from_file(token_counts.public_path(token_counts.TOKENIZER))
    got = {r.doc_id: r.n_tokens for r in QUERIES["op10_token_counts"](spark, SF).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def accuracy(spark, name, column, value, label, sf="/root/testdata/sf0.01"):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r[value], labels[r.doc_id]) for r in QUERIES[name](spark, sf).collect() if r.doc_id in labels and (column is None or r[column])]
    return rows


def test_toxicity_held_out(spark):
    rows = accuracy(spark, "op8_toxicity", "held_out", "predicted", "toxic", "/root/testdata/sf0.1")
    wrong = Counter((p, y) for p, y in rows)
    assert wrong[1, 0] <= 0.02 * len(rows) and wrong[1, 1] >= 0.6 * (wrong[1, 1] + wrong[0, 1])


def test_quality_keeps_good_and_drops_most_junk(spark):
    rows = accuracy(spark, "op9_quality", None, "kept", "quality")
    assert np.mean([k for k, y in rows if y == 1]) > 0.95 and np.mean([not k for k, y in rows if y == 0]) > 0.75


def test_pipeline_stages(spark, duck):
    """Each stage on what the one before kept, held against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "minhash_dedup", "mixing", "pieces"]
    cols = list(corpus_pipeline.COLUMNS)
    clean = stages["toxicity"](spark, docs, SF).cache()
    assert clean.columns == cols
    scores = {r.doc_id: r.score for r in QUERIES["op8_toxicity"](spark, SF).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5}
    lines = stages["line_dedup"](spark, clean, SF).cache()
    before = sorted((r.doc_id, r.text) for r in clean.collect())
    want = brute_lines([t for _, t in before], 10)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in lines.collect()) == [(i, t, len(t)) for (i, _), (_, _, t) in zip(before, want, strict=True)]
    near = stages["minhash_dedup"](spark, lines, SF).cache()
    before = sorted((r.doc_id, r.text) for r in lines.collect())
    _, groups = brute_groups([t for _, t in before])
    assert sorted(r.doc_id for r in near.collect()) == [before[i][0] for i, g in enumerate(groups) if g == i]
    mixed = stages["mixing"](spark, near, SF).cache()
    sizes, taken = Counter(), Counter()
    for r in near.collect():
        sizes[r.source] += len(r.text.split())
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    assert mixed.columns == cols
    targets = brute_targets(dict(sizes))
    assert sum(taken.values()) == pytest.approx(sum(targets.values()), rel=0.25)
    last = stages["pieces"](spark, mixed, SF)
    assert last.where("not round_trip").isEmpty() and last.count() == mixed.count()


def test_pipeline_runs_whole(spark):
    assert entry.queries()["pipeline"](spark, SF).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and len([q for q in QUERIES if q.startswith("op")]) == 13
