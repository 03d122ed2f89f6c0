"""Operator 12: a Merkle manifest of a table, with a proof for every row.

1. Every row becomes a leaf. Leaves are written (no texts), dealt by ranges of (tree, doc_id, leaf) and numbered: each range counts its
   rows of a tree, and what the ranges before it hold of the tree is added. No window goes over a whole tree.
2. Blocks of ARITY ** height leaves, cut where the tree cuts them, are shuffled to a task each, reduced to their root, and written as
   one row with their leaves. The height follows the number of rows, so that TOP_BLOCKS blocks at most (twice that with the last, short
   block of each tree) are left above.
3. The driver builds the upper tree of each tree of more than one block, and with it the suffix path of each block. The subroots of all
   trees are leaves of one more tree: the driver builds it too, or, if there are more trees than TOP_BLOCKS, it goes through the same
   steps as a table.
4. The suffix paths are broadcast (their number is bounded by TOP_BLOCKS; beyond, joined). Executors rebuild each block's lower tree, and
   finish proof and fold of every row.

A digest is SHA-256, and digests go into the next one as lowercase hex text. Proofs hold the siblings of a node, left to right.

Edge cases: a null field is `-` in its leaf, an empty one `0:`; rows of one doc_id are in the order of their leaves, null doc_ids
first; rows repeated in full are equal leaves with their own proofs; a null tree key is a tree of its own, which comes first; an empty table
gives an empty result; columns with other names are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, pick, small_enough

ARITY = 2
#: Levels of a block at least; blocks that are left for the driver at most.
HEIGHT, TOP_BLOCKS = 12, 1 << 15
#: Rows whose crc32 this divides are tampered with in the registered query.
TAMPER_EVERY = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Node = bytes  # 32 bytes
Path = list[tuple[str, str]]  # per level the siblings to the left and to the right, as hex text

_NODES = "tree string, key long, leaf binary, changed binary"
_BLOCK = "tree string, block long, nodes int, alone boolean, root binary, keys binary, no_key binary, leaves binary, changed binary, has_changed binary"
_PATH = "array<struct<before: string, after: string>>"


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def leaf(fields: list[Column]) -> Column:
    """The digest (hex) of fields that are `-` if null, else byte count, colon and value."""
    shown = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(shown(c.cast("string")) for c in fields)).cast("binary"), 256)


# -- trees in memory -----------------------------------------------------------------------------------------------------
def reduced(nodes: list[Node], levels: int | None = None, arity: int = ARITY) -> list[list[Node]]:
    """The levels of a tree from its nodes up: so many levels, or until one node remains."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = [n.hex() for n in out[-1]]
        out.append([digest("".join(below[i : i + arity])) for i in range(0, len(below), arity)])
    return out


def path(levels: list[list[Node]], at: int, arity: int = ARITY) -> Path:
    """The siblings of a node at every level below the last."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % arity
        out.append(("".join(n.hex() for n in nodes[first:at]), "".join(n.hex() for n in nodes[at + 1 : first + arity])))
        at //= arity
    return out


def folded(node: Node, way: Path) -> Node:
    for before, after in way:
        node = digest(before + node.hex() + after)
    return node


# -- numbering and blocks ------------------------------------------------------------------------------------------------
def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tree: the number of the task, and of each row among the task's rows of its tree."""
    part, tree, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        at = []
        for t in batch.column("tree").to_pylist():
            if t != tree:
                tree, n = t, 0
            at.append(n)
            n += 1
        columns = [batch.column(c) for c in ("tree", "key", "leaf", "changed")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], ["tree", "key", "leaf", "changed", "part", "at"])


def numbered(nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """nodes (a written table) with position, from 0 in each tree, and the tree's total."""
    rows = nodes.repartitionByRange(F.col("tree").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf").sortWithinPartitions(F.col("tree").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf")
    rows = scratch.table(rows.mapInArrow(_numbered, _NODES + ", part int, at long"), f"{name}-numbered")
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("n"))
    every = W.partitionBy("tree")  # one row a range
    ahead = F.sum("n").over(every.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("tree", F.col("part").alias("of"), F.coalesce(ahead, F.lit(0)).alias("start"), F.sum("n").over(every).alias("total"))
    starts = small_enough(scratch.table(starts.withColumnRenamed("tree", "named"), f"{name}-starts"))
    both = rows.join(starts, (F.col("part") == F.col("of")) & F.col("tree").eqNullSafe(F.col("named")))
    return both.select("tree", "key", "leaf", "changed", (F.col("at") + F.col("start")).alias("position"), "total")


def _packer(height: int, arity: int):
    """Rows come sorted by (tree, block, position): a row for each block."""

    def packed(tree, block: int, rows: list[tuple], alone: bool) -> pa.RecordBatch:
        keys, leaves, changed = zip(*rows, strict=True)
        root = reduced(list(leaves), None if alone else height, arity)[-1][0]
        values = [tree, block, len(rows), alone, root, pa.array([k or 0 for k in keys], pa.int64()).buffers()[1].to_pybytes()[: 8 * len(rows)], bytes(k is None for k in keys), b"".join(leaves), b"".join(c for c in changed if c), bytes(c is not None for c in changed)]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, alone = None, [], False
        for batch in batches:
            for tree, block, total, *row in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "total", "key", "leaf", "changed")), strict=True):
                if (tree, block) != at:
                    if rows:
                        yield packed(*at, rows, alone)
                    at, rows, alone = (tree, block), [], total <= arity**height
                rows.append(row)
        if rows:
            yield packed(*at, rows, alone)

    return run


def blocks_of(nodes: DataFrame, scratch: Scratch, name: str, height: int, arity: int) -> DataFrame:
    """The written blocks of a written table of nodes; alone says that a block is a whole tree."""
    rows = numbered(nodes, scratch, name).withColumn("block", F.floor(F.col("position") / arity**height).cast("long"))
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "position").select("tree", "block", "total", "key", "leaf", "changed")
    return scratch.table(dealt.mapInArrow(_packer(height, arity), _BLOCK), f"{name}-blocks")


# -- the upper tree ------------------------------------------------------------------------------------------------------
def _tops(blocks: DataFrame, arity: int) -> tuple[dict, dict]:
    """Of trees of more than one block: suffix path of each (tree, block), and the subroots. At most 2 TOP_BLOCKS roots reach the driver."""
    roots = defaultdict(list)
    for r in blocks.where("not alone").select("tree", "block", "root").orderBy("tree", "block").collect():
        roots[r.tree].append(bytes(r.root))
    paths, subroots = {}, {}
    for tree, nodes in roots.items():
        levels = reduced(nodes, None, arity)
        subroots[tree] = levels[-1][0]
        paths |= {(tree, b): path(levels, b, arity) for b in range(len(nodes))}
    return paths, subroots


def _unpacked(row: dict) -> tuple[list, list[Node], list[Node | None]]:
    n = row["nodes"]
    missing = row["no_key"]
    keys = [None if missing[i] else int.from_bytes(row["keys"][8 * i : 8 * i + 8], "little", signed=True) for i in range(n)]
    leaves = [row["leaves"][32 * i : 32 * i + 32] for i in range(n)]
    changed, k = [], 0
    for has in row["has_changed"]:
        changed.append(row["changed"][32 * k : 32 * k + 32] if has else None)
        k += has
    return keys, leaves, changed


def _prover(height: int, arity: int, row_of, schema: pa.Schema):
    """What row_of(tree, key, leaf, changed, path) gives for each row of the blocks, which come with the path above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                keys, leaves, changed = _unpacked(row)
                levels = reduced(leaves, None if row["alone"] else height, arity)
                above = [(p["before"], p["after"]) for p in row["path"]]
                out = [row_of(row["tree"], k, n, c, path(levels, j, arity) + above) for j, (k, n, c) in enumerate(zip(keys, leaves, changed, strict=True))]
                for begin in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_pylist(out[begin : begin + 10_000], schema=schema)

    return run


def _with_paths(spark, blocks: DataFrame, tops: dict, upper: DataFrame) -> DataFrame:
    """blocks with the path from the block's root to the root of all: that of its tree's top, then that of the tree (upper)."""
    rows = [(t, b, [{"before": x, "after": y} for x, y in p]) for (t, b), p in tops.items()]
    suffix = spark.createDataFrame(rows, f"named string, number long, suffix {_PATH}")
    joined = blocks.join(F.broadcast(suffix), F.col("tree").eqNullSafe(F.col("named")) & (F.col("block") == F.col("number")), "left").drop("named", "number")  # 2 TOP_BLOCKS rows
    joined = joined.join(upper.withColumnRenamed("tree", "named"), F.col("tree").eqNullSafe(F.col("named"))).drop("named")
    return joined.withColumn("path", F.concat(F.coalesce("suffix", F.array().cast(_PATH)), F.col("upper"))).drop("suffix", "upper")


def _upper(spark, subroots: DataFrame, scratch: Scratch, height: int, arity: int, most: int) -> tuple[DataFrame, bytes]:
    """(tree, upper): the path of each subroot in the tree of subroots, and that tree's root."""
    n = subroots.count()
    if n <= most:
        rows = sorted(((r.tree, bytes(r.root)) for r in subroots.collect()), key=lambda r: (r[0] is not None, (r[0] or "").encode()))  # at most TOP_BLOCKS
        levels = reduced([root for _, root in rows], None, arity)
        named = [(tree, [{"before": x, "after": y} for x, y in path(levels, i, arity)]) for i, (tree, _) in enumerate(rows)]
        return F.broadcast(spark.createDataFrame(named, f"tree string, upper {_PATH}")), levels[-1][0]
    # ranks of the trees as keys of one tree
    ranked = numbered(scratch.table(subroots.select(F.lit(None).cast("string").alias("tree"), F.lit(0).cast("long").alias("key"), F.encode(F.coalesce(F.concat(F.lit("1"), "tree"), F.lit("0")), "utf-8").alias("leaf"), F.col("root").alias("changed")), "subroots"), scratch, "ranks")
    ranked = scratch.table(ranked, "ranked")
    nodes = scratch.table(ranked.select("tree", F.col("position").alias("key"), F.col("changed").alias("leaf"), F.lit(None).cast("binary").alias("changed")), "upper-nodes")
    blocks = blocks_of(nodes, scratch, "upper", height, arity)
    tops, roots = _tops(blocks, arity)
    root = next(iter(roots.values())) if roots else bytes(blocks.first().root)
    none = spark.createDataFrame([(None, [])], f"tree string, upper {_PATH}")
    schema = pa.schema([("rank", pa.int64()), ("upper", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))])
    row_of = lambda tree, key, leaf, changed, way: {"rank": key, "upper": [{"before": x, "after": y} for x, y in way]}
    ways = _with_paths(spark, blocks, tops, F.broadcast(none)).mapInArrow(_prover(height, arity, row_of, schema), f"rank long, upper {_PATH}")
    named = ranked.select(F.col("position").alias("rank"), F.decode("leaf", "utf-8").alias("name"))
    tree = F.when(F.col("name") != "0", F.substring("name", 2, 2**31 - 1))
    return scratch.table(named.join(ways, "rank").select(tree.alias("tree"), "upper"), "upper-paths"), root


def manifest(leaves: DataFrame, height: int | None = None, arity: int = ARITY, most: int = TOP_BLOCKS) -> DataFrame:
    """(doc_id, tree, leaf, subroot, root, proof_sha256, folded_root, verified) for (tree, key, leaf, changed) rows, digests as binary.

    changed is null, or what the leaf is folded as in its place: a row that was tampered with has a root that differs.
    """
    spark, scratch = leaves.sparkSession, Scratch(leaves.sparkSession)
    nodes = scratch.table(leaves, "leaves")
    total = nodes.count()
    if not total:
        return spark.createDataFrame([], "doc_id long, tree string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    if height is None:
        height = HEIGHT
        while total > most * arity**height:
            height += 1
    blocks = blocks_of(nodes, scratch, "leaves", height, arity)
    tops, found = _tops(blocks, arity)
    subroots = blocks.where("alone").select("tree", "root").unionByName(spark.createDataFrame(list(found.items()), "tree string, root binary"))
    subroots = scratch.table(subroots, "subroots-all")
    upper, root = _upper(spark, subroots, scratch, height, arity, most)
    root = root.hex()

    def row_of(tree, key, node, changed, way):
        again = folded(changed or node, way).hex()
        return {"doc_id": key, "tree": tree, "leaf": node.hex(), "root": root, "proof_sha256": digest("".join(x + y for x, y in way)).hex(), "folded_root": again, "verified": again == root}

    schema = pa.schema([("doc_id", pa.int64()), ("tree", pa.string()), *((c, pa.string()) for c in ("leaf", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
    rows = _with_paths(spark, blocks, tops, upper).mapInArrow(_prover(height, arity, row_of, schema), "doc_id long, tree string, leaf string, root string, proof_sha256 string, folded_root string, verified boolean")
    named = small_enough(subroots.select(F.col("tree").alias("named"), F.lower(F.hex("root")).alias("subroot")))
    out = rows.join(named, F.col("tree").eqNullSafe(F.col("named")))
    return out.select("doc_id", "tree", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def tampered(docs: DataFrame, every: int = TAMPER_EVERY) -> DataFrame:
    """(tree, key, leaf, changed): leaves of documents by lang; changed has 1 added to n_chars where every divides the id's crc32."""
    rows = pick(docs, *FIELDS)
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    plain = [F.col(c) for c in FIELDS]
    other = [more if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return rows.select(F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("key"), F.unhex(leaf(plain)).alias("leaf"), F.when(hit, F.unhex(leaf(other))).alias("changed"))


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(tampered(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("tree")


#: unsigned crc32 of ASCII digits, by bits: DuckDB has no crc32.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)))"
_FIELD = "coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD.format(x=n if c == "n_chars" else c) for c in FIELDS) + ")"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF('n_chars')} AS leaf, CASE WHEN xor({_CRC}, 4294967295::BIGINT) % {TAMPER_EVERY} = 0 THEN {_LEAF('(n_chars + 1)')} END AS changed FROM documents),
o AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT lang, 0 AS lev, pos, n, leaf AS h FROM o UNION ALL SELECT lang, lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, lev, pos // 2, n),
s AS (SELECT lang, lev AS top, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lev, pos, n, subroot AS h FROM s UNION ALL SELECT lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lev, pos // 2, n),
x AS (SELECT lang, lev, pos, h, false AS upper FROM t UNION ALL SELECT NULL, lev, pos, h, true FROM u),
w AS (SELECT o.*, s.subroot, s.top, s.pos AS spos, (SELECT arg_max(h, lev) FROM u) AS root, (SELECT max(lev) FROM u) AS utop FROM o JOIN s ON o.lang IS NOT DISTINCT FROM s.lang),
l AS (SELECT r, lang, i >= top AS upper, i, CASE WHEN i < top THEN i ELSE i - top END AS lev, CASE WHEN i < top THEN pos >> i ELSE spos >> (i - top) END AS at FROM (SELECT *, unnest(range(top + utop)) AS i FROM w)),
g AS (SELECT l.r, list({{'s': l.at % 2, 'h': coalesce(x.h, '')}} ORDER BY i) AS way FROM l LEFT JOIN x ON l.upper = x.upper AND (l.upper OR l.lang IS NOT DISTINCT FROM x.lang) AND l.lev = x.lev AND x.pos = xor(l.at, 1) GROUP BY l.r),
f AS (SELECT w.*, coalesce(way, []) AS way FROM w LEFT JOIN g USING (r))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda b: b.h), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM (SELECT *,
  list_reduce(list_prepend({{'s': 0::BIGINT, 'h': coalesce(changed, leaf)}}, way), lambda a, b: {{'s': 0::BIGINT, 'h': CASE WHEN b.s = 1 THEN sha256(b.h || a.h) ELSE sha256(a.h || b.h) END}}).h AS folded_root FROM f)
"""
