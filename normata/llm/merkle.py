"""Merkle manifest of a dataset: leaf digests, roots and every row's proof, by fractal traversal.

A leaf is the digest of a row's fields. The leaves of each language, in order of doc_id, form a tree in
which runs of eight become one node; the languages' roots form another above them. Trees are cut into
aligned blocks of 8**4 leaves. A first pass folds each block to its root, block roots are the leaves of
the next tier, and so on until a tier is a single block. A second pass goes down again: the authentication
paths of a tier's blocks are computed first, then each block walks through its leaves with a fractal
traversal, which emits one path after the other, and appends its own path to each.

The traversal keeps, for each level, the existing subtree (that in which the present leaf lies) and
the desired one (its right neighbour, grown a leaf with every leaf passed). So a block holds its leaves, two
subtrees for each level and one path, whatever the table's size. Rows are numbered without a
single task: ranges of (language, doc_id, leaf) are counted apart and shifted by the counts before them.

Defined results: a null field is ``-``; a null doc_id comes first within its language and counts as the empty
text for the choice of tampered rows; the null language comes first; empty texts are values like others;
rows of equal doc_id and language follow the order of their leaves, so repeated rows are neighbours, each
with its own proof; texts of any length are digested whole, once as they are and once tampered, and
no text leaves the task that reads it; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normata.llm.common import discard, materialise, remainder, small

#: Children of a node, and levels of a block's tree.
FAN, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A path: for each level from the leaf up, the siblings left and right of the node.
PATH = "array<struct<left: array<string>, right: array<string>>>"
MODULUS = 3


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf_of(fields: dict[str, Column]) -> Column:
    """Digest of a row's fields: ``-`` for null, else byte count, colon, value."""
    text = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def depth_of(size: int) -> int:
    """Levels above ``size`` leaves until one node remains."""
    depth = 0
    while size > 1:
        size, depth = -(-size // FAN), depth + 1
    return depth


class Stack:
    """Folds a stream of leaves to nodes of one height, with at most a run in memory for each level below it."""

    def __init__(self, height: int):
        self.pending: list[list[str]] = [[] for _ in range(height)]

    def add(self, node: str, last: bool) -> str | None:
        """Take a leaf; the node that it completes, if any. ``last`` closes the runs that are short."""
        for run in self.pending:
            run.append(node)
            if len(run) < FAN and not last:
                return None
            node = digest(run)
            run.clear()
        return node


class Run:
    """Up to eight neighbouring nodes of height ``level``, made from the leaves under them one step at a time."""

    def __init__(self, leaf: Callable[[int], str], level: int, start: int, size: int):
        self.leaf, self.at, self.end, self.size = leaf, start, min(size, start + FAN ** (level + 1)), size
        self.nodes: list[str] = []
        self.stack = Stack(level)

    def step(self) -> bool:
        """Read the next leaf; false when the run is whole."""
        if self.at >= self.end:
            return False
        node = self.stack.add(self.leaf(self.at), self.at + 1 == self.size)
        self.at += 1
        if node is not None:
            self.nodes.append(node)
        return True


class Traversal:
    """Successive authentication paths of the leaves of one block of ``depth`` levels.

    The tree is a stack of subtrees of one level. ``existing[l]`` is the subtree of height l in which the present
    leaf's ancestor lies, ``desired[l]`` its right neighbour. Every leaf that is passed lets each desired subtree
    read one leaf more, so it is whole when the walk leaves the existing one; then it takes its place.
    """

    def __init__(self, leaf: Callable[[int], str], size: int, depth: int):
        self.leaf, self.size, self.depth = leaf, size, depth
        self.existing = [Run(leaf, level, 0, size) for level in range(depth)]
        self.desired = [Run(leaf, level, FAN ** (level + 1), size) for level in range(depth)]
        for run in self.existing:
            while run.step():
                pass

    def paths(self) -> Iterator[list[tuple[list[str], list[str]]]]:
        for at in range(self.size):
            places = [at // FAN**level % FAN for level in range(self.depth)]
            yield [(run.nodes[:p], run.nodes[p + 1 :]) for run, p in zip(self.existing, places, strict=True)]
            for level, run in enumerate(self.desired):
                run.step()
                span = FAN ** (level + 1)
                if (at + 1) % span == 0:
                    self.existing[level], self.desired[level] = run, Run(self.leaf, level, at + 1 + span, self.size)


def block_depth(tree_size: int, levels: int) -> int:
    """Levels of each block's tree: ``levels`` if the tree has several blocks."""
    return min(depth_of(tree_size), levels)


def fold(node: str, path: list[tuple[list[str], list[str]]]) -> str:
    """The root that a node and its path lead to."""
    for left, right in path:
        node = digest([*left, node, *right])
    return node


def proof_digest(path: list[tuple[list[str], list[str]]]) -> str:
    return digest([node for left, right in path for node in (*left, *right)])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``, their place in their ``tree``, and ``size``, their tree's; stored.

    Rows are dealt into sorted ranges and numbered as they are written; what a range holds of each tree
    is a row of a small table, whose running sums are joined back.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = materialise(ranged.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)), name)
    held = kept.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    all_of = Window.partitionBy("tree")
    before = F.coalesce(F.sum("__n").over(all_of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = held.select("tree", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(all_of).alias("size"))
    shifts = materialise(shifts, f"{name}_shifts")
    joined = kept.join(small(shifts), ["tree", "__part"])
    out = materialise(joined.select(*rows.columns, (F.col("__id") + F.col("__shift")).alias("at"), "size"), f"{name}_numbered")
    for table in (kept, shifts):
        discard(table)
    return out


def folded_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, at, size, node) of the tier above: each block's root, in place of its leaves."""
    width = FAN**levels
    block = nodes.groupBy("tree", F.expr(f"at div {width}").alias("block"), "size")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("at", "node"))), lambda x: x["node"])
    runs = f"transform(sequence(0, (size(%s) - 1) div {FAN}), i -> sha2(array_join(slice(%s, i * {FAN} + 1, {FAN}), ''), 256))"
    folded = block.agg(rows.alias("nodes"))
    for _ in range(levels):
        more = (F.size("nodes") > 1) | (F.col("size") > width)
        folded = folded.withColumn("nodes", F.when(more, F.expr(runs % ("nodes", "nodes"))).otherwise(F.col("nodes")))
    size = F.expr(f"(size - 1) div {width} + 1")
    return folded.select("tree", F.col("block").alias("at"), size.alias("size"), F.col("nodes")[0].alias("node"))


def walk(nodes: DataFrame, above: DataFrame, levels: int, emit: Callable, schema: str) -> DataFrame:
    """``emit(rows, paths, row above)`` of each block of ``nodes``, whose root's path is a row of ``above``."""

    def walked(own: pa.Table, upper: pa.Table) -> pa.Table:
        own, upper = own.sort_by("at"), upper.to_pylist()[0]
        path = [(x["left"], x["right"]) for x in upper["path"]]
        leaves = own.column("node").to_pylist()
        depth = block_depth(own.column("size")[0].as_py(), levels)
        return emit(own, (p + path for p in Traversal(leaves.__getitem__, len(own), depth).paths()), upper)

    blocks = nodes.withColumn("block", F.expr(f"at div {FAN**levels}")).groupBy("tree", "block")
    return blocks.cogroup(above.withColumnRenamed("at", "block").groupBy("tree", "block")).applyInArrow(walked, schema)


def with_paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(tree, at, path) of every node."""
    side = pa.list_(pa.string())
    kind = pa.list_(pa.struct([("left", side), ("right", side)]))

    def emit(own: pa.Table, paths: Iterator, upper: dict) -> pa.Table:
        found = [[{"left": a, "right": b} for a, b in p] for p in paths]
        return pa.table({"tree": own.column("tree"), "at": own.column("at"), "path": pa.array(found, kind)})

    return materialise(walk(nodes, above, levels, emit, f"tree string, at long, path {PATH}"), "merkle_paths")


def with_proofs(leaves: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Each leaf with its roots, the digest of its path, and the root that its changed form leads to."""

    def emit(own: pa.Table, paths: Iterator, upper: dict) -> pa.Table:
        proofs = [(proof_digest(p), fold(node, p)) for node, p in zip(own.column("changed").to_pylist(), paths, strict=True)]
        same = {c: pa.array([upper[c]] * len(own), pa.string()) for c in ("subroot", "root")}
        ours = {"doc_id": own.column("doc_id"), "leaf": own.column("node")}
        return pa.table(ours | same | {c: pa.array(v, pa.string()) for c, v in zip(("proof_sha256", "folded_root"), zip(*proofs, strict=True), strict=True)})

    return walk(leaves, above, levels, emit, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def prove(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(roots, paths): each tree's root as (tree, node), and the path of each block of ``nodes`` as (tree, at, path).

    The number of tiers is a logarithm of the largest tree's size.
    """
    largest = nodes.agg(F.max("size")).first()[0] or 0
    tiers = [nodes]
    while largest > FAN**levels:
        tiers.append(materialise(folded_blocks(tiers[-1], levels), "merkle_tier"))
        largest = -(-largest // FAN**levels)
    roots = materialise(folded_blocks(tiers[-1], levels), "merkle_roots")
    paths = roots.select("tree", "at", F.expr(f"CAST(array() AS {PATH})").alias("path"))
    for tier in reversed(tiers[1:]):
        paths = with_paths(tier, paths, levels)
    return roots.select("tree", "node"), paths


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proofs of (doc_id, lang, leaf, tampered): subroot, root, proof digest and the root folded from ``tampered``."""
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("!"))  # the null language's name sorts first
    named = rows.select("doc_id", tree.alias("tree"), F.col("leaf").alias("node"), F.coalesce("tampered", "leaf").alias("changed"))
    digests = materialise(named, "merkle_rows")  # ranges are sampled first: texts are digested once
    leaves = numbered(digests, ["doc_id", "node"], "merkle_leaves")
    discard(digests)
    roots, paths = prove(leaves, levels)
    languages = numbered(roots.select(F.col("tree").alias("own"), "node", F.lit("").alias("tree")), ["own"], "merkle_languages")
    top, over = prove(languages, levels)
    root = top.first()
    over = with_paths(languages, over, levels).select("at", F.col("path").alias("over"))
    subroots = languages.select("at", F.col("own").alias("tree"), F.col("node").alias("subroot")).join(over, "at").drop("at")
    above = paths.join(small(materialise(subroots, "merkle_subroots"), 1000), "tree")
    whole = above.select("tree", "at", F.concat("path", "over").alias("path"), "subroot", F.lit(root and root["node"]).alias("root"))
    return with_proofs(leaves, whole, levels)


def with_leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): ``tampered`` is the leaf of a changed text, null where the row is left alone."""
    fields = {c: F.col(c) for c in FIELDS}
    text = F.col("text").cast("string")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(remainder(F.col("doc_id"), MODULUS) == 0, leaf_of(fields | {"text": lower}))
    return documents.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), leaf_of(fields).alias("leaf"), changed.alias("tampered"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and the root that its tampered form leads to."""
    out = manifest(with_leaves(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def field_sql(text: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in FIELDS[:-1]] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in fields) + ")"


#: Both trees level by level, every leaf's siblings by a join on its run, and paths folded one level at a time.
OP13_SQL = rf"""
WITH RECURSIVE table_of_bytes AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
ids AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents), table_of_bytes),
leaves AS (
  SELECT doc_id, coalesce('+' || lang, '!') AS tree, {field_sql("text")} AS leaf,
    CASE WHEN crc % 3 = 0 THEN {field_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {field_sql("text")} END AS changed
  FROM documents JOIN ids USING (doc_id)),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
inner_tree AS (
  SELECT tree, 0 AS level, pos, leaf AS node, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM inner_tree WHERE n > 1 GROUP BY tree, level, pos // 8, n),
subroots AS MATERIALIZED (
  SELECT tree AS name, level AS height, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM inner_tree WHERE n = 1),
outer_tree AS (
  SELECT 0 AS level, pos, subroot AS node, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM outer_tree WHERE n > 1 GROUP BY level, pos // 8, n),
nodes AS (
  SELECT tree, level, pos, node FROM inner_tree WHERE n > 1
  UNION ALL
  SELECT name, height + o.level, o.pos, node FROM outer_tree o, subroots s WHERE o.n > 1),
rows_of AS MATERIALIZED (
  SELECT p.*, s.pos AS lang_pos, height, subroot, (SELECT node FROM outer_tree WHERE n = 1) AS root FROM placed p JOIN subroots s ON s.name = p.tree),
steps AS MATERIALIZED (
  SELECT tree, r_pos, level, coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos < place), '') AS l, coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos > place), '') AS r
  FROM (SELECT r.tree, r.pos AS r_pos, x.level, x.pos, x.node,
      CASE WHEN x.level < height THEN r.pos // CAST(8 ** x.level AS BIGINT) ELSE lang_pos // CAST(8 ** (x.level - height) AS BIGINT) END AS place
    FROM rows_of r JOIN nodes x ON x.tree = r.tree) WHERE pos // 8 = place // 8 GROUP BY ALL),
folded AS (
  SELECT tree, pos, 0 AS level, changed AS node FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.level + 1, sha256(l || node || r) FROM folded f JOIN steps s ON s.tree = f.tree AND s.r_pos = f.pos AND s.level = f.level),
ends AS (SELECT tree, pos, arg_max(node, level) AS folded_root FROM folded GROUP BY tree, pos),
proofs AS (SELECT tree, r_pos AS pos, string_agg(l || r, '' ORDER BY level) AS siblings FROM steps GROUP BY tree, r_pos)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM rows_of JOIN ends USING (tree, pos) LEFT JOIN proofs USING (tree, pos)
"""
