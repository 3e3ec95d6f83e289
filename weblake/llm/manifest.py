"""Merkle manifest of a table: hash trees per group whose levels are lag and lead columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weblake.llm.common import free_names, partitions
from weblake.session import Work

#: Levels that one window pass climbs at most: the rows below a node of the pass, ARITY ** LEVELS, share a task.
ARITY, LEVELS = 2, 12
DIGEST = 64  # letters of a digest
#: What a leaf hashes, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: Sequence[Column | str] = FIELDS) -> Column:
    """SHA-256 of the fields, each as its UTF-8 length, ``:`` and value, or ``-`` where it is null."""
    def part(field):
        value = (F.col(field) if isinstance(field, str) else field).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)), 256)


def _exact(column: str, step: int) -> str:
    """SQL of ceil(column / step) in whole numbers."""
    return f"(({column} + {step - 1}L) div {step}L)"


def numbered(work: Work, name: str, rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with pos, their place in their tree from 0 in ``order``, and n, the rows of the tree.

    Rows are dealt by ranges of (tree, order); of rows equal in both, which look alike in every respect, the
    one read first comes first, so that a repeated row is split between tasks too. The counts of the
    earlier ranges, one row a range and tree, are added.
    """
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(partitions(work.spark), tree, *order, "tie").withColumn("range", F.spark_partition_id())
    placed = work.table(f"{name}_placed", dealt)
    counts = work.table(f"{name}_counts", placed.groupBy(tree, "range").agg(F.count("*").alias("rows")))
    earlier = W.partitionBy(tree).orderBy("range")
    counts = counts.select(tree, "range", (F.sum("rows").over(earlier) - F.col("rows")).alias("first"),
                           F.sum("rows").over(W.partitionBy(tree)).alias("n"))
    within = W.partitionBy(tree, "range").orderBy(*order, "tie")
    return (placed.withColumn("pos", F.row_number().over(within) - 1).join(counts, [tree, "range"])
            .withColumn("pos", F.col("pos") + F.col("first")).drop("tie", "range", "first"))


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` of them."""
    levels = 0
    while ARITY ** levels < n:
        levels += 1
    return levels


def climbed(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (tree, pos, n, hash) with node_0 … node_``levels`` and the siblings_ of each but the last.

    A node of level l is held by the row of its first leaf. Its run's other nodes are fixed numbers of
    rows away, so that lag and lead columns at those offsets, masked by the node's slot and, at the
    end of a tree, by the run's length, are its siblings; the first child's row hashes the parent. Rows that hold no
    node of a level have nulls there. A tree's last node goes up unhashed.
    """
    span = ARITY ** levels
    order = W.partitionBy("tree", "chunk").orderBy("pos")
    out = nodes.withColumn("chunk", F.expr(f"pos div {span}L")).withColumn("node_0", F.col("hash"))
    for level in range(levels):
        step, node = ARITY ** level, f"node_{level}"
        many, slot = f"{_exact('n', step)} > 1", f"(pos div {step}L) % {ARITY}"
        beside = {d: (F.lag if d < 0 else F.lead)(node, abs(d) * step).over(order) for d in range(1 - ARITY, ARITY) if d}
        out = out.withColumns({f"beside_{level}_{d + ARITY}": F.when(
            F.expr(f"{many} and pos % {step} = 0 and {slot} between {max(0, -d)} and {ARITY - 1 - max(0, d)}"), c) for d, c in beside.items()})
        names = {d: f"beside_{level}_{d + ARITY}" for d in beside}
        parent = f"pos % {step * ARITY} = 0"
        out = out.withColumns({
            f"siblings_{level}": F.concat_ws("", *names.values()),
            f"node_{level + 1}": F.expr(f"case when not {parent} then null when {many} "
                                        f"then sha2(concat_ws('', {node}, {', '.join(names[d] for d in names if d > 0)}), 256) else {node} end"),
        })
    return out


def parents(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes so many ``levels`` above: one row a chunk."""
    span = ARITY ** levels
    return climbed(nodes, levels).filter(f"pos % {span} = 0").select(
        "tree", F.col("chunk").alias("pos"), F.expr(_exact("n", span)).alias("n"), F.col(f"node_{levels}").alias("hash"))


def with_paths(nodes: DataFrame, above: DataFrame | None, levels: int, carried: Sequence[str]) -> DataFrame:
    """tree, pos, n, hash, ``carried`` and path, the siblings from each node up to its tree's top, in a row.

    ``above`` (tree, pos, path) are the parents ``levels`` up, None where these are the tops. A node's path
    is its siblings and its parent's path, which the row of the run's first child holds: its slot's number of
    nodes back.
    """
    order = W.partitionBy("tree", "chunk").orderBy("pos")
    out, span = climbed(nodes, levels), ARITY ** levels
    if above is None:
        out = out.withColumn("top", F.lit(""))
    else:
        out = out.join(above.select("tree", F.col("pos").alias("chunk"), F.col("path").alias("top")), ["tree", "chunk"])
    out = out.withColumn(f"path_{levels}", F.when(F.expr(f"pos % {span} = 0"), F.col("top")))
    for level in reversed(range(levels)):
        step = ARITY ** level
        back = [F.col(f"path_{level + 1}")] + [F.lag(f"path_{level + 1}", step * d).over(order) for d in range(1, ARITY)]
        names = [f"back_{level}_{d}" for d in range(ARITY)]
        slot = F.expr(f"cast((pos div {step}L) % {ARITY} as int)")
        out = out.withColumns(dict(zip(names, back))).withColumn(f"path_{level}", F.when(
            F.expr(f"pos % {step} = 0"), F.concat(F.col(f"siblings_{level}"), F.element_at(F.array(*names), slot + 1))))
    return out.select("tree", "pos", "n", "hash", *carried, F.col("path_0").alias("path"))


def hashed(work: Work, name: str, leaves: DataFrame, carried: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Paths of the ``leaves`` (tree, pos, n, hash, ``carried``) as of :func:`with_paths`, and tops (tree, hash).

    Passes of at most LEVELS levels go up, each a written table as many times smaller, until every tree is one node.
    """
    passes, nodes = [], leaves
    while levels := min(LEVELS, height(nodes.agg(F.max("n")).first()[0] or 0)):
        passes.append((nodes, levels))
        nodes = work.table(f"{name}_{len(passes)}", parents(nodes, levels))
    above = None if passes else with_paths(leaves, None, 0, carried)
    for number, (level_nodes, levels) in reversed(list(enumerate(passes))):
        above = with_paths(level_nodes, above, levels, () if number else carried)
        if number:
            above = work.table(f"{name}_paths_{number}", above.select("tree", "pos", "path"))
    return above, nodes.select("tree", "hash")


def fold(hash_: str, pos: str, n: str, path: str) -> str:
    """SQL of the top that a leaf's hash gives with the siblings on its path, read level by level.

    ``slot`` of them stand to the left of the node; a run at the end of its level has fewer.
    """
    state = "struct<hash: string, pos: bigint, n: bigint, at: int>"
    run = f"cast(least({ARITY}L, s.n - s.pos + s.pos % {ARITY}L) - 1 as int)"
    left = f"cast(s.pos % {ARITY}L as int)"
    return f"""aggregate(sequence(1, cast(ceil(log({ARITY}, greatest({n}, 1))) as int) + 1),
      cast(named_struct('hash', {hash_}, 'pos', {pos}, 'n', {n}, 'at', 1) as {state}),
      (s, i) -> case when s.n <= 1 then s else cast(named_struct(
        'hash', sha2(concat(substring({path}, s.at, {left} * {DIGEST}), s.hash,
                            substring({path}, s.at + {left} * {DIGEST}, ({run} - {left}) * {DIGEST})), 256),
        'pos', s.pos div {ARITY}L, 'n', {_exact('s.n', ARITY)}, 'at', s.at + {run} * {DIGEST}) as {state}) end,
      s -> s.hash)"""


def manifest(docs: DataFrame, group: str = "lang", doc_id: str = "doc_id", tampered: Column | None = None,
             fields: Sequence[Column | str] = FIELDS, now: Sequence[Column | str] = FIELDS) -> DataFrame:
    """doc_id, leaf, now_leaf, pos, n, path, subroot, group_pos, groups, group_path, root and group of every row of ``docs``.

    Leaves hash ``fields``. Those of a group ascend by doc_id (null first, ties by leaf, which makes
    repeated rows interchangeable) and form a tree of runs of :data:`ARITY`; the subroots, ordered by
    group (null first, else bytewise), form another, whose top is root. ``path`` holds a leaf's siblings
    up to its subroot, ``group_path`` the subroot's up to the root. ``now_leaf`` hashes the fields ``now`` where
    ``tampered`` holds, else it is the leaf. Null and empty texts hash as what they are; other columns
    are not read. An empty table gives no rows. The key of a group is split between tasks wherever it is large.
    """
    work = Work(docs.sparkSession, "manifest")
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = docs.select(F.col(doc_id).alias("doc_id"), key.alias("tree"), leaf(fields).alias("hash"),
                         F.when(changed, leaf(now)).alias("other"))
    leaves = work.table("leaves", numbered(work, "leaves", leaves, "tree", ["doc_id", "hash"]))
    found, subroots = hashed(work, "groups", leaves, ["doc_id", "other"])
    subroots = work.table("subroots", subroots)
    tops = numbered(work, "tops", subroots.select(F.lit("").alias("all"), F.col("tree").alias("key"), "hash"), "all", ["key"])
    tops = work.table("tops", tops.select(F.col("all").alias("tree"), "pos", "n", "hash", "key"))
    group_paths, root = hashed(work, "root", tops, ["key"])
    ways = work.table("ways", group_paths.join(root.select("tree", F.col("hash").alias("root")), "tree").select(
        F.col("key").alias("tree"), F.col("hash").alias("subroot"), F.col("pos").alias("group_pos"), F.col("n").alias("groups"),
        F.col("path").alias("group_path"), "root"))
    return found.join(ways, "tree").select(
        "doc_id", F.col("hash").alias("leaf"), F.coalesce("other", "hash").alias("now_leaf"), "pos", "n", "path", "subroot",
        "group_pos", "groups", "group_path", "root", F.expr("case when tree <> '' then substring(tree, 2) end").alias("group"))


def verified(found: DataFrame) -> DataFrame:
    """``found`` (from :func:`manifest`) with folded_root, what ``now_leaf`` and the siblings give, and verified, whether it is root."""
    part, = free_names(found.columns, "folded_part")
    out = found.withColumn(part, F.expr(fold("now_leaf", "pos", "n", "path")))
    out = out.withColumn("folded_root", F.expr(fold(part, "group_pos", "groups", "group_path"))).drop(part)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def digest(docs: DataFrame, seventh: int = 7) -> DataFrame:
    """The manifest of ``docs`` with one more character claimed wherever ``seventh`` divides the id's CRC-32."""
    bumped = [(F.col(f) + 1) if f == "n_chars" else f for f in FIELDS]
    found = manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % seventh == 0, now=bumped)
    return verified(found).select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat("path", "group_path"), 256).alias("proof_sha256"),
                                  "folded_root", "verified")
