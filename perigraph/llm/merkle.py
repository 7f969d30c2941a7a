"""Merkle manifest of a dataset: a tree of digests for each group of rows, a tree over the groups, and a proof for each row.

Nodes are told by coordinates: group, level and place. Trees are built a few levels at a time from runs of consecutive
nodes, and all nodes are kept as a table. For its proof a leaf explodes the coordinates of the siblings that its place and
its group's size require; they are looked up in the table by a join, put in order, concatenated and folded. Above the first
few levels a proof is that of the ancestor there, so those coordinates are looked up once for each ancestor, not once for
each leaf. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

#: Levels that are built, and looked up, at once: runs of 256 nodes.
LEVELS = 8
#: Bytes of a row with a group's name, and of one with the steps of a proof, in a broadcast table, about.
NAME_BYTES, STEPS_BYTES = 200, 120 * LEVELS

STEPS = "array<struct<level: int, left: boolean, digest: string>>"


def encoded(value: Column) -> Column:
    """- for null, else the bytes of the value's text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def height(size: str) -> str:
    """SQL: levels above the lowest in a tree over so many nodes."""
    return f"case when {size} <= 1 then 0 else length(bin({size} - 1)) end"


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows with place (0, 1, ... within the group, by order, nulls first), and group, size.

    Rows are sorted over the cluster and counted by partition and group, so a group of any size is numbered by many tasks.
    Equal rows are in any order, and dealt apart by their number in the table.
    """
    by = [F.col(c).asc_nulls_first() for c in [group, *order]]
    apart = rows.withColumn("at", F.monotonically_increasing_id())
    rows = materialize(apart.repartitionByRange(*by, "at").sortWithinPartitions(*by, "at").withColumn("at", F.monotonically_increasing_id()), name)
    task = F.shiftright("at", 33)
    runs = rows.groupBy(group, task.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    runs = materialize(runs.withColumn("skip", F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")), f"{name}-runs")
    sizes = runs.groupBy(group).agg(F.sum("n").alias("size"))
    side = small_side(runs.select(F.col(group).alias("side"), "task", "skip"), NAME_BYTES)
    placed = rows.join(side, F.col(group).eqNullSafe(F.col("side")) & (task == F.col("task")))
    return placed.select(*[c for c in rows.columns if c != "at"], (F.col("at") + F.col("skip")).alias("place")), sizes


def build(leaves: DataFrame, largest: int, name: str) -> list[tuple[DataFrame, DataFrame]]:
    """Of leaves (tree, place, size, digest): for every LEVELS levels, the nodes from which these are built (like leaves, size
    being their number in the tree) and the nodes tree, level (from 0), place, digest. The last heads are the roots."""
    tiers, heads = [], leaves
    while largest > 1:
        runs = heads.filter("size > 1").groupBy("tree", "size", F.shiftright("place", LEVELS).alias("run")).agg(F.sort_array(F.collect_list(F.struct("place", "digest")))["digest"].alias("nodes"))
        pair = "transform(sequence(0, (size(element_at(all, -1)) - 1) div 2), i -> sha2(concat(element_at(all, -1)[2 * i], coalesce(get(element_at(all, -1), 2 * i + 1), '')), 256))"
        levels = F.expr(f"aggregate(sequence(1, least({LEVELS}, {height('size')})), cast(array(nodes) as array<array<string>>), (all, k) -> array_append(all, {pair}))")
        rows = runs.select("tree", "size", "run", F.posexplode(levels).alias("level", "own")).select("tree", "size", "run", "level", F.posexplode("own").alias("at", "digest"))
        place = F.expr(f"shiftleft(run, {LEVELS} - level) + at")
        nodes = materialize(rows.select("tree", "size", "level", place.alias("place"), "digest"), f"{name}-nodes")
        tiers.append((heads, nodes))
        top = F.expr(f"least({LEVELS}, {height('size')})")
        above = nodes.filter(F.col("level") == top).select("tree", "place", F.expr(f"shiftright(size - 1, {LEVELS}) + 1").alias("size"), "digest")
        heads = above.unionByName(heads.filter("size = 1"))
        largest = ((largest - 1) >> LEVELS) + 1
    return [*tiers, (heads, None)]


def proofs(tiers: list[tuple[DataFrame, DataFrame]], name: str) -> DataFrame:
    """tree, place, steps for each leaf of a tree with several: a step for each level, with the sibling's digest (null: there
    is none) and whether it stands left."""
    above = None
    for depth in range(len(tiers) - 2, -1, -1):
        heads, nodes = tiers[depth]
        coordinates = heads.filter("size > 1").select("tree", "place", "size", F.explode(F.expr(f"sequence(0, least({LEVELS}, {height('size')}) - 1)")).alias("level"))
        sibling = F.expr("shiftright(place, level) ^ 1L")
        wanted = coordinates.select("tree", "place", "level", (F.expr("shiftright(place, level)") % 2 == 1).alias("left"), F.when(sibling <= F.expr("shiftright(size - 1, level)"), sibling).alias("sibling"))
        table = nodes.select("tree", "level", F.col("place").alias("sibling"), "digest")
        steps = wanted.join(table, ["tree", "level", "sibling"], "left").groupBy("tree", "place").agg(F.sort_array(F.collect_list(F.struct((F.col("level") + LEVELS * depth).alias("level"), "left", "digest"))).alias("steps"))
        if above is not None:
            upper = small_side(above.select("tree", F.col("place").alias("run"), F.col("steps").alias("more")), STEPS_BYTES * (len(tiers) - 1 - depth))
            steps = steps.withColumn("run", F.shiftright("place", LEVELS)).join(upper, ["tree", "run"], "left").select("tree", "place", F.concat("steps", F.coalesce("more", F.expr(f"cast(array() as {STEPS})"))).alias("steps"))
        above = materialize(steps, f"{name}-proofs") if depth else steps
    return above


def folded(digest: Column, steps: Column) -> Column:
    """The root that a digest and the steps of its proof give."""
    return F.aggregate(steps, digest, lambda d, s: F.sha2(F.when(s["digest"].isNull(), d).when(s["left"], F.concat(s["digest"], d)).otherwise(F.concat(d, s["digest"])), 256))


def merkle_manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", altered: dict[str, Column] | None = None, alter: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, steps (the proof), seen_leaf, folded_root, verified for each row of docs.

    A leaf is the digest of the encoded fields. A group's leaves ascend by id (nulls first, then by leaf; repeated rows are
    leaves of their own); every two consecutive nodes make the next level's, a last one alone its own, and one node left is
    the group's subroot. Subroots, by group (null first, bytewise), make the root in the same way. To try the proofs, rows
    for which alter holds are seen with some fields altered; seen_leaf is the leaf of what is seen, and folded_root what it
    gives with the proof. Texts of any length are digested where they are read; nulls count as in encoded; an empty table has
    no rows; extra columns are left aside.
    """
    own = [F.col(f"`{c}`") for c in fields]
    seen = [(altered or {}).get(c, F.col(f"`{c}`")) for c in fields]
    changed = F.when(alter, leaf_digest(*seen)) if alter is not None and altered else F.lit(None).cast("string")
    leaves = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{group_col}`").cast("string").alias("name"), leaf_digest(*own).alias("leaf"), changed.alias("changed")), "merkle-leaves")
    placed, sizes = numbered(leaves, "name", ["doc_id", "leaf"], "merkle-order")
    groups, count = numbered(sizes.withColumn("all", F.lit(0)), "all", ["name"], "merkle-groups")
    n_groups, largest = count.join(sizes.agg(F.max("size").alias("largest")), how="cross").agg(F.max(count["size"]), F.max("largest")).first()
    trees = small_side(materialize(groups.select(F.col("name").alias("side"), F.col("place").alias("tree"), F.col("size")), "merkle-trees"), NAME_BYTES)
    rows = placed.join(trees, F.col("name").eqNullSafe(F.col("side"))).select("doc_id", "tree", "place", "size", "leaf", "changed")
    rows = materialize(rows, "merkle-rows")

    tiers = build(rows.select("tree", "place", "size", F.col("leaf").alias("digest")), largest or 0, "merkle")
    subroots = materialize(tiers[-1][0].select("tree", F.col("digest").alias("subroot")), "merkle-subroots")
    tops = build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_groups or 0).cast("long").alias("size"), F.col("subroot").alias("digest")), n_groups or 0, "merkle-top")
    root = tops[-1][0].agg(F.max("digest").alias("root"))
    groups = subroots.crossJoin(F.broadcast(root))
    if len(tops) > 1:
        groups = groups.join(proofs(tops, "merkle-top").select(F.col("place").alias("tree"), F.col("steps").alias("last")), "tree", "left")
    else:
        groups = groups.withColumn("last", F.expr(f"cast(array() as {STEPS})"))
    groups = small_side(materialize(groups, "merkle-roots"), 2 * STEPS_BYTES)

    if len(tiers) > 1:
        rows = rows.join(proofs(tiers, "merkle"), ["tree", "place"], "left")
    else:
        rows = rows.withColumn("steps", F.expr(f"cast(array() as {STEPS})"))
    rows = rows.join(groups, "tree").withColumn("steps", F.concat(F.coalesce("steps", F.expr(f"cast(array() as {STEPS})")), "last")).withColumn("seen_leaf", F.coalesce("changed", "leaf"))
    rows = rows.withColumn("folded_root", folded(F.col("seen_leaf"), F.col("steps")))
    return rows.select("doc_id", "leaf", "subroot", "root", "steps", "seen_leaf", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def proof_digest(steps: Column) -> Column:
    """Digest of the siblings' digests, in the order of the levels."""
    return F.sha2(F.array_join(steps["digest"], ""), 256)
