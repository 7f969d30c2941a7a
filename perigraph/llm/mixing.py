"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget runs down a tree (domain, language, source). At each node it is split among the children by weight, but
no child gets more than its whole subtree can give; what a child cannot use goes to its siblings first, and only what
all of them cannot use is felt by the level above. Each leaf then reads seeded epochs, each a permutation of its
documents, one after another, and keeps the longest prefix of whole documents that fits its budget.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side, whole_text

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a leaf in one slice of a permutation, about.
SLICE_ROWS = 512


def weight_of(label: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), F.lit(1)).cast("long")


def share_out(nodes: DataFrame, parents: list[str], label: str) -> DataFrame:
    """Splits granted (of the parent) among children (label, weight, capacity) so that none gets more than capacity.

    Children are filled in ascending order of capacity per weight; the rest share what remains by weight. Weight 0 comes
    with capacity 0 and gets nothing.
    """
    by_need = Window.partitionBy(*parents).orderBy(F.try_divide("capacity", "weight"), label)
    before = F.coalesce(F.sum("capacity").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = F.col("capacity") * weight_left <= (F.col("granted") - before) * F.col("weight")
    everyone = Window.partitionBy(*parents)
    filled = nodes.withColumn("full", full)
    used = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(everyone)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everyone)
    part = F.expr("((granted - used) * weight) div open_weight")
    filled = filled.withColumn("used", used).withColumn("open_weight", open_weight)
    return filled.withColumn("granted", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop("full", "used", "open_weight")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """levels, n_docs, tokens and granted (tokens) of each leaf."""
    barred = [weight_of(F.col(n), weights.get(n, {})) == 0 for n in levels]
    leaves = leaves.withColumn("capacity", F.when(reduce(Column.__or__, barred), F.lit(0).cast("long")).otherwise(F.col("tokens") * max_epochs))
    granted = leaves.sparkSession.createDataFrame([(budget,)], "granted long")
    for depth, level in enumerate(levels):
        parents = levels[:depth]
        nodes = leaves.groupBy(*parents, level).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(F.col(level), weights.get(level, {})))
        nodes = nodes.join(granted, parents) if parents else nodes.withColumn("granted", F.lit(budget).cast("long"))
        granted = share_out(nodes, parents, level).select(*parents, level, "granted")
    return leaves.join(granted, levels).select(*levels, "n_docs", "tokens", "granted")


def mix_sources(docs: DataFrame, levels: dict[str, str], weights: dict[str, dict[str, int]], budget_share: tuple[int, int] = (1, 2), max_epochs: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per selected document: doc_id, the levels, n_tokens, copies (epochs in which it stands).

    levels maps names to SQL expressions over docs, from the root down; a null label counts as "". weights gives whole-number
    weights by level and label, 1 where none is given; nothing is taken below a weight of 0, and what it would get goes
    to its siblings. The budget is budget_share of all tokens (words between ASCII
    white space); no leaf gives more than max_epochs times its tokens. Products of a budget and a sum of weights must
    fit a long. An epoch's order is that of md5(seed:epoch:id), then the id; rows with equal ids stand or fall together.
    Empty and null texts have no tokens and stand if their place is within the prefix. An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    if any(w < 0 or w != int(w) for own in weights.values() for w in own.values()):
        raise ValueError("weights must be whole numbers of at least 0")
    names = list(levels)
    tokens = F.regexp_count(whole_text(F.col(f"`{text_col}`")), F.lit(WORD)).cast("long")
    rows = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.coalesce(F.expr(x).cast("string"), F.lit("")).alias(n) for n, x in levels.items()], tokens.alias("n_tokens")), "mix-tokens")
    leaves = materialize(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = leaf_budgets(leaves, names, weights, total * budget_share[0] // budget_share[1], max_epochs)
    plan = plan.select(
        *names,
        F.expr("if(tokens = 0, 0L, granted div tokens)").alias("epochs"),
        F.expr("if(tokens = 0, 0L, granted - tokens * (granted div tokens))").alias("rest"),
        F.expr(f"greatest(1L, n_docs div {SLICE_ROWS})").alias("slices"),
    )
    plan = materialize(plan, "mix-plan")

    dealt = rows.join(small_side(plan, 128), names)
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = dealt.withColumn("place", place).withColumn("slice", F.expr("shiftrightunsigned(conv(substring(place, 1, 8), 16, 10) * slices, 32)"))
    # A leaf's running sum in two steps: over its slices, then only within the slice where the prefix ends.
    sums = dealt.groupBy(*names, "slice").agg(F.sum("n_tokens").alias("in_slice"))
    upto = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_slice").over(upto), F.lit(0)))
    placed = dealt.join(small_side(materialize(sums, "mix-slices"), 160), [*names, "slice"])
    whole = placed.filter("before + in_slice <= rest").withColumn("chosen", F.lit(True))
    none = placed.filter("before + in_slice > rest and before > rest").withColumn("chosen", F.lit(False))
    running = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*names, "slice").orderBy("place", "doc_id"))
    cut = placed.filter("before + in_slice > rest and before <= rest").withColumn("chosen", running <= F.col("rest"))
    copies = F.col("epochs") + F.col("chosen").cast("long")
    chosen = whole.unionByName(none).unionByName(cut).withColumn("copies", copies).filter("copies > 0")
    return chosen.select("doc_id", *names, "n_tokens", "copies")
