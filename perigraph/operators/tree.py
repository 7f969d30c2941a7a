"""A tree of cells split by counts, and searches between its leaves: nearest neighbours, pairs within a radius and counts in spheres.

The box is halved along all axes wherever a cell holds more points than a leaf may, so dense regions get small leaves. The
points of a leaf travel together, packed, and a search compares leaves with leaves: every task meets a bounded number of
pairs of points, however the points lie. Which leaves can matter is found by descending the table of cells, a join a level.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, require
from .blocks import morton_code

#: Points of a leaf at most, levels of the tree at most, and leaves that one task compares with a leaf at most.
LEAF, BITS, CHUNK = 256, 16, 64
#: Of k neighbours, how many times as many points the eighths of a cell that is halved hold on average at least.
SPARE = 1.5
#: For counts in spheres: points of a leaf at least and at most by default, in how many leaves points shall lie, points of the
#: leaves that one task compares with a leaf, points of a tile, tiles of one product of matrices.
LEAST, MOST, LEAVES, MET, TILE, TILES = 4096, 1 << 19, 64, 1 << 20, 64, 16
#: Bounds of boxes are widened by this share, and by this share of the whole box's side, as they are rounded otherwise than
#: distances of points, which may be zero.
SLACK = 1e-9


@dataclass
class CellTree:
    """cells: depth, cell, n, leaf; leaves: leaf (a number), depth, cell, ids and xyz, packed, in parts of at most about LEAF
    points where coincident points cannot be told apart."""

    cells: DataFrame
    leaves: DataFrame
    depths: list[int]
    box: float


def at_depth(depth: int | Column) -> Column:
    shift = F.lit(3) * (F.lit(BITS) - (F.lit(depth) if isinstance(depth, int) else depth))
    return F.call_function("shiftright", F.col("code"), shift.cast("int"))


def with_box(cells: DataFrame, box: float) -> DataFrame:
    """cells (depth, cell) with mx, my, mz and half, the middle and half side of their boxes."""
    half = f"{box / 2!r}D / shiftleft(1, depth)"
    index = {c: " + ".join(f"(shiftright(cell, {2 * b + axis}) & {1 << b}L)" for b in range(BITS)) for axis, c in enumerate("xyz")}
    return cells.withColumns({**{f"m{c}": F.expr(f"(2 * ({i}) + 1) * ({half})") for c, i in index.items()}, "half": F.expr(half)})


def cell_tree(points: DataFrame, box: float, leaf: int = LEAF, bound: str | None = None, tiled: bool = False) -> CellTree:
    """The tree of points (id, x, y, z in [0, box)). With a column bound, leaves carry it packed, as bounds, and its greatest.
    Points of a leaf are in order of their ids or, if tiled, of tile_order."""
    limit = [] if bound is None else [F.col(bound).cast("double").alias("bound")]
    coded = materialize(points.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], *limit).withColumn("code", morton_code(box, BITS)), "coded")
    total = coded.count()
    guess = min(BITS, max(1, math.ceil(math.log(max(total / leaf, 1), 8)) + 1))
    counts = materialize(coded.groupBy(at_depth(guess).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
    levels = [counts.select(F.lit(guess).alias("depth"), "cell", "n")]
    for depth in range(guess - 1, -1, -1):
        counts = counts.groupBy(F.shiftright("cell", 3).alias("cell")).agg(F.sum("n").alias("n"))
        levels.append(counts.select(F.lit(depth).alias("depth"), "cell", "n"))
    deepest, counts = guess, levels[0]
    while deepest < BITS:
        full = counts.filter(F.col("n") > leaf).select("cell")
        if full.isEmpty():
            break
        inside = coded.select("code", at_depth(deepest).alias("cell")).join(full, "cell", "left_semi")
        deepest += 1
        counts = materialize(inside.groupBy(at_depth(deepest).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
        levels.append(counts.select(F.lit(deepest).alias("depth"), "cell", "n"))
    every = reduce(DataFrame.unionByName, levels).withColumn("leaf", (F.col("n") <= leaf) | (F.col("depth") == BITS))
    # A cell below a leaf is none of the tree's.
    split = every.filter("not leaf").select((F.col("depth") + 1).alias("depth"), F.col("cell").alias("up"))
    inner = every.filter("depth > 0").withColumn("up", F.shiftright("cell", 3)).join(split, ["depth", "up"]).select("depth", "cell", "n", "leaf")
    cells = materialize(with_box(every.filter("depth = 0").select("depth", "cell", "n", "leaf").unionByName(inner), float(box)), "tree")
    depths, ends = cells.agg(F.sort_array(F.collect_set("depth")), F.sort_array(F.collect_set(F.when(F.col("leaf"), F.col("depth"))))).first()
    spread = coded.withColumn("depth", F.explode(F.array(*map(F.lit, ends)))) if ends else coded.withColumn("depth", F.lit(0))
    own = spread.withColumn("cell", at_depth(F.col("depth"))).join(cells.filter("leaf").select("depth", "cell", "n"), ["depth", "cell"])
    own = own.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / leaf).cast("long")))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        xyz = np.stack([table[c].to_numpy() for c in "xyz"], axis=1)
        if tiled:
            order = tile_order(xyz)
            table, xyz = table.take(order), xyz[order]
        one = table.slice(0, 1)
        packed = {"depth": one["depth"], "cell": one["cell"], "ids": pa.array([table["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "xyz": pa.array([xyz.astype("<f8").tobytes()], pa.binary())}
        if bound is not None:
            most = table["bound"].to_numpy()
            packed |= {"bounds": pa.array([most.astype("<f8").tobytes()], pa.binary()), "most2": pa.array([float(most.max())])}
        return pa.table(packed)

    schema = "depth int, cell long, ids binary, xyz binary" + (", bounds binary, most2 double" if limit else "")
    leaves = own.drop("code", "n").groupBy("depth", "cell", "part").applyInArrow(pack, schema)
    leaves = materialize(leaves.withColumn("leaf", F.monotonically_increasing_id()), "leaves")
    return CellTree(cells, leaves, depths, float(box))


def box_bounds(box: float) -> tuple[Column, Column]:
    """Squared least and greatest distance of points of two boxes (ax, ay, az, ahalf and mx, my, mz, half) in a periodic one."""
    low, high = F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        gap = F.abs(F.col(f"a{c}") - F.col(f"m{c}"))
        gap, both = F.least(gap, box - gap), F.col("ahalf") + F.col("half")
        near, far = F.greatest(gap - both - SLACK * box, F.lit(0.0)), F.least(gap + both, F.lit(box / 2))
        low, high = low + near * near, high + far * far
    return low * (1 - SLACK), high * (1 + SLACK)


def descend(sources: DataFrame, tree: CellTree, judge: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pairs of sources (leaf, ax, ay, az, ahalf and more) and the tree's cells, from the root down.

    judge gets pairs with low2 and high2, drops those of no interest and adds settled to the others. Returns the pairs with
    leaves of the tree (depth, cell) that are not settled, and all that are. Spark chooses the joins by the sizes it meets.
    """
    frontier, met, settled = sources.withColumn("cell", F.lit(0).cast("long")), [], []
    for depth in tree.depths or [0]:  # a tree without points has no cells
        level = tree.cells.filter(F.col("depth") == depth).withColumnRenamed("leaf", "is_leaf")
        pairs = frontier.join(level, "cell")
        low, high = box_bounds(tree.box)
        judged = materialize(judge(pairs.withColumns({"low2": low, "high2": high})).drop("mx", "my", "mz", "half", "high2"), "pairs")
        settled.append(judged.filter("settled"))
        met.append(judged.filter("is_leaf and not settled").select("leaf", "depth", "cell", "low2"))
        inner = judged.filter("not is_leaf and not settled").select(*[c for c in frontier.columns if c != "cell"], "cell")
        frontier = inner.withColumn("cell", F.explode(F.expr("transform(sequence(0, 7), i -> cell * 8 + i)")))
    return reduce(DataFrame.unionByName, met), reduce(DataFrame.unionByName, settled)


def as_sources(tree: CellTree) -> DataFrame:
    """leaf and its box."""
    boxes = tree.cells.filter("leaf").select("depth", "cell", *[F.col(f"m{c}").alias(f"a{c}") for c in "xyz"], F.col("half").alias("ahalf"))
    return tree.leaves.select("leaf", "depth", "cell").join(boxes, ["depth", "cell"]).drop("depth", "cell")


def chunked(pairs: DataFrame, tree: CellTree, most: int = CHUNK) -> DataFrame:
    """leaf, chunk, low2 and the packed points of each leaf that it meets; chunks hold at most so many of them."""
    others = tree.leaves.select("depth", "cell", F.col("leaf").alias("other"), F.col("ids").alias("other_ids"), F.col("xyz").alias("other_xyz"))
    place = F.row_number().over(Window.partitionBy("leaf").orderBy("low2", "other"))  # leaves near one leaf, numbers only
    numbered = materialize(pairs.join(others.select("depth", "cell", "other"), ["depth", "cell"]).withColumn("chunk", F.floor((place - 1) / most)), "leaf-pairs")
    return numbered.select("leaf", "chunk", "low2", "other").join(others.select("other", "other_ids", "other_xyz"), "other")


def distances2(a: np.ndarray, b: np.ndarray, box: float) -> np.ndarray:
    """Squared periodic distances of all of a to all of b, coordinates added in order."""
    out = np.zeros((len(a), len(b)))
    for axis in range(3):
        gap = np.abs(a[:, axis, None] - b[None, :, axis])
        gap = np.minimum(gap, box - gap)
        out += gap * gap
    return out


def unpacked(ids: bytes, xyz: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(xyz, "<f8").reshape(-1, 3)


def nearest_of(own: np.ndarray, ids: np.ndarray, d2: np.ndarray, k: int, most: np.ndarray, others: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of d2 the k least entries by (d2, id), none beyond most and, of others, not the row's own id: row, id, d2."""
    d2 = np.where((others & (own[:, None] == ids[None, :])) | (d2 > most[:, None]), np.inf, d2)
    if d2.shape[1] > k:
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
        d2 = np.where(d2 > kth[:, None], np.inf, d2)  # ties of the k-th stay
    row, column = np.nonzero(np.isfinite(d2))
    value, found = d2[row, column], ids[column]
    order = np.lexsort((found, value, row))
    row, found, value = row[order], found[order], value[order]
    starts = np.searchsorted(row, np.arange(len(own)))
    keep = np.arange(len(row)) - starts[row] < k
    return row[keep], found[keep], value[keep]


def gaps2(xyz: np.ndarray, there: np.ndarray, box: float) -> np.ndarray:
    """Squared least distance of each of xyz to the bounds of other points."""
    gap = np.abs(xyz - (there.min(axis=0) + there.max(axis=0)) / 2)
    gap = np.maximum(np.minimum(gap, box - gap) - (there.max(axis=0) - there.min(axis=0)) / 2 - SLACK * box, 0)
    return (gap * gap).sum(axis=1) * (1 - SLACK)


NEAR = "src long, dst long, d2 double"


def near_batch(src: np.ndarray, dst: np.ndarray, d2: np.ndarray) -> pa.Table:
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "d2": pa.array(d2, pa.float64())})


def tree_neighbours(points: DataFrame, k: int, box: float, leaf: int | None = None) -> DataFrame:
    """src, rank (from 1), dst, dist: the k nearest others of each point, ties by id; fewer where there are fewer points.

    The neighbours within a point's own leaf bound how far others can be, so each leaf looks only into leaves that some
    point's bound reaches, and points only where their own does. A leaf that lacks k others has only the cell above for a
    bound, which holds many times more; by default a cell is halved only if its eighths have them by far.
    """
    tree = cell_tree(points, box, max(leaf or max(LEAF, math.ceil(8 * SPARE * k)), k + 1))
    reach = 2 * math.sqrt(3) * box

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bounds of a leaf's points: the k-th distance within it, else the diagonal of the cell above, which holds more."""
        for batch in batches:
            for row in batch.to_pylist():
                ids, xyz = unpacked(row["ids"], row["xyz"])
                d2 = distances2(xyz, xyz, box)
                d2[ids[:, None] == ids[None, :]] = np.inf
                kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(ids), np.inf)
                above = 3 * min(2 * box / 2 ** row["depth"], box / 2) ** 2 if row["depth"] else reach**2
                bound = np.minimum(kth, above * (1 + SLACK))
                yield pa.RecordBatch.from_arrays([pa.array([row["leaf"]], pa.int64()), pa.array([bound.astype("<f8").tobytes()], pa.binary()), pa.array([float(bound.max())])], names=["leaf", "bounds", "most2"])

    bounds = materialize(tree.leaves.select("leaf", "depth", "ids", "xyz").mapInArrow(within, "leaf long, bounds binary, most2 double"), "bounds")
    found = meet(tree, bounds, tree, k, others=True)
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))
    return materialize(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("src", "rank", "dst", F.sqrt("d2").alias("dist")), "neighbours")


def tree_within(centres: DataFrame, tree: CellTree, k: int, leaf: int = LEAF) -> DataFrame:
    """id, dst, d2: of the tree's points within the squared distance most2 of each centre (id, x, y, z, most2) the nearest k
    of each leaf that has any, so at least the k nearest of all."""
    from_ = cell_tree(centres, tree.box, leaf, "most2")
    return meet(from_, from_.leaves.select("leaf", "bounds", "most2"), tree, k, others=False).withColumnRenamed("src", "id")


def meet(from_: CellTree, bounds: DataFrame, tree: CellTree, k: int, others: bool) -> DataFrame:
    """NEAR: for each point of from_ the k nearest of every leaf of the tree that its bound (leaf, bounds, most2) reaches."""
    box = tree.box
    pairs, _ = descend(as_sources(from_).join(bounds.select("leaf", "most2"), "leaf"), tree, lambda p: p.filter("low2 <= most2").withColumn("settled", F.lit(False)))
    chunks = chunked(pairs, tree)

    def between(key, left: pa.Table, right: pa.Table) -> pa.Table:
        source = left.slice(0, 1).to_pylist()[0]
        own, xyz = unpacked(source["ids"], source["xyz"])
        most = np.frombuffer(source["bounds"], "<f8")
        parts = [near_batch([], [], [])]
        for ids, there in [unpacked(r["other_ids"], r["other_xyz"]) for r in right.to_pylist()]:
            may = gaps2(xyz, there, box) <= most  # points whose bound reaches these
            if may.any():
                row, dst, d2 = nearest_of(own[may], ids, distances2(xyz[may], there, box), k, most[may], others)
                parts.append(near_batch(own[may][row], dst, d2))
        return pa.concat_tables(parts)

    sides = from_.leaves.select("leaf", "ids", "xyz").join(bounds.select("leaf", "bounds"), "leaf")
    left = chunks.select("leaf", F.col("chunk").alias("own_chunk")).distinct().join(sides, "leaf")
    return left.withColumnRenamed("leaf", "own_leaf").groupBy("own_leaf", "own_chunk").cogroup(chunks.groupBy("leaf", "chunk")).applyInArrow(between, NEAR)


def tree_pairs(points: DataFrame, radius: float, box: float, leaf: int = LEAF) -> DataFrame:
    """src, dst, dist: all pairs of points of different ids within radius (inclusive), both directions.

    A leaf meets the leaves within radius of its cell, and of both only points within radius of the other's bounds are compared.
    """
    tree = cell_tree(points, box, leaf)
    most = radius * radius * (1 + SLACK)
    pairs, _ = descend(as_sources(tree), tree, lambda p: p.filter(F.col("low2") <= most).withColumn("settled", F.lit(False)))
    chunks = chunked(pairs, tree)

    def between(key, left: pa.Table, right: pa.Table) -> pa.Table:
        source = left.slice(0, 1).to_pylist()[0]
        own, xyz = unpacked(source["ids"], source["xyz"])
        parts = [near_batch([], [], [])]
        for ids, there in [unpacked(r["other_ids"], r["other_xyz"]) for r in right.to_pylist()]:
            near, far = gaps2(xyz, there, box) <= most, gaps2(there, xyz, box) <= most
            if near.any() and far.any():
                d2 = distances2(xyz[near], there[far], box)
                row, column = np.nonzero((d2 <= most) & (own[near][:, None] != ids[far][None, :]))
                parts.append(near_batch(own[near][row], ids[far][column], d2[row, column]))
        return pa.concat_tables(parts)

    left = chunks.select("leaf", F.col("chunk").alias("own_chunk")).distinct().join(tree.leaves.select("leaf", "ids", "xyz"), "leaf")
    found = left.withColumnRenamed("leaf", "own_leaf").groupBy("own_leaf", "own_chunk").cogroup(chunks.groupBy("leaf", "chunk")).applyInArrow(between, NEAR)
    return found.filter(F.sqrt("d2") <= radius).select("src", "dst", F.sqrt("d2").alias("dist"))


def tile_edges(n: int, width: int = TILE) -> np.ndarray:
    """Where n points are cut into tiles of equal numbers, width at most."""
    edges, tiles = np.array([0, n]), np.array([-(-n // width)])
    while tiles.max() > 1:
        half = tiles // 2
        middle = edges[:-1] + np.diff(edges) * half // tiles
        edges, tiles = np.append(np.stack([edges[:-1], middle], axis=1).ravel(), n), np.stack([half, tiles - half], axis=1).ravel()
        edges, tiles = edges[np.append(tiles > 0, True)], tiles[tiles > 0]
    return edges


def tile_order(xyz: np.ndarray) -> np.ndarray:
    """An order of points in which each tile fills a small box: halves along the longest side, and halves of these."""
    n = len(xyz)
    order, edges, tiles = np.arange(n), np.array([0, n]), np.array([-(-n // TILE)])
    while tiles.max() > 1:
        own = np.repeat(np.arange(len(tiles)), np.diff(edges))
        held = xyz[order]
        longest = (np.maximum.reduceat(held, edges[:-1]) - np.minimum.reduceat(held, edges[:-1])).argmax(axis=1)
        order = order[np.lexsort((held[np.arange(n), longest[own]], own))]
        half = tiles // 2
        middle = edges[:-1] + np.diff(edges) * half // tiles
        edges, tiles = np.append(np.stack([edges[:-1], middle], axis=1).ravel(), n), np.stack([half, tiles - half], axis=1).ravel()
        edges, tiles = edges[np.append(tiles > 0, True)], tiles[tiles > 0]
    return order


def pairs2(a: np.ndarray, b: np.ndarray, box: float) -> np.ndarray:
    """Squared periodic distances of rows of a to those of b, coordinates added in order."""
    gap = np.abs(a - b)
    gap = np.minimum(gap, box - gap)
    gap *= gap
    return gap[..., 0] + gap[..., 1] + gap[..., 2]


def added(held: np.ndarray, width: int) -> np.ndarray:
    """Sums of each column, of a number of rows that width divides. Eight columns are added at a time, a byte each, over no
    more rows than a byte can count."""
    lanes = np.add.reduce(held.view(np.uint64).reshape(width, -1), axis=0)
    return lanes.view(np.uint8).reshape(-1, held.shape[1]).sum(axis=0, dtype=np.int64)


def counts_within(own: np.ndarray, there: list[np.ndarray], squares: np.ndarray, box: float) -> np.ndarray:
    """How many points of all arrays there lie within each squared radius of each point of own; all are in tile order.

    A tile of which all points lie within a radius of a whole tile of own, or none do, is counted whole. Others are compared
    by a product of matrices in single precision, and what its error leaves open by the exact distance.
    """
    n, single, columns = len(squares), np.float32, 2 * TILE
    width = -(-max(int(np.diff(tile_edges(len(t))).max()) for t in there) // 8) * 8
    places, sizes = [], []
    for t in there:
        edges = tile_edges(len(t))
        places.append(t.T[:, np.minimum(edges[:-1, None] + np.arange(width), edges[1:, None] - 1)])  # the last point stands in for none
        sizes.append(np.diff(edges))
    tiles, sizes = np.concatenate(places, axis=1), np.concatenate(sizes)  # axis, tile, point
    none = np.arange(width) >= sizes[:, None]
    low_side, high_side = tiles.min(axis=2), tiles.max(axis=2)
    middle, half = (low_side + high_side) / 2, (high_side - low_side) / 2
    reach, out, edges = math.sqrt(squares[-1]), np.zeros((len(own), n), np.int64), tile_edges(len(own), columns)
    d2 = np.empty((TILES * width, columns), single)
    within, maybe = np.empty(d2.shape, bool), np.empty(d2.shape, bool)
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        p, counts = own[first:last], np.zeros((n, columns), np.int64)
        at = (p.min(axis=0) + p.max(axis=0))[:, None] / 2
        both = half + (p.max(axis=0) - p.min(axis=0))[:, None] / 2 + SLACK * box
        gap = np.abs(middle - at)
        gap = np.minimum(gap, box - gap)
        near, far = np.maximum(gap - both, 0), np.minimum(gap + both, box / 2)
        low = np.searchsorted(squares, (near * near).sum(axis=0) * (1 - SLACK))
        high = np.searchsorted(squares, (far * far).sum(axis=0) * (1 + SLACK))
        counts += np.bincount(high, sizes, n + 1)[:n].cumsum().astype(np.int64)[:, None]
        crossing = np.flatnonzero(low < high)
        # Where a point may be near by two images, one shift for the whole tile does not do.
        twice = ((gap + both)[:, crossing] >= box - reach).any(axis=0)
        a = p.T - at
        a2 = (a * a).sum(axis=0)
        factors = np.full((5, columns), np.inf, single)  # what is no point has nothing within
        factors[:4], factors[3] = 0, 1
        factors[:3, : len(p)], factors[4, : len(p)] = -2 * a, a2
        kinds = (low[crossing] * (n + 1) + high[crossing]) * 2 + twice
        order = np.argsort(kinds, kind="stable")
        starts = np.flatnonzero(np.diff(kinds[order], prepend=-1))
        for group in np.split(order, starts[1:]) if len(order) else []:
            kind, chosen = int(kinds[group[0]]), crossing[group]
            between = range(kind // 2 // (n + 1), kind // 2 % (n + 1))
            if kind % 2:
                for some in (chosen[i : i + TILES] for i in range(0, len(chosen), TILES)):
                    exact = distances2(tiles[:, some].reshape(3, -1).T, p, box)
                    exact[none[some].ravel()] = np.inf
                    for k in between:
                        counts[k, : len(p)] += (exact <= squares[k]).sum(axis=0)
                continue
            met, centre = tiles[:, chosen], middle[:, chosen]
            b = met - (at + box * np.round((centre - at) / box))[:, :, None]
            b2 = b[0] * b[0] + b[1] * b[1] + b[2] * b[2]
            # Rounded coordinates, squares, products and their sums: seven units of the square of both lengths, and the bounds' own.
            error = (math.sqrt(a2.max()) + math.sqrt(b2.max())) ** 2 * 10 * 2.0**-24
            b2[none[chosen]] = np.inf
            rows, met = np.ones((5, b2.size), single), met.reshape(3, -1)
            rows[:3], rows[3] = b.reshape(3, -1), b2.ravel()
            for start in range(0, b2.size, TILES * width):
                m = min(TILES * width, b2.size - start)
                np.matmul(rows[:, start : start + m].T, factors, out=d2[:m])
                for k in between:
                    np.less_equal(d2[:m], single(squares[k] - error), out=within[:m])
                    np.less_equal(d2[:m], single(squares[k] + error), out=maybe[:m])
                    sure, most = added(within[:m], width), added(maybe[:m], width)
                    counts[k] += sure
                    for column in np.flatnonzero(sure != most):
                        row = np.flatnonzero(within[:m, column] != maybe[:m, column])
                        counts[k, column] += (pairs2(p[column], met[:, start + row].T, box) <= squares[k]).sum()
        out[first:last] = counts.T[: len(p)]
    return out


def own_within(own: np.ndarray, xyz: np.ndarray, ids: np.ndarray, there: np.ndarray, squares: np.ndarray, box: float) -> np.ndarray:
    """How many of the points there with a point's own id lie within each squared radius of it."""
    order = np.argsort(ids, kind="stable")
    first, last = np.searchsorted(ids[order], own), np.searchsorted(ids[order], own, "right")
    times = last - first
    row = np.repeat(np.arange(len(own)), times)
    same = order[np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + first[row]]
    d2 = pairs2(xyz[row], there[same], box)
    return np.stack([np.bincount(row[d2 <= s], minlength=len(own)) for s in squares], axis=1)


def tree_counts(centres: DataFrame, points: DataFrame, radii: list[float], box: float, leaf: int | None = None) -> DataFrame:
    """center, r_index, radius, count: points within each radius (inclusive) of each centre, itself left out.

    Every centre has a row for every radius. A leaf is by default a large block, so points travel to some tens of blocks
    however many there are, and tasks compare small tiles of the blocks that they hold, see counts_within. A cell, or a
    tile, that lies between two radii as seen from a whole leaf, or tile, of centres is counted whole.
    """
    require(radii == sorted(radii) and 0 < radii[0] and radii[-1] < box / 2, "radii must ascend, to less than half the box")
    size = lambda df: leaf or min(max(LEAST, 3 * df.count() // (2 * LEAVES)), MOST)
    held = size(points)
    to = cell_tree(points, box, held, tiled=True)
    from_ = to if centres is points else cell_tree(centres, box, size(centres), tiled=True)
    n, squares = len(radii), np.array([r * r for r in radii])
    shell = lambda d2: reduce(lambda a, b: a + b, [F.when(d2 > s, 1).otherwise(0) for s in squares.tolist()])

    def judge(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter(F.col("low2") <= float(squares[-1])).withColumns({"low": shell(F.col("low2")), "high": shell(F.col("high2"))})
        return pairs.withColumn("settled", (F.col("low") == F.col("high")) & (F.col("low2") > 0))  # cells that touch may hold the centre itself

    pairs, settled = descend(as_sources(from_), to, judge)
    whole = settled.groupBy("leaf", "low").agg(F.sum("n").alias("n")).groupBy("leaf").agg(F.collect_list(F.struct("low", "n")).alias("whole"))
    columns = [f"s{i}" for i in range(n)]
    schema = "center long, " + ", ".join(f"{c} long" for c in columns)

    def rows_of(ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        return [pa.array(ids), *[pa.array(np.ascontiguousarray(counts[:, i])) for i in range(n)]]

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                sums = np.zeros(n, np.int64)
                for w in row["whole"] or []:
                    sums[w["low"]] += w["n"]
                yield pa.RecordBatch.from_arrays(rows_of(ids, np.tile(sums, (len(ids), 1))), names=["center", *columns])

    def between(key, left: pa.Table, right: pa.Table) -> pa.Table:
        source = left.slice(0, 1).to_pylist()[0]
        own, xyz = unpacked(source["ids"], source["xyz"])
        others = [unpacked(r["other_ids"], r["other_xyz"]) for r in right.to_pylist()]
        upto = counts_within(xyz, [o[1] for o in others], squares, box)
        upto -= own_within(own, xyz, np.concatenate([o[0] for o in others]), np.concatenate([o[1] for o in others]), squares, box)
        return pa.table(rows_of(own, np.diff(upto, axis=1, prepend=0)), names=["center", *columns])

    base = from_.leaves.select("leaf", "ids").join(whole, "leaf", "left").select("ids", "whole").mapInArrow(all_of, schema)
    chunks = chunked(pairs, to, max(1, min(CHUNK, MET // held)))
    left = chunks.select("leaf", F.col("chunk").alias("own_chunk")).distinct().join(from_.leaves.select("leaf", "ids", "xyz"), "leaf")
    met = left.withColumnRenamed("leaf", "own_leaf").groupBy("own_leaf", "own_chunk").cogroup(chunks.groupBy("leaf", "chunk")).applyInArrow(between, schema)
    sums = base.unionByName(met).groupBy("center").agg(*[F.sum(c).alias(c) for c in columns])
    upto = [F.struct(F.lit(i).alias("r_index"), F.lit(float(r)).alias("radius"), reduce(lambda a, b: a + b, [F.col(c) for c in columns[: i + 1]]).alias("count")) for i, r in enumerate(radii)]
    return sums.select("center", F.explode(F.array(*upto)).alias("e")).select("center", "e.*")
