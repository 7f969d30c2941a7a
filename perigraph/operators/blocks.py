"""Propagation by graph blocks: several steps for one exchange of halo values.

Nodes are cut into blocks along a space-filling curve. A block holds the compressed rows of its own nodes and of the halo
around them, so that with halo layers of depth s it can take s steps alone; then it needs the halo's values anew. A round
of s steps thus shuffles each halo value once, packed, and nothing else: rows and own values stay where they are, in tables
bucketed by block. States are tables too, and each is removed when the next one is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_table, materialize, materialize_by, require

#: Own nodes of a block, about.
BLOCK_NODES = 1 << 14
#: Edges that a block may hold with its halo; depth is lowered until the largest block holds no more.
MOST_EDGES = 1 << 21


def morton_code(box: float, bits: int = 16) -> Column:
    """The place of x, y, z in [0, box) on a space-filling curve: the bits of their cells, interleaved."""
    cells = {c: f"cast(least(floor({c} / {float(box)!r}D * {1 << bits}), {(1 << bits) - 1}) as bigint)" for c in "xyz"}
    return F.expr(" | ".join(f"shiftleft(shiftright({cells[c]}, {b}) & 1L, {3 * b + axis})" for axis, c in enumerate("xyz") for b in range(bits)))


def cut_by(nodes: DataFrame, order: Column, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """id, block: runs of block_nodes nodes in this order (ties by id), numbered over the cluster by slices of the order."""
    keyed = nodes.select("id", order.alias("order"))
    curve = keyed.repartitionByRange("order", "id").sortWithinPartitions("order", "id").withColumn("at", F.monotonically_increasing_id())
    rows = materialize(curve.drop("order"), "curve")
    runs = rows.groupBy(F.shiftright("at", 33).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    skip = runs.select("slice", (before - F.shiftleft("slice", 33)).alias("skip"))  # a row for each slice
    return rows.withColumn("slice", F.shiftright("at", 33)).join(F.broadcast(skip), "slice").select("id", F.expr(f"(at + skip) div {block_nodes}").alias("block"))


@dataclass
class GraphBlocks:
    """shape: a row for each block with its nodes and compressed rows; sends: for each pair of blocks the own nodes of the
    first that the second's halo holds; depth: steps for one exchange."""

    shape: DataFrame
    sends: DataFrame
    nodes: DataFrame
    depth: int
    tables: list[DataFrame] = field(default_factory=list)

    def drop(self) -> None:
        for t in self.tables:
            drop_table(t)


def halo(walk: DataFrame, blocks: DataFrame, depth: int) -> DataFrame:
    """block, id, layer: the own nodes of each block (0) and what is reached from them in up to depth steps."""
    reached = blocks.select("block", "id", F.lit(0).alias("layer"))
    last = reached
    for layer in range(1, depth + 1):
        ahead = last.join(walk.select(F.col("src").alias("id"), "dst"), "id").select("block", F.col("dst").alias("id")).distinct()
        last = materialize(ahead.join(reached.select("block", "id"), ["block", "id"], "left_anti").withColumn("layer", F.lit(layer)), f"halo-{layer}")
        reached = reached.unionByName(last)
    return materialize(reached, "halo")


def pack(table: pa.Table, depth: int) -> pa.Table:
    """One block from its nodes (src null: id, layer, owner) and its edges (src, id, p).

    Nodes stand by layer; the order in which halo values arrive is by owner, then by id.
    """
    flat = {c: table[c].combine_chunks() for c in table.column_names}
    is_node = np.asarray(flat["src"].is_null())
    ids, layers, owners = (flat[c].filter(pa.array(is_node)).to_numpy() for c in ("id", "layer", "owner"))
    order = np.lexsort((ids, layers))
    ids, layers, owners = ids[order], layers[order], owners[order]
    src, dst, p = (flat[c].filter(pa.array(~is_node)).to_numpy() for c in ("src", "id", "p"))
    by_id = np.argsort(ids)
    row, column = (by_id[np.searchsorted(ids, x, sorter=by_id)] for x in (src, dst))
    order = np.lexsort((column, row))
    rows = int(np.searchsorted(layers, depth, "left"))  # nodes whose own rows are held
    pointers = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    ghosts = np.flatnonzero(layers > 0)
    arrival = ghosts[np.lexsort((ids[ghosts], owners[ghosts]))]
    bounds = np.searchsorted(layers, np.arange(depth + 1), "right")
    packed = [ids[: bounds[0]].astype("<i8"), bounds.astype("<i8"), arrival.astype("<i4"), pointers.astype("<i8"), column[order].astype("<i4"), p[order].astype("<f8")]
    names = ["own", "bounds", "arrival", "pointers", "columns", "p"]
    return pa.table({"block": flat["block"].slice(0, 1), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(names, packed, strict=True)}})


SHAPE = "block long, own binary, bounds binary, arrival binary, pointers binary, columns binary, p binary"


def graph_blocks(walk: DataFrame, blocks: DataFrame, depth: int = 4, most_edges: int = MOST_EDGES) -> GraphBlocks:
    """Blocks (id, block) of a walk (src, dst, p) with halos of so many layers, or of fewer if a block would grow too large.

    Every node of the walk must be in blocks. A node that is linked to a large share of all nodes makes every block large; such graphs are refused and propagated by
    diffusion.propagate, whose joins split hubs.
    """
    blocks = materialize(blocks, "blocks")
    while True:
        reached = halo(walk, blocks, depth)
        held = reached.filter(F.col("layer") < depth).join(walk.select(F.col("src").alias("id"), "dst", "p"), "id")
        held = materialize(held.select("block", F.col("id").alias("src"), F.col("dst").alias("id"), "p"), "block-edges")
        largest = held.groupBy("block").count().agg(F.max("count")).first()[0] or 0
        if largest <= most_edges:
            break
        require(depth > 1, f"a block would hold {largest} edges, over {most_edges}")
        depth -= 1
    members = reached.join(blocks.select("id", F.col("block").alias("owner")), "id")
    both = members.select("block", F.lit(None).cast("long").alias("src"), "id", F.lit(None).cast("double").alias("p"), "layer", "owner").unionByName(held.select("block", "src", "id", "p", F.lit(None).cast("int").alias("layer"), F.lit(None).cast("long").alias("owner")))
    shape = materialize_by(both.groupBy("block").applyInArrow(lambda t: pack(t, depth), SHAPE), "shape", "block", dealt=True)
    sends = members.filter("layer > 0").groupBy(F.col("owner").alias("block"), F.col("block").alias("to")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    sends = materialize_by(sends, "sends", "block")
    return GraphBlocks(shape, sends, blocks, depth, [shape, sends])


def to_blocks(state: DataFrame, graph: GraphBlocks) -> DataFrame:
    """block, y: the values of each block's own nodes in the order of their ids, a row of probes for each node, packed."""
    columns = [c for c in state.columns if c != "id"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        y = np.stack([table[c].to_numpy() for c in columns], axis=1)
        return pa.table({"block": table["block"].combine_chunks().slice(0, 1), "y": pa.array([y.astype("<f8").tobytes()], pa.binary())})

    wide = state.join(graph.nodes, "id").select("block", "id", *[F.col(c).cast("double").alias(c) for c in columns])
    return materialize_by(wide.groupBy("block").applyInArrow(run, "block long, y binary"), "block-state", "block", dealt=True)


def from_blocks(state: DataFrame, graph: GraphBlocks, columns: list[str]) -> DataFrame:
    """id and a column for each probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, y in zip(batch.column(0), batch.column(1), strict=True):
                values = np.frombuffer(y.as_py(), "<f8").reshape(-1, len(columns))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(own.as_py(), "<i8")), *[pa.array(np.ascontiguousarray(v)) for v in values.T]], names=["id", *columns])

    return state.join(graph.shape.select("block", "own"), "block").select("own", "y").mapInArrow(run, "id long, " + ", ".join(f"`{c}` double" for c in columns))


def exchange(state: DataFrame, graph: GraphBlocks) -> DataFrame:
    """block (the receiver), sender, y: the values that each block's halo needs, packed by sender."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, y, ids in zip(batch.column("own"), batch.column("y"), batch.column("ids"), strict=True):
                nodes = np.frombuffer(own.as_py(), "<i8")
                values = np.frombuffer(y.as_py(), "<f8").reshape(len(nodes), -1)
                out.append(values[np.searchsorted(nodes, ids.values.to_numpy())].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("to"), batch.column("block"), pa.array(out, pa.binary())], names=["block", "sender", "y"])

    own = state.join(graph.shape.select("block", "own"), "block").join(graph.sends, "block")
    return own.select("block", "own", "y", "to", "ids").mapInArrow(run, "block long, sender long, y binary")


def take_steps(shape: dict[str, np.ndarray], y: np.ndarray, halo_values: np.ndarray, steps: int) -> np.ndarray:
    """A block's own values after so many steps; each step is right for one layer less."""
    bounds, pointers, columns, p = shape["bounds"], shape["pointers"], shape["columns"], shape["p"]
    x = np.zeros((bounds[-1], y.shape[1]))
    x[: len(y)] = y
    x[shape["arrival"]] = halo_values
    for done in range(1, steps + 1):
        rows = bounds[steps - done]
        cuts = pointers[: rows + 1]
        products = p[: cuts[-1], None] * x[columns[: cuts[-1]]]
        sums = np.zeros((rows, x.shape[1]))
        filled = np.flatnonzero(np.diff(cuts))
        if len(filled):
            sums[filled] = np.add.reduceat(products, cuts[filled], axis=0)
        x[:rows] = sums
    return x[: len(y)]


def round_of(state: DataFrame, graph: GraphBlocks, steps: int, width: int) -> DataFrame:
    """The state after steps (at most the halo's depth); the only shuffle is that of the exchange."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0]
        kinds = {"bounds": "<i8", "arrival": "<i4", "pointers": "<i8", "columns": "<i4", "p": "<f8"}
        shape = {n: np.frombuffer(row[n], t) for n, t in kinds.items()}
        arrived = right.sort_by("sender")["y"].to_pylist() if right.num_rows else []
        values = np.frombuffer(b"".join(arrived), "<f8").reshape(-1, width)
        out = take_steps(shape, np.frombuffer(row["y"], "<f8").reshape(-1, width), values, steps)
        return pa.table({"block": pa.array([row["block"]], pa.int64()), "y": pa.array([out.tobytes()], pa.binary())})

    own = graph.shape.drop("own").join(state, "block")
    return own.groupBy("block").cogroup(exchange(state, graph).groupBy("block")).applyInArrow(run, "block long, y binary")


def propagate_blocks(graph: GraphBlocks, state: DataFrame, times: list[int], width: int, start: int = 0) -> Iterator[tuple[int, DataFrame]]:
    """Yields (time, state by blocks) at each requested time above start. A state is removed once the next is asked for, and
    one between requested times once it has been used; start's own stays."""
    done, given = start, None
    for time in sorted(t for t in set(times) if t > start):
        while done < time:
            steps = min(graph.depth, time - done)
            after = materialize_by(round_of(state, graph, steps, width), f"block-state-{done + steps}", "block", dealt=True)
            if given is not None:
                drop_table(given)
            state = given = after
            done += steps
        yield time, state
    if given is not None:
        drop_table(given)


def block_trace(initial: DataFrame, state: DataFrame, time: int, width: int) -> DataFrame:
    """diffusion_time, probe_index, individual_trace_estimate, like diffusion.trace_estimates, from states by blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                sums = (np.frombuffer(a.as_py(), "<f8") * np.frombuffer(b.as_py(), "<f8")).reshape(-1, width).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(sums)], names=["probe_index", "part"])

    pairs = initial.join(state.withColumnRenamed("y", "later"), "block").select("y", "later").mapInArrow(run, "probe_index int, part double")
    return pairs.groupBy("probe_index").agg((width * F.sum("part")).alias("individual_trace_estimate")).select(F.lit(time).alias("diffusion_time"), "probe_index", "individual_trace_estimate")


def state_after(walk: DataFrame, blocks: DataFrame, initial: DataFrame, time: int, depth: int = 4) -> DataFrame:
    """The state after so many steps, a table; nothing else of the run is left."""
    columns = [c for c in initial.columns if c != "id"]
    graph = graph_blocks(walk, blocks, depth)
    first = to_blocks(initial, graph)
    out = initial
    for _, state in propagate_blocks(graph, first, [time], len(columns)):
        out = materialize(from_blocks(state, graph, columns), "state")
    drop_table(first)
    graph.drop()
    return out


def return_trace_by_blocks(walk: DataFrame, blocks: DataFrame, initial: DataFrame, times: list[int], depth: int = 4) -> DataFrame:
    """Trace estimates at the times, a table; nothing of the run is left but this table's folder."""
    graph, width = graph_blocks(walk, blocks, depth), len(initial.columns) - 1
    first = to_blocks(initial, graph)
    parts = [materialize(block_trace(first, first, 0, width), "trace")] if 0 in times else []
    for time, state in propagate_blocks(graph, first, times, width):
        parts.append(materialize(block_trace(first, state, time, width), "trace"))
    drop_table(first)
    graph.drop()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
