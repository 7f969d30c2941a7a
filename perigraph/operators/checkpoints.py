"""The life of saved states: committed one at a time by a manifest, the last few kept, the rest removed.

A state is a folder of its own; it counts once a manifest names it. A manifest is a file that is written whole under
another name and then renamed, its number one above the last, so a run that is killed leaves the states of the manifest
before it and folders that none names, which the next run removes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_table, materialize_by, require
from ..sources.files import append_times
from .blocks import block_trace, from_blocks, graph_blocks, propagate_blocks, to_blocks
from .diffusion import propagate, trace_estimates, transition


class StateLog:
    """Saved states in a folder of any store that Spark reads; state 0 and the last keep stay."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2) -> None:
        require(keep > 0, "at least one state must stay")
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.system.mkdirs(self.path(f"{self.folder}/states"))
        self.system.mkdirs(self.path(f"{self.folder}/manifests"))

    def names(self, kind: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(f"{self.folder}/{kind}")))

    def manifest(self) -> tuple[int, list[dict]]:
        """Number and states of the last manifest."""
        numbers = [int(n.removesuffix(".json")) for n in self.names("manifests") if n.endswith(".json")]
        if not numbers:
            return 0, []
        text = self.spark.read.text(f"{self.folder}/manifests/{max(numbers):012d}.json", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def times(self) -> list[int]:
        return sorted(s["time"] for s in self.manifest()[1])

    def read(self, time: int) -> DataFrame:
        state = next(s for s in self.manifest()[1] if s["time"] == time)
        return self.spark.read.parquet(f"{self.folder}/states/{state['name']}")

    def put(self, time: int, state: DataFrame) -> None:
        """Saves a state and commits it; states beyond the kept ones go, and manifests before the last two."""
        number, states = self.manifest()
        require(time not in [s["time"] for s in states], f"the state of {time} is there already")
        name = f"step={time}-{uuid.uuid4().hex}"
        state.write.mode("error").parquet(f"{self.folder}/states/{name}")
        rows = self.spark.read.parquet(f"{self.folder}/states/{name}").count()
        states = sorted([*states, {"time": time, "name": name, "rows": rows}], key=lambda s: s["time"])
        kept = [s for s in states[: -self.keep] if s["time"] == 0] + states[-self.keep :]
        self.commit(number + 1, kept)
        self.clean()

    def commit(self, number: int, states: list[dict]) -> None:
        draft = self.path(f"{self.folder}/manifests/.draft-{uuid.uuid4().hex}")
        out = self.system.create(draft, False)
        out.write(bytearray(json.dumps(states).encode()))
        out.close()
        require(self.system.rename(draft, self.path(f"{self.folder}/manifests/{number:012d}.json")), f"manifest {number} is there already")

    def clean(self) -> int:
        """Removes folders that the last manifest does not name, drafts and old manifests; returns how many states went."""
        number, states = self.manifest()
        stray = set(self.names("states")) - {s["name"] for s in states}
        for name in stray:
            self.system.delete(self.path(f"{self.folder}/states/{name}"), True)
        for name in self.names("manifests"):
            if not name.endswith(".json") or int(name.removesuffix(".json")) < number - 1:
                self.system.delete(self.path(f"{self.folder}/manifests/{name}"), False)
        return len(stray)


def resumable_trace(edges: DataFrame, degree: DataFrame, initial: DataFrame, folder: str, times: list[int], every: int = 8, keep: int = 2, blocks: DataFrame | None = None, depth: int = 4) -> DataFrame:
    """Trace estimates at the times, appended to a table in the folder as they are found, with a state saved every so often.

    A run that was killed goes on from the last saved state at or below its first missing time; estimates are appended once
    per time and probe. After the run the folder holds the table, state 0 and the last keep states, and the catalog nothing.
    """
    spark, log = edges.sparkSession, StateLog(initial.sparkSession, folder, keep)
    log.clean()
    if 0 not in log.times():
        log.put(0, initial)
    start_state, table = log.read(0), f"{folder.rstrip('/')}/trace"
    there = log.system.exists(log.path(f"{table}/_SUCCESS"))
    found = {r[0] for r in spark.read.parquet(table).select("diffusion_time").distinct().collect()} if there else set()
    missing = sorted(set(times) - found)
    width = len(initial.columns) - 1
    if missing:
        start = max(t for t in log.times() if t <= missing[0])
        if start == missing[0]:  # a saved state is evaluated as it is
            append_times(trace_estimates(start_state, log.read(start), start), table)
        stops = sorted({t for t in missing if t > start} | {t for t in range(start + 1, missing[-1] + 1) if t % every == 0})
        walk = materialize_by(transition(edges, degree), "walk", "dst")
        if blocks is None:
            runs, first, graph = propagate(walk, log.read(start), stops, start), None, None
        else:
            graph = graph_blocks(walk, blocks, depth)
            first, held = to_blocks(start_state, graph), to_blocks(log.read(start), graph)
            runs = propagate_blocks(graph, held, stops, width, start)
        last = None
        for time, state in runs:
            if time in missing:
                append_times(trace_estimates(start_state, state, time) if graph is None else block_trace(first, state, time, width), table)
            if time % every == 0 and time not in log.times():
                log.put(time, state if graph is None else from_blocks(state, graph, [c for c in initial.columns if c != "id"]))
            if last is not None and graph is None:
                drop_table(last)
            last = state
        for t in [last if graph is None else None, walk, *([first, held] if graph else [])]:
            if t is not None:
                drop_table(t)
        if graph:
            graph.drop()
    return spark.read.parquet(table).filter(F.col("diffusion_time").isin(list(times)))
