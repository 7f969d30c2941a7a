"""Incremental work on traces and catalogues that arrive as files."""

from .reservoir import read_sample, reservoirs, sample_stream
from .traces import ingest_traces, running_summary, trace_stream

__all__ = ["ingest_traces", "read_sample", "reservoirs", "running_summary", "sample_stream", "trace_stream"]
