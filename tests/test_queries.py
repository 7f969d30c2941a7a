"""Registered queries against their SQL in an independent engine."""

import os
from pathlib import Path

import duckdb
import pytest

from perigraph.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: A query of each kind; PERIGRAPH_ALL=1 runs every one.
SOME = ["a3_points", "a4_array", "a6_sparse_matrix", "b5_reservoir", "d6_kept_states", "d10_single_source", "e7_orders", "k2_counts_in_spheres", "k4_radii", "m9_three_way", "m12_bias", "n9_float_wrap", "b2_top_threshold", "b4_exact_top", "b7_cube", "b16_keep_last", "c3_neighbours", "c5_radius_graph", "c7_gaussian_graph", "c18_asymmetric", "d4_trace", "e4_time_summary", "f1_spectral_dimension", "f3_shifted_window", "f7_gradient_dimension", "g5_bootstrap_bands", "h2_interpolated_crossing", "h9_truncation", "i9_lengths_at", "i12_containment", "j1_diffusion_distances", "k7_bootstrap_scales", "l3_transform", "l5_shell_spectrum", "m2_log_derivatives", "n5_mesh_at_points", "o2_pair_counts", "o8_kaplan_meier", "q_set_operations"]


@pytest.fixture(scope="module")
def engine():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    # An integer column with nulls comes as floats from one engine and as integers from the other.
    text = lambda v: "-" if v is None or v != v else repr(round(float(v), 6) + 0.0) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL) if os.environ.get("PERIGRAPH_ALL") else SOME)
def test_query_matches_sql(spark, engine, name):
    got, want = QUERIES[name](spark, SF).toPandas(), engine.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_is_callable():
    assert len(QUERIES) > 110
    assert set(ORACLE_SQL) <= set(QUERIES)
