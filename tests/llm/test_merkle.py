"""Merkle manifests against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from perigraph.llm import merkle, queries

from .conftest import with_clashes
from .rows import ODD

NULL = -(10**18)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    i, source, lang, n, text = row
    values = [i, source, lang, None if n is None else n + more, text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][at : at + 2]) for at in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    return [(at >> k & 1, level[at >> k ^ 1] if at >> k ^ 1 < len(level) else None) for k, level in enumerate(tree[:-1])]


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {x: sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in names}
    trees = {x: levels([leaf(r) for r in ordered[x]]) for x in names}
    top, out = levels([trees[x][-1][0] for x in names]), []
    for g, x in enumerate(names):
        for at, r in enumerate(ordered[x]):
            proof = siblings(trees[x], at) + siblings(top, g)
            seen = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            now = seen
            for left, other in proof:
                now = digest(now) if other is None else digest(other, now) if left else digest(now, other)
            out.append((NULL if r[0] is None else r[0], leaf(r), trees[x][-1][0], top[-1][0], digest(*[o for _, o in proof if o]), now, now == top[-1][0]))
    return sorted(out)


def found(docs):
    out = queries.merkle_columns(queries.merkle_of(docs))
    return sorted((NULL if r["doc_id"] is None else r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in out.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("digest", F.lit(1)).withColumn("place", F.lit("x")).withColumn("tree", F.lit(None).cast("int")).withColumn("size", F.lit(0))


@pytest.mark.parametrize("bits", [2, 8])
def test_against_brute_force(spark, monkeypatch, bits):
    """Groups of every small size, one large group, a null group; trees of several tiers with short ones."""
    monkeypatch.setattr(merkle, "LEVELS", bits)
    rng, rows, i = random.Random(1), [], 0
    for k, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31, 33, 300]):
        for _ in range(n):
            i += 1
            rows.append((i * 3, rng.choice([None, "s", "é"]), None if k == 5 else f"l{k}" if k % 2 else "L" * k, rng.choice([None, 0, 17, 2**63 - 1]), rng.choice([None, "", "text é", "x" * 50])))
    rows += [rows[40]] * 5 + [(None, None, None, None, None), (None, "a", "l1", 3, "z")]
    rng.shuffle(rows)
    assert found(table(spark, rows).repartition(5)) == brute(rows)


def test_odd_rows(spark):
    rows = [(i, None if i is None else "s", "en" if t else None, len(t or ""), t) for i, t in ODD]
    assert found(table(spark, rows)) == brute(rows)
    assert found(table(spark, [])) == []
    one = [(5, "a", "en", 1, "b")]
    assert found(table(spark, one)) == brute(one)
    assert merkle.merkle_manifest(with_clashes(spark, ODD), ["doc_id", "text"], group_col="source").filter("verified").count() == len(ODD)


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 3)
    rows = [(i, "s", f"g{i % 150}", i, "t") for i in range(400)]
    assert found(table(spark, rows)) == brute(rows)


def test_places_by_many_tasks(spark):
    """One group that is nearly all rows is numbered by several tasks."""
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), F.when(F.col("id") % 50 == 0, "small").otherwise("large").alias("g"))
    placed, sizes = merkle.numbered(rows, "g", ["k"], "test-order")
    want = rows.selectExpr("g", "k", "row_number() over (partition by g order by k) - 1 as place")
    assert placed.select("g", "k", "place").exceptAll(want).isEmpty()
    assert dict(sizes.select("g", "size").collect()) == {"small": 400, "large": 19_600}
