"""Exact, substring and near dedup against brute force."""

import hashlib
import random
import string

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from perigraph.llm import exact_dedup as exact
from perigraph.llm import shingle_join, simhash
from perigraph.llm import substring_dedup as sub
from perigraph.llm.components import connected_components

from .rows import ODD

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
NULL = -(10**18)


@given(st.lists(st.lists(st.integers(0, 2**24 - 1), min_size=1, max_size=60), min_size=1, max_size=4))
def test_filters_merge_without_loss(parts):
    blobs, want = [], {}
    for part in parts:
        keys, counts = np.unique(np.array(part, np.uint64), return_counts=True)
        blob = exact.cqf_encode(keys, counts.astype(np.uint64), 16)
        again = exact.cqf_decode(blob, 16)
        assert again[0].tolist() == keys.tolist() and again[1].tolist() == counts.tolist()
        blobs.append(blob)
        for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
            want[k] = want.get(k, 0) + c
    keys, counts = exact.cqf_merge(blobs, 16)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(NULL if i is None else i)
    return sorted((NULL if i is None else i, max(g := groups[(t or "").translate(LOWER)]), len(g), (NULL if i is None else i) == max(g), hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()) for i, t in rows)


def found_exact(df):
    null = lambda v: NULL if v is None else v
    return sorted((null(r["doc_id"]), null(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def test_exact(odd_docs, prose_docs, prose, empty_docs):
    assert found_exact(exact.exact_dedup(odd_docs)) == brute_exact(ODD)
    assert found_exact(exact.exact_dedup(prose_docs)) == brute_exact(prose)
    assert exact.exact_dedup(empty_docs).count() == 0


def test_equal_fingerprints_are_compared_by_bytes(prose_docs, prose, monkeypatch):
    """Even when every text has one fingerprint, only equal texts are grouped."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(exact.F, "xxhash64", lambda *a: F.lit(7).cast("long") + real(*a) * 0)
    assert found_exact(exact.exact_dedup(prose_docs)) == brute_exact(prose)


SPLIT = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in "".join("\n" if c in SPLIT else c for c in text or "").split("\n") if w]


def brute_substring(rows):
    first, out = {}, []
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 10**18), NULL if i is None else i)
    for i, t in rows:
        own, w, gone = NULL if i is None else i, words_of(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < own:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((own, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("block", [None, 700])
def test_substring(odd_docs, prose_docs, prose, empty_docs, monkeypatch, block):
    if block:  # many blocks and several shards
        monkeypatch.setattr(sub, "BLOCK_CHARS", block)
        monkeypatch.setattr(sub, "SHARD_BITS", 12)
        monkeypatch.setattr(sub, "HASH_BYTES", 500)
    found = lambda df: sorted((NULL if r[0] is None else r[0], *r[1:]) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect())
    assert found(sub.substring_dedup(prose_docs)) == brute_substring(prose)
    if not block:
        assert found(sub.substring_dedup(odd_docs)) == brute_substring(ODD)
        assert sub.substring_dedup(empty_docs, with_text=False).count() == 0


def test_windows_do_not_cross_texts():
    import pyarrow as pa

    texts = ["a " * 12 + "b", "b c d", "", "é " * 13]
    found = sub.Windows(pa.chunked_array([pa.array(texts)]))
    assert found.at.tolist() == [0, 16] and found.owner.tolist() == [0, 3] and found.bounds.tolist() == [0, 13, 16, 16, 29]


def brute_fingerprint(text):
    w = [x.translate(LOWER) for x in words_of(text)]
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_simhash(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    found = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for (i, _), c in zip(rows, found, strict=True):
        least[c] = min(least.get(c, 10**18), 10**18 if i is None else i)
    return sorted((NULL if i is None else i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, found, strict=True))


def test_simhash(odd_docs, prose_docs, prose, empty_docs):
    found = lambda df: sorted((NULL if r["doc_id"] is None else r["doc_id"], r["fingerprint"], 10**18 if r["component_id"] is None else r["component_id"]) for r in df.collect())
    assert found(simhash.simhash_near_dedup(prose_docs)) == brute_simhash(prose)
    assert found(simhash.simhash_near_dedup(odd_docs)) == brute_simhash(ODD)
    assert simhash.simhash_near_dedup(empty_docs).count() == 0


def near(rng, centre, most):
    return centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most)))


def test_finer_masks_lose_no_pair():
    """Three splits, whichever masks are taken: a pair within 3 bits agrees on a finer mask each time, and 9 bits stay free."""
    rng, free = random.Random(1), []
    for _ in range(300):
        other = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        mask = 0
        for _ in range(3):
            mask = rng.choice([x for x in simhash.finer(mask) if not x & other])
        free.append(64 - mask.bit_count())
    assert 3 <= min(free) and max(free) <= 9


@pytest.mark.parametrize("limit", [10**9, 20, 9])
def test_links(spark, monkeypatch, limit):
    """Links are all pairs within 3 bits, however often groups are split; groups keep their bound; pivots discard pairs, none that links."""
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(3)]
    # Bits that vary are few in the second crowd, so that its groups stay crowded for long.
    prints = list(dict.fromkeys([near(rng, c, 6) for c in centres[:2] for _ in range(40)] + [centres[2] ^ sum(rng.getrandbits(1) << b for b in (1, 2, 30, 31, 50, 63)) for _ in range(60)]))
    monkeypatch.setattr(simhash, "PAIR_GROUP", limit)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    pairs = {(simhash.signed(p), simhash.signed(q)): (p ^ q).bit_count() <= 3 for p in prints for q in prints if simhash.signed(p) < simhash.signed(q)}
    assert len(got) == len(set(got)) and set(got) == {x for x, linked in pairs.items() if linked}
    sizes = [r["count"] for r in simhash.groups(df).distinct().groupBy("mask", "bits").count().collect()]
    assert 2 <= min(sizes) and max(sizes) <= limit
    met = {(r["a"], r["b"]): r["discarded"] for r in simhash.candidates(df).collect()}
    assert set(got) <= set(met) and any(met.values()) and not any(met[x] for x in got)


def test_crowded_key(spark):
    """5,000 fingerprints that share half of their bits: groups are split, and pivots, not all pairs, decide."""
    rng = np.random.default_rng(5)
    low = rng.integers(0, 2**10, (5000, 2)) @ np.array([1, 2**12])
    prints = np.unique(low)
    df = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    assert simhash.groups(df).groupBy("mask", "bits").count().agg({"count": "max"}).first()[0] <= simhash.PAIR_GROUP
    want = set()
    for p in prints:
        want |= {(int(p), int(q)) for q in prints[(np.bitwise_count(prints ^ p) <= 3) & (prints > p)]}
    rows = simhash.links(df).collect()
    assert len(rows) == len(want) and {(r["a"], r["b"]) for r in rows} == want
    told = {r["discarded"]: r["count"] for r in simhash.candidates(df).groupBy("discarded").count().collect()}
    assert told[True] > 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=25))
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    want = components(15, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in connected_components(df).collect()} == {x: want[x] for x in touched}


def brute_similar(texts, words=5, share=0.8):
    def shingles(text):
        own = text.lower().split()
        return {" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()

    sets = [shingles(t) for t in texts]
    return components(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]) - 1e-9])


@pytest.mark.parametrize("block", [1024, 16])
def test_similar_components(spark, odd_docs, empty_docs, monkeypatch, block):
    """A crowd of near copies of all degrees of similarity, chains, and plain texts, against all pairs."""
    monkeypatch.setattr(shingle_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(shingle_join, "PAIRED", 64 if block > 16 else 4)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdehiost") for _ in range(5)) for _ in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    for i in range(30):  # each alike to the one before only
        texts.append(" ".join(base[:20] + [f"chain{j}" for j in range(i * 4, i * 4 + 60)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute_similar(texts)
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.similar_components(docs).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want and len(set(want)) > 30
    assert {tuple(r) for r in shingle_join.similar_components(odd_docs).collect()} >= {(9, 9)}
    assert shingle_join.similar_components(empty_docs).count() == 0


def test_substring_of_words_with_equal_sums(spark):
    """Words whose polynomial hashes agree modulo 2**64 for every odd base, and windows brought together by hash only."""
    from .test_text import swapped_twins

    before = " ".join(f"w{i}" for i in range(12))
    for size in (1024, 4096):
        rows = [(i, f"{before} {x}") for i, x in enumerate([*swapped_twins(size), swapped_twins(size)[0]], 1)]
        got = {r["doc_id"]: r["n_removed"] for r in sub.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {1: 0, 2: 0, 3: 13}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(sub, "runs_of", lambda words, size, odd: np.zeros(max(0, len(words) - size + 1), np.uint64))
    words = lambda a, b: b" ".join(b"%d" % i for i in range(a, b))
    found = sub.least_documents([words(0, 20), words(50, 70), words(4, 18)], np.array([7, 3, 5]))
    assert [x.tolist() for x in found] == [[7, 7, 7, 7, 5, 5, 7, 7], [3] * 8, [5, 5]]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 13, 40])
def test_runs_and_least(n):
    values = np.random.default_rng(n).integers(0, 1 << 62, n).astype(np.uint64)
    for size in (1, 2, 3, 4, 10, 13):
        runs = sub.runs_of(values, size, sub.ODD[0])
        assert len(runs) == max(0, n - size + 1) and (sub.runs_of(values[1:], size, sub.ODD[0]) == runs[1:]).all()
        if n >= size:
            assert sub.least_of(values, size).tolist() == [values[i : i + size].min() for i in range(n - size + 1)]


def test_text_is_dealt_to_blocks_once(spark, prose_docs):
    """Grouping by block moves no text: the plan's scans of the blocks have no exchange above them."""
    plan = sub.substring_dedup(prose_docs)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    scans = [i for i, x in enumerate(lines) if "FileScan parquet" in x and "perigraph_blocks" in x]
    assert len(scans) >= 2 and all("Bucketed: true" in lines[i] for i in scans)
