"""Decontamination against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from perigraph.llm import decontamination as leak

from .conftest import with_clashes
from .rows import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for at in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[at : at + size]), set()).add("" if i is None else str(i))
    lengths, out = {len(w) for w in windows}, []
    for i, t in rows:
        w, hit, own = words(t), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if found := windows.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    own |= found
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((-1 if i is None else i, len(w), len(hit), [tuple(s) for s in spans], sorted(own)))
    return sorted(out)


def found(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"]) for r in df.collect())


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


@pytest.fixture(scope="module")
def corpus():
    """Documents over few words, so that shingles are common, with passages of items in other case and between other signs."""
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "to", "É", "é", "Straße", "ΑΣ", "ας", "42", "naïve", "K", "k"] + [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(11, 40))) for i in range(25)] + [(30, "the of"), (31, "w1"), (32, "AND to the"), (33, None), (34, " ?! "), (None, text(14)), (2, text(12))]
    items += [(40, items[0][1]), (41, items[0][1].upper()), (42, "a a a a a a a a a a a a a")]
    rows = [(i, text(rng.randint(0, 60))) for i in range(80)]
    for i in range(80, 140):
        w = rng.choice([t for _, t in items if t]).split()
        a = rng.randrange(len(w))
        part = w[a : a + rng.randint(5, 30)]
        rows.append((i, text(rng.randint(0, 9)) + rng.choice([" ", "-", "\n.", "'"]) + rng.choice([" ", ", ", "'", "\t"]).join(part) + " " + text(rng.randint(0, 9))))
    rows += [(i, (items[3][1] + ". ").title()) for i in range(140, 150)] + [(150, "a " * 500), (151, "ΑΣ'w1 the of"), (9, rows[9][1])]
    return rows + [(i + 200 if i is not None else None, t) for i, t in ODD if i is None or i != 6], items


@pytest.mark.parametrize("limit", [leak.BROADCAST_BYTES, 0])
def test_against_brute_force(spark, corpus, limit):
    rows, items = corpus
    assert found(leak.decontaminate(with_clashes(spark, rows).repartition(3), bench(spark, items), broadcast_bytes=limit)) == brute(rows, items)


def test_long_items_only(spark, corpus):
    rows, items = corpus
    items = [(i, t) for i, t in items if len(words(t)) >= 10]
    got = found(leak.decontaminate(with_clashes(spark, rows), bench(spark, items)))
    assert got == brute(rows, items) and sum(r[2] > 0 for r in got) > 20


def test_prefixes_are_the_rarest_shingles(spark, corpus, monkeypatch):
    """Each window keeps one shingle, and no other shingle of it is rarer; windows that cannot occur keep none."""
    rows, items = corpus
    items = [(i, t) for i, t in items if len(words(t)) >= 10]
    seen = []
    real = leak.materialize
    monkeypatch.setattr(leak, "materialize", lambda df, name: (seen.append((name, out := real(df, name))), out)[1])
    leak.decontaminate(with_clashes(spark, rows), bench(spark, items))
    tables = dict(seen)
    fold = lambda w: [x.replace("Σ", "σ").lower() for x in w]
    shingles = lambda w: [tuple(w[at : at + 3]) for at in range(len(w) - 2)]
    counts = Counter(s for _, t in rows for s in shingles(fold(words(t))))
    windows = tables["leak-prefixes"].collect()
    assert len({r["id"] for r in windows}) == len(windows) > 0
    for r in windows:
        own = [counts[s] for s in shingles(fold(r["words"]))]
        assert 0 < own[r["at"]] == min(own)
    assert len(windows) < tables["leak-windows"].count()


def test_empty_tables(spark, corpus):
    rows, items = corpus
    none = leak.decontaminate(with_clashes(spark, []), bench(spark, items))
    assert none.count() == 0
    clean = leak.decontaminate(with_clashes(spark, rows[:5]), bench(spark, []))
    assert [r["n_hit"] for r in clean.collect()] == [0] * 5
    assert clean.filter(F.size("items") > 0).isEmpty()
    assert leak.decontaminate(with_clashes(spark, rows[:5]), bench(spark, [(1, None), (2, "...")])).filter("n_hit > 0").isEmpty()
