"""The pipeline's stages on odd and small inputs."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as pipeline
from perigraph.llm import language_id

SF = "/root/testdata/sf0.001"


def key(r):
    return r["doc_id"], r["text"]


def test_stages_keep_columns_and_take_oddities(spark, odd_docs, empty_docs, tmp_path):
    docs = odd_docs
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        path = str(tmp_path / str(i))
        stage(spark, docs, "").write.parquet(path)
        after = spark.read.parquet(path)
        assert sorted(after.dtypes) == sorted(odd_docs.dtypes)
        assert {key(r) for r in after.collect()} <= {key(r) for r in docs.collect()}
        assert stage(spark, empty_docs, "").count() == 0
        docs = after
    out = pipeline.STAGES[-1][1](spark, docs, "")
    assert out.filter("not round_trip").isEmpty() and pipeline.STAGES[-1][1](spark, empty_docs, "").count() == 0


def test_exact_stage_keeps_one_of_each_text(spark, odd_docs):
    kept = [key(r) for r in pipeline.exact_duplicates(spark, odd_docs, "").collect()]
    texts = [(t or "").lower() for _, t in kept]
    assert len(texts) == len(set(texts)) and (9, "repeated row of words that is here twice over and over again my friend") in kept
    assert (5, "hello world HELLO world") in kept and (8, "the same id, another text") in kept


def test_near_stage_keeps_one_of_each_group(spark, prose_docs):
    from perigraph.llm.simhash import simhash_near_dedup

    groups = {r["component_id"] for r in simhash_near_dedup(prose_docs).collect()}
    assert {r["doc_id"] for r in pipeline.near_duplicates(spark, prose_docs, "").collect()} == groups


def test_near_stage_leaves_no_similar_pair(spark, prose, prose_docs):
    """By brute force: what SimHash keeps, without all but the smallest id of each group linked at 0.8."""
    from .test_dedup import components

    def shingles(text):
        words = text.lower().split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    before = sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, prose_docs, "").collect())
    sets = [shingles(dict(prose)[i]) for i in before]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {before[i] for i in components(len(sets), linked)}
    stage = dict(pipeline.STAGES)["simhash_near_dedup"]
    assert linked and {r["doc_id"] for r in stage(spark, prose_docs, "").collect()} == want


def brute_grams(word):
    """The hashed trigrams and four-grams that end at each letter of a word and at its end."""
    mask, out = (1 << 64) - 1, []
    padded = [0, 0, 0, *[ord(c.lower()) for c in word], 0]
    for end in range(3, len(padded)):
        mixed = padded[end]
        for k in (1, 2, 3):
            mixed = (mixed * 0x100000001B3 + padded[end - k] + k) * 0x9E3779B97F4A7C15 & mask
            if k > 1:
                out.append((k, mixed >> 48))
    return out


def words_in(text):
    return "".join(c if c.isalpha() else " " for c in text).split()


def brute_language(rows, penalty=language_id.SWITCH_PENALTY):
    """lang_pred and score of each text, learnt from all labelled rows; for texts in one script."""
    counts = defaultdict(Counter)
    for _, text, lang, _ in rows:
        if lang is not None:
            for w in words_in(text or ""):
                counts[lang].update(brute_grams(w))
    langs = sorted(counts)
    totals = {(lang, k): sum(n for (j, _), n in counts[lang].items() if j == k) + 0.5 * (1 << 16) for lang in langs for k in (2, 3)}
    out = []
    for _, text, _, _ in rows:
        words = words_in(text or "")
        if not words:
            out.append(("und", 0.0))
            continue
        scores = [[sum(math.log((counts[lang][g] + 0.5) / totals[lang, g[0]]) for g in brute_grams(w)) for lang in langs] for w in words]
        best, back = scores[0], []
        for own in scores[1:]:
            leader = max(range(len(langs)), key=lambda i: (best[i], -i))
            back.append([i if best[i] >= best[leader] - penalty else leader for i in range(len(langs))])
            best = [max(best[i], best[leader] - penalty) + own[i] for i in range(len(langs))]
        at = max(range(len(langs)), key=lambda i: (best[i], -i))
        share = Counter()
        for t in range(len(words) - 1, -1, -1):
            share[at] += len(words[t])
            at = back[t - 1][at] if t else at
        top = max(share, key=lambda i: (share[i], -i))
        out.append((langs[top], share[top] / sum(share.values())))
    return out


def brute_mixture(rows, keys):
    """The ids within three quarters of all tokens, by waterfilling down the tree and a prefix of each leaf, in the order of
    the rows' keys."""
    from .test_text import brute_fill

    def domain(source):
        digits = source[len(source.rstrip("0123456789")) :] if source else ""
        return f"domain{int(digits) % 4}" if digits else ""

    leaves = defaultdict(list)
    for doc_id, text, lang, source in rows:
        leaf = (domain(source), lang or "", source or "")
        leaves[leaf].append((doc_id, text, len((text or "").split())))
    tokens = {leaf: sum(x[2] for x in own) for leaf, own in leaves.items()}
    granted = {(): sum(tokens.values()) * 3 // 4}
    for depth, level in enumerate(pipeline.MIX_LEVELS):
        for parent in [k for k in granted if len(k) == depth]:
            below = {leaf[: depth + 1] for leaf in leaves if leaf[:depth] == parent}
            weight = pipeline.MIX_WEIGHTS.get(level, {})
            children = {k: (weight.get(k[-1], 1), sum(n for leaf, n in tokens.items() if leaf[: depth + 1] == k)) for k in below}
            granted |= brute_fill(children, granted[parent])
    kept = set()
    for leaf, own in leaves.items():
        epochs, rest = divmod(granted[leaf], tokens[leaf]) if tokens[leaf] else (0, 0)
        upto = 0
        for doc_id, text, n in sorted(own, key=lambda x: hashlib.md5(f"7:{epochs}:{keys[x[0]]}".encode()).hexdigest()):
            upto += n
            if epochs + (upto <= rest) > 0:
                kept.add(doc_id)
    return kept


def test_run_against_brute_force(spark, tmp_path):
    """Each stage's kept rows, one after the other, in plain Python; and two segmentations of every text left."""
    from .test_dedup import brute_similar, brute_simhash

    rng, rows = random.Random(8), []
    sounds = {"en": "tha ing and ou the st er on", "de": "sch ung der ein ich ver zu ge", "fr": "eau oi les que ent ai re un", "es": "cion los que ado la er os el"}
    for i in range(240):
        lang = rng.choice(list(sounds))
        words = ["".join(rng.choice(sounds[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(50, 90))]
        rows.append([i, " ".join(words), lang if rng.random() < 0.8 else None, f"src{rng.randint(0, 5)}"])
    for i in range(60):  # exact and near copies
        base = rows[rng.randrange(200)]
        words = base[1].split()
        if i % 3:
            words[rng.randrange(len(words))] = "changed"
        rows.append([240 + i, " ".join(words).upper() if i % 3 == 0 else " ".join(words), base[2], base[3]])
    rows += [[300, "123 456", "en", "src1"], [301, None, "de", "src2"]]
    path = str(tmp_path / "documents.parquet")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(path)

    def stage(n):
        out = spark.read.parquet(path)
        for _, f in pipeline.STAGES[: n + 1]:
            out = f(spark, out, str(tmp_path)).persist()
        return {r["doc_id"] for r in out.collect()}

    labels = brute_language(rows)
    rows = [[i, t, lang or pred, s] for (i, t, lang, s), (pred, score) in zip(rows, labels, strict=True) if pred != "und" and score >= 0.5]
    assert stage(0) == {r[0] for r in rows} and len(rows) == 300
    last = {r[1].lower(): r[0] for r in rows}  # ids ascend
    rows = [r for r in rows if last[r[1].lower()] == r[0]]
    assert stage(1) == {r[0] for r in rows} and len(rows) < 300
    rows = [r for r, (i, _, least) in zip(rows, brute_simhash([(r[0], r[1]) for r in rows]), strict=True) if least == i]
    groups = brute_similar([r[1] for r in rows])
    rows = [r for k, r in enumerate(rows) if groups[k] == k]
    assert stage(2) == {r[0] for r in rows} and len(rows) < 260
    keyed = spark.read.parquet(path).select("doc_id", pipeline.row_key().cast("string").alias("k"))
    kept = brute_mixture(rows, {r["doc_id"]: r["k"] for r in keyed.collect()})
    assert stage(3) == kept and len(kept) < len(rows)
    texts = {r[0]: r[1] for r in rows}
    out = pipeline.run(spark, str(tmp_path)).collect()
    from perigraph.llm import sentencepiece_lattice as lattice

    words = lattice.vocabulary(pipeline.public_tokenizers.path("piece_bpe_32k.model"), lattice.ALPHA)
    assert Counter(r["doc_id"] for r in out) == dict.fromkeys(kept, 2)
    ids = [np.frombuffer(r["ids"], "<i4") for r in out]
    assert all(words.decode(x) == texts[r["doc_id"]] and r["n_pieces"] == len(x) for x, r in zip(ids, out, strict=True))
    assert len({(r["doc_id"], r["ids_sha256"]) for r in out}) == len(out)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.count() > 100 and out.filter("not round_trip or inclusion < 0 or inclusion > 1").isEmpty()
