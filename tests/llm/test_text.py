"""Language ID, mixing, token counts, fingerprints, segmentations, HTML and licenses."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perigraph.llm import html_extract, language_id, license_scan, mixing, order_minhash, queries, token_counts
from perigraph.llm import sentencepiece_lattice as lattice

from .rows import ODD

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@needs_data
def test_language_held_out_accuracy(spark):
    labels = queries.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    shares = {r["held_out"]: r["share"] for r in labels.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("share")).collect()}
    assert shares[True] >= 0.97 and shares[False] >= 0.97


def test_language_spans_and_oddities(spark, odd_docs, empty_docs):
    train = spark.createDataFrame([("the cat and the dog went thither", "en", 1), ("der Hund und die Katze gehen", "de", 2), ("кот и собака пошли", "ru", 3)], "text string, lang string, doc_id long")
    docs = spark.createDataFrame([(1, "the cat went and the dog. der Hund und die Katze gehen! кот собака"), (2, "!!! 123"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify_languages(docs, train).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de", "ru"] and 0 < got[1]["score"] < 1
    text = "the cat went and the dog. der Hund und die Katze gehen! кот собака"
    assert [text[s["start"] : s["end"]] for s in got[1]["spans"]] == ["the cat went and the dog", "der Hund und die Katze gehen", "кот собака"]
    assert (got[2]["lang_pred"], got[3]["lang_pred"], got[3]["score"]) == ("und", "und", 0.0)
    odd = language_id.identify_languages(odd_docs)
    assert odd.count() == len(ODD) and odd.filter("score < 0 or score > 1").isEmpty()
    assert {r["lang_pred"] for r in odd.filter("doc_id in (1, 2, 3, 10)").collect()} == {"und"}
    assert language_id.identify_languages(empty_docs).count() == 0
    kept = language_id.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id in (1, 2, 3, 10)").isEmpty()


def brute_viterbi(scores, penalty):
    best, back = scores[0].copy(), []
    for s in scores[1:]:
        top = best.max() - penalty
        back.append(np.where(best >= top, np.arange(len(best)), best.argmax()))
        best = np.maximum(best, top) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@given(st.integers(0, 10**6), st.lists(st.integers(0, 9), min_size=1, max_size=6))
def test_viterbi_over_texts_together(seed, sizes):
    bounds = np.append(0, np.cumsum(sizes))
    scores = np.random.default_rng(seed).normal(0, 5, (bounds[-1], 3))
    got = language_id.viterbi(scores, bounds, 4.0)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a < b:
            assert got[a:b].tolist() == brute_viterbi(scores[a:b], 4.0)


def brute_fill(children, granted):
    """Waterfilling one child at a time."""
    out, left, open_ = {}, granted, dict(children)
    for name, (w, cap) in sorted(children.items(), key=lambda x: (x[1][1] / x[1][0], x[0])):
        total = sum(v[0] for v in open_.values())
        if cap * total <= left * w:
            out[name], left = cap, left - cap
            del open_[name]
        else:
            break
    total = sum(v[0] for v in open_.values())
    return out | {n: left * w // total for n, (w, _) in open_.items()}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 100)), min_size=1, max_size=7), st.integers(0, 300))
def test_share_out(spark, children, granted):
    named = {f"c{i}": c for i, c in enumerate(children)}
    df = spark.createDataFrame([("p", n, w, cap, granted) for n, (w, cap) in named.items()], "parent string, name string, weight long, capacity long, granted long")
    got = {r["name"]: r["granted"] for r in mixing.share_out(df, ["parent"], "name").collect()}
    assert got == brute_fill(named, granted)


def test_mixing(spark, odd_docs, prose_docs, empty_docs, monkeypatch):
    levels = {"lang": "lang", "source": "source"}
    for size in (4096, 2):  # whole leaves, and leaves cut in slices
        monkeypatch.setattr(mixing, "SLICE_ROWS", size)
        got = mixing.mix_sources(prose_docs, levels, {"lang": {"en": 3}}, (2, 3), 2, seed=1).collect()
        rows = [(r["doc_id"], r["lang"] or "", r["source"] or "", len(r["text"].split())) for r in prose_docs.collect()]
        want = {}
        for lang, source in {(x[1], x[2]) for x in rows}:
            own = [x for x in rows if x[1:3] == (lang, source)]
            tokens = sum(x[3] for x in own)
            leaves = defaultdict(int)
            for x in rows:
                leaves[x[1:3]] += x[3]
            total = sum(leaves.values())
            langs = {n: (3 if n == "en" else 1, 2 * sum(v for k, v in leaves.items() if k[0] == n)) for n in {k[0] for k in leaves}}
            budget = brute_fill(langs, total * 2 // 3)[lang]
            granted = brute_fill({k[1]: (1, 2 * v) for k, v in leaves.items() if k[0] == lang}, budget)[source]
            epochs, rest = divmod(granted, tokens)
            upto = 0
            for x in sorted(own, key=lambda x: (hashlib.md5(f"1:{epochs}:{x[0]}".encode()).hexdigest(), x[0])):
                upto += x[3]
                if epochs + (upto <= rest):
                    want[x[0]] = epochs + (upto <= rest)
        assert {r["doc_id"]: r["copies"] for r in got} == want
    # Nothing is taken below a weight of 0; its siblings get what it would have got.
    none = mixing.mix_sources(prose_docs, levels, {"lang": {"en": 0}, "source": {"src1": 0}}, (1, 9), 2, seed=1).collect()
    assert none and all(r["lang"] != "en" and r["source"] != "src1" for r in none)
    assert mixing.mix_sources(prose_docs, levels, {"lang": {"en": 0, "": 0}}, (1, 2), 2).filter("n_tokens > 0").count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(prose_docs, levels, {"lang": {"en": -1}})
    assert mixing.mix_sources(odd_docs, levels, {}).count() > 0
    assert mixing.mix_sources(empty_docs, levels, {}).count() == 0


def test_token_counts_and_cache(spark, odd_docs, prose_docs, empty_docs, tmp_path):
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    model = Tokenizer.from_file(path)
    got = sorted(((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(odd_docs, cache, path).collect()))
    want = sorted((len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False).ids), n > 1024) for _, t in ODD)
    assert got == want
    first = spark.read.parquet(cache).count()
    assert first == len({t or "" for _, t in ODD})
    token_counts.count_tokens(odd_docs, cache, path).collect()
    assert spark.read.parquet(cache).count() == first  # nothing is encoded again
    token_counts.count_tokens(prose_docs, cache, path).collect()
    assert spark.read.parquet(cache).count() > first
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=pieces)
    found = sorted(r["n_tokens"] for r in token_counts.count_tokens(odd_docs, cache, pieces).collect())
    assert found == sorted(len(other.encode(t or "")) for _, t in ODD)  # the other version's counts are not taken
    assert token_counts.count_tokens(empty_docs, str(tmp_path / "none"), path).count() == 0


def test_token_counts_of_many_misses_move_no_texts(spark, tmp_path, monkeypatch):
    """Too many misses to broadcast: texts are encoded where they are read, copies are cached once and cached ones are kept."""
    from tokenizers import Tokenizer

    path, cache, texts = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache"), [f"text {i % 40} of some" for i in range(44)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    token_counts.count_tokens(docs.filter("doc_id < 2"), cache, path).collect()
    monkeypatch.setattr(token_counts, "BROADCAST_BYTES", 0)
    joined, join = [], type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda df, other, *a, **k: joined.append(df.columns + other.columns) or join(df, other, *a, **k))
    model = Tokenizer.from_file(path)
    want = sorted((i, len(model.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs, cache, path).collect()) == want
    assert joined and not any("text" in columns for columns in joined)
    assert spark.read.parquet(cache).count() == 40
    token_counts.count_tokens(docs.unionByName(spark.range(100, 110).selectExpr("id as doc_id", "concat('more ', id) as text")), cache, path).collect()
    assert any("text" in columns for columns in joined)  # a fifth lack: these alone are fetched
    assert spark.read.parquet(cache).count() == 50


def brute_order_minhash(text):
    k = min(order_minhash.KMER, len(text))
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] if k else []
    mask, seen, keys = (1 << 64) - 1, Counter(), []

    def mix(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & mask
        x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & mask
        return x ^ x >> 33

    def plain(g):
        h = k
        for c in g:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
        return mix(h)

    repeated = {g for g, n in Counter(grams).items() if n > 1}
    for g in grams:
        keys.append(mix((plain(g) + seen[g] * 0xD6E8FEB86659FD93) & mask) if g in repeated else plain(g))
        seen[g] += 1
    out = []
    for a in order_minhash.MULTIPLIERS.tolist():
        chosen = sorted(sorted(range(len(keys)), key=lambda i: (a * keys[i] & mask, i))[: order_minhash.TUPLE])
        h = mix(a)
        for i in chosen:
            h = mix((h * 31 + plain(grams[i])) & mask)
        out.append(h >> 32)
    return out


@settings(max_examples=40, deadline=None)
@given(st.text("abcé🎉 ", max_size=60))
def test_order_minhash_against_brute_force(text):
    assert order_minhash.order_minhash(text).tolist() == brute_order_minhash(text)


def test_order_minhash_tiles(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 9
    whole = order_minhash.order_minhash(text)
    monkeypatch.setattr(order_minhash, "TILE", 7)
    assert order_minhash.order_minhash(text).tolist() == whole.tolist()


def test_order_counts():
    """The same words in another order are less alike than with one word changed."""
    words = [f"w{i}x" for i in range(200)]
    own, swapped, changed = (order_minhash.order_minhash(" ".join(x)) for x in (words, words[100:] + words[:100], [*words[:50], "changed", *words[51:]]))
    assert order_minhash.likeness(own, changed) > 0.8 > order_minhash.likeness(own, swapped)


def test_document_fingerprints(odd_docs, prose_docs, prose, empty_docs):
    got = {r["doc_id"]: r for r in order_minhash.document_fingerprints(prose_docs).collect()}
    texts = dict(prose)
    ids = sorted(texts)
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - n] + texts[nxt][:n]
        own, other, after = (order_minhash.order_minhash(x) for x in (t, edited, texts[nxt]))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), order_minhash.to_hex(own), order_minhash.to_hex(other))
        assert (r["near_edited"], r["near_next"]) == (float((own == other).mean()), float((own == after).mean()))
    assert order_minhash.document_fingerprints(odd_docs).count() == len(ODD)
    assert order_minhash.document_fingerprints(empty_docs).count() == 0
    assert order_minhash.document_fingerprints(prose_docs.limit(1)).first()["near_next"] == 1.0


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(words, text):
    """All segmentations of a text of plain characters with their probabilities."""
    text, pieces = "▁" + text.replace(" ", "▁"), {words.model.id_to_piece(i): i for i in range(words.size) if not words.model.is_byte(i)}
    found = []

    def go(at, ids, weight):
        if at == len(text):
            found.append((tuple(ids), weight))
        for end in range(at + 1, len(text) + 1):
            if (i := pieces.get(text[at:end])) is not None:
                go(end, [*ids, i], weight + words.weights[i])

    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in found])
    return {ids: math.exp(w - total) for ids, w in found}


def test_samples_follow_the_distribution():
    words = lattice.vocabulary(MODEL, 2e-4)
    want, n = segmentations(words, "thet on"), 3000
    drawn = lattice.sample_batch(words, ["thet on"] * n, [str(i) for i in range(n)], 2, 5)
    first, second = (Counter(tuple(r[2].tolist()) for r in drawn if r[1] == rank) for rank in (1, 2))
    for ids, p in want.items():
        again = sum(p * q / (1 - q) for other, q in want.items() if other != ids)
        assert first[ids] / n == pytest.approx(p, abs=0.04) and second[ids] / n == pytest.approx(again, abs=0.04)
    assert all(math.exp(r[3]) == pytest.approx(want[tuple(r[2].tolist())]) for r in drawn)
    # An estimate by inclusion probabilities of the number of segmentations of each kind is unbiased: here, of all weights.
    estimate = np.mean([sum(math.exp(r[3]) / r[5] for r in group) for group in (drawn[2 * i : 2 * i + 2] for i in range(n))])
    assert estimate == pytest.approx(1.0, abs=0.05)


def test_all_segmentations_come_once():
    words = lattice.vocabulary(MODEL, 1e-3)
    want = segmentations(words, "ab c")
    drawn = lattice.sample_batch(words, ["ab c"], ["k"], 50, 1)
    assert {tuple(r[2].tolist()) for r in drawn} == set(want) and len(drawn) == len(want)
    values = [r[4] for r in drawn]
    assert values == sorted(values, reverse=True) and all(r[5] == 1.0 for r in drawn)


def test_segmentation_rows(odd_docs, empty_docs):
    got = lattice.sample_segmentations(odd_docs, MODEL, samples=3, seed=2).collect()
    assert all(r["round_trip"] for r in got)
    by_text = defaultdict(list)
    for r in got:
        by_text[r["doc_id"]].append(tuple(r["ids"]))
    assert by_text[2] == [()] and len(set(by_text[4])) == 3
    assert len(by_text[9]) == 6 and len(set(by_text[9])) == 3  # two equal rows, the same samples
    again = lattice.sample_segmentations(odd_docs.repartition(1), MODEL, samples=3, seed=2)
    assert sorted((str(r["doc_id"]), r["sample"], r["ids_sha256"]) for r in again.collect()) == sorted((str(r["doc_id"]), r["sample"], r["ids_sha256"]) for r in got)
    decoded = lattice.decode_ids(again, MODEL).filter("doc_id = 4").select("text").distinct().collect()
    assert [r["text"] for r in decoded] == ["Hello World hello world"]
    packed = lattice.sample_segmentations(odd_docs, MODEL, samples=3, seed=2, packed_ids=True)
    assert {(r["ids_sha256"], tuple(np.frombuffer(r["ids"], "<i4").tolist())) for r in packed.collect()} == {(r["ids_sha256"], tuple(r["ids"])) for r in got}
    decoded = lattice.decode_ids(packed.filter("doc_id = 4"), MODEL).select("text").distinct().collect()
    assert [r["text"] for r in decoded] == ["Hello World hello world"]
    assert "ids" not in lattice.sample_segmentations(odd_docs, MODEL, with_ids=False).toPandas().columns
    assert lattice.sample_segmentations(empty_docs, MODEL).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>"</script><style>p{}</style><body>
<div class="site-header"><a href=/>Home</a></div><div class="cookie-notice">We use cookies</div><nav><ul><li>menu</ul></nav>
<div class="post-%d"><h1>Title &amp; more</h1><p>One<br>two <a href=x>link</a>,   three <b>bold<p>Next&nbsp;para &lt;x&gt;.
<div class="ad">Buy</div><ul><li>item one<li>item two</ul><!-- <p>hidden</p> --><form><p>mail</p></form><p style="display: none">unseen</p></div>
<div class="comments"><p>%s</p></div><footer>&copy; f</footer></body></html>"""
TEXT = "Title & more\nOne two link, three bold\nNext para <x>.\nitem one\nitem two"


def test_html_oddities(spark):
    rows = [(1, "http://a.org/1", PAGE % (1, "so nice")), (2, "http://A.org/2", PAGE % (2, "so")), (3, None, None), (4, "not a url", ""), (5, "http://b.org", "plain text only"), (6, "http://b.org", "<div><p>a<div>b</p></div>"), (6, "http://b.org", "<div><p>a<div>b</p></div>"), (7, "http://c.org", "<p>" * 20_000 + "deep"), (8, "http://c.org", "<body><article><p>main text of the page</p></article><article class='comment'><p>reader</p></article>")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, path string")
    got = defaultdict(list)
    for r in html_extract.extract_main_text(pages).collect():
        got[r["page_id"]].append((r["text"], r["n_chars"]))
    assert got[1] == got[2] == [(TEXT, len(TEXT))]
    assert got[3] == got[4] == [("", 0)] and got[5] == [("plain text only", 15)] and len(got[6]) == 2
    assert got[7] == [("deep", 4)] and got[8] == [("main text of the page", 21)]
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_host_consensus_overrules_a_page(spark):
    """A page whose sidebar is longer than its article follows the host's other pages."""
    page = lambda main, side: f"<body><div class='story'><p>{main}</p></div><div class='box'><p>{side}</p></div></body>"
    rows = [(i, f"http://h.org/{i}", page("long article text " * 20, "short")) for i in range(5)] + [(9, "http://h.org/9", page("brief article", "a very long box of other things " * 3))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[9] == "brief article" and got[0].startswith("long article text")


def test_html_keeps_whole_articles_and_wrapped_pages(spark):
    """Nested sections, headings outside the body div, and wrappers that look like furniture."""
    long = lambda word: f"{word} words of the text " * 12
    a, b, c = (long(x).strip() for x in ("intro", "method", "result"))
    whole = f"T\n{a}\n{b}\n{c}"
    parts = f"<section class=intro><p>{a}</p></section><section class=methods><p>{b}</p></section><section class=results><p>{c}</p></section>"
    inner = f"<h1>T</h1><div class=content><p>{a}</p><p>{b}</p><p>{c}</p></div>"
    foot = "<div class=comments><p>reader says so</p></div><div class=cookie-notice>We use cookies</div>"
    pages = [f"<article>{inner}</article>{foot}", f"<article><h1>T</h1>{parts}</article>{foot}", f"<main><h1>T</h1><article>{parts}</article></main>", f"<div class=page>{inner}</div>{foot}", f"<div class=page><h1>T</h1>{parts}</div>{foot}", f"{inner}{foot}", f"<section><h1>T</h1></section>{parts}{foot}", f"<div class='content has-sidebar'>{inner}</div>{foot}", f"<form><article>{inner}</article></form>{foot}", f"<form>{inner}</form>{foot}", f"<div class='content has-sidebar'><article><h1>T</h1>{parts}</article>{foot}<div class=sidebar><p>side</p></div></div>"]
    rows = [(i, f"http://h{i}.org/", f"<body>{x}</body>") for i, x in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert [i for i in got if got[i] != whole] == []


@needs_data
def test_html_of_test_pages(spark):
    import html
    import re

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in queries.op9_html_extraction(spark, SF).collect()}
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r["page_id"]].replace(" ", "") == "\n".join(x for x in want if x).replace(" ", "")


def brute_license(text):
    words = [w for w in "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).split(" ") if w]
    places = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    labels = {label for _, label in places}
    extra = set(labels)
    for line in (text or "").split("\n"):
        block = license_scan.token_set(line)
        for label, own in license_scan.template_sets(license_scan.TEMPLATES):
            if len(own & block) >= math.ceil(0.8 * len(own) - 1e-9):
                extra.add(label)
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(extra))


def test_license_scan(spark, odd_docs, empty_docs):
    mit = license_scan.TEMPLATES[0][1]
    texts = [t for _, t in ODD] + [mit, mit.replace("Software", "Program"), "x\n" + mit.upper() + "\ny", "cc by cc-by CC/BY", "The MIT License and the mit\nlicense; GNU General Public License.", "permission notice", mit[: len(mit) // 3], "Redistribution and use in source and binary forms, with or without modification, are permitted"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, labels string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in license_scan.license_scan(docs).collect()}
    assert got == {i: brute_license(t) for i, t in enumerate(texts)}
    assert license_scan.license_scan(docs).filter("score < 0 or score > 1 or (labels = '') != (score = 0)").isEmpty()
    assert license_scan.license_scan(odd_docs).count() == len(ODD) and license_scan.license_scan(empty_docs).count() == 0


def test_every_block_over_the_threshold_is_listed(spark):
    """Also those of templates that another one outdoes: their labels count only if asked for."""
    notices = dict(license_scan.TEMPLATES[:16])
    texts = [notices["lgpl"], notices["cc-by-sa"], "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License, this work is."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    sets = license_scan.template_sets(license_scan.TEMPLATES)
    for i, t in enumerate(texts):
        own = license_scan.token_set(t)
        want = {label for label, x in sets if len(own & x) >= 0.8 * len(x)}
        assert {b["label"] for b in got[i]["blocks"]} == want and len(want) > 1
    assert [got[i]["labels"] for i in (0, 1)] == ["lgpl", "cc-by-sa"]
    assert {b["label"]: b["outdone"] for b in got[0]["blocks"]}["gpl"] and {b["label"]: b["containment"] for b in got[1]["blocks"]}["cc-by"] == 1.0
    every = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(docs, all_labels=True).collect()}
    assert "gpl" in every[0].split(",") and "cc-by" in every[1].split(",")


def test_license_scan_of_wrapped_texts(spark):
    """Texts wrapped at 72 columns are found whole; a license is not taken for the ones whose names hold its own."""
    import textwrap

    whole = {label: text for label, text in license_scan.TEMPLATES[-9:]}
    sentence = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    texts = [("mit", whole["mit"]), ("bsd", whole["bsd"]), ("isc", whole["isc"]), ("mpl", whole["mpl"]), ("lgpl", whole["lgpl"]), ("cc-by", sentence.format("")), ("cc-by-sa", sentence.format("-ShareAlike")), ("cc-by-nc", sentence.format("-NonCommercial"))]
    docs = spark.createDataFrame([(i, "some text before\n\n" + textwrap.fill(t, 72, initial_indent="# ", subsequent_indent="# ") + "\nand after") for i, (_, t) in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert [got[i]["labels"] for i in range(len(texts))] == [label for label, _ in texts]
    assert all(r["score"] == 1.0 and any(b["line"] == 2 and b["containment"] == 1.0 for b in r["blocks"]) for r in got.values())
    both = spark.createDataFrame([(1, sentence.format("") + " " + sentence.format("-ShareAlike"))], "doc_id int, text string")
    assert license_scan.license_scan(both).first()["labels"] == "cc-by,cc-by-sa"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcdefghij"), min_size=1), min_size=1, max_size=6), st.sets(st.sampled_from("abcdefghijk")), st.dictionaries(st.sampled_from("abcdefghij"), st.integers(0, 5)), st.sampled_from([0.5, 0.8, 1.0]))
def test_set_join_filters_lose_nothing(sets, block, counts, share):
    templates = [(str(i), frozenset(x.encode() for x in s)) for i, s in enumerate(sets)]
    own = {x.encode() for x in block}
    index = license_scan.TemplateIndex(templates, {k.encode(): v for k, v in counts.items()}, share)
    want = {label for label, t in templates if len(t & own) >= math.ceil(share * len(t) - 1e-9)}
    assert {label for label, _ in index.search(own)} == want


def swapped_twins(letters):
    """A word of two letters whose order follows the parity of the place's bits, and the same with the letters swapped:
    sums of letters times powers of any odd number are equal modulo 2**64 for both, if there are enough letters."""
    parity = [bin(i).count("1") % 2 for i in range(letters)]
    return "".join("ab"[x] for x in parity), "".join("ba"[x] for x in parity)


def test_units_are_told_apart_by_their_characters():
    words = lattice.vocabulary(MODEL, lattice.ALPHA)
    for size in (1024, 2048, 4096):
        texts = [f"see {x}" for x in swapped_twins(size)]
        drawn = lattice.sample_batch(words, texts, ["1", "2"], 2, 3)
        assert len(drawn) == 4 and all(words.decode(r[2]) == texts[r[0]] for r in drawn)


def test_trie_finds_exactly_the_pieces():
    words = lattice.vocabulary(MODEL, lattice.ALPHA)
    known = {words.model.id_to_piece(i): i for i in range(words.size) if not (words.model.is_byte(i) or words.model.is_control(i) or words.model.is_unknown(i))}
    for text in ("▁the▁thing", "tionstion", "日本語é", "\U0010ffffa"):
        for a in range(len(text)):
            state = np.zeros(1, np.int64)
            for b in range(a, len(text)):
                state = words.follow(state, np.array([ord(text[b])]))
                found = int(words.piece_at[state[0]]) if state[0] >= 0 else -1
                assert found == known.get(text[a : b + 1], -1)
                if state[0] < 0:
                    break


def test_text_that_the_normaliser_empties(spark, monkeypatch):
    """It keeps a row, with the empty segmentation."""
    words = lattice.vocabulary(MODEL, lattice.ALPHA)
    plain = type("M", (), {"normalize": staticmethod(lambda t: " ".join(t.split()).replace(" ", "▁"))})
    monkeypatch.setattr(words, "model", plain)
    assert [r[0] for r in lattice.sample_batch(words, [" \t ", "", "the"], ["1", "2", "3"], 1, 0)] == [2]


def texts_of(spark, pages):
    rows = [(i, u, f"<html><body>{x}</body></html>") for i, (u, x) in enumerate(pages)]
    return [r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).orderBy("page_id").collect()]


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ("<p>Press <button>Name</button> and <label>Save</label> now.</p>", "Press Name and Save now."),
        ("<p>Long enough a text.</p><p><button>Subscribe now</button></p><div><label>Mail</label> <input></div>", "Long enough a text."),
        ("<p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x = 2</annotation></math> holds.</p>", "Here x=2 holds."),
        ("<p>Seen in <svg><text>A drawing</text></svg> it.</p>", "Seen in it."),
        ("<p class='byline'>By A. B.</p><p class='tags'>One, two.</p><p class='toc related'>See there.</p><p class='related ad'>Buy!</p>", "By A. B.\nOne, two.\nSee there."),
        ("<p>Text.</p><ul class='related'><li><a href='/'>More</a></li></ul><div class='social'>Follow us</div>", "Text."),
        ("<p>Text.</p><form><label>Your name, in full, as it is written</label> x</form>", "Text."),
        ("<p>Text.</p><button class='share'>Share</button> it <button>", "Text.\nit"),
    ],
)
def test_html_parts_of_an_article(inside, want):
    """What stands in the sentences of an article stays; controls, drawings and lists of links do not."""
    page = html_extract.Page(f"<html><body><nav><button>Menu</button> of all</nav><article>{inside}</article></body></html>")
    assert page.main_text(set(page.scores())) == want


def test_html_of_any_nesting():
    """Time and memory grow with the page, not with its depth."""
    import time
    import tracemalloc

    n = 50_000
    pages = ["<div>" * n + "<p>deep", "".join(f"<div class=c{i}x>t" for i in range(n)), "<b>" * n + "text" + "</i>" * n, "<p>" + "<td><blockquote>" * (n // 2) + "</p>" * n, "<ul><li>" * n + "end", "<span><p>" * n, "<div class=sidebar>" * n + "x" * 50, "</section>" * n + "<a>" * n]
    for i, page in enumerate(pages):
        began = time.process_time()
        if i < 2:
            tracemalloc.start()
        html_extract.Page(page).main_text(set(html_extract.Page(page).scores()))
        if i < 2:
            most = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert most < 200 << 20
        assert time.process_time() - began < 40


def test_html_keeps_split_articles(spark):
    """Parts in sibling containers of other classes, pages without an article, with links only, and without any container."""
    long = lambda word: f"{word} words of the text " * 12
    a, b = long("first").strip(), long("second").strip()
    split = f"<div class=one><p>{a}</p></div><div class=ad><p>buy this</p></div><div class=two><p>{b}</p></div><div class=side><p>some other things</p></div>"
    got = texts_of(spark, [("http://s.org/1", split), ("http://s.org/2", split), ("http://l.org/1", "<p><a href=x>all of it</a></p><p><a href=y>is links</a></p>"), ("http://t.org/1", f"{a}<br>{b}")])
    assert got == [f"{a}\n{b}"] * 2 + ["all of it\nis links", f"{a} {b}"]


def brute_consensus(pages):
    """Winning paths of each host from the pages' own votes, summed one by one."""
    votes = defaultdict(Counter)
    for host, source in pages:
        for path, points in html_extract.Page(source).scores().items():
            votes[host][path] += points
    out = {}
    for host, own in votes.items():
        best = min(own, key=lambda k: (-own[k], k))
        out[host] = sorted(k for k, v in own.items() if k == best or v >= 0.5 * own[best] and v >= 0.05 * sum(own.values()))
    return out


def test_html_consensus_against_brute_force(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(n))
    pages = []
    for i in range(60):
        parts = "".join(f"<div class='{rng.choice('abcde')}{rng.randint(1, 9)}'><p>{words(rng.randint(1, 60))}</p></div>" for _ in range(rng.randint(1, 4)))
        pages.append((f"h{i % 4}.org", f"<html><body>{'<article>' + parts + '</article>' if rng.random() < 0.3 else parts}</body></html>"))
    df = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, (h, x) in enumerate(pages)], "page_id int, url string, html string").repartition(5)
    want = brute_consensus(pages)
    for r in html_extract.extract_main_text(df).collect():
        host, source = pages[r["page_id"]]
        assert r["paths"] == want[host] and r["text"] == html_extract.Page(source).main_text(set(want[host]))


def test_many_phrases_and_licenses_take_linear_time(spark):
    import time

    mit = license_scan.TEMPLATES[0][1]
    docs = spark.createDataFrame([(1, "cc by " * 100_000), (2, (mit + "\n") * 2_000)], "doc_id int, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert (got[1]["n_base"], got[1]["last_word"]) == (100_000, 199_998) and got[2]["labels"] == "mit" and len(got[2]["blocks"]) >= 2_000
    assert time.time() - began < 60
