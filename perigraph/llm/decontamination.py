"""Benchmark decontamination: documents' words inside exact occurrences of item windows, by a prefix-filtered set join.

A window is a set of shingles, each with its place. Shingles are ordered by how often all documents hold them; as a window
must be contained whole, its prefix is one shingle, the rarest. Documents' shingles meet the prefixes by hash, what meets is
bounded by length and position, and what is left is compared word by word. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, materialize, small_side, whole_text

#: What stands between words, in texts of either case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 3
#: Bytes of a row in a broadcast table of hashes, and of a window with its words and items, about.
TOKEN_BYTES, WINDOW_BYTES = 24, 400


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def folded(text: Column) -> Column:
    """Lower case without regard to what stands around a letter, so texts and their words fold alike."""
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def shingle_hash(words: str, place: str, width: int) -> Column:
    """Hash of the width words from place (from 0); shingles of other widths differ by the seed."""
    return F.expr(f"xxhash64({width}, {', '.join(f'get({words}, {place} + {i})' for i in range(width))})")


def item_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """id, words, width and items (sorted) of each distinct window; a null item id counts as an empty one."""
    items = benchmark.select(whole_text(F.col(f"`{item_col}`")).alias("item"), words_of(ascii_lower(whole_text(F.col(f"`{text_col}`")))).alias("w"))
    items = items.filter("size(w) > 0").withColumn("width", F.least(F.size("w"), F.lit(window)))
    placed = items.select("item", F.explode(F.expr("transform(sequence(0, size(w) - width), i -> slice(w, i + 1, width))")).alias("words"))
    distinct = placed.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return materialize(distinct.select(F.monotonically_increasing_id().alias("id"), "words", F.size("words").alias("width"), "items"), "leak-windows")


def window_shingles(windows: DataFrame, widths: list[int]) -> DataFrame:
    """token and place of each shingle of each window."""
    parts = []
    for k in widths:
        own = windows.filter(F.least("width", F.lit(SHINGLE)) == k).select("id", F.transform("words", folded).alias("words"), F.explode(F.expr(f"sequence(0, width - {k})")).alias("at"))
        parts.append(own.select("id", "at", shingle_hash("words", "at", k).alias("token")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def placed_words(docs: DataFrame) -> DataFrame:
    """A row for each place (from 0, and one at -1) of each document, with all its words to look around in: w folded, which
    also folds letters beyond A-Z and so only adds candidates, and raw as they are (or folded, if all are ASCII)."""
    lower = words_of(folded(F.col("text")))
    same = F.octet_length("text") == F.char_length("text")
    words = docs.withColumn("w", lower).withColumn("raw", F.when(same, F.col("w")).otherwise(words_of(F.col("text"))))
    return words.withColumn("p", F.explode_outer(F.expr("sequence(-1, size(w) - 1)")))


def rarity(docs: DataFrame, tokens: DataFrame, widths: list[int], broadcast_bytes: int) -> DataFrame:
    """token and how often all documents hold it, for the tokens that any document holds."""
    lower = docs.select(words_of(folded(F.col("text"))).alias("w")).withColumn("p", F.explode_outer(F.expr("sequence(-1, size(w) - 1)")))
    parts = [lower.filter(f"p >= 0 and p + {k} <= size(w)").select(shingle_hash("w", "p", k).alias("token")) for k in widths]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if tokens.count() * TOKEN_BYTES <= broadcast_bytes:
        return found.join(F.broadcast(tokens), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(tokens, "token", "left_semi")


def meetings(docs: DataFrame, prefixes: DataFrame, widths: list[int], reach: int, broadcast_bytes: int) -> DataFrame:
    """Places of documents at which a prefix token stands, each with the words around it, and a row at -1 for each document.

    Only what is left after the join carries words, unless the tokens are too many to broadcast: then all places are
    shuffled with their surroundings.
    """
    tokens = prefixes.select("token").distinct().withColumn("met", F.lit(True))
    small = tokens.count() * TOKEN_BYTES <= broadcast_bytes
    around = F.expr(f"slice(raw, greatest(p - {reach}, 0) + 1, {2 * reach + 1})")
    out = []
    for k in widths:
        rows = placed_words(docs).filter(f"p >= 0 and p + {k} <= size(w)" + ("" if out else " or p = -1")).withColumn("token", F.when(F.col("p") >= 0, shingle_hash("w", "p", k)))
        kept = [*[c for c in docs.columns if c != "text"], "p", F.size("w").alias("n_words"), "token"]
        if small:
            rows = rows.join(F.broadcast(tokens), "token", "left").filter("met or p = -1").select(*kept, around.alias("around"))
        else:
            rows = rows.select(*kept, around.alias("around"))
            rows = rows.filter("p >= 0").join(tokens, "token", "left_semi").unionByName(rows.filter("p = -1"))
        out.append(rows)
    found = out[0]
    for p in out[1:]:
        found = found.unionByName(p)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start and end in words, from 0, merged), items (ids with occurring windows, sorted as
    strings) for each row of docs.

    Words are runs of 0-9, a-z and everything beyond ASCII after lower-casing A-Z. A window is that many consecutive words
    of an item, a shorter item is one window, and an item without words has none. Null texts are empty and have no words;
    repeated rows give a row each; rows that share an id are told apart by a hash of their texts. An empty benchmark hits
    nothing. Extra columns of either table are left aside. Tables are broadcast below broadcast_bytes, shuffled beyond.
    """
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(F.col(f"`{text_col}`")).alias("text")).withColumn("digest", F.xxhash64("text"))
    windows = item_windows(benchmark, window, item_col, item_text_col)
    widths = sorted(r[0] for r in windows.select(F.least("width", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    shingles = window_shingles(windows, widths)
    counted = materialize(rarity(keyed, shingles.select("token").distinct(), widths, broadcast_bytes), "leak-rarity")
    # A window with a shingle that no document holds cannot occur: it must have as many counted shingles as places.
    known = shingles.join(small_side(counted, TOKEN_BYTES), "token").groupBy("id").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "token", "at")).alias("rarest"))
    prefixes = windows.join(known, "id").filter(F.col("known") == F.col("width") - F.least("width", F.lit(SHINGLE)) + 1)
    prefixes = materialize(prefixes.select("id", "words", "width", "rarest.token", "rarest.at"), "leak-prefixes")
    reach = window - 1
    met = materialize(meetings(keyed, prefixes, widths, reach, broadcast_bytes), "leak-meetings")

    near = met.filter("p >= 0").join(F.broadcast(prefixes) if prefixes.count() * WINDOW_BYTES <= broadcast_bytes else prefixes, "token")
    fits = near.withColumn("start", F.col("p") - F.col("at")).filter("start >= 0 and start + width <= n_words")
    seen = ascii_lower(F.array_join(F.expr(f"slice(around, start - greatest(p - {reach}, 0) + 1, width)"), " "))
    key = ["doc_id", "digest"]
    hits = materialize(fits.filter(seen == F.array_join("words", " ")).select(*key, "start", (F.col("start") + F.col("width")).alias("end"), "id").distinct(), "leak-hits")

    by_start = Window.partitionBy(*key).orderBy("start")
    ends = hits.groupBy(*key, "start").agg(F.max("end").alias("end")).withColumn("before", F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    runs = ends.withColumn("run", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(by_start))
    merged = runs.groupBy(*key, "run").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"))
    spans = merged.groupBy(F.struct(*key).alias("side")).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    # Items are looked up once for each distinct set of windows, so a passage that many documents share costs one look.
    sets = hits.groupBy(F.struct(*key).alias("side")).agg(F.sort_array(F.collect_set("id")).alias("set"))
    own = sets.select("set").distinct().select("set", F.explode("set").alias("id")).join(windows.select("id", "items"), "id")
    named = own.select("set", F.explode("items").alias("item")).groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = materialize(spans.join(sets, "side").join(named, "set").select("side", "n_hit", "spans", "items"), "leak-found")
    rows = met.filter("p = -1").select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.struct(*key).alias("row"))
    out = rows.join(found, F.col("row").eqNullSafe(F.col("side")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
