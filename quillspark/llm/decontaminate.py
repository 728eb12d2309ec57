"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification.

Texts are lower-cased words (runs of letters and digits), shingles are `SHINGLE` words.  A document is
contaminated by an item if one of its windows of the item's number of words has a weighted (multiset) Jaccard
similarity of `similarity` or more to it over shingles; a document shorter than the item is one window.

1. Windows.  For each number of words that items have, a document's windows of that size are tried that hold
   enough shingles found in *any* item of that size; sliding a window to its first such shingle loses none, so
   those that start there (or end with the text) suffice.  Each gets a 64-bit SimHash of its shingles.
2. Index.  Fingerprints are cut into `BLOCKS` blocks.  Of two within the radius, one block at least differs in
   radius / `BLOCKS` bits or fewer, so items are indexed under all such variants of their blocks (1,811 rows an
   item at the radius of 19), and an equality join over (words, block, value) finds every window within the radius of
   an item; the distance is checked at once.  Only this index says which item a window may come from.
3. The multiset similarity of what is left is computed exactly.

At the least similarity of 0.8 fingerprints differ in about 10 of 64 bits, in more than the radius of 19 for one
pair in some thousands, and neighbouring windows give each passage further tries.  A random fingerprint lies within
the radius of one in a thousand items of its size.

DataFrame functions only.  The benchmark's shingles (two numbers a row) are broadcast while there are at most
`BROADCAST_ROWS` of them (counted first), else joined by shuffling.  Texts are told apart by 128 bits of
hash, so copies are worked on once.

Defined results: null and empty texts, and items under `SHINGLE` words, match nothing; null or repeated ids
are passed on; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import stage, unstage

SHINGLE = 5
BLOCKS = 5
_EDGES = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
BROADCAST_ROWS = 1_000_000
_H = ["h1", "h2"]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _identity(text: str) -> list[Column]:
    """Two columns that tell texts apart."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _shingles(words: str) -> Column:
    """The hash of each run of `SHINGLE` words; `words` is a column's name, so that it is worked out once."""
    n = F.size(words) - SHINGLE + 1
    each = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def with_simhash(rows: DataFrame, hashes: str) -> DataFrame:
    """Adds fp: bit b is set if it is set in over half of `hashes`. Two bits, 32 apart, are counted at once in the halves of a long."""
    shifted = lambda x, k: F.call_function("shiftrightunsigned", x, k)
    both = F.lit((1 << 32) | 1)
    counted = rows.withColumn("_bits", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.aggregate(F.col(hashes), F.lit(0).cast("long"), lambda acc, x: acc + shifted(x, k).bitwiseAND(both))))
    n = F.size(hashes).cast("long")
    bit = lambda count, k: F.call_function("shiftleft", F.when(2 * count > n, F.expr("1L")).otherwise(F.expr("0L")), k)
    low = lambda k: bit(F.get("_bits", k).bitwiseAND(F.lit((1 << 32) - 1)), k)
    high = lambda k: bit(shifted(F.get("_bits", k), F.lit(32)), k + 32)
    fp = F.aggregate(F.sequence(F.lit(0), F.size("_bits") - 1), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(low(k)).bitwiseOR(high(k)))
    return counted.withColumn("fp", fp).drop("_bits")


def _blocks(fp: Column) -> Column:
    """Each of the blocks of a fingerprint, with its number above it."""
    value = lambda a, b: F.call_function("shiftrightunsigned", fp, F.lit(a)).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*(value(a, b) + F.lit(i << 32) for i, (a, b) in enumerate(zip(_EDGES[:-1], _EDGES[1:], strict=True))))


def _variants(block: str, radius: int) -> Column:
    """What a block is XORed with to get all values that differ in radius / `BLOCKS` bits or fewer."""

    def masks(width: int) -> Column:
        each = (sum(1 << b for b in bits) for k in range(radius // BLOCKS + 1) for bits in combinations(range(width), k))
        return F.split(F.lit(",".join(map(str, each))), ",").cast("array<bigint>")

    widths = [b - a for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True)]
    out = masks(widths[0])
    for i, width in enumerate(widths):
        out = F.when(F.shiftright(F.col(block), 32) == i, masks(width)).otherwise(out) if width != widths[0] else out
    return out


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words, shingles, fp of each usable item."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    return with_simhash(rows.select("item_id", F.size("words").alias("n_words"), _shingles("words").alias("shingles")), "shingles")


def item_index(items: DataFrame, radius: int) -> DataFrame:
    """(n_words, block, item_id, ifp): each item under all variants of its blocks."""
    blocks = items.select("item_id", "n_words", F.col("fp").alias("ifp"), F.explode(_blocks(F.col("fp"))).alias("block"))
    return blocks.select("item_id", "n_words", "ifp", "block", F.explode(_variants("block", radius)).alias("mask")).select("n_words", F.col("block").bitwiseXOR(F.col("mask")).alias("block"), "item_id", "ifp")


def windows_of(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(h1, h2, n_words, start, window, fp): the windows that hold enough shingles of items of their size."""
    index = items.select("n_words", F.explode_outer("shingles").alias("s")).distinct()
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    # outer: an inner one would push a filter with the whole expression below the projection
    rows = docs.select(*_identity("text"), _words(F.col("text")).alias("words")).select(*_H, F.size("words").alias("n"), _shingles("words").alias("shingles"))
    hits = rows.select(*_H, "n", F.posexplode_outer("shingles").alias("pos", "s")).join(index, "s").select(*_H, "n", "n_words", "pos").distinct()
    need = F.greatest(F.ceil(F.lit(similarity) * (F.col("n_words") - SHINGLE + 1) - 1e-9), F.lit(1)).cast("int")
    found = hits.groupBy(*_H, "n", "n_words").agg(F.sort_array(F.collect_list("pos")).alias("pos")).where(F.size("pos") >= need)
    last = F.greatest(F.col("n") - F.col("n_words"), F.lit(0))
    wide = F.least(F.col("n"), F.col("n_words")) - SHINGLE + 1
    found = found.select(*_H, "n_words", "pos", need.alias("need"), last.alias("last"), wide.alias("wide"))
    # the need-th place from a window's first lies in it too; for the last window, the need-th place from the end
    full = F.when(F.size("pos") > 0, F.filter("pos", lambda p, i: (p < F.col("last")) & (F.get("pos", i + F.col("need") - 1) < p + F.col("wide"))))
    ends = F.when(F.get("pos", F.size("pos") - F.col("need")) >= F.col("last"), F.array("last")).otherwise(F.array().cast("array<int>"))
    tried = found.select(*_H, "n_words", "wide", F.concat(full, ends).alias("starts")).where(F.size("starts") > 0)
    tried = stage(tried, "bench-tried")
    texts = docs.select(*_identity("text"), "text").join(tried.select(*_H).distinct(), _H, "left_semi").dropDuplicates(_H)
    texts = texts.select(*_H, _words(F.col("text")).alias("words")).select(*_H, _shingles("words").alias("shingles"))
    windows = texts.join(tried, _H).select(*_H, "n_words", "wide", F.explode("starts").alias("start"), "shingles")
    windows = windows.select(*_H, "n_words", "start", F.slice("shingles", F.col("start") + 1, F.col("wide")).alias("window"))
    out = stage(with_simhash(windows, "window"), "bench-windows")
    unstage(tried)
    return out


def near_items(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """(h1, h2, n_words, start, item_id): windows and items whose fingerprints differ in `radius` bits or fewer."""
    left = windows.select(*_H, "n_words", "start", F.col("fp").alias("wfp"), F.explode(_blocks(F.col("fp"))).alias("block"))
    # the index isn't broadcast: it has far more rows than the benchmark
    near = left.join(item_index(items, radius).hint("merge"), ["n_words", "block"]).where(F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))) <= radius)
    return near.select(*_H, "n_words", "start", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 19) -> DataFrame:
    """(h1, h2, item_id, start_word, similarity): texts, by their hash, with the items they contain and the best window."""
    items = stage(items_of(benchmark), "bench-items")
    windows = windows_of(docs, items, similarity)
    pairs = near_items(windows, items, radius).join(windows.select(*_H, "n_words", "start", "window"), [*_H, "n_words", "start"]).join(items.select("item_id", "shingles"), "item_id")
    pairs = pairs.select(*_H, "item_id", "start", "window", "shingles", F.sort_array("window").alias("w"), F.sort_array("shingles").alias("s"))
    # a value that occurs k times more often than once adds k: what equals its neighbour in order
    again = lambda c: F.filter(c, lambda x, i: (i > 0) & (F.get(c, i - 1) == x)).alias(f"{c}_again")
    pairs = pairs.select("*", again("w"), again("s"))
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    more = F.aggregate(F.array_intersect("w_again", "s_again"), F.lit(0), lambda acc, x: acc + F.least(times("w_again", x), times("s_again", x)))
    pairs = pairs.withColumn("both", F.size(F.array_intersect("window", "shingles")) + more)
    pairs = pairs.withColumn("similarity", F.col("both") / (F.size("window") + F.size("shingles") - F.col("both")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    # filtered here: before the aggregation the filter would be pushed into the join, with all it takes to compute it
    found = pairs.groupBy(*_H, "item_id").agg(best.alias("b")).where(F.col("b.similarity") >= similarity)
    return found.select(*_H, "item_id", (-F.col("b.back")).cast("long").alias("start_word"), F.col("b.similarity").alias("similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 19) -> DataFrame:
    """doc_id, item_id, start_word, similarity for each document and item that it contains."""
    found = stage(contaminated(docs, benchmark, similarity, radius), "bench-leaks")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_identity("text"))
    return ids.join(found, _H).select("doc_id", "item_id", "start_word", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 19) -> DataFrame:
    """The rows of `docs` that contain no item of `benchmark`; null and empty texts stay."""
    found = stage(contaminated(docs, benchmark, similarity, radius).select(F.col("h1").alias("_qs_h1"), F.col("h2").alias("_qs_h2")).distinct(), "bench-leaks")
    h1, h2 = F.xxhash64(docs["text"]), F.xxhash64(F.lit(1), docs["text"])
    return docs.join(found, (h1 == F.col("_qs_h1")) & (h2 == F.col("_qs_h2")), "left_anti")
