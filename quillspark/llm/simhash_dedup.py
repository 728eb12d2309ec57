"""SimHash near-dedup by deletion-variant signatures.

A fingerprint has 64 bits; two are linked if they differ in at most `radius` bits.  Cut into
radius // 2 + 1 segments, at least one segment of two linked fingerprints differs in at most one bit.  Each
segment is indexed once per bit with that bit blotted out (one-wildcard variants): two segments share a
variant exactly if they differ in one bit at most.  An equality join over (segment, blotted bit, rest) thus
finds every link; candidates are verified on all 64 bits.

Equal fingerprints are grouped first, so copies cost one fingerprint.  Variants travel packed by hash bucket;
a bucket reports a spanning forest of its links, not all pairs; components come from `_components`.

Words are runs of anything but space and \\x09-\\x0D, with A-Z in lower case.  A text of fewer words than a
shingle has one shingle, an empty or null text none and fingerprint zero, linked like any other.  A row with
a null id is fingerprinted, but has no component and links nothing.  Repeated rows get the same result; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._blocks import binary_column
from quillspark.llm._common import bucket_of, by_bucket, dealt, first_per_value, mix64, n_buckets, n_parts, pack, stage, unstage
from quillspark.llm._components import components, forest

SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of `size` words, space-joined; one hash for fewer words, none for no word."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter([h(line[a:b], SEED) for a, b in zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    n, total = len(hashes), np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        total += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _print(size: int):
    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(shingle_hashes(t, size)) for t in binary_column(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each row of `docs` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_print(shingle), "doc_id long, fp long")


def variant_keys(prints: np.ndarray, radius: int, bits: list[int] | None = None) -> list[np.ndarray]:
    """For each of the bits (all 64 by default): the segment that holds it without that bit, hashed with the bit's number."""
    bits = list(range(64)) if bits is None else bits
    segments = radius // 2 + 1
    edge = [round(i * len(bits) / segments) for i in range(segments + 1)]
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            mask = sum(1 << x for x in bits[a:b])
            for bit in bits[a:b]:
                out.append(mix64((prints & np.uint64(mask & ~(1 << bit))) + np.uint64(bit + 1) * np.uint64(0xD1B54A32D192ED03)))
    return out


def _variants(radius: int, buckets: int):
    """(fingerprint, ..., node) rows to the variants of all fingerprints, packed by hash bucket."""

    def run(batches):
        for batch in batches:
            node = batch.column(batch.num_columns - 1).to_numpy()
            if not len(node):
                continue
            columns = [batch.column(i).to_numpy().view(np.uint64) for i in range(batch.num_columns - 1)]
            # fingerprints of one column only meet those of the same
            key = np.concatenate([k ^ np.uint64(i * 0x5851F42D4C957F2D) for i, p in enumerate(columns) for k in variant_keys(p, radius)])
            prints = np.concatenate([np.tile(p, 64) for p in columns])
            node = np.tile(node, 64 * len(columns))
            bucket = bucket_of(key, buckets)
            order = np.argsort(bucket, kind="stable")
            begin = first_per_value(bucket[order])
            blobs = [pack(key[o].view(np.uint8).reshape(-1, 8)[:, 2:].reshape(-1), prints[o], node[o]) for o in np.split(order, begin[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][begin]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


#: Pairs compared at once.
PAIRS = 1 << 18


def close_pairs(key: np.ndarray, prints: np.ndarray, radius: int):
    """Index pairs with equal keys (sorted) whose prints differ in `radius` bits at most, some at a time."""
    begin = first_per_value(key)
    size = np.diff(np.append(begin, len(key)))
    left = np.repeat(begin + size, size) - np.arange(len(key)) - 1  # partners behind each entry
    at = np.flatnonzero(left > 0)
    left = left[at]
    done = np.zeros(len(at), np.int64)
    while len(at):
        take = np.minimum(left, max(1, PAIRS // len(at)))
        i = np.repeat(at, take)
        j = i + 1 + np.repeat(done, take) + np.arange(len(i)) - np.repeat(np.cumsum(take) - take, take)
        near = np.bitwise_count(prints[i] ^ prints[j]) <= radius
        yield i[near], j[near]
        done, left = done + take, left - take
        more = left > 0
        at, left, done = at[more], left[more], done[more]


#: Variants handled at once, and the size from which those that share one are parted by variants of the bits that differ in it.
VARIANTS = 1 << 22
LARGE = 1 << 12


def linked(key: np.ndarray, prints: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (u, v) of the links between entries with equal keys."""
    order = np.lexsort((prints, key))
    key, prints, node = key[order], prints[order], node[order]
    same = np.concatenate(([False], (key[1:] == key[:-1]) & (prints[1:] == prints[:-1])))
    u, v = node[1:][same[1:]], node[:-1][same[1:]]  # equal fingerprints form a chain; the first stands for them below
    if len(u):
        u, v = forest(u, v)
    key, prints, node = key[~same], prints[~same], node[~same]
    begin = first_per_value(key)
    size = np.diff(np.append(begin, len(key)))
    large = np.repeat(size > LARGE, size)
    parts = [(key[~large], prints[~large], node[~large])]
    for a, n in zip(begin[size > LARGE].tolist(), size[size > LARGE].tolist(), strict=True):
        p, m = prints[a : a + n], node[a : a + n]
        differ = int(np.bitwise_or.reduce(p) ^ np.bitwise_and.reduce(p))
        for k in variant_keys(p, radius, [b for b in range(64) if differ >> b & 1]):
            o = np.argsort(k, kind="stable")
            parts.append((k[o], p[o], m[o]))
    for k, p, m in parts:
        for i, j in close_pairs(k, p, radius):
            if len(i):
                u, v = np.concatenate((u, m[i])), np.concatenate((v, m[j]))
                if len(u) > PAIRS:
                    u, v = forest(u, v)
    return forest(u, v) if len(u) else (u, v)


def _links(radius: int):
    def run(batches):
        for blobs in by_bucket(batches):
            keys = []
            for six, _, _ in blobs:
                k = np.zeros((len(six) // 6, 8), np.uint8)
                k[:, 2:] = six.reshape(-1, 6)
                keys.append(k.reshape(-1).view(np.uint64))
            key, prints, node = np.concatenate(keys), *(np.concatenate([b[i] for b in blobs]) for i in (1, 2))
            pieces = 1 + len(key) // VARIANTS
            piece = (key >> np.uint64(40)) % np.uint64(pieces)
            for i in range(pieces):
                at = piece == i if pieces > 1 else slice(None)
                u, v = linked(key[at], prints[at], node[at], radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable over links) for each row of `docs` (doc_id, text)."""
    parts = n_parts(docs)
    prints = stage(fingerprints(docs, shingle), "simhash-prints")
    # written, so that the last join deals its rows anew and can split a fingerprint that many documents have
    nodes = stage(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    packed = nodes.mapInArrow(_variants(radius, n_buckets(docs)), "bucket int, blob binary")
    roots = components(dealt(packed, parts).mapInArrow(_links(radius), "u long, v long"), "simhash")
    named = nodes.join(roots, "node", "left").select(F.col("fp").alias("fp_"), F.coalesce("root", "node").alias("root"))
    joined = prints.join(named, F.col("fp") == F.col("fp_"), "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))


def _word_prints(seeds: tuple[int, ...]):
    def run(batches):
        for batch in batches:
            words = [set(t.lower().split()) for t in binary_column(batch.column(3))]
            cols = []
            for seed in seeds:
                h = xxhash.xxh64_intdigest
                prints = np.fromiter((fingerprint(np.fromiter((h(w, seed) for w in ws), np.uint64, len(ws))) for ws in words), np.uint64, len(words))
                cols.append(pa.array(prints.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], ["doc_id", "h1", "h2", *(f"fp{i}" for i in range(len(seeds)))])

    return run


def prefix_size(n: int, similarity: float) -> int:
    """Of two sets with this similarity or more, the first hashes, so many of a set of n, share one (in any common order)."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def alike(both, n, m, similarity: float):
    """True where sets of n and m elements with `both` in common have this Jaccard similarity or more; empty sets are alike to none."""
    return (both > 0) & (both >= similarity * (n + m - both) - 1e-9)


#: Texts and bytes of texts of one cluster that are compared at once, in a tile of two blocks of half of them.
TILE_TEXTS = 512
TILE_BYTES = 2 << 20


def tile_links(sets: list[np.ndarray], block: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks of sets, or inside the one block: one row of bits for each set, over the elements of two sets or more."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    begin = first_per_value(values[order])
    times = np.diff(np.append(begin, len(values)))
    shared = np.repeat(times > 1, times)
    column = (np.cumsum(times > 1) - 1).repeat(times)[shared]
    bits = np.zeros((len(sets), int((times > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner[order][shared], column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    first = block == (block.min() if len(block) else 0)
    one = np.flatnonzero(first)
    two = one if first.all() else np.flatnonzero(~first)
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = max(1, (1 << 21) // (bits.shape[1] * max(1, len(two))))
    for a in range(0, len(one), step):
        i = one[a : a + step]
        both = np.bitwise_count(bits[i][:, None, :] & bits[two][None, :, :]).sum(axis=2, dtype=np.int64)
        x, y = np.nonzero(alike(both, sizes[i][:, None], sizes[two][None, :], similarity))
        x, y = i[x], two[y]
        u, v = np.concatenate((u, x[x != y])), np.concatenate((v, y[x != y]))
    return forest(u, v) if len(u) else (u, v)


def _tiles(shingle: int, similarity: float):
    """Rows (root, i, j, block, node, text), those of one tile together, to links (u, v)."""

    def run(batches):
        last, nodes, blocks, sets = None, [], [], []

        def links():
            u, v = tile_links(sets, np.asarray(blocks), similarity)
            node = np.asarray(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node[u], pa.int64()), pa.array(node[v], pa.int64())], ["u", "v"])

        for batch in batches:
            for root, i, j, block, node, text in zip(*(batch.column(k).to_pylist() for k in range(5)), binary_column(batch.column(5)), strict=True):
                if (root, i, j) != last:
                    if sets:
                        yield links()
                    last, nodes, blocks, sets = (root, i, j), [], [], []
                nodes.append(node)
                blocks.append(block)
                sets.append(np.unique(shingle_hashes(text, shingle)))
        if sets:
            yield links()

    return run


def links_inside(reps: DataFrame, shingle: int, similarity: float, parts: int) -> DataFrame:
    """(u, v): enough links to connect all similar texts of `reps` (node, root, text) that share a root.

    A root's texts are dealt to blocks of a bounded size, and each pair of blocks is a tile of its own: a large
    cluster is spread over many tasks, and no pair leaves a task unless it is a link of the tile's forest.
    """
    size = F.octet_length("text")
    blocks = reps.groupBy("root").agg(F.count("*").alias("n"), F.greatest(F.ceil(2 * F.count("*") / TILE_TEXTS), F.ceil(2 * F.sum(size) / TILE_BYTES)).cast("int").alias("b")).where("n > 1").select("root", "b")
    rows = reps.join(stage(blocks, "near-blocks"), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
    rows = rows.select("root", "block", "node", "text", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("other"))
    rows = rows.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "text")
    return rows.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_tiles(shingle, similarity), "u long, v long")


#: The most frequent shingles, at most so many, come last in the order of prefixes. Any order finds all pairs.
FREQUENT = 1 << 17


def _shingles(shingle: int):
    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(text, shingle)) for text in binary_column(batch.column(0))]
            s, n = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], ["s", "n"])

    return run


def frequent_shingles(reps: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that eight or more of one in 16 texts hold, the most frequent first."""
    some = reps.where(F.pmod(F.xxhash64("node"), F.lit(16)) == 0).select("text").mapInArrow(_shingles(shingle), "s long, n long")
    top = some.groupBy("s").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.col("n").desc(), "s").limit(FREQUENT)
    return np.array([r.s for r in top.collect()], np.int64).view(np.uint64)


def _prefixes(shingle: int, similarity: float, buckets: int, frequent):
    def run(batches):
        last = frequent.value
        by = np.argsort(last)
        ordered_last = last[by]
        for batch in batches:
            keys, sizes, nodes, roots = [], [], [], []
            for node, root, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch.column(2)), strict=True):
                s = np.unique(shingle_hashes(text, shingle))
                if not len(s):
                    continue
                n = min(len(s), prefix_size(len(s), similarity) + len(s) // 10)
                if len(last):
                    at = np.minimum(np.searchsorted(ordered_last, s), len(last) - 1)
                    hot = ordered_last[at] == s
                    s = np.concatenate((s[~hot], last[np.sort(by[at[hot]])[::-1]]))
                keys.append(s[:n])
                sizes.append(np.full(n, len(s), np.uint32))
                nodes.append(np.full(n, node, np.int64))
                roots.append(np.full(n, root, np.int64))
            if not keys:
                continue
            key, size, node, root = (np.concatenate(x) for x in (keys, sizes, nodes, roots))
            bucket = bucket_of(mix64(key), buckets)
            order = np.argsort(bucket, kind="stable")
            begin = first_per_value(bucket[order])
            blobs = [pack(key[o], size[o], node[o], root[o]) for o in np.split(order, begin[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][begin]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _sharing(similarity: float):
    """Pairs of texts of different roots with shared prefix shingles and sizes that allow the similarity.

    `n` counts the shared ones here. A prefix is longer than `prefix_size` by a tenth of its set, so similar sets share
    `need` or more, one and a tenth of the smaller set.
    """

    def run(batches):
        for blobs in by_bucket(batches):
            key, size, node, root = (np.concatenate(x) for x in zip(*blobs, strict=True))
            order = np.lexsort((root, key))
            key, size, node, root = key[order], size[order].astype(np.int64), node[order], root[order]
            begin = first_per_value(key)
            mixed = np.maximum.reduceat(root, begin) != np.minimum.reduceat(root, begin) if len(begin) else np.zeros(0, bool)
            keep = np.repeat(mixed, np.diff(np.append(begin, len(key))))
            key, size, node, root = key[keep], size[keep], node[keep], root[keep]
            for i, j in close_pairs(key, np.zeros(len(key), np.uint64), 0):
                ok = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
                a, b, least = node[i[ok]], node[j[ok]], np.minimum(size[i[ok]], size[j[ok]])
                if len(a):
                    rows, times = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b), 1 + least // 10)), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(times)], ["a", "b", "need", "n"])

    return run


def _similar(shingle: int, similarity: float):
    def run(batches):
        for batch in batches:
            u, v = [], []
            for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch.column(2)), binary_column(batch.column(3)), strict=True):
                s, t = np.unique(shingle_hashes(s, shingle)), np.unique(shingle_hashes(t, shingle))
                if alike(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), similarity):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def links_across(reps: DataFrame, shingle: int, similarity: float, parts: int, buckets: int) -> DataFrame:
    """(u, v): all similar pairs of `reps` (node, root, text) with different roots."""
    frequent = reps.sparkSession.sparkContext.broadcast(frequent_shingles(reps, shingle))
    packed = reps.select("node", "root", "text").mapInArrow(_prefixes(shingle, similarity, buckets, frequent), "bucket int, blob binary")
    pairs = dealt(packed, parts).mapInArrow(_sharing(similarity), "a long, b long, need long, n long")
    pairs = stage(pairs.groupBy("a", "b", "need").agg(F.sum("n").alias("n")).where("n >= need").select("a", "b"), "near-pairs")
    texts = reps.select("node", "text").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("s"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("t"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "s", "t").mapInArrow(_similar(shingle, similarity), "u long, v long")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 7, seeds: tuple[int, ...] = (42, 43)) -> DataFrame:
    """The rows of `docs` of one document of each group of near copies, that with the smallest id.

    Two texts are linked if they are equal or the exact Jaccard similarity of their sets of `shingle`-word shingles
    is `similarity` or more; groups are the components of these links.

    A fingerprint of word shingles moves too far at a similarity of 0.8 (about 10 of 64 bits), one of the set of
    words moves less (about 5), so texts are clustered by the deletion variants of one such fingerprint for each
    seed.  Inside a cluster all texts are compared exactly, in tiles.  Fingerprints miss pairs, above all those that
    differ in one run of words, so texts of different clusters are compared as well: those that share enough shingles
    of their prefixes (frequent shingles last) are verified.  No link between different texts is lost.

    Rows with a null id stay.  Rows that repeat both id and text stay or go together.  Null texts are equal to each
    other, texts without words are alike only if equal.
    """
    parts, buckets = n_parts(docs), n_buckets(docs)
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    fps = [f"fp{i}" for i in range(len(seeds))]
    prints = named.select("doc_id", "h1", "h2", "text").mapInArrow(_word_prints(seeds), "doc_id long, h1 long, h2 long, " + ", ".join(f"{c} long" for c in fps))
    nodes = prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in fps))
    nodes = stage(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "near-nodes")
    packed = nodes.select(*fps, "node").mapInArrow(_variants(radius, buckets), "bucket int, blob binary")
    clusters = components(dealt(packed, parts).mapInArrow(_links(radius), "u long, v long"), "near-clusters")
    nodes = stage(nodes.drop(*fps).join(clusters, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-nodes")
    # the rows of one document for each text, the smallest
    reps = stage(named.drop("text").join(nodes, ["doc_id", "h1", "h2"]).select("node", "root", "row"), "near-rows")
    texts = reps.select("node", "root", F.col("row.text").cast("string").alias("text"))
    inside = stage(links_inside(texts, shingle, similarity, parts), "near-inside")
    across = stage(links_across(texts, shingle, similarity, parts, buckets), "near-across")
    groups = components(inside.unionByName(across), "near-groups")
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).join(nodes.drop("root"), "node")
    stays = members.groupBy("root").agg(F.min(F.struct("doc_id", "h1", "h2", "node")).alias("m")).select("m.node")
    gone = stage(members.select("node").join(stays, "node", "left_anti"), "near-gone")
    unstage(inside, across)
    return reps.join(gone, "node", "left_anti").select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))


def digest(groups: DataFrame) -> DataFrame:
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
