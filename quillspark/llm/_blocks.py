"""Where can two documents share a window?  Anchors, owner blocks and segments.

`suffix_dedup` (bytes) and `substring_dedup` (words) both remove the units covered by a window of
W units that also starts in a document with a smaller id.  Comparing all windows would move one row
per unit.  This module moves far less and stays exact:

1. *Anchors.*  In each window the k-gram with the smallest hash is its anchor, so equal windows have
   equal anchors at equal offsets (about one anchor in (W-k)/2 units).  Anchor hashes travel packed,
   one blob per task and hash bucket.
2. *Owner blocks.*  An anchor seen in two documents or more belongs to the block of the smallest
   document that holds it.  Each document cuts out the segments around its anchors of one block and
   sends them there: windows that are equal meet in one block, whoever else holds them.
3. The caller decides inside a block which windows repeat an earlier document's.
4. *Hot anchors.*  What more than `HOT` different texts hold is dealt to chunks, and the owner's segments go to each of
   them: the caller decides each chunk alone.  Windows that nothing in the chunk repeats, mostly those that reach beyond
   a shared passage, are then compared by 128 bits of hash across chunks, where the smallest document that holds
   one is a grouped minimum.  It is never missing there, as nothing smaller can have settled it in its chunk.

Exact copies of a text are settled by a grouped minimum beforehand, so that a large group of copies
sends one document's segments only; copies in one batch send one document's anchors.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import bucket_of, by_bucket, dealt, first_per_value, group_col, group_of, mix64, n_buckets, n_parts, ordered, pack, stage, unpack, unstage

#: Bytes of documents handled at once, and units of one text.
SLICE = 1 << 20
PIECE = 1 << 21
#: Texts of one chunk, about, where more of them hold an anchor.
HOT = 256
#: Anchors packed at once, and read at once from a bucket.
PACKED = 1 << 20


@dataclass(frozen=True)
class Units:
    """How a text becomes units: one 64-bit value per unit and the bounds of each text; a text's length and a cutter."""

    window: int
    gram: int
    block: int
    hashes: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    opened: Callable[[bytes], tuple[int, Callable[[int, int], bytes]]]


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` neighbours, by doubling; len(a) - width + 1 values."""
    n, span, cur = len(a) - width + 1, 1, a
    if n <= 0:
        return a[:0]
    while span * 2 <= width:
        cur = op(cur[:-span], cur[span:])
        span *= 2
    return op(cur[:n], cur[width - span : width - span + n])


def grams(unit: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` units, by doubling; the last step may overlap, which gives as good a key."""
    h, done = unit, 1
    with np.errstate(over="ignore"):
        while done < width:
            step = min(done, width - done)
            h = mix64(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
            done += step
    return h


def anchors(unit: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows that lie inside one text."""
    n = len(unit)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n > 2 * PIECE:  # a very long text: pieces that overlap by a window less one unit, so each window is in one
        found = []
        for a in range(0, n - window + 1, PIECE):
            b = min(n, a + PIECE + window - 1)
            at, h = anchors(unit[a:b], np.unique(np.clip(bounds, a, b)) - a, window, gram)
            found.append((at + a, h))
        at, first = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
        return at, np.concatenate([x for _, x in found])[first]
    h = grams(unit, gram)
    low = sliding(h, window - gram + 1, np.minimum)
    inside = np.zeros(n, bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= window:
            inside[a : b - window + 1] = True
    low = np.where(inside[: len(low)], low, np.uint64(0))
    pad = np.zeros(window - gram, np.uint64)
    high = sliding(np.concatenate((pad, low, pad)), window - gram + 1, np.maximum)
    at = np.flatnonzero((high == h) & (high > 0))
    return at, h[at]


def slices(ids: list, texts: list[bytes], most: int = SLICE) -> Iterator[tuple[list, list[bytes]]]:
    """Neighbouring documents, together of about `most` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield ids[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield ids[at:], texts[at:]


def binary_column(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _find(units: Units, buckets: int):
    """Documents to anchors, packed by hash bucket."""

    def packed(got: list) -> pa.RecordBatch:
        h, at, doc, crc = (np.concatenate(x) for x in zip(*got, strict=True))
        bucket = bucket_of(h, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        begin = first_per_value(bucket)
        rows = []
        for a, b in zip(begin, [*begin[1:], len(order)], strict=True):
            o = order[a:b]
            new = np.concatenate(([True], (doc[o][1:] != doc[o][:-1]) | (crc[o][1:] != crc[o][:-1])))
            first = np.flatnonzero(new)
            held = np.diff(np.append(first, len(o))).astype(np.uint32)
            six = h[o].view(np.uint8).reshape(-1, 8)[:, 2:].reshape(-1)
            rows.append(pack(six, at[o].astype(np.uint32), doc[o][first], crc[o][first], held))
        return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(rows, pa.binary())], ["bucket", "blob"])

    def run(batches):
        got, size = [], 0
        for batch in batches:
            texts = binary_column(batch.column(1))
            smallest: dict[bytes, int] = {}
            for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                smallest[t] = min(i, smallest.get(t, i))
            for some, part in slices(list(smallest.values()), list(smallest)):
                unit, bounds = units.hashes(part)
                at, h = anchors(unit, bounds, units.window, units.gram)
                doc = np.searchsorted(bounds, at, side="right") - 1
                got.append((h, at - bounds[doc], np.asarray(some, np.int64)[doc], np.fromiter(map(zlib.crc32, part), np.uint32, len(part))[doc]))
                size += len(h)
                if size >= PACKED:
                    yield packed(got)
                    got, size = [], 0
        if size:
            yield packed(got)

    return run


def _own(block: int, groups: int, hot: int):
    """One hash bucket's anchors: those of two documents or more, each with its owner block."""

    def run(batches):
        for blobs in by_bucket(batches):
            pieces = 1 + sum(len(b[1]) for b in blobs) // PACKED
            for piece in range(pieces):
                if (out := _owned(blobs, block, groups, hot, piece, pieces)) is not None:
                    yield out

    return run


def _chunked(base: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, crc: np.ndarray, owner: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of entries and their keys: even for anchors of a block, odd for a chunk of a hot one; the owner has all chunks."""
    even = base & ~np.uint64(1)
    places, keys = [np.arange(len(base))], [even]
    cold = np.ones(len(base), bool)
    for a, n in zip(begin[size > hot].tolist(), size[size > hot].tolist(), strict=True):
        texts = len(np.unique(crc[a : a + n]))
        if texts <= hot:
            continue
        chunks = 1 << ((texts - 1) // hot).bit_length()
        cold[a : a + n] = False
        at = np.arange(a, a + n)
        own = doc[at] == owner[at]
        chunk = mix64(doc[at].view(np.uint64)) % np.uint64(chunks)
        places += [at[~own], np.repeat(at[own], chunks)]
        chunk = np.concatenate((chunk[~own], np.tile(np.arange(chunks, dtype=np.uint64), int(own.sum()))))
        with np.errstate(over="ignore"):
            keys.append(mix64(np.concatenate((base[at[~own]], np.repeat(base[at[own]], chunks))) + np.uint64(0x9E3779B97F4A7C15) * (chunk + np.uint64(1))) | np.uint64(1))
    if len(places) > 1:
        places[0], keys[0] = places[0][cold], keys[0][cold]
    return np.concatenate(places), np.concatenate(keys)


def _owned(blobs: list, block: int, groups: int, hot: int, piece: int, pieces: int) -> pa.RecordBatch | None:
    parts = []
    for six, at, doc, crc, held in blobs:
        h = np.zeros((len(at), 8), np.uint8)
        h[:, :6] = six.reshape(-1, 6)
        h = h.reshape(-1).view(np.uint64) << np.uint64(16)
        here = (h >> np.uint64(24)) % np.uint64(pieces) == piece if pieces > 1 else slice(None)
        parts.append((h[here], at[here], np.repeat(doc, held)[here], np.repeat(crc, held)[here]))
    h, at, doc, crc = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    if not len(h):
        return None
    h, order = ordered(h)
    at, doc, crc = at[order].astype(np.int64), doc[order], crc[order]
    begin = first_per_value(h)
    size = np.diff(np.append(begin, len(h)))
    owner = np.minimum.reduceat(doc, begin)
    shared = np.repeat(owner != np.maximum.reduceat(doc, begin), size)
    owner = np.repeat(owner, size)
    first = np.repeat(np.minimum.reduceat(np.where(doc == owner, at, np.int64(1) << 62), begin), size)
    if not shared.any():
        return None
    with np.errstate(over="ignore"):
        base = mix64(mix64(owner.view(np.uint64)) + (first // block).astype(np.uint64))[shared]
    at, doc, crc, owner = at[shared], doc[shared], crc[shared], owner[shared]
    size = size[shared[begin]]
    place, key = _chunked(base, np.cumsum(size) - size, size, doc, crc, owner, hot)
    at, doc, crc = at[place], doc[place], crc[place]
    group = group_of(doc, groups)
    order = np.lexsort((at, crc, doc, group))
    group, at, doc, crc, key = group[order], at[order], doc[order], crc[order], key[order]
    begin = first_per_value(group)
    blobs = []
    for a, b in zip(begin, [*begin[1:], len(group)], strict=True):
        first = np.flatnonzero(np.concatenate(([True], (doc[a:b][1:] != doc[a:b][:-1]) | (crc[a:b][1:] != crc[a:b][:-1]))))
        held = np.diff(np.append(first, b - a)).astype(np.uint32)
        blobs.append(pack(at[a:b].astype(np.uint32), key[a:b], doc[a:b][first], crc[a:b][first], held))
    return pa.RecordBatch.from_arrays([pa.array(group[begin].astype(np.int32)), pa.array(blobs, pa.binary())], ["g", "blob"])


class Notes:
    """What is known of the documents of one group: arrays by (doc_id, crc), looked up document by document."""

    def __init__(self, blobs: list[bytes]):
        parts = [unpack(b) for b in blobs]
        self.values: list[np.ndarray] = []
        self.where: dict = {}
        if not parts:
            return
        doc = np.concatenate([np.repeat(p[-3], p[-1]) for p in parts])
        crc = np.concatenate([np.repeat(p[-2], p[-1]) for p in parts])
        order = np.lexsort((crc, doc))
        doc, crc = doc[order], crc[order]
        self.values = [np.concatenate([p[i] for p in parts])[order] for i in range(len(parts[0]) - 3)]
        begin = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]))))
        ends = [*begin[1:].tolist(), len(doc)]
        self.where = {k: (a, b) for k, a, b in zip(zip(doc[begin].tolist(), crc[begin].tolist(), strict=True), begin.tolist(), ends, strict=True)}

    def of(self, doc_id: int, crc: int) -> list[np.ndarray]:
        a, b = self.where.get((doc_id, crc), (0, 0))
        return [v[a:b] for v in self.values]


MEET_SCHEMA = "g int, kind int, doc_id long, crc long, text string, blob binary"


def meet(docs: DataFrame, firsts: DataFrame, blobs: DataFrame, groups: int, parts: int) -> DataFrame:
    """Documents beside what was found out about them, in one partition: per group the blobs, then the first copies, then the texts."""
    g = group_col(F.col("doc_id"), groups)
    none = lambda kind: F.lit(None).cast(kind)
    rows = blobs.select("g", F.lit(0).alias("kind"), none("long").alias("doc_id"), none("long").alias("crc"), none("string").alias("text"), "blob")
    rows = rows.unionByName(firsts.select(g.alias("g"), F.lit(1).alias("kind"), "doc_id", "crc", none("string").alias("text"), none("binary").alias("blob")))
    rows = rows.unionByName(docs.select(g.alias("g"), F.lit(2).alias("kind"), "doc_id", none("long").alias("crc"), "text", none("binary").alias("blob")))
    return rows.repartition(parts, "g").sortWithinPartitions("g", "kind")


def met(batches) -> Iterator[tuple[list[int], list[bytes], list[int], Notes, set]]:
    """Reads what `meet` deals out: slices of documents with the notes of their group."""
    group, blobs, firsts, notes = None, [], set(), None
    for batch in batches:
        g, kind, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        cut = np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, len(g)], strict=True):
            if a == b:
                continue
            if g[a] != group:
                group, blobs, firsts, notes = g[a], [], set(), None
            part = batch.slice(a, b - a)
            if kind[a] == 0:
                blobs += [x.as_py() for x in part.column(5)]
            elif kind[a] == 1:
                firsts.update(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
            else:
                notes = notes or Notes(blobs)
                blobs = []
                ids = part.column(2).to_pylist()
                texts = binary_column(part.column(4))
                for some, these in slices(ids, texts):
                    yield some, these, [zlib.crc32(t) for t in these], notes, firsts


def _segments(units: Units):
    """Cuts the segments of each first copy around its shared anchors."""
    before = units.window - units.gram

    def run(batches):
        for ids, texts, crcs, notes, firsts in met(batches):
            keys, docs, sums, starts, bodies = [], [], [], [], []
            for doc, text, crc in zip(ids, texts, crcs, strict=True):
                if (doc, crc) not in firsts or not (values := notes.of(doc, crc)) or not len(values[0]):
                    continue
                n, cut = units.opened(text)
                at, key = values[0].astype(np.int64), values[1]
                order = np.lexsort((at, key))
                at, key = at[order], key[order]
                a, b = np.maximum(at - before, 0), np.minimum(at + units.window, n)
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (a[1:] > b[:-1])))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                for k, x, y in zip(key[first].view(np.int64).tolist(), a[first].tolist(), b[last].tolist(), strict=True):
                    keys.append(k)
                    starts.append(x)
                    bodies.append(cut(x, y))
                docs += [doc] * len(first)
                sums += [crc] * len(first)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(sums, pa.int64()), pa.array(starts, pa.int64()), pa.array(bodies, pa.binary())], ["key", "doc_id", "crc", "start", "body"])

    return run


#: Bytes of segments that one call of the block operator gets at least, whole blocks each time.
CHUNK = 3 << 19


def _by_group(doc, crc, a, b, groups: int) -> pa.RecordBatch:
    """Spans, packed by document group."""
    group = group_of(doc, groups)
    order = np.lexsort((a, crc, doc, group))
    group, doc, crc, a, b = group[order], doc[order], crc[order], a[order], b[order]
    begin = first_per_value(group)
    blobs = [pack(a[x:y].astype(np.uint32), b[x:y].astype(np.uint32), doc[x:y], crc[x:y].astype(np.uint32), np.ones(y - x, np.uint32)) for x, y in zip(begin, [*begin[1:], len(group)], strict=True)]
    n = len(blobs)
    return pa.RecordBatch.from_arrays([pa.array(group[begin].astype(np.int32)), pa.nulls(n, pa.int32()), pa.array(blobs, pa.binary())], ["g", "bucket", "blob"])


def _unsettled(units: Units, keys, docs, crcs, starts, bodies, body, a, b, buckets: int) -> pa.RecordBatch | None:
    """The windows of chunks that no span holds, packed by hash bucket; the smallest document of a chunk, its owner, has none."""
    odd = np.flatnonzero(keys & 1)
    if not len(odd):
        return None
    begin = first_per_value(keys[odd])
    least = np.repeat(np.minimum.reduceat(docs[odd], begin), np.diff(np.append(begin, len(odd))))
    odd = odd[docs[odd] > least]
    if not len(odd):
        return None
    unit, bounds = units.hashes([bodies[i] for i in odd.tolist()])
    sizes = np.diff(bounds)
    settled = np.zeros(len(unit) + 1, np.int64)
    place = np.full(len(keys), -1)
    place[odd] = np.arange(len(odd))
    here = place[body] >= 0
    np.add.at(settled, bounds[place[body[here]]] + a[here], 1)
    np.add.at(settled, bounds[place[body[here]]] + b[here] - units.window + 1, -1)
    owner = np.repeat(np.arange(len(odd)), sizes)
    at = np.arange(len(unit)) - bounds[owner]
    open_ = np.flatnonzero((np.cumsum(settled)[:-1] == 0) & (at + units.window <= sizes[owner]))
    if not len(open_):
        return None
    one = grams(unit, units.window)[open_]
    two = grams(mix64(unit ^ np.uint64(0xA0761D6478BD642F)), units.window)[open_]
    row = odd[owner[open_]]
    bucket = bucket_of(one, buckets)
    order = np.argsort(bucket, kind="stable")
    first = first_per_value(bucket[order])
    blobs = [pack(one[o], two[o], (starts[row[o]] + at[open_[o]]).astype(np.uint32), docs[row[o]], crcs[row[o]].astype(np.uint32)) for o in np.split(order, first[1:])]
    return pa.RecordBatch.from_arrays([pa.nulls(len(blobs), pa.int32()), pa.array(bucket[order][first]), pa.array(blobs, pa.binary())], ["g", "bucket", "blob"])


def _decide(units: Units, settle: Callable, groups: int, buckets: int):
    """Gathers whole blocks; packs the spans that `settle` finds by document group, and what chunks leave unsettled by bucket."""

    def flush(keys, docs, crcs, starts, bodies):
        keys, docs, crcs, starts = np.asarray(keys, np.int64), np.asarray(docs, np.int64), np.asarray(crcs, np.uint32), np.asarray(starts, np.int64)
        body, a, b = settle(keys, docs, bodies)
        if len(body):
            yield _by_group(docs[body], crcs[body], starts[body] + a, starts[body] + b, groups)
        if (rest := _unsettled(units, keys, docs, crcs, starts, bodies, body, a, b, buckets)) is not None:
            yield rest

    def run(batches):
        held: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if size >= CHUNK and row[0] != held[0][-1]:
                    yield from flush(*held)
                    held, size = ([], [], [], [], []), 0
                for x, v in zip(held, row, strict=True):
                    x.append(v)
                size += len(row[4])
        if size:
            yield from flush(*held)

    return run


def _holders(window: int, groups: int):
    """One bucket's windows after the other: those that a smaller document holds as well, as spans."""

    def run(batches):
        for blobs in by_bucket(batches):
            one, two, at, doc, crc = (np.concatenate(x) for x in zip(*blobs, strict=True))
            order = np.lexsort((doc, two, one))
            one, two, at, doc, crc = one[order], two[order], at[order].astype(np.int64), doc[order], crc[order]
            begin = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
            again = doc > np.repeat(doc[begin], np.diff(np.append(begin, len(doc))))
            if again.any():
                yield _by_group(doc[again], crc[again], at[again], at[again] + window, groups)

    return run


def repeated_spans(docs: DataFrame, units: Units, settle: Callable, tag: str):
    """The plan up to the spans.

    Returns (frame for `met`, whose notes hold each first copy's spans [start, end) to remove; a document
    that isn't among the first copies repeats an earlier text in full).  Rows whose id is null take no part.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = n_parts(docs)
    buckets, groups = n_buckets(docs), 4 * parts
    firsts = docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("doc_id", F.crc32("text").alias("crc"))).alias("m")).select("m.doc_id", "m.crc")
    found = dealt(docs.mapInArrow(_find(units, buckets), "bucket int, blob binary"), parts)
    shared = stage(found.mapInArrow(_own(units.block, groups, HOT), "g int, blob binary"), f"{tag}-anchors")
    firsts = stage(firsts, f"{tag}-firsts")
    segments = meet(docs, firsts, shared, groups, parts).mapInArrow(_segments(units), "key long, doc_id long, crc long, start long, body binary")
    blocks = segments.repartition(parts, "key").sortWithinPartitions("key")
    spans = stage(blocks.mapInArrow(_decide(units, settle, groups, buckets), "g int, bucket int, blob binary"), f"{tag}-spans")
    unstage(shared)
    rest = dealt(spans.where(F.col("bucket").isNotNull()).select("bucket", "blob"), parts).mapInArrow(_holders(units.window, groups), "g int, bucket int, blob binary")
    return meet(docs, firsts, spans.where(F.col("g").isNotNull()).unionByName(rest), groups, parts)
