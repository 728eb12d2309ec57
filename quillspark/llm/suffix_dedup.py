"""Suffix-array dedup: remove byte strings that already start in an earlier document.

Threshold-bounded interval expansion.  The segments that may repeat (see `_blocks`) are joined to one
text per block, from which a Burrows-Wheeler transform is made.  Starting from the interval of the empty
string, a breadth-first backward extension visits the suffix intervals of all strings by growing length;
the first interval that ends at a suffix fixes its common prefix with the suffix before it, so common
prefixes come out by increasing value.  The walk stops at the minimum length: boundaries it hasn't reached
have a common prefix of at least that length, and the runs between reached boundaries are the classes of
suffixes that start with the same string.  In each class, every suffix of a later document than the
smallest one marks its first `min_bytes` bytes for removal.

Defined results: a null text is empty; a row with a null id keeps all its bytes and takes part in no
comparison; rows with the same id never remove from each other, so repeated rows get the same result;
texts shorter than `min_bytes` keep everything; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._blocks import Units, met, repeated_spans
from quillspark.llm._common import mix64, runs

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least (ties in any order); symbols past the end are 0."""
    n = len(text)
    bits = max(1, n.bit_length())
    idx = np.arange(n, dtype=np.uint64)
    width = (64 - bits) // 8
    pad = np.concatenate((text, np.zeros(width, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = key << np.uint64(8) | pad[i : i + n]
    mask = np.uint64((1 << bits) - 1)
    both = np.sort(key << np.uint64(bits) | idx)
    del pad, key
    done = width
    while True:
        order = (both & mask).astype(np.int64)
        if done >= depth:
            return order
        head = both >> np.uint64(bits)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([True], head[1:] != head[:-1])), dtype=np.int64).astype(np.uint64)
        then = np.zeros(n, np.uint64)
        then[: max(0, n - done)] = rank[done:]
        if 3 * bits <= 64:
            both = np.sort(rank << np.uint64(2 * bits) | then << np.uint64(bits) | idx)
        else:  # a block of several million bytes
            order = np.argsort(rank << np.uint64(32) | then, kind="stable")
            head = (rank << np.uint64(32) | then)[order]
            dense = np.cumsum(np.concatenate(([True], head[1:] != head[:-1])), dtype=np.int64).astype(np.uint64)
            both = dense << np.uint64(bits) | order.astype(np.uint64)
        done *= 2


class Wavelet:
    """Ranks of all symbols of a byte sequence: a bit row per level, zeros first."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        cur, self.bits = symbols, max(1, int(symbols.max(initial=0)).bit_length())
        for b in range(self.bits - 1, -1, -1):
            one = (cur >> b & 1).astype(bool)
            zeros = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((zeros, int(zeros[-1])))
            cur = np.concatenate((cur[~one], cur[one]))

    def split(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all intervals [lo, hi): each symbol in one, and its interval in the last level's order."""
        sym = np.zeros(len(lo), np.uint8)
        for zeros, n0 in self.levels:
            a, b = zeros[lo], zeros[hi]
            c, d = n0 + lo - a, n0 + hi - b
            left, right = b > a, d > c
            lo = np.concatenate((a[left], c[right]))
            hi = np.concatenate((b[left], d[right]))
            sym = np.concatenate((sym[left] << 1, sym[right] << 1 | 1))
        return sym, lo, hi


def short_boundaries(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """True at i if suffixes i-1 and i of the order share fewer than `depth` symbols (strings over the separator 0 aside)."""
    n = len(symbols)
    bwt = symbols[order - 1]
    wavelet = Wavelet(bwt)
    counts = np.bincount(symbols, minlength=256)
    below = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int32)
    # where each symbol's run begins in the last level: descend with the empty prefix
    base = np.zeros(256, np.int32)
    for s in np.flatnonzero(counts):
        at = 0
        for (zeros, n0), b in zip(wavelet.levels, range(wavelet.bits - 1, -1, -1), strict=True):
            at = n0 + at - zeros[at] if s >> b & 1 else zeros[at]
        base[s] = at
    shift = below - base
    reached = np.zeros(n + 1, bool)
    reached[0] = reached[n] = True
    lo, hi = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(depth):
        sym, lo, hi = wavelet.split(lo, hi)
        use = sym > 0
        sym, lo, hi = sym[use], lo[use], hi[use]
        lo, hi = lo + shift[sym], hi + shift[sym]
        new = ~reached[hi]
        lo, hi = lo[new], hi[new]
        reached[hi] = True
        if not len(lo):
            break
    return reached


def repeats(bodies: list[bytes], doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (body, start, end) of the bytes covered by strings of `depth` bytes that also start in a body of a smaller document."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    first = np.cumsum(sizes + 1) - sizes - 1
    used = np.zeros(256, bool)
    used[raw] = True
    ends = first + sizes
    inside = np.ones(len(raw), bool)
    inside[ends] = False
    code = np.zeros(256, np.uint8)
    if used.sum() < 256 or raw[inside].min(initial=1):
        zero = bool((raw[inside] == 0).any())
        code[used] = np.cumsum(used)[used] - (0 if zero else 1)
    else:
        raise ValueError("a text holds all 256 byte values")  # impossible in UTF-8
    symbols = np.where(inside, code[raw], 0).astype(np.uint8)
    order = suffix_order(symbols, depth)
    reached = short_boundaries(symbols, order, depth)
    owner = np.repeat(np.arange(len(bodies)), sizes + 1)
    whole = (np.arange(len(raw)) + depth <= ends[owner])[order]
    cls = np.cumsum(reached[:-1])[whole]
    at = order[whole]
    who = doc[owner[at]]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    begin = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    least = np.repeat(np.minimum.reduceat(who, begin), np.diff(np.append(begin, len(at))))
    hit = np.zeros(len(raw), bool)
    hit[at[who > least]] = True
    a, b = runs(hit)
    body = owner[a]
    return body, a - first[body], b - 1 + depth - first[body]


def _settle(depth: int):
    def settle(keys, docs, bodies):
        return repeats(bodies, docs, depth)

    return settle


def _hashes(texts: list[bytes]):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return _BYTE[raw], np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))


def _opened(text: bytes):
    return len(text), lambda a, b: text[a:b]


def byte_units(min_bytes: int) -> Units:
    gram = max(1, min(20, min_bytes - 1))
    return Units(window=min_bytes, gram=gram, block=4096, hashes=_hashes, opened=_opened)


def covered(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs; touching spans join."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1)
    return runs(np.cumsum(step)[:n] > 0)


def _apply(min_bytes: int):
    def run(batches):
        for ids, texts, crcs, notes, firsts in met(batches):
            out = []
            for doc, text, crc in zip(ids, texts, crcs, strict=True):
                n = len(text)
                if (doc, crc) not in firsts:
                    out.append((doc, n, n, 1, b"") if n >= min_bytes else (doc, n, 0, 0, text))
                    continue
                values = notes.of(doc, crc)
                if not values or not len(values[0]):
                    out.append((doc, n, 0, 0, text))
                    continue
                a, b = covered(n, values[0].astype(np.int64), values[1].astype(np.int64))
                kept = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), n], strict=True))
                out.append((doc, n, n - len(kept), len(a), kept))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def suffix_dedup(docs: DataFrame, min_bytes: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each row of `docs` (doc_id, text)."""
    rest = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"))
    rest = rest.select("doc_id", F.length("kept").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept")
    done = repeated_spans(docs, byte_units(min_bytes), _settle(min_bytes), "suffix").mapInArrow(_apply(min_bytes), SCHEMA)
    return done.unionByName(rest)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["digest", "repeats", "suffix_dedup"]
