"""Line dedup by pairwise alignment.

Overlapping documents are found through shared *runs*: consecutive lines, one or more, that reach `min_words`
words and would not without the first or without the last of them.  Every line of a block that may be deleted
lies in such a run of that block, so all runs propose pairs, however many documents hold them.  Lines too short
to be deleted alone also propose pairs if they are rare: few documents hold them, or they mostly stand between
the same neighbours.  Each document is paired with the *owners* of its runs and rare lines, the smallest
documents that hold them; the number of pairs is at most three times that of the lines, however large a group
is.  Each pair is aligned by patience diff over line hashes (lines that are unique in both
anchor a longest increasing chain, the gaps are aligned in turn; in a gap without such lines, equal lines are
numbered), and the aligned common blocks of `min_words` words or more are deleted from the later document.  What
an alignment cannot hold, as it stands in another order or more often than in the owner, is looked up by its
runs and deleted as well.  So a line goes exactly if it lies in a block of consecutive lines, blank ones aside,
of `min_words` words or more that a document with a smaller id also holds.  Decisions are made on the input texts.

Lines are split at \\n and compared without surrounding white space; blank lines are never compared and stay,
but for those between two deleted lines.  Defined results: a null text stays null with no lines; a row with a
null id is returned as it is; rows with the same id never delete from each other, so repeated rows get the
same result; an empty table gives an empty result; all columns of the input are returned.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._blocks import binary_column
from quillspark.llm._common import stage

LINES = "doc_id long, h long, lines array<long>, at array<int>, words array<int>, runs array<long>"
#: Pairs whose lines are unpacked at once.
PAIRS = 256


def runs(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(begin, end) of the shortest runs of lines from each line and up to each line that reach `min_words` words."""
    total, need = np.concatenate(([0], np.cumsum(words, dtype=np.int64))), max(1, min_words)
    begin = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + need)
    out = set(zip(begin[end <= len(words)].tolist(), end[end <= len(words)].tolist(), strict=True))
    first = np.searchsorted(total, total[1:] - need, "right") - 1
    return sorted(out | set(zip(first[first >= 0].tolist(), (begin + 1)[first >= 0].tolist(), strict=True)))


def _lines(min_words: int):
    def run(batches):
        for batch in batches:
            hashes, ats, words, keys = [], [], [], []
            for text in binary_column(batch.column(2)):
                row = [(i, s) for i, x in enumerate(text.split(b"\n")) if (s := x.strip())]
                hashes.append([xxhash.xxh64_intdigest(s) - (1 << 63) for _, s in row])
                ats.append([i for i, _ in row])
                words.append([len(s.split()) for _, s in row])
                raw = np.array(hashes[-1], np.int64).tobytes()
                keys.append(list({xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) - (1 << 63) for a, b in runs(words[-1], min_words)}))
            arrays = [pa.array(hashes, pa.list_(pa.int64())), pa.array(ats, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "h", "lines", "at", "words", "runs"])

    return run


def numbered(lines: list) -> list[tuple]:
    """Each line with the number of equal ones before it."""
    seen: Counter = Counter()
    out = []
    for x in lines:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        once_a, once_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        where = {x: j for j, x in enumerate(b[j0:j1], j0) if once_b[x] == 1}
        both = [(i, where[x]) for i, x in enumerate(a[i0:i1], i0) if once_a[x] == 1 and x in where]
        if not both:
            # no line is unique on both sides: the k-th of equal lines stands for the k-th of the other side
            where = {x: j for j, x in enumerate(numbered(b[j0:j1]), j0)}
            both = [(i, where[x]) for i, x in enumerate(numbered(a[i0:i1]), i0) if x in where]
        if not both:
            continue
        tails, ends, back = [], [], [-1] * len(both)
        for k, (_, j) in enumerate(both):
            at = bisect.bisect_left(tails, j)
            back[k] = ends[at - 1] if at else -1
            tails[at : at + 1] = [j]
            ends[at : at + 1] = [k]
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        i, j = i0, j0
        for x, y in reversed(chain):
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, i1, j, j1))
    return sorted(out)


def common_blocks(matches: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Maximal runs (i, j, length) of matches that advance together."""
    out: list[tuple[int, int, int]] = []
    for i, j in matches:
        if out and (i, j) == (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]):
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


def moved(later: list, earlier: list, words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(begin, end) of the runs of the later text that stand anywhere in the earlier one, in whatever order and however often."""
    known = dict(zip(later, words, strict=True))
    held = {tuple(earlier[i:j]) for i, j in runs([known.get(x, 1) for x in earlier], min_words)}
    return [(i, j) for i, j in runs(words, min_words) if tuple(later[i:j]) in held]


def deleted_lines(later: list, earlier: list, at: list[int], words: list[int], min_words: int) -> list[int]:
    """Line numbers of the later text that lie in common blocks, with the blank lines inside a block."""
    blocks = [(i, i + n) for i, _, n in common_blocks(patience(later, earlier)) if sum(words[i : i + n]) >= min_words]
    if blocks != [(0, len(later))]:
        blocks += moved(later, earlier, words, min_words)
    out: list[int] = []
    for i, j in sorted(blocks):
        out += range(max(at[i], out[-1] + 1 if out else 0), at[j - 1] + 1)
    return out


def _align(min_words: int):
    def run(batches):
        for batch in (b.slice(i, PAIRS) for b in batches for i in range(0, b.num_rows, PAIRS)):
            docs, hs, ats, gone = [], [], [], []
            for doc, h, a, at, words, b in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if found := deleted_lines(a, b, at, words, min_words):
                    docs.append(doc)
                    hs.append(h)
                    ats.append(at)
                    place = {x: k for k, x in enumerate(at)}
                    gone.append([place[x] for x in found if x in place])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hs, pa.int64()), pa.array(ats, pa.list_(pa.int32())), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "h", "at", "gone"])

    return run


def overlapping(lines: DataFrame, min_words: int, rare_df: int, rare_words: int) -> DataFrame:
    """(doc_id, h, owner): each document with the smallest documents that hold its runs and its short rare lines."""
    short = lines.select("doc_id", "h", F.posexplode("lines").alias("i", "line"), "lines", "words")
    around = F.xxhash64(F.get("lines", F.col("i") - 1), F.get("lines", F.col("i") + 1))
    short = short.where((F.get("words", "i") >= rare_words) & (F.get("words", "i") < min_words)).select("doc_id", "h", "line", around.alias("around"))
    rows = lines.select("doc_id", "h", F.explode("runs").alias("line"), F.lit(None).cast("long").alias("around")).unionByName(short)
    places = rows.groupBy("line", "around").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h")).alias("first"), F.max("doc_id").alias("last"))
    owners = (
        places.groupBy("line")
        .agg(F.sum("n").alias("n"), F.count("*").alias("places"), F.count("around").alias("short"), F.min("first").alias("owner"), F.max("last").alias("last"))
        .where((F.col("last") > F.col("owner.doc_id")) & ((F.col("short") == 0) | (F.col("n") <= rare_df) | (2 * F.col("places") <= F.col("n"))))
        .select("line", "owner")
    )
    # written, so that the join deals both sides anew and can split a line that very many documents hold
    found = rows.select("doc_id", "h", "line").join(stage(owners, "line-owners"), "line")
    return found.where(F.col("owner.doc_id") < F.col("doc_id")).select("doc_id", "h", "owner").distinct()


def deletions(docs: DataFrame, min_words: int, rare_df: int, rare_words: int) -> DataFrame:
    """(doc_id, h, gone): the line numbers to delete, by document and hash of its text."""
    slim = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    # written after the deduplication, so that the joins below deal its rows anew and can split a hot owner
    lines = stage(slim.mapInArrow(_lines(min_words), LINES).dropDuplicates(["doc_id", "h"]), "lines")
    pairs = stage(overlapping(lines, min_words, rare_df, rare_words), "line-pairs")
    mine = pairs.join(lines.drop("runs"), ["doc_id", "h"])
    theirs = lines.select(F.col("doc_id").alias("o"), F.col("h").alias("oh"), F.col("lines").alias("theirs"))
    both = mine.join(theirs, (F.col("owner.doc_id") == F.col("o")) & (F.col("owner.h") == F.col("oh")))
    found = both.select("doc_id", "h", "lines", "at", "words", "theirs").mapInArrow(_align(min_words), "doc_id long, h long, at array<int>, gone array<int>")
    places = found.groupBy("doc_id", "h").agg(F.first("at").alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("k"))
    # blank lines between two that go, be it in blocks of different owners, go too
    last = lambda x, i: F.when(F.get("k", i + 1) == x + 1, F.get("at", x + 1) - 1).otherwise(F.get("at", x))
    return places.select("doc_id", "h", F.flatten(F.transform("k", lambda x, i: F.sequence(F.get("at", x), last(x, i)))).alias("gone"))


def line_dedup(docs: DataFrame, min_words: int = 20, rare_df: int = 10, rare_words: int = 4) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) with `text` cleaned, `_qs_lines` and `_qs_removed` added or replaced."""
    docs = docs.drop("_qs_lines", "_qs_removed")
    gone = deletions(docs, min_words, rare_df, rare_words).select(F.col("doc_id").alias("_qs_doc"), F.col("h").alias("_qs_h"), F.col("gone").alias("_qs_gone"))
    rows = docs.join(gone, (F.col("doc_id").cast("long") == F.col("_qs_doc")) & (F.xxhash64("text") == F.col("_qs_h")), "left")
    rows = rows.withColumn("_qs_split", F.split("text", "\n", -1))  # a column of its own, so that lambdas don't split again
    n, m = F.size("_qs_split"), F.size("_qs_gone")
    # the stretches between deleted lines
    begin = lambda i: F.when(i > 0, F.get("_qs_gone", i - 1) + 1).otherwise(0)
    end = lambda i: F.when(i < m, F.get("_qs_gone", i)).otherwise(n)
    stretches = F.transform(F.sequence(F.lit(0), m), lambda i: F.slice("_qs_split", begin(i) + 1, end(i) - begin(i)))
    text = F.when(F.col("_qs_gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(stretches), "\n"))
    return rows.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.greatest(n, F.lit(0)).cast("long").alias("_qs_lines"),
        F.greatest(m, F.lit(0)).cast("long").alias("_qs_removed"),
    )


def digest(result: DataFrame) -> DataFrame:
    n = F.when(F.col("text").isNull() & (F.col("_qs_removed") == 0), 0).otherwise(F.col("_qs_lines"))
    return result.select("doc_id", n.cast("long").alias("n_lines"), F.col("_qs_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
