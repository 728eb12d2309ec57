"""Substring dedup: remove word sequences that already start in an earlier document.

Relative Lempel-Ziv parsing.  The segments that meet in a block (see `_blocks`) are taken by growing id.
Each is factored greedily against the index of all reference blocks before it: where the next `min_words`
words start in a reference, the factor runs as far as the two agree, else one word passes as a literal.
Factors of `min_words` or more become duplicate spans.  A window may straddle two factors, so parsing
resumes `min_words` - 1 words before a factor's end and looks those windows up as well; with that check no
window is missed.  Then the segment's new windows join the index.

Defined results: a null text has no words; a row with a null id keeps all its words and takes part in no
comparison; rows with the same id never remove from each other, so repeated rows get the same result;
texts shorter than `min_words` keep everything; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._blocks import Units, binary_column, grams, met, repeated_spans
from quillspark.llm.suffix_dedup import covered

SCHEMA = "doc_id long, n_words long, n_removed long, n_spans long, kept string"


class WordHashes(dict):
    """Signed 64-bit hash of each word, remembered up to a bound."""

    MOST = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return value


_WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words)).view(np.uint64)


def _hashes(texts: list[bytes]):
    parts = [t.split() for t in texts]  # bytes split at space and \x09-\x0D only
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
    return word_hashes([w for p in parts for w in p]), bounds


def _opened(text: bytes):
    words = text.split()
    return len(words), lambda a, b: b" ".join(words[a:b])


def word_units(min_words: int) -> Units:
    return Units(window=min_words, gram=max(1, min(8, min_words - 1)), block=1024, hashes=_hashes, opened=_opened)


def factor(words: list[bytes], window: list[int], index: dict, refs: list[list[bytes]], least: int) -> list[tuple[int, int]]:
    """Factors of `least` words or more as [start, end); `window[i]` is the hash of the `least` words from i."""
    out, i, n = [], 0, len(words)
    while i < len(window):
        if (found := index.get(window[i])) is not None:
            ref, at = refs[found[0]], found[1]
            if ref[at : at + least] == words[i : i + least]:
                size, most = least, min(n - i, len(ref) - at)
                while size < most and ref[at + size] == words[i + size]:
                    size += 1
                out.append((i, i + size))
                i += size - least  # the windows across the factor's end come next
        i += 1
    return out


def _settle(least: int):
    def settle(keys, docs, bodies):
        words = [b.split() for b in bodies]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes) - sizes
        flat = word_hashes([w for p in words for w in p])
        hashes = grams(flat, least).view(np.int64) if len(flat) >= least else np.zeros(0, np.int64)
        which, froms, tos = [], [], []
        order = np.lexsort((docs, keys))
        index: dict = {}
        refs: list[list[bytes]] = []
        waiting: list[tuple[int, list[int]]] = []
        last = (None, None)
        for x in order.tolist():
            if (keys[x], docs[x]) != last:
                if last[0] != keys[x]:
                    index, refs, waiting = {}, [], []
                for y, window in waiting:  # rows with the same id don't refer to each other
                    refs.append(words[y])
                    k = len(refs) - 1
                    for i, h in enumerate(window):
                        index.setdefault(h, (k, i))
                waiting, last = [], (keys[x], docs[x])
            if sizes[x] < least:
                continue
            window = hashes[first[x] : first[x] + sizes[x] - least + 1].tolist()
            spans = factor(words[x], window, index, refs, least)
            for a, b in spans:
                which.append(x)
                froms.append(a)
                tos.append(b)
            if not (len(spans) == 1 and spans[0] == (0, sizes[x])):
                waiting.append((x, window))
        return np.asarray(which, np.int64), np.asarray(froms, np.int64), np.asarray(tos, np.int64)

    return settle


def _apply(least: int):
    def run(batches):
        for ids, texts, crcs, notes, firsts in met(batches):
            out = []
            for doc, text, crc in zip(ids, texts, crcs, strict=True):
                words = text.split()
                n = len(words)
                if (doc, crc) not in firsts:
                    out.append((doc, n, n, 1, "") if n >= least else (doc, n, 0, 0, b" ".join(words).decode()))
                    continue
                values = notes.of(doc, crc)
                if not values or not len(values[0]):
                    out.append((doc, n, 0, 0, b" ".join(words).decode()))
                    continue
                a, b = covered(n, values[0].astype(np.int64), values[1].astype(np.int64))
                kept = [w for x, y in zip([0, *b.tolist()], [*a.tolist(), n], strict=True) for w in words[x:y]]
                out.append((doc, n, n - len(kept), len(a), b" ".join(kept).decode()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], ["doc_id", "n_words", "n_removed", "n_spans", "kept"])

    return run


def _whole(batches):
    for batch in batches:
        rows = [t.split() for t in binary_column(batch.column(1))]
        n = pa.array(map(len, rows), pa.int64())
        zero = pa.array([0] * len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), n, zero, zero, pa.array([b" ".join(r).decode() for r in rows], pa.string())], ["doc_id", "n_words", "n_removed", "n_spans", "kept"])


def substring_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept (words joined by one space) for each row of `docs` (doc_id, text)."""
    rest = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(_whole, SCHEMA)
    done = repeated_spans(docs, word_units(min_words), _settle(min_words), "substring").mapInArrow(_apply(min_words), SCHEMA)
    return done.unionByName(rest)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["digest", "factor", "substring_dedup"]
