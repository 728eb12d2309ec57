"""Bounded-space online packing of tokenised documents into fixed-length sequences.

Each partition keeps `open_windows` windows.  A document's whole sequences of `length` ids go straight out;
the rest goes best-fit: into the open window it leaves least room in.  When none fits and all windows are in
use, the fullest is topped up with the first ids of the rest (cuts are free) and emitted full, and what
remains of the rest is placed again.  At the end of the partition the windows left over are merged: their
pieces are laid end to end and cut at `length`; the tail is cut at powers of two, which need no padding.

Nothing moves between tasks, and a lost task is repeated with the same result: sequence ids combine the
partition's number with a counter.  Memory is bounded by the open windows and one document.

Tokens: where the vocabulary's rules are known to split at white space and to drop it, a text is split there
first, so words can be tokenised once and remembered; with any other rules whole texts are tokenised.  Defined results: a null text is empty and gives only
the end id; ids are passed on as they are, null or repeated; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._blocks import binary_column

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Words remembered, in two generations: those of the older one move to the younger when they are met again.
_GENERATION = 1 << 18
#: The rules under which words can be tokenised one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one past 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    more = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(more)) for b in range(256)]


class WordIds(dict):
    """The ids of each word, as little-endian unsigned 32-bit values, remembered up to a bound.

    A word of letters up to U+00FF, all of which are their own composed forms, goes in lower case straight to the
    vocabulary's model, byte by byte, which is what its rules would hand on; behind such a letter a full stop or comma is
    a token of its own; all other words take the whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.words = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        rules = json.loads(tokenizer.to_str())
        marked = all(re.search(r"[^A-Za-z.,]", t["content"]) and not (re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"]) for t in rules["added_tokens"])
        self.by_word = marked and rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == _PRE_TOKENIZER and rules["post_processor"] is None

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _GENERATION:
            self.older = self.copy()
            self.clear()
        if (ids := self.older.get(word)) is not None:
            pass
        elif word.isalpha():  # bytes: ASCII letters only
            ids = b"".join([self.words[t.id] for t in self.model(word.lower().decode())])
        elif (text := word.decode()).isalpha() and max(text) <= "\u00ff":
            ids = b"".join([self.words[t.id] for t in self.model(text.lower().encode().decode("latin-1").translate(self.letters))])
        elif text[-1] in ".," and text[-2:-1].isalpha() and max(text) <= "\u00ff":
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def whole(self, text: bytes) -> bytes:
        return np.asarray(self.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: bytes) -> bytes:
        """The ids of a whole text."""
        return b"".join([self[w] for w in text.split()]) if self.by_word else self.whole(text)


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


class Packer:
    """The windows of one partition. `place` and `finish` append rows to `out`."""

    def __init__(self, length: int, open_windows: int, first_sequence: int):
        self.length, self.most, self.next = length, open_windows, first_sequence
        self.windows: list[tuple[int, list]] = []
        self.out: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, ids, total, self.next, at))
            at += n
        self.next += 1

    def place(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.length:
            self.emit([(doc, at, ids[4 * at : 4 * (at + self.length)], total)])
            at += self.length
        while at < total:
            n = total - at
            fit = max((i for i, w in enumerate(self.windows) if w[0] + n <= self.length), key=lambda i: self.windows[i][0], default=None)
            if fit is None and len(self.windows) < self.most:
                self.windows.append((n, [(doc, at, ids[4 * at :], total)]))
                return
            if fit is None:
                fit = max(range(len(self.windows)), key=lambda i: self.windows[i][0])
                n = self.length - self.windows[fit][0]
            used, pieces = self.windows[fit]
            pieces.append((doc, at, ids[4 * at : 4 * (at + n)], total))
            if used + n == self.length:
                self.emit(pieces)
                del self.windows[fit]
            else:
                self.windows[fit] = (used + n, pieces)
            at += n

    def finish(self) -> None:
        pieces = [p for _, w in sorted(self.windows, key=lambda w: -w[0]) for p in w]
        left = sum(len(p[2]) // 4 for p in pieces)
        self.windows = []
        while left:
            room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            left -= room
            row = []
            while room:
                doc, start, ids, total = pieces.pop(0)
                n = min(room, len(ids) // 4)
                row.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    pieces.insert(0, (doc, start + n, ids[4 * n :], total))
                room -= n
            self.emit(row)


def _pack(path: str, end_id: int, length: int, open_windows: int):
    def batch_of(rows):
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def run(batches):
        ids_of = word_ids(path)
        end = np.asarray([end_id], "<u4").tobytes()
        packer = Packer(length, open_windows, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), binary_column(batch.column(1)), strict=True):
                packer.place(doc, ids_of.of(text) + end)
                if len(packer.out) >= 2000:
                    yield batch_of(packer.out)
                    packer.out = []
        packer.finish()
        if packer.out:
            yield batch_of(packer.out)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 4096, open_windows: int = 16, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    `tokenizer` is the path of a vocabulary file, present on every worker.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack(tokenizer, end_id, length, open_windows), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
