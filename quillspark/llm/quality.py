"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger holds the measurements and one bit per failed rule.
Policies are versioned masks over those bits: applying one is a bitwise AND, and an ablation (what would be
kept without rule r?) is a sum over the ledger that never touches the texts again.

Words are runs of anything but space and \\x09-\\x0D, lines are split at \\n.  Defined results: a null text
has no words and no lines, so it fails `few_words`; ids are passed on as they are, null or repeated; an empty
table gives an empty ledger; further columns of the input are ignored by the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_bars")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
_SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20

#: The rules in the order of their bits: a rule fails where its condition holds.
RULES: dict[str, Column | str] = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "10 * word_chars < 15 * n_words",
    "duplicate_lines": "n_dup_lines > 3 and 100 * n_dup_lines > 30 * n_lines",
    "shouting": "100 * n_upper_words > 60 * n_words",
    "lists": "100 * n_bars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A named version of the set of rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r in self.rules)


BASE_POLICY = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE_POLICY, Policy("v1", tuple(RULES)))}


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in windows of `WINDOW` words found twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    width, top = 1, len(ids)
    while width < WINDOW:  # exact: a pair of ranks becomes one rank
        pair = code[:-width] * top + code[width:]
        values, code = np.unique(pair, return_inverse=True)
        if len(values) == len(pair):
            return 0
        width, top = width * 2, len(values)
    twice = np.bincount(code)[code] > 1
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + WINDOW, -1)
    return int((np.cumsum(mark)[:n] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = text.split(b"\n") if text else []
    full = [x for x in lines if x and not x.isspace()]
    solid = b"".join(words)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    return len(words), chars, symbols, len(full) - len(set(full)), repeat_words(words), len(full), upper, words.count(b"|")


def _measure(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        rows = [measure(t.as_py() or b"") for t in texts]
        cols = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *MEASURES])


def fail_bits() -> Column:
    return sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0)).cast("long").alias("fail_bits")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits for each row of `docs` (doc_id, text). One narrow pass."""
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, SCHEMA)
    return measured.select("*", fail_bits())


def _beside(batches):
    for batch in batches:
        rows = [measure(t.as_py() or b"") for t in batch.column(batch.schema.get_field_index("_qs_text")).cast(pa.binary())]
        cols = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], [*batch.schema.names, *(f"_qs_{m}" for m in MEASURES)])


def keep(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The rows of `docs` (text, ...) that pass a policy, all columns as they are; the ledger is made beside them, with no join."""
    rest = [F.col(c) for c in docs.columns if c != "text"] or [F.lit(0).alias("_qs_none")]
    wide = docs.select(F.struct(*rest).alias("_qs_row"), F.col("text").cast("string").alias("_qs_text"))
    schema = T.StructType([*wide.schema.fields, *(T.StructField(f"_qs_{m}", T.LongType()) for m in MEASURES)])
    measured = wide.mapInArrow(_beside, schema).select("_qs_row", "_qs_text", *(F.col(f"_qs_{m}").alias(m) for m in MEASURES))
    kept = measured.withColumn("fail_bits", fail_bits()).where(passes(policy))
    return kept.select(*(F.col("_qs_text").cast(docs.schema["text"].dataType).alias(c) if c == "text" else F.col("_qs_row").getField(c).alias(c) for c in docs.columns))


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(rows: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    return rows.withColumn("kept", passes(policy)).withColumn("policy", F.lit(policy.version))


def ablation(rows: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """rule, n_failed, n_only (rejected by this rule alone), n_kept_without: one aggregation over the bits."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    names = [r for r in RULES if r in policy.rules]
    bit = {r: 1 << i for i, r in enumerate(RULES)}
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    sums = rows.agg(
        *(count(bits.bitwiseAND(F.lit(bit[r])) != 0).alias(f"f_{r}") for r in names),
        *(count(bits == bit[r]).alias(f"o_{r}") for r in names),
        count(bits == 0).alias("kept"),
    )
    each = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only"), (F.col("kept") + F.col(f"o_{r}")).alias("n_kept_without")) for r in names))
    return sums.select(F.inline(each))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE_POLICY)).alias("base_failed"), (passes(BASE_POLICY) & F.col("kept")).alias("kept"), "fail_bits", "policy")
