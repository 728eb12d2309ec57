"""Secret scans: who else holds a candidate?

Base kinds are `assign` (a keyword, a separator and a value), `access` (AKIA identifiers) and `hex`; further
kinds are `private_key` (its value is the key's body), `token` (prefixed service tokens) and `jwt`.  Corpus-wide
ownership: each candidate value is hashed and counted over distinct repositories and owners.  A value that
`shared_from` owners hold, or two owners in `shared_repositories` repositories, is a copied example; any other
that mixes letters and digits looks live.

DataFrame functions only.  Positions come from splitting at the pattern: the pieces and the matches alternate,
so their lengths add up to the offsets, in code points; sums are taken over stretches of sqrt(n) matches and
over the stretches before, so a text with very many matches costs n * sqrt(n).  Texts stay where they are read:
only (row, hash, repository, owner) are shuffled, summed before, and the join back is one that Spark can split.

Defined results: a null text is empty; ids are passed on as they are, null or repeated (rows are told apart
by a number of their own); a null repository or owner counts as one more; an empty value (a key without a
body) belongs to nobody; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import stage

#: kind, pattern, group with the value, least length of the match, least length of the value
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 0, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24, 24),  # a shorter run matches nowhere, so this finds what the plain run finds
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\x20\x09-\x0D]*)(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?", 1, 0, 0),
    ("token", r"(?:gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, 0),
)
BASE = ("assign", "access", "hex")
KINDS = tuple(p[0] for p in PATTERNS)
#: Sums of matches' lengths are taken over stretches of so many matches at least.
STRETCH = 16


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _matched(rows: DataFrame) -> DataFrame:
    """Adds, for each kind, found_<kind>, value_<kind> and end_<kind>: the matches, their values, where they end.

    Every array that a lambda reads is a column of the projection below, referenced twice, so that it is worked out
    once a row.
    """
    text = F.col("text")
    add = lambda df, make: df.select("*", *(make(k).alias(f"{name}_{k}") for name, make in make.items() for k in KINDS))
    some = lambda k, there, kind: F.when(F.size(f"found_{k}") > 0, there).otherwise(F.array().cast(f"array<{kind}>"))
    rows = rows.select("*", *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"found_{k}") for k, p, *_ in PATTERNS))
    # the second look at a text is for those with a match only
    rows = rows.select("*", *(some(k, F.regexp_extract_all(text, F.lit(p), F.lit(g)), "string").alias(f"value_{k}") for k, p, g, *_ in PATTERNS if g), *(some(k, F.split(text, p, -1), "string").alias(f"gap_{k}") for k, p, *_ in PATTERNS))
    rows = add(rows, {"step": lambda k: some(k, F.zip_with(F.col(f"found_{k}"), F.slice(f"gap_{k}", 1, F.size(f"found_{k}")), lambda m, g: F.length(m) + F.length(g)), "int")})
    rows = add(rows, {"wide": lambda k: F.greatest(F.lit(STRETCH), F.ceil(F.sqrt(F.size(f"step_{k}"))).cast("int"))})
    stretch = lambda k, j, n: F.slice(f"step_{k}", j * F.col(f"wide_{k}") + 1, n)
    count = lambda k: F.ceil(F.size(f"step_{k}") / F.col(f"wide_{k}")).cast("int")
    rows = add(rows, {"sum": lambda k: F.when(F.size(f"step_{k}") > 0, F.transform(F.sequence(F.lit(0), count(k) - 1), lambda j: _sum(stretch(k, j, F.col(f"wide_{k}"))))).otherwise(F.array().cast("array<int>"))})
    rows = add(rows, {"before": lambda k: F.transform(f"sum_{k}", lambda _, j: _sum(F.slice(f"sum_{k}", 1, j)))})
    at = lambda k, i: F.floor(i / F.col(f"wide_{k}")).cast("int")
    end = lambda k: F.when(F.size(f"before_{k}") > 0, F.transform(f"step_{k}", lambda _, i: F.get(f"before_{k}", at(k, i)) + _sum(stretch(k, at(k, i), i % F.col(f"wide_{k}") + 1)))).otherwise(F.array().cast("array<int>"))
    return add(rows, {"end": end})


def _spans(order: int, kind: str, group: int, least: int, value_least: int) -> Column:
    """array<struct<start, rank, end, kind, value>> of one kind."""
    zipped = F.arrays_zip(F.col(f"found_{kind}").alias("m"), F.col(f"value_{kind}" if group else f"found_{kind}").alias("v"), F.col(f"end_{kind}").alias("e"))
    spans = F.transform(zipped, lambda p: F.struct((p["e"] - F.length(p["m"])).alias("start"), F.lit(order).alias("rank"), p["e"].alias("end"), F.lit(kind).alias("kind"), p["v"].alias("value")))
    return F.filter(spans, lambda s: (s["end"] - s["start"] >= least) & (F.length(s["value"]) >= value_least))


def candidates(docs: DataFrame, repository: str | Column = "source", owner: str | Column = "source") -> DataFrame:
    """row, doc_id, repository, owner and all spans with the hash of their values; narrow rows without the text."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), column(repository).cast("string").alias("repository"), column(owner).cast("string").alias("owner"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = F.array_sort(F.concat(*(_spans(i, k, *rest) for i, (k, _, *rest) in enumerate(PATTERNS))))
    solid = lambda s: F.when(s["kind"] == "private_key", F.translate(s["value"], " \t\n\x0b\x0c\r", "")).otherwise(s["value"])
    hashed = lambda v: F.when(v != "", F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b")))
    slim = F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), hashed(solid(s)).alias("value"), (s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")).alias("mixed")))
    return _matched(rows).select("doc_id", "repository", "owner", spans.alias("all")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", slim.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """value, n_found, n_repositories, n_owners: the corpus-wide frequencies, summed before they are shuffled."""
    values = found.select("repository", "owner", F.explode("spans").alias("s")).where(F.col("s.value").isNotNull())
    each = values.groupBy(F.col("s.value").alias("value"), "repository", "owner").agg(F.count("*").alias("n"))
    distinct = lambda c: F.count_distinct(F.coalesce(F.concat(F.lit("="), c), F.lit("")))
    return each.groupBy("value").agg(F.sum("n").alias("n_found"), distinct(F.col("repository")).alias("n_repositories"), distinct(F.col("owner")).alias("n_owners"))


def secrets(docs: DataFrame, repository: str | Column = "source", owner: str | Column = "source", shared_from: int = 3, shared_repositories: int = 6) -> DataFrame:
    """doc_id, spans, n_live, n_shared, max_owners, max_repositories for each row of `docs` (doc_id, text, repository, owner)."""
    found = stage(candidates(docs, repository, owner), "secrets")
    # written, so that the join deals both sides anew and can split a value that very many texts hold
    shares = stage(ownership(found), "secret-owners").select("value", "n_owners", "n_repositories")
    each = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", F.col("s.value").alias("value"), F.col("s.mixed").alias("mixed"))
    shared = (F.col("n_owners") >= shared_from) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= shared_repositories))
    verdict = (
        each.join(shares, "value")
        .groupBy("row")
        .agg(
            F.sum(F.when(~shared & F.col("mixed"), 1).otherwise(0)).alias("n_live"),
            F.sum(F.when(shared, 1).otherwise(0)).alias("n_shared"),
            F.max("n_owners").alias("max_owners"),
            F.max("n_repositories").alias("max_repositories"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.join(verdict, "row", "left").select("doc_id", "spans", *(zero(c) for c in ("n_live", "n_shared", "max_owners", "max_repositories")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(result: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return result.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_live", "n_shared", "max_owners", "max_repositories")
