"""scan, check and history over Go trees and git repositories."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.classes import label, parse
from quillspark.operators import delta, detectors
from quillspark.operators.calibrate import FEATURES, Calibration, calibrate
from quillspark.operators.features import REGISTRY, extended
from quillspark.operators.paths import classify_change, classify_skip, is_analyzable
from quillspark.operators.rollup import series
from quillspark.operators.score import contributions_map, rank, score
from quillspark.sources import git as G
from quillspark.sources import gofacts, gosrc
from quillspark.sources.config import CACHE_NAME, Config, load_calibration, save_calibration

LISTING = "frame string, ref string, name string, path string"


def cross_enabled(config: Config) -> bool:
    return config.weights.get("cross_duplication", 0) > 0


def tree_features(files: DataFrame, config: Config) -> DataFrame:
    return measured(gosrc.parsed(files), config).cache()


def measured(files: DataFrame, config: Config) -> DataFrame:
    """All features of parsed files: the built-in and the registered ones."""
    return extended(gosrc.features(files, cross=cross_enabled(config)), files, config.weights)


def resolve_calibration(feats: DataFrame, config: Config, cache: str | None = None, recalibrate: bool = False) -> Calibration:
    """The stored calibration if it is of these weights and covers all features, else a new one, which is stored."""
    if cache and not recalibrate and (held := load_calibration(cache, config.weights)):
        return held
    cal = calibrate(feats, "path", config.weights)
    if cache:
        try:
            save_calibration(cache, cal, config.weights)
        except OSError:
            pass  # a read-only tree is no reason to fail
    return cal


def scan(spark: SparkSession, root: str, config: Config | None = None, churn: dict[str, int] | None = None, top: int = 0, cache: str | None = None, recalibrate: bool = False) -> DataFrame:
    """path, s, t, dominant, contributions; hottest first."""
    config = config or Config()
    feats = tree_features(gosrc.read_tree(spark, root), config)
    cal = resolve_calibration(feats, config, cache, recalibrate)
    counts = spark.createDataFrame(list((churn or {}).items()), "path string, churn bigint")
    scores = score(feats.join(counts, "path", "left"), cal, config.weights, churn="churn")
    names = [n for n in (*FEATURES, *REGISTRY) if n in config.weights and n in scores.columns]
    return rank(scores.select("path", "s", "t", "dominant", contributions_map(names).alias("contributions")), "path", top)


@dataclass
class CheckResult:
    base: str
    head: str
    files: list[dict]
    total: float
    density: float
    lines_changed: int
    scaling_class: int
    breakdown: list[dict]
    skipped: list[dict]
    failed: bool
    reasons: list[str] = field(default_factory=list)
    threshold: float = 0.05
    class_max: str = "O(k)"
    downgrade_bonus: float = 0.0


def changes_of(spark: SparkSession, raw: list[dict], numstat: list[dict]) -> DataFrame:
    """kind, path, old_path, added, removed, reason: raw records left-joined to their counts on the head path."""
    r = spark.createDataFrame(raw, "src_mode string, dst_mode string, src_sha string, dst_sha string, status string, path string, new_path string")
    n = spark.createDataFrame(numstat, "added bigint, removed bigint, is_binary boolean, path string, new_path string")
    key = F.when(F.col("new_path") != "", F.col("new_path")).otherwise(F.col("path"))
    left = r.select("*", key.alias("key"))
    right = n.select(key.alias("key"), "added", "removed", "is_binary")
    rows = left.join(right, "key", "left")
    reason = classify_skip(F.col("src_mode"), F.col("dst_mode"), F.col("src_sha"), F.col("dst_sha"), F.coalesce("is_binary", F.lit(False)))
    old = F.when(F.col("new_path") != "", F.col("path")).otherwise(F.lit(""))
    return rows.select(classify_change(F.col("status")).alias("kind"), F.col("key").alias("path"), old.alias("old_path"), F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"), reason.alias("reason"))


def module_of(git: G.Git, ref: str) -> str:
    text = G.blobs(git, ref, ["go.mod"]).get("go.mod", b"").decode(errors="replace")
    return next((line.split()[1] for line in text.splitlines() if line.startswith("module ") and len(line.split()) > 1), "")


def check(spark: SparkSession, git: G.Git, base: str, head: str, config: Config | None = None, cache: str | None = None, root: str | None = None, downgrade: tuple[float, float] | None = None) -> CheckResult:
    """Signed change of S between two refs and the scaling class of the change, against the gate.

    `downgrade` is the size of what a signal covers before and after the change, for a change that reduces it: the
    bonus that it earns is taken off the total.  No detector reports one by itself.
    """
    config = config or Config()
    base_sha, head_sha = G.resolve(git, base), G.resolve(git, head)
    cal = resolve_calibration(tree_features(gosrc.read_tree(spark, root or git.root), config), config, cache)
    changes = changes_of(spark, *G.diff(git, base_sha, head_sha)).cache()
    used = [r.asDict() for r in changes.where("reason is null").orderBy("path").collect()]
    skipped = [{"path": r.path, "reason": r.reason} for r in changes.where("reason is not null").orderBy("path").collect()]

    # both refs as frames of one table; a renamed file keeps its head path in the base frame
    old_name = {c["old_path"]: c["path"] for c in used if c["old_path"]}
    listing = [("base", base_sha, p, old_name.get(p, p)) for p in G.source_files(git, base_sha)]
    seen = {row[3] for row in listing}
    # a rename into the analysable tree has its base side there too
    listing += [("base", base_sha, old, new) for old, new in old_name.items() if is_analyzable(new) and new not in seen]
    listing += [("head", head_sha, p, p) for p in G.source_files(git, head_sha)]
    files = G.contents(spark.createDataFrame(listing, LISTING), git.root).cache()
    parsed = gosrc.parsed(files).cache()
    go = changes.where("reason is null").where(F.col("path").endswith(".go")).where(_analyzable())
    both = go.where(F.col("kind").isin("modified", "renamed")).select("path")
    sides = parsed.select("path", "frame").distinct().groupBy("path").agg(F.count("*").alias("n"))
    lopsided = both.join(sides.where("n = 1"), "path", "left_semi")
    kept = parsed.join(lopsided, "path", "left_anti")
    scores = score(measured(kept, config), cal, config.weights).select("frame", "path", "s").cache()
    of = lambda f: scores.where(F.col("frame") == f).select("path", F.col("s").alias(f"s_{f}"))
    sided = go.join(of("base"), "path", "left").join(of("head"), "path", "left")
    kind = F.when(F.col("kind") == "renamed", "modified").otherwise(F.col("kind"))
    present = F.when(kind == "added", F.col("s_head").isNotNull()).when(kind == "removed", F.col("s_base").isNotNull()).otherwise(F.col("s_base").isNotNull() & F.col("s_head").isNotNull())
    sided = sided.where(present).withColumn("kind", kind).cache()
    deltas = delta.with_delta(sided, "path")
    lines = sided.agg(F.coalesce(F.sum(F.col("added") + F.col("removed")), F.lit(0)).alias("n")).first().n

    texts = G.patches(git, base_sha, head_sha)
    facts = detectors.Facts(patches=spark.createDataFrame(list(texts.items()), "path string, patch string").join(changes.where("reason is null").select("path"), "path", "left_semi"))
    touched = [c["path"] for c in used if c["path"].endswith(".go")]
    if touched:
        for name, df in gofacts.relations(files.where("frame = 'head'"), module_of(git, head_sha)).items():
            setattr(facts, name, df)
        facts.changed = spark.createDataFrame([(p,) for p in touched], "path string")
        facts.base_funcs = gofacts.relations(files.where("frame = 'base'"))["head_funcs"]
        facts.head_funcs = facts.head_funcs.join(facts.changed, "path", "left_semi")
    by_path = detectors.analyze(facts, changes.where("reason is null")).cache()
    rank_max = detectors.change_class(by_path).first()["class"]

    before, after = downgrade or (0.0, 0.0)
    bonus = delta.downgrade_bonus(F.lit(float(before)), F.lit(float(after)), config.scaling_bonus_beta)
    sums = delta.with_bonus(delta.total(deltas, int(lines)), bonus)
    row = delta.verdict(sums, F.lit(rank_max), config.delta_s_max, parse(config.scaling_class_max)).first()
    files = [r.asDict() for r in deltas.orderBy("path").collect()]
    breakdown = [r.asDict(recursive=True) for r in by_path.orderBy("path").collect()]
    reasons = [f"ΔS density {row.density:.4f} > {config.delta_s_max:.4f}" if r == "delta_s" else f"scaling {label(rank_max)} > {config.scaling_class_max}" for r in row.reasons]
    return CheckResult(base_sha, head_sha, files, row.total, row.density, row.lines_changed, rank_max, breakdown, skipped, row.failed, reasons, config.delta_s_max, config.scaling_class_max, row.bonus)


def _analyzable():
    from quillspark.operators.paths import analyzable

    return analyzable(F.col("path"))


def history(spark: SparkSession, git: G.Git, ref: str = "HEAD", limit: int = 30, config: Config | None = None, first_parent: bool = False, cache: str | None = None) -> DataFrame:
    """sha, short_sha, commit_time, subject, s, n_files per commit, oldest first.

    Commits are frames of one table: trees are listed and contents read by the tasks, contents that commits share are
    read and parsed once, and clone masses are computed for all commits in one plan.
    """
    config = config or Config()
    commits = G.log(git, ref, limit, first_parent)
    cal = resolve_calibration(tree_features(gosrc.read_tree(spark, git.root), config), config, cache)
    listed = spark.createDataFrame(commits, "sha string, short_sha string, commit_time string, subject string, position int")
    trees = G.listed(listed, git.root).cache()
    files = trees.join(G.blob_contents(trees, git.root), "blob").select(F.col("sha").alias("frame"), "path", "src")
    totals = series(score(measured(gosrc.parsed(files), config), cal, config.weights), ["frame"])
    out = listed.join(totals, listed.sha == totals.frame, "left")
    return out.select("sha", "short_sha", "commit_time", "subject", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("n_files", F.lit(0)).alias("n_files"), "position").orderBy("position").drop("position")


def churn_of(root: str, config: Config, as_of: datetime | None = None) -> dict[str, int]:
    """Churn by path; nothing where there is no repository."""
    try:
        return G.churn(G.Git(root), config.churn_since_days or 90, as_of)
    except G.GitError:
        return {}


def dump(result: CheckResult) -> str:
    return json.dumps(result.__dict__, indent=2, ensure_ascii=False)


__all__ = ["CACHE_NAME", "CheckResult", "check", "history", "scan"]
