"""Change-ripple detectors over type facts and patches, and the registry that runs them.

Each detector maps relations to hits (detector, class, size, path, evidence).  Thresholds out of range fall
back to their defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.classes import O2N, OK, ON

_KINDS = ("func", "type", "var", "const")


@dataclass
class Facts:
    """The relations a detector may read; those it lacks make it return nothing."""

    patches: DataFrame | None = None  # path, patch
    changed: DataFrame | None = None  # path
    symbols: DataFrame | None = None  # id, pkg, name, kind, exported, path
    uses: DataFrame | None = None  # symbol_id, pkg, path, pos
    consts: DataFrame | None = None  # pkg, name, type_id
    types: DataFrame | None = None  # id, pkg, name, kind, is_alias, is_generic, path
    switch_sites: DataFrame | None = None  # path, pos, type_id
    methods: DataFrame | None = None  # type_id, name, sig, path
    iface_methods: DataFrame | None = None  # iface_id, name, sig
    embeds: DataFrame | None = None  # type_id, embedded_id
    base_funcs: DataFrame | None = None  # path, pkg, recv, name, exported, params
    head_funcs: DataFrame | None = None
    options: dict = field(default_factory=dict)


Detector = Callable[[Facts], DataFrame | None]
REGISTRY: dict[str, Detector] = {}


def register(name: str) -> Callable[[Detector], Detector]:
    def add(f: Detector) -> Detector:
        REGISTRY[name] = f
        return f

    return add


def _hits(df: DataFrame, name: str, rank: int, size: Column, path: Column, evidence: Column) -> DataFrame:
    return df.select(F.lit(name).alias("detector"), F.lit(rank).alias("class"), size.cast("long").alias("size"), path.alias("path"), evidence.alias("evidence"))


def _ratio(value, default: float) -> float:
    return float(value) if value is not None and 0 < value <= 1 else default


def _least(value, default: int, floor: int) -> int:
    return int(value) if value is not None and value >= floor else default


def fingerprint(patch: Column) -> Column:
    """SHA-256 over the sorted added and removed lines without indentation; 'empty' for none.

    Lines that begin with +++ or --- count as headers wherever they stand.
    """
    lines = F.split(patch, "\n", -1)
    # '+' sorts before '-', and lines of one sign sort as their texts do
    short = lambda x: F.concat(F.left(x, F.lit(1)), F.btrim(F.substring(x, 2, 1 << 30), F.lit(" \t\n\x0b\f\r")))
    signed = lambda x: (x.startswith("+") & ~x.startswith("+++")) | (x.startswith("-") & ~x.startswith("---"))
    changed = F.filter(F.transform(F.filter(lines, signed), short), lambda x: F.length(x) > 1)
    body = F.array_join(F.sort_array(changed), "\n")
    # the hash covers each line with its sign and line end; no line at all has no hash
    return F.coalesce(F.sha2(F.concat(F.nullif(body, F.lit("")), F.lit("\n")), 256), F.lit("empty"))


def shotgun_groups(prints: DataFrame, min_size: int = 5) -> DataFrame:
    """Members (fp, ...) of groups that share a fingerprint, with the group's size: one window over narrow rows.

    Empty patches are spread over the partitions, and dropped by their size of zero: a filter on the fingerprint itself
    would be pushed below the projection and work it out again.
    """
    spread = F.when(F.col("fp") == "empty", F.xxhash64(*(c for c in prints.columns if c != "fp")))
    size = F.when(F.col("fp") != "empty", F.count("*").over(Window.partitionBy("fp", spread))).otherwise(0)
    return prints.withColumn("size", size).where(F.col("size") >= max(1, min_size))


@register("shotgun")
def shotgun(facts: Facts) -> DataFrame | None:
    """The same edit in many source files: O(n)."""
    if facts.patches is None:
        return None
    least = _least(facts.options.get("min_files"), 5, 1)
    prints = facts.patches.where(F.col("path").endswith(".go")).select("path", fingerprint(F.col("patch")).alias("fp"))
    rows = shotgun_groups(prints, least)
    return _hits(rows, "shotgun", ON, F.col("size"), F.col("path"), F.format_string("same edit in %d files", F.col("size")))


def touched_ratio(sites: DataFrame, key: list[str], min_total: int, min_ratio: float) -> DataFrame:
    """key, total, touched of groups with enough sites and a large enough part in changed places (`touched` boolean)."""
    rows = sites.groupBy(*key).agg(F.count("*").alias("total"), F.sum(F.col("touched").cast("int")).cast("long").alias("touched"))
    return rows.where((F.col("total") >= min_total) & (F.col("touched") >= F.col("total") * min_ratio))


def _touched(df: DataFrame, changed: DataFrame) -> DataFrame:
    """Marks rows whose path is among the changed ones: a left join on distinct paths."""
    c = changed.select(F.col("path").alias("_p")).distinct().withColumn("_c", F.lit(True))
    return df.join(c, df.path == F.col("_p"), "left").withColumn("touched", F.coalesce("_c", F.lit(False))).drop("_p", "_c")


@register("identifier_fanout")
def identifier_fanout(facts: Facts) -> DataFrame | None:
    """An exported symbol declared in a changed file, most uses of which change too: O(k)."""
    if facts.symbols is None or facts.uses is None or facts.changed is None:
        return None
    least, ratio = _least(facts.options.get("min_refs"), 8, 2), _ratio(facts.options.get("ratio"), 0.8)
    declared = facts.symbols.where(F.col("exported") & F.col("kind").isin(*_KINDS)).join(facts.changed.select("path").distinct(), "path", "left_semi")
    sites = _touched(facts.uses, facts.changed).join(declared.select(F.col("id").alias("symbol_id"), "name", F.col("path").alias("at")), "symbol_id")
    rows = touched_ratio(sites, ["symbol_id", "name", "at"], least, ratio)
    return _hits(rows, "identifier_fanout", OK, F.col("total"), F.col("at"), F.format_string("%s: %d of %d uses touched", F.col("name"), F.col("touched"), F.col("total")))


def enums(types: DataFrame, consts: DataFrame) -> DataFrame:
    """Named types that aren't generic and have two package-level constants or more."""
    many = consts.groupBy("type_id").agg(F.count("*").alias("n_consts")).where("n_consts >= 2")
    return types.where(~F.col("is_generic") & ~F.col("is_alias")).join(many, F.col("id") == F.col("type_id"))


@register("switch_case_symmetry")
def switch_case_symmetry(facts: Facts) -> DataFrame | None:
    """Switches over one enum that change together: O(k)."""
    if facts.types is None or facts.consts is None or facts.switch_sites is None or facts.changed is None:
        return None
    least, ratio = _least(facts.options.get("min_switches"), 2, 2), _ratio(facts.options.get("switch_ratio"), 0.5)
    declared = enums(facts.types, facts.consts).select("id", "name", F.col("path").alias("at"))
    sites = _touched(facts.switch_sites, facts.changed).join(declared, F.col("type_id") == F.col("id"))
    rows = touched_ratio(sites, ["id", "name", "at"], least, ratio)
    return _hits(rows, "switch_case_symmetry", OK, F.col("total"), F.col("at"), F.format_string("%s: %d of %d switches touched", F.col("name"), F.col("touched"), F.col("total")))


def closure(links: DataFrame) -> DataFrame:
    """(type_id, embedded_id) over any number of embeddings: paths double in length until no new pair appears, also around cycles."""
    pairs = links.select("type_id", "embedded_id").distinct().cache()
    n = pairs.count()
    while n:
        step = pairs.select(F.col("type_id").alias("embedded_id"), F.col("embedded_id").alias("next"))
        longer = pairs.join(step, "embedded_id").select("type_id", F.col("next").alias("embedded_id"))
        grown = pairs.unionByName(longer).distinct().cache()
        more = grown.count()
        pairs.unpersist()
        pairs = grown
        if more == n:
            break
        n = more
    return pairs


def promoted(methods: DataFrame, embeds: DataFrame | None) -> DataFrame:
    """Direct methods and those promoted through embedded types, however deep."""
    out = methods.select("type_id", "name", "sig", "path")
    if embeds is None:
        return out
    held = methods.select(F.col("type_id").alias("embedded_id"), "name", "sig", "path")
    return out.unionByName(closure(embeds).join(held, "embedded_id").select("type_id", "name", "sig", "path")).distinct()


def implementors(required: DataFrame, methods: DataFrame) -> DataFrame:
    """(iface_id, type_id) by relational division: types that have every required (name, sig)."""
    # the least common method of an interface is met first: only types that have it are counted at all
    held = methods.select("type_id", "name", "sig").distinct()
    times = held.groupBy("name", "sig").agg(F.count("*").alias("n_types"))
    needed = required.select("iface_id", "name", "sig").distinct().join(times, ["name", "sig"], "left")
    first = needed.groupBy("iface_id").agg(F.count("*").alias("n_required"), F.min(F.struct(F.coalesce("n_types", F.lit(0)).alias("n"), "name", "sig")).alias("m"))
    first = first.where("m.n > 0").select("iface_id", "n_required", F.col("m.name").alias("name"), F.col("m.sig").alias("sig"))
    pairs = first.join(held, ["name", "sig"]).select("iface_id", "n_required", "type_id")
    have = pairs.join(needed.select("iface_id", "name", "sig"), "iface_id").join(held, ["type_id", "name", "sig"], "left_semi")
    return have.groupBy("iface_id", "type_id", "n_required").agg(F.count("*").alias("n_have")).where("n_have = n_required").select("iface_id", "type_id")


@register("implementor_scan")
def implementor_scan(facts: Facts) -> DataFrame | None:
    """An interface most implementors of which change together: O(k)."""
    if facts.types is None or facts.methods is None or facts.iface_methods is None or facts.changed is None:
        return None
    least, ratio = _least(facts.options.get("min_implementors"), 2, 2), _ratio(facts.options.get("implementor_ratio"), 0.5)
    named = facts.types.where(~F.col("is_alias") & ~F.col("is_generic"))
    faces = named.where(F.col("kind") == "interface").select(F.col("id").alias("iface_id"), "name", F.col("path").alias("at"))
    solid = named.where(F.col("kind") != "interface").select(F.col("id").alias("type_id"), "path")
    methods = promoted(facts.methods, facts.embeds)
    places = solid.unionByName(methods.select("type_id", "path")).distinct()
    touched = _touched(places, facts.changed).groupBy("type_id").agg(F.max("touched").alias("touched"))
    required = facts.iface_methods.join(faces.select("iface_id"), "iface_id", "left_semi")
    pairs = implementors(required, methods).join(solid.select("type_id"), "type_id", "left_semi").join(touched, "type_id").join(faces, "iface_id")
    rows = touched_ratio(pairs, ["iface_id", "name", "at"], least, ratio)
    return _hits(rows, "implementor_scan", OK, F.col("total"), F.col("at"), F.format_string("%s: %d of %d implementors touched", F.col("name"), F.col("touched"), F.col("total")))


def added_last(base: Column, head: Column) -> Column:
    """The one parameter that `head` has behind all of `base`'s, or null."""
    n = F.size(base)
    return F.when((F.size(head) == n + 1) & (F.slice(head, 1, n) == base), F.element_at(head, -1))


@register("state_multiplier")
def state_multiplier(facts: Facts) -> DataFrame | None:
    """An exported function gains a trailing bool or enum that two other packages' uses or more must feed: O(2^n)."""
    if facts.base_funcs is None or facts.head_funcs is None or facts.symbols is None or facts.uses is None:
        return None
    least = _least(facts.options.get("min_sites"), 2, 1)
    key = ["path", "recv", "name"]
    head = facts.head_funcs.where("exported").select(*key, "pkg", F.col("params").alias("after"))
    both = head.join(facts.base_funcs.select(*key, F.col("params").alias("before")), key).withColumn("new", added_last(F.col("before"), F.col("after")))
    kind = F.when(F.col("new") == "bool", "bool")
    if facts.types is not None and facts.consts is not None:
        known = enums(facts.types, facts.consts).select(F.col("name").alias("enum"), F.col("pkg").alias("enum_pkg"))
        last = F.element_at(F.split("new", r"\."), -1)
        both = both.join(known, (last == F.col("enum")) & ~F.col("new").rlike(r"^[*\[]") & ((F.instr("new", ".") > 0) | (F.col("enum_pkg") == F.col("pkg"))), "left")
        kind = F.coalesce(kind, F.when(F.col("enum").isNotNull(), F.concat(F.lit("enum "), F.col("enum"))))
    grown = both.withColumn("state", kind).where(F.col("state").isNotNull()).dropDuplicates(key)
    ids = facts.symbols.where(F.col("kind").isin("func", "method")).select(F.col("id").alias("symbol_id"), F.col("pkg").alias("def_pkg"), F.col("name").alias("n_"), F.col("recv").alias("r_") if "recv" in facts.symbols.columns else F.lit("").alias("r_"))
    sites = grown.join(ids, (F.col("name") == F.col("n_")) & (F.col("recv") == F.col("r_")) & (F.col("pkg") == F.col("def_pkg"))).join(facts.uses.select("symbol_id", F.col("pkg").alias("use_pkg")), "symbol_id")
    rows = sites.where("use_pkg <> def_pkg").groupBy(*key, "state").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return _hits(rows, "state_multiplier", O2N, F.col("n"), F.col("path"), F.format_string("%s gains %s for %d external uses", F.col("name"), F.col("state"), F.col("n")))


def analyze(facts: Facts, changes: DataFrame, detectors: list[str] | None = None) -> DataFrame:
    """path, class, hits: the highest class over each path's hits; changed paths without one are O(1)."""
    found = [h for n in (detectors or sorted(REGISTRY)) if (h := REGISTRY[n](facts)) is not None]
    paths = changes.select("path").distinct()
    if not found:
        empty = F.array().cast("array<struct<detector: string, class: int, size: bigint, path: string, evidence: string>>")
        return paths.select("path", F.lit(0).alias("class"), empty.alias("hits"))
    hits = found[0]
    for h in found[1:]:
        hits = hits.unionByName(h)
    return breakdown(hits, paths)


def breakdown(hits: DataFrame, paths: DataFrame) -> DataFrame:
    by = hits.groupBy("path").agg(F.max("class").alias("class"), F.sort_array(F.collect_list(F.struct("detector", "class", "size", "path", "evidence"))).alias("hits"))
    return by.join(paths, "path", "full").select("path", F.coalesce("class", F.lit(0)).alias("class"), F.coalesce("hits", F.array()).alias("hits"))


def change_class(by_path: DataFrame) -> DataFrame:
    return by_path.agg(F.coalesce(F.max("class"), F.lit(0)).alias("class"))
