"""The kernel's formulas against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import classes
from quillspark.functions.mathx import erf, erf_float
from quillspark.operators import calibrate as C
from quillspark.operators import clones, delta, detectors, paths, rollup, score


def test_erf():
    assert max(abs(erf_float(x / 500) - math.erf(x / 500)) for x in range(-4000, 4001)) < 1e-15


def test_erf_column(spark):
    rows = spark.range(-70, 71).select((F.col("id") / 10).alias("x")).select("x", erf(F.col("x")).alias("e")).collect()
    assert max(abs(r.e - math.erf(r.x)) for r in rows) < 1e-14


def frame(spark, values):
    return spark.createDataFrame([(str(i), "f", float(v)) for i, v in enumerate(values)], "unit string, name string, raw double")


@pytest.mark.parametrize(("values", "want"), [([1, math.e, math.e**2], (1.0, math.sqrt(2 / 3), True)), ([5, 5, 5], (0, 0, False)), ([3], (0, 0, False)), ([0, -1], (0, 0, False))])
def test_fit(spark, values, want):
    fit = C.fit(frame(spark, values))["f"]
    assert (pytest.approx(fit.mu), pytest.approx(fit.sigma), fit.valid) == want


def test_normalize(spark):
    fit = C.Fit(0.0, 1.0, True)
    df = spark.createDataFrame([(0.0,), (0.001,), (1e6,), (1.0,)], "x double")
    got = [r[0] for r in df.select(C.normalize(F.col("x"), fit)).collect()]
    assert got == [0.0, 0.0, 1.0, pytest.approx(0.2 / 0.7)]
    assert df.select(C.normalize(F.col("x"), C.Fit())).first()[0] == 0.0


def test_median_unit_scores_one(spark):
    wide = spark.createDataFrame([(str(v), float(v)) for v in (1, 4, 16, 64, 256)], "u string, f double")
    cal = C.calibrate(wide, "u", {"f": 1.0})
    s = sorted(r.s for r in score.score(wide, cal, {"f": 1.0}).collect())
    assert s[2] == pytest.approx(1.0, abs=1e-9)
    assert C.calibrate(wide.limit(0), "u", {"f": 1.0}).k == 1.0


def test_score_and_churn(spark):
    wide = spark.createDataFrame([("a", 1.0, 9.0, 0), ("b", 5.0, 0.0, 50), ("c", 2.0, 3.0, None)], "u string, cyclomatic double, nesting double, churn int")
    w = {"cyclomatic": 1.0, "nesting": 0.5}
    cal = C.Calibration({"cyclomatic": C.Fit(0.0, 1.0, True), "nesting": C.Fit(0.0, 1.0, True)}, 2.0)
    rows = {r.u: r for r in score.score(wide, cal, w, "churn").collect()}
    assert rows["a"].t == pytest.approx(rows["a"].s) and rows["c"].t == pytest.approx(rows["c"].s)
    assert rows["b"].t / rows["b"].s == pytest.approx(1 + 0.5 * math.log(51))
    assert rows["a"].s == pytest.approx(rows["a"].c_cyclomatic + rows["a"].c_nesting)
    assert rows["b"].dominant == "cyclomatic" and rows["b"].c_nesting == 0.0
    assert [r.u for r in score.rank(score.score(wide, cal, w, "churn"), "u", 1).collect()] == ["b"]


def test_outermost_any_order(spark):
    rows = [("1", 10, 1, 100), ("2", 4, 10, 50), ("2", 4, 200, 240)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([("p", *r) for r in order], "path string, digest string, size int, pos long, end long")
        assert {(r.pos, r.end) for r in clones.outermost(df, ["path"]).collect()} == {(1, 100), (200, 240)}


def test_cross_mass_original_is_free(spark):
    rows = [("dup", "h", 20, 1, 9), ("dup", "h", 20, 11, 19), ("single", "h", 20, 1, 9), ("alone", "g", 20, 1, 9)]
    df = spark.createDataFrame(rows, "path string, digest string, size int, pos long, end long")
    assert {r.path: r.mass for r in clones.cross_mass(df, "path").collect()} == {"single": 20}
    assert {r.path: r.mass for r in clones.intra_mass(df, ["path"]).collect()} == {"dup": 20}


def test_delta_kinds(spark):
    base = spark.createDataFrame([("m", 2.0), ("r", 3.0)], "path string, s double")
    head = spark.createDataFrame([("m", 2.5), ("a", 4.0)], "path string, s double")
    got = {r.path: (r.kind, r.s_base, r.s_head, r.delta) for r in delta.file_deltas(base, head, "path").collect()}
    assert got == {"m": ("modified", 2.0, 2.5, 0.5), "a": ("added", 0.0, 4.0, 4.0), "r": ("removed", 3.0, 0.0, -3.0)}


@pytest.mark.parametrize(
    ("d", "lines", "rank", "failed", "n"),
    [(0.5, 10, 1, False, 0), (0.51, 10, 1, True, 1), (0.5, 10, 2, True, 1), (9.0, 10, 4, True, 2), (float("nan"), 10, 0, True, 1), (float("-inf"), 10, 0, True, 1), (0.05, 0, 0, False, 0), (0.05, -3, 0, False, 0)],
)
def test_gate(spark, d, lines, rank, failed, n):
    df = spark.createDataFrame([("x", "modified", 0.0, d, d)], "path string, kind string, s_base double, s_head double, delta double")
    row = delta.verdict(delta.total(df, lines), F.lit(rank), 0.05, 1).first()
    assert (row.failed, len(row.reasons)) == (failed, n)
    assert delta.total(df.limit(0), 0).first().total == 0.0


PATHS = [("a.go", True), ("vendor/a.go", False), ("x/vendor/a.go", False), (".git/a.go", False), ("x/.y/a.go", False), (".a.go", True), ("a_test.go", True), ("vendor.go", True), ("a.txt", False), ("x/vendored/a.go", True)]


def test_analyzable(spark):
    df = spark.createDataFrame(PATHS, "p string, ok boolean")
    assert df.where(paths.analyzable(F.col("p")) != F.col("ok")).count() == 0
    assert all(paths.is_analyzable(p) == ok for p, ok in PATHS)


def test_classes():
    assert classes.parse("O(n*m)") == 3 and classes.parse("O(2^n)") == 4 and classes.parse_lenient("?") == 0
    with pytest.raises(ValueError):
        classes.parse("O(x)")


def patch(*lines):
    return "a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n" + "\n".join(lines) + "\n"


@pytest.mark.parametrize(
    ("patches", "n"),
    [
        ([("f%d.go" % i, patch("-old", "+new")) for i in range(4)], 0),
        ([("f%d.go" % i, patch("-old", "+new")) for i in range(5)], 5),
        ([("f%d.go" % i, patch("-old", "+new %d" % i)) for i in range(5)], 0),
        ([("f%d.go" % i, patch("-  ", "+\t")) for i in range(6)], 0),
        ([("f%d.go" % i, patch("-" + " " * i + "old", "+" + "\t" * i + "new")) for i in range(5)], 5),
        ([("f%d.go" % i, patch("+new")) for i in range(4)] + [("a.md", patch("+new")), ("b.yaml", patch("+new"))], 0),
    ],
)
def test_shotgun(spark, patches, n):
    df = spark.createDataFrame(patches, "path string, patch string")
    hits = detectors.shotgun(detectors.Facts(patches=df)).collect()
    assert len(hits) == n and all(h.size == n and h["class"] == 2 for h in hits)


def changed(spark, *names):
    return spark.createDataFrame([(p,) for p in names], "path string")


@pytest.mark.parametrize(("uses", "touched", "fires"), [(10, 10, True), (10, 8, True), (10, 5, False), (7, 7, False)])
def test_fanout(spark, uses, touched, fires):
    symbols = spark.createDataFrame([("s", "p", "Format", "func", True, "def.go")], "id string, pkg string, name string, kind string, exported boolean, path string")
    rows = spark.createDataFrame([("s", "q", f"u{i}.go", i) for i in range(uses)], "symbol_id string, pkg string, path string, pos long")
    facts = detectors.Facts(symbols=symbols, uses=rows, changed=changed(spark, "def.go", *(f"u{i}.go" for i in range(touched))))
    hits = detectors.identifier_fanout(facts).collect()
    assert [(h.path, h.size, h["class"]) for h in hits] == ([("def.go", uses, 1)] if fires else [])


def test_switch_and_implementors(spark):
    types = spark.createDataFrame(
        [("E", "p", "Kind", "named", False, False, "enum.go"), ("I", "p", "Storage", "interface", False, False, "iface.go")] + [(f"T{i}", "p", f"T{i}", "struct", False, False, f"t{i}.go") for i in range(4)],
        "id string, pkg string, name string, kind string, is_alias boolean, is_generic boolean, path string",
    )
    consts = spark.createDataFrame([("p", c, "E") for c in "ABC"], "pkg string, name string, type_id string")
    sites = spark.createDataFrame([(f"s{i}.go", i, "E") for i in range(3)], "path string, pos long, type_id string")
    methods = spark.createDataFrame([(f"T{i}", m, "()", f"t{i}.go") for i in range(2) for m in ("Get", "Set")] + [("T3", "Get", "()", "t3.go")], "type_id string, name string, sig string, path string")
    embeds = spark.createDataFrame([("T2", "T0")], "type_id string, embedded_id string")
    need = spark.createDataFrame([("I", "Get", "()"), ("I", "Set", "()")], "iface_id string, name string, sig string")
    facts = detectors.Facts(types=types, consts=consts, switch_sites=sites, methods=methods, iface_methods=need, embeds=embeds, changed=changed(spark, "s0.go", "s1.go", "t0.go"))
    assert [(h.path, h.size) for h in detectors.switch_case_symmetry(facts).collect()] == [("enum.go", 3)]
    # T2 has its methods from T0, whose file changed
    assert [(h.path, h.size, h.evidence) for h in detectors.implementor_scan(facts).collect()] == [("iface.go", 3, "Storage: 2 of 3 implementors touched")]
    facts.changed = changed(spark, "s0.go", "t1.go")
    assert not detectors.switch_case_symmetry(facts).collect() and not detectors.implementor_scan(facts).collect()


def test_analyze_joins_paths(spark):
    facts = detectors.Facts(patches=spark.createDataFrame([(f"f{i}.go", patch("+n")) for i in range(5)], "path string, patch string"))
    got = {r.path: r["class"] for r in detectors.analyze(facts, changed(spark, "f0.go", "x.md")).collect()}
    assert got == {"x.md": 0} | {f"f{i}.go": 2 for i in range(5)}


def test_rollup_helpers(spark):
    df = spark.createDataFrame([("a/b/x.go", 1.0), ("a/y.go", 0.0)], "path string, s double")
    got = {r.dir: (round(r.weight, 4), r.n_files) for r in rollup.directory_weights(df).collect()}
    assert got == {"": (1.05, 2), "a": (1.05, 2), "a/b": (1.0, 1)}
    for n, want in ((100, 95.0), (30, 29.0)):
        assert rollup.nearest_rank(spark.range(1, n + 1).select(F.col("id").cast("double").alias("v")), "v", 0.95).first().p == want


@pytest.mark.parametrize("values", [[], [3.0], [2.0, 2.0, 2.0], [1.0, 2.0], [5.0, 1.0, 4.0], [0.0, -0.0, 1e-300, 1e300, -1e300], [float(i % 7) for i in range(100)], [1.0, 1.0 + 2**-52, 1.0 + 2**-51], [0.1 * i * i for i in range(501)]])
def test_ranks(spark, values):
    import statistics

    from quillspark.operators import ranks

    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(3)
    assert ranks.median(df, "v") == (statistics.median(values) if values else None)
    for p in (0.0, 0.3, 0.95, 1.0):
        want = sorted(values)[max(1, math.ceil(p * len(values) - 1e-12)) - 1] if values else None
        assert ranks.nearest_rank(df, "v", p) == want


def test_deep_and_cyclic_embedding(spark):
    links = [(f"T{i}", f"T{i + 1}") for i in range(40)] + [("A", "B"), ("B", "A"), ("T40", "A")]
    embeds = spark.createDataFrame(links, "type_id string, embedded_id string")
    methods = spark.createDataFrame([("B", "Get", "()", "b.go")], "type_id string, name string, sig string, path string")
    assert {r.type_id for r in detectors.promoted(methods, embeds).collect()} == {"A", "B"} | {f"T{i}" for i in range(41)}
    assert detectors.promoted(methods, embeds.limit(0)).count() == 1


def test_line_masses(spark):
    rows = [(1, "a", 20, 0), (1, "a", 20, 1), (2, "a", 20, 0), (2, "b", 30, 1), (3, "b", 30, 0), (3, "b", 30, 4), (4, "c", 15, 0), (4, "d", 5, 1), (5, "d", 5, 1)]
    df = spark.createDataFrame([(u, d, s, p, p) for u, d, s, p in rows], "u int, digest string, size int, pos long, end long")
    got = {r.u: (r.intra, r.cross) for r in clones.line_masses(df, "u").collect() if r.intra or r.cross}
    assert got == {1: (20, 0), 2: (0, 20), 3: (30, 30)}
    own = {r.u: r.mass for r in clones.intra_mass(df, ["u"]).collect()}
    cross = {r.u: r.mass for r in clones.cross_mass(df, "u").collect()}
    assert got == {u: (own.get(u, 0), cross.get(u, 0)) for u in own.keys() | cross.keys()}


@pytest.mark.parametrize(("before", "after", "want"), [(8.0, 2.0, -1.0), (2.0, 8.0, 0.0), (4.0, 4.0, 0.0), (4.0, 0.0, 0.0), (0.0, 0.0, 0.0)])
def test_downgrade_bonus(spark, before, after, want):
    totals = delta.total(spark.createDataFrame([("x", "modified", 0.0, 3.0, 3.0)], "path string, kind string, s_base double, s_head double, delta double"), 10)
    row = delta.with_bonus(totals, delta.downgrade_bonus(F.lit(before), F.lit(after))).first()
    assert (row.bonus, row.total, row.density) == (want, 3.0 + want, pytest.approx((3.0 + want) / 10))
