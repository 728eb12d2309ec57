"""scan, check and history end to end on a small repository, and the renderers."""

import io
import json
import subprocess

import pytest

from quillspark.sources import git as G

CALIB = {
    "a.go": 'package p\n\nimport "fmt"\n\nfunc A(n int) int {\n\tfor i := 0; i < n; i++ {\n\t\tif i > 2 && n > 3 {\n\t\t\tfmt.Println(i)\n\t\t}\n\t}\n\treturn n\n}\n',
    "b.go": 'package p\n\nimport (\n\t"fmt"\n\t"os"\n)\n\nfunc B(n int) int {\n\tif n > 1 {\n\t\tfmt.Fprintln(os.Stderr, n)\n\t}\n\treturn n\n}\n',
    "c.go": "package p\n\nfunc C(n int) int {\n\tswitch n {\n\tcase 1:\n\t\treturn 2\n\tdefault:\n\t\tfor n > 0 {\n\t\t\tif n == 3 {\n\t\t\t\tn--\n\t\t\t}\n\t\t\tn--\n\t\t}\n\t}\n\treturn n\n}\n",
    "api/api.go": 'package api\n\nfunc Format(s string) string {\n\treturn s\n}\n',
    "u1/u.go": 'package u1\n\nimport "m/api"\n\nfunc U() string { return api.Format("a") }\n',
    "u2/u.go": 'package u2\n\nimport "m/api"\n\nfunc U() string { return api.Format("b") }\n',
    "go.mod": "module m\n\ngo 1.22\n",
    "vendor/v.go": "package v\n",
}


@pytest.fixture
def repo(tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    def write(files):
        for name, text in files.items():
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)

    git("init", "-q", "-b", "dev")
    write(CALIB)
    git("add", "-A")
    git("commit", "-q", "-m", "first")
    git("checkout", "-q", "-b", "work")
    (tmp_path / "c.go").unlink()
    write(
        {
            "a.go": CALIB["a.go"].replace("\treturn n\n", "\tif n > 9 || n < 1 {\n\t\treturn 0\n\t}\n\treturn n\n"),
            "new.go": "package p\n\nfunc N(n int) int {\n\tif n > 0 {\n\t\treturn 1\n\t}\n\treturn n\n}\n",
            "api/api.go": "package api\n\nfunc Format(s string, legacy bool) string {\n\treturn s\n}\n",
            "vendor/v.go": "package v\n\nvar X = 1\n",
            "notes.md": "x\n",
            "data.bin": "\x00\x01",
        }
    )
    git("mv", "b.go", "renamed.go")
    git("add", "-A")
    git("commit", "-q", "-m", "second")
    return tmp_path


def test_scan(spark, repo):
    from quillspark.plans.source import scan

    rows = scan(spark, str(repo), churn={"a.go": 5}).collect()
    assert {r.path for r in rows} == {"a.go", "new.go", "renamed.go", "api/api.go", "u1/u.go", "u2/u.go"}
    assert [r.t for r in rows] == sorted((r.t for r in rows), reverse=True)
    a = next(r for r in rows if r.path == "a.go")
    assert a.t > a.s and sum(a.contributions.values()) == pytest.approx(a.s)
    with pytest.raises(FileNotFoundError):
        scan(spark, str(repo / "nowhere"))


def test_check(spark, repo):
    from quillspark.plans.source import check
    from quillspark.reports import text

    r = check(spark, G.Git(str(repo)), "dev", "work")
    kinds = {f["path"]: f["kind"] for f in r.files}
    assert kinds == {"a.go": "modified", "new.go": "added", "c.go": "removed", "renamed.go": "modified", "api/api.go": "modified"}
    by = {f["path"]: f for f in r.files}
    assert by["new.go"]["s_base"] == 0 < by["new.go"]["s_head"] and by["c.go"]["s_head"] == 0 and by["c.go"]["delta"] < 0
    assert by["a.go"]["delta"] > 0
    assert r.skipped == [{"path": "data.bin", "reason": "binary"}]
    hits = text.hits_above_lowest(r)
    assert [(h["detector"], h["path"], h["size"]) for h in hits] == [("state_multiplier", "api/api.go", 2)]
    assert r.failed and r.scaling_class == 4 and any("O(2ⁿ)" in x for x in r.reasons)
    first, *rest = text.check_table(r).splitlines()
    assert first.split("  ")[0] == "FAIL" and [x.split("=")[0] for x in first.split("  ")[1:]] == list(text.STATUS_FIELDS)
    assert any(x.split()[:4] == ["state_multiplier", "O(2ⁿ)", "2", "api/api.go"] for x in rest)
    shown = json.loads(text.check_json(r))
    assert shown["verdict"] == "fail" and shown["result"]["scaling"]["class"] == "O(2ⁿ)"
    md = text.check_markdown(r)
    assert md.startswith(text.MARKER) and "`data.bin` (binary)" in md and "| `a.go` | modified |" in md
    assert shown["result"]["scaling"]["downgrade_bonus"] == 0.0


def test_check_with_a_downgrade(spark, repo):
    from quillspark.plans.source import check
    from quillspark.sources.config import Config

    plain = check(spark, G.Git(str(repo)), "dev", "work")
    better = check(spark, G.Git(str(repo)), "dev", "work", Config(scaling_bonus_beta=0.25), downgrade=(16.0, 2.0))
    assert better.downgrade_bonus == -0.75 and better.total == pytest.approx(plain.total - 0.75)
    assert better.density == pytest.approx(better.total / better.lines_changed)
    worse = check(spark, G.Git(str(repo)), "dev", "work", downgrade=(2.0, 16.0))
    assert worse.downgrade_bonus == 0.0 and worse.total == pytest.approx(plain.total)


def test_registered_feature(spark, repo):
    from pyspark.sql import functions as F

    from quillspark.operators import features
    from quillspark.plans.source import scan
    from quillspark.sources.config import Config

    with pytest.raises(ValueError):
        features.register("nesting")(lambda files: files)

    @features.register("returns", weight=2.0)
    def returns(files):
        return files.select("frame", "path", F.size(F.filter("nodes", lambda n: n["kind"] == "ReturnStmt")).alias("value"))

    try:
        assert Config().weights["returns"] == 2.0
        rows = {r.path: r for r in scan(spark, str(repo)).collect()}
        assert all("returns" in r.contributions for r in rows.values()) and rows["a.go"].contributions["returns"] > 0
        off = scan(spark, str(repo), Config(weights=Config().weights | {"returns": 0.0})).first()
        assert "returns" not in off.contributions
    finally:
        del features.REGISTRY["returns"]
    assert "returns" not in Config().weights


def test_file_at_ref(repo, monkeypatch):
    g = G.Git(str(repo))
    assert G.file_at(g, "dev", "a.go").decode() == CALIB["a.go"]
    with pytest.raises(G.PathAbsent):
        G.file_at(g, "work", "c.go")
    with pytest.raises(G.PathAbsent):
        G.file_at(g, "work", "api")
    with pytest.raises(G.RefUnknown):
        G.file_at(g, "nowhere", "a.go")
    monkeypatch.setenv("PATH", "")
    with pytest.raises(G.GitMissing):
        G.file_at(g, "dev", "a.go")


def test_history(spark, repo):
    from quillspark.plans.source import history
    from quillspark.reports import html, text

    points = [r.asDict() for r in history(spark, G.Git(str(repo)), "work", 5).collect()]
    assert [p["subject"] for p in points] == ["first", "second"] and [p["n_files"] for p in points] == [6, 6]
    assert all(p["s"] > 0 for p in points)
    assert text.history_table(points).splitlines()[0].split() == ["SHA", "DATE", "FILES", "S", "SUBJECT"]
    assert "polyline" in html.history_page(points, "work") and "No commits" in html.history_page([], "x")
    with pytest.raises(ValueError):
        history(spark, G.Git(str(repo)), "work", 0)


def test_churn_and_refs(repo):
    g = G.Git(str(repo))
    assert G.churn(g, 90)["renamed.go"] == 2 and G.churn(g, 90)["new.go"] == 1
    with pytest.raises(G.GitError):
        G.resolve(g, "no-such-ref")
    with pytest.raises(ValueError):
        G.churn(g, 0)


def test_git_parsers():
    raw = b":100644 100644 aa bb M\0x.go\0:100644 100644 aa bb R087\0old.go\0new.go\0:broken\0"
    assert [(r["status"], r["path"], r["new_path"]) for r in G.parse_raw(raw)] == [("M", "x.go", ""), ("R087", "old.go", "new.go")]
    num = b"1\t2\tx.go\0-\t-\tb.png\x003\t4\t\0old.go\0new.go\0"
    assert [(r["added"], r["is_binary"], r["path"], r["new_path"]) for r in G.parse_numstat(num)] == [(1, False, "x.go", ""), (0, True, "b.png", ""), (3, False, "old.go", "new.go")]
    batch = b"aa blob 3\na\nb\nHEAD:y missing\nbb blob 2\nok\n"
    assert G.parse_batch(batch, ["x", "y", "z"]) == {"x": b"a\nb", "z": b"ok"}
    assert G.parse_batch(b"aa blob 99\nshort", ["x"]) == {}


FILES = [{"path": f"d{i % 3}/f{i}.go", "s": 0.5 * i, "t": 0.4 * i, "dominant": "length" if i else "", "contributions": {"length": 0.5 * i}} for i in range(8)]


def test_treemap():
    from quillspark.reports import html

    cells = html.layout(FILES)
    assert len(cells) == len(FILES) and all(c["w"] >= 0 and c["h"] >= 0 for c in cells)
    for i, a in enumerate(cells):
        for b in cells[:i]:
            assert a["x"] + a["w"] <= b["x"] + 1e-6 or b["x"] + b["w"] <= a["x"] + 1e-6 or a["y"] + a["h"] <= b["y"] + 1e-6 or b["y"] + b["h"] <= a["y"] + 1e-6
    flat = html.squarify([6, 6, 4, 3, 2, 2, 1], 0, 0, 600, 400)
    assert [round(w * h) for _, _, w, h in flat] == [60000, 60000, 40000, 30000, 20000, 20000, 10000]
    page = html.scan_page(FILES)
    for i, f in enumerate(sorted(FILES, key=lambda f: f["path"])):
        assert f'href="#f{i}"' in page and f'id="f{i}"' in page and f["path"] in page
    assert "S 3.50" in page and html._label({"path": "abcdefgh.go", "x": 0, "y": 0, "w": 200, "h": 20, "s": 1.0}).count("<text") == 1
    assert html._label({"path": "abcdefgh.go", "x": 0, "y": 0, "w": 200, "h": 40, "s": 1.0}).count("<text") == 2
    page = html.scan_page([FILES[3] | {"path": "<x>&.go"}])
    assert "<x>" not in page and page == html.scan_page([FILES[3] | {"path": "<x>&.go"}])
    assert html.percentile(list(range(1, 101)), 0.95) == 95 and html.percentile([], 0.95) == 0.0


def test_sarif_and_tables():
    from quillspark.reports import text

    log = json.loads(text.scan_sarif(FILES, "1"))
    levels = [r["level"] for r in log["runs"][0]["results"]]
    assert levels == ["note" if f["t"] < 1.5 else "warning" for f in FILES if f["t"] >= 1.0]
    assert json.loads(text.scan_json(FILES))[1]["path"] == "d1/f1.go"
    assert text.scan_table(FILES).splitlines()[0].split() == ["PATH", "S", "T", "DOMINANT"]
    assert text.code("a|b\n") == "`a\\|b`" and text.code("a`b") == "``a`b``" and text.code("`a") == "`` `a ``" and text.code("a\nb") == "`a b`"
    rule = log["runs"][0]["tool"]["driver"]["rules"][0]
    assert rule["fullDescription"]["text"] and rule["help"]["text"] and "helpUri" not in rule
    named = json.loads(text.scan_sarif(FILES, "1", uri="https://docs.example/x"))["runs"][0]["tool"]["driver"]
    assert named["informationUri"] == named["rules"][0]["helpUri"] == "https://docs.example/x"
    assert all(r["level"] == "error" for r in json.loads(text.scan_sarif(FILES, "1", error=1.0))["runs"][0]["results"])


def test_config_and_cache(tmp_path):
    from quillspark.operators.calibrate import Calibration, Fit
    from quillspark.sources.config import Config, _plain_yaml, load_calibration, load_config, save_calibration

    assert load_config(str(tmp_path / "none")) == Config()
    f = tmp_path / "c.yaml"
    f.write_text("delta_s_max: 0.2\nweights:\n  nesting: 2\n  other: 1.5\nscaling_class_max: O(n)\n")
    c = load_config(str(f))
    assert (c.delta_s_max, c.weights["nesting"], c.weights["other"], c.weights["length"], c.scaling_class_max) == (0.2, 2.0, 1.5, 0.5, "O(n)")
    assert _plain_yaml(f.read_text())["weights"] == {"nesting": 2, "other": 1.5}
    f.write_text("scaling_class_max: O(x)\n")
    with pytest.raises(ValueError):
        load_config(str(f))
    cal = Calibration({"length": Fit(1.0, 2.0, True), "nesting": Fit()}, 3.0)
    k, two = str(tmp_path / "k.json"), {"length": 1.0, "nesting": 0.5}
    save_calibration(k, cal, two)
    assert load_calibration(k, two) == cal and load_calibration(k, dict(reversed(two.items()))) == cal
    assert load_calibration(k, two | {"nesting": 0.6}) is None and load_calibration(k, {"length": 1.0}) is None
    save_calibration(k, cal, two | {"coupling": 1.0})
    assert load_calibration(k, two | {"coupling": 1.0}) is None
    for broken in ('{"format": 2}', "[]", "{", '{"format": 3, "weights": 1}'):
        (tmp_path / "k.json").write_text(broken)
        assert load_calibration(k, two) is None
    assert load_calibration(str(tmp_path / "none.json"), two) is None


def test_command_line(spark, repo):
    from quillspark.__main__ import arguments, chosen_format, run

    out = io.StringIO()
    assert run(arguments().parse_args(["scan", str(repo), "--top", "2"]), spark, out) == 0
    assert len(out.getvalue().splitlines()) == 3 and (repo / ".quillspark.cache.json").exists()
    out = io.StringIO()
    assert run(arguments().parse_args(["check", "--root", str(repo), "--base", "dev", "--head", "work", "--json"]), spark, out) == 1
    assert json.loads(out.getvalue())["verdict"] == "fail"
    run(arguments().parse_args(["history", "work", "--root", str(repo), "--html", str(repo / "site")]), spark, io.StringIO())
    assert (repo / "site" / "index.html").exists()
    with pytest.raises(ValueError):
        chosen_format(arguments().parse_args(["scan", "--json", "--format", "sarif"]))
    with pytest.raises(ValueError):
        chosen_format(arguments().parse_args(["history", "--format", "markdown"]))


def test_streaming_churn(spark, tmp_path):
    from quillspark.streaming.churn import windowed_churn

    rows = [("u", "2024-01-01 10:00:00"), ("u", "2024-01-02 10:00:00"), ("v", "2024-01-02 11:00:00")]
    df = spark.createDataFrame(rows, "unit string, at string").selectExpr("unit", "cast(at as timestamp) at")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_churn(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "unit", "at", days=2)
    q = stream.writeStream.format("memory").queryName("churn").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.unit, r.churn) for r in spark.table("churn").collect()}
    assert ("u", 2) in got and ("v", 1) in got
    from quillspark.streaming import churn as C

    spread = spark.range(200).selectExpr("concat('u', id % 3) unit", "timestamp_seconds(1700000000 + id * 40000) at")
    direct = C.windowed_churn(spread, "unit", "at", days=5, slide="24 hours")
    assert sorted(map(str, C.windowed_churn(spread, "unit", "at", days=5).collect())) == sorted(map(str, direct.collect()))
    with pytest.raises(ValueError):
        C.rolling_churn(C.daily_churn(spread, "unit", "at"), "unit", 0)
    batch = windowed_churn(df, "unit", "at", days=2)
    assert {(r.unit, r.churn) for r in batch.collect()} >= {("u", 2), ("v", 1)}


def test_shipped_package(spark):
    """The zip holds every module, and imports from nothing else."""
    import subprocess
    import sys
    import zipfile

    from quillspark.shipping import ship

    path = ship(spark)
    assert "quillspark/operators/score.py" in zipfile.ZipFile(path).namelist()
    done = subprocess.run([sys.executable, "-I", "-c", f"import sys; sys.path.insert(0, {path!r}); import quillspark.sources.gosrc as g; print(g.__file__)"], capture_output=True, text=True, cwd="/")
    assert done.stdout.startswith(path), done.stderr


def test_comment_of_a_pull_request(tmp_path, capsys):
    from quillspark.plans.source import CheckResult
    from quillspark.reports import ci
    from quillspark.reports.text import MARKER, check_markdown

    r = CheckResult("a", "b", [], 0.0, 0.0, 0, 0, [], [], True, ["x"])
    body = check_markdown(r)
    assert ci.plan([], body) == ci.Step("create", None, body)
    others = [{"id": 1, "body": "hello"}, {"id": 2, "body": f"see {MARKER}"}]
    assert ci.plan(others, body).action == "create"
    assert ci.plan([*others, {"id": 3, "body": MARKER + " old"}, {"id": 4, "body": MARKER}], body) == ci.Step("update", 3, body)
    assert ci.plan([{"id": 3, "body": body}], body) == ci.Step("keep", 3)
    long = MARKER + "\n" + "line\n" * 40_000
    assert len(ci.fitted(long)) <= ci.MOST and ci.fitted(long).startswith(MARKER) and "cut off" in ci.fitted(long)
    assert ci.write(r, str(tmp_path / "out")) == 1 and json.loads((tmp_path / "out" / "check.json").read_text())["verdict"] == "fail"
    (tmp_path / "c.json").write_text(json.dumps([{"id": 3, "body": MARKER}]))
    assert ci.main([str(tmp_path / "c.json"), str(tmp_path / "out" / "comment.md")]) == 0
    assert json.loads(capsys.readouterr().out)["action"] == "update"
    action = (__import__("pathlib").Path(__file__).parent.parent / "action.yml").read_text()
    assert "quillspark check" in action and "quillspark.reports.ci" in action
