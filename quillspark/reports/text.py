"""Tables, JSON, SARIF and Markdown: each report is a list of parts, and a writer that joins them."""

from __future__ import annotations

import json
from collections.abc import Iterable

from quillspark.functions.classes import label
from quillspark.plans.source import CheckResult

MARKER = "<!-- quillspark-report -->"
HOTSPOTS = 3
#: Scripts read these names, in this order, from the first line of a check.
STATUS_FIELDS = ("ΔS_total", "ΔS_density", "threshold", "scaling_class", "lines_changed", "files")


def columns(rows: list[list[str]]) -> str:
    """Rows of cells under each other, two spaces between columns; the first row is the head."""
    widths = [max(map(len, column)) for column in zip(*rows, strict=True)]
    return "".join("  ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)).rstrip() + "\n" for row in rows)


def _json(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def scan_table(files: list[dict]) -> str:
    return columns([["PATH", "S", "T", "DOMINANT"], *([f["path"], f"{f['s']:.2f}", f"{f['t']:.2f}", f["dominant"]] for f in files)])


def scan_json(files: list[dict]) -> str:
    """A bare array."""
    return _json(files)


def _level(t: float, floors: dict[str, float]) -> str | None:
    """The highest level whose floor t reaches; None below all, and for what isn't a number."""
    return next((name for name, floor in floors.items() if t >= floor), None)


def scan_sarif(files: list[dict], version: str, note: float = 1.0, warning: float = 1.5, error: float = float("inf"), uri: str | None = None) -> str:
    """SARIF 2.1.0: one result for each file at or above the note floor, in the order given.

    `uri`, where given, is the address of the tool's documentation.  Option values that aren't positive mean the default.
    """
    defaults = {"error": float("inf"), "warning": 1.5, "note": 1.0}
    floors = {name: given if given > 0 else defaults[name] for name, given in (("error", error), ("warning", warning), ("note", note))}
    rule = {
        "id": "hot-file",
        "name": "HotFile",
        "shortDescription": {"text": "Disordered and often changed"},
        "fullDescription": {"text": "The structure of this file is more disordered than that of most files of the tree. Its temperature is that disorder, raised by how often the file changed of late."},
        "help": {"text": "See which feature dominates and reduce that first: split long functions, flatten nesting, name conditions, move repeated code into one place, or cut imports."},
        "defaultConfiguration": {"level": "note"},
    }
    driver = {"name": "quillspark", "version": version, "rules": [rule]}
    if uri:
        rule["helpUri"] = driver["informationUri"] = uri
    results = []
    for f in files:
        if (level := _level(f["t"], floors)) is None or f["t"] < floors["note"]:
            continue
        place = f["path"].replace("\\", "/")
        cause = f"mostly {f['dominant']}" if f["dominant"] else "no feature stands out"
        where = {"physicalLocation": {"artifactLocation": {"uri": place}, "region": {"startLine": 1}}}
        results.append({"ruleId": rule["id"], "level": level, "message": {"text": f"T {f['t']:.2f} from S {f['s']:.2f}, {cause}"}, "locations": [where], "partialFingerprints": {"filePath": place}})
    return _json({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]})


def hits_above_lowest(result: CheckResult) -> list[dict]:
    return [h for row in result.breakdown for h in row["hits"] if h["class"] > 0]


def _status(r: CheckResult) -> dict[str, str]:
    values = (f"{r.total:.4f}", f"{r.density:.4f}", f"{r.threshold:.4f}", label(r.scaling_class), str(r.lines_changed), str(len(r.files)))
    return dict(zip(STATUS_FIELDS, values, strict=True))


def _file_rows(r: CheckResult, path) -> Iterable[list[str]]:
    return ([path(f["path"]), f["kind"], f"{f['s_base']:.3f}", f"{f['s_head']:.3f}", f"{f['delta']:+.3f}"] for f in r.files)


def check_table(r: CheckResult) -> str:
    """The status line, then one block each of reasons, signals and files, those that have rows."""
    out = ["  ".join(["FAIL" if r.failed else "PASS", *(f"{k}={v}" for k, v in _status(r).items())]) + "\n"]
    out += [f"  because {x}\n" for x in r.reasons]
    if hits := hits_above_lowest(r):
        out.append(columns([["SIGNAL", "CLASS", "SIZE", "PATH", "EVIDENCE"], *([h["detector"], label(h["class"]), str(h["size"] or ""), h["path"], h["evidence"]] for h in hits)]))
    if r.files:
        out.append(columns([["FILE", "CHANGE", "S BEFORE", "S AFTER", "DELTA"], *_file_rows(r, str)]))
    return "".join(out)


def check_json(r: CheckResult) -> str:
    """The names of the fields, which scripts read."""
    named = lambda rows: [row | {"class": label(row["class"])} for row in rows]
    scaling = {"class": label(r.scaling_class), "breakdown": [row | {"class": label(row["class"]), "hits": named(row["hits"])} for row in r.breakdown], "acknowledged": [], "downgrade_bonus": r.downgrade_bonus}
    delta = {"total": r.total, "density": r.density, "lines_changed": r.lines_changed, "files": r.files}
    head = {"verdict": "fail" if r.failed else "pass"} | ({"reasons": r.reasons} if r.reasons else {})
    return _json(head | {"threshold": r.threshold, "scaling_class_max": r.class_max, "result": {"base": r.base, "head": r.head, "delta": delta, "scaling": scaling, "skipped": r.skipped}})


def code(text: str) -> str:
    """A path as Markdown code that nothing in it can end: the fence is longer than any run of backticks inside, line ends are shown as spaces, bars are escaped for tables."""
    flat = " ".join(text.splitlines()) if text.splitlines() else ""
    longest = max((len(run) for run in "".join(c if c == "`" else " " for c in flat).split()), default=0)
    fence = "`" * (longest + 1)
    pad = " " if flat.startswith("`") or flat.endswith("`") else ""
    return f"{fence}{pad}{flat}{pad}{fence}".replace("|", "\\|")


def _grid(head: list[str], rows: Iterable[list[str]], numbers: int) -> list[str]:
    """A Markdown table, its last `numbers` columns aligned right."""
    rule = ["---"] * (len(head) - numbers) + ["---:"] * numbers
    return ["| " + " | ".join(row) + " |" for row in (head, rule, *rows)]


def check_markdown(r: CheckResult) -> str:
    """Marker, verdict and status as a table, then a section for each kind of finding that there is."""
    parts = [[MARKER, f"## Entropy gate: {'failed' if r.failed else 'passed'}"]]
    parts.append(_grid(["measure", "value"], ([k, v] for k, v in _status(r).items()), 1))
    if r.failed:
        parts.append(["The gate fails because of", *(f"* {x}" for x in r.reasons)])
    if hits := hits_above_lowest(r):
        rows = ([label(h["class"]), h["detector"], code(h["path"]), str(h["size"] or ""), h["evidence"].replace("|", "\\|")] for h in hits)
        parts += [["#### How far the change ripples"], _grid(["class", "signal", "path", "size", "evidence"], rows, 0)]
    if r.files:
        parts += [["#### Files"], _grid(["path", "change", "S before", "S after", "delta"], _file_rows(r, code), 3)]
        hot = sorted((f for f in r.files if f["s_head"] > 0), key=lambda f: -f["s_head"])[:HOTSPOTS]
        if hot:
            parts.append(["Most disordered now: " + ", ".join(f"{code(f['path'])} ({f['s_head']:.3f})" for f in hot)])
    else:
        parts.append(["No Go file that can be measured has changed."])
    if r.skipped:
        parts.append(["Left out: " + ", ".join(f"{code(s['path'])} ({s['reason']})" for s in r.skipped)])
    return "\n\n".join("\n".join(p) for p in parts) + "\n"


def history_table(points: list[dict]) -> str:
    return columns([["SHA", "DATE", "FILES", "S", "SUBJECT"], *([p["short_sha"], p["commit_time"][:10], str(p["n_files"]), f"{p['s']:.2f}", p["subject"]] for p in points)])


def history_json(ref: str, points: list[dict]) -> str:
    return _json({"ref": ref, "points": points})


__all__ = ["MARKER", "check_json", "check_markdown", "check_table", "history_json", "history_table", "scan_json", "scan_sarif", "scan_table"]
