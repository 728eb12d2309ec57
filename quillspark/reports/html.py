"""Self-contained pages: a treemap of S coloured by T, and a line chart of S over time."""

from __future__ import annotations

import os
from datetime import datetime, timedelta
from html import escape

#: The least weight of a file, and the colours from green (120) to red (0).
MIN_WEIGHT, COOL, SATURATION, LIGHTNESS = 0.05, 120, 70, 45
WIDTH, HEIGHT, INSET = 1200.0, 800.0, 2.0
#: A label's distance from the edge, a letter's width, the height of a line, the fewest letters worth showing.
LABEL_INSET, LABEL_WIDTH, LABEL_HEIGHT, LABEL_LEAST = 4, 7, 18, 4
_STYLE = (
    "body{font:14px sans-serif;margin:16px;background:#fff;color:#222}svg text{font:11px sans-serif;pointer-events:none}"
    "section{display:none;border-top:1px solid #ccc;margin-top:12px}section:target{display:block}section div{background:#c33;height:10px}td{padding:2px 8px}"
)


def percentile(values: list[float], p: float) -> float:
    """Nearest rank; 0 for no values."""
    if not values:
        return 0.0
    ordered = sorted(values)
    rank = -int(-p * len(ordered) // 1)
    return ordered[min(len(ordered), max(1, rank)) - 1]


def fill(t: float, p95: float) -> str:
    share = min(1.0, max(0.0, t / p95)) if p95 > 0 else 1.0
    return f"hsl({COOL * (1 - share):.0f}, {SATURATION}%, {LIGHTNESS}%)"


def squarify(weights: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles of areas in proportion to the weights, in order, rows kept as square as can be."""
    total = sum(weights)
    if not weights or total <= 0 or w <= 0 or h <= 0:
        return [(x, y, 0.0, 0.0)] * len(weights)
    areas = [v * w * h / total for v in weights]
    out: list[tuple[float, float, float, float]] = []
    row: list[float] = []

    def worst(r: list[float]) -> float:
        side, s = min(w, h), sum(r)
        return max(max(side * side * a / (s * s), s * s / (side * side * a)) if a > 0 else float("inf") for a in r)

    def lay() -> None:
        nonlocal x, y, w, h
        s = sum(row)
        if w >= h:
            thick, at = s / h, y
            for a in row:
                out.append((x, at, thick, a / thick if thick else 0.0))
                at += a / thick if thick else 0.0
            x, w = x + thick, w - thick
        else:
            thick, at = s / w, x
            for a in row:
                out.append((at, y, a / thick if thick else 0.0, thick))
                at += a / thick if thick else 0.0
            y, h = y + thick, h - thick

    for a in areas:
        if row and worst([*row, a]) > worst(row):
            lay()
            row = []
        row.append(a)
    lay()
    return out


def layout(files: list[dict], width: float = WIDTH, height: float = HEIGHT) -> list[dict]:
    """One rectangle per file, directories nested; children by weight, then name."""
    root: dict = {}
    for f in files:
        here = root
        *dirs, name = f["path"].split("/")
        for d in dirs:
            here = here.setdefault(("d", d), {})
        here[("f", name)] = f

    def weight(key, node) -> float:
        return max(node["s"], MIN_WEIGHT) if key[0] == "f" else sum(weight(k, v) for k, v in node.items())

    cells: list[dict] = []
    todo = [(root, 0.0, 0.0, width, height)]
    while todo:
        node, x, y, w, h = todo.pop()
        rows = sorted(((weight(k, v), k, v) for k, v in node.items()), key=lambda r: (-r[0], r[1][1]))
        for (_, key, value), (a, b, c, d) in zip(rows, squarify([r[0] for r in rows], x, y, w, h), strict=True):
            if key[0] == "f":
                cells.append(value | {"x": a, "y": b, "w": c, "h": d})
            else:
                pad = min(INSET, c / 4, d / 4)
                todo.append((value, a + pad, b + pad, c - 2 * pad, d - 2 * pad))
    return cells


def _label(cell: dict) -> str:
    """The file's name where it fits, shortened if need be, and S below it where there is room for a second line."""
    name = cell["path"].rsplit("/", 1)[-1]
    most = int((cell["w"] - 2 * LABEL_INSET) / LABEL_WIDTH)
    if cell["h"] < LABEL_HEIGHT or most < LABEL_LEAST:
        return ""
    lines = [name if len(name) <= most else name[: most - 1] + "…"]
    if cell["h"] >= 2 * LABEL_HEIGHT:
        lines.append(f"S {cell['s']:.2f}")
    place = lambda i: f'x="{cell["x"] + LABEL_INSET:.2f}" y="{cell["y"] + 14 + 13 * i:.2f}"'
    return "".join(f'<text {place(i)} fill="#fff">{escape(x)}</text>' for i, x in enumerate(lines))


def _detail(number: int, f: dict) -> str:
    """The panel that shows up once its rectangle is chosen: a bar for each feature's share of S."""
    parts = sorted(((v, k) for k, v in (f.get("contributions") or {}).items() if v > 0), reverse=True)
    bars = "".join(f'<tr><td>{escape(k)}</td><td><div style="width:{200 * v / parts[0][0]:.0f}px"></div></td><td>{v:.3f}</td></tr>' for v, k in parts)
    return f'<section id="f{number}"><h2>{escape(f["path"])}</h2><p>S {f["s"]:.3f}, T {f["t"]:.3f}, most from {escape(f["dominant"] or "no feature")}</p><table>{bars}</table><a href="#">close</a></section>'


def scan_page(files: list[dict], title: str = "Code entropy") -> str:
    p95 = percentile([f["t"] for f in files], 0.95)
    body, details = [], []
    for i, c in enumerate(sorted(layout(files), key=lambda c: c["path"])):
        tip = f"{c['path']}\nS {c['s']:.2f}  T {c['t']:.2f}\n{c['dominant'] or 'none'}"
        rect = f'<rect x="{c["x"]:.2f}" y="{c["y"]:.2f}" width="{c["w"]:.2f}" height="{c["h"]:.2f}" fill="{fill(c["t"], p95)}" stroke="#fff"><title>{escape(tip)}</title></rect>'
        body.append(f'<a href="#f{i}">{rect}{_label(c)}</a>')
        details.append(_detail(i, c))
    total = sum(f["s"] for f in files)
    return (
        f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style></head><body>'
        f"<h1>{escape(title)}</h1><p>{len(files)} files, ΣS {total:.2f}; area is S, colour is T (red at the 95th percentile, {p95:.2f}). Choose a file for its features.</p>"
        f'<svg viewBox="0 0 {WIDTH:.0f} {HEIGHT:.0f}" width="100%">{"".join(body)}</svg>{"".join(details)}</body></html>\n'
    )


def _when(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def history_page(points: list[dict], ref: str, title: str = "Entropy over time") -> str:
    """Time is the true x axis; five ticks below, three at the side; hours where the span is under 72 hours."""
    head = f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style></head><body><h1>{escape(title)}</h1><p>{escape(ref)}, {len(points)} commits</p>'
    if not points:
        return head + "<p>No commits.</p></body></html>\n"
    w, h, left, top, bottom = 960.0, 360.0, 60.0, 20.0, 40.0
    times = [_when(p["commit_time"]).timestamp() for p in points]
    t0, t1 = min(times), max(times)
    low, high = min(p["s"] for p in points), max(p["s"] for p in points)
    if high <= low:
        low, high = low - 0.5, high + 0.5
    x = lambda t: left + (w - left - 20) * ((t - t0) / (t1 - t0) if t1 > t0 else 0.5)
    y = lambda s: h - bottom - (h - top - bottom) * (s - low) / (high - low)
    form = "%m-%d %H:%M" if timedelta(seconds=t1 - t0) < timedelta(hours=72) else "%Y-%m-%d"
    ticks = []
    for i in range(5 if t1 > t0 else 1):
        t = t0 + (t1 - t0) * i / 4
        ticks.append(f'<text x="{x(t):.1f}" y="{h - 12:.1f}" text-anchor="middle">{datetime.fromtimestamp(t, tz=_when(points[0]["commit_time"]).tzinfo).strftime(form)}</text>')
    for i in range(3):
        s = low + (high - low) * i / 2
        ticks.append(f'<text x="{left - 8:.1f}" y="{y(s) + 4:.1f}" text-anchor="end">{s:.2f}</text><line x1="{left}" x2="{w - 20}" y1="{y(s):.1f}" y2="{y(s):.1f}" stroke="#ddd"/>')
    line = " ".join(f"{x(t):.1f},{y(p['s']):.1f}" for t, p in zip(times, points, strict=True))
    dots = "".join(f'<circle cx="{x(t):.1f}" cy="{y(p["s"]):.1f}" r="3" fill="#c33"><title>{escape(p["short_sha"] + " " + p["subject"])}\nS {p["s"]:.2f}, {p["n_files"]} files</title></circle>' for t, p in zip(times, points, strict=True))
    return head + f'<svg viewBox="0 0 {w:.0f} {h:.0f}" width="100%">{"".join(ticks)}<polyline fill="none" stroke="#c33" points="{line}"/>{dots}</svg></body></html>\n'


def write_page(folder: str, page: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "index.html")
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
    return path
