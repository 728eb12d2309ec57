"""Command line: scan, check, history, version."""

from __future__ import annotations

import argparse
import os
import sys

VERSION = "0.1.0"
FORMATS = {"scan": ("table", "json", "sarif"), "check": ("table", "json", "markdown"), "history": ("table", "json")}


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillspark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in FORMATS:
        c = commands.add_parser(name)
        c.add_argument("--format", default=None, help="|".join(FORMATS[name]))
        c.add_argument("--json", action="store_true", help="deprecated: --format json")
        c.add_argument("--config", default="")
        c.add_argument("--recalibrate", action="store_true")
        if name == "scan":
            c.add_argument("path", nargs="?", default=".")
            c.add_argument("--top", type=int, default=0)
        else:
            c.add_argument("--root", default=".")
        if name == "check":
            c.add_argument("--base", default="dev")
            c.add_argument("--head", default="HEAD")
        else:
            c.add_argument("--html", default="")
        if name == "history":
            c.add_argument("ref", nargs="?", default="HEAD")
            c.add_argument("--limit", type=int, default=30)
            c.add_argument("--first-parent", action=argparse.BooleanOptionalAction, default=True)
    commands.add_parser("version")
    return parser


def chosen_format(args) -> str:
    if args.json and args.format not in (None, "json"):
        raise ValueError("--json conflicts with --format")
    form = "json" if args.json else args.format or "table"
    if form not in FORMATS[args.command]:
        raise ValueError(f"unknown format {form!r}; one of {', '.join(FORMATS[args.command])}")
    return form


def run(args, spark, out) -> int:
    from quillspark.plans import source
    from quillspark.reports import html, text
    from quillspark.sources.config import CACHE_NAME, CONFIG_NAME, load_config
    from quillspark.sources.git import Git

    form = chosen_format(args)
    root = args.path if args.command == "scan" else args.root
    folder = root if os.path.isdir(root) else os.path.dirname(root) or "."
    config = load_config(args.config or os.path.join(folder, CONFIG_NAME))
    cache = os.path.join(folder, CACHE_NAME)
    if args.recalibrate and os.path.exists(cache):
        os.remove(cache)
    if args.command == "scan":
        files = [r.asDict(recursive=True) for r in source.scan(spark, root, config, source.churn_of(folder, config), 0 if args.html else args.top, cache).collect()]
        if args.html:
            print(html.write_page(args.html, html.scan_page(files)), file=out)
        else:
            out.write({"table": text.scan_table, "json": text.scan_json, "sarif": lambda f: text.scan_sarif(f, VERSION)}[form](files))
        return 0
    if args.command == "check":
        result = source.check(spark, Git(root), args.base, args.head, config, cache)
        out.write({"table": text.check_table, "json": text.check_json, "markdown": text.check_markdown}[form](result))
        return int(result.failed)
    if args.limit <= 0:
        raise ValueError("--limit must be positive")
    points = [r.asDict() for r in source.history(spark, Git(root), args.ref, args.limit, config, args.first_parent, cache).collect()]
    if args.html:
        print(html.write_page(args.html, html.history_page(points, args.ref)), file=out)
    else:
        out.write(text.history_table(points) if form == "table" else text.history_json(args.ref, points))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    if args.command == "version":
        print(f"quillspark {VERSION}")
        return 0
    from pyspark.sql import SparkSession

    from quillspark.shipping import ship

    try:
        spark = SparkSession.builder.appName("quillspark").getOrCreate()
        if not spark.sparkContext.master.startswith("local["):
            ship(spark)
        return run(args, spark, sys.stdout)
    except (ValueError, RuntimeError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
