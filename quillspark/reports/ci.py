"""What a pull request's automation needs: one comment that is kept up to date, a log upload, and the gate's exit code.

Nothing here talks to a host.  `plan` tells what to do with the comments that are there, `write` leaves the files that a
workflow uploads; `action.yml` at the top of the repository wires them together.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass

from quillspark.plans.source import CheckResult
from quillspark.reports.text import MARKER, check_json, check_markdown

#: Fixed value: hosts refuse comments that are longer.
MOST = 65_000


@dataclass(frozen=True)
class Step:
    """create, update or keep; the comment's number for the latter two; the text for the former two."""

    action: str
    number: int | None = None
    body: str = ""


def fitted(body: str) -> str:
    """A comment of a length that hosts take: whole lines from the start, and a note of what is missing."""
    if len(body) <= MOST:
        return body
    note = "\n\n(cut off: the full report is in the log)\n"
    return body[: body.rfind("\n", 0, MOST - len(note))] + note


def plan(comments: Iterable[dict], body: str) -> Step:
    """`comments` (id, body) of a pull request, oldest first: the first that starts with the marker is the one to update."""
    body = fitted(body)
    own = next((c for c in comments if str(c.get("body", "")).startswith(MARKER)), None)
    if own is None:
        return Step("create", None, body)
    return Step("keep", own["id"]) if own["body"] == body else Step("update", own["id"], body)


def write(result: CheckResult, folder: str) -> int:
    """Leaves comment.md and check.json in a folder; returns the exit code of the gate."""
    os.makedirs(folder, exist_ok=True)
    for name, text in (("comment.md", fitted(check_markdown(result))), ("check.json", check_json(result))):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    return int(result.failed)


def main(argv: list[str]) -> int:
    """`python -m quillspark.reports.ci COMMENTS.json BODY.md`: prints the step as JSON, for a workflow to carry out."""
    comments, body = (open(p, encoding="utf-8").read() for p in argv)
    print(json.dumps(plan(json.loads(comments), body).__dict__))
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
