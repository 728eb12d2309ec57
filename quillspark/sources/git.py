"""Git history as relations. A diff and the log run on the driver, one process each; trees and contents are read by the tasks."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.operators.paths import is_analyzable


class GitError(RuntimeError):
    """A git command failed."""


class GitMissing(GitError):
    """There is no git."""


class RefUnknown(GitError):
    """A ref that names no commit."""


class PathAbsent(GitError):
    """A path that a ref lacks, or that is no file there."""


@dataclass(frozen=True)
class Git:
    """Runs git in a folder; tests replace `run`."""

    root: str

    def run(self, *args: str, stdin: bytes | None = None) -> bytes:
        try:
            done = subprocess.run(["git", "-C", self.root, *args], input=stdin, capture_output=True, env=os.environ | {"LC_ALL": "C"}, check=False)
        except FileNotFoundError as e:
            raise GitMissing("no git program was found") from e
        if done.returncode:
            raise GitError(done.stderr.decode(errors="replace").strip())
        return done.stdout


def resolve(git: Git, rev: str) -> str:
    try:
        return git.run("rev-parse", "--verify", "--quiet", f"{rev}^{{commit}}").decode().strip()
    except GitMissing:
        raise
    except GitError as e:
        raise RefUnknown(f"{rev!r} names no commit") from e


def parse_raw(raw: bytes) -> list[dict]:
    """Records of `diff --raw -z`: modes, ids, status, path, and the new path of a rename."""
    out, fields = [], raw.decode("utf-8", "surrogateescape").split("\0")
    at = 0
    while at < len(fields):
        head = fields[at].split()
        at += 1
        if not head or not head[0].startswith(":") or len(head) < 5 or at >= len(fields):
            continue
        row = {"src_mode": head[0][1:], "dst_mode": head[1], "src_sha": head[2], "dst_sha": head[3], "status": head[4], "path": fields[at], "new_path": ""}
        at += 1
        if head[4][0] in "RC" and at < len(fields):
            row["new_path"] = fields[at]
            at += 1
        out.append(row)
    return out


def parse_numstat(raw: bytes) -> list[dict]:
    """Records of `diff --numstat -z`; '-' counts mean a binary file."""
    out, fields = [], raw.decode("utf-8", "surrogateescape").split("\0")
    at = 0
    while at < len(fields):
        parts = fields[at].split("\t")
        at += 1
        if len(parts) != 3:
            continue
        added, removed, path = parts
        new = ""
        if not path and at + 1 < len(fields):  # a rename: both paths follow
            path, new = fields[at], fields[at + 1]
            at += 2
        number = lambda x: int(x) if x.isdigit() else 0
        out.append({"added": number(added), "removed": number(removed), "is_binary": added == "-" and removed == "-", "path": path, "new_path": new})
    return out


def diff(git: Git, base: str, head: str) -> tuple[list[dict], list[dict]]:
    """Raw and numstat records from the merge base to the head, renames from half equal, no copies."""
    spec = ["--find-renames=50%", "-z", f"{base}...{head}"]
    return parse_raw(git.run("diff", "--raw", "--no-abbrev", *spec)), parse_numstat(git.run("diff", "--numstat", *spec))


def patches(git: Git, base: str, head: str) -> dict[str, str]:
    """Path to its part of the diff without context lines; the old path for a deleted file."""
    text = git.run("diff", "--unified=0", "--find-renames=50%", "--no-color", "--no-ext-diff", f"{base}...{head}").decode("utf-8", "replace")
    out = {}
    for part in ("\n" + text).split("\ndiff --git ")[1:]:
        lines = part.split("\n")
        named = {sign: line[4:].rstrip("\t") for line in lines for sign in ("---", "+++") if line.startswith(sign + " ")}
        new, old = named.get("+++", ""), named.get("---", "")
        path = new[2:] if new.startswith("b/") else old[2:] if old.startswith("a/") else ""
        if not path:  # no hunks: the header names the path twice
            half = lines[0]
            path = half[half.rfind(" b/") + 3 :]
        out[path] = part
    return out


def parse_tree(raw: bytes) -> list[tuple[str, str]]:
    """(path, object id) of the blobs in `ls-tree -r -z`."""
    out = []
    for record in raw.decode("utf-8", "surrogateescape").split("\0"):
        head, tab, path = record.partition("\t")
        if tab and head.split()[1:2] == ["blob"]:
            out.append((path, head.split()[2]))
    return out


def tree(git: Git, ref: str) -> list[str]:
    raw = git.run("ls-tree", "-r", "-z", "--name-only", ref)
    return [p for p in raw.decode("utf-8", "surrogateescape").split("\0") if p]


def parse_batch(raw: bytes, keys: list[str]) -> dict[str, bytes]:
    """Contents from `cat-file --batch`, in order of the keys; missing ones are left out, a cut record ends it."""
    out, at = {}, 0
    for key in keys:
        end = raw.find(b"\n", at)
        if end < 0:
            break
        head = raw[at:end].split(b" ")
        at = end + 1
        if head[-1] in (b"missing", b"ambiguous"):
            continue
        if len(head) != 3 or not head[2].isdigit():
            break
        size = int(head[2])
        if at + size > len(raw):
            break
        if head[1] == b"blob":
            out[key] = raw[at : at + size]
        at += size + 1
    return out


def blobs(git: Git, ref: str, paths: list[str]) -> dict[str, bytes]:
    if not paths:
        return {}
    usable = [p for p in paths if "\n" not in p]
    asked = "".join(f"{ref}:{p}\n" for p in usable).encode("utf-8", "surrogateescape")
    return parse_batch(git.run("cat-file", "--batch", stdin=asked), usable)


def contents(listing: DataFrame, root: str) -> DataFrame:
    """frame, path, src of a listing (frame, ref, name, path), read by the tasks: one process for each ref of a batch.

    `root` must be a repository that every worker can reach; names that a ref lacks are left out.
    """
    git = Git(root)

    def fetch(batches):
        for batch in batches:
            wanted: dict[str, list[tuple[str, str, str]]] = {}
            for frame, ref, name, path in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                wanted.setdefault(ref, []).append((frame, name, path))
            rows = []
            for ref, entries in wanted.items():
                found = blobs(git, ref, sorted({n for _, n, _ in entries}))
                rows += [(frame, path, found[name]) for frame, name, path in entries if name in found]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], ["frame", "path", "src"])

    # neighbouring rows share a ref, so that a task starts few processes
    return listing.repartitionByRange("ref", "path").select("frame", "ref", "name", "path").mapInArrow(fetch, "frame string, path string, src binary")


def file_at(git: Git, ref: str, path: str) -> bytes:
    """The content of one file at a ref. `RefUnknown` and `PathAbsent` tell the two ways to miss it apart; `GitMissing` is neither."""
    sha = resolve(git, ref)
    found = blobs(git, sha, [path])
    if path not in found:
        raise PathAbsent(f"{path!r} isn't a file at {ref!r}")
    return found[path]


def listed(commits: DataFrame, root: str) -> DataFrame:
    """sha, path, blob: the analysable files of each commit (column sha), listed by the tasks, one process a commit."""
    git = Git(root)

    def trees(batches):
        for batch in batches:
            for sha in batch.column(0).to_pylist():
                rows = [r for r in parse_tree(git.run("ls-tree", "-r", "-z", sha)) if is_analyzable(r[0])]
                yield pa.RecordBatch.from_arrays([pa.array([sha] * len(rows), pa.string()), pa.array([p for p, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string())], ["sha", "path", "blob"])

    return commits.select("sha").distinct().repartition("sha").mapInArrow(trees, "sha string, path string, blob string")


def blob_contents(ids: DataFrame, root: str) -> DataFrame:
    """blob, src of object ids (column blob), each read once, by the tasks: one process for a batch."""
    git = Git(root)

    def fetch(batches):
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            found = parse_batch(git.run("cat-file", "--batch", stdin="".join(f"{b}\n" for b in wanted).encode()), wanted) if wanted else {}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.binary())], ["blob", "src"])

    return ids.select("blob").distinct().mapInArrow(fetch, "blob string, src binary")


def log(git: Git, ref: str, limit: int, first_parent: bool = False) -> list[dict]:
    """The newest commits, oldest first."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    raw = git.run("log", f"--max-count={limit}", *["--first-parent"] * first_parent, "--format=%H%x1f%h%x1f%cI%x1f%s%x1e", ref or "HEAD").decode("utf-8", "replace")
    rows = []
    for record in raw.split("\x1e"):
        if not (record := record.strip("\n")):
            continue
        parts = record.split("\x1f")
        if len(parts) != 4:
            raise GitError("malformed log record")
        rows.append(dict(zip(("sha", "short_sha", "commit_time", "subject"), parts, strict=True)))
    return [r | {"position": i} for i, r in enumerate(reversed(rows))]


def churn(git: Git, since_days: int, as_of: datetime | None = None) -> dict[str, int]:
    """Commits per current path in the window before `as_of`, renames followed; one process for the whole tree."""
    if since_days <= 0:
        raise ValueError("the churn window must be positive")
    as_of = as_of or datetime.now(timezone.utc)
    raw = git.run("log", f"--since={(as_of - timedelta(days=since_days)).isoformat()}", f"--until={as_of.isoformat()}", "--find-renames", "--name-status", "-z", "--format=%x1e%H").decode("utf-8", "surrogateescape")
    counts: dict[str, int] = {}
    now: dict[str, str] = {}  # an older name to the name it has today
    for record in raw.split("\x1e")[1:]:
        fields = [f.strip("\n") for f in record.split("\0")]
        at = 1
        while at + 1 < len(fields):
            status, path = fields[at], fields[at + 1]
            at += 2
            if status[:1] in ("R", "C"):
                old, path = path, fields[at]
                at += 1
                if status[0] == "R":
                    now[old] = now.get(path, path)
            name = now.get(path, path)
            counts[name] = counts.get(name, 0) + 1
    return counts


def source_files(git: Git, ref: str) -> list[str]:
    """Analysable files of a ref."""
    return sorted(p for p in tree(git, ref) if is_analyzable(p))
