"""Go source as relations: one parse per distinct text, rows per syntax node, features as aggregations."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.clones import cross_mass, intra_mass
from quillspark.operators.paths import analyzable
from quillspark.sources.golex import GoSyntaxError, code_lines
from quillspark.sources.goparse import EXPRESSIONS, STATEMENTS, Node, parse

_NODE = pa.struct(
    [
        ("node_id", pa.int32()), ("parent_id", pa.int32()), ("kind", pa.string()), ("op", pa.string()), ("is_stmt", pa.bool_()), ("is_expr", pa.bool_()),
        ("in_func_body", pa.bool_()), ("block_depth", pa.int32()), ("pos", pa.int64()), ("end", pa.int64()), ("line", pa.int32()), ("size", pa.int32()), ("digest", pa.string()),
    ]
)
_NODE_SQL = "struct<node_id:int,parent_id:int,kind:string,op:string,is_stmt:boolean,is_expr:boolean,in_func_body:boolean,block_depth:int,pos:bigint,end:bigint,line:int,size:int,digest:string>"
#: Kinds whose operator tells copies apart; names and literal values never do.
_TAGGED = frozenset(("BasicLit", "BinaryExpr", "UnaryExpr", "AssignStmt", "IncDecStmt", "BranchStmt"))


def rows_of(tree: Node) -> list[dict]:
    """One row per node, children before parents; sizes and digests are folded upwards."""
    out: list[dict] = []
    ids = 0
    # (node, parent's id, inside a function's body, depth of blocks)
    stack: list = [(tree, -1, False, 0, None)]
    done: dict[int, list] = {}
    while stack:
        node, parent, inside, depth, number = stack.pop()
        if number is None:
            number, ids = ids, ids + 1
            done[number] = []
            stack.append((node, parent, inside, depth, number))
            for child in reversed(node.children):
                body = node.kind == "FuncDecl" and child is node["body"]
                deeper = depth + 1 if child.kind == "BlockStmt" and inside and not body else (0 if body else depth)
                stack.append((child, number, inside or body, deeper, None))
            continue
        below = done.pop(number)
        tag = f"{node.kind}:{node.op}" if node.kind in _TAGGED else node.kind
        digest = hashlib.blake2b("|".join([tag, *(d for d, _ in below)]).encode(), digest_size=8).hexdigest()
        size = 1 + sum(s for _, s in below)
        if parent >= 0:
            done[parent].append((digest, size))
        out.append(
            {
                "node_id": number, "parent_id": parent, "kind": node.kind, "op": node.op, "is_stmt": node.kind in STATEMENTS, "is_expr": node.kind in EXPRESSIONS,
                "in_func_body": inside, "block_depth": depth, "pos": node.pos, "end": node.end, "line": node.line, "size": size, "digest": digest,
            }
        )
    return out


def _parse(batches):
    for batch in batches:
        ok, lines, nodes = [], [], []
        for raw in batch.column(1).to_pylist():
            try:
                src = (raw or b"").decode()
                rows = rows_of(parse(src))
                ok.append(True)
                lines.append(code_lines(src))
                nodes.append(rows)
            except (GoSyntaxError, UnicodeDecodeError):
                ok.append(False)
                lines.append(0)
                nodes.append([])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok), pa.array(lines, pa.int64()), pa.array(nodes, pa.list_(_NODE))], ["blob", "parse_ok", "n_lines", "nodes"])


def parsed(files: DataFrame) -> DataFrame:
    """files (frame, path, src) with parse_ok, n_lines and nodes; equal contents are parsed once, whatever frame they are in."""
    keyed = files.withColumn("blob", F.sha2("src", 256))
    texts = keyed.select("blob", "src").dropDuplicates(["blob"])
    return keyed.drop("src").join(texts.mapInArrow(_parse, f"blob string, parse_ok boolean, n_lines bigint, nodes array<{_NODE_SQL}>"), "blob").where("parse_ok")


def ast_nodes(files: DataFrame) -> DataFrame:
    return files.select("frame", "path", F.explode("nodes").alias("n")).select("frame", "path", "n.*")


def occurrences(nodes: DataFrame) -> DataFrame:
    """Statements and expressions: the only clone seeds."""
    return nodes.where("is_stmt or is_expr").select("frame", "path", "digest", "size", "pos", "end")


def features(files: DataFrame, cross: bool = True) -> DataFrame:
    """frame, path and the six features of each parsed file; the cross-file pass is left out of the plan if not wanted."""
    per_file = lambda cond: F.size(F.filter("nodes", cond)).cast("long")
    decision = lambda n: n["in_func_body"] & (
        n["kind"].isin("IfStmt", "ForStmt", "RangeStmt", "CaseClause", "CommClause")
        | ((n["kind"] == "BinaryExpr") & n["op"].isin("&&", "||"))
        | ((n["kind"] == "DeferStmt") & (n["op"] == "recover"))
    )
    depth = F.array_max(F.transform(F.filter("nodes", lambda n: n["in_func_body"] & (n["kind"] == "BlockStmt")), lambda n: n["block_depth"]))
    rows = files.select(
        "frame", "path",
        per_file(decision).alias("cyclomatic"),
        F.coalesce(depth, F.lit(0)).cast("long").alias("nesting"),
        per_file(lambda n: n["kind"] == "ImportSpec").alias("coupling"),
        F.col("n_lines").alias("length"),
    )
    occ = occurrences(ast_nodes(files))
    own = intra_mass(occ, ["frame", "path"]).withColumnRenamed("mass", "duplication")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = rows.join(own, ["frame", "path"], "left").select(*rows.columns, zero("duplication"))
    if not cross:
        return out.withColumn("cross_duplication", F.lit(0).cast("long"))
    shared = cross_mass(occ, "path", ["frame"]).withColumnRenamed("mass", "cross_duplication")
    return out.join(shared, ["frame", "path"], "left").select(*out.columns, zero("cross_duplication"))


def read_tree(spark: SparkSession, root: str, frame: str = "tree") -> DataFrame:
    """frame, path (relative), src of the analysable files under a folder, or of one file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    base = fs.makeQualified(path)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.go").load(root)
    whole = str(base.toUri().getPath()).rstrip("/")
    name = str(base.getName())
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + _quoted(whole) + "/?", "")
    rel = F.when(below == "", F.lit(name)).otherwise(below)
    return raw.select(F.lit(frame).alias("frame"), rel.alias("path"), F.col("content").alias("src")).where(analyzable(F.col("path")))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else "\\" + c for c in text)
