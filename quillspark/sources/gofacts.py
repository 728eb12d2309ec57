"""Type facts of a Go tree from syntax alone: declarations and uses by name, without a type checker.

Approximate on purpose: a use is resolved through the scopes around it, then the file's imports (`pkg.Name`) or the
package's own scope, so a local that shadows a package-level name is none; method calls resolve by name when one type
of the tree has that method, and a switch is over an enum when one of its cases names one of the constants.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.detectors import closure
from quillspark.sources.golex import GoSyntaxError, lex
from quillspark.sources.goparse import Node, parse

FACT = "path string, pkg string, fact string, a string, b string, c string, d string, pos bigint, params array<string>, flag boolean"
_NAMES = ["path", "pkg", "fact", "a", "b", "c", "d", "pos", "params", "flag"]


class Types:
    """The text of types: their source without comments and with one space where there was white space between words.

    Two types are equal as texts exactly if their tokens are.
    """

    def __init__(self, src: str):
        self.tokens = [t for t in lex(src) if t.text.strip() not in ("", ";")]
        self.starts = [t.pos for t in self.tokens]

    def of(self, node: Node | None) -> str:
        if node is None:
            return ""
        a, b = bisect.bisect_left(self.starts, node.pos), bisect.bisect_left(self.starts, node.end)
        out = ""
        for text in (t.text for t in self.tokens[a:b]):
            out += " " + text if out and (out[-1].isalnum() or out[-1] == "_") and (text[0].isalnum() or text[0] == "_") else text
        return out

    def each(self, fields: Node | None) -> list[str]:
        """One type per parameter: `a, b int` gives two."""
        return [self.of(f["type"]) for f in (fields["fields"] if fields else []) for _ in (f["names"] or [None])]

    def signature(self, t: Node) -> str:
        return f"({','.join(self.each(t['params']))})({','.join(self.each(t['results']))})"


def receiver(fields: Node | None) -> str:
    """The receiver's type without pointer and type arguments."""
    if fields is None or not fields["fields"]:
        return ""
    t = fields["fields"][0]["type"]
    while t.kind in ("StarExpr", "ParenExpr", "IndexExpr", "IndexListExpr"):
        t = t["x"]
    return t.op if t.kind == "Ident" else ""


def _exported(name: str) -> bool:
    return name[:1].isupper()


_SCOPES = frozenset("FuncDecl FuncLit BlockStmt IfStmt ForStmt RangeStmt SwitchStmt TypeSwitchStmt CaseClause CommClause SelectStmt".split())


class Scope:
    """Names declared in a block so far, and the block around it."""

    def __init__(self, outer: Scope | None):
        self.names: set[str] = set()
        self.outer = outer

    def holds(self, name: str) -> bool:
        scope: Scope | None = self
        while scope is not None:
            if name in scope.names:
                return True
            scope = scope.outer
        return False


def uses(tree: Node, imports: dict[str, str]) -> Iterator[tuple[str, Node]]:
    """("name", identifier), ("import", pkg.Name), ("member", x.Name) and ("switch", statement with a tag), in order of the source.

    Identifiers that a scope inside a function declares are left out, as are the places of declarations and labels.
    """
    todo: list = [(tree, None)]
    while todo:
        node, scope = todo.pop()
        if isinstance(node, str):  # a name that is declared from here on
            scope.names.add(node)
            continue
        if node.kind in _SCOPES:
            scope = Scope(scope)
        later: list = []  # what comes after, in order
        kind = node.kind
        if kind == "Ident":
            if scope is None or not scope.holds(node.op):
                yield "name", node
        elif kind == "SelectorExpr":
            x = node["x"]
            if x.kind == "Ident" and x.op in imports and not (scope and scope.holds(x.op)):
                yield "import", node
            else:
                yield "member", node
                later = [x]
        elif kind in ("FuncDecl", "FuncLit"):
            t = node["type"]
            fields = [f for part in (node["recv"], t["type_params"], t["params"], t["results"]) if part is not None for f in part["fields"]]
            later = [f["type"] for f in fields] + [n.op for f in fields for n in f["names"] or []] + ([node["body"]] if node["body"] is not None else [])
        elif kind == "AssignStmt" and node.op == ":=":
            later = [*node["rhs"], *(x.op for x in node["lhs"] if x.kind == "Ident")]
        elif kind == "RangeStmt" and node.op == ":=":
            later = [node["x"], *(x.op for x in (node["key"], node["value"]) if x is not None and x.kind == "Ident"), node["body"]]
        elif kind == "ValueSpec":
            inside = [n.op for n in node["names"]] if scope is not None else []
            later = ([node["type"]] if node["type"] is not None else []) + (node["values"] or []) + inside
        elif kind == "TypeSpec":
            params = [f for f in (node["params"]["fields"] if node["params"] is not None else [])]
            inner = Scope(scope)
            inner.names.update(n.op for f in params for n in f["names"] or [])
            if scope is not None:
                scope.names.add(node["name"].op)
            scope, later = inner, [*(f["type"] for f in params), node["type"]]
        elif kind in ("ImportSpec", "BranchStmt"):
            pass
        elif kind == "File":
            later = node["decls"]
        elif kind == "Field":
            later = [node["type"]]
        elif kind == "LabeledStmt":
            later = [node["stmt"]]
        else:
            if kind == "SwitchStmt" and node["tag"] is not None:
                yield "switch", node
            later = node.children
        todo += [(x, scope) for x in reversed(later)]


def facts_of(path: str, src: str, module: str = "") -> list[dict]:
    tree, types = parse(src), Types(src)
    folder = path.rpartition("/")[0]
    pkg = folder or tree["name"].op
    out: list[dict] = []

    def add(fact, a="", b="", c="", d="", pos=0, params=None, flag=False):
        out.append(dict(zip(_NAMES, (path, pkg, fact, a, b, c, d, pos, params or [], flag), strict=True)))

    imports: dict[str, str] = {}
    prefix = f"{module}/" if module else ""

    def embedded(t: Node) -> str:
        """The package and name of an embedded type, without pointer and type arguments; empty for anything else."""
        while t.kind in ("StarExpr", "ParenExpr", "IndexExpr", "IndexListExpr"):
            t = t["x"]
        if t.kind == "SelectorExpr" and t["x"].kind == "Ident":
            return f"{imports.get(t['x'].op, t['x'].op).removeprefix(prefix)}#{t['sel'].op}"
        return f"{pkg}#{t.op}" if t.kind == "Ident" else ""

    for decl in tree["decls"]:
        if decl.kind == "FuncDecl":
            recv = receiver(decl["recv"])
            add("func", recv, decl["name"].op, types.signature(decl["type"]), pos=decl.pos, params=types.each(decl["type"]["params"]), flag=_exported(decl["name"].op))
            if recv:
                add("method", recv, decl["name"].op, types.signature(decl["type"]))
        elif decl.op == "import":
            for spec in decl["specs"]:
                target = spec["path"]["text"].strip('"`')
                imports[spec["name"].op if spec["name"] else target.rpartition("/")[2]] = target
        elif decl.op == "type":
            for spec in decl["specs"]:
                t = spec["type"]
                kind = "interface" if t.kind == "InterfaceType" else "struct" if t.kind == "StructType" else "named"
                add("type", spec["name"].op, kind, "alias" if spec.op else "", "generic" if spec["params"] is not None else "", spec.pos, flag=_exported(spec["name"].op))
                if t.kind == "InterfaceType":
                    for f in t["methods"]["fields"]:
                        for name in f["names"] or []:
                            add("iface_method", spec["name"].op, name.op, types.signature(f["type"]))
                        if not f["names"] and (held := embedded(f["type"])):
                            add("embed_iface", spec["name"].op, held)
                elif t.kind == "StructType":
                    for f in t["fields"]["fields"]:
                        if not f["names"] and (held := embedded(f["type"])):
                            add("embed", spec["name"].op, held)
        else:
            last = None
            for spec in decl["specs"]:
                if spec["type"] is not None or spec["values"]:
                    last = spec["type"]
                for name in spec["names"]:
                    add(decl.op, name.op, types.of(last) if decl.op == "const" else "", pos=spec.pos, flag=_exported(name.op))
    for kind, node in uses(tree, imports):
        if kind == "switch":
            add("switch", pos=node.pos, params=[types.of(x) for clause in node["body"].children for x in clause["list"]])
        elif kind == "import":
            add("use", imports[node["x"].op].removeprefix(prefix), node["sel"].op, pos=node.pos)
        elif kind == "member":
            add("use_method", "", node["sel"].op, pos=node.pos)
        else:
            add("use", pkg, node.op, pos=node.pos)
    return out


def _extract(module: str):
    kinds = [pa.string()] * 7 + [pa.int64(), pa.list_(pa.string()), pa.bool_()]

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += facts_of(path, (raw or b"").decode(), module)
                except (GoSyntaxError, UnicodeDecodeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(_NAMES, kinds, strict=True)], _NAMES)

    return run


def with_embedded(methods: DataFrame, embeds: DataFrame) -> DataFrame:
    """Methods that interfaces ask for themselves or through the interfaces they embed, however deep."""
    held = methods.select(F.col("iface_id").alias("embedded_id"), "name", "sig")
    return methods.unionByName(closure(embeds).join(held, "embedded_id").select(F.col("type_id").alias("iface_id"), "name", "sig")).distinct()


def relations(files: DataFrame, module: str = "") -> dict[str, DataFrame]:
    """The relations of `operators.detectors.Facts` from files (path, src); test files are left out."""
    facts = files.where(~F.col("path").endswith("_test.go")).select("path", "src").mapInArrow(_extract(module), FACT).cache()
    of = lambda *names: facts.where(F.col("fact").isin(*names))
    ident = lambda pkg, name: F.concat_ws("#", pkg, name)
    kind = F.when(F.col("fact") == "func", F.when(F.col("a") == "", "func").otherwise("method")).otherwise(F.col("fact"))
    name = F.when(F.col("fact") == "func", F.col("b")).otherwise(F.col("a"))
    recv = F.when(F.col("fact") == "func", F.col("a")).otherwise(F.lit(""))
    symbol = F.when(recv == "", ident("pkg", name)).otherwise(F.concat_ws("#", "pkg", recv, name))
    symbols = of("func", "type", "var", "const").select(symbol.alias("id"), "pkg", name.alias("name"), kind.alias("kind"), recv.alias("recv"), F.col("flag").alias("exported"), "path")
    plain = of("use").select(ident("a", F.col("b")).alias("symbol_id"), "pkg", "path", "pos")
    by_name = symbols.where("kind = 'method'").groupBy("name").agg(F.min("id").alias("symbol_id"), F.count_distinct("id").alias("n")).where("n = 1")
    through = of("use_method").join(by_name, F.col("b") == F.col("name")).select("symbol_id", "pkg", "path", "pos")
    type_id = ident("pkg", F.col("a"))
    funcs = of("func").select("path", "pkg", F.col("a").alias("recv"), F.col("b").alias("name"), F.col("flag").alias("exported"), "params")
    consts = of("const").where("b <> ''").select("pkg", F.col("a").alias("name"), ident("pkg", F.col("b")).alias("type_id"))
    labels = of("switch").select("path", "pkg", "pos", F.explode("params").alias("label"))
    labels = labels.select("path", "pos", F.element_at(F.split("label", r"\."), -1).alias("name"), "pkg", F.contains("label", F.lit(".")).alias("far"))
    sites = labels.join(consts.withColumnRenamed("pkg", "const_pkg"), "name").where(F.col("far") | (F.col("pkg") == F.col("const_pkg"))).select("path", "pos", "type_id").distinct()
    return {
        "symbols": symbols,
        "uses": plain.join(symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").unionByName(through),
        "types": of("type").select(type_id.alias("id"), "pkg", F.col("a").alias("name"), F.col("b").alias("kind"), (F.col("c") != "").alias("is_alias"), (F.col("d") != "").alias("is_generic"), "path"),
        "methods": of("method").select(type_id.alias("type_id"), F.col("b").alias("name"), F.col("c").alias("sig"), "path"),
        "iface_methods": with_embedded(of("iface_method").select(type_id.alias("iface_id"), F.col("b").alias("name"), F.col("c").alias("sig")), of("embed_iface").select(type_id.alias("type_id"), F.col("b").alias("embedded_id"))),
        "embeds": of("embed").select(type_id.alias("type_id"), F.col("b").alias("embedded_id")),
        "consts": consts,
        "switch_sites": sites,
        "head_funcs": funcs,
    }
