"""A recursive-descent parser for Go source.

Nodes have the shape of the public `go/ast` package, as node counts and nesting are features.  A file that
doesn't parse raises `GoSyntaxError`.
"""

from __future__ import annotations

from quillspark.sources.golex import GoSyntaxError, Token, lex

_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_UNARY = frozenset("+ - ! ^ & ~".split())
_LITERALS = frozenset(("int", "float", "imag", "char", "string"))
_TYPE_NAMES = frozenset(("Ident", "SelectorExpr", "IndexExpr", "IndexListExpr"))

EXPRESSIONS = frozenset(
    "Ident BasicLit Ellipsis FuncLit CompositeLit ParenExpr SelectorExpr IndexExpr IndexListExpr SliceExpr TypeAssertExpr CallExpr StarExpr UnaryExpr"
    " BinaryExpr KeyValueExpr ArrayType StructType FuncType InterfaceType MapType ChanType".split()
)
STATEMENTS = frozenset(
    "DeclStmt EmptyStmt LabeledStmt ExprStmt SendStmt IncDecStmt AssignStmt GoStmt DeferStmt ReturnStmt BranchStmt BlockStmt IfStmt CaseClause"
    " SwitchStmt TypeSwitchStmt CommClause SelectStmt ForStmt RangeStmt".split()
)


class Node:
    """kind, op (operator, literal kind or name), parts by role, children in order."""

    __slots__ = ("kind", "op", "pos", "end", "line", "children", "parts")

    def __init__(self, kind: str, pos: int, end: int, line: int, op: str = "", **parts):
        self.kind, self.op, self.pos, self.end, self.line, self.parts = kind, op, pos, end, line, parts
        self.children: list[Node] = []
        for value in parts.values():
            if isinstance(value, Node):
                self.children.append(value)
            elif isinstance(value, list):
                self.children += value

    def __getitem__(self, role: str):
        return self.parts.get(role)


class Parser:
    def __init__(self, src: str):
        self.tokens, self.i, self.level = lex(src), 0, 0

    # tokens

    @property
    def tok(self) -> Token:
        return self.tokens[self.i]

    @property
    def last_end(self) -> int:
        return self.tokens[self.i - 1].end if self.i else 0

    def at(self, *texts: str) -> bool:
        t = self.tok
        return t.kind in ("op", "keyword") and t.text in texts

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.tok
        self.i += 1
        return t

    def accept(self, text: str) -> Token | None:
        return self.take() if self.at(text) else None

    def expect(self, text: str) -> Token:
        if not self.at(text):
            raise GoSyntaxError(f"line {self.tok.line}: {text!r} expected, {self.tok.text!r} found")
        return self.take()

    def semicolon(self) -> None:
        if self.at(")", "}"):
            return
        if not self.at(";", "\n"):
            raise GoSyntaxError(f"line {self.tok.line}: unexpected {self.tok.text!r}")
        self.i += 1

    def node(self, kind: str, start: Token | Node, op: str = "", **parts) -> Node:
        return Node(kind, start.pos, self.last_end, start.line, op, **parts)

    # names and lists

    def ident(self) -> Node:
        t = self.tok
        if t.kind != "ident":
            raise GoSyntaxError(f"line {t.line}: a name expected, {t.text!r} found")
        self.i += 1
        return Node("Ident", t.pos, t.end, t.line, t.text)

    def commas(self, item) -> list[Node]:
        out = [item()]
        while self.accept(","):
            out.append(item())
        return out

    # file and declarations

    def file(self) -> Node:
        start = self.expect("package")
        name = self.ident()
        self.semicolon()
        decls = []
        while self.at("import"):
            decls.append(self.general(self.import_spec))
            self.semicolon()
        while self.tok.kind != "eof":
            decls.append(self.declaration())
            if self.tok.kind != "eof":
                self.semicolon()
        return self.node("File", start, name=name, decls=decls)

    def declaration(self) -> Node:
        if self.at("func"):
            return self.function()
        if self.at("const", "var"):
            return self.general(self.value_spec)
        if self.at("type"):
            return self.general(self.type_spec)
        raise GoSyntaxError(f"line {self.tok.line}: a declaration expected, {self.tok.text!r} found")

    def general(self, spec) -> Node:
        start = self.take()
        specs = []
        if self.accept("("):
            while not self.at(")"):
                specs.append(spec())
                self.semicolon()
            self.expect(")")
        else:
            specs.append(spec())
        return self.node("GenDecl", start, start.text, specs=specs)

    def import_spec(self) -> Node:
        start, name = self.tok, None
        if self.tok.kind == "ident":
            name = self.ident()
        elif self.at("."):
            t = self.take()
            name = Node("Ident", t.pos, t.end, t.line, ".")
        if self.tok.kind != "string":
            raise GoSyntaxError(f"line {self.tok.line}: an import path expected")
        path = self.literal()
        return self.node("ImportSpec", start, name=name, path=path)

    def value_spec(self) -> Node:
        start = self.tok
        names = self.commas(self.ident)
        kind = None if self.at("=", ";", "\n", ")", "}") else self.type()
        values = self.commas(self.expression) if self.accept("=") else []
        return self.node("ValueSpec", start, names=names, type=kind, values=values)

    def type_spec(self) -> Node:
        start = self.tok
        name, params, alias = self.ident(), None, ""
        if self.at("[") and self.is_type_parameters():
            params = self.type_parameters()
        if self.accept("="):
            alias = "="
        kind = self.type()
        return self.node("TypeSpec", start, alias, name=name, params=params, type=kind)

    def is_type_parameters(self) -> bool:
        """After a type's name: `[P any]` or `[P, Q any]` rather than an array's length."""
        if self.peek().kind != "ident":
            return False
        t = self.peek(2)
        if t.kind == "ident" or t.text in (",", "~", "[", "interface", "func", "map", "chan", "struct", "("):
            return not (t.text == "(" or (t.text == "[" and self.peek(3).kind in _LITERALS))
        if t.text == "*":  # `[P *T]` or `[P *T, ...]`, not `[n * 2]`
            return self.peek(3).kind == "ident" and (self.peek(4).text in (",", "|") or (self.peek(4).text == "]" and self.peek(5).kind == "keyword"))
        return False

    def type_parameters(self) -> Node:
        start = self.expect("[")
        self.level += 1
        fields = []
        while not self.at("]"):
            first = self.tok
            names = self.commas(self.ident)
            kind = self.constraint()
            fields.append(self.node("Field", first, names=names, type=kind))
            if not self.accept(","):
                break
        self.level -= 1
        self.expect("]")
        return self.node("FieldList", start, fields=fields)

    def constraint(self) -> Node:
        """A union of types, each maybe with a tilde."""
        left = self.constraint_term()
        while self.at("|"):
            self.take()
            right = self.constraint_term()
            left = self.node("BinaryExpr", left, "|", x=left, y=right)
        return left

    def constraint_term(self) -> Node:
        start = self.tok
        if self.accept("~"):
            kind = self.type()
            return self.node("UnaryExpr", start, "~", x=kind)
        return self.type()

    def function(self) -> Node:
        start = self.expect("func")
        recv = self.parameters() if self.at("(") else None
        name = self.ident()
        params = self.type_parameters() if self.at("[") else None
        kind = self.signature(start, params)
        body = None
        if self.at("{"):
            held, self.level = self.level, 0
            body = self.block()
            self.level = held
        return self.node("FuncDecl", start, recv=recv, name=name, type=kind, body=body)

    def signature(self, start: Token, type_params: Node | None = None) -> Node:
        params = self.parameters()
        results = None
        if self.at("("):
            results = self.parameters()
        elif self.starts_type():
            first = self.tok
            kind = self.type()
            results = self.node("FieldList", first, fields=[self.node("Field", first, type=kind)])
        return self.node("FuncType", start, type_params=type_params, params=params, results=results)

    def parameters(self) -> Node:
        start = self.expect("(")
        self.level += 1
        entries: list[tuple[Token, Node, Node | None]] = []  # where, first part, type behind a name
        while not self.at(")"):
            first = self.tok
            part = self.variadic()
            behind = None
            if not self.at(",", ")"):
                behind = self.variadic()
            entries.append((first, part, behind))
            if not self.accept(","):
                break
        self.level -= 1
        self.expect(")")
        fields = []
        if any(b is not None for _, _, b in entries):
            names: list[Node] = []
            first = None
            for where, part, behind in entries:
                first = first or where
                if part.kind != "Ident":
                    raise GoSyntaxError(f"line {part.line}: mixed named and unnamed parameters")
                names.append(part)
                if behind is not None:
                    fields.append(Node("Field", first.pos, behind.end, first.line, names=names, type=behind))
                    names, first = [], None
            if names:
                raise GoSyntaxError(f"line {names[0].line}: mixed named and unnamed parameters")
        else:
            fields = [Node("Field", p.pos, p.end, p.line, type=p) for _, p, _ in entries]
        return self.node("FieldList", start, fields=fields)

    def variadic(self) -> Node:
        start = self.tok
        if self.accept("..."):
            kind = self.type()
            return self.node("Ellipsis", start, elt=kind)
        return self.type()

    # types

    def starts_type(self) -> bool:
        return self.tok.kind == "ident" or self.at("*", "[", "struct", "interface", "map", "chan", "func", "<-", "(")

    def type(self) -> Node:
        start = self.tok
        if start.kind == "ident":
            return self.type_name()
        if self.accept("*"):
            kind = self.type()
            return self.node("StarExpr", start, x=kind)
        if self.accept("("):
            kind = self.type()
            self.expect(")")
            return self.node("ParenExpr", start, x=kind)
        if self.at("["):
            return self.array_type()
        if self.at("struct"):
            return self.struct_type()
        if self.at("interface"):
            return self.interface_type()
        if self.accept("map"):
            self.expect("[")
            self.level += 1
            key = self.type()
            self.level -= 1
            self.expect("]")
            value = self.type()
            return self.node("MapType", start, key=key, value=value)
        if self.at("chan", "<-"):
            return self.channel_type()
        if self.accept("func"):
            return self.signature(start)
        raise GoSyntaxError(f"line {start.line}: a type expected, {start.text!r} found")

    def type_name(self) -> Node:
        x = self.ident()
        if self.at("."):
            self.take()
            sel = self.ident()
            x = self.node("SelectorExpr", x, x=x, sel=sel)
        if self.at("[") and self.peek().text != "]":
            x = self.indices(x)
        return x

    def indices(self, x: Node) -> Node:
        """Type arguments behind a type's name."""
        self.expect("[")
        self.level += 1
        args = [self.type()]
        while self.accept(","):
            if self.at("]"):
                break
            args.append(self.type())
        self.level -= 1
        self.expect("]")
        return self.node("IndexExpr", x, x=x, index=args[0]) if len(args) == 1 else self.node("IndexListExpr", x, x=x, indices=args)

    def array_type(self) -> Node:
        start = self.expect("[")
        self.level += 1
        size = None
        if self.at("..."):
            t = self.take()
            size = Node("Ellipsis", t.pos, t.end, t.line)
        elif not self.at("]"):
            size = self.expression()
        self.level -= 1
        self.expect("]")
        elt = self.type()
        return self.node("ArrayType", start, len=size, elt=elt)

    def channel_type(self) -> Node:
        start, way = self.tok, "both"
        if self.accept("<-"):
            self.expect("chan")
            way = "recv"
        else:
            self.expect("chan")
            if self.accept("<-"):
                way = "send"
        value = self.type()
        return self.node("ChanType", start, way, value=value)

    def struct_type(self) -> Node:
        start = self.expect("struct")
        brace = self.expect("{")
        fields = []
        while not self.at("}"):
            first = self.tok
            names, kind = [], None
            if self.at("*", "(") or (first.kind == "ident" and (self.peek().text in (".", "}", ";", "\n") or self.peek().kind == "string")):
                kind = self.type()
            else:
                names = self.commas(self.ident)
                if len(names) == 1 and self.at("[") and self.is_embedded_generic():
                    kind, names = self.indices(names[0]), []
                else:
                    kind = self.type()
            tag = self.literal() if self.tok.kind == "string" else None
            fields.append(self.node("Field", first, names=names, type=kind, tag=tag))
            self.semicolon()
        self.expect("}")
        held = self.node("FieldList", brace, fields=fields)
        return self.node("StructType", start, fields=held)

    def is_embedded_generic(self) -> bool:
        """`T[X]` on a line of its own, rather than a field of array or slice type."""
        depth, k = 0, 0
        while True:
            t = self.peek(k)
            depth += (t.text == "[") - (t.text == "]")
            if t.kind == "eof":
                return False
            if not depth:
                break
            k += 1
        return k > 1 and self.peek(k + 1).text in (";", "\n", "}")

    def interface_type(self) -> Node:
        start = self.expect("interface")
        brace = self.expect("{")
        fields = []
        while not self.at("}"):
            first = self.tok
            if first.kind == "ident" and self.peek().text == "(":
                name = self.ident()
                kind = self.signature(self.tok)
                fields.append(self.node("Field", first, names=[name], type=kind))
            else:
                kind = self.constraint()
                fields.append(self.node("Field", first, type=kind))
            self.semicolon()
        self.expect("}")
        held = self.node("FieldList", brace, fields=fields)
        return self.node("InterfaceType", start, methods=held)

    # statements

    def block(self) -> Node:
        start = self.expect("{")
        rows = self.statements()
        self.expect("}")
        return self.node("BlockStmt", start, list=rows)

    def statements(self) -> list[Node]:
        out = []
        while not self.at("}", "case", "default") and self.tok.kind != "eof":
            out.append(self.statement())
        return out

    def statement(self) -> Node:
        start = self.tok
        if self.at(";", "\n"):
            self.take()
            return self.node("EmptyStmt", start)
        if self.at("}"):
            return Node("EmptyStmt", start.pos, start.pos, start.line)
        if start.kind == "keyword":
            made = getattr(self, f"_s_{start.text}", None)
            if made is not None:
                out = made(start)
                self.semicolon()
                return out
            if self.at("const", "var", "type"):
                decl = self.declaration()
                out = self.node("DeclStmt", start, decl=decl)
                self.semicolon()
                return out
        if self.at("{"):
            out = self.block()
            self.semicolon()
            return out
        if start.kind == "ident" and self.peek().text == ":":
            label = self.ident()
            self.take()
            inner = self.statement()
            return self.node("LabeledStmt", start, label=label, stmt=inner)
        out = self.simple()
        self.semicolon()
        return out

    def simple(self) -> Node:
        start = self.tok
        left = self.commas(self.expression)
        if self.tok.kind == "op" and self.tok.text in _ASSIGN:
            op = self.take().text
            right = self.commas(self.expression)
            return self.node("AssignStmt", start, op, lhs=left, rhs=right)
        if len(left) > 1:
            raise GoSyntaxError(f"line {start.line}: one expression expected")
        if self.at("++", "--"):
            op = self.take().text
            return self.node("IncDecStmt", start, op, x=left[0])
        if self.accept("<-"):
            value = self.expression()
            return self.node("SendStmt", start, chan=left[0], value=value)
        return self.node("ExprStmt", start, x=left[0])

    def _call_stmt(self, kind: str, start: Token) -> Node:
        self.take()
        call = self.expression()
        if call.kind not in ("CallExpr", "ParenExpr"):
            raise GoSyntaxError(f"line {start.line}: a call expected")
        op = "recover" if kind == "DeferStmt" and call["fun"] is not None and call["fun"].kind == "Ident" and call["fun"].op == "recover" else ""
        return self.node(kind, start, op, call=call)

    def _s_go(self, start):
        return self._call_stmt("GoStmt", start)

    def _s_defer(self, start):
        return self._call_stmt("DeferStmt", start)

    def _s_return(self, start):
        self.take()
        values = [] if self.at(";", "\n", "}") else self.commas(self.expression)
        return self.node("ReturnStmt", start, results=values)

    def _branch(self, start):
        op = self.take().text
        label = self.ident() if op != "fallthrough" and self.tok.kind == "ident" else None
        return self.node("BranchStmt", start, op, label=label)

    _s_break = _s_continue = _s_goto = _s_fallthrough = _branch

    def header(self, start: Token):
        """The parts of an if or switch header before its block: (init, tail), either may be None."""
        held, self.level = self.level, -1
        init = tail = None
        if not self.at("{"):
            if not self.at(";"):
                tail = self.simple()
            if self.at(";", "\n"):
                self.take()
                init, tail = tail, None
                if not self.at("{"):
                    tail = self.simple()
        self.level = held
        return init, tail

    def _s_if(self, start):
        self.expect("if")
        init, cond = self.header(start)
        if cond is None or cond.kind != "ExprStmt":
            raise GoSyntaxError(f"line {start.line}: an if needs a condition")
        body = self.block()
        other = None
        if self.accept("else"):
            here = self.tok
            other = self._s_if(here) if self.at("if") else self.block()
        return self.node("IfStmt", start, init=init, cond=cond["x"], body=body, other=other)

    def _s_switch(self, start):
        self.expect("switch")
        init, tag = self.header(start)
        typed = tag is not None and self.is_type_switch(tag)
        brace = self.expect("{")
        clauses = []
        while not self.at("}"):
            clauses.append(self.case_clause(typed))
        self.expect("}")
        body = self.node("BlockStmt", brace, list=clauses)
        if typed:
            return self.node("TypeSwitchStmt", start, init=init, assign=tag, body=body)
        if tag is not None and tag.kind != "ExprStmt":
            raise GoSyntaxError(f"line {start.line}: a switch needs an expression")
        return self.node("SwitchStmt", start, init=init, tag=tag["x"] if tag else None, body=body)

    @staticmethod
    def is_type_switch(tag: Node) -> bool:
        x = tag["x"] if tag.kind == "ExprStmt" else tag["rhs"][0] if tag.kind == "AssignStmt" and tag.op == ":=" and len(tag["lhs"]) == len(tag["rhs"]) == 1 else None
        return x is not None and x.kind == "TypeAssertExpr" and x["type"] is None

    def case_clause(self, typed: bool) -> Node:
        start = self.tok
        if self.accept("default"):
            values = []
        else:
            self.expect("case")
            values = self.commas(self.type if typed else self.expression)
        self.expect(":")
        body = self.statements()
        return self.node("CaseClause", start, list=values, body=body)

    def _s_select(self, start):
        self.expect("select")
        brace = self.expect("{")
        clauses = []
        while not self.at("}"):
            first = self.tok
            comm = None
            if not self.accept("default"):
                self.expect("case")
                comm = self.simple()
            self.expect(":")
            body = self.statements()
            clauses.append(self.node("CommClause", first, comm=comm, body=body))
        self.expect("}")
        body = self.node("BlockStmt", brace, list=clauses)
        return self.node("SelectStmt", start, body=body)

    def _s_for(self, start):
        self.expect("for")
        held, self.level = self.level, -1
        init = cond = post = None
        found = None
        if self.at("range"):
            self.take()
            found = ([], "", self.expression())
        elif not self.at("{"):
            if not self.at(";"):
                found = self.range_header()
                init = None if isinstance(found, tuple) else found
                found = found if isinstance(found, tuple) else None
            if found is None:
                if self.at(";"):
                    self.take()
                    if not self.at(";"):
                        if self.at("{"):
                            raise GoSyntaxError(f"line {start.line}: a for clause is incomplete")
                        cond = self.simple()
                    if not self.at(";", "\n"):
                        raise GoSyntaxError(f"line {start.line}: a for clause is incomplete")
                    self.take()
                    if not self.at("{"):
                        post = self.simple()
                else:
                    init, cond = None, init
        self.level = held
        body = self.block()
        if found is not None:
            names, op, x = found
            key, value = (*names, None, None)[:2]
            return self.node("RangeStmt", start, op, key=key, value=value, x=x, body=body)
        if cond is not None and cond.kind != "ExprStmt":
            raise GoSyntaxError(f"line {start.line}: a condition expected")
        return self.node("ForStmt", start, init=init, cond=cond["x"] if cond else None, post=post, body=body)

    def range_header(self):
        """A simple statement, or (names, operator, ranged expression)."""
        mark = self.i
        left = self.commas(self.expression)
        if self.at("=", ":=") and self.peek().text == "range":
            op = self.take().text
            self.take()
            if len(left) > 2:
                raise GoSyntaxError(f"line {left[2].line}: at most two range variables")
            return left, op, self.expression()
        self.i = mark
        return self.simple()

    # expressions

    def expression(self, least: int = 1) -> Node:
        left = self.unary()
        while self.tok.kind == "op" and (rank := _BINARY.get(self.tok.text, 0)) >= least:
            op = self.take().text
            right = self.expression(rank + 1)
            left = self.node("BinaryExpr", left, op, x=left, y=right)
        return left

    def unary(self) -> Node:
        start = self.tok
        if start.kind == "op":
            if start.text in _UNARY:
                self.take()
                x = self.unary()
                return self.node("UnaryExpr", start, start.text, x=x)
            if start.text == "*":
                self.take()
                x = self.unary()
                return self.node("StarExpr", start, x=x)
            if start.text == "<-":
                if self.peek().text == "chan":
                    return self.primary(self.channel_type())
                self.take()
                x = self.unary()
                return self.node("UnaryExpr", start, "<-", x=x)
        return self.primary(self.operand())

    def literal(self) -> Node:
        t = self.take()
        return Node("BasicLit", t.pos, t.end, t.line, t.kind, text=t.text)

    def operand(self) -> Node:
        start = self.tok
        if start.kind == "ident":
            return self.ident()
        if start.kind in _LITERALS:
            return self.literal()
        if self.accept("("):
            x = self.inner(self.expression)
            self.expect(")")
            return self.node("ParenExpr", start, x=x)
        if self.accept("func"):
            kind = self.signature(start)
            if self.at("{"):
                held, self.level = self.level, 0
                body = self.block()
                self.level = held
                return self.node("FuncLit", start, type=kind, body=body)
            return kind
        if self.at("[", "struct", "map", "chan", "interface"):
            return self.type()
        raise GoSyntaxError(f"line {start.line}: an expression expected, {start.text!r} found")

    def primary(self, x: Node) -> Node:
        while True:
            if self.at("."):
                self.take()
                if self.accept("("):
                    kind = None
                    if not self.accept("type"):
                        kind = self.type()
                    self.expect(")")
                    x = self.node("TypeAssertExpr", x, x=x, type=kind)
                else:
                    sel = self.ident()
                    x = self.node("SelectorExpr", x, x=x, sel=sel)
            elif self.at("["):
                x = self.index_or_slice(x)
            elif self.at("("):
                x = self.call(x)
            elif self.at("{") and self.may_be_composite(x):
                x = self.composite(x)
            else:
                return x

    def may_be_composite(self, x: Node) -> bool:
        if x.kind in ("ArrayType", "StructType", "MapType"):
            return True
        if x.kind not in _TYPE_NAMES or self.level < 0:
            return False
        base = x
        while base.kind in ("IndexExpr", "IndexListExpr"):
            base = base["x"]
        return base.kind == "Ident" or (base.kind == "SelectorExpr" and base["x"].kind == "Ident")

    def inner(self, f):
        """f inside brackets, where composite literals are unambiguous again."""
        held, self.level = self.level, max(self.level, 0) + 1
        out = f()
        self.level = held
        return out

    def index_or_slice(self, x: Node) -> Node:
        self.expect("[")

        def parts():
            bounds: list[Node | None] = [None]
            colons = 0
            if not self.at(":"):
                bounds[0] = self.expression()
                if self.at(","):
                    args = [bounds[0]]
                    while self.accept(","):
                        if self.at("]"):
                            break
                        args.append(self.expression())
                    return args, -1 if len(args) > 1 else 0
            while self.accept(":"):
                colons += 1
                bounds.append(None if self.at(":", "]") else self.expression())
            return bounds, colons

        bounds, colons = self.inner(parts)
        self.expect("]")
        if colons < 0:
            return self.node("IndexListExpr", x, x=x, indices=bounds)
        if colons == 0:
            return self.node("IndexExpr", x, x=x, index=bounds[0])
        if colons > 2 or (colons == 2 and None in bounds[1:]):
            raise GoSyntaxError(f"line {x.line}: a slice is incomplete")
        low, high, most = (*bounds, None)[:3]
        return self.node("SliceExpr", x, x=x, low=low, high=high, max=most)

    def call(self, fun: Node) -> Node:
        self.expect("(")

        def arguments():
            args = []
            while not self.at(")"):
                args.append(self.expression())
                self.accept("...")
                if not self.accept(","):
                    break
            return args

        args = self.inner(arguments)
        self.expect(")")
        return self.node("CallExpr", fun, fun=fun, args=args)

    def composite(self, kind: Node | None) -> Node:
        start = self.expect("{")

        def elements():
            out = []
            while not self.at("}"):
                x = self.element()
                if self.accept(":"):
                    value = self.element()
                    x = self.node("KeyValueExpr", x, key=x, value=value)
                out.append(x)
                if not self.accept(","):
                    break
            return out

        elts = self.inner(elements)
        self.expect("}")
        return self.node("CompositeLit", kind or start, type=kind, elts=elts)

    def element(self) -> Node:
        return self.composite(None) if self.at("{") else self.expression()


def parse(src: str) -> Node:
    if not src:
        raise GoSyntaxError("empty file")
    parser = Parser(src)
    try:
        return parser.file()
    except RecursionError as e:
        raise GoSyntaxError("nested too deeply") from e
