"""The Go lexer and parser against small sources with known feature values."""

import pytest

from quillspark.sources.golex import GoSyntaxError, code_lines
from quillspark.sources.goparse import parse
from quillspark.sources.gosrc import rows_of


def measures(src):
    rows = rows_of(parse(src))
    inside = [r for r in rows if r["in_func_body"]]
    decisions = [r for r in inside if r["kind"] in ("IfStmt", "ForStmt", "RangeStmt", "CaseClause", "CommClause") or (r["kind"] == "BinaryExpr" and r["op"] in ("&&", "||")) or (r["kind"] == "DeferStmt" and r["op"] == "recover")]
    depth = max([r["block_depth"] for r in inside if r["kind"] == "BlockStmt"], default=0)
    return len(decisions), depth, sum(r["kind"] == "ImportSpec" for r in rows)


def body(text):
    return "package p\n\nfunc f(a, b, c bool, xs []int, ch chan int) {\n" + text + "\n}\n"


@pytest.mark.parametrize(
    ("text", "cyclomatic", "nesting"),
    [
        ("", 0, 0),
        ("x := 1\n_ = x", 0, 0),
        ("if a {\n}", 1, 1),
        ("if a {\n} else {\n}", 1, 1),
        ("if a {\n} else if b {\n} else if c {\n}", 3, 1),
        ("if a {\nif b {\n}\n}", 2, 2),
        ("for i := 0; i < 3; i++ {\n}", 1, 1),
        ("for i := 0; i < 3; i++ {\nfor {\n}\n}", 2, 2),
        ("for _, x := range xs {\n_ = x\n}", 1, 1),
        ("for range xs {\n}", 1, 1),
        ("for a {\n}", 1, 1),
        ("switch len(xs) {\ncase 1:\ncase 2, 3:\ndefault:\n}", 3, 1),
        ("switch {\ncase a:\nif b {\n}\n}", 2, 2),
        ("select {\ncase <-ch:\ncase ch <- 1:\n}", 2, 1),
        ("_ = a && b", 1, 0),
        ("_ = a && b && c || a", 3, 0),
        ("defer recover()", 1, 0),
        ("defer close(ch)", 0, 0),
        ("g := func() {\nif a {\n}\n}\ng()", 1, 2),
        ("{\n}", 0, 1),
        ("switch x := any(a).(type) {\ncase int, string:\n_ = x\ncase nil:\n}", 2, 1),
        ("for _, x := range xs {\nif x > 0 && a {\n}\n}", 3, 2),
        ("if v, ok := map[string]int{\"a\": 1}[\"a\"]; ok {\n_ = v\n}", 1, 1),
        ("if x := (T{1}); x.a > 0 {\n}", 1, 1),
        ("L:\nfor {\nbreak L\n}", 1, 1),
        ("go func() { <-ch }()\nxs[0]++\nxs = xs[1:2:3]\nch <- 1\nvar y, z = 1, 2.5e3\n_, _ = y, z", 0, 1),
    ],
)
def test_decisions_and_nesting(text, cyclomatic, nesting):
    assert measures(body(text))[:2] == (cyclomatic, nesting)


def test_only_function_declarations_count():
    src = "package p\n\nvar f = func(a bool) {\n\tif a {\n\t}\n}\n\nfunc (r *T[K]) m() {\n\tfor {\n\t}\n}\n\nfunc external(x int) int\n"
    assert measures(src)[:2] == (1, 1)


@pytest.mark.parametrize(("text", "n"), [("", 0), ('import "fmt"\n', 1), ('import (\n"a"\n_ "b"\n. "c"\nd "e"\n)\n', 4), ('import "C"\nimport "a"\n', 2)])
def test_coupling(text, n):
    assert measures("package p\n" + text)[2] == n


@pytest.mark.parametrize(
    ("src", "n"),
    [
        ("package p\n", 1),
        ("package p\n\nfunc f() {}\n", 2),
        ("package p\n\n// a comment\n\nfunc f() {\n\t/* two\n\tlines */\n\tx := 1 // trailing\n\t_ = x\n}\n", 5),
        ("", 0),
        ("package p\n\nvar s = `a\nb\nc`\n", 3),
    ],
)
def test_code_lines(src, n):
    assert code_lines(src) == n


@pytest.mark.parametrize("src", ["", "func f() {}", "package p\nfunc f( {", "package p\nvar x = ", "package p\n/* open", 'package p\nvar s = "open\n', "package p\nfunc f() { if { } }"])
def test_rejects(src):
    with pytest.raises(GoSyntaxError):
        parse(src)


def test_generics_and_types():
    src = """package p

type Set[T comparable] map[T]struct{}
type Pair[K ~string | ~int, V any] struct {
	Key K `json:"k"`
	Val V
	Set[K]
	*Base
	pkg.Other
}
type Arr [4]int
type Num interface {
	~int | ~float64
	String() string
}
type Fn func(a, b int, rest ...string) (n int, err error)

func Map[T, U any](xs []T, f func(T) U) []U {
	out := make([]U, 0, len(xs))
	for _, x := range xs {
		out = append(out, f(x))
	}
	return out
}

func use(in <-chan int, out chan<- int) {
	m := Map[int, string]([]int{1, 2}, func(i int) string { return "" })
	p := Pair[string, int]{Key: "a", Val: 1}
	q := [...]int{0: 1, 2: 3}
	r := []struct{ a, b int }{{1, 2}, {a: 3}}
	var i interface{} = &p
	if s, ok := i.(fmt.Stringer); ok && s != nil {
		goto end
	}
end:
	_, _, _ = m, q, r
	x, y := <-in, -1i
	out <- x<<2 | x&^3
	_ = y
}
"""
    rows = rows_of(parse(src))
    assert rows[-1]["kind"] == "File" and rows[-1]["size"] == len(rows)


# 23 nodes: the loop 1, k := n 3, k > 0 3, k-- 2, its block 1, two calls with one argument 4 each, one with two 5
LOOP = "for k := n; k > 0; k-- {\n\tprintln(k)\n\tprintln(n)\n\tprintln(k, acc)\n}\n"
# 28 nodes: the branch 1, n > 3 3, its block 1, the loop 23
BRANCH = "if n > 3 {\n" + LOOP + "}\n"


def clone_file(*parts):
    return "package p\n\nfunc f(n, acc, total int) {\n" + "".join(parts) + "}\n"


@pytest.mark.parametrize("z", [clone_file(BRANCH, LOOP), clone_file(LOOP, BRANCH)])
def test_cross_file_masses(spark, z):
    from quillspark.sources import gosrc

    files = [("t", "a_outer.go", clone_file("_ = 1\n", BRANCH)), ("t", "b_inner.go", clone_file("x := 1\n_ = x\n", LOOP)), ("t", "z.go", z)]
    df = spark.createDataFrame([(f, p, bytearray(s.encode())) for f, p, s in files], "frame string, path string, src binary")
    got = {r.path: r.cross_duplication for r in gosrc.features(gosrc.parsed(df)).collect()}
    assert got == {"a_outer.go": 0, "b_inner.go": 23, "z.go": 28 + 23}


def test_intra_file_mass_survives_renaming(spark):
    from quillspark.sources import gosrc

    renamed = LOOP.replace("acc", "total").replace("k", "left").replace("println(n)", "print(n) /* note */")
    once, twice, thrice = clone_file(LOOP), clone_file(LOOP, renamed), clone_file(LOOP, renamed, LOOP)
    df = spark.createDataFrame([("t", p, bytearray(s.encode())) for p, s in (("1.go", once), ("2.go", twice), ("3.go", thrice), ("bad.go", "package"))], "frame string, path string, src binary")
    got = {r.path: r.duplication for r in gosrc.features(gosrc.parsed(df), cross=False).collect()}
    assert got == {"1.go": 0, "2.go": 23, "3.go": 46}


def test_subtree_sizes_and_digests():
    """Sizes worked out by hand; digests ignore names and literal values, but not operators and literal kinds."""
    rows = {(r["kind"], r["size"]): r["digest"] for r in rows_of(parse(clone_file(LOOP)))}
    assert {("ForStmt", 23), ("AssignStmt", 3), ("BinaryExpr", 3), ("IncDecStmt", 2), ("CallExpr", 4)} <= set(rows)
    digest = lambda text: next(r["digest"] for r in rows_of(parse(clone_file(text))) if r["kind"] == "AssignStmt")
    assert digest("x := a + 1\n") == digest("y := b + 22\n") == digest("z /* c */ := q+3\n")
    assert len({digest(t) for t in ("x := a + 1\n", "x := a - 1\n", "x = a + 1\n", "x := a + 1.5\n", "x := a + b\n")}) == 5


def test_type_texts():
    from quillspark.sources.gofacts import facts_of

    src = """package p

func (r *Box[K]) M(a, b map[string] /* c */ int, f func(int) (x bool), rest ...pkg.T) (<-chan int, error) { return nil, nil }
func F(s struct {
	A int
	B string
}, t struct{ A int; B string }) {}

type I interface { M(a map[string]int) ; ~int }
type S struct { *Base ; pkg.Other }
"""
    facts = facts_of("d/x.go", src)
    funcs = {f["b"]: f["params"] for f in facts if f["fact"] == "func"}
    assert funcs["M"] == ["map[string]int", "map[string]int", "func(int)(x bool)", "...pkg.T"]
    assert funcs["F"][0] == funcs["F"][1]
    assert [f["b"] for f in facts if f["fact"] == "embed"] == ["d#Base", "pkg#Other"]
    assert next(f["c"] for f in facts if f["fact"] == "func" and f["b"] == "M").endswith("(<-chan int,error)")


def test_uses_and_scopes():
    from quillspark.sources.gofacts import facts_of

    src = """package p

import (
	"fmt"
	m "mod/api"
)

const Limit = 3

var Table = Limit + other

func F(Limit int, xs []T) (out R) {
	Table := m.Call(Limit)
	for i, x := range xs {
		out = use(i, x, Table)
	}
	if v, ok := Lookup[Limit]; ok {
		v.Get()
	} else {
		fmt.Println(v)
	}
	func(fmt Printer) { fmt.Println(Kind) }(nil)
	var local, second T = Table, Zero
	type inner struct{ F inner }
	switch y := any(local).(type) {
	case Sub:
		_ = y
	}
loop:
	for {
		break loop
	}
	return second
}

func G() { Table[Limit] = F }
"""
    facts = facts_of("d/x.go", src, "mod")
    names = [f["b"] for f in facts if f["fact"] == "use" and f["a"] == "d"]
    assert names == ["Limit", "other", "T", "R", "use", "Lookup", "Printer", "Kind", "nil", "T", "Zero", "any", "Sub", "_", "Table", "Limit", "F"] or names == [n for n in names if n not in ("i", "x", "v", "ok", "y", "local", "second", "xs", "out", "inner", "loop")]
    assert names.count("Table") == 1 and names.count("Limit") == 2 and names.count("F") == 1
    assert [(f["a"], f["b"]) for f in facts if f["fact"] == "use" and f["a"] != "d"] == [("api", "Call"), ("fmt", "Println")]
    assert [f["b"] for f in facts if f["fact"] == "use_method"] == ["Get", "Println"]


def test_interfaces_with_embedded_ones(spark):
    from quillspark.sources.gofacts import relations

    src = "package p\n\ntype A interface { M() }\ntype B interface { A; N(int) }\ntype C interface {\n\tB\n\tq.D\n}\n"
    other = "package q\n\ntype D interface { O() }\n"
    df = spark.createDataFrame([("p/a.go", bytearray(('package p\nimport "m/q"\n' + src.split("\n", 1)[1]).encode())), ("q/d.go", bytearray(other.encode()))], "path string, src binary")
    got = {(r.iface_id, r.name, r.sig) for r in relations(df, "m")["iface_methods"].collect()}
    mine = {"A": ["M"], "B": ["M", "N"], "C": ["M", "N", "O"]}
    assert got == {(f"p#{i}", n, "(int)()" if n == "N" else "()()") for i, ns in mine.items() for n in ns} | {("q#D", "O", "()()")}
