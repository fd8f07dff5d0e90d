import random
import time

import pytest

from corpusward.detectors.js_calls import blanked, rows_of


def calls(source):
    return {(r[2], r[3]): r for r in rows_of(source) if r[0] == "call"}


def test_blanked_keeps_places():
    source = "a('x//y') // c\n/* d( */ b(`t ${f('`')} z`, /[/)(]/g) / 2"
    masked = blanked(source)
    assert len(masked) == len(source) and "c" not in masked and "d(" not in masked and masked.count("(") == 2


def test_calls():
    found = calls("import { exec as run } from 'child_process';\nrun(`ls ${x}`);\nexec('a' + b);\nfoo.bar(a, 'b', { shell: true, n: [1, f(2)] });\nfunction def(x) {}\nclass A { exec(cmd) { return eval(cmd); } }\nif (x) { y(); }")
    assert set(found) == {("run", 2), ("exec", 3), ("foo.bar", 4), ("f", 4), ("eval", 6), ("y", 7)}
    assert found["run", 2][7] and found["run", 2][-1] and not found["exec", 3][-1]
    assert found["foo.bar", 4][12] == {"shell": "true", "n": "[1, f(2)]"}


def test_dynamic_values():
    first = lambda s: [r[6:8] for r in rows_of(f"q({s})")][0]
    assert first("'a'") == ("string", False) and first("`a`") == ("template", False) and first("`a${b}`") == ("template", True)
    assert first("a.b") == ("member", True) and first("a") == ("identifier", True) and first("f(x)") == ("call", True)
    assert first("'a' + 'b'") == ("binary", True) and first("() => 1") == ("other", False) and first("1") == ("other", False)
    assert first("['a', b]") == ("array", True) and first("x ? 'a' : 'b'") == ("other", False)


def test_pairs_assignments_attributes():
    source = "const o = { rejectUnauthorized: false, 'Access-Control-Allow-Origin': '*' };\nel.innerHTML = '<b>';\nel.innerHTML = `<b>${x}`;\n// el.innerHTML = y\nprocess.env.NODE_TLS_REJECT_UNAUTHORIZED = '0';\n<p dangerouslySetInnerHTML={{ __html: v }} />"
    assert [(r[0], r[1], r[3], r[7]) for r in rows_of(source) if r[0] != "call"] == [("pair", "rejectUnauthorized", 1, False), ("pair", "Access-Control-Allow-Origin", 1, False), ("assign", "el.innerHTML", 2, False), ("assign", "el.innerHTML", 3, True), ("assign", "process.env.NODE_TLS_REJECT_UNAUTHORIZED", 5, False), ("jsx", "dangerouslySetInnerHTML", 6, False)]


def test_odd_sources():
    for source in ("", "(", "'open", "`${", "a(", "/", "/* x", "}{)(", "x(" * 2000, "a?.b?.(c)"):
        rows_of(source)


@pytest.mark.parametrize("source", ["x /*" + "a" * 300_000 + "*/ y", "x" + " " * 300_000 + "y", "a." * 150_000, "a" + ".b" * 150_000 + "(", "f<" + "a" * 300_000, "a.innerHTML" * 30_000, "dangerouslySetInnerHTML={{" * 12_000, "import {" * 40_000, "const {" * 40_000, "NODE_TLS_REJECT_UNAUTHORIZED" * 10_000])
def test_time_grows_with_the_length(source):
    began = time.process_time()
    rows_of(source)
    assert time.process_time() - began < 3


def test_owners_and_whole_values():
    called = {r[1]: r for r in rows_of("import { exec } from 'child_process'\nthis.#db.query(`x ${y}`)\nlist = [...exec(cmd)]\nf(1).g(2)\n") if r[0] == "call"}
    assert called["query"][2] == "this.#db.query" and called["exec"][2] == "exec" and called["exec"][-1] and called["g"][2] == ".g"
    said = [r for r in rows_of("<p dangerouslySetInnerHTML={{ __html: f({ a: { b: 1 }}) }} />") if r[0] == "jsx"]
    assert [r[10] for r in said] == ["__html: f({ a: { b: 1 }})"]


class Made:
    """Random sources with what a hand parse gives: for each call its callee, its line, and what its first
    argument is. An expression is (text, kind, is it put together at run time)."""

    def __init__(self, seed):
        self.rng, self.calls, self.rows = random.Random(seed), [], []

    def name(self):
        return self.rng.choice(["a", "b1", "$c", "_d", "of_", "async_", "exec", "query", "newer"])

    def args(self, depth, most=3):
        made = [self.expression(depth - 1) for _ in range(self.rng.randrange(most))]
        return ", ".join(x[0] for x in made), (made[0][1:] if made else ("", False))

    def call(self, depth):
        r = self.rng
        callee = self.name() if r.random() < 0.4 else ".".join([r.choice(["x", "y", "this", "z"]), *(self.name() for _ in range(r.randrange(1, 3)))])
        said, first = self.args(depth)
        self.calls.append((callee, *first))
        return callee.replace(".", r.choice([".", "?.", " . ", ".\n"])) + r.choice(["", "", " ", "<T>", "<A<B>, C[]>", "/* ( */"]) + f"({said})", "call", True

    def operand(self, depth):
        kinds = ["string", "template", "identifier", "member", "number"] + ["call", "paren", "index"] * (depth > 0)
        return getattr(self, self.rng.choice(kinds))(depth)

    def string(self, depth):
        return self.rng.choice(["'a'", '"(b"', "'\\\\'", "'it\\'s `'", '"// no"', "'/*'"]), "string", False

    def template(self, depth):
        if depth <= 0 or self.rng.random() < 0.3:
            return self.rng.choice(["`a`", "``", "`'\\``", "`{(`", "`$ $x`"]), "template", False
        return f"`({self.expression(depth - 1)[0]}".replace("`(", "`b ${", 1) + "} c ${" + self.expression(depth - 1)[0] + "}`", "template", True

    def identifier(self, depth):
        return self.name(), "identifier", True

    def member(self, depth):
        return f"{self.name()}{self.rng.choice(['.', '?.'])}{self.name()}", "member", True

    def number(self, depth):
        return self.rng.choice(["1", "2.5", ".5", "0x1f", "1_000", "true", "null"]), "other", False

    def paren(self, depth):
        return f"({self.expression(depth - 1)[0]})", "other", False

    def index(self, depth):
        return f"{self.name()}[{self.expression(depth - 1)[0]}]", "other", False

    def binary(self, depth):
        parts = [self.operand(depth - 1)[0] for _ in range(self.rng.randrange(2, 4))]
        return f" {self.rng.choice('+ / * - < > && || ?? === % in'.split())} ".join(parts), "binary", True

    def array(self, depth):
        parts = [self.expression(depth - 1) for _ in range(self.rng.randrange(3))]
        return "[" + ", ".join(p[0] for p in parts) + "]", "array", any(p[2] for p in parts if p[1] != "object")

    def object(self, depth):
        return "{ " + ", ".join(self.rng.choice([f"k{k}: {{}}", f"'s-{k}': {{}}", f"[{self.name()}]: {{}}"]).format(self.expression(depth - 1)[0]) if self.rng.random() < 0.7 else self.method(depth) for k in range(self.rng.randrange(3))) + " }", "object", False

    def method(self, depth):
        return f"{self.rng.choice(['', 'async ', 'get '])}{self.name()}() {{ return {self.expression(depth - 1)[0]}; }}"

    def ternary(self, depth):
        return " ".join([self.operand(depth - 1)[0], "?", self.operand(depth - 1)[0], ":", self.operand(depth - 1)[0]]), "other", False

    def arrow(self, depth):
        head = self.rng.choice(["x", "(x)", "({ x, y })", "async (x)", "(x) "]) + " => "
        return head + (self.operand(depth - 1)[0] if self.rng.random() < 0.5 else "{ " + self.statement(depth - 1) + " }"), "other", False

    def function(self, depth):
        return f"function {self.rng.choice(['', 'f'])}(x) {{ {self.statement(depth - 1)} }}", "other", False

    def unary(self, depth):
        return f"{self.rng.choice(['!', '-', 'typeof ', 'await ', 'void '])}{self.operand(depth - 1)[0]}", "other", False

    def new(self, depth):
        return f"new {self.name()}({self.args(depth)[0]})", "other", False

    def regex(self, depth):
        return self.rng.choice(["/a(b/", "/[/)(\"]/g", "/\\//", "/'`/i"]), "other", False

    def tested(self, depth):
        regex, (said, first) = self.regex(depth)[0], self.args(depth)
        self.calls.append((".test", *first))
        return f"{regex}.test({said})", "call", True

    def cast(self, depth):
        return f"{self.operand(depth - 1)[0]} as {self.rng.choice(['string', 'A.B', 'T[]'])}", "other", False

    def markup(self, depth):
        inner = self.rng.choice(["don't ( ", "a < 1 ? ".replace("<", "&lt;"), "{/* ( */}", "it`s "])
        parts = f"<b c='(' d={{{self.expression(depth - 1)[0]}}} />" if self.rng.random() < 0.5 else "<></>"
        return f"<p a={{{self.expression(depth - 1)[0]}}}>{inner}{{{self.expression(depth - 1)[0]}}}{parts}</p>", "other", False

    def expression(self, depth):
        if depth <= 0:
            return self.rng.choice([self.string, self.identifier, self.number, self.member])(0)
        kinds = "call call call binary binary template template array object ternary arrow function unary new regex tested cast markup paren string".split()
        return getattr(self, self.rng.choice(kinds))(depth)

    def statement(self, depth):
        r = self.rng
        kind = r.randrange(9)
        if kind == 0:
            return f"if ({self.expression(depth)[0]}) /x(/.test;"
        if kind == 1:
            return f"const v = {self.expression(depth)[0]};"
        if kind == 2:
            return f"function def({self.name()}) {{ {self.statement(depth - 1) if depth > 0 else ''} }}"
        if kind == 3:
            return f"class K extends L<M> {{ n() {{ return {self.expression(depth - 1)[0]}; }} static async *o(x: A): B {{}} p = {self.expression(depth - 1)[0]}; get(k) {{}} }}"
        if kind == 4:
            said, kind_, dynamic = self.expression(depth)
            self.rows.append(("assign", "el.innerHTML", kind_, dynamic))
            return f"el.innerHTML = {said};"
        if kind == 5:
            self.rows.append(("pair", "rejectUnauthorized", "", False))
            return f"v = {{ m: {self.expression(depth)[0]}, rejectUnauthorized: false }};"
        if kind == 6:
            return f"for (const i of {self.operand(depth)[0]}) {{ {self.expression(depth - 1)[0] if r.random() < 0.0 else ''} }} /y(/g;"
        if kind == 7:
            return f"// it's ( {self.name()}(\nv = {self.name()}++ / 2 / {self.operand(depth)[0]}; /* f( */"
        return f"return {self.expression(depth)[0]};"


@pytest.mark.parametrize("seed", range(400))
def test_nested_sources_against_hand_parses(seed):
    made = Made(seed)
    source = "\n".join(made.statement(3) for _ in range(3))
    rows = rows_of(source)
    assert sorted((r[2], r[6], r[7]) for r in rows if r[0] == "call") == sorted(made.calls), source
    assert sorted((r[0], r[1], r[6], r[7]) for r in rows if r[0] != "call") == sorted(made.rows), source


def test_divisions_types_and_tags():
    called = lambda s: [r[2] for r in rows_of(s) if r[0] == "call"]
    assert called("x = a / f(b) / g(c)") == ["f", "g"] and called("x = (a) / f(1) / 2") == ["f"] and called("if (a) /f(1)/.g") == []
    assert called("return /f(1)/") == [] and called("a[0] / f(1) / 2") == ["f"] and called("x = {} / f(1) / 2") == ["f"] and called("{}\n/f(1)/.g") == []
    assert called("f<A, B<C>>(x)") == ["f"] and called("a < b && c > (d)") == [] and called("const g = <T,>(x: T) => h(x)") == ["h"]
    assert called("<a b='x(1)'>f(1) {g(2)} </a>") == ["g"] and called("x = y < z; f(1)") == ["f"]
    assert called("new Function(x)") == [] and called("new A().run(x)") == [".run"] and called("class A { run(x) { run(x) } }") == ["run"]
    assert called("`a${f(`b${g(1)}`)}`") == ["f", "g"] and called("a?.b?.(c)") == ["a.b"] and called("import('x'); super(y)") == []
    assert [r[6:8] for r in rows_of("q(a\n  + b)")] == [("binary", True)] and [r[10] for r in rows_of("el.outerHTML = a\n  .b\nc()") if r[0] == "assign"] == ["a\n  .b"]


@pytest.mark.parametrize("source", ["<a " * 60_000, "f(" * 60_000, "`${" * 50_000, "a < b " * 60_000, "{" * 100_000, "x = y\n" * 50_000, "[" * 400 + "f(x)" + "]" * 400, "a.innerHTML = b\n" * 20_000, "/" * 100_000])
def test_time_of_odd_sources(source):
    began = time.process_time()
    rows_of(source)
    assert time.process_time() - began < 6
