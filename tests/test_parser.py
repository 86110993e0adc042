import pytest

from knotwork.parser import grammar
from knotwork.parser.grammar import GRAMMARS, extract, syntax_of, valid


def calls(src, grammar="typescript", name=None):
    fs = extract(src, grammar)["functions"]
    return [f["calls"] for f in fs if name is None or f["name"] == name][0]


@pytest.mark.parametrize(
    "body, want",
    [
        ("bar()", ["bar"]),
        ("a.b.c(); x.y()", ["a.b.c", "x.y"]),
        ("new Foo()", ["Foo"]),
        ("new Foo", ["Foo"]),
        ("getUser().save()", ["getUser", "save"]),
        ("a();a();a()", ["a", "a", "a"]),
        ("items.map(i => validate(i))", ["validate", "items.map"]),
        ("function inner(){bar()}; inner()", ["inner"]),
        ("user?.profile?.save()", ["user.profile.save"]),
        ("a[b]()", []),
        ("this.x()", []),
        ("(f)()", []),
        ("f()()", ["f"]),
        ("a[0].b()", []),
        ("new A().b()", ["A"]),
        ("a.b().c.d()", ["a.b", "c.d"]),
        ("tag`x ${g()} y`", ["g", "tag"]),
        ("`x ${g()} y ${h(`${k()}`)}`", ["g", "k", "h"]),
        ("const o = { m() { hidden() }, p: () => seen() }", ["seen"]),
        ("class K { m() { hidden() } f = seen() }", ["seen"]),
        ("const g = function () { seen() }", ["seen"]),
        ("import('x').then(f)", ["then"]),
        ("// no()\n/* no() */ yes('no()')", ["yes"]),
        ("const r = /no()/.test(x)", []),
        ("f<T>(x)", ["f"]),
        ("return a < b ? c() : d()", ["c", "d"]),
    ],
)
def test_calls(body, want):
    assert calls("function foo() {" + body + "}") == want


def test_lambda_wrapped_call():
    assert "writeGraph" in calls("function f(){ db.transaction(() => { writeGraph() })() }")


def test_functions_and_lines():
    src = "export default function a(x = no()) {\n b()\n}\nconst p = 1,\n  q = async () => c(),\n  r = function () { d() };\nexport const s = <T,>(x: T) => x;\nconst t = wrap(() => e());\nclass C { m() {} }\nfunction over(a: string): void;\nfunction over(a: any) {}\n"
    got = extract(src, "typescript")
    assert [(f["name"], f["start_line"], f["end_line"], f["calls"]) for f in got["functions"]] == [
        ("a", 1, 3, ["b"]),
        ("q", 5, 5, ["c"]),
        ("r", 6, 6, ["d"]),
        ("s", 7, 7, []),
        ("over", 11, 11, []),
    ]
    assert not got["had_parse_errors"]


def test_first_definition_wins():
    got = extract("function foo(){a()}\nfunction foo(){b()}\nfunction foo(){c()}", "javascript")
    assert [f["calls"] for f in got["functions"]] == [["a"]]
    assert got["duplicate_function_names"] == ["foo", "foo"]


def test_imports():
    got = extract("import X, {a, b as c} from './c'\nimport * as N from \"m\"\nimport type {T} from 't'\nimport {type U, V} from 'u'\nimport 'side'", "typescript")["imports"]
    assert [(i["local_name"], i["imported_name"], i["module_specifier"], i["is_default"], i["is_namespace"]) for i in got] == [
        ("X", "default", "./c", True, False),
        ("a", "a", "./c", False, False),
        ("c", "b", "./c", False, False),
        ("N", "*", "m", False, True),
        ("V", "V", "u", False, False),
    ]


def test_tsx_component():
    assert calls("function App(){ useEffect(); return <div onClick={() => go()}>{xs.map(x => <Li {...x}>it's {f(x)}</Li>)}</div> }", "tsx") == ["useEffect", "go", "f", "xs.map"]


def test_broken_source_keeps_what_stood_before():
    got = extract("function ok(){a()}\nfunction broken( {", "typescript")
    assert got["had_parse_errors"]
    assert isinstance(got["functions"], list) and isinstance(got["imports"], list)


@pytest.mark.parametrize(
    "src, names, modules",
    [
        ("import a from './a'\nfunction ok() {\n a()\n}\nconst p = () => b()\nfunction cut() {\n if (x) {\n", ["ok", "p"], ["./a"]),  # cut off
        ("function ok() { a() }\nfunction broken( {", ["ok"], []),
        ("function ok() { a() }\n}\nimport b from './b'\nfunction more() { b() }", ["ok", "more"], ["./b"]),  # closes nothing
        ("function ok() { a() }\nfunction bad() {\n f(1\n}\nfunction more() { b() }\n", ["ok", "more"], []),  # unclosed within
        ("function ok() { a() }\n<<<<<<< HEAD\nfunction l() {}\n=======\nfunction r() {}\n>>>>>>> x\nfunction more() {}", ["ok", "l", "r", "more"], []),
        ("function ok() {}\nlet t: (a: (b\n", ["ok"], []),
        ("function ok() {}\nlet t = `a ${b(", ["ok"], []),
    ],
)
def test_errors_keep_sound_statements(src, names, modules):
    got = extract(src, "typescript")
    assert got["had_parse_errors"]
    assert [f["name"] for f in got["functions"]] == names
    assert [i["module_specifier"] for i in got["imports"]] == modules


VALID = {
    "javascript": [
        "", "// only", "/* x */\n", "﻿const a = 1", "#!/usr/bin/env node\nlet a", "let a = 1\nlet b = a\n++b", "for (const [a, b] of c) d(a)", "for (let i = 0, n = 3; i < n; i++);",
        "a = b ? (c) : d", "x = a / b / c", "x = /[/]\\/'\"`/g.test(y)", "label: for (;;) { break label }", "async function* g() { yield* h(); await x; for await (const y of z) {} }",
        "({ a, b: { c = 1 } = {}, ...rest } = d)", "const { a = 1, ...b } = c", "class A extends (B) { static #p = 1; get x() { return this.#p } static { f() } async *g() {} 'q'() {} [k] = 2 }",
        "if (a) b\nelse c", "do x(); while (y) z()", "try { a } catch { b } finally { c }", "switch (a) { case 1: case 2: b; break; default: c }", "a ??= b?.c?.[d]?.(e) ?? f", "var āb = '\\u{1F600}', \\u0061 = 1_000n",
        "x = `a ${`b ${c}`} }`", "export { a as default, b } from 'c'; export * as d from 'e'; import f, * as g from 'h'", "a = function () {}\n(b)", "let async; async = of => of", "x = a\n/* c */ / b", "let s = 'a\\\nb'", "new.target", "y = x ** -z",
        "return_ = () => ({}).x", "a = b\n`t`", "while (a) if (b) continue; else break", "import d from './d.json' with { type: 'json' }", "x = a >> 1 >>> 2 >= 3; x >>= 1; x >>>= 2", "const get = 1, set = 2, type = 3; type = get", "if (x) { } else if (y) { } else { }",
    ],
    "typescript": [
        "type A<T> = T extends (infer U)[] ? U : never", "interface I extends J<K> { readonly a?: string; [k: string]: unknown; m<T>(x: T): void; new (x: number): I; get g(): string }",
        "enum E { A = 1 << 2, B = 'x' }", "const enum F { A }", "declare module 'm' { export const x: number; export function f(): void }", "namespace N.M { export const a = 1 }", "abstract class A<T> implements B, C { constructor(private readonly x: string, public y?: number) { super() } abstract m(): void; declare z: string; protected static override q!: T }",
        "function f(this: Foo, a?: string, ...r: number[]): asserts a is string { }", "let x = y as unknown as Map<string, Array<number>>", "const z = <T>(a: T): T => a", "let q = <string>w", "f<string>(a)!.b!", "x satisfies Y<Z>", "type M = { readonly [K in keyof T]?: T[K] }", "type Fn = new (...a: any[]) => void", "let t: [a: string, b?: number, ...c: boolean[]]",
        "export type { A } from 'b'; import type B from 'c'; import { type C, D } from 'd'; export = x", "type L = `a${string}b` | -1 | typeof import('x')", "@dec() class K { @inp() p: string; m(@arg a: number) {} }", "let o = a ? (b) : c", "let g: Array<Array<number>>= []", "function over(a: string): void\nfunction over(a: any) {}", "type P = A | B\n  | C", "let u: unique symbol; let k: keyof typeof v", "for (const x of <any[]>y) {}",
        "export default abstract class Q {}", "declare global { interface Window { a: string } }", "const a = async <T,>(x: T) => { await x }", "let v = a < b && c > d", "type C2 = A extends B ? C : D extends E ? F : G", "let opt = a?.b!.c", "accessor = 1",
    ],
    "jsx": ["x = <a b='c' {...d}>text {e} <f.g /> it's</a>", "y = <>a</>", "z = a < b", "w = cond ? <A /> : <B>{/* c */}</B>", "v = <a-b c:d={<e />} />"],
    "tsx": ["const a = <T,>(x: T) => <A<T> b={x as any}>{x}</A>", "let b: string = <c/>"],
}
INVALID = {
    "javascript": [
        "function f( {", "let a = 'x", "x = `a ${b", "/* never", "a b", "if (a", "const x;", "let x: string = 1", "interface A { b: c }", "x = <a />", "1 = 2", "f() = 3", "for (;;", "class {", "import a", "return 1", "break", "x = {a b}", "<<<<<<< HEAD\na", "=======", "import { a } from", "x = a ? b", "((a)", "var 1a", "x = y!", "{\"a\": 1, \"b\": 2}", "def f(x):\n    return 1", "SELECT a FROM b", "try { a }", "throw\na", "a?.b = 1", "x = /a", "let a = 08n", "# Title\n", "type A = string", "x as any", "export { a } b", "enum A { B }", "() + 1 => 2", "a => {} ()",
    ],
    "typescript": ["let x: = 1", "type A =", "x = <div>it's</div>", "interface A { b c }", "function f(a: ) {}", "enum E { A B }", "let a: Array<string", "class A { constructor(private) }}"],
    "jsx": ["x = <a></b>", "x = <a>", "x = <a b=c />", "x = <a>}</a>", "let y: string"],
    "tsx": ["let q = <string>w", "x = <a"],
}


@pytest.mark.parametrize("grammar, src", [(g, s) for g, ss in VALID.items() for s in ss])
def test_valid(grammar, src):
    assert valid(src, grammar), src
    assert valid(src, grammar)  # again, from the memory of shapes
    assert syntax_of(src, grammar)[0]


@pytest.mark.parametrize("grammar, src", [(g, s) for g, ss in INVALID.items() for s in ss])
def test_invalid(grammar, src):
    assert not valid(src, grammar), src
    assert not syntax_of(src, grammar)[0]


def test_foreign_grammars():
    assert syntax_of("let a: string = 'x'", "javascript") == (False, ["typescript", "tsx"])
    assert syntax_of("x = <a>it's</a>", "typescript") == (False, ["tsx", "jsx"])
    assert syntax_of("let a = 1", "tsx") == (True, list(GRAMMARS))
    assert syntax_of("a b", "tsx") == (False, [])


def test_deep_and_long_texts():
    assert valid("x = " + "(" * 400 + "1" + ")" * 400, "javascript") in (True, False)
    assert valid("a();\n" * 200_000, "javascript")


N = 400
DEEP = {
    "brackets": "x = " + "(" * N + "1" + ")" * N,
    "literals": "x = " + "[{ a: " * N + "1" + "}]" * N,
    "else-if": "if (a) b()\n" + "else if (a) b()\n" * N,
    "ternary": "x = " + "a ? b : " * N + "c",
    "blocks": "{" * N + "}" * N,
    "functions": "x = " + "(a) => { return " * N + "1" + "}" * N,
    "templates": "x = " + "`${" * N + "1" + "}`" * N,
}


@pytest.mark.parametrize("deep", DEEP.values(), ids=DEEP)
def test_deep_texts_are_parsed(deep):
    assert syntax_of(deep, "javascript") == (True, list(GRAMMARS))
    for fault in ("a b", "<<<<<<< HEAD", "x = (1 2)"):
        assert not valid(f"{deep}\n{fault}\n", "javascript")
        assert syntax_of(f"{deep}\n{fault}\n", "javascript") == (False, [])
    assert syntax_of(f"{deep}\nlet y: string = z", "javascript") == (False, ["typescript", "tsx"])
    got = extract(f"{deep}\nfunction f() {{ g() }}", "typescript")
    assert [f["name"] for f in got["functions"]] == ["f"] and not got["had_parse_errors"]


def test_deep_types_and_elements():
    deep = "type A = " + "Array<[" * N + "B" + "]>" * N
    assert syntax_of(deep, "javascript") == (False, ["typescript", "tsx"])
    assert not valid(deep + "\na b", "typescript")
    deep = "x = " + "<a>{" * N + "1" + "}</a>" * N
    assert syntax_of(deep, "javascript") == (False, ["tsx", "jsx"])
    assert syntax_of(deep + "\na b", "jsx") == (False, [])
    assert valid("x = " + "(" * 20_000 + "1" + ")" * 20_000, "typescript")


REGEX_OR_DIVISION = [
    ("function f(x){ if (x) /ab+/.test(x); }", True),
    ("function f(){ return 1 }\n/ab+/.test('x')", True),
    ("let a = (b) / 2 / c; let d = {a: 1}.a / 3 / 4", True),
    ("while (q) /x/g.exec(q)", True),
    ("for await (const a of b) /x\\//.test(a)", True),
    ("a.if(x) / 2 / 3", True),
    ("const o = { a: { b: 1 } } / 2 / 3", True),
    ("x = y ? {a: 1} / 2 : {b: 2} / 3 / 1", True),
    ("switch (a) { case 1: { b() }\n/x'/.test(c) }", True),
    ("x = `a${ {b: 1}.b / 2 / 1 }`", True),
    (r"x = /(?<a>b)(?:c)(?=d)[(]\(/u; y = /^(?:a|b)*?(?!x)+$/", True),
    ("let a = /(/;", False),
    ("let a = /a)/;", False),
    ("let a = /+a/;", False),
    ("if (a) {} /re(/.test(x)", False),
]


@pytest.mark.parametrize("src, want", REGEX_OR_DIVISION)
def test_regular_expression_or_division(src, want):
    assert valid(src, "javascript") is want


def test_memory_of_shapes_is_bounded(monkeypatch):
    monkeypatch.setattr(grammar, "MEMORY", 5)
    monkeypatch.setattr(grammar, "LONGEST", 12)
    for i in range(40):
        assert valid("x = `${" + "a+" * i + "1}`; y = z" + "+ 1" * i, "javascript")
    assert len(grammar._seen) <= 5 and max(len(k[2]) for k in grammar._seen) <= 14
