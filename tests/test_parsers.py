"""The eleven parsers on hand-written sources."""

import pytest

from lodestone.parsers import LANGUAGES, parse


def symbols(source, lang):
    return [(s["kind"], s["name"]) for s in parse(source, lang)["symbols"]]


def imports(source, lang):
    return [(i["source"], i["names"]) for i in parse(source, lang)["imports"]]


def exports(source, lang):
    return [e["name"] for e in parse(source, lang)["exports"]]


def one(source, lang, name):
    return next(s for s in parse(source, lang)["symbols"] if s["name"] == name)


@pytest.mark.parametrize("lang", LANGUAGES)
@pytest.mark.parametrize("source", [None, "", " \n\n", "{{{((", "}}}])", '"', "'''", "/*", "class", "import {", "`${`${", "\0\n\ud83d", "def f(:\n  x", "é" * 50])
def test_odd_sources_yield_no_error(lang, source):
    found = parse(source, lang)
    assert found["error"] is None and isinstance(found["symbols"], list)


def test_unknown_language_yields_nothing():
    assert parse("class A {}", "cobol") == {"imports": [], "exports": [], "symbols": [], "error": None}


TS = """import Lib, { one, two as deux, type Three } from './lib';
import * as all from "../all"; import type { T } from './types'
// import { no } from 'comment';
const text = "import { no } from 'text'", pattern = /['"`{]/g, made = `a ${ call({ a: 1 }) } '`;
import './effect'
export * from './star'; export * as ns from './ns'; export { A, B as C } from './b';
export default class Shop extends Base<T> implements Open, Close<K> {
  private stock: Map<string, number> = new Map();
  constructor(private name: string) { super(); }
  async sell(r: R): Promise<{ a: number }> { if (x) { return y(); } }
  get size() { return 1 }
}
export abstract class Shape { abstract area(): number; draw() {} }
export interface Wide extends Narrow, Other { id: number }
type State = 'on' | 'off';
export const { p, q: r } = o, MAX = 3;
enum Level { Low }
export async function run(a: { x: number } = { x: 1 }): Promise<void> { function inner() {} }
const quiet = function named() {}
const lazy = () => import('./lazy')
"""


def test_typescript():
    assert imports(TS, "typescript") == [("./lib", ["Lib", "one", "deux", "Three"]), ("../all", ["all"]), ("./types", ["T"]), ("./effect", []), ("./lazy", [])]
    flags = {i["source"]: i for i in parse(TS, "typescript")["imports"]}
    assert flags["./lib"]["is_default"] and flags["../all"]["is_namespace"] and flags["./types"]["is_type_only"] and flags["./lazy"]["is_dynamic"]
    assert exports(TS, "typescript") == ["*", "ns", "A", "C", "Shop", "Shape", "Wide", "p", "r", "MAX", "run"]
    re_exported = [e["name"] for e in parse(TS, "typescript")["exports"] if e["is_re_export"]]
    assert re_exported == ["*", "ns", "A", "C"]
    assert symbols(TS, "typescript") == [
        ("function", "run"), ("function", "inner"), ("class", "Shop"), ("method", "Shop.constructor"), ("method", "Shop.sell"), ("method", "Shop.size"),
        ("class", "Shape"), ("method", "Shape.draw"), ("method", "Shape.area"), ("interface", "Wide"), ("type", "State"), ("enum", "Level"),
        ("variable", "text"), ("variable", "pattern"), ("variable", "made"), ("variable", "MAX"), ("variable", "quiet"), ("variable", "lazy"),
    ]
    shop = one(TS, "typescript", "Shop")
    assert (shop["extends"], shop["implements"], shop["start_line"], shop["end_line"]) == ("Base", ["Open", "Close<K>"], 7, 12)


def test_signature_is_the_first_line_cut_at_200():
    assert one("function f(" + "a" * 300 + ") {}", "typescript", "f")["signature"] == "function f(" + "a" * 189 + "..."


def test_javascript_requires_and_exports():
    source = "const a = require('./a');\nconst { b, c: d } = require('./b');\nimport e from './e'; const e2 = require('./e');\nmodule.exports = { f, g: 1 };\nexports.h = 2;"
    assert imports(source, "javascript") == [("./e", ["e"]), ("./a", ["a"]), ("./b", ["b", "d"])]
    assert exports(source, "javascript") == ["f", "g", "h"]


def test_python():
    source = 'import a.b as c, os\nfrom ..x import y as z\nfrom .m import *\n@dec\nclass C(A, B[int], metaclass=M):\n    def m(self): pass\n    class In: pass\ndef _f(): pass\nx, y = 1, 2\nif 1:\n    def hidden(): pass\n'
    assert imports(source, "python") == [("a.b", ["c"]), ("os", ["os"]), ("..x", ["z"]), (".m", [])]
    assert symbols(source, "python") == [("class", "C"), ("method", "C.m"), ("function", "_f"), ("variable", "x"), ("variable", "y")]
    assert exports(source, "python") == ["C", "x", "y"]
    c = one(source, "python", "C")
    assert (c["extends"], c["implements"], c["start_line"], c["start_col"]) == ("A", ["B"], 4, 1)
    assert exports('__all__ = ["f"]\ndef f(): pass\ndef g(): pass', "python") == ["f"]


def test_python_that_does_not_parse_is_read_by_lines():
    source = "print 'old'\nimport os.path as p\nclass A(B, C):\n    def m(self):\n        return 1\n\n    def n(self): pass\nx = 1\n"
    assert symbols(source, "python") == [("class", "A"), ("method", "A.m"), ("method", "A.n"), ("variable", "x")]
    assert imports(source, "python") == [("os.path", ["p"])] and one(source, "python", "A")["end_line"] == 7


def test_go():
    source = 'package m\nimport (\n\t"fmt"\n\tx "a/b"\n)\nimport . "dot"\nimport _ "blank"\ntype Admin struct {\n\tUser\n\tn int\n}\ntype S interface { Start() error }\ntype ID int\nfunc (s *Service) Start() (int, error) {\n\treturn nil\n}\nfunc low() map[string]struct{} { return nil }\nconst (\n\tA = iota\n\tb\n)\nvar D, e *User\n'
    assert imports(source, "go") == [("fmt", ["fmt"]), ("a/b", ["x"]), ("dot", []), ("blank", ["_"])]
    assert symbols(source, "go") == [("struct", "Admin"), ("interface", "S"), ("type", "ID"), ("method", "Service.Start"), ("function", "low"), ("constant", "A"), ("constant", "b"), ("variable", "D"), ("variable", "e")]
    assert exports(source, "go") == ["Admin", "S", "ID", "Service.Start", "A", "D"]
    assert one(source, "go", "Admin")["extends"] == "User" and one(source, "go", "low")["end_line"] == 17


def test_rust():
    source = "use std::io::{Read, Write as W};\nuse std::fmt::*;\n#[derive(Debug)]\npub struct User<T> { t: T }\npub enum E { A }\npub trait Repo { fn save(&self); }\nimpl<T: Clone> Display for User<T> { fn fmt(&self) -> R { write!(f, \"{}\", 'a') } }\nimpl User { pub fn new() -> Self { Self {} } fn p<'a>(&'a self) {} }\npub const X: [u8; 2] = [1, 2]; static Y: i32 = 1; pub fn go() {}\n"
    assert imports(source, "rust") == [("std::io", ["Read"]), ("std::io", ["Write"]), ("std::fmt", [])]
    assert symbols(source, "rust") == [("struct", "User"), ("enum", "E"), ("trait", "Repo"), ("method", "User.fmt"), ("method", "User.new"), ("method", "User.p"), ("constant", "X"), ("variable", "Y"), ("function", "go")]
    assert exports(source, "rust") == ["User", "E", "Repo", "User.new", "X", "go"]
    assert one(source, "rust", "User")["implements"] == ["Display"] == one(source, "rust", "User.fmt")["implements"]


def test_php():
    source = "<p>class Not {}</p><?php\nnamespace App\\Http;\nuse App\\Models\\User as U; use A\\{B, C};\nrequire_once './y.php';\n# class Fake {}\nfinal class Ctl extends Base implements I, J { public function __construct($a = []) {} private static function v(): array { return []; } }\ninterface Z extends Y {} trait TT { function t() {} } enum Suit: string { case A = 'a'; }\nfunction calc($i) { return 1; } const LIM = 3;\n"
    assert imports(source, "php") == [("App\\Models", ["User"]), ("A", ["B", "C"]), ("./y.php", [])]
    assert symbols(source, "php") == [("namespace", "App\\Http"), ("class", "Ctl"), ("method", "Ctl.__construct"), ("method", "Ctl.v"), ("interface", "Z"), ("trait", "TT"), ("method", "TT.t"), ("enum", "Suit"), ("function", "calc"), ("constant", "LIM")]
    assert (one(source, "php", "Ctl")["extends"], one(source, "php", "Ctl")["implements"], one(source, "php", "Z")["extends"]) == ("Base", ["I", "J"], "Y")


def test_java():
    source = 'import java.util.List;\nimport java.util.*;\nimport static java.lang.Math.PI;\n@Service("x") public class My<T> extends Base<T> implements IFoo, IBar<Q> {\n  private final Map<String, Integer> m = new HashMap<>(), n;\n  public My() {}\n  @Override public <R> List<R> go(int a) throws E { return null; }\n  interface In { void f(); }\n  enum Co { A, B; int q() { return 1; } }\n}\nrecord P(int x) implements S {}\nclass Pk {}'
    assert imports(source, "java") == [("java.util", ["List"]), ("java.util", []), ("java.lang.Math", ["PI"])]
    assert [i["is_type_only"] for i in parse(source, "java")["imports"]] == [True, True, False]
    assert symbols(source, "java") == [("class", "My"), ("variable", "My.m"), ("variable", "My.n"), ("method", "My.My"), ("method", "My.go"), ("interface", "In"), ("method", "In.f"), ("enum", "Co"), ("method", "Co.q"), ("class", "P"), ("class", "Pk")]
    assert exports(source, "java") == ["My"] and one(source, "java", "My")["implements"] == ["IFoo", "IBar"]


def test_ruby():
    source = "require 'json'\nrequire_relative 'lib/helper'\nload \"a/b.rb\"\nmodule App\n  LIM = 1\n  class User < Base::Record\n    attr_accessor :name, :mail\n    def initialize(n); @n = n if n; end\n    def self.version\n      [1].each do |x| puts x end\n      while true do x end\n      y = if a then b else c end\n    end\n    def sq(x) = x * x\n  end\nend\ndef top; end\n"
    assert imports(source, "ruby") == [("json", ["json"]), ("./lib/helper", ["helper"]), ("a/b.rb", ["b.rb"])]
    assert symbols(source, "ruby") == [("module", "App"), ("constant", "LIM"), ("class", "User"), ("property", "User.name"), ("property", "User.mail"), ("method", "User.initialize"), ("method", "User.version"), ("method", "User.sq"), ("function", "top")]
    assert exports(source, "ruby") == ["App", "top"] and "Base::Record" in one(source, "ruby", "User")["extends"]


def test_c():
    source = '#include <stdio.h>\n#include "a/my.h"\n#define PI 3\n#define MAX(a, b) ((a) > (b) ? \\\n (a) : (b))\nstatic int add(int a) { return a; }\nvoid greet(void); char *dup(const char *s);\nstruct P { int x; }; typedef struct { int a; } Q; enum E { A } e1; int g = 3, arr[2] = {1, 2};\n'
    assert imports(source, "c") == [("stdio.h", ["stdio"]), ("a/my.h", ["my"])]
    assert symbols(source, "c") == [("constant", "PI"), ("function", "MAX"), ("function", "add"), ("function", "greet"), ("function", "dup"), ("struct", "P"), ("type", "Q"), ("enum", "E"), ("variable", "e1"), ("variable", "g"), ("variable", "arr")]
    assert "add" not in exports(source, "c")


def test_c_conditionals_hide_but_a_guard_does_not():
    source = "#ifndef A_H\n#define A_H\nint a(void);\n#ifdef X\nint hidden(void);\n#if Y\nint deeper(void);\n#endif\n#endif\nint b(void);\n#endif\n"
    assert symbols(source, "c") == [("constant", "A_H"), ("function", "a"), ("function", "b")]


def test_cpp():
    source = '#include <vector>\nclass Base { public: virtual void foo() = 0; };\nclass Derived : public Base, public ILog<int> { public: void foo() override {} struct In { void q() {} }; };\nnamespace Math { int add(int a) { return a; } }\ntemplate<typename T> class Box { public: T value; };\nenum class Color { Red };\nusing S = std::string; static int hid = 1;\nint Derived::bar(int x) const { return 1; }\nextern "C" { void cfun(); }\n'
    assert symbols(source, "cpp") == [("class", "Base"), ("class", "Derived"), ("method", "Derived::foo"), ("struct", "Derived::In"), ("method", "Derived::In::q"), ("namespace", "Math"), ("function", "add"), ("class", "Box"), ("enum", "Color"), ("type", "S"), ("variable", "hid"), ("method", "Derived::bar"), ("function", "cfun")]
    assert "hid" not in exports(source, "cpp") and (one(source, "cpp", "Derived")["extends"], one(source, "cpp", "Derived")["implements"]) == ("Base", ["ILog"])


def test_csharp():
    source = 'using System; using static System.Math; using Text = System.Text.Builder;\nnamespace App {\n [Attr] public class User : Base<T>, IDisposable where T : new() {\n  public string Name { get; set; } = "x"; public int Age => 3; public readonly string Id; private int a = 1, b;\n  public User(int x) : base(x) {} public async Task<List<int>> Go<T>(int a) { return 1; }\n }\n public interface ILog { void Log(string m); } public enum St { A } public record Pt(int X); public delegate void D(int a);\n}'
    assert imports(source, "csharp") == [("System", ["System"]), ("System.Math", ["Math"]), ("Text", ["Text"])]
    assert symbols(source, "csharp") == [("namespace", "App"), ("class", "User"), ("property", "User.Name"), ("property", "User.Age"), ("variable", "User.Id"), ("variable", "User.a"), ("variable", "User.b"), ("method", "User.User"), ("method", "User.Go"), ("interface", "ILog"), ("method", "ILog.Log"), ("enum", "St"), ("class", "Pt"), ("type", "D")]
    assert exports(source, "csharp") == ["User", "User.Name", "User.Age", "User.Id", "User.User", "User.Go", "ILog", "St", "Pt", "D"]
