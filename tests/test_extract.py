import pytest

from knotwork.sources.extract import extract_one


def edges(found, kind=None):
    return [(e["source"], e["target"], e.get("symbol"), e.get("line"), e["confidence"]) for e in found.edges if kind in (None, e["type"])]


def names(found):
    return {n["name"] for n in found.nodes}


def test_python_scopes_and_calls():
    src = "import a.b\nfrom . import x\nif True:\n    import c\n@deco(1)\nasync def f(z=g()):\n    import hidden\n    if g():\n        h(k())\n    def inner():\n        z()\n    print(1)\nclass A(B.C, D[int], metaclass=M):\n    from q import r as s\n    class I:\n        def m(self): return self.x.y()()\n    if 1:\n        def n(self): pass\n"
    f = extract_one("m.py", ".py", src)
    assert [n["id"] for n in f.nodes] == ["file::m.py", "module::a.b", "module::.", "module::c", "function::m.py::f", "class::m.py::A", "module::q", "class::m.py::A.I", "function::m.py::A.I.m", "function::m.py::A.n"]
    calls = edges(f, "calls")
    assert sorted(e[2] for e in calls if e[0] == "function::m.py::f") == ["deco", "g", "g", "h", "k", "z"]
    assert [e[2] for e in calls if e[0] == "function::m.py::A.I.m"] == ["self.x.y"]
    assert [e[2] for e in edges(f, "inherits")] == ["B.C"]
    assert [e[1] for e in edges(f, "has-method")] == ["function::m.py::A.I.m"]
    assert all(e[4] == "INFERRED" for e in edges(f, "calls"))


def test_python_calls_breadth_first():
    f = extract_one("m.py", ".py", "def f():\n    if g():\n        h(k())\n    z()\n")
    assert [e[2] for e in edges(f, "calls")] == ["g", "z", "h", "k"]


@pytest.mark.parametrize("source", ["def f(:", "\ufeffx = 1", "x = 1\x00", "(" * 5000])
def test_python_errors_leave_the_file(source):
    f = extract_one("m.py", ".py", source)
    assert len(f.nodes) == 1 and not f.edges and f.error


def test_javascript():
    f = extract_one("m.ts", ".TS", "import x from 'p';\nconst y = require(\"q\");\nexport {a} from 'r';\n\nfunction f() {}\nconst f = () => 1;\nexport const g = async x => x;\nclass C extends a.B {}\n")
    assert {"p", "q", "r", "f", "g", "C"} <= names(f) and f.nodes[0]["language"] == "typescript"
    assert [n["id"] for n in f.nodes].count("function::m.ts::f") == 1
    assert edges(f, "inherits") == [("class::m.ts::C", "symbol::?::a.B", "a.B", None, "INFERRED")]


def test_match_line_is_where_blank_lines_begin():
    f = extract_one("m.js", ".js", "x;\n\nfunction f() {}")
    assert f.nodes[1]["line"] == 2


def test_go_rust_java_markdown_text():
    go = extract_one("m.go", ".go", 'package m\nimport (\n\t"fmt"\n\t"os"\n)\nfunc Hello() {}\ntype Foo struct {}\n')
    assert {"Hello", "Foo", "fmt", "os"} <= names(go) and {e[3] for e in edges(go, "imports")} == {2}
    rust = extract_one("m.rs", ".rs", "use a::b::{c};\npub fn f() {}\ntrait T {}\n")
    assert {"a::b::", "f", "T"} <= names(rust)
    java = extract_one("M.java", ".java", "import a.B;\npublic class M extends N {\n  public void f() {\n    if (x) { }\n  }\n  private int f(int a) { return 1; }\n}\n")
    assert {"a.B", "M", "f"} <= names(java) and [n["name"] for n in java.nodes].count("f") == 1
    md = extract_one("m.md", ".md", "# T \n[a](b) [m](mailto:x) [h](#y)\n## U\n![i](b)\n")
    assert edges(md, "links") == [("heading::m.md::h2-U", "link::b", None, 2, "EXTRACTED"), ("heading::m.md::h2-U", "link::b", None, 4, "EXTRACTED")]
    assert [n["type"] for n in extract_one("x.txt", ".txt", "# no").nodes] == ["file"]
