import pytest

from knotwork.functions import text
from knotwork.sources import discover
from tests.conftest import write_tree


def test_walk_order_and_skips(tmp_path):
    root = write_tree(tmp_path / "r", {x: "" for x in ("a-b/x.py", "a/x.py", "a.py", ".git/c.py", "node_modules/m.js", ".github/w.yml", ".hidden/h.py", ".dot.py", "z.bin", "_u.py")})
    assert [rel for rel, _ in discover.walk(root)] == [".dot.py", ".github/w.yml", "_u.py", "a/x.py", "a-b/x.py", "a.py"]


def test_ignore_file_negation_and_fallback(tmp_path):
    root = write_tree(tmp_path / "r", {"a.py": "", "b.py": "", ".gitignore": "# c\n*.py\n!a.py\n\n"})
    assert [rel for rel, _ in discover.walk(root)] == ["a.py"]
    write_tree(root, {".knotworkignore": "a.py\n"})
    assert [rel for rel, _ in discover.walk(root)] == ["b.py"]


def test_ignored_directory_is_not_revived(tmp_path):
    root = write_tree(tmp_path / "r", {"d/a.py": "", "b.py": "", ".gitignore": "d/\n!d/a.py\n"})
    assert [rel for rel, _ in discover.walk(root)] == ["b.py"]


def test_link_cycles_and_output_directory(tmp_path):
    root = write_tree(tmp_path / "r", {"d/a.py": "", "out/graph.json": "{}"})
    (root / "d" / "up").symlink_to(root)
    assert [rel for rel, _ in discover.walk(root, frozenset({str(root / "out")}))] == ["d/a.py"]


@pytest.mark.parametrize("path", ["a/b/c.py", "build/", "src/build/x.js", "docs/a.md", "x.tmp.py", "a.b/c", "/", "a"])
def test_native_matching_equals_the_driver(spark, path):
    patterns = ["a/*", "build", "/docs", "/src/b*", "!*.js", "*.tmp.*", "[ab].?", "/", "c.py"]
    row = spark.createDataFrame([(path,)], "p string")
    got = row.select(*[text.matches_pattern(row.p, p.removeprefix("!")) for p in patterns], text.ignored(row.p, patterns)).first()
    assert list(got) == [*(discover.path_matches(path, p.removeprefix("!")) for p in patterns), discover.is_ignored(path, patterns)]


def test_kinds_and_contents(spark, tmp_path):
    root = write_tree(tmp_path / "r", {"__init__.py": "", "A.MD": "x\r\ny\rz"})
    (root / "bad.txt").write_bytes(b"\xff\xfea")
    rows = {r.rel: r for r in discover.with_contents(discover.discover(spark, root)).collect()}
    assert set(rows) == {"__init__.py", "A.MD", "bad.txt"}
    assert rows["A.MD"].content == "x\ny\nz" and rows["A.MD"].kind == "markdown" and rows["A.MD"].suffix == ".md"
    assert rows["bad.txt"].content == "\ufffd\ufffda" and rows["__init__.py"].content == ""
