"""Captures, manifests, Python facts and incremental admission on small trees of our own."""

from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from tessellar.operators import diff
from tessellar.functions import predicates
from tessellar.plans.project import analyse, review
from tessellar.sources import manifests, python_facts, revision, worktree
from tessellar.streaming import incremental

TREE = {
    "pyproject.toml": '[project]\nname = "shop"\nversion = "1"\ndependencies = ["tool>=2; python_version > \'3\'", "# no"]\n[project.optional-dependencies]\nx = ["extra"]\n',
    "libs/tool/pyproject.toml": '[project]\nname = "tool"\n',
    "requirements.txt": "-r other.txt\nabc==1 # why\n",
    "src/shop/__init__.py": "",
    "src/shop/cart.py": "from .price import total as sum_up\nimport os\n\nclass Cart(Base):\n    size: int = 0\n\n    def add(self, x):\n        self.items = x\n        return sum_up(x)\n\n\ndef é():\n    return helper() + os.getcwd()\n\n\ndef helper():\n    return 1\n",
    "src/shop/price.py": "def total(x):\n    return x\n\n\nif True:\n    def maybe():\n        pass\n\n\ndef use():\n    return maybe()\n",
    "src/shop/broken.py": "def (",
    "node_modules/x.py": "pass",
    ".hidden/y.py": "pass",
    "notes.txt": "no",
    "bad.md": b"\xff\xfe",
}


@pytest.fixture
def tree(tmp_path):
    for name, content in TREE.items():
        path = tmp_path / "t" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return tmp_path / "t"


def test_capture(spark, tree):
    files, wrong = worktree.capture(spark, str(tree), ["libs/*"])
    assert {r.path for r in files.collect()} == {"pyproject.toml", "requirements.txt", *(p for p in TREE if p.startswith("src/"))}
    assert [tuple(r) for r in wrong.collect()] == [("invalid_utf8", "bad.md")]
    one = worktree.content_id(files, "r").first()[0]
    assert one == worktree.content_id(files.repartition(5), "r").first()[0] != worktree.content_id(files, "s").first()[0]


def test_facts(spark, tree):
    snap = analyse(spark, str(tree))
    nodes = {r.qualified: r for r in snap.nodes.collect()}
    assert nodes["shop.cart.Cart.add"].kind == "function" and nodes["shop.cart.Cart.size"].kind == "field"
    where = nodes["shop.cart.é"]
    assert TREE["src/shop/cart.py"].encode()[where.start : where.end].decode().startswith("def é")
    assert not nodes["shop.price.maybe"].plain
    names = {r.id: r.qualified for r in nodes.values()}
    calls = {(names[r.source], r.target_name): names.get(r.target) for r in snap.edges.where("kind = 'calls'").collect()}
    assert calls == {("shop.cart.Cart.add", "sum_up"): "shop.price.total", ("shop.cart.é", "helper"): "shop.cart.helper", ("shop.cart.é", "os.getcwd"): None, ("shop.price.use", "maybe"): None}
    assert {(r.kind, r.target_name) for r in snap.edges.where("kind in ('extends', 'writes', 'type_usage')").collect()} == {("extends", "Base"), ("writes", "self.items"), ("type_usage", "int")}
    assert any("parse_error" in r.code for r in snap.diagnostics.collect())
    assert snap.stats().first().resolved_calls == 2


def test_reuse_and_review(spark, tree):
    first = analyse(spark, str(tree))
    (tree / "src/shop/price.py").write_text("def total(x, y):\n    return x\n")
    second = analyse(spark, str(tree), first)
    assert incremental.misses(second.files, first.files).count() == 1
    assert {r.path for r in worktree.changed_paths(first.files, second.files).collect()} == {"src/shop/price.py"}
    kinds = "kind in ('function', 'type', 'field')"
    changed = {(r.stable_key, r.state) for r in diff.multiset_diff(first.nodes.where(kinds), second.nodes.where(kinds), "stable_key", ["fingerprint"]).collect()}
    names = {r.stable_key: r.qualified for s in (first, second) for r in s.nodes.collect()}
    assert {(names[k], s) for k, s in changed} == {("shop.price.total", "modified"), ("shop.price.maybe", "removed"), ("shop.price.use", "removed")}


def test_review(spark, tree):
    first = analyse(spark, str(tree))
    (tree / "src/shop/price.py").write_text("def total(x, y):\n    return x\n")
    (tree / "src/shop/cart.py").write_text(TREE["src/shop/cart.py"].replace("return 1", "return 2"))
    found = review(first, analyse(spark, str(tree), first))
    got = [(r.qualified, r.state, r.reason, r.priority) for r in found["changes"].collect()]
    assert got == [
        ("shop.price.maybe", "removed", "definition removed", 3), ("shop.price.total", "modified", "signature changed", 3),
        ("shop.price.use", "removed", "definition removed", 3), ("shop.cart.helper", "modified", "implementation changed", 1),
    ]
    names = {r.id: r.qualified for r in first.nodes.collect()}
    callers = {(names.get(r.target), names.get(r.caller)) for r in found["callers"].collect()}
    assert {("shop.price.total", "shop.cart.Cart.add"), ("shop.cart.helper", "shop.cart.é")} <= callers
    files = {r.path: r.diff for r in found["files"].collect()}
    assert "-    return 1" in files["src/shop/cart.py"] and "+    return 2" in files["src/shop/cart.py"]


def test_targets_and_components(spark):
    paths = ["Cargo.toml", "src/lib.rs", "src/bin/run.rs", "tests/it.rs", "sub/Cargo.toml", "sub/src/main.rs", "sub/build.rs", "sub/benches/b/main.rs", "src/x/y.rs"]
    files = spark.createDataFrame([(p, '[package]\nname = "top"' if p == "Cargo.toml" else '[package]\nname = "sub"' if p.endswith("toml") else "") for p in paths], "path string, content string")
    got = {tuple(r)[:3] for r in manifests.targets(files, manifests.manifests(files)).collect()}
    assert got == {("top", "lib", "top"), ("top", "bin", "run"), ("top", "test", "it"), ("sub", "bin", "sub"), ("sub", "build", "build"), ("sub", "bench", "b")}
    rows = [("a/src/lib.rs", "a"), ("a/src/io/x.rs", "a"), ("a/tests/t.rs", "a"), ("pkg/mod.py", ""), ("src/util.py", "")]
    named = spark.createDataFrame(rows, "path string, root string").select("path", predicates.component(F.col("path"), F.col("root")).alias("c"))
    assert {r.path: r.c for r in named.collect()} == {"a/src/lib.rs": "core", "a/src/io/x.rs": "io", "a/tests/t.rs": "tests", "pkg/mod.py": "pkg", "src/util.py": "util"}


def test_manifests(spark, tree):
    files, _ = worktree.capture(spark, str(tree))
    found = manifests.manifests(files)
    rows = {(r.package, r.alias, r.kind, r.condition) for r in found.collect()}
    assert {("shop", "tool", "normal", "python_version > '3'"), ("shop", "extra", "optional:x", None), (None, "abc", "requirements", None), ("tool", None, "package", None)} <= rows
    assert {(r.source, r.target) for r in manifests.internal_relations(found).collect()} == {("shop", "tool")}
    assert {r.path: r.package for r in manifests.package_of(files, found).collect()}["libs/tool/pyproject.toml"] == "tool"


def test_cargo_manifest():
    text = '[package]\nname = "a"\n[dependencies]\nb = { workspace = true }\nc = "1"\n[workspace.dependencies]\nb = { package = "bee", path = "../b" }\n[target."cfg(unix)".dev-dependencies]\nd = { version = "1", optional = true }\n'
    assert manifests.declared("Cargo.toml", text)[1:] == [("a", None, "b", "bee", "normal", None, False, "../b"), ("a", None, "c", "c", "normal", None, False, None), ("a", None, "d", "d", "dev", "cfg(unix)", True, None)]
    assert manifests.declared("Cargo.toml", "[")[0][4] == "invalid_manifest"


def test_revision(spark, tree):
    run = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@t.t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "x")
    got = {r.path: r.content for r in revision.capture_revision(spark, str(tree)).collect()}
    assert got["src/shop/cart.py"] == TREE["src/shop/cart.py"] and "notes.txt" not in got and "bad.md" not in got


def test_stream(spark, tmp_path):
    root, cache = str(tmp_path / "in"), "seen_files"
    spark.sql(f"drop table if exists {cache}")
    for part in ([("a.py", "1"), ("a.py", "1"), ("x.bin", "0")], [("a.py", "1"), ("a.py", "2")]):
        spark.createDataFrame(part, "path string, content string").coalesce(1).write.mode("append").parquet(root)
        incremental.fold_into(incremental.arrivals(spark, root), cache, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.path, r.content) for r in spark.table(cache).select("path", "content", F.lit(1)).collect()) == [("a.py", "1"), ("a.py", "2")]
    spark.sql(f"drop table {cache}")


def test_facts_of_a_long_file_are_whole(spark):
    """More calls than any array was once cut to, and what comes after them."""
    text = "def last():\n    pass\n\n\n" + "f()\n" * 100_001 + "last()\n\n\ndef after():\n    pass\n"
    row = python_facts.facts(spark.createDataFrame([("long.py", text)], "path string, content string")).select(F.size("edges").alias("n"), F.element_at("edges", -1).target_name.alias("last"), F.element_at("nodes", -1).qualified.alias("node"), "diagnostic").first()
    assert tuple(row) == (100_002, "last", "long.after", None)
