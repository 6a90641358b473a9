"""Declarations and relations of Python files, and their static resolution.

One file is one row in and one row of facts out, parsed in the task that holds it; what is resolved across files is a
join. Spans are UTF-8 byte offsets with one-based lines.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "id string, stable_key string, name string, qualified string, kind string, parent string, path string, visibility string, signature string, fingerprint string, start long, end long, line long, is_test boolean, plain boolean"
EDGE = "id string, source string, target string, target_name string, kind string, resolution string, path string, start long, end long, line long"


def identity(*parts: str) -> str:
    h = hashlib.sha256()
    for p in map(str.encode, parts):
        h.update(len(p).to_bytes(8, "little") + p)
    return h.hexdigest()


def module_name(path: str) -> str:
    parts = path.removesuffix(".py").removesuffix(".pyi").split("/")
    parts = parts[1:] if parts[0] == "src" and len(parts) > 1 else parts
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


class Walk(ast.NodeVisitor):
    """Collects rows of NODE and EDGE in source order."""

    def __init__(self, path: str, text: str):
        self.path, self.data = path, text.encode()
        self.starts = [0]
        for line in self.data.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []
        self.test = path.startswith("tests/") or "/tests/" in path or path.rsplit("/", 1)[-1].startswith("test_")
        self.scopes: list[tuple[str, str, str]] = []  # id, qualified, kind
        self.conditions = 0

    def span(self, n: ast.AST) -> tuple[int, int, int]:
        return self.starts[n.lineno - 1] + n.col_offset, self.starts[n.end_lineno - 1] + n.end_col_offset, n.lineno

    def declare(self, name: str, kind: str, span: tuple[int, int, int], signature: str, plain: bool = True) -> str:
        owner = self.scopes[-1] if self.scopes else ("", "", "")
        qualified = f"{owner[1]}.{name}" if owner[1] else name
        key = identity("", self.path, kind, qualified)
        node = identity(key, str(span[0]))
        visibility = "private" if name.startswith("_") and not name.startswith("__") else "public"
        text = self.data[span[0] : span[1]]
        self.nodes.append((node, key, name.rsplit(".", 1)[-1], qualified, kind, owner[0] or None, self.path, visibility, signature, hashlib.sha256(text).hexdigest(), *span, self.test, plain and not self.conditions))
        return node

    def relate(self, kind: str, name: str, n: ast.AST) -> None:
        span = self.span(n)
        source = self.scopes[-1][0]
        self.edges.append((identity(source, kind, str(span[0]), str(span[1])), source, None, name, kind, "unresolved", self.path, *span))

    def run(self, tree: ast.Module) -> Walk:
        module = module_name(self.path)
        node = self.declare(module, "module", (0, len(self.data), 1), "")
        self.scopes.append((node, module, "module"))
        self.generic_visit(tree)
        return self

    def inner(self, node: str, n: ast.AST, kind: str) -> None:
        self.scopes.append((node, next(x[3] for x in reversed(self.nodes) if x[0] == node), kind))
        held, self.conditions = self.conditions, 0
        for part in n.body:
            self.visit(part)
        self.conditions = held
        self.scopes.pop()

    def visit_FunctionDef(self, n) -> None:
        for x in [*n.decorator_list, n.args, *([n.returns] if n.returns else [])]:
            self.visit(x)
        signature = f"({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
        self.inner(self.declare(n.name, "function", self.span(n), signature, not n.decorator_list), n, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, n) -> None:
        for x in n.decorator_list:
            self.visit(x)
        node = self.declare(n.name, "type", self.span(n), ", ".join(map(ast.unparse, n.bases)), not n.decorator_list)
        self.scopes.append((node, "", "type"))
        for base in n.bases:
            self.relate("extends", ast.unparse(base), base)
        self.scopes.pop()
        self.inner(node, n, "type")

    def visit_If(self, n) -> None:
        self.conditions += 1
        self.generic_visit(n)
        self.conditions -= 1

    visit_Try = visit_For = visit_While = visit_With = visit_Match = visit_If

    def visit_Import(self, n) -> None:
        for a in n.names:
            self.relate("imports", f"{a.name} as {a.asname or a.name.split('.')[0]}", n)

    def visit_ImportFrom(self, n) -> None:
        module = self.nodes[0][3].split(".")
        own = module if self.path.endswith("__init__.py") else module[:-1]
        base = ".".join([*own[: len(own) - n.level + 1], *([n.module] if n.module else [])]) if n.level else n.module
        for a in n.names:
            self.relate("imports", f"{base}.{a.name} as {a.asname or a.name}", a)

    def visit_Call(self, n) -> None:
        if isinstance(n.func, ast.Name | ast.Attribute):
            self.relate("calls", ast.unparse(n.func), n)
        self.generic_visit(n)

    def assigned(self, target: ast.AST, n: ast.AST) -> None:
        kind = self.scopes[-1][2]
        if isinstance(target, ast.Name) and kind in ("module", "type"):
            self.declare(target.id, "field" if kind == "type" else "variable", self.span(n), "")
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
            self.relate("writes", f"self.{target.attr}", target)

    def visit_Assign(self, n) -> None:
        for t in n.targets:
            self.assigned(t, n)
        self.generic_visit(n)

    def visit_AnnAssign(self, n) -> None:
        self.assigned(n.target, n)
        self.relate("type_usage", ast.unparse(n.annotation), n.annotation)
        self.generic_visit(n)


def facts(files: DataFrame) -> DataFrame:
    """path, nodes, edges, diagnostic of every Python file of files (path, content); a file that does not parse has no
    nodes and says why."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    walk = Walk(path, content).run(ast.parse(content))
                    out.append((path, walk.nodes, walk.edges, None))
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append((path, [], [], f"parse_error: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "nodes", "edges", "diagnostic"])

    struct = lambda s: "array<struct<" + ", ".join(f"{n}: {t}" for n, t in (x.split() for x in s.split(", "))) + ">>"
    python = files.where(F.regexp(F.col("path"), F.lit(r"\.pyi?$"))).select("path", "content")
    return python.mapInPandas(parse, f"path string, nodes {struct(NODE)}, edges {struct(EDGE)}, diagnostic string")


def resolve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with targets for calls of functions that are bound once, unconditionally and undecorated: by their name in
    the same module, or by a name that the module imports once. Everything else stays unresolved."""
    known = nodes.where("kind in ('function', 'type')").groupBy("qualified").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("callee"), F.bool_and("plain").alias("sure"))
    known = known.where("n = 1 and sure").select("qualified", "callee")
    modules = nodes.where("kind = 'module'").select("path", F.col("qualified").alias("module"))
    bound = nodes.where("kind in ('function', 'type', 'variable')").groupBy("path", F.col("qualified").alias("shadow")).count().drop("count")
    pair = F.split("target_name", " as ")
    imported = edges.where("kind = 'imports'").select("path", pair[0].alias("full"), pair[1].alias("alias"))
    imported = imported.groupBy("path", "alias").agg(F.min("full").alias("full"), F.count_distinct("full").alias("n")).where("n = 1").drop("n")
    calls = edges.where("kind = 'calls'").join(modules, "path").withColumn("head", F.split("target_name", r"\.")[0])
    calls = calls.join(imported, (calls["path"] == imported["path"]) & (calls["head"] == imported["alias"]), "left").drop(imported["path"])
    local = F.concat_ws(".", "module", "target_name")
    calls = calls.join(bound.withColumnRenamed("path", "at"), (F.col("path") == F.col("at")) & (F.col("shadow") == F.concat_ws(".", "module", "head")), "left")
    far = F.concat(F.col("full"), F.substr("target_name", F.length("head") + 1))
    name = F.when(F.col("shadow").isNull() & F.col("full").isNotNull(), far).when(F.col("full").isNull() & ~F.col("target_name").contains("."), local)
    found = calls.withColumn("qualified", name).join(known, "qualified", "left").select("id", F.col("callee"))
    out = edges.join(found, "id", "left").withColumn("target", F.coalesce("target", "callee"))
    return out.withColumn("resolution", F.when(F.col("callee").isNotNull(), "resolved").otherwise(F.col("resolution"))).drop("callee")
