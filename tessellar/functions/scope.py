"""Scope and admission predicates as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of calls that leave the program, as beginnings and as a whole name.
BOUNDARY_STARTS = ["std::env::", "std::fs::", "os.getenv", "os.environ", "subprocess.", "std::process::"]
BOUNDARY_NAMES = ["open"]
# Files that an explanation may quote, and folders that it never does.
MATERIAL_ENDINGS = [".rs", ".py", ".pyi"]
MATERIAL_NAMES = ["Cargo.toml", "pyproject.toml"]
MATERIAL_READMES = ["readme", "readme.md", "readme.rst", "readme.markdown"]
MATERIAL_REFUSED = ["runtime-data", "vendor", "target"]
# Kinds of declarations that a review compares.
REVIEWED_KINDS = ["function", "type", "trait", "value", "macro", "field", "variant"]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def runtime_boundary(spelling: Column) -> Column:
    """Does the spelling of a call suggest that it leaves the program?"""
    return any_of([spelling.startswith(s) for s in BOUNDARY_STARTS] + [spelling.isin(BOUNDARY_NAMES)])


def explanation_material(path: Column) -> Column:
    """May an explanation quote this file? No hidden part, no refused folder, and a known ending or name."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    refused = F.exists(parts, lambda p: p.startswith(".") | p.isin(MATERIAL_REFUSED))
    return ~refused & (any_of([path.endswith(e) for e in MATERIAL_ENDINGS]) | name.isin(MATERIAL_NAMES) | F.lower(name).isin(MATERIAL_READMES))


def package_in_scope(name: Column, root: Column, key: Column, query: str) -> Column:
    """Name or non-empty root holds the query, or the id is the query."""
    return name.contains(query) | ((root != "") & root.contains(query)) | (key == query)


def paths_related(a: Column, b: Column) -> Column:
    """The same path, or one is a folder above the other."""
    return (a == b) | a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))


def item_in_scope(item: Column, node_ids: Column, query: str, ids: Column) -> Column:
    """The whole item, written as JSON, holds the query, or its nodes meet those of the scope."""
    return F.to_json(item).contains(query) | F.arrays_overlap(node_ids, ids)
