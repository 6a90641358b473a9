"""Packages and declared dependencies from project manifests."""

from __future__ import annotations

import re
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.rules import owners

ROW = "package string, version string, alias string, target string, kind string, condition string, optional boolean, path string"


def requirement(raw: str, kind: str) -> tuple | None:
    """name, name, kind, marker of one requirement line; None for comments and directives."""
    raw = raw.split("#")[0].strip()
    name = re.match(r"[A-Za-z0-9._-]+", raw)
    return (name[0], name[0], kind, raw.partition(";")[2].strip() or None, kind.startswith("optional"), None) if name and raw[0] != "-" else None


def declared(path: str, content: str) -> list[tuple]:
    """(package, version, alias, target, kind, condition, optional, path); a first row without alias names the package."""
    name = path.rsplit("/", 1)[-1]
    if name.startswith("requirements"):
        return [(None, None, *r) for line in content.splitlines() if (r := requirement(line, "requirements"))]
    try:
        spec = tomllib.loads(content)
    except tomllib.TOMLDecodeError:
        return [(None, None, None, None, "invalid_manifest", None, False, None)]
    if name == "Cargo.toml":
        package = spec.get("package", {})
        own, rows = package.get("name"), []
        sections = [(None, spec), *spec.get("target", {}).items()]
        for condition, part in sections:
            for table, kind in (("dependencies", "normal"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
                for alias, value in part.get(table, {}).items():
                    value = value if isinstance(value, dict) else {}
                    if value.get("workspace"):
                        whole = spec.get("workspace", {}).get("dependencies", {}).get(alias, {})
                        value = (whole if isinstance(whole, dict) else {}) | value
                    rows.append((own, None, alias, value.get("package", alias), kind, condition, bool(value.get("optional")), value.get("path")))
        version = package.get("version")
        return [(own, version if isinstance(version, str) else None, None, None, "package", None, False, None), *rows]
    project = spec.get("project", {})
    own = project.get("name")
    lists = [("normal", project.get("dependencies", [])), *((f"optional:{g}", v) for g, v in project.get("optional-dependencies", {}).items()), *((f"group:{g}", v) for g, v in spec.get("dependency-groups", {}).items())]
    rows = [(own, None, *r) for kind, values in lists for v in values if isinstance(v, str) and (r := requirement(v, kind))]
    return [(own, project.get("version"), None, None, "package", None, False, None), *rows]


def manifests(files: DataFrame) -> DataFrame:
    """manifest, root and the rows of ``declared`` for each manifest among files (path, content)."""
    wanted = files.where(F.regexp(F.col("path"), F.lit(r"(^|/)(Cargo\.toml|pyproject\.toml|requirements[^/]*\.txt)$")))

    schema = T._parse_datatype_string(ROW)
    arrow = pa.list_(to_arrow_type(schema))

    @F.arrow_udf(T.ArrayType(schema))
    def rows(paths: pa.Array, contents: pa.Array) -> pa.Array:
        both = zip(paths.to_pylist(), contents.to_pylist(), strict=True)
        return pa.array([[dict(zip(schema.names, r, strict=True)) for r in declared(p, c)] for p, c in both], arrow)

    out = wanted.select(F.col("path").alias("manifest"), F.explode(rows("path", "content")).alias("r")).select("manifest", "r.*")
    return out.withColumn("root", F.regexp_extract("manifest", "^(.*)/[^/]*$", 1))


def package_of(files: DataFrame, found: DataFrame) -> DataFrame:
    """path, package: each file under the longest manifest root above it."""
    roots = found.where("kind = 'package'").groupBy("root").agg(F.min("package").alias("package"))
    own = owners(files.select("path"), roots.select(F.col("root").alias("prefix")))
    return own.join(roots.withColumnRenamed("root", "prefix"), "prefix").select("path", "package")


def internal_relations(found: DataFrame) -> DataFrame:
    """source, target of packages whose declared dependency names another captured package, outside development."""
    names = found.where("kind = 'package'").select(F.col("package").alias("target")).distinct()
    return found.where("alias is not null and kind <> 'dev'").join(names, "target").select(F.col("package").alias("source"), "target").distinct()


def targets(files: DataFrame, found: DataFrame) -> DataFrame:
    """package, kind, name, path of the build targets that a cargo package has by where its files lie."""
    roots = found.where("kind = 'package' and manifest like '%Cargo.toml'").select("root", "package").distinct()
    own = owners(files.select("path"), roots.select(F.col("root").alias("prefix"))).join(roots.withColumnRenamed("root", "prefix"), "prefix")
    inner = F.when(F.col("prefix") == "", F.col("path")).otherwise(F.substr("path", F.length("prefix") + 2))
    stem = F.regexp_extract("inner", r"([^/]+?)(/main)?\.rs$", 1)
    folder = F.regexp_extract("inner", r"^(src/bin|tests|benches|examples)/([^/]+\.rs|[^/]+/main\.rs)$", 1)
    kind = (
        F.when(F.col("inner") == "src/lib.rs", "lib").when(F.col("inner") == "src/main.rs", "bin").when(F.col("inner") == "build.rs", "build")
        .when(folder == "src/bin", "bin").when(folder == "tests", "test").when(folder == "benches", "bench").when(folder == "examples", "example")
    )
    name = F.when(F.col("inner").isin("src/lib.rs", "src/main.rs"), F.col("package")).otherwise(stem)
    return own.withColumn("inner", inner).select("package", kind.alias("kind"), name.alias("name"), "path").where("kind is not null")
