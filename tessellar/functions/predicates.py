"""Classification predicates as Column expressions, with their fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and extensions that decide what a path is.
DENIED_COMPONENTS = [".git", ".worktrees", "target", "node_modules", "vendor", "third_party", "__pycache__", ".venv", "venv", ".pytest_cache", ".mypy_cache"]
DENIED_NAMES = ["package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml"]
ALLOWED_EXTENSIONS = ["rs", "py", "pyi", "toml", "xml", "md", "markdown", "rst", "adoc", "yaml", "yml", "json", "sql", "proto", "graphql", "gql", "sh", "properties", "ini", "cfg"]
ALLOWED_NAMES = ["Cargo.lock", ".gitignore", ".dockerignore", "Dockerfile", "Containerfile", "Makefile", "Justfile", "Jenkinsfile", "README", "LICENSE", "NOTICE"]
DOCUMENT_PREFIXES = ["readme", "license", "notice", "changelog", "authors", "contributing"]
DOCUMENT_FOLDERS = ["doc", "docs", "documentation"]
MANIFESTS = ["cargo.toml", "pyproject.toml", "setup.cfg", "setup.py", "requirements.txt", "pipfile"]
LOCKFILES = ["cargo.lock", "poetry.lock", "uv.lock", "pipfile.lock"]
INTERNAL = ["health", "healthz", "ready", "readyz", "live", "livez", "internal", "metrics", "debug", "status", "ping", "_internal"]
METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the name, unless the name begins there."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def admitted(path: Column) -> Column:
    """Does a source capture take this path?"""
    parts, name, ext = F.split(path, "/"), file_name(path), extension(path)
    words = F.lower(name)
    prefix = F.lit(False)
    for p in DOCUMENT_PREFIXES:
        prefix = prefix | words.startswith(p)
    document = (ext == "txt") & (name.startswith("requirements") | prefix | F.arrays_overlap(parts, F.array(*map(F.lit, DOCUMENT_FOLDERS))))
    denied = F.arrays_overlap(parts, F.array(*map(F.lit, DENIED_COMPONENTS))) | name.isin(DENIED_NAMES)
    cargo = path.rlike(r"(^|/)\.cargo/config$")
    allowed = ext.isin(ALLOWED_EXTENSIONS) | name.isin(ALLOWED_NAMES) | name.startswith("Dockerfile.") | name.startswith("Containerfile.") | document
    return ~denied & (cargo | allowed)


def artifact_kind(path: Column) -> Column:
    """manifest, lockfile, documentation, schema, deployment or configuration, by the first rule that holds; else null."""
    name, ext = F.lower(file_name(path)), extension(path)
    under = lambda folder: path.startswith(f"{folder}/") | path.contains(f"/{folder}/")
    return (
        F.when(name.isin(MANIFESTS) | (name.startswith("requirements") & (ext == "txt")), "manifest")
        .when(name.isin(LOCKFILES), "lockfile")
        .when(ext.isin("md", "markdown", "rst", "adoc") | name.startswith("readme") | ((ext == "txt") & under("docs")), "documentation")
        .when(ext.isin("sql", "proto", "graphql", "gql"), "schema")
        .when(
            name.isin("dockerfile", "makefile", "containerfile", "jenkinsfile", "justfile") | name.startswith("dockerfile.") | name.contains("compose")
            | path.contains(".github/workflows/") | path.contains(".circleci/") | name.startswith(".gitlab-ci") | under("deploy") | ext.isin("sh", "dockerfile"),
            "deployment",
        )
        .when(ext.isin("toml", "yaml", "yml", "json", "xml", "ini", "cfg", "env") | (name == ".env") | name.startswith(".env.") | path.contains(".cargo/config"), "configuration")
    )


def is_status(code: Column) -> Column:
    """Error statuses only."""
    return code.between(400, 599)


def is_code(text: Column) -> Column:
    """A machine code: 3 to 64 of a-z, 0-9, _ and ., a letter first; without _ or . at most 24."""
    return text.rlike("^[a-z][a-z0-9_.]{2,63}$") & (text.rlike("[_.]") | (F.length(text) <= 24))


def is_internal_path(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/+", ""), "/")[0].isin(INTERNAL)


def looks_like_route(text: Column) -> Column:
    return text.rlike(r"^/[A-Za-z0-9/_\-{}*:.<>]{0,254}$")


def http_method(text: Column) -> Column:
    last = F.element_at(F.split(text, "::"), -1)
    return F.when(last.isin(METHODS), last)


def glob_pattern(glob: Column) -> Column:
    """An anchored regular expression for a glob whose * and ? also match a slash."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}|\\\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*+", ".*"), r"\?", "."), F.lit("$"))


def like_literal(text: str) -> str:
    """Text as a LIKE pattern of itself, with the escape character backslash."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def holds(text: Column, pattern: str) -> Column:
    """LIKE that folds A-Z and nothing else."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(text, upper, lower).like(pattern.translate(str.maketrans(upper, lower)))


def component(path: Column, root: Column) -> Column:
    """The component that a file's path names: tests, examples, its first folder under src, or its own stem; files that
    only name their folder belong to core."""
    under = F.when((root != "") & path.startswith(F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)
    first = F.split(F.regexp_replace(under, "^src/", ""), "/")[0]
    stem = F.regexp_replace(first, r"\.[^.]*$", "")
    plain = F.when(~first.contains("."), first).when(stem.isin("lib", "main", "mod", "__init__", "__main__"), "core").otherwise(stem)
    return F.when(under.startswith("tests/"), "tests").when(under.startswith("examples/"), "examples").otherwise(plain)


# Names of statuses.
STATUS_NAMES = {
    "OK": 200, "CREATED": 201, "ACCEPTED": 202, "NO_CONTENT": 204, "BAD_REQUEST": 400, "UNAUTHORIZED": 401, "FORBIDDEN": 403, "NOT_FOUND": 404,
    "METHOD_NOT_ALLOWED": 405, "CONFLICT": 409, "GONE": 410, "PAYLOAD_TOO_LARGE": 413, "UNSUPPORTED_MEDIA_TYPE": 415, "UNPROCESSABLE_ENTITY": 422,
    "TOO_MANY_REQUESTS": 429, "INTERNAL_SERVER_ERROR": 500, "NOT_IMPLEMENTED": 501, "BAD_GATEWAY": 502, "SERVICE_UNAVAILABLE": 503, "GATEWAY_TIMEOUT": 504,
}
# What a project's root manifest, or else the endings of its files, say about its language.
LANGUAGE_MANIFESTS = {"Cargo.toml": "rust", "pyproject.toml": "python", "setup.cfg": "python", "setup.py": "python"}
LANGUAGE_ENDINGS = {"rs": "rust", "py": "python", "pyi": "python"}


def status_constant(path: Column) -> Column:
    """The number of StatusCode::NAME; null for other paths and names."""
    named = F.create_map(*[F.lit(v) for pair in STATUS_NAMES.items() for v in pair])
    return F.when(path.contains("StatusCode"), F.try_element_at(named, F.element_at(F.split(path, "::"), -1)))


def status_value(text: Column) -> Column:
    """An error status written as a number or as HTTP_nnn_NAME behind the last dot; else null."""
    plain = F.trim(text).rlike("^[+-]?[0-9]+$")
    named = F.regexp_extract(F.element_at(F.split(text, r"\."), -1), "^HTTP_([0-9]+)", 1)
    code = F.when(plain, F.trim(text).try_cast("long")).otherwise(named.try_cast("long"))
    return F.when(is_status(code), code)


def languages(files, project: str, path: str):
    """project, language: what the manifests in a project's root say if they agree, else the one kind of ending there is."""
    test = lambda found, table, key: F.bool_or(F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), key) == found, F.lit(False)))
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    by = [test(language, t, k).alias(f"{name}_{language}") for name, t, k in (("root", LANGUAGE_MANIFESTS, F.col(path)), ("ending", LANGUAGE_ENDINGS, ending)) for language in ("rust", "python")]
    seen = files.groupBy(project).agg(*by)
    one = lambda name: F.when(F.col(f"{name}_rust") & ~F.col(f"{name}_python"), "rust").when(F.col(f"{name}_python") & ~F.col(f"{name}_rust"), "python")
    return seen.select(project, F.when(F.col("root_rust") | F.col("root_python"), one("root")).otherwise(one("ending")).alias("language"))
