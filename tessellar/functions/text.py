"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def clean(text: Column) -> Column:
    """Without control characters other than newline and tab."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "")


def single_line(text: Column, n: int) -> Column:
    """Cleaned, blanks collapsed and trimmed, cut to n characters with an ellipsis."""
    line = F.trim(F.regexp_replace(clean(text), r"[ \t\n]+", " "))
    return F.when(F.length(line) <= n, line).otherwise(F.concat(F.substring(line, 1, n), F.lit("…")))


def compact(text: Column, n: int) -> Column:
    """One line for an expression: blanks collapse to one, and vanish before . ) ] , ? and after . ( [."""
    line = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    line = F.regexp_replace(F.regexp_replace(line, r" ([.)\],?])", "$1"), r"([.(\[]) ", "$1")
    return F.when(F.length(line) <= n, line).otherwise(F.concat(F.substring(line, 1, n - 1), F.lit("…")))


def markdown(text: Column) -> Column:
    return F.regexp_replace(clean(text), r"([\\`*_\[\]<>])", r"\\$1")


def short_path(path: Column) -> Column:
    """The last component; the last two for the files that only name their folder."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    plain = ["mod.rs", "lib.rs", "main.rs", "__init__.py"]
    return F.when(last.isin(plain) & (F.size(parts) > 1), F.concat_ws("/", F.element_at(parts, -2), last)).otherwise(last)


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def join_path(base: Column, relative: Column) -> Column:
    """base/relative with . and .. resolved; null where it leaves the root, is absolute or has a backslash."""
    parts = F.concat(F.split(base, "/"), F.split(relative, "/"))
    step = lambda acc, p: (
        F.when(acc.isNull(), acc)
        .when(p.isin("", "."), acc)
        .when((p == "..") & (F.size(acc) == 0), F.lit(None))
        .when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p)))
    )
    out = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~relative.startswith("/") & ~relative.contains("\\"), F.array_join(out, "/"))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def byte_position(text: Column, characters: Column) -> Column:
    """UTF-8 bytes of the first so many characters."""
    return F.octet_length(text.substr(F.lit(1), characters))


def line_of(text: Column, position: Column) -> Column:
    """1-based line of a 1-based character position; null where the position is not above 0."""
    before = text.substr(F.lit(1), position - 1)
    return F.when(position > 0, F.length(before) - F.length(F.translate(before, "\n", "")) + 1)


def column_of(text: Column, position: Column) -> Column:
    """1-based column, in characters, of a 1-based character position."""
    before = text.substr(F.lit(1), position - 1)
    return F.when(position > 0, F.length(F.substring_index(before, "\n", -1)) + 1)


def evidence_of(text: Column, needle: Column) -> Column:
    """Where a needle first stands: bytes from and to, line and column; null where it does not."""
    at = F.position(needle, text)
    start = byte_position(text, at - 1)
    span = F.struct(start.alias("start_byte"), (start + F.octet_length(needle)).alias("end_byte"), line_of(text, at).alias("line"), column_of(text, at).alias("column"))
    return F.when(at > 0, span)


def path_link(path: Column) -> Column:
    """Percent-encoded but for slashes."""
    encoded = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(F.replace(encoded, F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def narrowed(reference: Column, n_lines: Column) -> Column:
    """id, first and last of a reference id#L2-L9 or id#L2, within n_lines; null where it points outside."""
    part = lambda k: F.nullif(F.regexp_extract(reference, "^([^#]+)#L([0-9]+)(?:-L([0-9]+))?$", k), F.lit(""))
    first, last = part(2).cast("long"), F.coalesce(part(3), part(2)).cast("long")
    whole = F.struct(part(1).alias("id"), first.alias("first"), last.alias("last"))
    return F.when((first >= 1) & (first <= last) & (last <= n_lines), whole)


def dependency_line(text: Column, alias: Column) -> Column:
    """The number, from 1, of the line of a manifest that declares a dependency: a key of a dependencies section, or the head
    of a section of its own; null without one. The section of a line is a running value over the lines before it."""
    begun = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("line"), F.lit(0).alias("found"))

    def step(state: Column, raw: Column) -> Column:
        line = F.trim(F.regexp_replace(raw, r"^[\s]+|[\s]+$", ""))
        head = line.startswith("[")
        inside = F.when(head, line.contains("dependencies") & ~line.contains("dev-dependencies") & ~line.contains("build-dependencies")).otherwise(state["inside"])
        key = F.regexp_replace(F.trim(F.split_part(line, F.lit("="), F.lit(1))), "^['\"]+|['\"]+$", "")
        own = F.regexp_replace(line, r"\]+$", "").endswith(F.concat(F.lit("."), alias))
        hit = inside & F.when(head, own).otherwise(line.contains("=") & (key == alias))
        n = state["line"] + 1
        return F.struct(inside.alias("inside"), n.alias("line"), F.when((state["found"] == 0) & hit, n).otherwise(state["found"]).alias("found"))

    found = F.aggregate(lines(text), begun, step, lambda s: s["found"])
    return F.when(found > 0, found)
