"""Routes that decorators, attributes and router initialisers declare, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that declare a route of their own method, in decorators and in attributes, and those that list methods.
VERBS = ["get", "post", "put", "delete", "patch", "head", "options"]
ANY_VERB = "any"
LISTED = ["route", "api_route"]
WEBSOCKET, WEBSOCKET_METHOD, DEFAULT_METHOD = "websocket", "WS", "GET"

_QUOTED = r"""^[^"']*(?:"([^"]*)"|'([^']*)')"""
_NO_ROUTES = "array<struct<method:string,path:string>>"


def first_string(text: Column) -> Column:
    """What the first quotes of a text hold; null without any."""
    hit = text.rlike(_QUOTED)
    return F.when(hit, F.concat(F.regexp_extract(text, _QUOTED, 1), F.regexp_extract(text, _QUOTED, 2)))


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark; null without one."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substr(text, at + len(mark)))


def decorator_routes(decorator: Column) -> Column:
    """(method, path) of every route that a decorator declares: that of its verb, a websocket, or a route with a list of methods."""
    body = F.regexp_replace(F.trim(decorator), "^@+", "")
    args = _after(body, "(")
    verb = F.trim(F.element_at(F.split(F.split_part(body, F.lit("("), F.lit(1)), r"\."), -1))
    path = first_string(args)
    listed = F.split_part(F.coalesce(_after(args, "methods"), F.lit("")), F.lit("]"), F.lit(1))
    pieces = F.split(listed, "[\"']")
    named = F.transform(F.filter(pieces, lambda x, k: k % 2 == 1), F.upper)
    methods = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(DEFAULT_METHOD)))
    found = F.when(verb.isin(VERBS), F.array(F.upper(verb))).when(verb == WEBSOCKET, F.array(F.lit(WEBSOCKET_METHOD))).when(verb.isin(LISTED), methods)
    routes = F.transform(found, lambda m: F.struct(m.alias("method"), path.alias("path")))
    return F.coalesce(F.when(path.startswith("/"), routes), F.array().cast(_NO_ROUTES))


def attribute_route(attribute: Column) -> Column:
    """(method, path) of an attribute; a route that names no method has the empty one. Null where there is none."""
    inner = F.when(attribute.startswith("#[") & attribute.endswith("]"), F.substr(attribute, F.lit(3), F.length(attribute) - 3))
    verb = F.trim(F.element_at(F.split(F.split_part(inner, F.lit("("), F.lit(1)), "::"), -1))
    path = F.get(F.split(_after(inner, "("), '"'), F.lit(1))
    method = F.when(verb == "route", "").when(verb.isin([*VERBS, ANY_VERB]), F.upper(verb))
    return F.when(method.isNotNull() & path.startswith("/"), F.struct(method.alias("method"), path.alias("path")))


def router_name(decorator: Column) -> Column:
    """The object that a decorator is called on; null without one."""
    callee = F.split_part(F.regexp_replace(F.trim(decorator), "^@+", ""), F.lit("("), F.lit(1))
    return F.when(callee.contains("."), F.regexp_extract(callee, r"^(.*)\.", 1))


def router_prefix(initialiser: Column) -> Column:
    """The prefix that a router was made with; empty without one, or where it is no path."""
    told = first_string(F.regexp_replace(_after(initialiser, "prefix"), r"^\s*=*", ""))
    return F.coalesce(F.when(told.startswith("/"), told), F.lit(""))


def joined_route(prefix: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(F.coalesce(prefix, F.lit("")), "/+$", ""), path)
