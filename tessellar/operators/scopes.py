"""Names along lexical scope chains, as interval lookups over labelled scopes.

scopes: id, parent, kind, redirect (the scope that stands in for this one, null for none). bindings: scope, name, kind, target,
node, unconditional. A name is looked for in its own scope, then outwards. A class scope (kind ``type``) only counts for
calls that stand in it directly. A scope with a redirect has no bindings of its own. The nearest scope that binds the name, or that takes
in unknown names (a binding ``*``), decides: unknown names block it, several bindings make it ambiguous, and
a binding under a condition is no sure one. Scopes further out than HOPS are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from . import forest, intervals

HOPS = 128


def nearest_bindings(calls: DataFrame, scopes: DataFrame, bindings: DataFrame, hops: int = HOPS) -> DataFrame:
    """calls (id, scope, name) with state (bound, blocked, ambiguous, conditional, or unbound), distance and binding (a struct
    of kind, target, node where state is bound). Five joins over the labels, whatever the depth."""
    up = scopes.select("id", F.coalesce("redirect", "parent").alias("parent"))
    tree = keep(forest.labels(up).join(scopes.select("id", "kind", F.col("redirect").isNotNull().alias("passed")), "id"), "scopes")
    of = tree.select(F.col("id").alias("scope"), "root", "enter", "leave", "depth", "kind", "passed")
    by_name = bindings.groupBy("scope", "name").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("unconditional").alias("sure"), F.min(F.struct("kind", "target", "node")).alias("binding"),
    )
    named = by_name.join(of.drop("scope_kind").withColumnRenamed("kind", "scope_kind"), "scope").where("not passed")
    spans = named.select("root", "name", "n", "sure", "binding", F.col("enter").alias("a"), F.col("leave").alias("b"), F.col("depth").alias("at_depth"), (F.col("scope_kind") == "type").alias("class"))
    spans = keep(spans, "scope-bindings")
    points = keep(calls.join(of.select("scope", "root", "enter", "depth"), "scope").select("id", "name", "root", "enter", "depth"), "scope-calls")
    on = intervals.levels(spans, "a", "b")
    plain = intervals.containing(points, spans.where("name <> '*'"), ["root", "name"], "enter", "a", "b", on)
    wild = intervals.containing(points, spans.where("name = '*'").drop("name"), ["root"], "enter", "a", "b", on)
    far = F.col("depth") - F.col("at_depth")
    met = plain.withColumn("wild", F.lit(False)).unionByName(wild.withColumn("wild", F.lit(True))).withColumn("distance", far)
    met = met.where((F.col("distance") < hops) & (~F.col("class") | (F.col("distance") == 0)))
    first = met.groupBy("id").agg(F.min_by(F.struct("distance", "wild", "n", "sure", "binding"), F.struct("distance", ~F.col("wild"))).alias("x"))
    state = F.when(F.col("x").isNull(), "unbound").when(F.col("x.wild"), "blocked").when(F.col("x.n") > 1, "ambiguous").when(~F.col("x.sure"), "conditional").otherwise("bound")
    return calls.join(first, "id", "left").select(*calls.columns, state.alias("state"), F.col("x.distance").alias("distance"), F.when(state == "bound", F.col("x.binding")).alias("binding"))


def resolve(calls: DataFrame, scopes: DataFrame, bindings: DataFrame, definitions: DataFrame, hops: int = HOPS) -> DataFrame:
    """calls (id, scope, name, dotted by attributes) with target: the one definition that a call surely means, else null.
    definitions: id, qualified, kind, name, parent. A function bound by name is its own definition; an imported name is the only one so
    qualified; attributes are looked up below an imported module. What is found has to be a function outside classes that its
    own scope binds once, surely, and with no unknown names beside it."""
    parts = F.split("name", r"\.")
    sound = F.forall(parts, lambda p: p.rlike(r"^[\p{L}\p{N}_]+$"))
    asked = calls.where(sound).withColumn("rest", F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "."))
    first = nearest_bindings(asked.select("id", "scope", parts[0].alias("name")), scopes, bindings, hops)
    bound = first.where("state = 'bound'").select("id", "binding.*").join(asked.select("id", "rest"), "id")
    named = definitions.groupBy("qualified").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "kind")).alias("d")).where("n = 1")
    by_name = keep(named.select("qualified", "d.id", "d.kind"), "definitions")
    whole = F.col("rest") == ""
    wanted = F.when(whole & (F.col("kind") == "import_symbol"), F.col("target")).when(~whole & F.col("kind").isin("import_symbol", "import_module"), F.concat_ws(".", "target", "rest"))
    meant = bound.withColumn("wanted", wanted).withColumn("own", F.when(whole & (F.col("kind") == "function"), F.col("node")))
    met = meant.join(by_name.select(F.col("qualified").alias("wanted"), F.col("id").alias("found")), "wanted", "left")
    modules = by_name.where("kind = 'module'").select(F.col("qualified").alias("target"), F.lit(True).alias("module"))
    met = met.join(modules, "target", "left")
    below_symbol = ~whole & (F.col("kind") == "import_symbol")
    met = met.select("id", F.coalesce("own", F.when(~below_symbol | F.coalesce("module", F.lit(False)), F.col("found"))).alias("target")).where("target is not null")
    counts = bindings.groupBy("scope", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("kind", "unconditional", "node")).alias("b"))
    open_scopes = bindings.where("name = '*'").select(F.col("scope").alias("parent")).distinct()
    classes = scopes.where("kind = 'type'").select(F.col("id").alias("parent"))
    one = (F.col("n") == 1) & (F.col("b.kind") == "function") & F.col("b.unconditional") & F.col("b.node").eqNullSafe(F.col("target"))
    functions = definitions.where("kind = 'function' and parent is not null").join(open_scopes, "parent", "left_anti").join(classes, "parent", "left_anti")
    safe = met.join(functions.select(F.col("id").alias("target"), F.col("parent").alias("scope"), F.col("name")), "target").join(counts, ["scope", "name"]).where(one)
    return calls.join(safe.select("id", "target"), "id", "left")
