"""From a source tree to a stored snapshot: capture, parse only what is new, resolve, publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scope import REVIEWED_KINDS
from ..operators import diff, traversal
from ..sources.python_facts import facts, resolve
from ..sources.worktree import capture, line_diffs
from ..storage import keep


@dataclass
class Snapshot:
    files: DataFrame
    facts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame

    def stats(self) -> DataFrame:
        """files, parsed, nodes, edges, calls, resolved_calls in one row."""
        calls = self.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "calls").alias("calls"), F.count_if((F.col("kind") == "calls") & F.col("target").isNotNull()).alias("resolved_calls"))
        sizes = self.files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("n_bytes"))
        return sizes.join(self.nodes.agg(F.count(F.lit(1)).alias("nodes"))).join(calls)


def analyse(spark: SparkSession, root: str, before: Snapshot | None = None) -> Snapshot:
    """A snapshot of the tree. Files whose path and content ``before`` has are not parsed again."""
    found, wrong = capture(spark, root)
    files = keep(found, "files")
    todo, reused = files, None
    if before is not None:
        same = before.files.select("path", "hash")
        todo = files.join(same, ["path", "hash"], "left_anti")
        reused = before.facts.join(files.join(same, ["path", "hash"], "left_semi").select("path"), "path", "left_semi")
    parsed = facts(todo)
    parsed = keep(parsed if reused is None else parsed.unionByName(reused), "facts")
    nodes = keep(parsed.select(F.explode("nodes").alias("n")).select("n.*"), "nodes")
    edges = keep(resolve(nodes, parsed.select(F.explode("edges").alias("e")).select("e.*")), "edges")
    broken = parsed.where("diagnostic is not null").select(F.col("diagnostic").alias("code"), "path")
    return Snapshot(files, parsed, nodes, edges, wrong.unionByName(broken))


def changes(before: Snapshot, after: Snapshot) -> DataFrame:
    """stable_key, qualified, path, id, state, reasons, priority. Copies of a key cancel one for one by fingerprint; what
    is left alone on both sides is modified, anything else removed and added."""
    kept = lambda s: s.nodes.where(F.col("kind").isin(REVIEWED_KINDS))
    states = diff.multiset_diff(kept(before), kept(after), "stable_key", ["fingerprint"]).select("stable_key", "state")
    row = lambda s, n: kept(s).groupBy("stable_key").agg(F.min(F.struct("start", "id", "qualified", "path", "signature", "visibility")).alias(n))
    met = states.join(row(before, "old"), "stable_key", "left").join(row(after, "new"), "stable_key", "left")
    state, public = F.col("state"), (F.coalesce("old.visibility", F.lit("")) == "public") | (F.coalesce("new.visibility", F.lit("")) == "public")
    changed = (F.col("old.signature") != F.col("new.signature")) | (F.col("old.visibility") != F.col("new.visibility"))
    reason = F.when(state == "removed", "definition removed").when(state == "added", "definition added").when(changed, "signature changed").otherwise("implementation changed")
    at = F.when(state == "removed", F.col("old")).otherwise(F.col("new"))
    return met.select("stable_key", "state", reason.alias("reason"), diff.priority(state, changed, public).alias("priority"), at.alias("n")).select(
        "stable_key", "n.qualified", "n.path", "n.id", "state", "reason", "priority"
    )


def review(before: Snapshot, after: Snapshot) -> dict[str, DataFrame]:
    """changes in review order; for each changed definition up to 30 callers within two reverse steps, with their paths; and
    the line diffs of changed files."""
    found = keep(changes(before, after), "changes")
    calls = before.edges.unionByName(after.edges).where("kind = 'calls' and target is not null")
    old = before.nodes.select("stable_key", "id").unionByName(after.nodes.select("stable_key", "id")).join(found.select("stable_key"), "stable_key", "left_semi")
    return {
        "changes": found.orderBy(F.desc("priority"), "path", "qualified", "id"),
        "callers": traversal.impact(calls, old.select("id").distinct())[0].withColumnRenamed("seed", "target"),
        "files": line_diffs(before.files, after.files),
    }
