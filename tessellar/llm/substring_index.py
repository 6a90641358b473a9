"""Substring dedup by a log-structured fingerprint index.

A window is WINDOW consecutive words. Windows in a row share an anchor: the least of the hashed ANCHOR-word runs inside
them (leftmost of equals), so equal windows always have equal anchors at equal offsets. An entry is such a stretch of
windows: its anchor, two 64-bit hashes of all its words, the first document that holds it and where.

``SubstringIndex`` keeps immutable runs, sorted by their key, in a folder with a manifest, and is opened again by a later
call: runs of entries, and runs of window hashes for the stretches that had to be compared window by window. A batch is
resolved as it comes: its entries are joined by anchor with all historical runs (merge joins), what they share is verified,
the verdict is returned, and the batch's own runs are added. Before a batch, runs of one size class are compacted into one
of the next when there are FANOUT of them.

Verification: a stretch whose two hashes some earlier document has is repeated as a whole. The first document of a stretch
is compared window by window (two 64-bit hashes of all WINDOW words, made from the texts) where its anchor has other
stretches; a historical stretch is read from its text once, when a batch first meets its anchor with another stretch.

A document loses every word that lies in a window whose words also start in a document of smaller doc_id that came with
its own or an earlier batch; what was judged is not judged again, so batches come by ascending doc_id where all documents
are to count, as ``dedup_substrings`` makes them. Words are unchanged runs of other than the six ASCII blanks. Null text
has no words; a document of fewer than WINDOW words loses nothing; a null doc_id is never smaller nor larger; rows that
repeat a doc_id do not count against each other; any long is a doc_id; very long texts are cut into overlapping parts; empty input gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import next_version, put_version, tables_dir, versions
from .common import keep, map_texts, mix, words_of
from .shingles import Spans, run_hashes, word_hashes

WINDOW, ANCHOR = 50, 8
#: Runs of one size class that are merged into one of the next, and batches that the whole-table query forms.
FANOUT, BATCHES = 2, 3
#: Up to so many wanted texts (16 bytes each) are broadcast to filter the texts; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
_AT = np.uint64((1 << 26) - 1)


def stretches(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash) of each stretch of windows that share their anchor's place."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.uint64)
    grams = run_hashes(hashes, ANCHOR)
    least = (grams & ~_AT) | np.arange(len(grams), dtype=np.uint64)  # ties go to the left; places below 2**26
    reach, done = WINDOW - ANCHOR + 1, 1
    while done < reach:  # least over done grams -> over up to twice as many
        step = min(done, reach - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    place = (least & _AT).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return starts, np.diff(np.append(starts, n)), mix(grams[place[starts]])


ENTRY = "doc_id long, mark long, at int, windows int, anchor long, s1 long, s2 long"
#: A second word hash, for second hashes of runs.
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def entries(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), at, windows, anchor, s1, s2 for every stretch of every text."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("mark"))

    def run(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "mark", "at", "windows", "anchor", "s1", "s2")}
        for doc_id, mark, text in zip(cols["doc_id"], cols["mark"], cols["text"], strict=True):
            hashes = word_hashes(words_of(text))
            for base in range(0, max(len(hashes) - WINDOW + 1, 0), 1 << 25):  # very long texts in overlapping parts
                part = hashes[base : base + (1 << 25) + WINDOW - 1]
                at, n, anchor = stretches(part)
                ends = at + n + WINDOW - 1
                lanes = (Spans(x).of(at, ends).view(np.int64) for x in (part, mix(part ^ _OTHER)))
                for name, v in zip(("at", "windows", "anchor", "s1", "s2"), (at + base, n, anchor.view(np.int64), *lanes), strict=True):
                    out[name].append(v)
                out["doc_id"].append(np.full(len(at), doc_id))
                out["mark"].append(np.full(len(at), mark))
        return {k: np.concatenate([np.empty(0, np.int64), *v]) for k, v in out.items()}

    return map_texts(rows, run, ENTRY)


KEY = ["anchor", "s1", "s2"]
FIRST = ["first_doc", "mark", "at", "windows"]


def merged_entries(rows: DataFrame) -> DataFrame:
    """One row for each stretch of rows (KEY, FIRST, last_doc): its first holder and its last document."""
    found = rows.groupBy(*KEY).agg(F.min(F.struct(*FIRST)).alias("f"), F.max("last_doc").alias("last_doc"))
    return found.select(*KEY, "f.*", "last_doc").sortWithinPartitions(*KEY)


def merged_windows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("w1", "w2").agg(F.min("first").alias("first")).sortWithinPartitions("w1", "w2")


def merged_keys(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY).distinct().sortWithinPartitions(*KEY)


MERGE = {"entries": merged_entries, "windows": merged_windows, "compared": merged_keys}


def windows_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """KEY, first, k, w1, w2: hashes of every window of the wanted stretches (KEY, FIRST), from the texts of docs."""
    todo = wanted.groupBy(F.col("first_doc").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_list(F.struct(*KEY, "at", "windows")).alias("todo"))
    todo = keep(todo, "substring-wanted")  # a text's own stretches: no more than it has words
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    same = (F.col("doc_id") == F.col("__id")) & (F.col("mark") == F.col("__mark"))
    if todo.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(todo.select("__id", "__mark")), same, "left_semi")
    texts = texts.join(todo, same).select("doc_id", "text", "todo")

    def run(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("first", *KEY, "k", "w1", "w2")}
        for doc_id, text, wanted in zip(cols["doc_id"], cols["text"], cols["todo"], strict=True):
            hashes = word_hashes(words_of(text))
            n = np.array([t["windows"] for t in wanted])
            k = np.concatenate([np.arange(x) for x in n])
            at = np.repeat([t["at"] for t in wanted], n) + k
            out["first"].append(np.full(len(k), doc_id))
            for name in KEY:
                out[name].append(np.repeat(np.array([t[name] for t in wanted], np.int64), n))
            out["k"].append(k)
            for name, lane in (("w1", hashes), ("w2", mix(hashes ^ _OTHER))):
                out[name].append(Spans(lane).of(at, at + WINDOW).view(np.int64))
        return {name: np.concatenate([np.empty(0, np.int64), *v]) for name, v in out.items()}

    return map_texts(texts, run, "first long, anchor long, s1 long, s2 long, k int, w1 long, w2 long")


class SubstringIndex:
    """Runs in a folder. The manifest has a folder for each version, with a row for each of its runs; the highest version
    counts. A version is put in place by a rename that fails where it exists, so of two writers that began from one version
    one raises an error, and its runs are never seen."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        manifest = f"{self.path}/manifest"
        self.next, found = next_version(spark, manifest), versions(spark, manifest)
        rows = spark.read.parquet(f"{manifest}/{found[-1][1]}").collect() if found else []
        self.runs = [(r.kind, r.level, r.run) for r in rows if r.run]

    def _commit(self, runs: list[tuple[str, int, str]]) -> None:
        rows = self.spark.createDataFrame(runs or [("", 0, "")], "kind string, level int, run string").coalesce(1)
        put_version(rows, f"{self.path}/manifest", self.next)
        self.next, self.runs = self.next + 1, runs

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def history(self, kind: str) -> DataFrame | None:
        """All rows of the runs of a kind."""
        names = [run for k, _, run in self.runs if k == kind]
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in names]) if names else None

    def compact(self) -> None:
        """Merge the runs of a kind and level into one of the next level while there are ``fanout`` of them."""
        runs = list(self.runs)
        for kind, merge in MERGE.items():
            level = 0
            while level <= max((n for k, n, _ in runs if k == kind), default=-1):
                own = [r for r in runs if r[:2] == (kind, level)]
                if len(own) >= self.fanout:
                    rows = self.spark.read.parquet(*[f"{self.path}/{r[2]}" for r in own])
                    runs = [r for r in runs if r not in own] + [(kind, level + 1, self._write(merge(rows)))]
                level += 1
        if runs != self.runs:
            self._commit(runs)

    def add(self, found: DataFrame, docs: DataFrame) -> DataFrame:
        """Resolve a batch of entries against the runs and itself, then add its runs. docs holds the texts of the batch and
        of all earlier ones. doc_id, mark, cuts: ranges (from, to) of windows that start in an earlier document, too."""
        self.compact()
        one = found.select(*KEY, F.col("doc_id").alias("first_doc"), "mark", "at", "windows", F.col("doc_id").alias("last_doc"))
        run = self._write(merged_entries(one))
        both = self.spark.read.parquet(f"{self.path}/{run}").withColumn("old", F.lit(False))
        past, compared, known = (self.history(k) for k in ("entries", "compared", "windows"))
        if past is not None:
            met = past.join(both.select("anchor").distinct(), "anchor", "left_semi")
            both = both.unionByName(keep(met.withColumn("old", F.lit(True)), "substring-met"))
        kind = F.struct("s1", "s2")
        anchors = both.groupBy("anchor").agg(F.min("first_doc").alias("lo"), F.max("last_doc").alias("hi"), (F.min(kind) != F.max(kind)).alias("several"))
        shared = both.join(anchors.where("lo < hi").drop("lo", "hi"), "anchor")
        firsts = shared.groupBy(*KEY).agg(F.min(F.struct(*FIRST, "old")).alias("f"), F.max("last_doc").alias("last_doc"), F.bool_or("several").alias("several"))
        firsts = keep(firsts.select(*KEY, "f.*", "last_doc", "several"), "substring-firsts")
        todo = firsts.where("several")
        if compared is not None:
            todo = todo.where("not old").unionByName(todo.where("old").join(compared, KEY, "left_anti"))
        todo = keep(todo.select(*KEY, *FIRST), "substring-todo")
        made = keep(windows_of(todo, docs), "substring-windows")
        held = made.select("w1", "w2", "first")
        if known is not None:
            held = held.unionByName(known.join(held.select("w1", "w2").distinct(), ["w1", "w2"], "left_semi"))
        least = held.groupBy("w1", "w2").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most")
        earlier = made.join(least, ["w1", "w2"]).where("least < first")
        earlier = earlier.groupBy(*KEY).agg(F.collect_set("k").alias("ks"))  # of one stretch: at most WINDOW - ANCHOR + 1
        judged = firsts.select(*KEY, "first_doc", "last_doc").join(earlier, KEY, "left").where("first_doc < last_doc or ks is not null")
        judged = keep(judged.drop("last_doc"), "substring-judged")  # a side of its own, so that a hot stretch of found is split
        whole = F.array(F.struct(F.col("at").alias("from"), (F.col("at") + F.col("windows")).alias("to")))
        single = F.transform("ks", lambda k: F.struct((F.col("at") + k).alias("from"), (F.col("at") + k + 1).alias("to")))
        lost = found.join(judged, KEY)  # a stretch's later holders lose it whole, its first what others had
        lost = lost.select("doc_id", "mark", F.when(F.col("first_doc") < F.col("doc_id"), whole).otherwise(single).alias("cuts")).where("cuts is not null")
        cuts = keep(lost.groupBy("doc_id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("cuts"))).alias("cuts")), "substring-cuts")
        self._commit([*self.runs, ("entries", 0, run), ("windows", 0, self._write(merged_windows(made))), ("compared", 0, self._write(merged_keys(todo)))])
        return cuts


def without_repeats(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs. cuts: rows of doc_id, mark and their ranges."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    inner = cuts.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "cuts")
    same = (F.col("doc_id") == F.col("__id")) & (F.col("mark") == F.col("__mark"))
    n = cuts.count()
    if n <= BROADCAST_ROWS:  # only the texts that lose words travel
        ids = F.broadcast(inner.select("__id", "__mark"))
        rest = texts.join(ids, same, "left_anti").select("doc_id", "text", F.lit(None).cast(cuts.schema["cuts"].dataType).alias("cuts"))
        texts = texts.join(ids, same, "left_semi").join(inner, same).select("doc_id", "text", "cuts").unionByName(rest)
    else:
        texts = texts.join(inner, same, "left").select("doc_id", "text", "cuts")

    def run(cols: dict) -> dict:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
        for text, cut in zip(cols["text"], cols["cuts"], strict=True):
            words = words_of(text)
            kept = words
            if cut:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [c["from"] for c in cut], 1)
                np.add.at(edge, [c["to"] + WINDOW - 1 for c in cut], -1)
                kept = [w for w, gone in zip(words, np.cumsum(edge[:-1]) > 0, strict=True) if not gone]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(sha256(b" ".join(kept)).hexdigest())
        return {"doc_id": cols["doc_id"], **out}

    return map_texts(texts, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, batches: int = BATCHES, path: str | None = None) -> DataFrame:
    """The whole table as batches of ascending doc_id, each resolved against the index of those before it."""
    spark = docs.sparkSession
    found = keep(entries(docs), "substring-entries")
    least, most = found.agg(F.min("doc_id"), F.max("doc_id")).first()
    index = SubstringIndex(spark, path or f"{tables_dir(spark)}/substring-index-{uuid.uuid4().hex}")
    cuts = []
    for b in range(batches if least is not None else 1):
        low, last = (least + (most - least + 1) * b // batches, least + (most - least + 1) * (b + 1) // batches - 1) if least is not None else (0, 0)
        cuts.append(index.add(found.where(F.col("doc_id").between(low, last)), docs.where(F.col("doc_id") <= last)))
    whole = cuts[0]
    for c in cuts[1:]:
        whole = whole.unionByName(c)
    return without_repeats(docs, whole)
