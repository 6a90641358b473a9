"""Personal data by boosted trees over candidate spans.

Base spans are the matches of four fixed formats that pass a fixed check; they always stay. High-recall generators also
propose looser, overlapping spans: addresses with spelled-out or spaced signs, number groups with other separators,
numbers without a country sign, and card-like groups inside longer rows of digits, which the fixed formats take as one
match and drop. Boosted trees score a candidate by its format and its surroundings.

The trees learn from every lesson of every row. Equal lessons are counted by Spark and growing takes sums from tasks
(``boosting.fit_rows``), so their number is not bounded by a machine. Sure lessons are base spans, base spans rewritten in a
looser format in the place where they stand, and broken so that their check fails. Natural candidates are judged by evidence
from elsewhere: one that spells the same value as a base span of any document is right; one whose parts or digits are out of
range for its kind is wrong. What nobody can judge counts as a wrong one of weight DOUBT. The Luhn sum is a feature and labels
no candidate: broken cards keep their format and digits, in another order, and as one in ten of these passes it, too, they
weigh DOUBT. Every lesson also sets its kind's threshold, by the score that trees without its fold (by a hash of document and
place) give it: the least score at which the weighted precision is PRECISION; a kind that never reaches it adds nothing. What is
found is scored by trees that learned from all folds. Where added spans of a kind overlap, the higher score wins (ties: the
earlier, then the longer one).

Null text is empty. Rows that repeat are judged each; empty input gives an empty result; very long texts and texts of a
million candidates take time and memory in proportion; extra columns are ignored by ``find_pii`` and carried by
``redact``. Without base spans nothing is added.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scans
from .boosting import CHUNK, TASKS, BoostedTrees, binned, fit_rows, scored
from .common import keep, map_texts

KINDS = ("email", "ip", "card", "phone")
#: Parts of the lessons; each is scored by trees that learned from the others when thresholds are set.
FOLDS = 2
PRECISION = 0.95
#: Weight of a natural candidate that no check and no other document judges.
DOUBT = 0.25

# Fixed formats of the base spans.
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match always begins a run of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidate generators.
LOOSE = (
    (0, re.compile(r"(?<![\w.])[\w.+-]{1,64} ?(?:@|\(at\)|\[at\]|\bat\b) ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\bdot\b) ?[\w-]{2,63}){1,4}")),
    (1, re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?[.,] ?|-)[0-9]{1,3}){3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{0,2}[0-9]{2,6}){2,5}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}[0-9]{0,3}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])(?:00|\+|\()?[0-9]{1,4}(?:[ ()./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])")),
)
#: What every match of the first pattern holds: @, or at as a word, bracketed or not.
SIGN = re.compile(r"@|\bat\b")
HINTS = (re.compile(r"mail|contact|write", re.I), re.compile(r"\bip\b|host|server|addr", re.I), re.compile(r"card|visa|credit|pay", re.I), re.compile(r"tel|phone|call|fax|mobil", re.I))
FEATURES = 20


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start."""
    out = []
    at, free = text.find("@"), 0  # free: where a local part may begin at the earliest
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL_PART)) if at > free else at
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if not any(d in text for d in "0123456789"):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split("."))]
    for kind, pattern in ((2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            digits = digits_of(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    signs = SIGN.search(text) is not None
    numbers = any(d in text for d in "0123456789")
    return [(kind, m.start(), m.end()) for kind, pattern in LOOSE if (numbers if kind else signs) for m in pattern.finditer(text)]


class Taken:
    """Disjoint or nested stretches of a text; whether a span meets one is a search, not a scan."""

    def __init__(self, spans: list[tuple[int, int, int]] = ()):
        self.starts, self.ends = [], []
        for _, s, e in sorted(spans, key=lambda x: x[1:]):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, span: tuple[int, int, int]) -> bool:
        k = bisect_right(self.ends, span[1])
        return k < len(self.starts) and self.starts[k] < span[2]

    def add(self, span: tuple[int, int, int]) -> None:
        """A span that meets none."""
        insort(self.starts, span[1])
        insort(self.ends, span[2])


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that touch no base span, each once."""
    taken = Taken(base)
    return list(dict.fromkeys(c for c in candidates(text) if not taken.meets(c)))


def spelled(kind: int, span: str) -> str:
    """The value that a span of any format spells: an address with its signs, or digits."""
    if kind:
        digits = re.sub("[^0-9]+", "." if kind == 1 else "", span).strip(".")
        return digits[-10:] if kind == 3 else digits
    whole = re.sub(r" ?(?:\(at\)|\[at\]|\bat\b|@) ?", "@", span.lower(), count=1)
    return re.sub(r" ?(?:\(dot\)|\[dot\]|\bdot\b|\.) ?", ".", whole)


def judged(kind: int, span: str) -> bool | None:
    """False for a natural candidate that is out of range for its kind, else None: others have to tell."""
    digits = digits_of(span)
    if kind == 1:
        return None if all(int(g) <= 255 for g in re.findall("[0-9]+", span)) else False
    if kind == 2:
        return None if 16 <= len(digits) <= 19 else False
    return None if kind == 0 or 8 <= len(digits) <= 15 else False


def described(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and surroundings of a span, as numbers."""
    span, digits = text[start:end], digits_of(text[start:end])
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    groups = re.findall("[0-9]+", span)
    near = text[max(0, start - 40) : start]
    side = lambda c: 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0
    rest = [c for c in span if not c.isalnum()]
    return [
        float(kind), float(len(span)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)), float(len(rest)), float(len(set(rest))), float(sum(c.isalpha() for c in span)),
        float(span.count("@")), float(span.count(".")), float(len(re.findall(r"\bat\b|\bdot\b", span))), float(span[:1] in "+("),
        float(luhn(digits)) if digits else 0.0, float(max((int(g[:9]) for g in groups), default=0) <= 255), float(len(set(digits))),
        side(before), side(after), float(bool(HINTS[kind].search(near))), float(span.count(" ")),
    ]


def rewritten(text: str, kind: int, start: int, end: int, salt: int) -> tuple[str, str]:
    """A looser and a broken form of a base span."""
    span, digits = text[start:end], digits_of(text[start:end])
    if kind == 0:
        sign, dot = ((" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" @ ", "."))[salt % 4]
        local, _, domain = span.partition("@")
        return local + sign + domain.replace(".", dot), local + "@" + domain.replace(".", "")
    if kind == 1:
        parts = span.split(".")
        return ("[.]", ",", " . ", "(.)")[salt % 4].join(parts), ".".join([*parts[:2], str(256 + salt % 600), parts[3]])
    if kind == 2:
        sep = ". /_"[salt % 4]
        grouped = lambda d: sep.join(d[i : i + 4] for i in range(0, len(d), 4))
        return grouped(digits), grouped(digits[:4] + digits[:3:-1])
    national = digits[-10:]
    loose = (f"({national[:3]}) {national[3:6]}-{national[6:]}", f"{national[:3]}-{national[3:6]}-{national[6:]}", f"00{digits[:2]} {digits[2:5]} {digits[5:]}", f"{national[:3]}.{national[3:6]}.{national[6:]}")[salt % 4]
    return loose, digits[:6]


def lessons(text: str, base: list, loose: list):
    """(place, features, right, weight, spelled value where another document may judge) of all that a text teaches."""
    for kind, start, end in base:
        yield (kind, start, 0), described(text, kind, start, end), True, 1.0, None
        for n, form in enumerate(rewritten(text, kind, start, end, zlib.crc32(text[start:end].encode())), 1):
            there = text[max(0, start - 60) : start] + form + text[end : end + 60]
            at = min(60, start)
            yield (kind, start, n), described(there, kind, at, at + len(form)), n == 1, DOUBT if kind == 2 and n == 2 else 1.0, None
    for kind, start, end in loose:
        right = judged(kind, text[start:end])
        value = f"{kind}:{spelled(kind, text[start:end])}" if right is None else None
        yield (kind, start, end), described(text, kind, start, end), bool(right), DOUBT if right is None else 1.0, value


def taught(docs: DataFrame) -> DataFrame:
    """Every lesson of every row: fold, features, right, quarters (four times its weight), value, n (how often). What base
    spans spell has a value and no features."""

    def run(cols: dict) -> dict:
        found: Counter = Counter()
        for doc_id, x in zip(cols["doc_id"], cols["text"], strict=True):
            text = x or ""
            base = base_spans(text)
            for at, features, right, weight, value in lessons(text, base, loose_spans(text, base)):
                found[zlib.crc32(f"{doc_id}:{at}".encode()) % FOLDS, tuple(features), right, int(4 * weight), value] += 1
            found.update((None, None, None, None, v) for v in {f"{k}:{spelled(k, text[s:e])}" for k, s, e in base})
        out = list(zip(*found, strict=True)) or [()] * 5
        return dict(zip(("fold", "features", "right", "quarters", "value"), out, strict=True)) | {"n": list(found.values())}

    return map_texts(docs.select("doc_id", "text"), run, "fold int, features array<double>, right boolean, quarters long, value string, n long")


def lessons_of(docs: DataFrame) -> DataFrame:
    """fold, features, right, quarters, n of all lessons, judged by what base spans of any document spell. Equal lessons are one
    row, so that a value that is everywhere is a few rows: its formats and surroundings."""
    known = keep(taught(docs).groupBy("fold", "features", "right", "quarters", "value").agg(F.sum("n").alias("n")), "pii-taught")
    lesson = known.where("features is not null")
    spelt = known.where("features is null").select("value").distinct().withColumn("agreed", F.lit(True))
    asked = lesson.where("value is not null").join(spelt.hint("merge"), "value", "left")  # sizes of compressed files say little
    judged = asked.withColumn("right", F.col("right") | F.col("agreed").isNotNull()).withColumn("quarters", F.when(F.col("agreed"), 4).otherwise(F.col("quarters")))
    columns = ["fold", "features", "right", "quarters", "n"]
    return keep(lesson.where("value is null").select(*columns).unionByName(judged.select(*columns)), "pii-lessons")


def binned_rows(found: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """fold, kind, codes (bins of the features), right, weight (in quarters, of all equal ones)."""

    def run(cols: dict) -> dict:
        x = np.array(cols["features"])
        weight = [q * n for q, n in zip(cols["quarters"], cols["n"], strict=True)]
        return {"fold": cols["fold"], "kind": x[:, 0].astype(int).tolist(), "codes": [c.tobytes() for c in binned(x, edges)], "right": cols["right"], "weight": weight}

    each = map_texts(found, run, "fold int, kind int, codes binary, right boolean, weight long")
    return keep(each.groupBy("fold", "kind", "codes", "right").agg(F.sum("weight").alias("weight")), "pii-binned")


def train(docs: DataFrame) -> tuple[BoostedTrees, list[float]] | None:
    """Trees and the kinds' thresholds, from all lessons."""
    found = lessons_of(docs)
    quantiles = F.array(*map(F.lit, BoostedTrees().levels().tolist()))
    told = found.agg(F.bool_or("right").alias("some"), *[F.percentile(F.col("features")[j], quantiles, F.col("n")).alias(f"e{j}") for j in range(FEATURES)]).first()
    if not told.some:
        return None
    edges = [np.unique(told[f"e{j}"]) for j in range(FEATURES)]
    rows = binned_rows(found, edges)
    rows = rows.coalesce(min(TASKS, -(-rows.count() // CHUNK)))
    models = fit_rows(rows, edges, FOLDS, one=4)
    each = scored(rows, models).groupBy("kind", (-F.col("raw")).alias("order")).agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("right"), F.col("weight")).otherwise(0)).alias("good"))
    for name in ("all", "good"):
        each = scans.running_sum(each, ["kind"], ["order"], name, f"{name}_to")
    least = {r.kind: -r.order for r in each.where(F.col("good_to") >= PRECISION * F.col("all_to")).groupBy("kind").agg(F.max("order").alias("order")).collect()}
    return models[-1], [float(max(1 / (1 + np.exp(-least[k])), 0.5)) if k in least else 2.0 for k in range(len(KINDS))]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def chosen(text: str, base: list, learned: tuple[BoostedTrees, list[float]] | None) -> list[tuple[int, int, int]]:
    """Loose spans that the trees add, best first; of one kind none that overlap."""
    loose = loose_spans(text, base) if learned else []
    if not loose:
        return []
    model, levels = learned
    score = model.score(np.array([described(text, *c) for c in loose]))
    taken, added = [Taken() for _ in KINDS], []
    for s, c in sorted(zip(score, loose, strict=True), key=lambda v: (-v[0], v[1][1], -v[1][2])):
        if s >= levels[c[0]] and not taken[c[0]].meets(c):
            taken[c[0]].add(c)
            added.append(c)
    return added


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added."""
    learned = train(docs)

    def decide(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for x in cols["text"]:
            text = x or ""
            base = base_spans(text)
            added = chosen(text, base, learned)
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(b[0] == k for b in base))
            out["base_sha256"].append(sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + added))
            out["n_added"].append(len(added))
        return {"doc_id": cols["doc_id"], **out}

    return map_texts(docs.select("doc_id", "text"), decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: str) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first is replaced, to the end of the last."""
    out, at = [], 0
    for kind, s, e in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)), key=lambda x: x[1:]):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of every text, base and added, replaced (null stays null)."""
    learned = train(docs)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            base = base_spans(x or "")
            out.append(None if x is None else redacted(x, joined(base + chosen(x, base, learned))))
        return pa.array(out, pa.string())

    return docs.withColumn("text", run("text"))
