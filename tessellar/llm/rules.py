"""Quality rules as a short-circuit cascade.

Each rule is a test of one text over facts (words, repeated words, symbols, lines, letters) that rules share and that are
worked out when first asked for. A sample (SAMPLE_DOCS rows on average, drawn over all partitions) tells what a fact and
a test cost and which texts a rule rejects. The order is greedy: next comes the rule with the most rejections per second
among the texts that the rules before it left, where facts that those rules have worked out cost nothing any more. Every
text then meets the rules in that order and leaves at the first that rejects it. A text is kept when no rule rejects it,
so the order changes the work and never the verdict.

``filter_quality`` works out only what the cascade asks for. ``rule_report`` has to give the facts themselves; its cascade
is ordered for what is left.

Null text is empty and has no words: the rule on length rejects it. Rows that repeat are judged each for itself; empty
input gives an empty result; very long texts take time and memory in proportion; extra columns are carried by
``filter_quality`` and ignored by ``rule_report``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_stats as st
from .common import map_texts, small_batches

#: Rows of the sample that costs and selectivities come from, on average.
SAMPLE_DOCS = 1000
#: What rules share, each after what it is worked out from.
FACTS = ("data", "words", "ids", "symbols", "lines", "repeats", "capitals")


class Text:
    """One text; what several rules need is worked out once, and only when asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def symbols(self) -> int:
        return st.n_symbols(self.text)

    @cached_property
    def lines(self) -> tuple[int, int]:
        return st.dup_lines(self.text)

    @cached_property
    def ids(self) -> tuple[np.ndarray, int]:
        return st.word_ids(self.words)

    @cached_property
    def repeats(self) -> int:
        return st.repeat_words(*self.ids)

    @cached_property
    def capitals(self) -> float:
        return st.upper_share(self.data)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]
    facts: tuple[str, ...] = ("data", "words")


#: Base rules (the first two) and what else marks a text as junk.
RULES = (
    Rule("short", lambda t: len(t.words) < 50),
    Rule("repeats", lambda t: 100 * t.repeats > 50 * len(t.words), ("data", "words", "ids", "repeats")),
    Rule("symbols", lambda t: 10 * t.symbols > len(t.words), ("data", "words", "symbols")),
    Rule("exclamations", lambda t: 2 * t.text.count("!") > len(t.words)),
    Rule("shouting", lambda t: t.capitals > 0.6, ("data", "capitals")),
    Rule("same_lines", lambda t: 2 * t.lines[1] > t.lines[0], ("lines",)),
    Rule("few_kinds", lambda t: 20 * t.ids[1] < min(len(t.words), 2000), ("data", "words", "ids")),
    Rule("digits", lambda t: 2 * (len(t.data) - len(t.data.translate(None, b"0123456789"))) > len(t.data), ("data",)),
    Rule("links", lambda t: 4 * t.text.count("://") > len(t.words)),
    Rule("unprintable", lambda t: 100 * (t.text.count("\ufffd") + t.text.count("\x00")) > len(t.text), ()),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE_DOCS, known: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Rules by rejections per cost on a sample, each given those before it: among the texts they left, with the facts
    they worked out. ``known`` facts cost nothing from the start. Nothing but the order depends on the costs."""
    n = docs.count()
    if not n:
        return rules
    some = docs.select("text").sample(min(1.0, sample / n), seed=1)

    def measure(cols: dict) -> dict:
        out: dict[str, list] = {"rejected": [], "facts": [], "tests": []}
        clock = time.perf_counter
        for x in cols["text"]:
            t, marks, verdicts = Text(x), [clock()], []
            for fact in FACTS:
                getattr(t, fact)
                marks.append(clock())
            for rule in rules:
                verdicts.append(bool(rule.rejects(t)))
                marks.append(clock())
            spent = [b - a for a, b in zip(marks, marks[1:])]
            for held, v in zip(out.values(), (verdicts, spent[: len(FACTS)], spent[len(FACTS) :]), strict=True):
                held.append(v)
        return out

    seen = map_texts(some, measure, "rejected array<boolean>, facts array<double>, tests array<double>").collect()
    mean = lambda name, i: 1e-9 + sum(r[name][i] for r in seen) / max(len(seen), 1)
    fact_cost = {f: mean("facts", i) for i, f in enumerate(FACTS)}
    return by_worth(rules, [r.rejected for r in seen], [mean("tests", i) for i in range(len(rules))], fact_cost, set(known))


def by_worth(rules: tuple[Rule, ...], rejected: list, test_cost: list[float], fact_cost: dict[str, float], known: set[str]) -> tuple[Rule, ...]:
    """The greedy order. Ties go to the cheaper rule, then to the earlier one."""
    left, order, todo, known = list(range(len(rejected))), [], list(range(len(rules))), set(known)
    while todo:
        cost = {i: test_cost[i] + sum(fact_cost[f] for f in rules[i].facts if f not in known) for i in todo}
        best = max(todo, key=lambda i: (sum(rejected[j][i] for j in left) / cost[i], -cost[i], -i))
        order.append(rules[best])
        todo.remove(best)
        known |= set(rules[best].facts)
        left = [j for j in left if not rejected[j][best]]
    return tuple(order)


def passes(text: Text, cascade: tuple[Rule, ...]) -> bool:
    """Short-circuit: any() stops at the first rule that rejects."""
    return not any(rule.rejects(text) for rule in cascade)


def rule_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    cascade = order_rules(docs, rules, known=("data", "words", "ids", "symbols", "lines", "repeats"))

    def judge(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")}
        for x in cols["text"]:
            t = Text(x)
            base = len(t.words) < 50 or 100 * t.repeats > 50 * len(t.words)
            row = (len(t.words), st.word_chars(t.text), t.symbols, t.lines[1], t.repeats, base, not base and passes(t, cascade))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"doc_id": cols["doc_id"], **out}

    return map_texts(docs.select("doc_id", "text"), judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that every rule lets pass, with all their columns."""
    cascade = order_rules(docs, rules)
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def passing(texts: pa.Array) -> pa.Array:
        return pa.array([passes(Text(x), cascade) for x in texts.to_pylist()], pa.bool_())

    return docs.where(passing("text"))
