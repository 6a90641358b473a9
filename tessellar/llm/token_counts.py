"""Exact token counts by prefix dynamic programming.

``prefix_table`` runs the dynamic program once over each text and stores what it gives: for every code point the change
of the token count, as int16 (``ByteBpe.steps``). The running sum is the exact count of every prefix, so the count of a
text, the question whether it is over a limit, and its longest prefix within a budget are read from the stored table;
nothing is encoded again. The program itself runs over the bytes of distinct pre-tokens.

Null text is empty: 0 bytes, 0 tokens, an empty table. Rows that repeat are counted each; empty input gives an empty
result; extra columns are carried by ``prefix_table`` where asked and by ``truncate``, and ignored otherwise. Special
strings in a text are single tokens, as the library has it. Time and memory are linear in a text, however long its words
and runs of blanks; a table takes two bytes a code point in memory and about a tenth of that in its files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import keep, map_texts, small_batches

LIMIT = 1024


def prefix_table(docs: DataFrame, path: str, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_bytes (UTF-8) and token_steps of every row of docs, in the shared folder."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def steps(texts: pa.Array) -> pa.Array:
        bpe = tokens.load(path)
        return pa.array([bpe.steps(x or "") for x in texts.to_pylist()], pa.binary())

    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return keep(docs.select(*carried, size.alias("n_bytes"), steps("text").alias("token_steps")), "token-prefixes")


def counts_of(steps: bytes) -> np.ndarray:
    """Tokens of every prefix, the empty one first."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int16), dtype=np.int64)])


def within(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most budget tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def budget_report(table: DataFrame, limit: int = LIMIT) -> DataFrame:
    """From a prefix table alone: doc_id, n_bytes, n_tokens, over_limit, chars_within (code points of the longest prefix
    within the limit)."""

    def run(cols: dict) -> dict:
        totals, fit = [], []
        for steps in cols["token_steps"]:
            counts = counts_of(steps)
            totals.append(int(counts[-1]))
            fit.append(within(counts, limit))
        return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"], "n_tokens": totals, "over_limit": [n > limit for n in totals], "chars_within": fit}

    return map_texts(table.select("doc_id", "n_bytes", "token_steps"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within long")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chars_within for every row of docs."""
    return budget_report(prefix_table(docs, path), limit)


def truncated(table: DataFrame, budget: int) -> DataFrame:
    """A prefix table that carries text, with every text cut to its longest prefix of at most budget tokens (null stays
    null). Other budgets are other calls on the same table."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, steps: pa.Array) -> pa.Array:
        both = zip(texts.to_pylist(), steps.to_pylist(), strict=True)
        return pa.array([None if x is None else x[: within(counts_of(s), budget)] for x, s in both], pa.string())

    return table.withColumn("text", cut("text", "token_steps")).drop("n_bytes", "token_steps")


def truncate(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """docs with every text cut to its longest prefix of at most budget tokens."""
    own = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("__own")
    cut = truncated(prefix_table(docs.select("text", own), path, ("text", "__own")), budget)
    return cut.select(*[F.col("text") if c == "text" else F.col("__own").getField(c).alias(c) for c in docs.columns])
