"""The pipeline, stage by stage, against brute force; and run() against the stages."""

from __future__ import annotations

import ast
from collections import Counter

import duckdb
import pytest
from conftest import TABLES
from test_pairs_and_copies import awkward, jaccard_components
from test_texts import brute_rules, check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from tessellar.llm import queries, rules
from tessellar.llm.common import documents

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def held(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output, written and read again."""
    out, df = [], documents(spark, TABLES)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, df, TABLES).write.parquet(path)
        out.append((df, spark.read.parquet(path)))
        df = out[-1][1]
    return out


def test_columns_stay(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_rules_stage(stages):
    before, after = stages[0]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert held(after) == Counter((d, t) for d, t in rows if rules.passes(rules.Text(t), rules.RULES))
    assert not any(brute_rules(t)[1] for _, t in held(after))


def test_copy_stages(stages):
    before, after = stages[1]
    import re

    first = {}
    for d, t in held(before):
        body = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        first[body] = min(first.get(body, d), d)
    assert {d for d, _ in held(after)} == set(first.values())
    before, after = stages[2]
    rows = sorted(held(before))
    keep = {d for d, _, c in map(ast.literal_eval, jaccard_components(rows)) if d == c}
    assert {d for d, _ in held(after)} == keep


def test_mixing_stage(spark, stages, tmp_path):
    before, after = stages[3]
    before.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = Counter(r[0] for r in con.execute(f"select doc_id from ({queries.MIX_SQL})").fetchall())
    assert Counter(r.doc_id for r in after.select("doc_id").collect()) == want


def test_packing_stage(stages):
    before, after = stages[4]
    texts = [(r.doc_id, r.text) for r in before.collect()]
    assert check_packing(after.collect(), texts, Tokenizer.from_file(queries.bpe_path()), 2048) == 0


def test_run(spark, stages):
    final = corpus_pipeline.run(spark, TABLES)
    pieces = lambda df: Counter((r.doc_id, r.doc_tokens) for r in df.where("start = 0").collect())
    assert pieces(final) == pieces(stages[4][1])


def test_odd_rows_pass_every_stage(spark):
    rows = [(d, t, "en", s, None) for d, t, _, s in awkward()]
    df = spark.createDataFrame(rows, COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, TABLES)
    assert df.count() > 0
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, TABLES)
    assert empty.count() == 0
