"""Very long words, runs of blanks and chains of special strings."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessellar.llm import packing, queries, token_counts, tokens

LONG = {
    "blanks": " " * 1_000_000,
    "mixed blanks": " \n" * 500_000 + "x",
    "one word": "".join(random.Random(1).choices("abcdefghijklmno", k=1_000_000)),
    "one letter": "a" * 1_000_000,
    "special strings": "<|endoftext|> a" * 10_000,
    "lines": "\n".join("word " * 5 for _ in range(40_000)),
}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.bpe_path())


@pytest.mark.parametrize("name", sorted(LONG))
def test_counts_and_ids_of_long_texts(library, name):
    bpe, text = tokens.load(queries.bpe_path()), LONG[name]
    want = library.encode(text, add_special_tokens=False).ids
    assert bpe.ids(text).tolist() == want
    counts = bpe.prefix_counts(text)
    assert len(counts) == len(text) + 1 and counts[-1] == len(want)
    for k in random.Random(2).sample(range(3000), 20):
        assert counts[k] == len(library.encode(text[:k], add_special_tokens=False).ids)


def test_memory_of_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    bpe = tokens.ByteBpe(queries.bpe_path())
    text = " ".join(f"w{k % 300}x" for k in range(5000))
    assert bpe.prefix_counts(text)[-1] == len(bpe.slow.encode(text, add_special_tokens=False).ids)
    assert len(bpe._steps) <= 50 and len(bpe._steps.old) <= 50


def test_one_table_answers_every_budget(spark, library):
    rows = [(k, t, k) for k, t in enumerate([None, "", "it's <|endoftext|> here  \n\n now", *LONG.values()])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long")
    table = token_counts.prefix_table(docs.drop("n_bytes"), queries.bpe_path(), ("doc_id", "text"))
    for budget in (0, 1, 5, 700):
        for r in token_counts.truncated(table, budget).collect():
            whole = rows[r.doc_id][1]
            assert (r.text is None) == (whole is None)
            if whole is not None:
                assert whole.startswith(r.text) and len(library.encode(r.text, add_special_tokens=False).ids) <= budget
    report = {r.doc_id: r for r in token_counts.budget_report(table, 100).collect()}
    assert [report[k].n_tokens for k, t, _ in rows] == [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    assert token_counts.truncate(docs, queries.bpe_path(), 3).columns == docs.columns


def test_packing_long_texts(spark, library):
    rows = list(enumerate(LONG.values()))
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.bpe_path()).collect()
    for k, text in rows:
        assert sum(p.length for p in pieces if p.doc_id == k) == len(library.encode(text, add_special_tokens=False).ids) + 1
    assert np.all(np.array([p.length for p in pieces]) <= 2048)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts of a megabyte and more, ids at both ends of a long, and a few plain ones."""
    rng = random.Random(9)
    plain = lambda n: " ".join("".join(rng.choices("abdeiklmnorstu", k=rng.randint(2, 8))) for _ in range(n))
    many = plain(150_000)
    rows = [(2**63 - 1, many), (-(2**63), many + " end"), (0, "same " * 200_000), (1, "x" * 1_000_000), (2, "\n".join(plain(12) for _ in range(15_000))), (3, None)]
    rows += [(10 + k, plain(150)) for k in range(40)]
    return spark.createDataFrame([(d, t, "en", f"s{(d % 3)}", len(t or "")) for d, t in rows], SCHEMA).repartition(4)


def test_scores_and_spans_of_long_texts(spark, long_docs):
    from tessellar.llm import brown_lm, mixing, pii, quality_qda, rules

    n = long_docs.count()
    words = {r.doc_id: len((r.text or "").split()) for r in long_docs.collect()}
    lm = {r.doc_id: r for r in brown_lm.score_texts(long_docs).collect()}
    assert len(lm) == n and all(r.n_tokens == words[d] + 1 and np.isfinite(r.score) for d, r in lm.items())
    labels = spark.createDataFrame([(10 + k, k % 2) for k in range(40)], "doc_id long, quality int")
    scores = quality_qda.quality_scores(long_docs, labels).collect()
    assert len(scores) == n and all(0 <= r.score <= 1 for r in scores)
    assert {r.doc_id: r.n_words for r in rules.rule_report(long_docs).collect()} == words
    assert len(pii.find_pii(long_docs).collect()) == n
    assert {r.doc_id: r.tokens for r in mixing.mix_sources(long_docs).collect()}.items() <= {d: w + 1 for d, w in words.items()}.items()


def test_stages_take_long_texts(spark, long_docs):
    import corpus_pipeline
    from tessellar.llm.common import keep

    docs, kept = long_docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, "/unused"), "long-stage")
        assert docs.columns == long_docs.columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0 not in kept["quality rules"] and {2**63 - 1, -(2**63), 2} <= kept["quality rules"]  # repeated words go
    assert kept["n-gram join"] == kept["exact dedup"] - {2**63 - 1}  # of two near copies the smaller id stays
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/unused")
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == kept["source mix"]
