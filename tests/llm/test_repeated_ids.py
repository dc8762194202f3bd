"""Near-duplicate removal, mixing and search where ids repeat."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from knotwork.llm import cover_search, fair_mix
from tests.llm import plain


def test_rows_are_told_apart_by_id_and_text(spark):
    words = [f"w{i}" for i in range(40)]
    a, near, b, p = " ".join(words), " ".join([*words, "more"]), " ".join(f"b{i}" for i in range(30)), " ".join(f"p{i}" for i in range(30))
    data = [(2, a, "en"), (4, near, "en"), (4, b, "en"), (6, p, "fr"), (6, p, "en"), (7, p, "en"), (8, "", "en"), (8, "", "en"), (9, None, "en"), (None, a, "en")]
    rows = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in data], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, rows, "")
    assert out.columns == rows.columns
    found = sorted(((r["doc_id"], r["text"], r["lang"]) for r in out.collect()), key=str)
    assert found == sorted([(2, a, "en"), (4, b, "en"), (6, p, "en"), (8, "", "en"), (8, "", "en"), (9, None, "en"), (None, a, "en")], key=str)


@pytest.mark.parametrize("texts", [["w " * 30], ["w " * 30, "v " * 20, "w " * 10]])
def test_mixed_rows_are_as_many_words_as_the_mix_takes(spark, texts):
    """Many rows of one id and source, with equal texts or not, and sources that run dry before others."""
    data = [(7, texts[i % len(texts)], "en", "a", i) for i in range(119)] + [(None, "x y z", "en", None, 0)] * 3 + [(8, "q " * 700, "en", "b", 0)] + [(9, None, "en", "b", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = fair_mix.fair_mix(docs)
    out = fair_mix.mixed_rows(docs, mixed)
    assert out.columns == docs.columns
    taken, got = ({(r["doc_id"], r["source"]): r["n"] for r in df.collect() if r["n"]} for df in (mixed.groupBy("doc_id", "source").agg({"taken": "sum"}).toDF("doc_id", "source", "n"), out.selectExpr("doc_id", "source", "size(filter(split(text, ' '), w -> w <> '')) as n").groupBy("doc_id", "source").sum("n").toDF("doc_id", "source", "n")))
    assert got == taken and taken


def test_mix_comes_in_order_of_finish_times(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", f"s{i % 3}", 0) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r["doc_id"]: r for r in fair_mix.fair_mix(docs).collect()}
    out = [r["doc_id"] for r in fair_mix.mixed_rows(docs, fair_mix.fair_mix(docs)).collect()]
    expected = sorted((r["finish"] + c * r["cycle"], i) for i, r in rows.items() for c in range(r["taken_copies"]))
    assert out == [i for _, i in expected]


def test_repeated_query_rows(spark):
    """A query's twin asks nothing again; one id with two vectors asks with both, and the best of both count."""
    rng = np.random.default_rng(3)
    rows = [(i + 1, rng.normal(size=4).tolist()) for i in range(57)]
    asks = [(20 * 5, [1.0, 0.0, 0.0, 0.5]), (20 * 5, [1.0, 0.0, 0.0, 0.5]), (20 * 6, [0.0, 1.0, 0.0, 0.0]), (20 * 6, [0.0, 0.0, -1.0, 0.0])]
    rows = [r for r in rows if r[0] % 20] + asks
    found = sorted(tuple(r) for r in cover_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=8).collect())
    assert found == plain.top_k_by_id(rows)
    first = [r for r in found if r[0] == 100]
    assert len(first) == 20
