"""run() against a plain version, stage by stage on the same input."""

from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from knotwork.llm.fair_mix import fair_mix
from knotwork.plans.materialize import written
from tests.llm import plain


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]

    before = docs.collect()
    docs = written(stages["language ID"](spark, docs, small), "t")
    after = {r["doc_id"]: r for r in docs.collect()}
    assert docs.columns == columns and set(after) == {r["doc_id"] for r in before if r["text"] and any(c.isalpha() for c in r["text"])}
    assert np.mean([after[r["doc_id"]]["lang"] == r["lang"] for r in before if r["doc_id"] in after]) > 0.95

    rows = [(r["doc_id"], r["text"]) for r in after.values()]
    docs = written(stages["n-gram Jaccard join"](spark, docs, small), "t")
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == {i for i, _, c in plain.jaccard_components(rows) if i == c}

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = written(stages["substring dedup"](spark, docs, small), "t")
    texts = dict(rows)
    expected = {i: kept if gone else texts[i] for i, n, gone, kept in plain.dedup(rows) if not gone or gone < n}
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == expected

    copies = {r["doc_id"]: r["taken_copies"] for r in fair_mix(docs).collect() if r["taken_copies"]}
    docs = written(stages["mixing sources to target weights"](spark, docs, small), "t")
    assert docs.columns == columns and {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == copies

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages["byte-level BPE encoding and decoding"](spark, docs, small).collect())
    plain_ids = [(r["doc_id"], bpe.encode_ordinary(r["text"]), r["text"]) for r in docs.collect()]
    assert found == sorted((i, len(ids), plain.sha(np.array(ids, "<u4").tobytes()), plain.sha(t.encode())) for i, ids, t in plain_ids)
    assert found == sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, small).collect())


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stage_takes_an_empty_table(spark, small, stage):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, small).count() == 0


def test_stages_on_awkward_rows(spark):
    """Null ids, texts and sources, repeated ids and rows, empty and very long texts, one after another."""
    rng = random.Random(4)
    words = "the house and the street with some of what they have said about it".split()
    prose = [" ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(n)) for n in (120, 90, 70, 3_000)]
    data = [(1, prose[0], "a"), (2, prose[0] + " tail", "b"), (2, prose[1], "b"), (2, prose[1], None), (3, None, "a"), (4, "", "a"), (5, " \t\n", "a"), (6, "12 34", "a")]
    data += [(None, prose[0], "a"), (None, prose[0], "a"), (7, prose[2] + " x " + prose[1], "c"), (8, prose[3], None), (9, prose[3] + " " + prose[2], "c")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in data], "doc_id long, text string, lang string, source string, n_chars long")
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    first = written(stages[0](spark, docs, ""), "t")
    with_letters = [(i, t) for i, t, _ in data if t and any(map(str.isalpha, t))]
    assert key(first) == sorted(with_letters, key=str) and first.columns == docs.columns
    second = written(stages[1](spark, first, ""), "t")
    # 2 (with tail) is near 1; of the equal rows of id 2 one stays; null ids link nothing.
    expected = [(1, prose[0]), (2, prose[1]), (None, prose[0]), (None, prose[0]), (7, prose[2] + " x " + prose[1]), (8, prose[3])]
    assert key(second) == sorted(expected, key=str)
    third = written(stages[2](spark, second, ""), "t")
    assert key(third) == sorted(((i, kept if gone else t) for (i, t), (_, n, gone, kept) in zip(expected, plain.dedup(expected), strict=True) if not gone or gone < n), key=str)
    fourth = written(stages[3](spark, third, ""), "t")
    taken = {(r["doc_id"], r["source"]): r["n"] for r in fair_mix(third).groupBy("doc_id", "source").sum("taken_copies").toDF("doc_id", "source", "n").collect() if r["n"]}
    assert {(r["doc_id"], r["source"]): r["count"] for r in fourth.groupBy("doc_id", "source").count().collect()} == taken
    last = stages[4](spark, fourth, "").collect()
    assert sorted(r["decoded_sha256"] for r in last) == sorted(plain.sha(t.encode()) for _, t in key(fourth))


def test_further_columns_pass_through(spark):
    """Named like results of the stages, or like their own helper columns, and a map among them."""
    rng = random.Random(12)
    words = "the house and the street with some of what they have said about it".split()
    texts = [" ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(80)) for _ in range(6)]
    texts += [texts[0], texts[1]]
    names = ["n_words", "n_removed", "kept_text", "lang_pred", "lang_score", "lang_spans", "size", "target", "__key", "gone", "component"]
    rows = [(min(i, 6), t, "en", "ab"[i % 2], len(t), *(f"{name} {t[:9]}" for name in names), {"k": t[:9]}) for i, t in enumerate(texts)]
    rows += [rows[2], rows[3]]  # repeated rows: the smallest of them stays
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{name} string" for name in names) + ", tags map<string,string>"
    docs = spark.createDataFrame(rows, schema)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), "t")
        assert docs.columns == spark.createDataFrame(rows, schema).columns
        found = docs.collect()
        assert found and all(r[name] == f"{name} {r['text'][:9]}" for r in found for name in names) and all(r["tags"] == {"k": r["text"][:9]} for r in found)
        kept.append({r["doc_id"] for r in found})
    assert kept[1] == kept[2] == set(range(6)) >= kept[3]  # the mix takes a share of each source


def _shuffled_rows(spark, action):
    """Rows that the action's stages write to shuffles."""
    core = spark.sparkContext._jsc.sc()

    def stages():
        core.listenerBus().waitUntilEmpty()
        found = core.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    action()
    return sum(n for k, n in stages().items() if k not in before)


def test_unmarked_texts_do_not_travel(spark):
    """Of 600 rows, 20 have copies; the other texts stay where they are when those are left out, with no table small enough to be broadcast by itself."""
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(600)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] + [(1_000 + i, texts[i], "en", "b", len(texts[i])) for i in range(10)]
    rows += [rows[i] for i in range(20, 30)]  # whole rows twice
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        found = []
        assert _shuffled_rows(spark, lambda: found.extend(kept.collect())) < 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(r["doc_id"] for r in found) == list(range(600))
