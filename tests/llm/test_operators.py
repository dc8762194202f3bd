"""The operators against plain versions, DuckDB, other libraries, and held-out rows."""

from __future__ import annotations

import base64
import io
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from knotwork.llm import byte_bpe, cover_search, fair_mix, jaccard_join, language_id, media, preference_format, quality, queries, substring_dedup, url_filters
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


def awkward(spark):
    """Nulls everywhere, empty and long texts, repeats, an id twice, and columns named like results and helpers."""
    rng = random.Random(5)
    words = ["Ab", "cd", "ef,", "gh", "ij", "kl", "é", "漢字", "mn", "x\x0by"]
    long = " ".join(rng.choice(words) for _ in range(9_000))
    passage = " ".join(rng.choice(words) for _ in range(80))
    texts = [(1, long), (2, passage), (3, "start " + passage + "  end\n"), (4, passage), (4, "other " + passage), (4, passage), (5, ""), (6, None), (7, " \t\n"), (None, passage), (None, None), (8, long + " tail"), (9, "one"), (10, "One"), (11, "same " * 300), (12, "same " * 400)]
    rows = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", None, "k", 1, [1]) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + ", kept_text string, n_words int, spans array<int>"), texts


def bag(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# --- 1 ---------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("parts", [{}, {"fan": 5, "block_rows": 16, "data_blocks": 2, "query_blocks": 2}, {"fan": 3, "block_rows": 10, "most_levels": 2, "most_cells": 4}])
def test_top_k(spark, parts):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] * (i % 3) + rng.normal(size=6) * 0.1).tolist(), 0) for i in range(260)]
    rows += [(300 + i, [0.5] * 6, 0) for i in range(60)]  # one vector, many times
    rows += [(400, None, 0), (420, [None] * 6, 0), (440, [float("nan")] * 6, 0), (460, [float("inf")] * 6, 0), (480, [], 0), (None, [1.0] * 6, 0), (500, [1.0, 2.0], 0), (501, [3.0, -1.0], 0)]
    rows += [(520, [1e12] * 6, 0)]
    found = bag(cover_search.top_k(vectors(spark, rows), **parts), "query_id", "rank", "vec_id", "score")
    clip = lambda s: max(min(s, (1 << 63) - 1), -(1 << 63))
    expected = [(q, r, i, clip(s)) for q, r, i, s in plain.top_k([r[:2] for r in rows])]
    assert found == sorted(expected, key=str)


def test_top_k_of_nothing(spark):
    assert cover_search.top_k(vectors(spark, [])).count() == 0
    assert cover_search.top_k(vectors(spark, [(0, [1.0], 0)])).count() == 0


def test_cover_bound_prunes_nothing_needed():
    rng = np.random.default_rng(2)
    data, ids = np.floor(rng.normal(size=(700, 5)) * 64), np.arange(700)
    tree = cover_search.Tree(data)
    queries = cover_search.query_side(tree, ids, ids % 17 == 0)
    best = cover_search.Best(queries.ids, 7)
    cover_search.dual_search(queries, best, cover_search.Side.unpacked(cover_search.data_side(tree, ids).packed()))
    assert len(queries.ids) == 42
    for q, row in zip(queries.ids.tolist(), best._kept, strict=True):
        scores = (data[q] @ data.T).astype(int)
        expected = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:7]
        assert sorted(zip((-row[0]).tolist(), row[1].tolist(), strict=True)) == expected


def test_cover_tree_rules():
    """Nodes cover their rows within their radius, children lie within and halve it, are apart, and hold the parent's centre."""
    rng = np.random.default_rng(5)
    data = np.floor(np.concatenate([rng.normal(size=(300, 3)) * 4 + c for c in rng.normal(size=(6, 3)) * 200]))
    tree = cover_search.Tree(data)
    vectors = data[tree.order]
    assert sorted(tree.order.tolist()) == list(range(len(data))) and len(tree.begin) > 20
    for i, (begin, end, centre, radius) in enumerate(zip(tree.begin, tree.end, tree.centre, tree.radius, strict=True)):
        assert begin <= centre < end
        assert np.isclose(np.linalg.norm(vectors[begin:end] - vectors[centre], axis=1).max(), radius)
        children = [j for j, p in enumerate(tree.parent) if p == i]
        if children:
            assert sum(tree.end[j] - tree.begin[j] for j in children) == end - begin and any(tree.centre[j] == centre for j in children)
            assert all(tree.radius[j] <= radius / 2 for j in children)
            apart = [np.linalg.norm(vectors[tree.centre[a]] - vectors[tree.centre[b]]) for a in children for b in children if a < b]
            assert min(apart) > radius / 2


def test_cover_tree_compares_less_than_it_holds():
    """On ten times the rows a query is compared with far fewer than ten times as many."""
    rng = np.random.default_rng(6)
    per_query = []
    for n in (2_000, 20_000):
        centres = rng.normal(size=(n // 50, 4)) * 300
        data, ids = np.floor(centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 4)) * 3), np.arange(n)
        tree = cover_search.Tree(data)
        queries = cover_search.query_side(tree, ids, ids % 20 == 0)
        best = cover_search.Best(queries.ids, 20)
        cover_search.dual_search(queries, best, cover_search.data_side(tree, ids))
        per_query.append(best.compared / len(queries.ids))
    print("rows compared for each query, of 2,000 and of 20,000:", per_query)
    assert per_query[0] < 2_000 / 2 and per_query[1] < 5 * per_query[0]


# --- 2 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_rows", [2_000, 2])
def test_substring_dedup(spark, docs, block_rows):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = substring_dedup.remove_duplicate_spans(docs, block_rows=block_rows)
    assert bag(found, "doc_id", "n_words", "n_removed", F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " ")) == sorted(plain.dedup(rows), key=str)


@pytest.mark.parametrize("block_rows", [2_000, 1])
def test_substring_dedup_awkward(spark, block_rows):
    df, texts = awkward(spark)
    out = substring_dedup.remove_duplicate_spans(df, block_rows=block_rows)
    assert bag(out, "doc_id", "n_words", "n_removed", F.coalesce("kept_text", F.lit(""))) == sorted(plain.dedup(texts), key=str)
    assert out.columns == [c for c in df.columns if c not in ("kept_text", "n_words")] + ["n_words", "n_removed", "kept_text"]
    assert substring_dedup.remove_duplicate_spans(df.limit(0)).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------


def check_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    quoted = ", ".join(columns)
    expected = con.execute(f"SELECT {quoted} FROM ({queries.ORACLE_SQL[name]}) q").fetchall()
    assert bag(df, *columns) == sorted(expected, key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, name):
    check_sql(spark, small, name)


def test_preferences(spark):
    schema = "conv_id long, turn long, role string, text string, prompt string"
    chosen = spark.createDataFrame([(1, 0, "user", "hé", ""), (1, 1, "assistant", "good", ""), (1, 1, "assistant", "good", ""), (2, 0, None, None, ""), (None, 0, "user", "x", ""), (3, 0, "user", "only", "")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "hé", ""), (1, 1, "assistant", "bad", ""), (2, 0, "", "", "")], schema)
    clean = preference_format.clean_turns
    out = {r["conv_id"]: r for r in preference_format.format_preferences(clean(chosen), clean(rejected)).collect()}
    assert set(out) == {1, 2, 3}
    one = out[1]
    assert (one["n_common"], one["prompt"]) == (1, "<|user|>\nhé<|end|>\n")
    whole = one["prompt"] + one["chosen_completion"]
    assert [whole[s["start"] : s["end"]] for s in one["chosen_spans"]] == ["good<|end|>\n"]
    whole = one["prompt"] + one["rejected_completion"]
    assert [whole[s["start"] : s["end"]] for s in one["rejected_spans"]] == ["bad<|end|>\n"]
    assert (out[2]["n_common"], out[2]["chosen_completion"], out[2]["rejected_completion"]) == (1, "", "")
    assert (out[3]["n_common"], out[3]["prompt"], out[3]["rejected_completion"]) == (0, "", "")
    assert preference_format.format_preferences(clean(chosen.limit(0)), clean(rejected.limit(0))).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------


def test_fair_mix_awkward(spark):
    df, texts = awkward(spark)
    for range_rows in (2_000, 2):
        out = fair_mix.fair_mix(df, range_rows=range_rows).collect()
        assert len(out) == len(texts)
        total, taken = sum(r["size"] for r in out), {}
        for r in out:
            assert r["taken"] <= 3 * r["size"]
            taken.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["taken"]
        largest = max(r["size"] for r in out)
        assert sum(x[0] for x in taken.values()) <= total
        assert all(abs(t - goal) <= largest and goal <= 3 * size for t, goal, size in taken.values())
    assert fair_mix.fair_mix(df.limit(0)).count() == 0
    empty = fair_mix.fair_mix(df.where("text is null")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


def test_mixed_rows(spark, docs):
    mixed = fair_mix.fair_mix(docs)
    out = fair_mix.mixed_rows(docs, mixed)
    assert out.columns == docs.columns
    assert bag(out.groupBy("doc_id").count(), "doc_id", "count") == bag(mixed.where("taken_copies > 0"), "doc_id", "taken_copies")


# --- 5 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, reference):
    extra = ["", None, "a" * 3000, " " * 40 + "x  y", "it's  they'll\n\n", "漢字かな 🙂 é", "<|endoftext|>", "\x1c\x1f \x85　z", "a\n b", " lead", "trail "]
    rows = spark.createDataFrame([(-i, t, 5) for i, t in enumerate(extra)], "doc_id long, text string, n_tokens int")
    bpe = queries.tokenizer(spark)
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text").unionByName(rows.select("doc_id", "text"))))
    for r in out.collect():
        ids = np.frombuffer(r["token_ids"], dtype="<u4").tolist()
        assert ids == reference.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(rows).columns == ["doc_id", "text", "token_ids", "n_tokens"]
    together = bpe.round_trip(rows.select("doc_id", "text"))
    assert sorted(map(str, together.collect())) == sorted(map(str, bpe.decode(bpe.encode(rows.select("doc_id", "text"))).select(together.columns).collect()))
    assert bpe.encode(rows.limit(0)).count() == 0


def test_bpe_random(reference):
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    perfect = byte_bpe.PerfectHash(tokens)
    assert sorted(perfect.key_at) == list(range(len(tokens)))
    assert all(perfect.candidate(t) == i for i, t in enumerate(tokens))
    encoder = byte_bpe.Encoder(tokens, perfect, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(2_000):
        text = "".join(rng.choice("abcAB 's\t\n\x1d\x85 ​1٣²ßñ漢\U0001f600!?-") for _ in range(rng.randrange(50)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


# --- 6 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast_rules", [100_000, 0])
def test_url_filters(spark, broadcast_rules):
    urls = ["http://a.Example.ORG/es/x?y", "https://example.org/en/12", "https://notexample.org/es/", "x://org/", "x://org", "http://b.com/fr/1#t", "http://com/de/", "no url", None, "a://b://c/d", "http://EXAMPLE.org?/es/"]
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id long, url string, verdict string, short int")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages, broadcast_rules=broadcast_rules).collect()}
    assert out == {
        0: ("a.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("notexample.org", "/es/", "org/", "allow"),
        3: ("org", "/", "org/", "allow"), 4: ("org", "", None, "allow"), 5: ("b.com", "/fr/1", "com/fr/", "allow"), 6: ("com", "/de/", "com/de/", "block"),
        7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("b:", "//c/d", None, "allow"), 10: ("example.org", "", None, "allow"),
    }
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filters.judge_urls(pages, none).collect()} == {"allow"}
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_url_of_very_many_labels(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 30_000 + "example.org/es/x"), (2, "http://" + "." * 50 + "org/"), (3, "x://.com/de/"), (4, None), (4, None)], "page_id long, url string")
    out = url_filters.judge_urls(pages)
    assert bag(out, "page_id", "rule", "verdict") == [(1, "example.org/es/", "block"), (2, "org/", "allow"), (3, "com/de/", "block"), (4, None, "allow"), (4, None, "allow")]


# --- 7 ---------------------------------------------------------------------------------------------


def plain_cells(image, height, width):
    """Means over the exact areas of cells, pixel by pixel."""
    h, w = image.shape
    overlap = lambda n, cells: np.array([[max(0.0, min((c + 1) * n / cells, i + 1) - max(c * n / cells, i)) for i in range(n)] for c in range(cells)])
    return overlap(h, height) @ image.astype(float) @ overlap(w, width).T * (height * width / (h * w))


def test_media_query(spark, tmp_path):
    """Every column against a plain version: stored form, payload read back, and features; null, empty, long and repeated texts."""
    rng = random.Random(2)
    texts = [None, "", "a", "x" * 575, "y" * 576, "z" * 577, "é漢🙂 " * 400, "same", "same", "".join(chr(rng.randrange(32, 127)) for _ in range(30_000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op7_media(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) and rows[7][1:] == rows[8][1:] and rows[0][1:] == rows[1][1:]
    for i, text in enumerate(texts):
        raw, r = (text or "").encode(), rows[i]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), plain.sha(payload))
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(stored), plain.sha(stored))
        image = np.frombuffer(payload, np.uint8).reshape(-1, 24)
        tile = np.rint(np.round(plain_cells(image, 32, 32), 6)).astype(np.uint8)
        small = np.round(plain_cells(image, 8, 9), 6)
        bits = int("".join("01"[int(small[y, x] < small[y, x + 1])] for y in range(8) for x in range(8)), 2)
        out = io.BytesIO()
        np.save(out, tile)
        assert r["feature"] == f"{bits:016x}:{plain.sha(out.getvalue())}"


def test_media_forms():
    rng = np.random.default_rng(4)
    for shape in ((7, 5), (7, 5, 3), (1, 1), (24, 24)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        for encode in (media.encode_netpbm, media.encode_bmp):
            assert (media.decode(encode(image)) == image).all()
    assert (media.decode_netpbm(b"P5 # note\n2 1\n255\n\x01\x02") == [[1, 2]]).all()
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")
    image = rng.integers(0, 256, (6, 9), dtype=np.uint8)
    assert np.allclose(media.area_resize(image, 3, 3), image.reshape(3, 2, 3, 3).mean(axis=(1, 3)))
    big = np.kron(image, np.ones((4, 7)))
    assert np.allclose(media.area_resize(big, 5, 4), media.area_resize(image, 5, 4))
    assert media.difference_hash(np.tile(np.arange(9, dtype=np.uint8), (8, 1))) == "ff" * 8


def test_media_awkward(spark):
    df, texts = awkward(spark)
    for kind in ("netpbm", "bmp"):
        out = media.image_features(media.text_images(df, kind=kind)).collect()
        assert len(out) == len(texts)
        for r in out:
            raw = (r["text"] or "").encode()
            assert bytes(r["samples"]) == raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    bad = spark.createDataFrame([(b"P5 nothing",), (None,), (b"BM",)], "media binary")
    assert all(r["dhash"] is None for r in media.image_features(bad).collect())
    assert media.text_images(df.limit(0)).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = queries.op8_language_id(spark, sf_dir).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_spans_and_awkward(spark, docs):
    model = language_id.learn(docs)
    en, de = "The house with that is on the street. " * 8, "Der Mann und die Frau sind nicht in dem Haus. " * 8
    rows = spark.createDataFrame([(1, en + de), (2, None), (3, ""), (4, "12 34 -- !"), (5, "ª")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in language_id.identify(rows, model).collect()}
    assert [s["lang"] for s in out[1]["lang_spans"]] == ["en", "de"]
    assert [out[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and out[5]["lang_pred"] in model.languages
    df, _ = awkward(spark)
    assert language_id.identify(df, language_id.learn(df)).count() == df.count()
    assert language_id.learn(df.limit(0)) is None and language_id.identify(df.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df, None).collect()} == {"und"}


def test_viterbi_against_plain_search(docs):
    model = language_id.learn(docs)
    texts = [t.lower().encode() for t in ("the of und die that der les que", "x", "", "la los el der and the of to")]
    words = language_id.Words(texts)
    scores, _ = model.word_scores(words)
    labels, _ = model.label(words)

    def value(path, own):
        return sum(float(own[i, x]) for i, x in enumerate(path)) - float(model.switch) * sum(a != b for a, b in zip(path, path[1:], strict=False))

    for t in range(len(texts)):
        own = scores[words.first[t] : words.first[t + 1]]
        best = {(): 0.0}
        for row in range(len(own)):
            best = {(*p, x): 0.0 for p in best for x in range(len(model.languages))}
            if len(best) > 5_000:
                best = dict.fromkeys(sorted(best, key=lambda p: -value(p, own))[:2_000], 0.0)
        top = max((value(p, own) for p in best), default=0.0)
        got = value(tuple(labels[words.first[t] : words.first[t + 1]]), own)
        assert got >= top - 1e-2


# --- 9 ---------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    """Better than keeping all, and most of the bad ones go."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = quality.score_documents(docs, labels.where(~held)).select("doc_id", "keep").join(labels.where(held).select("doc_id", F.col("quality").alias("good")), "doc_id").collect()
    base = np.mean([r["good"] == 1 for r in rows])
    assert np.mean([r["keep"] == (r["good"] == 1) for r in rows]) > base + (1 - base) / 2
    assert np.mean([r["keep"] for r in rows if r["good"] == 1]) > 0.97
    assert np.mean([not r["keep"] for r in rows if r["good"] == 0]) > 0.5


def test_quality_against_a_plain_version(spark):
    """Trigram odds, the logistic fit, and both levels of shrinking, with plain Python loops."""
    rng = random.Random(9)
    good_words, bad_words = [f"good{i}" for i in range(30)], [f"spam{i}" for i in range(30)]
    data = []
    for i in range(160):
        host, path = f"h{i % 4}", f"p{i % 3}"
        good = rng.random() < (0.9 if host == "h0" else 0.5)
        data.append((i, " ".join(rng.choice(good_words if good or rng.random() < 0.3 else bad_words) for _ in range(12)), path, host, 0, int(good)))
    docs = spark.createDataFrame([r[:5] for r in data], DOCS)
    labels = spark.createDataFrame([(r[0], r[5]) for r in data if r[0] % 5], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    kept_out = {r["label_id"]: r["c"] for r in labels.select(F.col("doc_id").alias("label_id"), quality.calibrates(F.col("doc_id")).alias("c")).collect()}

    def buckets(text):
        padded = [0x20, *(0x20 if b == 0x20 else 0x30 if 0x30 <= b <= 0x39 else b for b in text.encode()), 0x20]
        return [(((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 16 for a, b, c in zip(padded, padded[1:], padded[2:], strict=False) if b != 0x20]

    counts = [Counter(), Counter()]
    known = {r[0]: r for r in data if r[0] % 5}
    for i, r in known.items():
        if not kept_out[i]:
            counts[r[5]].update(buckets(r[1]))
    odds = lambda b: math.log((counts[1][b] + 0.5) / (counts[1].total() + 32768)) - math.log((counts[0][b] + 0.5) / (counts[0].total() + 32768))
    evidence = {r[0]: sum(map(odds, buckets(r[1]))) / len(buckets(r[1])) for r in data}
    assert all(abs(found[i]["evidence"] - e) < 1e-5 for i, e in evidence.items())

    n, n_good = len(known), sum(r[5] for r in known.values())
    share = (n_good + 0.5) / (n + 1)
    strength = lambda groups, parent: quality.prior_strength(sum(k for k, _ in groups.values()), sum(k * k for k, _ in groups.values()), len(groups), sum(k * (g / k - parent(site)) ** 2 for site, (k, g) in groups.items()) / (share * (1 - share)))
    sums = lambda site: {s: (len(own), sum(r[5] for r in own)) for s in {site(r) for r in known.values()} for own in [[r for r in known.values() if site(r) == s]]}
    hosts, paths = sums(lambda r: r[3]), sums(lambda r: (r[3], r[2]))
    k_host = strength(hosts, lambda site: share)
    host_share = {h: (g + k_host * share) / (k + k_host) for h, (k, g) in hosts.items()}
    k_path = strength(paths, lambda site: host_share[site[0]])
    prior = {s: (g + k_path * host_share[s[0]]) / (k + k_path) for s, (k, g) in paths.items()}
    assert all(abs(found[r[0]]["site_prior"] - prior[r[3], r[2]]) < 1e-9 for r in data)

    fit = [(math.floor((found[i]["evidence"] + 4) * 50) / 50 - 4 + 0.01, r[5]) for i, r in known.items() if kept_out[i]]
    slope, intercept = quality.fit_logistic(np.array([x for x, _ in fit]), np.array([g for _, g in fit], dtype=float), np.array([1 - g for _, g in fit], dtype=float))
    fit_good = sum(g for _, g in fit)
    for r in data:
        logit = slope * found[r[0]]["evidence"] + intercept - math.log((fit_good + 0.5) / (len(fit) - fit_good + 0.5)) + math.log(prior[r[3], r[2]] / (1 - prior[r[3], r[2]]))
        assert abs(found[r[0]]["quality"] - 1 / (1 + math.exp(-logit))) < 1e-6 and found[r[0]]["keep"] == (found[r[0]]["quality"] >= 0.5)


def test_quality_awkward(spark):
    df, texts = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 1), (3, None, 0), (None, 1, 0), (11, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        out = quality.score_documents(df, lab).collect()
        assert len(out) == len(texts) and all(0 <= r["quality"] <= 1 for r in out)
    assert quality.score_documents(df.limit(0), labels).count() == 0


def test_shrinking():
    assert quality.prior_strength(1_000, 100_000, 10, 9.0) > 1_000  # no more spread than chance
    assert quality.prior_strength(1_000, 100_000, 10, 500.0) < 10
    slope, intercept = quality.fit_logistic(np.array([-1.0, 1.0]), np.array([10.0, 30.0]), np.array([30.0, 10.0]))
    assert slope == pytest.approx(np.log(3), abs=1e-2) and intercept == pytest.approx(0, abs=1e-2)


# --- 10 --------------------------------------------------------------------------------------------


def test_jaccard_join(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert bag(jaccard_join.similarity_components(docs), "doc_id", "n_shingles", "component_id") == sorted(plain.jaccard_components(rows), key=str)


@pytest.mark.parametrize("hot_rows", [20_000, 3])
def test_jaccard_join_of_near_copies(spark, hot_rows):
    """More near copies of one text than there are centres, some too far off, so that all steps matter."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(120), i % 6):
            words[at] = f"z{i}x{at}"
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else "  ".join(words)))
    rows += [(100, " ".join(base[:60])), (101, " ".join(base[:60] + ["q"] * 3))]
    found = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), hot_rows=hot_rows)
    assert bag(found, "doc_id", "n_shingles", "component_id") == sorted(plain.jaccard_components(rows), key=str)


def test_jaccard_join_awkward(spark):
    df, texts = awkward(spark)
    found = jaccard_join.similarity_components(df)
    assert bag(found, "doc_id", "n_shingles", "component_id") == sorted(plain.jaccard_components(texts), key=str)
    assert jaccard_join.similarity_components(df.limit(0)).count() == 0


def test_prefix_lengths():
    for n in range(1, 400):
        assert jaccard_join.prefix_length(n, 75) == n - -(-75 * n // 100) + 1


