"""Letters outside the large scripts."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import product

import regex

from knotwork.llm import language_id

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def scripts(texts):
    return language_id.word_scripts(language_id.Words([t.encode() for t in texts]), language_id.script_table()).tolist()


def number(name):
    return language_id.SCRIPT_NAMES.index(name) + 1


def test_every_letter_has_a_script():
    letters = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)]) if regex.match(r"\p{L}", c)]
    found = scripts(letters)
    assert len(found) == len(letters) and min(found) > 0
    others = scripts([" \u2019 \u201c \u00a7 \u20ac \u2192 \u07a6 \u07c0 \ufffd \u0301 e\u0301 hawai\u02bbi \u043f\u02bc\u044f\u0442\u044c"])
    assert others == [0] * 9 + [1, 1, number("Cyrillic")]


def test_scripts_of_code_points():
    """Against the Script property, letter by letter, and some that share a lead byte with another script."""
    words = {"ti\u1ebfng": "Latin", "\u10e5\u10d0\u10e0": "Georgian", "\u1f00\u03bd\u03ae\u03c1": "Greek", "\u1c90": "Georgian", "\u0e44\u0e17\u0e22": "Thai", "\u0939\u093f\u0928": "Devanagari", "\ud55c\uad6d": "Hangul", "\u6f22\u5b57": "Han", "\u6f22\u5b57\u304b": "Hiragana", "\u30ab\u30ca": "Katakana", "\U0001e900": "Adlam"}
    assert scripts(words) == [number(name) for name in words.values()]
    for name in ("Armenian", "Hebrew", "Arabic", "Ethiopic", "Cherokee", "Yi"):
        own = [chr(p) for p in range(0xD800) if regex.match(rf"[\p{{L}}&&\p{{Script={name}}}]", chr(p), flags=regex.V1)]
        assert own and set(scripts(own)) == {number(name)}
    assert scripts(["\U00010380"]) == [language_id.SCRIPTS - 1]  # Ugaritic: one of the others


def test_more_than_512_languages(spark):
    """Languages of one word each: the model's buckets are halved, and the words still tell them apart."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(700)})
    rows = spark.createDataFrame([(i, w, f"l{i:03d}", "s", len(w)) for i, w in enumerate(words)], DOCS)
    model = language_id.learn(rows)
    assert model.shift == 1 and model.shares.shape == (700, (1 << 15) + 1)
    found = [r["lang"] == r["lang_pred"] for r in language_id.identify(rows, model).collect()]
    assert len(found) == 700 and sum(found) > 650


def test_prediction_against_a_plain_version(spark):
    """Scores by trigram and language, the best sequence by trying out every language at every word, and the vote."""
    rows = [("en", "the small dog and the cat"), ("en", "this is the house of the man"), ("de", "das ist der kleine Hund und die Katze"), ("de", "der Mann und das Haus"), ("el", "\u03c4\u03bf \u03c3\u03c0\u03af\u03c4\u03b9 \u03ba\u03b1\u03b9")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (lang, t) in enumerate(rows)], DOCS)
    languages = ["de", "el", "en"]

    def trigrams(word):
        padded = [0x20, *(0x30 if 0x30 <= b <= 0x39 else b for b in word.lower().encode()), 0x20]
        return [(((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 16 for a, b, c in zip(padded, padded[1:], padded[2:], strict=False)]

    counts = {x: Counter(t for lang, text in rows if lang == x for w in text.split() for t in trigrams(w)) for x in languages}
    greek = lambda w: any("\u0370" <= c < "\u0400" for c in w)

    def score(word, x):
        share = sum(math.log((counts[x][t] + 0.5) / (counts[x].total() + 0.5 * 65536)) for t in trigrams(word))
        return 0.0 if not any(map(str.isalpha, word)) else share - (1e4 if greek(word) != (x == "el") else 0)

    def predict(text, switch=3.0):
        own = text.split()
        best = max(product(languages, repeat=len(own)), key=lambda p: sum(score(w, x) for w, x in zip(own, p, strict=True)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        votes = Counter(x for w, x in zip(own, best, strict=True) if any(map(str.isalpha, w)))
        first = min(votes, key=lambda x: (-votes[x], x))
        return first, votes[first] / votes.total()

    texts = ["the cat", "die Katze und the dog", "12 der Hund 34", "das \u03c3\u03c0\u03af\u03c4\u03b9 und der Mann", "house house das Haus the man is"]
    model = language_id.learn(df, switch_penalty=3.0)
    found = language_id.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [(r["lang_pred"], round(r["lang_score"], 6)) for r in found] == [(x, round(s, 6)) for x, s in map(predict, texts)]


def test_language_of_scripts_by_code_point(spark):
    texts = {"dv": "\u078b\u07a8\u0788\u07ac\u0780\u07a8 \u0784\u07a6\u0790\u07b0 \u0783\u07a7\u0787\u07b0\u0796\u07ac", "zgh": "\u2d5c\u2d30\u2d4e\u2d30\u2d63\u2d49\u2d56\u2d5c \u2d30\u2d4e\u2d30\u2d63\u2d49\u2d56", "syr": "\u0720\u072b\u0722\u0710 \u0723\u0718\u072a\u071d\u071d\u0710", "de": "das ist der kleine Hund", "en": "this is the small dog"}
    rows = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (lang, t) in enumerate(texts.items())], DOCS)
    found = {r["lang"]: r for r in language_id.identify(rows, language_id.learn(rows)).collect()}
    assert {lang: (r["lang_pred"], r["lang_score"]) for lang, r in found.items()} == {lang: (lang, 1.0) for lang in texts}
