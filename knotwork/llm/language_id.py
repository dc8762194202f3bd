"""Language identification of spans: scripts narrow the languages, Viterbi over word scores labels the words.

Each word gets the summed log share of its byte trigrams in every language, learned from all labelled training
texts. The script of its letters, by the Unicode Script property of their code points, rules out languages that in training hardly use
that script. A Viterbi pass over a text's words then picks the best sequence of languages, where every
change costs ``switch_penalty``; runs of one language are the spans. A text's language is the one that
labels most of its words with letters, and its score that share. Texts of a block advance together, a word at a step.

One scan to learn, one to label. The model has a fixed size: 65,536 trigram buckets for each of up to 512 languages, and with more languages
half as many buckets for each doubling. A block's texts times the languages are held as floats, so blocks are the smaller the more languages there are; one
text's words stay together. Defined results: a null text, or one without
a letter, is ``und`` with score 0 and no spans; words without letters take their neighbours' language; with no training
rows all texts are ``und``; null languages or texts train nothing; input columns named like a result are
replaced; other columns pass through. Ties go to the language first by code point.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.ngram_model import BUCKETS, class_counts, log_shares, trigrams
from knotwork.llm.textblocks import Words, text_blocks

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: Script names of the Unicode Script property (fixed values), as classes 1, 2, ...; letters of other scripts are one more class. Class 0: no letter.
#: Letters that scripts share (modifier letters and the like) count as Latin, the least class, so they leave the class of the word they stand in.
#: Kana come after Han: a word of both is Japanese.
SCRIPT_NAMES = (
    "Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Syriac", "Thaana", "Nko", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil",
    "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao", "Tibetan", "Myanmar", "Georgian", "Ethiopic", "Cherokee", "Canadian_Aboriginal", "Ogham", "Runic",
    "Khmer", "Mongolian", "Tifinagh", "Coptic", "Glagolitic", "Gothic", "Javanese", "Balinese", "Sundanese", "Tai_Le", "New_Tai_Lue", "Tai_Tham", "Cham", "Lisu",
    "Vai", "Bamum", "Adlam", "Ol_Chiki", "Meetei_Mayek", "Yi", "Hangul", "Han", "Bopomofo", "Hiragana", "Katakana",
)
SCRIPTS = len(SCRIPT_NAMES) + 2
BLOCK_FLOATS = 3 << 20
MODEL_CELLS = 1 << 25
_RULED_OUT = np.float32(-1e4)


@cache
def script_table() -> np.ndarray:
    """The script class of every code point."""
    points = "".join(map(chr, (p for p in range(0x110000) if not 0xD800 <= p < 0xE000)))
    place = lambda at: at if at < 0xD800 else at + 0x800  # noqa: E731  surrogates are left out
    table = np.zeros(0x110000, dtype=np.int8)
    for found in regex.finditer(r"\p{L}+", points):
        table[place(found.start()) : place(found.end() - 1) + 1] = SCRIPTS - 1
    for number, name in [(1, "Common"), (1, "Inherited"), *enumerate(SCRIPT_NAMES, 1)]:
        for found in regex.finditer(rf"[\p{{L}}&&\p{{Script={name}}}]+", points, flags=regex.V1):
            table[place(found.start()) : place(found.end() - 1) + 1] = number
    return table


def word_scripts(words: Words, table: np.ndarray) -> np.ndarray:
    """Each word's script: the largest class among its letters."""
    if not len(words.start):
        return np.empty(0, np.int8)
    kind = np.where(words.data < 0x80, table[words.data], np.int8(0))
    at = np.flatnonzero(words.data >= 0xC0)  # lead bytes
    if len(at):
        lead = words.data[at].astype(np.int32)
        second, third, fourth = (words.data[np.minimum(at + i, len(words.data) - 1)].astype(np.int32) & 0x3F for i in (1, 2, 3))
        point = np.where(lead < 0xE0, (lead & 0x1F) << 6 | second, np.where(lead < 0xF0, (lead & 0xF) << 12 | second << 6 | third, (lead & 7) << 18 | second << 12 | third << 6 | fourth))
        kind[at] = table[np.minimum(point, 0x10FFFF)]
    return np.maximum.reduceat(kind, words.start)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, shift: int, switch_penalty: float):
        self.languages, self.shares, self.shift, self.switch = languages, log_shares(counts), shift, np.float32(switch_penalty)
        self.scripts = script_table()
        self.allowed = np.zeros((SCRIPTS, len(languages)), dtype=np.float32)

    def rule_out(self, script_words: np.ndarray, least_share: float) -> None:
        """``script_words``: words by (language, script) in training."""
        share = script_words / np.maximum(1, script_words[:, 1:].sum(axis=1, keepdims=True))
        barred = (share < least_share).T
        barred[barred.all(axis=1)] = False
        barred[0] = False
        self.allowed = np.where(barred, _RULED_OUT, np.float32(0)).astype(np.float32)

    def word_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, language) scores, and each word's script."""
        script = word_scripts(words, self.scripts)
        bucket = trigrams(words) >> self.shift
        scores = np.empty((len(words.start), len(self.languages)), dtype=np.float32)
        for i, shares in enumerate(self.shares):
            if len(words.start):
                scores[:, i] = np.add.reduceat(shares[bucket], words.start)
        scores += self.allowed[script]
        scores[script == 0] = 0
        return scores, script

    def label(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each word's language under the best sequence, and its script."""
        scores, script = self.word_scores(words)
        order = np.argsort(-words.count, kind="stable")
        first, count = words.first[:-1][order], words.count[order]
        steps = int(count[0]) if len(count) else 0
        active = np.searchsorted(-count, -np.arange(steps), side="left")  # texts with more words than this step
        moved = np.zeros(scores.shape, dtype=bool)
        source = np.zeros(len(scores), dtype=np.int16)
        value = np.zeros((len(count), len(self.languages)), dtype=np.float32)
        for t in range(steps):
            k = active[t]
            at = first[:k] + t
            v = value[:k]
            if t:
                best = v.argmax(axis=1)
                source[at] = best
                change = v[np.arange(k), best] - self.switch
                go = v < change[:, None]
                moved[at] = go
                v = np.where(go, change[:, None], v)
            value[:k] = v + scores[at]
        state = value.argmax(axis=1)
        labels = np.zeros(len(scores), dtype=np.int16)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            at = first[:k] + t
            own = state[:k]
            labels[at] = own
            state[:k] = np.where(moved[at, own], source[at], own)
        return labels, script


def learn(training: DataFrame, lang_col: str = "lang", text_col: str = "text", switch_penalty: float = 12.0, least_share: float = 0.001) -> Model | None:
    """A model from all rows with a language and a text (None without such rows)."""
    rows = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    languages = sorted((r["lang"] for r in rows.select("lang").distinct().collect()), key=lambda s: s.encode())  # a row a language
    if not languages:
        return None
    shift = max(0, (len(languages) * BUCKETS - 1).bit_length() - MODEL_CELLS.bit_length() + 1)
    numbered = rows.select((F.array_position(F.lit(languages), F.col("lang")) - 1).cast("int").alias("class"), "text")
    model = Model(languages, class_counts(numbered, len(languages), lower=True, shift=shift), shift, switch_penalty)
    table = training.sparkSession.sparkContext.broadcast(model.scripts)

    def scripts(batches):
        total = np.zeros((len(languages), SCRIPTS), dtype=np.int64)
        for batch in batches:
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, raw in text_blocks(batch.column(1)):
                words = Words([t.lower().encode("utf-8", "surrogatepass") for t in raw])
                if len(words.start):
                    script = word_scripts(words, table.value)
                    np.add.at(total, (np.repeat(kind[a:b], words.count), script), 1)
        at = np.argwhere(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(total[tuple(at.T)])], ["class", "script", "words"])

    by_script = numbered.mapInArrow(scripts, "class long, script long, words long").groupBy("class", "script").agg(F.sum("words").alias("words"))
    used = np.zeros((len(languages), SCRIPTS))
    for row in by_script.collect():  # at most languages * scripts rows
        used[row["class"], row["script"]] = row["words"]
    model.rule_out(used, least_share)
    return model


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_spans`` (word ranges [start, end) with a language)."""
    results = ["lang_pred", "lang_score", "lang_spans"]
    own = docs.drop(*results)
    span_type = "array<struct<start:int,end:int,lang:string>>"
    if model is None:
        return own.withColumns({"lang_pred": F.lit(UNDETERMINED), "lang_score": F.lit(0.0), "lang_spans": F.array().cast(span_type)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(column):
        m = shared.value
        names = pa.array(m.languages)
        pred, score, spans = [], [], []
        for a, b, raw in text_blocks(column, max(1, 4 * BLOCK_FLOATS // max(4, len(m.languages)))):
            words = Words([t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in raw])
            labels, script = m.label(words)
            text = np.repeat(np.arange(b - a), words.count)
            with_letters = script > 0
            votes = np.bincount(text[with_letters] * len(m.languages) + labels[with_letters], minlength=(b - a) * len(m.languages)).reshape(b - a, -1)
            best = votes.argmax(axis=1)
            share = votes[np.arange(b - a), best] / np.maximum(1, votes.sum(axis=1))
            known = np.array([bool(t) and _LETTER.search(t) is not None for t in raw])
            pred += [m.languages[i] if ok else UNDETERMINED for i, ok in zip(best, known, strict=True)]
            score += np.where(known, share, 0.0).tolist()
            new = np.flatnonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(labels) != 0)))) if len(text) else np.empty(0, dtype=np.int64)
            end = np.concatenate((new[1:], [len(text)])) if len(new) else new
            owner = text[new] if len(new) else new
            keep = known[owner] if len(new) else np.empty(0, dtype=bool)
            new, end, owner = new[keep], end[keep], owner[keep]
            offset = words.first[owner]
            items = pa.StructArray.from_arrays([pa.array(new - offset, pa.int32()), pa.array(end - offset, pa.int32()), names.take(pa.array(labels[new]))], ["start", "end", "lang"])
            starts = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
            spans.append(pa.ListArray.from_arrays(pa.array(starts), items))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        joined = pa.concat_arrays(spans).cast(kind) if spans else pa.array([], kind)
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), joined], results)

    # So marked, it runs once for each row: a filter on its results would else run it again.
    udf = F.arrow_udf(labelled, f"lang_pred string, lang_score double, lang_spans {span_type}").asNondeterministic()
    out = own.withColumn("__lang", udf(F.col(text_col).cast("string")))
    return out.select(*own.columns, *(F.col(f"__lang.{c}").alias(c) for c in results))
