"""The corpus pipeline: language ID, near-duplicate removal, substring dedup, mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again for the next. All but
the last return the columns of ``documents``. Texts that a stage changes get their ``n_chars`` anew. Further columns, of any type and name, pass through
as they are: while a stage runs they have names of their own, so that no result replaces them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import language_id
from knotwork.llm.fair_mix import fair_mix, mixed_rows
from knotwork.llm.jaccard_join import apart_by_buckets, similarity_groups
from knotwork.llm.queries import held_out_rows, token_digests, tokenizer
from knotwork.llm.substring_dedup import remove_duplicate_spans
from knotwork.plans.materialize import written


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _other_columns_aside(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in OWN else f"__column_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.withColumnsRenamed(names), sf_dir)
        return out.select(*(F.col(name).alias(c) for c, name in names.items()))

    return run_stage


@_other_columns_aside
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go; the others get the language found as ``lang``."""
    found = language_id.identify(docs, language_id.learn(docs.where(~held_out_rows())))
    kept = found.where(F.col("lang_pred") != language_id.UNDETERMINED)
    return kept.withColumn("lang", F.col("lang_pred")).select(docs.columns)


@_other_columns_aside
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one of smallest id stays; rows without words or id stay.

    Ids may repeat: rows are told apart by id and text. Of texts of one id in a group the one of smallest hash stays, and
    of rows with equal id and text the smallest by all columns, those that hold maps last and as JSON. Only rows that may be
    marked travel, with their texts, to the table of marks.
    """
    row, key = F.struct("doc_id", "text_key"), F.xxhash64("text")
    groups = similarity_groups(docs).where("label is not null and doc_id is not null").groupBy("label", "doc_id", "text_key").agg(F.count("*").alias("k"))
    first = written(groups.groupBy("label").agg(F.min(row).alias("first")), "firsts")  # read back, so that Spark may split a large group's rows at the join
    marked = groups.join(first, "label").withColumn("gone", row != F.col("first")).where("gone or k > 1").select("doc_id", F.col("text_key").alias("__key"), "gone")
    marked = written(marked, "near-duplicates")
    keyed = docs.withColumn("__key", key)
    asked, untouched = apart_by_buckets(keyed, marked, "doc_id", "__key")
    single = untouched.unionByName(asked.join(marked, ["doc_id", "__key"], "left_anti")).select(docs.columns)
    repeated = marked.where("not gone")
    several = apart_by_buckets(keyed, repeated, "doc_id", "__key")[0].join(repeated, ["doc_id", "__key"], "left_semi")
    maps = [c for c, kind in docs.dtypes if "map<" in kind]
    order = F.struct(*(c for c in docs.columns if c not in maps), F.to_json(F.struct(F.lit(0).alias("__no_map"), *maps)).alias("__maps"))
    return single.unionByName(several.groupBy("doc_id", "__key").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*"))


@_other_columns_aside
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of repeated passages; a document goes if nothing of it is left. Untouched texts keep their spacing."""
    out = remove_duplicate_spans(docs).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns({"text": text, "n_chars": length}).select(docs.columns)


@_other_columns_aside
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs, fair_mix(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded bytes of each document."""
    bpe = tokenizer(spark)
    return token_digests(bpe.round_trip(docs.select("doc_id", "text")))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: No stage but mixing can be said in SQL; tests/llm compares run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
