"""Quality classifier: document evidence combined with shrunken host and path posteriors.

Evidence of a document is the mean log odds of its byte trigrams between good and bad labelled texts (a naive Bayes
model of fixed size, fitted on at most ``sample_rows`` labelled rows, those of smallest id hash, so that they can be
broadcast), turned into a log likelihood ratio by a logistic fit on a fixed histogram of labelled rows. A quarter of the labelled ids,
by another hash, is kept out of the model and used for that fit (all of them, if none falls into that quarter): on its own
rows the model would look surer than it is.

Sites are two-level: a host (here ``source``) and a path in it (here ``lang``). Hierarchical empirical Bayes: a
host's share of good labels is shrunk to the global share, a path's to its host's posterior. The prior strength at either
level is estimated from all labelled rows by the method of moments (how much more the shares differ than
chance would make them), so sparse sites stay near their parents. The posterior odds of a document are its likelihood ratio
times the odds of its path; it is kept from probability ``threshold`` on.

Skew: labels and documents meet on narrow rows (no text); site sums are partial aggregates, and a hot host's rows
join to its one posterior row by a join that Spark can split.

Defined results: a null or wordless text has evidence 0 and goes by its site alone; an unlabelled site uses its parent's
posterior; null hosts and paths are sites of their own; labels that disagree for an id count as their mean, rounded up at
one half; null labels are ignored; without labels everything has probability 0.5 and is kept; repeated rows get equal
results; other columns do not pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.ngram_model import class_counts, log_shares, trigrams
from knotwork.llm.textblocks import Words, text_blocks, utf8
from knotwork.plans.materialize import written

BINS, BIN_RANGE = 400, 4.0


def doc_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return rows.groupBy(F.col(id_col).cast("long").alias("label_id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("good"))


def calibrates(label_id: Column) -> Column:
    return F.pmod(F.xxhash64(label_id, F.lit(1)), F.lit(4)) == 0


def learn_evidence(docs: DataFrame, labels: DataFrame, sample_rows: int) -> np.ndarray:
    """Log odds by bucket (last one zero) from at most ``sample_rows`` of ``labels(label_id, good)`` that do not calibrate."""
    sample = labels.where(~calibrates(F.col("label_id"))).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    rows = docs.join(F.broadcast(sample), docs["doc_id"] == F.col("label_id")).where("text is not null").select(F.col("good").alias("class"), "text")
    counts = class_counts(rows, 2, lower=False)
    shares = log_shares(counts)
    return (shares[1] - shares[0]).astype(np.float32)


def with_evidence(docs: DataFrame, odds: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(odds)

    def evidence(texts: pa.Array) -> pa.Array:
        out = []
        for _, _, some in text_blocks(texts):
            words = Words(utf8(some))
            bucket = trigrams(words)
            value = np.concatenate(([0.0], np.cumsum(shared.value[bucket], dtype=np.float64)))
            inside = np.concatenate(([0], np.cumsum(bucket < len(shared.value) - 1)))
            ends = np.minimum(words.text_start, len(bucket))
            out.append(np.diff(value[ends]) / np.maximum(1, np.diff(inside[ends])))
        return pa.array(np.round(np.concatenate(out), 9) if out else np.empty(0), pa.float64())

    return docs.select("doc_id", "host", "path", F.arrow_udf(evidence, "double")("text").alias("evidence"))


def fit_logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(good | x) for counted values, by Newton steps with a weak ridge."""
    scale = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale[0] * x + scale[1], -30, 30)))
        n = good + bad
        grad = np.array([((good - n * p) * x).sum(), (good - n * p).sum()]) - 1e-3 * scale
        w = n * p * (1 - p)
        hess = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        scale = scale + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(scale[0]), float(scale[1])


def prior_strength(n: float, sum_n2: float, groups: float, within: float) -> float:
    """Pseudo-count of a beta prior from one-way moments: within = sum over groups of n (p_g - p)^2, over p (1 - p)."""
    if groups < 2 or n <= groups:
        return float(max(n, 1.0))
    spread = (within - (groups - 1)) / max(n - sum_n2 / n, 1e-9)  # intra-group correlation
    spread = min(max(spread, 1e-4), 0.99)
    return (1 - spread) / spread


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    label_col: str = "quality", sample_rows: int = 20_000, threshold: float = 0.5,
) -> DataFrame:
    """Per document: doc_id, evidence, site_prior, quality (a probability), keep."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    known = written(doc_labels(labels, id_col, label_col), "labels")
    scored = written(with_evidence(docs, learn_evidence(docs, known, sample_rows)), "evidence")
    labelled = written(scored.join(known, scored["doc_id"] == known["label_id"]).select("host", "path", "evidence", "good", calibrates(F.col("label_id")).alias("kept_out")), "labelled")
    total = labelled.agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.count_if("kept_out").alias("kept_out")).first()
    if not total["n"]:
        return scored.select("doc_id", "evidence", F.lit(0.5).alias("site_prior"), F.lit(0.5).alias("quality"), F.lit(True).alias("keep"))
    share = (total["good"] + 0.5) / (total["n"] + 1)

    at = F.least(F.greatest(F.floor((F.col("evidence") + BIN_RANGE) * (BINS / (2 * BIN_RANGE))), F.lit(0)), F.lit(BINS - 1)).cast("int")
    histogram = labelled.where("kept_out" if total["kept_out"] else "true").groupBy(at.alias("bin")).agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()  # BINS rows at most
    x = np.array([(r["bin"] + 0.5) * (2 * BIN_RANGE / BINS) - BIN_RANGE for r in histogram])
    good = np.array([r["good"] for r in histogram], dtype=float)
    slope, intercept = fit_logistic(x, good, np.array([r["n"] for r in histogram]) - good)
    n, n_good = sum(r["n"] for r in histogram), good.sum()
    prior_logit = float(np.log((n_good + 0.5) / (n - n_good + 0.5)))  # of the rows that the fit saw

    paths = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    paths = written(paths, "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "hosts")

    def strength(sites: DataFrame, n: str, good: str, parent) -> float:
        m = sites.agg(F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).cast("double").alias("n2"), F.count("*").alias("g"), F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - parent, 2)).alias("w")).first()
        return prior_strength(m["n"], m["n2"], m["g"], m["w"] / (share * (1 - share)))

    k_host = strength(hosts, "host_n", "host_good", F.lit(share))
    hosts = hosts.select("host", ((F.col("host_good") + k_host * share) / (F.col("host_n") + k_host)).alias("host_share"))
    nested = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "host_share")
    k_path = strength(nested, "n", "good", F.col("host_share"))
    nested = nested.select("host", "path", ((F.col("good") + k_path * F.col("host_share")) / (F.col("n") + k_path)).alias("path_share"))

    rows = scored.alias("d").join(hosts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")), "left").join(nested.alias("p"), F.col("d.host").eqNullSafe(F.col("p.host")) & F.col("d.path").eqNullSafe(F.col("p.path")), "left")
    site = F.coalesce("path_share", "host_share", F.lit(share))
    ratio = F.lit(slope) * F.col("evidence") + F.lit(intercept - prior_logit)
    quality = 1 / (1 + F.exp(-(F.when(F.col("evidence") == 0, 0.0).otherwise(ratio) + F.log(site / (1 - site)))))
    return rows.select("d.doc_id", "evidence", site.alias("site_prior"), quality.alias("quality"), (quality >= threshold).alias("keep"))
