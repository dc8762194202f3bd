"""One query for each operator, over its whole table; ``QUERIES`` and ``ORACLE_SQL`` are by query name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import language_id, media
from knotwork.llm.byte_bpe import Tokenizer
from knotwork.llm.centroid_clustering import cluster_report
from knotwork.llm.cover_search import top_k
from knotwork.llm.fair_mix import fair_mix
from knotwork.llm.jaccard_join import similarity_components
from knotwork.llm.preference_format import clean_turns, format_preferences, swapped_answers
from knotwork.llm.quality import score_documents
from knotwork.llm.ring_shards import ring_shards
from knotwork.llm.substring_dedup import remove_duplicate_spans
from knotwork.llm.url_filters import judge_urls
from knotwork.llm.whitening import whiten
from knotwork.plans.materialize import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cover_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256)
    return remove_duplicate_spans(docs).select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with the next conversation's last answer."""
    turns = written(clean_turns(_table(spark, sf_dir, "conversations")), "turns")
    out = format_preferences(turns, swapped_answers(turns))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("conv_id", "n_common", "prompt", "chosen_completion", "rejected_completion", spans("chosen_spans").alias("chosen_mask"), spans("rejected_spans").alias("rejected_mask"))


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer(spark: SparkSession) -> Tokenizer:
    return Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = tokenizer(spark)
    return token_digests(bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def token_digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = media.text_features(docs)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    tail = F.crc32(F.expr("substring(samples, greatest(octet_length(samples) - 31, 1), 32)"))
    return out.select(
        "doc_id", n_bytes.alias("n_bytes"), F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        tail.alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "dhash", F.sha2("tile_npy", 256)).alias("feature"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = held_out_rows()
    found = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def held_out_rows():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(_table(spark, sf_dir, "documents"))


def op11_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even counts: every shard's room is its share of the rows."""
    placed = ring_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_cover_search, op2_substring_dedup, op3_preference_format, op4_fair_mix, op5_byte_bpe, op6_url_filters, op7_media, op8_language_id, op9_quality, op10_jaccard_join, op11_ring_shards, op12_whitening, op13_centroid_clusters)}

OP1_SQL = r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id AND len(d.v) = len(q.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""

OP3_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, role, text FROM t),
a AS (SELECT conv_id, max(place) AS place, arg_max(text, place) AS text FROM c WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT * FROM (SELECT c.conv_id, c.place, c.role, CASE WHEN c.place = a.place THEN o.text ELSE c.text END AS text
  FROM c LEFT JOIN a USING (conv_id) LEFT JOIN a o ON o.conv_id = a.conv_id + 1) WHERE text IS NOT NULL),
m AS (SELECT conv_id, coalesce(min(place) FILTER (WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text), count(*)) AS n
  FROM c FULL JOIN r USING (conv_id, place) GROUP BY conv_id),
b AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
l AS (SELECT b.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line FROM b JOIN m USING (conv_id)),
e AS (SELECT *, sum(length(line)) OVER (PARTITION BY side, conv_id ORDER BY place) AS ends FROM l),
g AS (SELECT conv_id, side, n, coalesce(string_agg(line, '' ORDER BY place) FILTER (WHERE place < n), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY place) FILTER (WHERE place >= n), '') AS rest,
  coalesce(string_agg((ends - length(text) - 8)::BIGINT::VARCHAR || '-' || ends::BIGINT::VARCHAR, ',' ORDER BY place) FILTER (WHERE place >= n AND role = 'assistant'), '') AS mask
  FROM e GROUP BY ALL)
SELECT m.conv_id, m.n::BIGINT AS n_common, coalesce(x.prompt, '') AS prompt, coalesce(x.rest, '') AS chosen_completion, coalesce(y.rest, '') AS rejected_completion,
  coalesce(x.mask, '') AS chosen_mask, coalesce(y.mask, '') AS rejected_mask
FROM m LEFT JOIN g x ON x.conv_id = m.conv_id AND x.side = 'c' LEFT JOIN g y ON y.conv_id = m.conv_id AND y.side = 'r'
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '-')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
q AS (SELECT *, most / weight AS dry_at FROM w),
r AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER b, 0) AS money, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS heavy FROM q WINDOW b AS (ORDER BY dry_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT arg_min(money / heavy, dry_at) AS end_at FROM r WHERE dry_at >= money / heavy),
t AS (SELECT source, source_size, weight, least(most, coalesce(weight * end_at, most)) AS target FROM r, e),
p AS (SELECT d.*, source_size, weight, target, (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS sent FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT p.*, copy, (sent + copy * source_size) / weight AS due FROM p, range(3) x(copy) WHERE size > 0),
f AS (SELECT *, sum(size) OVER (ORDER BY due, key, coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), copy, size ROWS UNBOUNDED PRECEDING) AS upto FROM c),
k AS (SELECT doc_id, source, key, size, sum(size)::BIGINT AS taken FROM f WHERE upto <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM p LEFT JOIN k ON p.doc_id IS NOT DISTINCT FROM k.doc_id AND p.source IS NOT DISTINCT FROM k.source AND p.size = k.size
"""

OP6_SQL = r"""
WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT b.*, (SELECT max({'n': length(h || p), 'k': length(h), 'rule': h || p, 'verdict': v}) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM b)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM c
"""

_OP13_ROUND = """
a{i} AS (SELECT e.vec_id, e.x, arg_min({{'c': c.cluster, 'd': d}}, {{'d': d, 'c': c.cluster}}) AS best FROM e, c{i} c, LATERAL (SELECT list_sum(list_transform(list_zip(e.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) GROUP BY e.vec_id, e.x),
u{i} AS (SELECT cluster, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY p) AS x FROM (SELECT best.c AS cluster, p, sum(x[p]) AS s, count(*) AS k FROM a{i}, range(1, 65) r(p) GROUP BY ALL) GROUP BY cluster),
c{n} AS (SELECT c{i}.cluster, coalesce(u{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN u{i} USING (cluster)),"""

OP13_SQL = (
    r"""
WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS cluster, x FROM (SELECT x, sha256('1:' || vec_id) AS h FROM e ORDER BY h, x LIMIT 16)),"""
    + "".join(_OP13_ROUND.format(i=i, n=i + 1) for i in range(3)).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")
    + _OP13_ROUND.format(i=3, n=4).split("\nu3")[0].rstrip(",")
    + r"""
SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(list_aggregate(c3.x, 'string_agg', ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.cluster = best.c
"""
)

ORACLE_SQL = {"op1_cover_search": OP1_SQL, "op3_preference_format": OP3_SQL, "op4_fair_mix": OP4_SQL, "op6_url_filters": OP6_SQL, "op13_centroid_clusters": OP13_SQL}
