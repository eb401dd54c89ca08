"""Thin queries over the operators of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lossweave.llm import best_fit_pack, decontaminate, ego_join, html_extract, langid, length_buckets, lm_backoff, minhash_paths, pii, superkmer

#: Vocabulary of the packing query: a byte-level rank file of 50,256 tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at a cosine of 0.93 or more."""
    return ego_join.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.93)


ORACLES["op1_ego_join"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
       WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON r.x = l.x WHERE r.c < l.y)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, m.c AS component_id, m.c = v.vec_id AS kept
FROM v JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = v.vec_id LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON k.x = v.vec_id
"""


@_query
def op2_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@_query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the part that is not held out."""
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs))
    return out.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


@_query
def op4_minhash_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes on 4-word shingles at a similarity of 0.8."""
    return minhash_paths.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, similarity=80)


ORACLES["op4_minhash_paths"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
r AS (SELECT doc_id AS x, doc_id AS c FROM d UNION SELECT l.y, r.c FROM r JOIN l ON r.x = l.x WHERE r.c < l.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""


@_query
def op5_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans: base patterns plus what the trained span classifier adds."""
    return pii.digest(_table(spark, sf_dir, "documents"))


@_query
def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of all documents in the 16 length buckets that pad least."""
    out = length_buckets.pack(length_buckets.word_lengths(_table(spark, sf_dir, "documents")))
    return out.withColumnsRenamed({"doc": "doc_id", "n": "n_tokens"})


# Layer k of the recursion holds, for each length j, the least padding of k buckets that end there (ties: the smaller
# split) and their bounds; 16 layers, or as many as there are lengths.
ORACLES["op6_length_buckets"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
h AS (SELECT n, row_number() OVER (ORDER BY n) AS j, CAST(sum(count(*)) OVER (ORDER BY n) AS BIGINT) AS c FROM d GROUP BY n),
last AS (SELECT max(j) AS j, least(16, max(j)) AS k FROM h),
r AS (SELECT 1 AS k, j, c, n * c AS cost, [n] AS bounds FROM h
      UNION ALL
      SELECT k, j, c, best.cost, list_append(best.bounds, n)
      FROM (SELECT r.k + 1 AS k, h.j, h.c, h.n, min({'cost': r.cost + h.n * (h.c - r.c), 'i': r.j, 'bounds': r.bounds}) AS best
            FROM r JOIN h ON h.j > r.j WHERE r.k < (SELECT k FROM last) GROUP BY r.k, h.j, h.c, h.n)),
bounds AS (SELECT unnest(bounds) AS bound, unnest(range(0, len(bounds))) AS bucket FROM r JOIN last ON r.j = last.j AND r.k = last.k),
p AS (SELECT doc_id, n, min({'bucket': bucket, 'bound': bound}) AS b FROM d JOIN bounds ON n <= bound GROUP BY doc_id, n),
q AS (SELECT doc_id, n, b.bucket AS bucket, b.bound AS bound, row_number() OVER (PARTITION BY b.bucket ORDER BY doc_id, n) - 1 AS rank, greatest(1, 65536 // greatest(b.bound, 1)) AS room FROM p)
SELECT doc_id, n AS n_tokens, bucket, bound, rank // room AS batch, rank % room AS slot, bound - n AS padding FROM q
"""


@_query
def op7_superkmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after 13-word windows that also start in an earlier document are removed."""
    out = superkmer.remove_repeats(_table(spark, sf_dir, "documents"), hashed=True)
    return out.withColumnRenamed("kept", "kept_sha256")


ORACLES["op7_superkmer"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT g.doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f ON g.g = f.g WHERE f.first < g.doc_id)),
ws AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT ws.doc_id, string_agg(ws.w, ' ' ORDER BY ws.p) FILTER (WHERE gone.p IS NULL) AS kept, count(gone.p) AS n_removed FROM ws LEFT JOIN gone ON ws.doc_id = gone.doc_id AND ws.p = gone.p GROUP BY ws.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


@_query
def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff score of every document by what the others hold."""
    out = lm_backoff.score(_table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log10_score") / F.col("n_words"), 6)).otherwise(0.0)
    return out.select("doc_id", "n_words", "n_backoff", mean.alias("log10_per_word"))


ORACLES["op8_stupid_backoff"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w0 FROM d),
g AS (SELECT t.doc_id, i, w0, lag(w0) OVER o AS w1, lag(w0, 2) OVER o AS w2 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c1 AS (SELECT w0, count(*) AS c FROM g GROUP BY ALL), o1 AS (SELECT doc_id, w0, count(*) AS c FROM g GROUP BY ALL),
c2 AS (SELECT w1, w0, count(*) AS c FROM g WHERE w1 IS NOT NULL GROUP BY ALL), o2 AS (SELECT doc_id, w1, w0, count(*) AS c FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w2, w1, w0, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY ALL), o3 AS (SELECT doc_id, w2, w1, w0, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
l1 AS (SELECT doc_id, o1.w0, c1.c - o1.c AS c FROM o1 JOIN c1 ON c1.w0 = o1.w0),
l2 AS (SELECT doc_id, o2.w1, o2.w0, c2.c - o2.c AS c FROM o2 JOIN c2 ON c2.w0 = o2.w0 AND c2.w1 = o2.w1),
l3 AS (SELECT doc_id, o3.w2, o3.w1, o3.w0, c3.c - o3.c AS c FROM o3 JOIN c3 ON c3.w0 = o3.w0 AND c3.w1 = o3.w1 AND c3.w2 = o3.w2),
s AS (SELECT g.doc_id,
      CASE WHEN l3.c > 0 THEN 0 WHEN l2.c > 0 THEN CASE WHEN g.w2 IS NULL THEN 0 ELSE 1 END ELSE CASE WHEN g.w1 IS NULL THEN 0 WHEN g.w2 IS NULL THEN 1 ELSE 2 END END AS b,
      CASE WHEN l3.c > 0 THEN l3.c / p2.c WHEN l2.c > 0 THEN l2.c / p1.c ELSE (l1.c + 1) / ((SELECT count(*) FROM t) - n.n + 1) END AS q
      FROM g JOIN n ON n.doc_id = g.doc_id JOIN l1 ON l1.doc_id = g.doc_id AND l1.w0 = g.w0
      LEFT JOIN l1 p1 ON p1.doc_id = g.doc_id AND p1.w0 = g.w1
      LEFT JOIN l2 ON l2.doc_id = g.doc_id AND l2.w1 = g.w1 AND l2.w0 = g.w0
      LEFT JOIN l2 p2 ON p2.doc_id = g.doc_id AND p2.w1 = g.w2 AND p2.w0 = g.w1
      LEFT JOIN l3 ON l3.doc_id = g.doc_id AND l3.w2 = g.w2 AND l3.w1 = g.w1 AND l3.w0 = g.w0)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.b, 0) AS BIGINT) AS n_backoff, coalesce(x.m, 0.0) AS log10_per_word
FROM d LEFT JOIN (SELECT doc_id, sum(b) AS b, round(sum(log10(q) + b * log10(CAST(0.4 AS DOUBLE))) / count(*), 6) AS m FROM s GROUP BY doc_id) x ON x.doc_id = d.doc_id
"""


@_query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents holding 13-word windows of benchmark items."""
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op9_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AND 20 * coalesce(cov.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


@_query
def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids in rows of 4096, packed best fit first."""
    return best_fit_pack.pack(_table(spark, sf_dir, "documents"), encode=best_fit_pack.rank_file_ids(VOCABULARY))
