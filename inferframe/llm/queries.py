"""Queries of the ten operators for the driver contract, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, quality, toxicity
from .common import held_out, shared_dir, table
from .decontaminate import contaminated
from .embedding_dedup import embedding_components
from .line_dedup import repeated_units
from .minhash_dedup import Settings, near_duplicates
from .mixing import mix_sources
from .suffix_dedup import repeated_spans
from .tokens import read_tokens, write_tokens


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("sentences").alias("n_offending"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", "copy_no", "n_copies", "shuffle_key")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, with_ids=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = repeated_units(table(spark, sf_dir, "documents"))
    return units.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Settings(words=2))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_toxicity, op3_quality, op4_decontamination, op5_mixing, op6_token_output, op7_line_dedup, op8_language_id, op9_minhash_near_dedup, op10_suffix_array_dedup)}


_COMPONENTS = """, reach(node, other) AS (
  SELECT a, b FROM link UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.other = link.a
), comp AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
"""

OP1 = (
    """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), link AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND len(p.x) = len(q.x) AND p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.x, q.x) >= 0.98
)"""
    + _COMPONENTS
    + """
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON e.vec_id = l.a LEFT JOIN comp c ON e.vec_id = c.node
"""
)


OP5 = """
WITH c AS (SELECT source, count(*)::DOUBLE AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
r AS (SELECT source, w * (sum(n) OVER () / sum(w) OVER ()) / n AS rate FROM c),
p AS (SELECT r.source, r.rate, k.k, exp(k.k * ln(r.rate) - r.rate - lgamma(k.k + 1)) AS p FROM r, range(0, 100) k(k)),
f AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (SELECT *, ('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT d.doc_id, count(*) FILTER (WHERE f.cdf <= d.u)::INT AS n_copies FROM d JOIN f ON d.source = f.source GROUP BY d.doc_id)
SELECT x.doc_id, x.text, x.lang, x.source, x.n_chars, x.copy_no, x.n_copies,
  ('0x' || substr(md5('mix-1:' || x.doc_id || ':' || x.copy_no), 1, 13))::BIGINT AS shuffle_key
FROM (SELECT documents.*, n.n_copies, unnest(range(1, n.n_copies + 1))::INT AS copy_no FROM documents JOIN n USING (doc_id)) x
"""

OP7 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, i, line, string_split(regexp_replace(line, '([.!?]) ', '\1' || chr(1) || chr(2), 'g'), chr(1) || chr(2)) AS parts FROM l),
v AS (SELECT *, list_transform(parts, lambda x: rtrim(trim(regexp_replace(lower(x), '[\x09-\x0D\x20]+', ' ', 'g'), ' '), '.!? ')) AS norms FROM s),
p AS (SELECT doc_id, i, generate_subscripts(parts, 1) - 1 AS j, unnest(parts) AS part, unnest(norms) AS norm FROM v),
w AS (SELECT *, len(string_split(norm, ' ')) AS n FROM p WHERE norm <> ''),
m AS (SELECT *, lag(norm) OVER g AS before, lead(norm) OVER g AS behind, n + lag(n) OVER g + lead(n) OVER g AS three FROM w WINDOW g AS (PARTITION BY doc_id, i ORDER BY j)),
u AS (SELECT doc_id, i, -1 AS j, array_to_string(list_filter(norms, lambda x: x <> ''), ' ') AS norm FROM v WHERE len(list_filter(norms, lambda x: x <> '')) > 1
  UNION ALL SELECT doc_id, i, j, norm FROM w
  UNION ALL SELECT doc_id, i, j, chr(3) || ' ' || before || ' ' || chr(3) || ' ' || norm || ' ' || chr(3) || ' ' || behind FROM m WHERE n < 5 AND three >= 5),
r AS (SELECT doc_id, i, j, len(string_split(norm, ' ')) >= 5 AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, i, j) > 1 AS gone FROM u),
o AS (SELECT doc_id, i, j, bool_or(gone) AS gone FROM r GROUP BY doc_id, i, j),
g AS (SELECT p.doc_id, p.i, coalesce(bool_or(whole.gone), false) AS whole, string_agg(p.part, ' ' ORDER BY p.j) FILTER (WHERE NOT coalesce(o.gone, false)) AS kept, count(*) FILTER (WHERE o.gone) AS n
  FROM p LEFT JOIN o ON p.doc_id = o.doc_id AND p.i = o.i AND p.j = o.j LEFT JOIN o AS whole ON p.doc_id = whole.doc_id AND p.i = whole.i AND whole.j = -1 GROUP BY p.doc_id, p.i),
t AS (SELECT doc_id, coalesce(string_agg(kept, chr(10) ORDER BY i) FILTER (WHERE NOT whole AND kept IS NOT NULL), '') AS kept, sum(CASE WHEN whole THEN 1 ELSE n END) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, octet_length(encode(coalesce(d.text, '')))::BIGINT AS n_bytes,
  (octet_length(encode(coalesce(d.text, ''))) - octet_length(encode(coalesce(t.kept, ''))))::BIGINT AS n_removed,
  coalesce(t.n, 0)::BIGINT AS n_spans, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""

OP9 = (
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [hash(w[1])]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: hash(w[i] || ' ' || w[i + 1]))) END AS s FROM w
), link AS MATERIALIZED (
  SELECT p.doc_id AS a, q.doc_id AS b FROM s p JOIN s q ON p.doc_id <> q.doc_id AND len(p.s) > 0 AND len(q.s) > 0
    AND 100 * len(p.s) >= 80 * len(q.s) AND 100 * len(q.s) >= 80 * len(p.s)
  WHERE 100 * len(list_intersect(p.s, q.s)) >= 80 * (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))
)"""
    + _COMPONENTS
    + """
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(c.low, s.doc_id)) AS kept
FROM s LEFT JOIN comp c ON s.doc_id = c.node
"""
)


OP10 = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50),
g AS (SELECT p.doc_id, p.i, md5_number(substr(d.h, (2 * p.i + 1)::BIGINT, 100)) AS s FROM p JOIN d USING (doc_id)),
m AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s HAVING min(doc_id) <> max(doc_id)),
f AS (SELECT g.doc_id, g.i FROM g JOIN m USING (s) WHERE g.doc_id > m.low),
j AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM f),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM j),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
t AS (SELECT d.doc_id, r.a, r.b, lag(r.b, 1, 0) OVER (PARTITION BY d.doc_id ORDER BY r.a) AS last, d.h, d.n FROM d JOIN r USING (doc_id)),
u AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS tail,
  string_agg(substr(h, (2 * last + 1)::BIGINT, (2 * (a - last))::BIGINT), '' ORDER BY a) AS kept FROM t GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(u.removed, 0)::BIGINT AS n_removed, coalesce(u.spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(u.kept, '') || substr(d.h, (2 * coalesce(u.tail, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN u USING (doc_id)
"""


def llm_oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1, "op5_mixing": OP5, "op7_line_dedup": OP7, "op9_minhash_near_dedup": OP9, "op10_suffix_array_dedup": OP10}
