"""The queries of the training-data operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.chat_format import read_back, render, turns_of_records, turns_of_rows

    turns = turns_of_rows(table(spark, sf_dir, "conversations"), "conv_id")
    control = "<|im_end|><|im_start|>assistant ok"
    messages = json.dumps({"messages": [{"role": "user", "content": control}, {"role": "assistant", "content": control}]})
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(messages).alias("record"))
    back = read_back(render(turns.unionByName(turns_of_records(own, "conv_id", "record"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftlink.llm.token_store import read_tokens, write_tokens

    manifest, root = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(manifest, root).withColumnRenamed("id", "doc_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.language_id import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.aq_search import search

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20).withColumnRenamed("id", "vec_id")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.common import text_key, word_count
    from weftlink.llm.packing import pack

    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.when(F.length("text") > 0, text_key(F.col("text"))).alias("cluster"))
    return pack(sized, "doc_id", "size", "source", "cluster")


def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftlink.llm.token_attribution import attribute

    return attribute(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), rule="start")


def op9_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.rp_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.93).withColumnRenamed("id", "vec_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


def op11_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.sharding import balanced_shards, text_bytes

    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", text_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    law = [F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return balanced_shards(docs, F.col("size"), ["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", *law)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.centroids import centroid_clusters

    return centroid_clusters(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.code_compression import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix,
        op2_token_files,
        op3_language_id,
        op4_additive_search,
        op5_chat_format,
        op6_jaccard_join,
        op7_best_fit_packing,
        op8_token_attribution,
        op9_projection_forest,
        op10_line_dedup,
        op11_byte_shards,
        op12_centroid_clusters,
        op13_vector_codes,
    )
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce('t' || text, '')) || '|' || row_number() OVER (PARTITION BY doc_id, source, text)), 1, 15))::BIGINT AS h FROM documents),
src AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
lvl AS (
  SELECT *, row_number() OVER o AS nth,
         sum(source_size) OVER ()::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest_w
  FROM src WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST)),
fst AS (SELECT min(nth) AS f FROM lvl WHERE 3.0::DOUBLE * source_size * rest_w > w * rest),
goal AS (
  SELECT source, source_size,
         CASE WHEN nth >= f THEN w * (SELECT rest FROM lvl JOIN fst ON nth = f) / (SELECT rest_w FROM lvl JOIN fst ON nth = f)
              ELSE 3.0::DOUBLE * source_size END AS target
  FROM lvl, fst),
want AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_copies FROM goal),
cum AS (
  SELECT s.*, g.source_size, g.target, g.full_copies, g.target - g.full_copies * g.source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS upto,
         sum(size) OVER (PARTITION BY s.source, h)::DOUBLE AS own
  FROM sized s JOIN want g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       size * (full_copies + CASE WHEN rest <= 0 THEN 0 WHEN upto < rest THEN 1
                                  WHEN upto - own < rest AND upto - rest < rest - (upto - own) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM cum
"""

ORACLE_SQL["op5_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok', 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok', 'assistant', '<|im_end|><|im_start|>assistant ok'),
s AS (
  SELECT *, '<|im_start|>' || replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A') || chr(10)
            || replace(replace(text, '%', '%25'), '<|', '%3C|') || '<|im_end|>' || chr(10) AS seg FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(seg))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

#: All pairs by brute force: the query's forest is held against this.
ORACLE_SQL["op9_projection_forest"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e FROM v
  WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = v.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = v.vec_id
"""

#: Runs as lists of lines, found by joining each line with the ones after it.
ORACLE_SQL["op10_line_dedup"] = r"""
WITH docs AS (SELECT DISTINCT doc_id, text, md5(coalesce('t' || text, '')) AS tkey FROM documents),
raw AS (
  SELECT doc_id, tkey, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, tkey, string_split(text, chr(10)) AS parts FROM docs WHERE text IS NOT NULL)),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM raw),
lines AS (
  SELECT *, row_number() OVER d AS nth, sum(words) OVER (d ROWS UNBOUNDED PRECEDING) AS upto
  FROM counted WHERE words > 0 WINDOW d AS (PARTITION BY doc_id, tkey ORDER BY pos)),
spans AS (
  SELECT a.doc_id, a.tkey, a.nth AS f, min(b.nth) AS l FROM lines a JOIN lines b
    ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.tkey = b.tkey AND b.nth BETWEEN a.nth AND a.nth + 19
  WHERE b.upto - (a.upto - a.words) >= 20 GROUP BY ALL
  UNION
  SELECT b.doc_id, b.tkey, max(a.nth) AS f, b.nth AS l FROM lines a JOIN lines b
    ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.tkey = b.tkey AND b.nth BETWEEN a.nth AND a.nth + 19
  WHERE b.upto - (a.upto - a.words) >= 20 GROUP BY b.doc_id, b.tkey, b.nth),
runs AS (
  SELECT s.doc_id, s.tkey, s.f, s.l, min(n.pos) AS first, string_agg(n.line, chr(10) ORDER BY n.nth) AS run
  FROM spans s JOIN lines n ON s.doc_id IS NOT DISTINCT FROM n.doc_id AND s.tkey = n.tkey AND n.nth BETWEEN s.f AND s.l
  GROUP BY s.doc_id, s.tkey, s.f, s.l),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, tkey, first) AS nth_copy FROM runs),
gone AS (
  SELECT DISTINCT r.doc_id, r.tkey, n.pos FROM (SELECT doc_id, tkey, min(first) AS lo, max(hi) AS hi, f, l FROM (
      SELECT r.*, (SELECT max(pos) FROM lines n WHERE n.doc_id IS NOT DISTINCT FROM r.doc_id AND n.tkey = r.tkey AND n.nth = r.l) AS hi
      FROM ranked r WHERE nth_copy > 1) GROUP BY doc_id, tkey, f, l) r
  JOIN raw n ON r.doc_id IS NOT DISTINCT FROM n.doc_id AND r.tkey = n.tkey AND n.pos BETWEEN r.lo AND r.hi),
left_over AS (
  SELECT c.doc_id, c.tkey, count(*) AS n_lines, count(g.pos) AS n_deleted,
         coalesce(string_agg(c.line, chr(10) ORDER BY c.pos) FILTER (g.pos IS NULL), '') AS text,
         coalesce(sum(c.words) FILTER (g.pos IS NULL), 0) AS words
  FROM counted c LEFT JOIN gone g ON c.doc_id IS NOT DISTINCT FROM g.doc_id AND c.tkey = g.tkey AND c.pos = g.pos GROUP BY ALL)
SELECT d.doc_id, CASE WHEN n_deleted > 0 THEN CASE WHEN words > 0 THEN o.text ELSE '' END ELSE d.text END AS text,
       coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_deleted, 0)::INT AS n_deleted
FROM documents d LEFT JOIN left_over o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND md5(coalesce('t' || d.text, '')) = o.tkey
"""

#: The check sum is made byte by byte from its polynomial.
ORACLE_SQL["op11_byte_shards"] = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
bytes AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
docs AS (
  SELECT doc_id, rid, len(h) // 2 + 8 AS size,
         xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
             lambda a, b: xor(a // 256, t[(xor(a, b) % 256 + 1)::INT])), 4294967295) AS text_crc32
  FROM bytes, tab),
run AS (
  SELECT *, row_number() OVER o AS nth, (sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size)::HUGEINT AS before, (sum(size) OVER ())::HUGEINT AS total
  FROM docs WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, rid)),
put AS (SELECT *, ((2 * before + size) * 24 // (2 * total))::INT AS shard FROM run)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (nth - min(nth) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM put
"""


def _rounds(first: str, step: str, n: int) -> str:
    """Common table expressions of n rounds; {p} and {c} are the numbers of the former and this one."""
    return ",\n".join([first, *[step.format(p=i, c=i + 1) for i in range(n)]])


ORACLE_SQL["op12_centroid_clusters"] = (
    r"""
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
"""
    + _rounds(
        r"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < 16),
a0 AS (SELECT rid, min(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c0.v[i]) * (k.v[i] - c0.v[i])))::BIGINT * 16 + c) AS m FROM kept k, c0 GROUP BY rid)""",
        r"""s{c} AS (SELECT m % 16 AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM kept JOIN a{p} USING (rid), range(1, 65) t(i) GROUP BY m % 16, i),
m{c} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{c} GROUP BY c),
c{c} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{p} o LEFT JOIN m{c} m ON o.c = m.c),
a{c} AS (SELECT rid, min(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c{c}.v[i]) * (k.v[i] - c{c}.v[i])))::BIGINT * 16 + c) AS m FROM kept k, c{c} GROUP BY rid)""",
        3,
    )
    + r"""
SELECT vec_id, (m % 16)::INT AS cluster, m // 16 AS distance, (sum(m // 16) OVER (PARTITION BY m % 16))::BIGINT AS cluster_inertia,
       (sum(m // 16) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM kept JOIN a3 USING (rid) JOIN c3 ON c3.c = m % 16
"""
)

ORACLE_SQL["op13_vector_codes"] = (
    r"""
WITH fine AS (
  SELECT vec_id, label, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT len(v) // 16 AS w FROM fine WHERE len(v) > 0 AND len(v) % 16 = 0 GROUP BY len(v) ORDER BY count(*) DESC, len(v) LIMIT 1),
kept AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM fine, w WHERE len(v) = 16 * w),
parts AS (SELECT rid, e, p, w, v[(p * w + 1):(p * w + w)] AS v FROM kept, range(16) t(p)),
"""
    + _rounds(
        r"""c0 AS (SELECT p, e, v FROM parts WHERE e < 64),
a0 AS (SELECT rid, p, min(list_sum(list_transform(range(1, w + 1), lambda i: (k.v[i] - c0.v[i]) * (k.v[i] - c0.v[i])))::BIGINT * 64 + c0.e) AS m FROM parts k JOIN c0 USING (p) GROUP BY rid, p)""",
        r"""s{c} AS (SELECT p, m % 64 AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, m, v, unnest(range(1, w + 1)) AS i FROM parts JOIN a{p} USING (rid, p)) GROUP BY p, m % 64, i),
m{c} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{c} GROUP BY p, e),
c{c} AS (SELECT o.p, o.e, coalesce(m.v, o.v) AS v FROM c{p} o LEFT JOIN m{c} m ON o.p = m.p AND o.e = m.e),
a{c} AS (SELECT rid, p, min(list_sum(list_transform(range(1, w + 1), lambda i: (k.v[i] - c{c}.v[i]) * (k.v[i] - c{c}.v[i])))::BIGINT * 64 + c{c}.e) AS m FROM parts k JOIN c{c} USING (p) GROUP BY rid, p)""",
        2,
    )
    + r""",
coded AS (SELECT rid, string_agg(lower(format('{:02x}', m % 64)), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), book
"""
)
