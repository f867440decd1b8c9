"""One query per operator, over its whole table, and the SQL twins that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage
from .common import crc_mod, table, word_count
from .conversation_repair import repair
from .filter_audit import audit_filters
from .line_quality import train_quality, with_quality
from .main_text import train_blocks, with_main_text
from .maxent_lm import score_texts
from .mixing import source_targets, systematic_mix
from .phrase_index import contaminated
from .pii import session_key, with_pseudonyms
from .risk_rules import fit_cutoffs, judge, measured
from .sentencepiece_trie import decode, encode
from .sharding import random_shards
from .simhash import near_duplicates
from .vantage import nearest

QUALITY_CUTOFF = 0.7


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = stage(source_targets(rows, F.col("source"), F.col("size")))
    mixed = systematic_mix(rows, targets, F.col("source"), F.col("size"), F.col("doc_id"))
    return mixed.select(
        "doc_id",
        "size",
        "mix.source_size",
        "mix.target",
        (F.col("mix.copies") * F.col("size")).alias("taken"),
        "mix.copies",
        "source",
    )


OP1_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source, count(*) AS n_rows, CAST(sum(size) AS HUGEINT) AS source_size FROM rows_ GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rnk,
         1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM sums),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, rnk) AS by_size FROM weighed),
left_ AS (
  SELECT *,
    (sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER (ORDER BY by_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    (sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY by_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM ordered),
stopped AS (SELECT *, 3 * source_size * weight_left < rest * weight AS full_ FROM left_),
level AS (SELECT rest AS l_rest, weight_left AS l_weight FROM stopped WHERE NOT full_ ORDER BY by_size LIMIT 1),
targets AS (
  SELECT source, n_rows, source_size,
    CASE WHEN full_ THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST(l_rest AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(l_weight AS DOUBLE) END AS target
  FROM stopped LEFT JOIN level ON true),
parts AS (
  SELECT *, CASE WHEN source_size > 0
    THEN CAST(round(target / CAST(source_size AS DOUBLE) * 1000000000000) AS HUGEINT) ELSE 0 END AS expected
  FROM targets),
binned AS (
  SELECT r.doc_id, r.size, p.*,
    CAST('0x' || substr(md5('1|' || coalesce(CAST(r.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
      % CAST(ceil(n_rows / 2000.0) AS BIGINT) AS bin
  FROM rows_ r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source),
placed AS (
  SELECT *,
    CAST(sum(expected) OVER (PARTITION BY source ORDER BY bin, size, doc_id NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS HUGEINT)
    + CAST('0x' || substr(md5('1|offset|' || coalesce(source, '')), 1, 8) AS BIGINT) % 1000000 * 1000000 AS end_
  FROM binned),
counted AS (
  SELECT *, CAST(end_ // 1000000000000 - (end_ - expected) // 1000000000000 AS BIGINT) AS copies FROM placed)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, copies * size AS taken, copies, source
FROM counted
"""


def op2_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = with_pseudonyms(docs, found="found", secret=session_key(spark))
    return done.select("doc_id", "text", F.coalesce(F.size("found"), F.lit(0)).alias("n_found"), "found")


def op4_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = measured(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    cutoffs = stage(fit_cutoffs(stats, table(spark, sf_dir, "labels")))
    return judge(stats, cutoffs).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode(encode(docs))
    return back.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
        "ids",
    )


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = with_main_text(pages, train_blocks(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = train_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = with_quality(docs, model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_CUTOFF).cast("int").alias("predicted"),
    )


def op9_random_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    placed = random_shards(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    scored, counts = score_texts(docs, ~held_out)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(counts.n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
flags AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM texts JOIN firsts USING (text) LEFT JOIN flags USING (doc_id)),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masked GROUP BY part, mask),
letters AS (SELECT unnest([0, 1, 2, 3, 4]) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT list_aggregate(list_transform(o, lambda x: substr('ABCDE', x + 1, 1)), 'string_agg', '') AS filter_order,
         step, 1 << o[step] AS bit,
         coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x)), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
cells AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM cells
"""


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contaminated(docs, items).drop("items")


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
cuts AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM items WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM cuts),
sizes AS (SELECT DISTINCT k FROM phrases),
runs AS (
  SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM docs, sizes WHERE len(w) >= k)),
found AS (SELECT r, k, s, item FROM runs JOIN phrases USING (k, phrase)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def op13_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (  -- CRC-32 bit by bit: a byte is mixed in before eight steps
  SELECT *, xor(list_reduce(
      list_concat([4294967295], flatten(list_transform(range(1, len(key) + 1),
        lambda k: [CAST(ascii(substr(key, CAST(k AS INT), 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) % 20 AS damage
  FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM crc WHERE damage <> 0),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY place) > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY place) || left(role, 1) AS pair FROM placed),
signed AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS kind,
    fault IS NOT NULL AND fault <> 'truncated' AS gone,
    CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM faulty),
counts AS (
  SELECT c, any_value(conv_id) AS conv_id, count(*) AS n,
    CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM signed GROUP BY c),
walk AS (  -- v0 to v3: cheapest rest from each state of the grammar, from the last turn to the first
  SELECT c, n AS i, {'c': 0::BIGINT, 'a': ''} AS v0, {'c': 10::BIGINT, 'a': 'II'} AS v1,
         {'c': 5::BIGINT, 'a': 'I'} AS v2, {'c': 0::BIGINT, 'a': ''} AS v3 FROM counts
  UNION ALL
  SELECT c, i - 1, list_min([b0, {'c': r2.c + 5, 'a': 'I' || r2.a}]), list_min([b1, {'c': r2.c + 5, 'a': 'I' || r2.a}]), r2, r3
  FROM (
    SELECT *, list_min([b2, {'c': b3.c + 5, 'a': 'I' || b3.a}]) AS r2, list_min([b3, {'c': b2.c + 5, 'a': 'I' || b2.a}]) AS r3
    FROM (
      SELECT w.c, w.i,
        list_min([{'c': v0.c + 2, 'a': 'D' || v0.a},
          CASE WHEN NOT gone THEN {'c': v2.c + 1 + extra, 'a': 'R' || v2.a} END,
          CASE WHEN NOT gone AND kind = 's' THEN {'c': v1.c + extra, 'a': 'K' || v1.a} END,
          CASE WHEN NOT gone AND kind = 'u' THEN {'c': v2.c + extra, 'a': 'K' || v2.a} END]) AS b0,
        list_min([{'c': v1.c + 2, 'a': 'D' || v1.a},
          CASE WHEN NOT gone THEN {'c': v2.c + 1 + extra, 'a': 'R' || v2.a} END,
          CASE WHEN NOT gone AND kind = 'u' THEN {'c': v2.c + extra, 'a': 'K' || v2.a} END]) AS b1,
        list_min([{'c': v2.c + 2, 'a': 'D' || v2.a},
          CASE WHEN NOT gone THEN {'c': v3.c + 1 + extra, 'a': 'R' || v3.a} END,
          CASE WHEN NOT gone AND kind = 'a' THEN {'c': v3.c + extra, 'a': 'K' || v3.a} END]) AS b2,
        list_min([{'c': v3.c + 2, 'a': 'D' || v3.a},
          CASE WHEN NOT gone THEN {'c': v2.c + 1 + extra, 'a': 'R' || v2.a} END,
          CASE WHEN NOT gone AND kind = 'u' THEN {'c': v2.c + extra, 'a': 'K' || v2.a} END]) AS b3
      FROM walk w JOIN signed s ON s.c = w.c AND s.place = w.i))),
best AS (SELECT c, v0.c AS cost, v0.a AS audit FROM walk WHERE i = 0),
edits AS (SELECT c, p, substr(audit, p, 1) AS e, audit FROM (SELECT c, audit, unnest(range(1, len(audit) + 1))::INT AS p FROM best)),
numbered AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY c ORDER BY p) AS place,
    count(*) FILTER (e <> 'D') OVER (PARTITION BY c ORDER BY p) AS o FROM edits),
written AS (
  SELECT n.c, n.p, n.o, e, s.role, CASE WHEN e = 'I' THEN '' ELSE s.text END AS text,
    max(CASE WHEN e = 'K' AND kind = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.c) AS system
  FROM numbered n LEFT JOIN signed s ON s.c = n.c AND s.place = n.place WHERE e <> 'D'),
hashes AS (
  SELECT c, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY p)) AS h FROM written GROUP BY c)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best USING (c) LEFT JOIN hashes USING (c)
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_vantage_points,
        op3_pseudonyms,
        op4_risk_rules,
        op5_sentencepiece,
        op6_main_text,
        op7_simhash,
        op8_line_quality,
        op9_random_shards,
        op10_maxent_lm,
        op11_filter_audit,
        op12_decontaminate,
        op13_repair_turns,
    )
}
ORACLE = {
    "op1_mix_sources": OP1_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_decontaminate": OP12_SQL,
    "op13_repair_turns": OP13_SQL,
}
