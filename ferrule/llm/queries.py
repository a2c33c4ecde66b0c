"""The registered query of each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, covertree, impact, lexical, mixing, neardup, packing, pii, quality, sharding, suffixtree, urls
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return deco


def bpe_ranks() -> str:
    """Where the public 50k byte-level BPE has its ranks (the ids of ``byte_bpe_50k.json``)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"),
                                        F.col("draws.shard").alias("shards"))


@query("op2_chat")
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame(
        [(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string"))
    return chat.digest_chats(chat.format_chats(chat.as_events(rows)))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe_ranks())


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out), metadata=("n_chars",))
    rows = quality.score(docs, model, metadata=("n_chars",), keep=["doc_id"])
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op6_embeddings")
def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), cosine=0.98)


@query("op7_lm")
def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixtree.score_texts(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2)


@query("op8_neardup")
def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n_words=3, percent=85)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
e AS (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS d FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM e AS q JOIN e AS c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query("op9_topk", OP9_SQL)
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return impact.search(rows, F.col("vec_id") % 20 == 0, k=20)


#: The rules that the URL query's contract states (fixed values).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]

OP10_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT page_id, url, strpos(url, '://') AS found_at, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
parts AS (
  SELECT page_id,
    CASE WHEN found_at > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN found_at > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    row_number() OVER () AS rn
  FROM cut),
hit AS (
  SELECT rn, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY rn ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM hit WHERE k = 1) USING (rn)
"""


@query("op10_urls", OP10_SQL)
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
docs AS (SELECT r, doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS n_docs, sum(n) AS n_terms FROM docs),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
words AS (SELECT r, unnest(t) AS term FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
norm AS (SELECT r, doc_id, 10 + ((90 * n * n_docs) // n_terms) AS m FROM docs, total),
part AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS s FROM tf JOIN weight USING (term) JOIN norm USING (r)),
score AS (SELECT item_id, r, doc_id, sum(s)::BIGINT AS score FROM items JOIN part USING (term) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM score QUALIFY rank <= 10
"""


@query("op11_lexical", OP11_SQL)
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=10)


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(f) WHERE strpos(o, f) = 0),
steps AS (
  SELECT o AS filter_order, s::INT AS step, 1 << (ascii(substr(o, s::INT, 1)) - 65) AS bit,
    list_sum([0] || [1 << (ascii(c) - 65) FOR c IN string_split(substr(o, 1, s::INT - 1), '') IF c <> ''])::INT AS before
  FROM orders, range(1, 6) AS r(s) WHERE length(o) = 5)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM counted, steps GROUP BY ALL
"""


@query("op12_audit", OP12_SQL)
def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_files(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT r, 1 AS k, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS f,
    regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS p FROM d
  UNION ALL SELECT r, 2, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
    regexp_split_to_array(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
  UNION ALL SELECT r, 3, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), regexp_split_to_array(t, '[0-9]([\x20-]?[0-9])+') FROM d
  UNION ALL SELECT r, 4, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
  UNION ALL SELECT r, 5, regexp_extract_all(t, '\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}'),
    regexp_split_to_array(t, '\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}') FROM d
  UNION ALL SELECT r, 6, regexp_extract_all(t, '[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?'),
    regexp_split_to_array(t, '[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?') FROM d),
un AS (SELECT r, k, unnest(f) AS m, unnest(p[:len(f)]) AS b, unnest(p[2:]) AS a, generate_subscripts(f, 1) AS i FROM cut WHERE len(f) > 0),
outer_m AS (
  SELECT r, k, m, b, a, (sum(length(b) + length(m)) OVER (PARTITION BY r, k ORDER BY i) - length(m))::BIGINT AS s,
    regexp_replace(m, '[^0-9]', '', 'g') AS digits, translate(right(b, 40) || ' ' || left(a, 40), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS near FROM un),
failed AS (
  SELECT r, s AS shift, regexp_extract_all(m, '[0-9]+') AS f, regexp_split_to_array(m, '[0-9]+') AS p, row_number() OVER () AS o
  FROM outer_m WHERE k = 3 AND len(m) > 19),
in_un AS (SELECT r, shift, o, unnest(f) AS m, unnest(p[:len(f)]) AS b, generate_subscripts(f, 1) AS i FROM failed),
inner_m AS (SELECT r, 7 AS k, m, shift + (sum(length(b) + length(m)) OVER (PARTITION BY o ORDER BY i) - length(m))::BIGINT AS s, o FROM in_un),
cards AS (SELECT r, k, m, s, digits, near FROM outer_m UNION ALL SELECT r, k, m, s, m, '' FROM inner_m),
checked AS (
  SELECT *, k IN (3, 7) AND length(digits) BETWEEN 13 AND 19 AND list_sum([
    CASE WHEN j % 2 = 0 THEN (c::INT * 2) // 10 + (c::INT * 2) % 10 ELSE c::INT END
    FOR c, j IN string_split(reverse(CASE WHEN k IN (3, 7) THEN digits ELSE '0' END), '')]) % 10 = 0 AS luhn FROM cards),
judged AS (
  SELECT r, m, s, CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 7 THEN 3 WHEN 6 THEN 5 ELSE 4 END AS kind,
    CASE k WHEN 1 THEN true
      WHEN 2 THEN list_max([coalesce(try_cast(ltrim(x, '0') AS BIGINT), CASE WHEN ltrim(x, '0') = '' THEN 0 ELSE 999 END)
        FOR x IN string_split(m, '.')]) <= 255
      WHEN 3 THEN luhn AND length(digits) >= 16
      WHEN 4 THEN length(digits) BETWEEN 8 AND 15 ELSE false END AS base,
    CASE k
      WHEN 3 THEN luhn AND length(digits) < 16 AND regexp_matches(near,
        '(^|[^a-z])(card|cards|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)([^a-z]|$)')
        AND NOT regexp_matches(near, '(^|[^a-z])(order|serial|isbn|tracking)([^a-z]|$)')
      WHEN 5 THEN regexp_matches(near, '(^|[^a-z])(phone|telephone|tel|call|mobile|cell|fax|telefon)([^a-z]|$)')
        AND NOT regexp_matches(near, '(^|[^a-z])(order|serial|isbn|version)([^a-z]|$)')
      WHEN 7 THEN luhn AND length(digits) >= 16 ELSE false END AS added, k
  FROM checked),
alone AS (
  SELECT r, k, s, CASE k WHEN 5 THEN NOT regexp_matches(right(b, 24), '[0-9+().-]$|[0-9+][0-9\x20().-]*$')
      AND NOT regexp_matches(left(a, 2), '^[0-9]|^[\x20.-][0-9]')
    ELSE NOT regexp_matches(right(b, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(a, 1), '[A-Za-z0-9]')
      AND length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce([0] || [CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END
        FOR c IN string_split(substr(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4), '')],
        lambda x, y: CASE WHEN y < 10 THEN (x * 10 + y) % 97 ELSE (x * 100 + y) % 97 END) = 1 END AS ok
  FROM outer_m WHERE k IN (5, 6)),
spans AS (
  SELECT j.r, j.kind, j.s, j.s + length(j.m) AS e, j.base FROM judged AS j LEFT JOIN alone AS a USING (r, k, s)
  WHERE j.base OR (j.added AND coalesce(a.ok, true)) OR (j.k = 6 AND a.ok)),
named AS (SELECT *, ['email', 'ip', 'card', 'phone', 'iban'][kind] || ':' || s || ':' || e AS name FROM spans)
SELECT doc_id, count(*) FILTER (base AND kind = 1) AS n_email, count(*) FILTER (base AND kind = 2) AS n_ip,
  count(*) FILTER (base AND kind = 3) AS n_card, count(*) FILTER (base AND kind = 4) AS n_phone,
  sha256(coalesce(string_agg(name, ',' ORDER BY kind, s) FILTER (base), '')) AS base_sha256,
  coalesce(string_agg(name, ',' ORDER BY kind, s), '') AS spans
FROM d LEFT JOIN named USING (r) GROUP BY r, doc_id
"""


@query("op13_pii", OP13_SQL)
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_pii(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))
