"""Registered queries of the training-data operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casebook.llm import audit, bpe, ftrl, lines, packing, phrases, quality, sharding, simhash, spans, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"))


@query(
    "op2_warc",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS target
      FROM pages)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM target THEN target END AS refers_to
    FROM p
    """,
)
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query(
    "op4_lines",
    """
    WITH l AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents),
    k AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l),
    r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    m AS (SELECT k.*, r.first IS NOT NULL AND doc_id <> r.first AS gone FROM k LEFT JOIN r ON k.key = r.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def op4_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.digests(table(spark, folder, "documents"))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op6_ring")
def op6_ring(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.by_rows(table(spark, folder, "documents"))


@query(
    "op7_topk",
    """
    WITH v AS (
      SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS c
      FROM embeddings
      WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    p AS (
      SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score
      FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


@query("op8_packing")
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.predictions(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_quality")
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_suffix")
def op10_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return spans.digests(table(spark, folder, "documents"))


@query("op13_ftrl")
def op13_ftrl(spark: SparkSession, folder: str) -> DataFrame:
    return ftrl.predictions(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op11_phrases",
    """
    WITH p AS (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[.,;:!?\\x0A-\\x0D]')) AS piece
      FROM documents),
    w AS (SELECT lang, row_number() OVER () AS id, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS ws FROM p),
    e AS (SELECT lang, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM w),
    v AS (
      SELECT lang, [w, lead(w, 1) OVER b, lead(w, 2) OVER b, lead(w, 3) OVER b, lead(w, 4) OVER b] AS ws
      FROM e WINDOW b AS (PARTITION BY id ORDER BY pos)),
    g AS (SELECT lang, ws[:k] AS words, k FROM v, range(1, 6) AS t(k) WHERE ws[k] IS NOT NULL),
    f AS MATERIALIZED (SELECT lang, words, k, array_to_string(words, ' ') AS phrase, lang || chr(10) || phrase AS key, count(*) AS f FROM g GROUP BY ALL),
    t AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT * FROM f WHERE k >= 2 AND f >= 100),
    h AS (SELECT c.*, j, lang || chr(10) || array_to_string(words[:j], ' ') AS one, lang || chr(10) || array_to_string(words[j + 1:], ' ') AS two FROM c, range(1, 5) AS u(j) WHERE j < k),
    s AS (
      SELECT h.lang, h.phrase, h.f AS a, x.f AS l, y.f AS r, t.n, h.words, h.k, j,
             (1000::HUGEINT * h.f * t.n) // (x.f::HUGEINT * y.f) AS score
      FROM h JOIN f AS x ON x.key = h.one JOIN f AS y ON y.key = h.two JOIN t ON t.lang = h.lang),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    z AS (
      SELECT b.* FROM b
      WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.f >= 100 * b.a
                        AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
    SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
    """,
)
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query(
    "op12_audit",
    """
    WITH d AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
             [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws
      FROM documents),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    m AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
      FROM d LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, failed),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    o AS (
      SELECT v.f || w.f || x.f || y.f || z.f AS filter_order
      FROM f AS v JOIN f AS w ON w.f <> v.f JOIN f AS x ON x.f NOT IN (v.f, w.f) JOIN f AS y ON y.f NOT IN (v.f, w.f, x.f)
      JOIN f AS z ON z.f NOT IN (v.f, w.f, x.f, y.f)),
    s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS filter, filter_order[:step - 1] AS before FROM o, range(1, 6) AS r(step)),
    r AS (
      SELECT part, filter_order, step, filter, n, good, toxic,
             before <> '' AND regexp_matches(failed, '[' || before || '-]') AS earlier, contains(failed, filter) AS fails, failed = filter AS alone
      FROM c, s),
    a AS (
      SELECT part, filter_order, step, filter,
             coalesce(sum(n) FILTER (NOT earlier AND NOT fails), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (NOT earlier AND fails), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (earlier AND fails), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (NOT earlier AND fails), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (NOT earlier AND fails), 0)::BIGINT AS toxic_lost
      FROM r GROUP BY part, filter_order, step, filter)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
    FROM a
    """,
)
def op12_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))
