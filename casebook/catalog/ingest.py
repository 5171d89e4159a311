"""Admission, duplicates, block building, facts, passages and index maintenance."""

import uuid

from pyspark.sql import functions as F

from casebook.catalog.base import given, inputs, query
from casebook.operators import chunking, embedding, facts, windows
from casebook.plans import evidence
from casebook.session import durable
from casebook.sources import blocks, files

inputs(
    uploads="""
        SELECT doc_id, source AS library, text, n_chars, lang || '-' || doc_id || CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.DOCX'
          WHEN 'de' THEN '.md' ELSE '.exe' END AS filename,
          CASE WHEN lang = 'de' AND doc_id % 7 = 0 THEN 0 ELSE n_chars END AS byte_size FROM {documents}""",
    indexed_documents="""
        SELECT d.doc_id, d.source AS library, d.text,
          CASE WHEN l.quality = 1 THEN 'ready' WHEN l.quality = 0 THEN 'failed' ELSE 'queued' END AS status,
          CASE WHEN l.toxic = 1 THEN '2' ELSE '3' END AS parser_version
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    markdown_docs="""
        SELECT conv_id * 1000 + turn AS doc_id, '# ' || role || chr(10) || text || chr(10) || '## ' || role || ' ' || turn || chr(10) || 'end' AS text
        FROM {conversations}""",
    supplier_rows="""
        SELECT s_nationkey AS doc_id, s_suppkey, s_name, s_acctbal,
          2 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM {supplier}""",
    supplier_cells="""
        SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'Suppliers' AS sheet, 1 AS row, 1 AS col, 'Suppliers of ' || n_name AS value, true AS is_text FROM {nation}
        UNION ALL SELECT n_nationkey, 'Suppliers', 2, 1, 'Name', true FROM {nation}
        UNION ALL SELECT n_nationkey, 'Suppliers', 2, 2, 'Key', true FROM {nation}
        UNION ALL SELECT n_nationkey, 'Suppliers', 2, 3, ' ', true FROM {nation}
        UNION ALL SELECT doc_id, 'Suppliers', CAST(rn AS INT), 1, s_name, true FROM {supplier_rows}
        UNION ALL SELECT doc_id, 'Suppliers', CAST(rn AS INT), 2, CAST(s_suppkey AS STRING), false FROM {supplier_rows}
        UNION ALL SELECT doc_id, 'Suppliers', CAST(rn AS INT), 3, CASE WHEN s_acctbal > 5000 THEN '7' ELSE '' END, false FROM {supplier_rows}
        -- a wordy record with more labels than the header, between two plain ones
        UNION ALL SELECT n_nationkey, 'Suppliers', 100000 + p, 1, 'nut', true FROM {nation}, (SELECT 0 AS p UNION ALL SELECT 4) x
        UNION ALL SELECT n_nationkey, 'Suppliers', 100000 + p, 2, '5', false FROM {nation}, (SELECT 0 AS p UNION ALL SELECT 4) x
        UNION ALL SELECT n_nationkey, 'Suppliers', 100002, c, 'see note', true FROM {nation}, (SELECT 1 AS c UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) x""",
    figure_images="""
        SELECT l_suppkey AS doc_id, CASE WHEN l_returnflag = 'A' THEN 'docx' ELSE 'pdf' END AS kind,
          l_orderkey * 10 + l_linenumber AS ord, CAST(l_quantity * 10 AS INT) AS width, CAST(l_quantity * 20 AS INT) AS height,
          CAST(floor(l_extendedprice) AS INT) AS bytes FROM {lineitem}""",
    caption_pages="""
        SELECT p_partkey AS doc_id, p_size AS page, 'Report on ' || p_brand || chr(10) || CASE p_size % 4
          WHEN 0 THEN '  Figure ' || p_size || '. ' || p_name WHEN 1 THEN 'See the diagram of ' || p_name
          WHEN 2 THEN 'Schematic: ' || p_name || chr(10) || 'Fig 2 other' ELSE p_name END || chr(10) || 'a figure at the end ' || p_size AS text
        FROM {part}""",
    cached_extractions="""
        SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'failed' ELSE 'ready' END AS status,
          CASE WHEN d.lang = 'es' THEN 'other' ELSE 'wps' END AS doc_type,
          CASE WHEN l.doc_id IS NULL THEN NULL ELSE 1 + l.toxic + d.n_chars % 2 END AS extracted_version,
          CASE WHEN d.n_chars % 3 = 0 THEN NULL ELSE d.n_chars END AS extracted_for,
          CASE WHEN d.n_chars % 5 = 0 THEN d.n_chars + 1 ELSE d.n_chars END AS updated_at
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
)

LIMIT = 20_000  # no document comes near 50 MB
_REASON = """CASE WHEN lower(regexp_extract(filename, '\\.([^./]+)$', 1)) NOT IN ('pdf','docx','md') THEN 'unsupported type'
      WHEN byte_size = 0 THEN 'empty' WHEN byte_size > 20000 THEN 'too large' END"""


@query("admission", f"SELECT doc_id, {_REASON} AS reject_reason FROM {{uploads}}")
def admission(spark, sf):
    rows = given(spark, sf, "uploads")
    taken, rejected = files.admit(rows, files.extension(F.col("filename")), F.col("byte_size"), LIMIT)
    return taken.select("doc_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(rejected.select("doc_id", "reject_reason"))


@query("hash_duplicates", """
    SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM {documents}""")
def hash_duplicates(spark, sf):
    docs = given(spark, sf, "documents").select("doc_id", F.col("source").alias("library"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"))
    return files.mark_duplicates(docs).select("doc_id", "sha256", "duplicate")


@query("already_indexed", """
    WITH d AS (SELECT doc_id, lang AS library, sha256(text) AS h FROM {documents}), held AS (
      SELECT DISTINCT d.library, h FROM d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality = 1)
    SELECT lang AS library, count(*) AS documents, count(*) FILTER (dup) AS duplicates FROM (
      SELECT d.library AS lang, (held.h IS NOT NULL OR row_number() OVER (PARTITION BY d.library, d.h ORDER BY doc_id) > 1) AS dup
      FROM d LEFT JOIN held ON d.library = held.library AND d.h = held.h) GROUP BY lang""")
def already_indexed(spark, sf):
    docs = given(spark, sf, "documents").select("doc_id", F.col("lang").alias("library"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"))
    held = docs.join(given(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_semi")
    marked = files.mark_duplicates(docs, held)
    return marked.groupBy("library").agg(F.count(F.lit(1)).alias("documents"), F.count_if("duplicate").alias("duplicates"))


@query("load_report", f"""
    WITH u AS (SELECT *, {_REASON} AS reason FROM {{uploads}}),
      k AS (SELECT doc_id, row_number() OVER (PARTITION BY library, sha256(text) ORDER BY doc_id) > 1 AS dup FROM u WHERE reason IS NULL)
    SELECT library, outcome, count(*) AS files FROM (
      SELECT u.library, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN dup THEN 'duplicate' ELSE 'added' END AS outcome
      FROM u LEFT JOIN k ON u.doc_id = k.doc_id) GROUP BY library, outcome""")
def load_report(spark, sf):
    rows = given(spark, sf, "uploads").withColumn("sha256", F.sha2(F.encode("text", "utf-8"), 256)).drop("text")
    taken, rejected = files.admit(rows, files.extension(F.col("filename")), F.col("byte_size"), LIMIT)
    judged = files.mark_duplicates(taken).withColumn("reject_reason", F.lit(None).cast("string")).unionByName(
        rejected.withColumn("duplicate", F.lit(False)))
    return files.load_report(judged, ["library"])


@query("cascade_delete", """
    SELECT d.source, count(*) AS lines FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM {documents}) d
    WHERE trim(line) <> '' AND doc_id NOT IN (SELECT doc_id FROM {labels} WHERE toxic = 1) GROUP BY d.source""")
def cascade_delete(spark, sf):
    derived = blocks.lines(given(spark, sf, "documents"), carry=["source"])
    left = files.without(derived, given(spark, sf, "labels").filter("toxic = 1"))
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("lines"))


@query("stale_index", """
    SELECT doc_id, parser_version <> '3' AND status IN ('ready', 'failed') AS requeued,
      CASE WHEN parser_version <> '3' AND status IN ('ready', 'failed') THEN 'queued' ELSE status END AS status FROM {indexed_documents}""")
def stale_index(spark, sf):
    return files.requeue_stale(given(spark, sf, "indexed_documents"), "3").select("doc_id", "requeued", "status")


@query("keyed_merge", """
    SELECT doc_id, n_chars AS state FROM {documents} WHERE n_chars > 1000
    UNION ALL SELECT l.doc_id, l.quality FROM {labels} l WHERE l.doc_id NOT IN (SELECT doc_id FROM {documents} WHERE n_chars > 1000)""")
def keyed_merge(spark, sf):
    current = given(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("state"))
    changes = given(spark, sf, "documents").filter("n_chars > 1000").select("doc_id", F.col("n_chars").alias("state"))
    return files.merge(current, changes, ["doc_id"])


@query("keyed_insert", """
    SELECT doc_id, quality AS state FROM {labels}
    UNION ALL SELECT doc_id, n_chars FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})""")
def keyed_insert(spark, sf):
    current = given(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("state"))
    return files.merge(current, given(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("state")), ["doc_id"], update=False)


@query("latest_version", """
    SELECT user_id, event_type, event_id, value FROM {events}
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_version(spark, sf):
    rows = given(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return files.latest(rows, ["user_id", "event_type"], F.struct("ts", "event_id")).drop("ts")


@query("unreadable_documents", """
    SELECT doc_id FROM {documents} WHERE NOT regexp_matches(text, '[0-9]')""")
def unreadable_documents(spark, sf):
    docs = given(spark, sf, "documents")
    readable = blocks.lines(docs).filter(F.col("text").rlike("[0-9]"))
    return files.unreadable(docs, readable).select("doc_id")


@query("extraction_cache", """
    SELECT doc_id, status = 'ready' AND doc_type <> 'other' AND (extracted_version IS NULL OR extracted_for IS DISTINCT FROM updated_at
      OR extracted_version <> 2) AS redo FROM {cached_extractions}""")
def extraction_cache(spark, sf):
    rows = given(spark, sf, "cached_extractions")
    return rows.select("doc_id", files.needs_extraction(rows, 2).alias("redo"))


_TOKENS = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]{{1,6}}|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]'))"


def passages_sql(blocks: str) -> str:
    """CTEs down to ``pk`` (doc_id, chunk_index, content_md5, token_count, section): passages of the clean lines ``blocks``
    (doc_id, ord, line, section), 420 tokens at most, 60 repeated. Part sums stand in lists, so the next cut is a list search."""
    words = _TOKENS.format("x")
    return f"""
      w AS MATERIALIZED (SELECT doc_id, ord, section, string_split(line, ' ') AS ws, {_TOKENS.format('line')} AS whole FROM ({blocks})),
      s AS MATERIALIZED (SELECT doc_id, ord, section, ws, list_transform(range(len(ws) + 1), lambda i: coalesce(list_sum(list_transform(ws[1:i], lambda x: {words})), 0)) AS sums FROM w WHERE whole > 420),
      cut AS (SELECT doc_id, ord, 0 AS a, greatest(1, len(list_filter(sums, lambda x: x <= 420)) - 1) AS e, 0 AS piece FROM s
        UNION ALL SELECT c.doc_id, c.ord, nx, greatest(nx + 1, len(list_filter(s.sums, lambda x: x <= s.sums[nx + 1] + 420)) - 1), piece + 1
        FROM (SELECT c.*, greatest(c.a + 1, list_max(list_filter(range(c.a, c.e + 1), lambda k: k = c.a OR s.sums[c.e + 1] - s.sums[k + 1] >= 60))) AS nx
          FROM cut c JOIN s USING (doc_id, ord) WHERE c.e < len(s.ws)) c JOIN s USING (doc_id, ord)),
      parts AS (SELECT doc_id, ord, 0 AS piece, array_to_string(ws, ' ') AS t, whole AS n, section FROM w WHERE whole <= 420
        UNION ALL SELECT doc_id, ord, piece, array_to_string(ws[a + 1:e], ' '), sums[e + 1] - sums[a + 1], section FROM cut JOIN s USING (doc_id, ord)),
      d AS (SELECT doc_id, list(t ORDER BY ord, piece) AS ts, list(n ORDER BY ord, piece) AS ns, list(section ORDER BY ord, piece) AS se FROM parts GROUP BY doc_id),
      p AS MATERIALIZED (SELECT doc_id, ts, se, list_transform(range(len(ns) + 1), lambda i: coalesce(list_sum(ns[1:i]), 0)) AS sums FROM d),
      run AS (SELECT doc_id, 0 AS a, greatest(1, len(list_filter(sums, lambda x: x <= 420)) - 1) AS e, 0 AS i FROM p
        UNION ALL SELECT r.doc_id, nx, greatest(nx + 1, len(list_filter(p.sums, lambda x: x <= p.sums[nx + 1] + 420)) - 1), i + 1 FROM (
          SELECT r.*, list_min(list_filter(range(back, r.e + 1), lambda k: k = r.e OR p.sums[r.e + 2] - p.sums[k + 1] <= 420)) AS nx FROM (
            SELECT r.*, list_max(list_filter(range(r.a, r.e + 1), lambda k: NOT (k > r.a AND p.sums[r.e + 1] - p.sums[k + 1] < 60 AND p.sums[r.e + 1] - p.sums[k] <= 120))) AS back
            FROM run r JOIN p USING (doc_id) WHERE r.e < len(p.ts)) r JOIN p USING (doc_id)) r JOIN p USING (doc_id)),
      pk AS (SELECT doc_id, i AS chunk_index, md5(array_to_string(ts[a + 1:e], chr(10) || chr(10))) AS content_md5, CAST(sums[e + 1] - sums[a + 1] AS INTEGER) AS token_count,
          CASE WHEN list_contains(se[a + 1:e], 'Heading') THEN 'Heading' ELSE '' END AS section FROM run JOIN p USING (doc_id))"""


# Blocks of a page: its tags are run through a stack, an open element gets all text until it is closed.
_HTML = r"""
      tk AS (SELECT page_id, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|[^<]+') AS ts FROM {pages})),
      ty AS MATERIALIZED (SELECT page_id, i, t, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, CASE WHEN t NOT LIKE '<%' THEN 'text' WHEN regexp_matches(t, '^<(!|script|style)') OR t LIKE '%/>' THEN 'skip'
          WHEN t LIKE '</%' THEN 'close' WHEN regexp_matches(t, '^<(br|meta|img|hr|link|input)\b') THEN 'skip' ELSE 'open' END AS kind FROM tk),
      st AS (SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(tag VARCHAR, id BIGINT)[]) AS open FROM {pages}
        UNION ALL SELECT y.page_id, y.i, CASE kind WHEN 'open' THEN list_append(s.open, {'tag': y.tag, 'id': y.i})
            WHEN 'close' THEN s.open[1:coalesce(list_max(list_filter(range(1, len(s.open) + 1), lambda k: s.open[k].tag = y.tag)) - 1, len(s.open))] ELSE s.open END
          FROM st s JOIN ty y ON y.page_id = s.page_id AND y.i = s.i + 1),
      tx AS (SELECT s.page_id, s.i, regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS t, s.open FROM st s JOIN ty y ON y.page_id = s.page_id AND y.i = s.i
        WHERE kind = 'text' AND len(list_filter(s.open, lambda o: o.tag IN ('script', 'style', 'nav', 'footer'))) = 0),
      ht AS (SELECT page_id, o.id AS id, any_value(o.tag) AS tag, string_agg(t, ' ' ORDER BY i) AS text FROM (SELECT page_id, i, t, unnest(list_filter(open, lambda o: o.tag IN ('h1', 'h2', 'h3', 'p', 'li', 'td', 'th'))) AS o FROM tx WHERE t <> '') GROUP BY page_id, o.id),
      hb AS MATERIALIZED (SELECT page_id AS doc_id, row_number() OVER (PARTITION BY page_id ORDER BY id) - 1 AS ord, text, CASE WHEN tag LIKE 'h%' THEN 'Heading' ELSE '' END AS section FROM ht)"""


@query("html_blocks", f"WITH RECURSIVE {_HTML} SELECT doc_id, ord, text, section FROM hb")
def html_blocks(spark, sf):
    return blocks.html(given(spark, sf, "pages")).select("doc_id", "ord", "text", "section")


@query("html_headings", f"WITH RECURSIVE {_HTML} SELECT doc_id AS page_id, text FROM hb WHERE section = 'Heading'")
def html_headings(spark, sf):
    found = blocks.html(given(spark, sf, "pages")).filter("section = 'Heading'")
    return found.select(F.col("doc_id").alias("page_id"), "text")


@query("markdown_sections", """
    SELECT doc_id, trim(line) AS text, section FROM (
      SELECT conv_id * 1000 + turn AS doc_id, '# ' || role AS line, role AS section FROM {conversations}
      UNION ALL SELECT conv_id * 1000 + turn, unnest(string_split(text, chr(10))), role FROM {conversations}
      UNION ALL SELECT conv_id * 1000 + turn, '## ' || role || ' ' || turn, role || ' ' || turn FROM {conversations}
      UNION ALL SELECT conv_id * 1000 + turn, 'end', role || ' ' || turn FROM {conversations}) WHERE trim(line) <> ''""")
def markdown_sections(spark, sf):
    return blocks.markdown(given(spark, sf, "markdown_docs")).select("doc_id", "text", "section")


@query("sheet_records", """
    SELECT doc_id, rn AS ord, 'Sheet Suppliers — Row ' || rn || ' — Name: ' || s_name || ' | Key: ' || s_suppkey
      || CASE WHEN s_acctbal > 5000 THEN ' | Column 3: 7' ELSE '' END AS text, 'Suppliers' AS section FROM {supplier_rows}
    UNION ALL SELECT n_nationkey, 100000 + p, 'Sheet Suppliers — Row ' || (100000 + p) || ' — Name: nut | Key: 5', 'Suppliers' FROM {nation}, (SELECT unnest([0, 4]) AS p)
    UNION ALL SELECT n_nationkey, 100002, 'Sheet Suppliers — Row 100002 — Name: see note | Key: see note | Column 3: see note | Column 4: see note', 'Suppliers' FROM {nation}""")
def sheet_records(spark, sf):
    return blocks.sheet_records(given(spark, sf, "supplier_cells")).select("doc_id", "ord", "text", "section")


@query("record_parse", """
    SELECT doc_id, rn AS row, 'Name' AS header, s_name AS value FROM {supplier_rows}
    UNION ALL SELECT doc_id, rn, 'Key', CAST(s_suppkey AS VARCHAR) FROM {supplier_rows}
    UNION ALL SELECT doc_id, rn, 'Column 3', '7' FROM {supplier_rows} WHERE s_acctbal > 5000
    UNION ALL SELECT n_nationkey, 100000 + p, h, CASE h WHEN 'Name' THEN 'nut' ELSE '5' END FROM {nation}, (SELECT unnest([0, 4]) AS p), (SELECT unnest(['Name', 'Key']) AS h)
    UNION ALL SELECT n_nationkey, 100002, h, 'see note' FROM {nation}, (SELECT unnest(['Name', 'Key', 'Column 3', 'Column 4']) AS h)""")
def record_parse(spark, sf):
    chunks = blocks.sheet_records(given(spark, sf, "supplier_cells")).withColumnRenamed("text", "content")
    found = evidence.records(chunks, ["doc_id"], ["ord"])
    return found.select("doc_id", "row", F.inline("fields"))


@query("table_rows", """
    SELECT c_custkey, c_name || ' | ' || c_mktsegment || ' | ' || c_nationkey AS text FROM {customer}""")
def table_rows(spark, sf):
    cells = F.array("c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))
    return given(spark, sf, "customer").select("c_custkey", blocks.table_row(cells).alias("text"))


@query("slide_blocks", """
    SELECT conv_id AS doc_id, string_agg(role, chr(10) ORDER BY t) AS text FROM (
      SELECT conv_id, role, min(turn) AS t FROM {conversations} GROUP BY conv_id, role) GROUP BY conv_id""")
def slide_blocks(spark, sf):
    rows = given(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.col("turn").alias("ord"), F.col("role").alias("text"), F.lit("t").alias("title"))
    return blocks.slides(rows).select("doc_id", "text")


@query("pair_facts", """
    SELECT n_regionkey AS doc_id, 'table 1 row ' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS locator,
      n_name AS label, 'key ' || n_nationkey AS value FROM {nation}""")
def pair_facts(spark, sf):
    rows = given(spark, sf, "nation").select(
        F.col("n_regionkey").alias("doc_id"), F.lit(None).cast("int").alias("page"),
        facts.locator(F.lit(None).cast("int"), F.lit(1)).alias("locator"), F.col("n_nationkey").alias("row"),
        F.array("n_name", F.concat(F.lit("key "), F.col("n_nationkey").cast("string"))).alias("cells"))
    return facts.table_facts(rows).select("doc_id", "locator", "label", "value")


inputs(
    part_table="""
        SELECT p_brand AS brand, CAST(-1 AS BIGINT) AS row, 'Part' AS a, 'Type' AS b, '' AS c, 'Size' AS d FROM (SELECT DISTINCT p_brand FROM {part}) x
        UNION ALL SELECT p_brand, p_partkey, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name || '  ' || p_partkey END, p_type, 'x',
          CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size AS STRING) END FROM {part}""",
)


@query("wide_facts", """
    WITH t AS (SELECT brand, row, a, b, d, row_number() OVER (PARTITION BY brand ORDER BY row) AS n FROM {part_table}),
      e AS (SELECT *, CASE WHEN a = '' THEN 'row ' || n ELSE regexp_replace(a, ' +', ' ', 'g') END AS entity FROM t WHERE n > 1)
    SELECT brand, 'p. 3 table 1 row ' || n AS locator, entity || '.Type' AS label, b AS value FROM e
    UNION ALL SELECT brand, 'p. 3 table 1 row ' || n, entity || '.Size', d FROM e WHERE d <> ''""")
def wide_facts(spark, sf):
    rows = given(spark, sf, "part_table").select(
        F.col("brand").alias("doc_id"), F.lit(3).alias("page"), facts.locator(F.lit(3), F.lit(1)).alias("locator"), "row",
        F.array("a", "b", "c", "d").alias("cells"))
    return facts.table_facts(rows).select(F.col("doc_id").alias("brand"), "locator", "label", "value")


@query("captions", """
    SELECT doc_id, page, CASE page % 4 WHEN 0 THEN trim(string_split(text, chr(10))[2]) WHEN 1 THEN string_split(text, chr(10))[2]
      WHEN 2 THEN string_split(text, chr(10))[2] ELSE 'a figure at the end ' || page END AS caption FROM {caption_pages}""")
def captions(spark, sf):
    return given(spark, sf, "caption_pages").select("doc_id", "page", blocks.caption(F.col("text"), F.col("page")).alias("caption"))


@query("figure_admission", """
    SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS figure_no FROM {figure_images}
    WHERE CASE WHEN kind = 'pdf' THEN width >= 150 AND height >= 150 ELSE bytes >= 5000 END""")
def figure_admission(spark, sf):
    return blocks.admit_figures(given(spark, sf, "figure_images")).select("doc_id", "ord", "figure_no")


@query("chunk_provenance", """
    WITH m AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM {documents}),
      k AS (SELECT doc_id, ord, trim(line) AS t, CAST(floor(ord / 4) AS INTEGER) AS page, CASE WHEN ord % 3 = 0 THEN '' ELSE 'part ' || (ord % 3) END AS section FROM m WHERE trim(line) <> ''),
      s AS (SELECT doc_id, string_agg(section, ' / ' ORDER BY o) AS section FROM (SELECT doc_id, section, min(ord) AS o FROM k WHERE section <> '' GROUP BY doc_id, section) GROUP BY doc_id)
    SELECT k.doc_id AS chunk_id, min(page) AS page_start, max(page) AS page_end, coalesce(any_value(s.section), '') AS section,
      md5(string_agg(t, chr(10) || chr(10) ORDER BY ord)) AS content_md5 FROM k LEFT JOIN s ON k.doc_id = s.doc_id GROUP BY k.doc_id""")
def chunk_provenance(spark, sf):
    rows = blocks.lines(given(spark, sf, "documents")).select(
        F.col("doc_id").alias("chunk_id"), "ord", "text", F.floor(F.col("ord") / 4).cast("int").alias("page"),
        F.when(F.col("ord") % 3 == 0, "").otherwise(F.concat(F.lit("part "), (F.col("ord") % 3).cast("string"))).alias("section"))
    return chunking.provenance(rows).select("chunk_id", "page_start", "page_end", "section", F.md5("content").alias("content_md5"))


_LINES = """SELECT doc_id, source, ord, regexp_replace(trim(line), '[\\s\\p{Z}]+', ' ', 'g') AS line FROM (
      SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM {documents})
    WHERE trim(line) <> ''"""


def _compared(packed):
    return packed.select("doc_id", "chunk_index", F.md5("content").alias("content_md5"), "token_count", "section")


_CLEAN = _LINES.replace("regexp_replace", "'' AS section, regexp_replace", 1)


@query("chunks", "WITH RECURSIVE " + passages_sql(_CLEAN) + " SELECT * FROM pk")
def chunks(spark, sf):
    return _compared(chunking.chunk_texts(given(spark, sf, "documents")))


@query("chunks_without_overlap", f"""
    SELECT doc_id, md5(string_agg(line, ' ' ORDER BY ord)) AS content_md5 FROM ({_LINES}) GROUP BY doc_id""")
def chunks_without_overlap(spark, sf):
    """Without overlap the passages of a document, put end to end, are its text again."""
    packed = chunking.chunk_texts(given(spark, sf, "documents"), overlap=0)
    return _rejoined(packed).select("doc_id", "content_md5")


@query("chunks_across_segments", """
    WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[^\\s\\p{Z}]+')) AS w FROM {documents})
    SELECT source, count(*) AS words, CAST(sum(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint, true AS within FROM w GROUP BY source""")
def chunks_across_segments(spark, sf):
    """The lines of a whole source as one long document, packed by segments: no word is lost, none is repeated."""
    lines = blocks.lines(given(spark, sf, "documents"), carry=["source"])
    rows = lines.select(
        F.xxhash64("source").alias("doc_id"), (F.col("doc_id") * 100_000 + F.col("ord")).alias("ord"), "text",
        F.lit(None).cast("int").alias("page"), F.lit("").alias("section"))
    sources = given(spark, sf, "documents").select("source").distinct().withColumn("doc_id", F.xxhash64("source"))
    packed = chunking.chunk_blocks(rows, max_tokens=60, overlap=0, segment=200)
    spoken = packed.select("doc_id", "token_count", F.explode(F.split("content", "\\s+")).alias("w"))
    mark = F.conv(F.left(F.md5("w"), F.lit(8)), 16, 10).cast("bigint")
    sums = spoken.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.sum(mark).alias("fingerprint"), F.bool_and(F.col("token_count") <= 60).alias("within"))
    return sums.join(sources, "doc_id").select("source", "words", "fingerprint", "within")


def _rejoined(packed):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"])
    text = F.replace(F.array_join(parts, " "), F.lit("\n\n"), F.lit(" "))
    return packed.groupBy("doc_id").agg(F.md5(text).alias("content_md5"))


_PAGE_LINES = "SELECT doc_id, ord, section, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS line FROM hb"


@query("html_chunks", f"WITH RECURSIVE {_HTML}, " + passages_sql(_PAGE_LINES) + " SELECT * FROM pk")
def html_chunks(spark, sf):
    return _compared(chunking.chunk_blocks(blocks.html(given(spark, sf, "pages"))))


_SLOTS = """
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\-]*')) AS w FROM {documents}),
      b AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) % 768 AS b, count(*) AS n FROM w GROUP BY ALL)
    SELECT doc_id, count(*) AS buckets, round(max(n) / sqrt(sum(n * n)), 5) AS largest, CAST(sum(b) AS BIGINT) AS positions FROM b GROUP BY doc_id"""


@query("hashed_vectors", _SLOTS)
def hashed_vectors(spark, sf):
    return _slots(embedding.with_vectors(given(spark, sf, "documents").select("doc_id", "text"), "text").drop("text"))


def _slots(rows):
    slots = F.filter(F.transform("vector", lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: s["v"] > 0)
    return rows.select("doc_id", slots.alias("s")).filter(F.size("s") > 0).select(
        "doc_id", F.size("s").cast("bigint").alias("buckets"), F.round(F.array_max("s.v").cast("double"), 5).alias("largest"),
        F.aggregate("s", F.lit(0).cast("bigint"), lambda a, s: a + s["i"]).alias("positions"))


@query("stored_vectors", _SLOTS)
def stored_vectors(spark, sf):
    """Vectors by way of a store: one language first, then all documents, of which only new texts are embedded."""
    from casebook.session import work_folder

    docs = given(spark, sf, "documents").select("doc_id", "lang", "text")
    store = embedding.VectorStore(f"{work_folder(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}")
    store.attach(docs.filter("lang = 'en'"), "text")
    return _slots(store.attach(docs, "text").select("doc_id", "vector"))


@query("index_counters", """
    WITH li AS (SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {documents}) WHERE trim(line) <> '' GROUP BY doc_id),
      lab AS (SELECT doc_id, count(*) AS facts FROM {labels} GROUP BY doc_id), conv AS (SELECT conv_id AS doc_id, count(*) AS figures FROM {conversations} GROUP BY conv_id)
    SELECT d.doc_id, coalesce(lines, 0) AS passages, coalesce(facts, 0) AS facts, coalesce(figures, 0) AS figures
    FROM {documents} d LEFT JOIN li ON d.doc_id = li.doc_id LEFT JOIN lab ON d.doc_id = lab.doc_id LEFT JOIN conv ON d.doc_id = conv.doc_id""")
def index_counters(spark, sf):
    from casebook.plans.index import counters

    docs = given(spark, sf, "documents")
    return counters(docs.select("doc_id"), blocks.lines(docs), given(spark, sf, "labels"),
                    given(spark, sf, "conversations").withColumnRenamed("conv_id", "doc_id")).select("doc_id", "passages", "facts", "figures")


inputs(
    label_tables="""
        SELECT doc_id, CAST(NULL AS INT) AS page, 'table 1' AS locator, 1 AS row, 'Quality' AS a, CAST(quality AS STRING) AS b FROM {labels}
        UNION ALL SELECT doc_id, NULL, 'table 1', 2, 'Toxic', CASE WHEN toxic = 1 THEN 'yes' ELSE '' END FROM {labels}""",
    turn_images="SELECT conv_id AS doc_id, 'pdf' AS kind, turn AS ord, CAST(100 + 30 * turn AS INT) AS width, 200 AS height, 0 AS bytes FROM {conversations}",
)


@query("index_build", "WITH RECURSIVE " + passages_sql(_CLEAN) + """,
      c AS (SELECT doc_id, count(*) AS passages, sum(token_count) AS tokens FROM pk GROUP BY doc_id),
      f AS (SELECT doc_id, count(*) FILTER (b <> '') AS facts FROM {label_tables} GROUP BY doc_id), g AS (SELECT doc_id, count(*) FILTER (width >= 150) AS figures FROM {turn_images} GROUP BY doc_id)
    SELECT d.doc_id, coalesce(passages, 0) AS passages, coalesce(facts, 0) AS facts, coalesce(figures, 0) AS figures, coalesce(tokens, 0) AS tokens, coalesce(passages, 0) AS vectors
    FROM {documents} d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id""")
def index_build(spark, sf):
    """The whole build of an index, written as a version and read back: counters against its own tables."""
    from casebook.plans import index
    from casebook.session import work_folder

    rows = given(spark, sf, "label_tables").select("doc_id", "page", "locator", "row", F.array("a", "b").alias("cells"))
    built = index.build(given(spark, sf, "documents").select("doc_id", "text"), rows, given(spark, sf, "turn_images"), dimensions=16)
    folder = f"{work_folder(spark)}/index-{uuid.uuid4().hex}"
    index.publish(built, folder, "v1")
    version = index.current_version(spark, folder)
    chunks = index.read_part(spark, folder, "chunks", version).groupBy("doc_id").agg(
        F.sum("token_count").alias("tokens"), F.count_if(F.size("vector") == 16).alias("vectors"))
    return index.read_part(spark, folder, "documents", version).join(chunks, "doc_id", "left").fillna(0, ["tokens", "vectors"])


inputs(
    document_versions="""
        SELECT 1 AS version, doc_id, text FROM {documents}
        UNION ALL SELECT 2, doc_id, CASE WHEN doc_id % 100 = 7 THEN 'amended ' || text ELSE text END FROM {documents}
        UNION ALL SELECT 3, doc_id, CASE WHEN doc_id % 100 IN (7, 8) THEN 'amended ' || text ELSE text END FROM {documents} WHERE doc_id % 100 <> 9""",
)


@query("index_update", """
    SELECT version, doc_id, md5(string_agg(line, ' ' ORDER BY ord)) AS content_md5 FROM (
      SELECT version, doc_id, ord, regexp_replace(trim(line), '[\\s\\p{Z}]+', ' ', 'g') AS line FROM (
        SELECT version, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM {document_versions})
      WHERE trim(line) <> '') GROUP BY version, doc_id""")
def index_update(spark, sf):
    """An index of all documents, then a hundredth of them amended, then another amended and a third gone: each version read back."""
    from casebook.plans.versions import BucketedIndex
    from casebook.session import work_folder

    index = BucketedIndex(f"{work_folder(spark)}/versions-{uuid.uuid4().hex}")
    docs, k = given(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id") % 100
    amended = docs.withColumn("text", F.concat(F.lit("amended "), "text"))

    def parts(rows):
        packed = durable(chunking.chunk_texts(rows, overlap=0))
        return {"chunks": packed, "documents": packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"))}

    index.update("v1", parts(docs))
    index.update("v2", parts(amended.filter(k == 7)))
    index.update("v3", parts(amended.filter(k == 8)), docs.filter(k == 9))
    found = None
    for n in (1, 2, 3):
        rows = _rejoined(index.read(spark, "chunks", f"v{n}")).join(index.read(spark, "documents", f"v{n}"), "doc_id").filter("passages > 0")
        rows = rows.select(F.lit(n).alias("version"), "doc_id", "content_md5")
        found = rows if found is None else found.unionByName(rows)
    return found


@query("section_carry", """
    SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS)
      OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM {conversations}""")
def section_carry(spark, sf):
    heading = F.when(F.col("role") == "user", F.md5("text"))
    rows = windows.carried_forward(given(spark, sf, "conversations"), ["conv_id"], "turn", heading, "section", 1024)
    return rows.select("conv_id", "turn", "section")
