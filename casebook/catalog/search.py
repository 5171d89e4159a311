"""Retrieval, matching, evidence, evaluation."""

import uuid

from pyspark.sql import functions as F

from casebook.catalog.base import given, inputs, query
from casebook.catalog.texts import content_sql, lexical_sql, terms_sql
from casebook.functions import scoring as sc
from casebook.functions import text as tx
from casebook.operators import facts as fx
from casebook.operators import windows
from casebook.operators.embedding import with_vectors
from casebook.operators.matching import nearest
from casebook.plans import evidence as ev
from casebook.plans import lexical
from casebook.plans import retrieval as rt
from casebook.session import durable, work_folder

inputs(
    # whole documents as passages, benchmark passages as questions; a source is a library
    prose="""
        SELECT doc_id AS chunk_id, doc_id, 0 AS chunk_index, text AS content, source AS library, CAST(NULL AS STRING) AS thread,
          source LIKE '%0' AS is_reference, lang || '-' || doc_id || '.txt' AS filename, CAST(NULL AS INT) AS page_start,
          CAST(NULL AS INT) AS page_end, lang AS section FROM {documents}""",
    ready_prose="SELECT p.* FROM {prose} p JOIN {labels} l ON l.doc_id = p.doc_id WHERE l.quality = 1",
    prose_questions="""
        SELECT item_id AS question_id, text, 'src' || (item_id % 20) AS library, CAST(NULL AS STRING) AS thread, item_id % 2 = 0 AS use_reference FROM {benchmark}""",
    # a workbook per brand and type, a passage per part
    workbooks="SELECT p_brand, p_type, min(p_partkey) AS doc_id FROM {part} GROUP BY p_brand, p_type",
    records="""
        SELECT p.p_partkey AS chunk_id, w.doc_id, row_number() OVER (PARTITION BY w.doc_id ORDER BY p.p_partkey) - 1 AS chunk_index,
          'Sheet Parts — Row ' || p.p_partkey || ' — Part name: ' || p.p_name || ' | Size: ' || p.p_size || ' | Grade: '
            || CASE WHEN p.p_size % 11 = 0 THEN 'Total' ELSE 'g' || (p.p_size % 7) END AS content,
          p.p_brand || ' ' || p.p_type || CASE WHEN w.doc_id % 4 = 0 THEN '.pdf' ELSE '.xlsx' END AS filename, CAST(p.p_size % 4 AS INT) AS page_start,
          CAST(p.p_size % 4 + p.p_size % 2 AS INT) AS page_end, 'Parts' AS section
        FROM {part} p JOIN {workbooks} w ON p.p_brand = w.p_brand AND p.p_type = w.p_type""",
    record_documents="SELECT doc_id, min(filename) AS filename FROM {records} GROUP BY doc_id",
    record_questions="SELECT min(question_id) AS question_id, text FROM {built_questions} GROUP BY text",
    record_facts="""
        SELECT p_partkey AS fact_id, w.doc_id, p_name || ' ' || lower(w.p_type) AS label, CAST(p_size AS STRING) AS value, p_size AS page,
          'p. ' || p_size || ' table 1 row ' || p_partkey AS locator, w.p_brand || ' ' || w.p_type || '.xlsx' AS filename
        FROM {part} p JOIN {workbooks} w ON p.p_brand = w.p_brand AND p.p_type = w.p_type""",
    part_figures="""
        SELECT p_partkey AS figure_id, p_size AS created_at, CASE p_size % 3 WHEN 0 THEN 'Figure ' || p_size || '. ' || p_name || ' of ' || p_brand
          WHEN 1 THEN 'Image from page ' || p_size ELSE 'Schematic: ' || p_type || ' assembly' END AS caption FROM {part}""",
    figure_requests="""
        SELECT min(p_partkey) AS question_id, text FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Draw a diagram of the ' || p_name
          ELSE 'diagram of the ' || p_type || ' gearbox' END AS text FROM {part}) x GROUP BY text""",
    candidates="""
        SELECT l_orderkey AS question_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_suppkey % 3 AS doc_id,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, l_quantity / 5 AS rerank_score FROM {lineitem}""",
)


# -- oracle building blocks ---------------------------------------------------------

def list_ctes(q: str, c: str, scoped: bool, x: str = "", floor: float = sc.MIN_SIMILARITY) -> str:
    """CTEs lx, vx (ranked lists) and fu (fused, ranked) for questions q and passages c; x ends their names."""
    seen = "(b.library = a.library OR (b.is_reference AND a.use_reference))" if scoped else "true"

    def weights(src: str, key: str, text: str) -> str:
        return f"""SELECT id, b, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS w FROM (
          SELECT id, CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) % 768 AS b, count(*) AS n FROM (
            SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9\\-]*')) AS w FROM {{{src}}}) GROUP BY ALL)"""

    return f"""qt{x} AS (SELECT question_id, unnest({lexical_sql('text')}) AS term FROM {{{q}}}),
      pt{x} AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM {{{c}}}) GROUP BY ALL),
      lx{x} AS (SELECT a.question_id, b.chunk_id, CAST(sum(tf) AS BIGINT) AS score, row_number() OVER (PARTITION BY a.question_id ORDER BY sum(tf) DESC, b.chunk_id) AS rank
        FROM qt{x} t JOIN pt{x} p USING (term) JOIN {{{q}}} a ON a.question_id = t.question_id JOIN {{{c}}} b ON b.chunk_id = p.chunk_id WHERE {seen}
        GROUP BY a.question_id, b.chunk_id QUALIFY rank <= 40),
      qv{x} AS ({weights(q, 'question_id', 'text')}), dv{x} AS ({weights(c, 'chunk_id', 'content')}),
      qn{x} AS (SELECT id, sqrt(sum(w * w)) AS n FROM qv{x} GROUP BY id), dn{x} AS (SELECT id, sqrt(sum(w * w)) AS n FROM dv{x} GROUP BY id),
      dots{x} AS (SELECT m.id AS question_id, o.id AS chunk_id, sum(m.w * o.w) AS dot FROM qv{x} m JOIN dv{x} o USING (b) GROUP BY 1, 2),
      vx{x} AS (SELECT a.question_id, b.chunk_id, coalesce(round(dot / (m.n * o.n), 9), 0) AS similarity,
          row_number() OVER (PARTITION BY a.question_id ORDER BY coalesce(round(dot / (m.n * o.n), 9), 0) DESC, b.chunk_id) AS rank
        FROM {{{q}}} a JOIN {{{c}}} b ON {seen} LEFT JOIN dots{x} s ON s.question_id = a.question_id AND s.chunk_id = b.chunk_id
        LEFT JOIN qn{x} m ON m.id = a.question_id LEFT JOIN dn{x} o ON o.id = b.chunk_id QUALIFY rank <= 40),
      fu{x} AS (SELECT question_id, chunk_id, round(sum(part), 12) AS rrf, row_number() OVER (PARTITION BY question_id ORDER BY round(sum(part), 12) DESC, chunk_id) AS rank FROM (
          SELECT question_id, chunk_id, CAST(0.7 AS DOUBLE) / (60 + rank) AS part FROM vx{x} WHERE similarity >= {floor}
          UNION ALL SELECT question_id, chunk_id, CAST(0.3 AS DOUBLE) / (60 + rank) FROM lx{x}) GROUP BY question_id, chunk_id)"""


HYPHEN = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9\\-]*'))"


def shared_score(a: str, b: str) -> str:
    return f"least(10, 3 * len(list_intersect({HYPHEN.format(a)}, {HYPHEN.format(b)})))"


def _asked(spark, sf, name):
    return with_vectors(given(spark, sf, name), "text", optional=True)


def _vectors(chunks):
    """Vectors of passages, written: counts, blocks and every search of a query read them, none asks the embedder again."""
    return durable(with_vectors(chunks, "content", packed=True).drop("content"))


def _spread(rows):
    """Rows in several parts for each core: Spark sizes tasks by bytes, so short texts of joined small tables would all be read by one."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _record_vectors(spark, sf):
    return _vectors(_spread(given(spark, sf, "records").select("chunk_id", "content")))


_WRITTEN: dict = {}


def _index(spark, sf, name):
    """The written lexical index of a passages table: the first query of a session writes it, all others read it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        folder = f"{work_folder(spark).rstrip('/')}/lexical-{uuid.uuid4().hex}"
        rows = given(spark, sf, name)
        rows = rows if name == "prose" else _spread(rows.select("chunk_id", "content"))
        _WRITTEN[key] = lexical.write_index(rows, folder, scoped=name == "prose")
    return _WRITTEN[key]


def _prose(spark, sf, columns=("doc_id",)):
    chunks = given(spark, sf, "prose")
    vectors = _vectors(chunks.select("chunk_id", "content", *rt.SCOPE_COLUMNS))
    return rt.retrieve(_asked(spark, sf, "prose_questions"), chunks, vectors, _index(spark, sf, "prose"), columns=columns), chunks


# -- lists and fusion -----------------------------------------------------------------

@query("lexical_top40", "WITH " + list_ctes("prose_questions", "prose", True) + " SELECT question_id, chunk_id, score, rank FROM lx")
def lexical_top40(spark, sf):
    return rt.lexical_list(given(spark, sf, "prose_questions"), given(spark, sf, "prose"), _index(spark, sf, "prose"))


@query("lexical_index_top40", "WITH " + list_ctes("record_questions", "records", False) + " SELECT question_id, chunk_id, score, rank FROM lx")
def lexical_index_top40(spark, sf):
    """Without scopes, by way of the written index of the workbooks' passages."""
    return rt.lexical_list(given(spark, sf, "record_questions"), given(spark, sf, "records"), _index(spark, sf, "records"), scoped=False)


@query("ready_top40", "WITH " + list_ctes("prose_questions", "ready_prose", True) + " SELECT question_id, chunk_id, score, rank FROM lx")
def ready_top40(spark, sf):
    """Scope taken from documents, their status and their libraries: only ready documents are searched."""
    docs = given(spark, sf, "documents")
    state = F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed").otherwise("queued")
    listed = docs.select("doc_id", F.col("source").alias("library"), F.lit(None).cast("string").alias("thread"), F.concat_ws("-", "lang", "doc_id").alias("filename"))
    listed = listed.join(given(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("status", state)
    libraries = docs.select(F.col("source").alias("library"), F.col("source").endswith("0").alias("is_reference")).distinct()
    chunks = rt.ready(docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content")), listed, libraries)
    return rt.lexical_list(given(spark, sf, "prose_questions"), chunks)


@query("lexical_scan_top40", "WITH " + list_ctes("prose_questions", "prose", True) + " SELECT question_id, chunk_id, score, rank FROM lx")
def lexical_scan_top40(spark, sf):
    """Passages read as they are, for a batch of questions that is not worth an index."""
    chunks = given(spark, sf, "prose").select("chunk_id", "content", *rt.SCOPE_COLUMNS)
    return rt.lexical_list(given(spark, sf, "prose_questions"), chunks)


@query("knn_top40", """
    SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rank
    FROM {embeddings} a JOIN {embeddings} b ON a.label = b.label OR (b.label = 0 AND a.vec_id % 2 = 0) QUALIFY rank <= 40""")
def knn_top40(spark, sf):
    """Every vector asks for its neighbours in its own library, half of them in the reference library too."""
    rows = given(spark, sf, "embeddings").withColumn("thread", F.lit(None).cast("string"))
    questions = rows.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"), F.col("label").alias("library"),
                            "thread", (F.col("vec_id") % 2 == 0).alias("use_reference"))
    items = rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").alias("library"),
                        "thread", (F.col("label") == 0).alias("is_reference"))
    return nearest(questions, items, 40).select("question_id", F.col("item_id").alias("chunk_id"), "similarity", "rank")


@query("knn_everywhere", """
    SELECT question_id, count(*) FILTER (similarity >= 0.28) AS kept, round(max(similarity), 6) AS best, round(min(similarity), 6) AS fortieth FROM (
      SELECT a.vec_id AS question_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC) AS r
      FROM {embeddings} a, {embeddings} b QUALIFY r <= 40) GROUP BY question_id""")
def knn_everywhere(spark, sf):
    """Unscoped neighbours; how many of the forty pass the similarity floor."""
    rows = given(spark, sf, "embeddings")
    found = nearest(rows.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")),
                    rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 40, scoped=False)
    return found.groupBy("question_id").agg(F.count_if(F.col("similarity") >= sc.MIN_SIMILARITY).alias("kept"),
                                            F.round(F.max("similarity"), 6).alias("best"), F.round(F.min("similarity"), 6).alias("fortieth"))


@query("hybrid_retrieval", "WITH " + list_ctes("prose_questions", "prose", True) + """
    SELECT fu.question_id, fu.chunk_id, p.filename, fu.rrf, fu.rank FROM fu JOIN {prose} p USING (chunk_id) WHERE fu.rank <= 12""")
def hybrid_retrieval(spark, sf):
    best, _ = _prose(spark, sf, ("doc_id", "filename"))
    return best.select("question_id", "chunk_id", "filename", "rrf", "rank")


@query("retrieval_scores", "WITH " + list_ctes("prose_questions", "prose", True) + """
    SELECT question_id, chunk_id, round(least(rrf / (CAST(1 AS DOUBLE) / 61), 1.0) * 6.5, 2) AS score FROM fu WHERE rank <= 12""")
def retrieval_scores(spark, sf):
    best, _ = _prose(spark, sf)
    return best.select("question_id", "chunk_id", sc.retrieval_score(F.col("rrf")).alias("score"))


@query("best_document", "WITH " + list_ctes("record_questions", "records", False) + """,
      r AS (SELECT fu.*, c.doc_id, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY fu.rrf DESC, fu.chunk_id) AS n FROM fu JOIN {records} c USING (chunk_id)),
      s AS (SELECT question_id, doc_id, round(sum(rrf), 12) AS score, min(rank) AS seen FROM r WHERE n <= 3 GROUP BY question_id, doc_id)
    SELECT question_id, doc_id, score AS document_score FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen) = 1""")
def best_document(spark, sf):
    chunks = given(spark, sf, "records")
    ranked = rt.retrieve(_asked(spark, sf, "record_questions"), chunks, _record_vectors(spark, sf), _index(spark, sf, "records"), k=None, scoped=False)
    return rt.best_document(ranked).select("question_id", "doc_id", "document_score")


_NAMED = f"""nm AS (SELECT question_id, doc_id, len(list_intersect({terms_sql('text')},
        list_distinct(list_transform(regexp_extract_all(lower(filename), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END)))) AS n
        FROM {{record_questions}}, {{record_documents}} QUALIFY n > 0 AND row_number() OVER (PARTITION BY question_id ORDER BY n DESC, doc_id) = 1)"""

_WHOLE = list_ctes("listing_questions", "records", False, "_w") + ", " + _NAMED.replace("record_questions", "listing_questions") + """,
      r AS (SELECT f.*, c.doc_id, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY f.rrf DESC, f.chunk_id) AS n FROM fu_w f JOIN {records} c USING (chunk_id)),
      s AS (SELECT question_id, doc_id, round(sum(rrf), 12) AS score, min(rank) AS seen FROM r WHERE n <= 3 GROUP BY question_id, doc_id),
      b AS (SELECT question_id, doc_id FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen) = 1),
      pick AS (SELECT question_id, coalesce(nm.doc_id, b.doc_id) AS doc_id FROM b FULL JOIN nm USING (question_id)),
      wd AS (SELECT question_id, doc_id, chunk_id, c.filename, c.content, count(*) OVER (PARTITION BY question_id) AS document_chunk_count,
          row_number() OVER (PARTITION BY question_id ORDER BY chunk_index) AS rank FROM pick JOIN {records} c USING (doc_id))"""

inputs(
    listing_questions="""
        SELECT question_id, text FROM {record_questions} WHERE lower(text) LIKE '%how many%' OR lower(text) LIKE '%list%'""",
)


def _chosen(spark, sf):
    chunks = given(spark, sf, "records")
    return rt.chosen_document(_asked(spark, sf, "listing_questions"), chunks, given(spark, sf, "record_documents"),
                              _record_vectors(spark, sf), _index(spark, sf, "records"), scoped=False), chunks


@query("whole_document", "WITH " + _WHOLE + """
    SELECT question_id, doc_id, chunk_id, rank, document_chunk_count, true AS document_complete, CAST(1 AS DOUBLE) / (60 + rank) AS rrf FROM wd""")
def whole_document(spark, sf):
    return rt.whole_document(*_chosen(spark, sf)).select("question_id", "doc_id", "chunk_id", "rank", "document_chunk_count", "document_complete", "rrf")


@query("spreadsheet_counts", "WITH " + _WHOLE + """,
      k AS (SELECT question_id, doc_id, filename, rank, regexp_extract(content, 'Part name: ([^|]*) \\|', 1) AS name FROM wd
        WHERE filename LIKE '%.xlsx' AND content NOT LIKE '%Grade: Total%')
    SELECT question_id, doc_id, filename, count(*) AS records, 'Part name' AS label, string_agg(name, '; ' ORDER BY rank) AS labels FROM k GROUP BY ALL""")
def spreadsheet_counts(spark, sf):
    return ev.spreadsheet_counts(*_chosen(spark, sf)).select("question_id", "doc_id", "filename", "records", "label", "labels")


@query("filename_match", "WITH " + _NAMED + " SELECT question_id, doc_id, n AS score FROM nm")
def filename_match(spark, sf):
    found = fx.best_filename(given(spark, sf, "record_questions"), given(spark, sf, "record_documents"))
    return found.select("question_id", "doc_id", "score")


_FACTS = f"""fm AS (SELECT q.question_id, f.fact_id, len(list_intersect({content_sql('q.text')}, {content_sql('f.label')})) AS score
        FROM {{record_questions}} q, {{record_facts}} f WHERE len(list_intersect({content_sql('q.text')}, {content_sql('f.label')})) > 0),
      ft AS (SELECT question_id, fact_id, score, row_number() OVER (PARTITION BY question_id ORDER BY fact_id) AS rank FROM fm
        WHERE score = (SELECT max(score) FROM fm b WHERE b.question_id = fm.question_id) QUALIFY rank <= 8)"""


@query("fact_match", "WITH " + _FACTS + " SELECT question_id, fact_id, score, rank FROM ft")
def fact_match(spark, sf):
    found = fx.match_facts(given(spark, sf, "record_questions"), given(spark, sf, "record_facts"))
    return found.select("question_id", "fact_id", "score", "rank")


_FIGURES = f"""fg AS (SELECT q.question_id, f.figure_id, len(list_intersect({content_sql('q.text', tx.DIAGRAM_WORDS)}, {content_sql('f.caption', tx.DIAGRAM_WORDS)})) AS score,
        least(2, len({content_sql('q.text', tx.DIAGRAM_WORDS)})) AS need, f.created_at FROM {{figure_requests}} q, {{part_figures}} f),
      fb AS (SELECT question_id, figure_id, score FROM fg WHERE score > 0 AND score >= need QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, created_at, figure_id) = 1)"""


@query("figure_match", "WITH " + _FIGURES + " SELECT question_id, figure_id, score FROM fb")
def figure_match(spark, sf):
    return fx.best_figures(given(spark, sf, "figure_requests"), given(spark, sf, "part_figures")).select("question_id", "figure_id", "score")


@query("figure_or_passages", "WITH " + _FIGURES + ", " + list_ctes("figure_requests", "records", False) + """
    SELECT question_id, 1 AS rank, figure_id, -1 AS chunk_id FROM fb
    UNION ALL SELECT question_id, rank, -1, chunk_id FROM fu WHERE rank <= 6 AND question_id NOT IN (SELECT question_id FROM fb)""")
def figure_or_passages(spark, sf):
    chunks = given(spark, sf, "records")
    rows = ev.figure_or_passages(_asked(spark, sf, "figure_requests"), given(spark, sf, "part_figures"), chunks,
                                 vectors=_record_vectors(spark, sf), scoped=False)
    return rows.select("question_id", "rank", F.coalesce("figure_id", F.lit(-1)).alias("figure_id"), F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"))


# -- reranking and evidence -------------------------------------------------------------

_RERANK = "WITH " + list_ctes("prose_questions", "prose", True) + f""",
      rr AS (SELECT fu.question_id, fu.chunk_id, fu.rank, CAST({shared_score('q.text', 'c.content')} AS DOUBLE) AS rerank_score FROM fu
        JOIN {{prose}} c USING (chunk_id) JOIN {{prose_questions}} q ON q.question_id = fu.question_id WHERE fu.rank <= 12),
      kept AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, rank) AS position FROM rr QUALIFY position <= 5)"""


def _reranked(spark, sf):
    best, chunks = _prose(spark, sf)
    texts = given(spark, sf, "prose_questions").select("question_id", "text")
    full = best.join(chunks.select("chunk_id", "content"), "chunk_id").join(texts, "question_id")
    return ev.rerank(full), best, chunks


@query("rerank_lexical", _RERANK + " SELECT question_id, chunk_id, position, rerank_score FROM kept")
def rerank_lexical(spark, sf):
    return _reranked(spark, sf)[0].select("question_id", "chunk_id", "position", "rerank_score")


@query("eval_hit_rates", _RERANK + """,
      k AS (SELECT item_id AS question_id, lower(substr(text, 20, 60)) AS kw FROM {benchmark}),
      h AS (SELECT k.question_id, coalesce(bool_or(contains(lower(c.content), k.kw)), false) AS f,
          coalesce(bool_or(contains(lower(c.content), k.kw)) FILTER (kept.chunk_id IS NOT NULL), false) AS r
        FROM k LEFT JOIN rr ON rr.question_id = k.question_id LEFT JOIN {prose} c ON c.chunk_id = rr.chunk_id
        LEFT JOIN kept ON kept.question_id = rr.question_id AND kept.chunk_id = rr.chunk_id GROUP BY k.question_id)
    SELECT count(*) AS total_cases, round(avg(CAST(f AS INT)), 3) AS fused_hit_rate, round(avg(CAST(r AS INT)), 3) AS reranked_hit_rate,
      round(avg(CAST(f AND NOT r AS INT)), 3) AS reranked_away_rate FROM h""")
def eval_hit_rates(spark, sf):
    kept, best, chunks = _reranked(spark, sf)
    cases = given(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.substring("text", 20, 60).alias("expected_keyword"),
                                                 F.lit("").alias("expected_source_file"))
    return rt.hit_rates(rt.evaluate(cases, best, kept, chunks))


@query("interleave", """
    SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY turn, queue) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY question_id, doc_id) AS queue FROM {candidates})""")
def interleave(spark, sf):
    return windows.interleaved(given(spark, sf, "candidates"), ["question_id"], "doc_id", "rank", "position").select("question_id", "chunk_id", "position")


@query("confidence", """
    WITH p AS (SELECT question_id, max(rerank_score) AS best, count(*) AS n FROM {candidates} GROUP BY question_id),
      f AS (SELECT doc_id AS question_id, count(*) AS n FROM {labels} GROUP BY doc_id)
    SELECT o_orderkey AS question_id, CASE WHEN p.n IS NULL AND f.n IS NULL THEN 'none'
      WHEN greatest(coalesce(best, 0), CASE WHEN f.n > 0 THEN 4 ELSE 0 END) >= 7 THEN 'high'
      WHEN greatest(coalesce(best, 0), CASE WHEN f.n > 0 THEN 4 ELSE 0 END) >= 4 THEN 'medium' ELSE 'low' END AS confidence
    FROM {orders} LEFT JOIN p ON p.question_id = o_orderkey LEFT JOIN f ON f.question_id = o_orderkey""")
def confidence(spark, sf):
    questions = given(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"))
    facts = given(spark, sf, "labels").select(F.col("doc_id").alias("question_id"))
    return ev.confidence_labels(questions, given(spark, sf, "candidates"), facts).select("question_id", "confidence")


@query("locations", """
    SELECT l_orderkey, l_linenumber, CASE WHEN ps > 0 AND (pe = 0 OR pe = ps) THEN 'p. ' || ps WHEN ps > 0 THEN 'pp. ' || ps || '-' || pe
      WHEN l_returnflag <> 'A' THEN l_returnflag ELSE 'Document' END AS location
    FROM (SELECT *, l_linenumber % 4 AS ps, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber % 4 + l_linenumber % 2 END AS pe FROM {lineitem})""")
def locations(spark, sf):
    n = F.col("l_linenumber")
    section = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).otherwise("")
    end = F.when(n % 3 == 0, 0).otherwise(n % 4 + n % 2)
    return given(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sc.location(n % 4, end, section).alias("location"))


@query("context_budget", """
    WITH h AS (SELECT conv_id, sum(greatest(1, length(text) // 4)) AS h FROM {conversations} GROUP BY conv_id)
    SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN least(16384, greatest(4096, d.n_chars // 4 + coalesce(h, 0) + 3000)) ELSE 4096 END AS num_ctx, d.n_chars // 4 + coalesce(h, 0) + 3000 AS tokens
    FROM {documents} d LEFT JOIN h ON h.conv_id = d.doc_id""")
def context_budget(spark, sf):
    past = given(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).alias("h"))
    rows = given(spark, sf, "documents").join(past, "doc_id", "left")
    return rows.select("doc_id", sc.context_budget(F.col("lang") == "en", F.floor(F.col("n_chars") / 4), F.col("h")).alias("num_ctx"),
                       sc.context_tokens(F.floor(F.col("n_chars") / 4), F.col("h")).alias("tokens"))


_EVIDENCE = "WITH " + list_ctes("ordinary_questions", "records", False) + ", " + _FACTS.replace("record_questions", "ordinary_questions") + f""",
      di AS (SELECT fu.question_id, fu.chunk_id, c.doc_id, fu.rank, q.text, regexp_matches(lower(q.text), '\\bcompare\\b') AS cmp,
          row_number() OVER (PARTITION BY fu.question_id, c.doc_id ORDER BY fu.rank) AS turn, min(fu.rank) OVER (PARTITION BY fu.question_id, c.doc_id) AS queue, c.content
        FROM fu JOIN {{records}} c USING (chunk_id) JOIN {{ordinary_questions}} q ON q.question_id = fu.question_id WHERE fu.rank <= 12),
      dr AS (SELECT *, CASE WHEN cmp THEN row_number() OVER (PARTITION BY question_id ORDER BY turn, queue) ELSE rank END AS place,
          CAST({shared_score('text', 'content')} AS DOUBLE) AS rerank_score FROM di),
      kp AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, place) AS position FROM dr QUALIFY position <= 5)"""

inputs(
    ordinary_questions="""
        SELECT question_id, text FROM {record_questions} WHERE NOT (lower(text) LIKE '%how many%' OR lower(text) LIKE '%list%')""",
)


def _prepared(spark, sf, questions):
    chunks = given(spark, sf, "records")
    return ev.prepare(_asked(spark, sf, questions), chunks, given(spark, sf, "record_documents"), given(spark, sf, "record_facts"),
                      _record_vectors(spark, sf), scoped=False)


@query("citations", _EVIDENCE + """,
      n AS (SELECT question_id, max(position) AS n FROM kp GROUP BY question_id)
    SELECT k.question_id, k.position AS index, 'passage' AS kind, k.doc_id, CASE WHEN c.page_start = 0 THEN 'Parts' WHEN c.page_end IN (0, c.page_start) THEN 'p. ' || c.page_start
        ELSE 'pp. ' || c.page_start || '-' || c.page_end END AS location, md5(c.content) AS snippet, k.rerank_score AS score, false AS exact
      FROM kp k JOIN {records} c USING (chunk_id)
    UNION ALL SELECT ft.question_id, coalesce(n.n, 0) + ft.rank, 'fact', f.doc_id, f.locator, md5(f.label || ': ' || f.value), -1, true
      FROM ft JOIN {record_facts} f USING (fact_id) LEFT JOIN n ON n.question_id = ft.question_id""")
def citations(spark, sf):
    sources, _ = _prepared(spark, sf, "ordinary_questions")
    return ev.public(sources).select("question_id", "index", "kind", "doc_id", "location", F.md5("snippet").alias("snippet"),
                                     F.coalesce("score", F.lit(-1.0)).alias("score"), "exact")


@query("evidence_confidence", _EVIDENCE + ", " + _WHOLE + """,
      pk AS (SELECT question_id, max(rerank_score) AS best FROM kp GROUP BY question_id), pf AS (SELECT DISTINCT question_id FROM ft)
    SELECT o.question_id, CASE WHEN pk.best IS NULL AND pf.question_id IS NULL THEN 'none' WHEN pk.best >= 7 THEN 'high'
        WHEN pk.best >= 4 OR pf.question_id IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence
      FROM {ordinary_questions} o LEFT JOIN pk USING (question_id) LEFT JOIN pf ON pf.question_id = o.question_id
    UNION ALL SELECT l.question_id, CASE WHEN n IS NULL THEN 'none' ELSE 'medium' END
      FROM {listing_questions} l LEFT JOIN (SELECT question_id, max(document_chunk_count) AS n FROM wd GROUP BY question_id) USING (question_id)""")
def evidence_confidence(spark, sf):
    return _prepared(spark, sf, "record_questions")[1].select("question_id", "confidence")


@query("evidence_pack", _EVIDENCE + """,
      n AS (SELECT question_id, max(position) AS n FROM kp GROUP BY question_id),
      s AS (SELECT k.question_id, k.position AS i, c.filename, CASE WHEN c.page_start = 0 THEN 'Parts' WHEN c.page_end IN (0, c.page_start) THEN 'p. ' || c.page_start
          ELSE 'pp. ' || c.page_start || '-' || c.page_end END AS loc, c.content FROM kp k JOIN {records} c USING (chunk_id)
        UNION ALL SELECT ft.question_id, coalesce(n.n, 0) + ft.rank, f.filename, f.locator, '(value read from a table) ' || f.label || ': ' || f.value
        FROM ft JOIN {record_facts} f USING (fact_id) LEFT JOIN n ON n.question_id = ft.question_id)
    SELECT question_id, count(*) AS sources, md5(string_agg('[' || i || '] ' || filename || ' (' || loc || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY i)) AS evidence_md5
    FROM s GROUP BY question_id""")
def evidence_pack(spark, sf):
    sources, _ = _prepared(spark, sf, "ordinary_questions")
    return ev.evidence_text(sources).select("question_id", "sources", F.md5("evidence").alias("evidence_md5"))


inputs(
    record_turns="SELECT conv_id AS question_id, turn, role, text FROM {conversations}",
)


@query("prepared_answers", _EVIDENCE + ", " + _WHOLE + """,
      an AS (SELECT question_id, max(position) AS n FROM kp GROUP BY question_id),
      ps AS (SELECT k.question_id, k.position AS i, k.chunk_id FROM kp k UNION ALL SELECT question_id, rank, chunk_id FROM wd),
      srcs AS (SELECT ps.question_id, ps.i, c.filename, CASE WHEN c.page_start = 0 THEN 'Parts' WHEN c.page_end IN (0, c.page_start) THEN 'p. ' || c.page_start
          ELSE 'pp. ' || c.page_start || '-' || c.page_end END AS loc, c.content FROM ps JOIN {records} c USING (chunk_id)
        UNION ALL SELECT ft.question_id, coalesce(an.n, 0) + ft.rank, f.filename, f.locator, '(value read from a table) ' || f.label || ': ' || f.value
        FROM ft JOIN {record_facts} f USING (fact_id) LEFT JOIN an ON an.question_id = ft.question_id),
      e AS (SELECT question_id, count(*) AS sources, sum(greatest(1, length(content) // 4)) AS tokens,
          md5(string_agg('[' || i || '] ' || filename || ' (' || loc || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY i)) AS evidence_md5 FROM srcs GROUP BY question_id),
      pk AS (SELECT question_id, max(rerank_score) AS best FROM kp GROUP BY question_id), pf AS (SELECT DISTINCT question_id FROM ft),
      ct AS (SELECT question_id, count(*) AS records FROM wd WHERE filename LIKE '%.xlsx' AND content NOT LIKE '%Grade: Total%' GROUP BY question_id),
      q AS (SELECT *, question_id IN (SELECT question_id FROM {listing_questions}) AS exhaustive FROM {record_questions}),
      t AS (SELECT t.*, exhaustive, row_number() OVER (PARTITION BY t.question_id, role ORDER BY turn DESC) AS r FROM {record_turns} t JOIN q ON q.question_id = t.question_id),
      h AS (SELECT question_id, md5(string_agg(role || ' ' || text, chr(10) ORDER BY turn)) AS history_md5, sum(greatest(1, length(text) // 4)) AS said FROM t WHERE NOT exhaustive OR (role = 'user' AND r <= 2) GROUP BY question_id)
    SELECT q.question_id, q.exhaustive, CASE WHEN q.exhaustive THEN CASE WHEN e.sources IS NULL THEN 'none' ELSE 'medium' END WHEN pk.best IS NULL AND pf.question_id IS NULL THEN 'none'
        WHEN pk.best >= 7 THEN 'high' WHEN pk.best >= 4 OR pf.question_id IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence,
      coalesce(e.sources, 0) AS sources, coalesce(evidence_md5, md5('No matching passages were found in the selected knowledge base or chat uploads.')) AS evidence_md5,
      e.sources IS NOT NULL AS evidence_found, ct.records, coalesce(history_md5, '') AS history_md5,
      CASE WHEN q.exhaustive THEN least(16384, greatest(4096, coalesce(e.tokens, 0) + coalesce(said, 0) + 3000)) ELSE 4096 END AS num_ctx
    FROM q LEFT JOIN e ON e.question_id = q.question_id LEFT JOIN pk ON pk.question_id = q.question_id LEFT JOIN pf ON pf.question_id = q.question_id
      LEFT JOIN ct ON ct.question_id = q.question_id LEFT JOIN h ON h.question_id = q.question_id""")
def prepared_answers(spark, sf):
    """The whole answer plan for count/list and ordinary questions together."""
    chunks = given(spark, sf, "records")
    rows = ev.prepared_answers(_asked(spark, sf, "record_questions"), given(spark, sf, "record_turns"), chunks, given(spark, sf, "record_documents"),
                               given(spark, sf, "record_facts"), _record_vectors(spark, sf), scoped=False)
    said = F.array_join(F.transform("history", lambda m: F.concat_ws(" ", m["role"], m["text"])), "\n")
    return rows.select("question_id", "exhaustive", "confidence", "sources", F.md5("evidence").alias("evidence_md5"), "evidence_found", "records",
                       F.coalesce(F.md5(said), F.lit("")).alias("history_md5"), "num_ctx")


@query("answer_audit", """
    SELECT message_id AS question_id, contains(lower(text), lower(p_name)) AND contains(lower(text), lower(p_type)) AS states_facts, true AS cites_source,
      regexp_matches(text, '\\[[0-9]+\\]') AS has_citations, regexp_matches(text, '(?i)from the documents') AS two_parts,
      NOT regexp_matches(text, '\\[[0-9]+\\] \\S+\\.(pdf|docx|xlsx) \\(|Exact table value -|value read from a table') AS not_pasted
    FROM {built_answers} JOIN {part} ON p_partkey = message_id""")
def answer_audit(spark, sf):
    rows = given(spark, sf, "built_answers").join(given(spark, sf, "part"), F.col("p_partkey") == F.col("message_id"))
    wanted = F.concat(F.lit("f"), (F.col("p_size") % 3).cast("string"))
    answers = rows.select(F.col("message_id").alias("question_id"), F.col("text").alias("answer"), F.array("p_name", "p_type").alias("expected"),
                          wanted.alias("expected_source"), F.array(*[F.lit(x) for x in ("a", "f0", "b", "f1", "f2")]).alias("sources"))
    return ev.audit(answers)


@query("highlighted_runs", """
    WITH r AS (SELECT doc_id, ord, trim(regexp_replace(lower(line), '[\\s\\p{Z}]+', ' ', 'g')) AS run FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM {documents}) WHERE trim(line) <> '')
    SELECT r.doc_id, r.ord, length(run) >= 4 AND contains(trim(regexp_replace(lower(d.text), '[\\s\\p{Z}]+', ' ', 'g')), run) AS marked FROM r JOIN {documents} d USING (doc_id)""")
def highlighted_runs(spark, sf):
    from casebook.sources.blocks import lines

    docs = given(spark, sf, "documents")
    cited = docs.select("doc_id", F.col("text").alias("snippet"))
    return ev.highlighted(lines(docs).withColumnRenamed("text", "run"), cited, ["doc_id"]).select("doc_id", "ord", "marked")
