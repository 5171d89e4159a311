"""Tokenizers, folding, classifiers and other per-row text expressions."""

from pyspark.sql import functions as F

from casebook.catalog.base import given, inputs, query
from casebook.functions import parsing as ps
from casebook.functions import scoring as sc
from casebook.functions import text as tx
from casebook.sources import blocks, files

_STOP = "['" + "','".join(tx.QUESTION_STOP_WORDS) + "']"
_CONTENT_STOP = "['" + "','".join(tx.CONTENT_STOP_WORDS) + "']"
SINGULAR = "list_transform({0}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END)"


def terms_sql(text: str) -> str:
    """Distinct question terms of a text column, for oracles."""
    kept = f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w))"
    return "list_distinct(" + SINGULAR.format(kept) + ")"


def lexical_sql(text: str) -> str:
    raw = f"list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+'))"
    terms = terms_sql(text)
    return f"list_sort(CASE WHEN len({terms}) > 0 THEN {terms} ELSE {raw} END)"


def content_sql(text: str, extra: tuple = ()) -> str:
    stop = "['" + "','".join(tx.CONTENT_STOP_WORDS + extra) + "']"
    return (
        f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9\\-]*'), "
        f"lambda w: length(w) > 2 AND NOT list_contains({stop}, w)))"
    )


inputs(
    user_turns="SELECT conv_id, turn, text FROM {conversations} WHERE role = 'user'",
    built_questions="""
        SELECT p_partkey AS question_id,
          CASE p_size % 4 WHEN 0 THEN 'How many ' || p_name || ' records are there?'
            WHEN 1 THEN 'Compare ' || p_name || ' and ' || p_brand
            WHEN 2 THEN 'Please list the ' || p_type || ' of ' || p_name
            ELSE 'What is the size of the ' || p_name || '?' END AS text
        FROM {part}""",
    built_messages="""
        SELECT p_partkey AS message_id,
          CASE p_size % 4 WHEN 0 THEN 'diagram: ' || p_name WHEN 1 THEN '/diagram  ' || p_name || ' '
            WHEN 2 THEN 'Diagram - ' ELSE 'What does the diagram of ' || p_name || ' show?' END AS text
        FROM {part}""",
    built_answers="""
        SELECT p_partkey AS message_id,
          CASE p_size % 5 WHEN 0 THEN 'FROM THE DOCUMENTS:' || chr(10) || 'None.' || chr(10) || chr(10) || 'ADDITIONAL INSIGHT:' || chr(10) || 'None.'
            WHEN 1 THEN 'None.' WHEN 2 THEN '**FROM THE DOCUMENTS:** None'
            WHEN 3 THEN 'FROM THE DOCUMENTS: The ' || p_name || ' is ' || p_type || ' [1] and [' || p_size || '].'
            ELSE 'The ' || p_name || ' has size ' || p_size || ' [2].' END AS text
        FROM {part}""",
    part_cells="""
        SELECT p_partkey, 'name' AS col, p_name AS value FROM {part}
        UNION ALL SELECT p_partkey, 'size', CAST(p_size AS STRING) FROM {part}
        UNION ALL SELECT p_partkey, 'range', CAST(p_size AS STRING) || ' - ' || CAST(p_size + 10 AS STRING) || ' %' FROM {part}
        UNION ALL SELECT p_partkey, 'brand', p_brand FROM {part}""",
)


@query("token_estimate", """
    SELECT doc_id, CAST(greatest(1,
        coalesce(list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: (length(w) + 5) // 6)), 0)
        + len(regexp_extract_all(text, '[^\\p{L}\\p{N}_\\s\\p{Z}]'))) AS INTEGER) AS tokens
    FROM {documents}""")
def token_estimate(spark, sf):
    return given(spark, sf, "documents").select("doc_id", tx.token_count(F.col("text")).alias("tokens"))


@query("content_tokens", f"""
    SELECT doc_id, len({content_sql('text')}) AS n_tokens, md5(array_to_string(list_sort({content_sql('text')}), ' ')) AS tokens_md5
    FROM {{documents}}""")
def content_tokens(spark, sf):
    tokens = F.array_sort(tx.content_tokens(F.col("text")))
    return given(spark, sf, "documents").select(
        "doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


@query("question_terms", f"""
    SELECT conv_id, turn, array_to_string({lexical_sql('text')}, ' ') AS terms,
        len({terms_sql('text')}) AS n_terms FROM {{user_turns}}""")
def question_terms(spark, sf):
    return given(spark, sf, "user_turns").select(
        "conv_id", "turn", F.array_join(tx.lexical_terms(F.col("text")), " ").alias("terms"),
        F.size(tx.question_terms(F.col("text"))).alias("n_terms"))


@query("token_overlap", f"""
    SELECT c.conv_id, c.turn, len(list_intersect({content_sql('c.text')}, {content_sql('d.text')})) AS shared
    FROM {{conversations}} c JOIN {{documents}} d ON c.conv_id = d.doc_id""")
def token_overlap(spark, sf):
    c = given(spark, sf, "conversations").withColumn("a", tx.content_tokens(F.col("text"))).drop("text")
    d = given(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), tx.content_tokens(F.col("text")).alias("b"))
    return c.join(d, "conv_id").select("conv_id", "turn", F.size(F.array_intersect("a", "b")).alias("shared"))


@query("question_classes", f"""
    SELECT question_id,
      regexp_matches(lower(text), '{tx.COUNT_WORDS}') OR regexp_matches(lower(text), '{tx.LIST_WORDS}')
        OR (regexp_matches(lower(text), '{tx.EVERY_WORDS}') AND regexp_matches(lower(text), '{tx.RECORD_WORDS}')) AS exhaustive,
      regexp_matches(lower(text), '{tx.COMPARE_WORDS}') AS comparison
    FROM {{built_questions}}""")
def question_classes(spark, sf):
    return given(spark, sf, "built_questions").select(
        "question_id", tx.is_exhaustive(F.col("text")).alias("exhaustive"), tx.is_comparison(F.col("text")).alias("comparison"))


@query("diagram_requests", """
    SELECT message_id, nullif(trim(regexp_replace(text, '(?i)^\\s*/?diagram\\s*[:\\-]?\\s+', '')), '') AS request
    FROM {built_messages} WHERE regexp_matches(text, '(?i)^\\s*/?diagram\\s*[:\\-]?\\s+')
      AND trim(regexp_replace(text, '(?i)^\\s*/?diagram\\s*[:\\-]?\\s+', '')) <> ''""")
def diagram_requests(spark, sf):
    rows = given(spark, sf, "built_messages").select("message_id", tx.diagram_request(F.col("text")).alias("request"))
    return rows.filter("request IS NOT NULL")


@query("empty_answers", """
    SELECT message_id, length(regexp_replace(text,
        '(?i)from the documents:?|additional insights?:?|\\bnone\\b\\.?|[#*_:\\s]', '', 'g')) < 5 AS says_nothing
    FROM {built_answers}""")
def empty_answers(spark, sf):
    return given(spark, sf, "built_answers").select("message_id", tx.says_nothing(F.col("text")).alias("says_nothing"))


@query("citation_marks", """
    SELECT message_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '\\[([0-9]{1,2})\\]', 1),
        lambda m: CAST(m AS INTEGER)), lambda m: m >= 1 AND m <= 9), ',') AS cited FROM {built_answers}""")
def citation_marks(spark, sf):
    cited = sc.valid_citations(F.col("text"), F.lit(9))
    return given(spark, sf, "built_answers").select("message_id", F.array_join(cited.cast("array<string>"), ",").alias("cited"))


@query("numeric_cells", """
    SELECT p_partkey, col, regexp_full_match(value, '[\\s$€£₹%.,:/-]*[0-9][0-9\\s$€£₹%.,:/-]*') AS looks_numeric FROM {part_cells}""")
def numeric_cells(spark, sf):
    return given(spark, sf, "part_cells").select("p_partkey", "col", tx.looks_numeric(F.col("value")).alias("looks_numeric"))


@query("canonical_ids", """
    SELECT s_suppkey, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS canon FROM {supplier}""")
def canonical_ids(spark, sf):
    return given(spark, sf, "supplier").select("s_suppkey", ps.canon_id(F.col("s_name")).alias("canon"))


@query("folded_text", """
    SELECT doc_id, md5(trim(regexp_replace(lower(text), '[\\s\\p{Z}]+', ' ', 'g'))) AS folded FROM {documents}""")
def folded_text(spark, sf):
    return given(spark, sf, "documents").select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded"))


@query("snippets", """
    SELECT doc_id, md5(left(text, 2000)) AS snippet_md5, length(left(text, 900)) AS shown,
      trim(regexp_replace(substr(text, greatest(0, instr(text, '. ') - 40) + 1, 120), '[\\s\\p{Z}]+', ' ', 'g')) AS around
    FROM {documents}""")
def snippets(spark, sf):
    text = F.col("text")
    return given(spark, sf, "documents").select(
        "doc_id", F.md5(tx.snippet(text, 2000)).alias("snippet_md5"), F.length(tx.snippet(text, 900)).alias("shown"),
        tx.around(text, F.instr(text, ". ")).alias("around"))


@query("clean_identifiers", """
    WITH t AS (SELECT p_partkey, ': ' || p_brand || '-' || p_size || '  ' || p_name || ' -' AS raw FROM {part}),
      c AS (SELECT *, trim(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' :-') AS clean FROM t)
    SELECT p_partkey, clean, CASE WHEN regexp_matches(clean, '^[A-Za-z0-9][A-Za-z0-9_\\-/.]*[0-9]')
      THEN split_part(clean, ' ', 1) ELSE clean END AS identifier FROM c""")
def clean_identifiers(spark, sf):
    raw = F.concat(F.lit(": "), "p_brand", F.lit("-"), "p_size", F.lit("  "), "p_name", F.lit(" -"))
    return given(spark, sf, "part").select("p_partkey", ps.clean(raw).alias("clean"), ps.identifier(raw).alias("identifier"))


@query("line_blocks", """
    SELECT doc_id, ord, trim(line) AS text FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM {documents})
    WHERE trim(line) <> ''""")
def line_blocks(spark, sf):
    return blocks.lines(given(spark, sf, "documents"))


@query("low_text_route", """
    SELECT source, count(*) FILTER (length(trim(text, ' ' || chr(10) || chr(9))) < 24) AS ocr,
      count(*) FILTER (length(trim(text, ' ' || chr(10) || chr(9))) >= 24) AS text FROM {documents} GROUP BY source""")
def low_text_route(spark, sf):
    routed = given(spark, sf, "documents").withColumn("route", files.page_route(F.col("text")))
    return routed.groupBy("source").agg(
        F.count_if(F.col("route") == "ocr").alias("ocr"), F.count_if(F.col("route") == "text").alias("text"))


@query("stored_answers", """
    SELECT message_id, CASE WHEN length(regexp_replace(text,
        '(?i)from the documents:?|additional insights?:?|\\bnone\\b\\.?|[#*_:\\s]', '', 'g')) < 5
      THEN 'replaced' ELSE text END AS stored FROM {built_answers}""")
def stored_answers(spark, sf):
    from casebook.functions.replies import NOT_IN_DOCUMENTS
    from casebook.plans.evidence import stored_answer

    kept = stored_answer(F.col("text"))
    return given(spark, sf, "built_answers").select(
        "message_id", F.when(kept == NOT_IN_DOCUMENTS, "replaced").otherwise(kept).alias("stored"))


@query("split_answers", """
    WITH a AS (SELECT p_partkey AS message_id, 'FROM THE DOCUMENTS:' || chr(10) || 'Size ' || p_size || ' [1].' || chr(10) || chr(10)
        || '**Additional insight:**' || CASE WHEN p_size % 2 = 0 THEN ' None.' ELSE ' See ' || p_name END AS text, p_size, p_name FROM {part})
    SELECT message_id, 'Size ' || p_size || ' [1].' AS grounded, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'See ' || p_name END AS insight FROM a""")
def split_answers(spark, sf):
    from casebook.functions.replies import split_answer

    text = F.concat(
        F.lit("FROM THE DOCUMENTS:\nSize "), F.col("p_size").cast("string"), F.lit(" [1].\n\n**Additional insight:**"),
        F.when(F.col("p_size") % 2 == 0, " None.").otherwise(F.concat(F.lit(" See "), "p_name")))
    return given(spark, sf, "part").select(F.col("p_partkey").alias("message_id"), split_answer(text).alias("a")).select(
        "message_id", "a.grounded", "a.insight")


@query("score_replies", """
    WITH r AS (SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN '[7, 0, 10]'
        WHEN 1 THEN 'Scores: [' || p_size || ', -3]' WHEN 2 THEN '["a", "b"]' WHEN 3 THEN 'no idea' ELSE '[1, 2, 3, 4]' END AS raw FROM {part})
    SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '7.0,0.0,10.0'
        WHEN 1 THEN CAST(least(10.0, CAST(p_size AS DOUBLE)) AS DECIMAL(4,1)) || ',0.0,4.0' WHEN 2 THEN '6.5,5.0,4.0' WHEN 3 THEN '6.5,5.0,4.0' ELSE '1.0,2.0,3.0' END AS scores FROM r""")
def score_replies(spark, sf):
    from casebook.functions.replies import fill_scores, parse_scores

    size = F.col("p_size")
    raw = (F.when(size % 5 == 0, "[7, 0, 10]").when(size % 5 == 1, F.format_string("Scores: [%d, -3]", "p_size"))
           .when(size % 5 == 2, '["a", "b"]').when(size % 5 == 3, "no idea").otherwise("[1, 2, 3, 4]"))
    fallback = F.array(F.lit(6.5), F.lit(5.0), F.lit(4.0))
    filled = fill_scores(parse_scores(raw, F.lit(3)), fallback)
    shown = F.transform(filled, lambda v: v.cast("decimal(4,1)").cast("string"))
    return given(spark, sf, "part").select("p_partkey", F.array_join(shown, ",").alias("scores"))


@query("memory_replies", """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'decision' ELSE 'fact' END AS entry_type, 'Use ' || p_name AS content
    FROM {part} WHERE p_size % 4 <> 0 AND p_size % 5 <> 0""")
def memory_replies(spark, sf):
    from casebook.functions.replies import parse_memory

    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "decision").otherwise("rumour")
    raw = F.when(size % 5 == 0, "nothing").otherwise(F.format_string(
        'Sure: {"worth_remembering": %s, "entry_type": "%s", "content": " Use %s "}', F.when(size % 4 == 0, "false").otherwise("true"), kind, "p_name"))
    return given(spark, sf, "part").select("p_partkey", parse_memory(raw).alias("m")).filter("m IS NOT NULL").select("p_partkey", "m.*")
