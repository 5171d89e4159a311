"""Scope, roles, listings, lookups, memory and thread history."""

from pyspark.sql import functions as F

from casebook.catalog.base import given, inputs, query
from casebook.operators import scope, windows
from casebook.plans import conversations as talk

inputs(
    libraries="SELECT CAST(n_nationkey AS BIGINT) AS library, n_name AS name, n_regionkey = 0 AS is_reference FROM {nation}",
    members="""
        SELECT CAST(c_nationkey AS BIGINT) AS library, c_custkey AS user_id, CASE WHEN c_acctbal > 7000 THEN 'owner' ELSE 'member' END AS role FROM {customer}""",
    access_requests="SELECT o_orderkey AS request_id, o_custkey AS user_id, o_orderkey % 25 AS library FROM {orders}",
    threads="""
        SELECT o_orderkey AS thread, o_custkey AS user_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 25 END AS library,
          CASE WHEN o_orderstatus = 'O' THEN 'New chat' ELSE o_orderpriority END AS title FROM {orders}""",
    files_held="""
        SELECT p_partkey AS doc_id, p_name || ' ' || p_brand || CASE WHEN p_size % 3 = 0 THEN '.pdf' ELSE '.xlsx' END AS filename,
          CASE WHEN p_size < 40 THEN p_partkey % 25 END AS library, CASE WHEN p_size >= 40 THEN p_partkey END AS thread,
          CASE WHEN p_type = 'SMALL' THEN 'queued' ELSE 'ready' END AS status, p_partkey % 1500 AS uploaded_by, p_size AS created_at FROM {part}""",
    document_requests="SELECT l_orderkey * 10 + l_linenumber AS request_id, l_partkey AS doc_id, o_custkey AS user_id FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey",
    own_requests="""
        SELECT * FROM {document_requests}
        UNION ALL SELECT -1 - p_partkey, p_partkey, o_custkey FROM {part} p JOIN {orders} o ON p_partkey = o_orderkey
        UNION ALL SELECT -100000000 - p_partkey, p_partkey, p_partkey % 1500 FROM {part}""",
    scoped_questions="""
        SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 25 END AS library, o_orderkey AS thread,
          o_orderkey % 2 = 0 AS use_reference FROM {orders}""",
    notes="""
        SELECT event_id AS entry_id, user_id % 25 AS library, ts AS created_at,
          CASE event_type WHEN 'purchase' THEN 'decision' WHEN 'view' THEN 'preference' ELSE 'fact' END AS entry_type, 'value ' || CAST(CAST(floor(value) AS INT) AS STRING) AS content
        FROM {events}""",
    job_links="SELECT DISTINCT l_suppkey AS job_id, l_partkey AS doc_id FROM {lineitem} WHERE l_quantity > 25",
    check_runs="""
        SELECT l_suppkey AS job_id, l_orderkey AS checked_at, count(*) FILTER (WHERE l_returnflag = 'A') AS error, count(*) FILTER (WHERE l_returnflag = 'N') AS warning,
          count(*) FILTER (WHERE l_returnflag = 'R') AS note FROM {lineitem} WHERE l_suppkey % 4 > 0 GROUP BY l_suppkey, l_orderkey""",
    # requests of known jobs, of jobs that do not exist, and for documents that do not exist; some name a type
    attach_requests="""
        SELECT job_id, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'pqr' END AS doc_type FROM {job_links}
        UNION ALL SELECT job_id + 10000000, doc_id, NULL FROM {job_links} WHERE doc_id % 3 = 0
        UNION ALL SELECT job_id, doc_id + 10000000, NULL FROM {job_links} WHERE doc_id % 7 = 0""",
    files_named="""
        SELECT doc_id, library, CASE doc_id % 6 WHEN 0 THEN 'WPS_' || doc_id || '.docx' WHEN 1 THEN 'weld map ' || doc_id || '.xlsx' ELSE 'scan-' || doc_id || '.pdf' END AS filename FROM {files_held}""",
    # title blocks in the second passage, behind a long first one
    files_text="""
        SELECT doc_id, 0 AS chunk_index, repeat('plain words ', 100) AS content FROM {files_held}
        UNION ALL SELECT doc_id, 1, CASE doc_id % 4 WHEN 0 THEN 'of the Procedure Qualification Record no. ' || doc_id WHEN 1 THEN 'Inspection CERTIFICATE ' || doc_id ELSE 'nothing ' || doc_id END FROM {files_held}
        UNION ALL SELECT doc_id, 2, 'see the welding procedure specification' FROM {files_held} WHERE doc_id % 4 < 3""",
)

_ROLE = """SELECT r.*, l.is_reference, coalesce(m.role, CASE WHEN l.is_reference THEN 'reader' END) AS role
    FROM {0} r JOIN {{libraries}} l USING (library) LEFT JOIN {{members}} m ON m.library = r.library AND m.user_id = r.user_id
    WHERE m.user_id IS NOT NULL OR l.is_reference"""


def _roles(spark, sf):
    return scope.role(given(spark, sf, "access_requests"), given(spark, sf, "libraries"), given(spark, sf, "members"))


@query("library_roles", "SELECT request_id, user_id, library, role FROM (" + _ROLE.format("{access_requests}") + ")")
def library_roles(spark, sf):
    return _roles(spark, sf).select("request_id", "user_id", "library", "role")


@query("writable_libraries", "SELECT request_id, library, role FROM (" + _ROLE.format("{access_requests}") + ") WHERE role <> 'reader'")
def writable_libraries(spark, sf):
    return scope.writable(_roles(spark, sf)).select("request_id", "library", "role")


_VISIBLE = """SELECT r.request_id, r.user_id, d.doc_id, d.library, d.uploaded_by, m.role AS own, l.is_reference, t.user_id AS thread_owner
    FROM {own_requests} r JOIN {files_held} d ON r.doc_id = d.doc_id LEFT JOIN {libraries} l ON d.library = l.library
    LEFT JOIN {members} m ON m.library = d.library AND m.user_id = r.user_id LEFT JOIN {threads} t ON t.thread = d.thread
    WHERE CASE WHEN d.library IS NOT NULL THEN m.user_id IS NOT NULL OR l.is_reference ELSE t.user_id = r.user_id END"""


def _visible(spark, sf):
    requests, documents = given(spark, sf, "own_requests"), given(spark, sf, "files_held")
    asked = requests.join(documents.select("doc_id", "library"), "doc_id").select("user_id", "library").distinct()
    roles = scope.role(asked, given(spark, sf, "libraries"), given(spark, sf, "members"))
    return scope.visible_documents(requests, documents, given(spark, sf, "threads").select("thread", "user_id"), roles)


@query("visible_documents", "SELECT request_id, doc_id, coalesce(own, CASE WHEN is_reference THEN 'reader' END, 'thread') AS role FROM (" + _VISIBLE + ")")
def visible_documents(spark, sf):
    return _visible(spark, sf).select("request_id", "doc_id", F.coalesce("role", F.lit("thread")).alias("role"))


@query("deletable_documents", "SELECT request_id, doc_id FROM (" + _VISIBLE + ") WHERE library IS NULL OR own = 'owner' OR uploaded_by = user_id")
def deletable_documents(spark, sf):
    return scope.deletable(_visible(spark, sf)).select("request_id", "doc_id")


@query("scope_sizes", """
    WITH d AS (SELECT f.library, f.thread, l.is_reference FROM {files_held} f LEFT JOIN {libraries} l USING (library) WHERE f.status = 'ready'),
      b AS (SELECT library, any_value(is_reference) AS is_reference, count(*) AS n FROM d WHERE library IS NOT NULL GROUP BY library),
      h AS (SELECT thread, count(*) AS n FROM d WHERE thread IS NOT NULL GROUP BY thread), r AS (SELECT sum(n) AS n FROM b WHERE is_reference)
    SELECT q.question_id, CAST(coalesce(b.n, 0) + coalesce(h.n, 0)
      + CASE WHEN q.use_reference THEN (SELECT n FROM r) - CASE WHEN b.is_reference THEN b.n ELSE 0 END ELSE 0 END AS BIGINT) AS documents
    FROM {scoped_questions} q LEFT JOIN b ON b.library = q.library LEFT JOIN h ON h.thread = q.thread""")
def scope_sizes(spark, sf):
    return scope.scope_sizes(given(spark, sf, "scoped_questions"), given(spark, sf, "files_held"), given(spark, sf, "libraries"))


@query("library_listing", """
    WITH c AS (SELECT l.*, (SELECT count(*) FROM {files_held} f WHERE f.library = l.library) AS document_count FROM {libraries} l)
    SELECT m.user_id, c.library, m.role, c.name, c.document_count FROM c JOIN {members} m ON m.library = c.library
    UNION ALL SELECT -1, library, 'reader', name, document_count FROM c WHERE is_reference""")
def library_listing(spark, sf):
    rows = scope.library_listing(given(spark, sf, "libraries"), given(spark, sf, "members"), given(spark, sf, "files_held"))
    return rows.select(F.coalesce("user_id", F.lit(-1)).alias("user_id"), "library", "role", "name", "document_count")


@query("reference_counts", """
    SELECT l.library, l.name, count(f.doc_id) AS documents, count(f.doc_id) FILTER (f.status = 'ready') AS ready
    FROM {libraries} l LEFT JOIN {files_held} f ON f.library = l.library WHERE l.is_reference GROUP BY l.library, l.name""")
def reference_counts(spark, sf):
    return scope.reference_counts(given(spark, sf, "libraries"), given(spark, sf, "files_held")).select("library", "name", "documents", "ready")


@query("job_listing", """
    SELECT s_suppkey AS job_id, s_name AS name, (SELECT count(*) FROM {job_links} j WHERE j.job_id = s_suppkey) AS document_count FROM {supplier}""")
def job_listing(spark, sf):
    counts = given(spark, sf, "job_links").groupBy("job_id").agg(F.count(F.lit(1)).alias("document_count"))
    jobs = given(spark, sf, "supplier").select(F.col("s_suppkey").alias("job_id"), F.col("s_name").alias("name"))
    return jobs.join(counts, "job_id", "left").fillna(0, ["document_count"])


@query("job_views", """
    SELECT s_suppkey AS job_id, (SELECT count(*) FROM {job_links} j WHERE j.job_id = s_suppkey) AS document_count, r.checked_at, r.error, r.warning, r.note
    FROM {supplier} LEFT JOIN (SELECT * FROM {check_runs} QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY checked_at DESC) = 1) r ON r.job_id = s_suppkey""")
def job_views(spark, sf):
    from casebook.operators.checks import job_views as views

    jobs = given(spark, sf, "supplier").select(F.col("s_suppkey").alias("job_id"))
    return views(jobs, given(spark, sf, "job_links"), given(spark, sf, "check_runs"))


@query("listing_orders", """
    SELECT 'document' AS listing, library AS under, doc_id AS id, row_number() OVER (PARTITION BY library ORDER BY created_at DESC, doc_id DESC) AS place FROM {files_held} WHERE library IS NOT NULL
    UNION ALL SELECT 'library', user_id, m.library, row_number() OVER (PARTITION BY user_id ORDER BY is_reference, m.library DESC) FROM {members} m JOIN {libraries} l ON l.library = m.library
    UNION ALL SELECT 'thread', user_id, thread, row_number() OVER (PARTITION BY user_id ORDER BY thread DESC) FROM {threads}""")
def listing_orders(spark, sf):
    """Where each row stands: documents newest first, own libraries before reference ones, threads by last use."""
    docs = given(spark, sf, "files_held").filter("library IS NOT NULL")
    docs = scope.in_listing_order(docs, "library", newest="created_at", tie="doc_id", place="place")
    own = given(spark, sf, "members").join(given(spark, sf, "libraries"), "library")
    own = scope.in_listing_order(own, "user_id", "is_reference", newest="library", tie="library", place="place")
    threads = scope.in_listing_order(given(spark, sf, "threads"), "user_id", newest="thread", tie="thread", place="place")
    parts = (("document", docs, "library", "doc_id"), ("library", own, "user_id", "library"), ("thread", threads, "user_id", "thread"))
    rows = [df.select(F.lit(name).alias("listing"), F.col(under).alias("under"), F.col(key).alias("id"), "place") for name, df, under, key in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("cleared_corrections", """
    SELECT l_suppkey AS job_id, l_partkey AS doc_id, l_orderkey AS entered_at FROM {lineitem} l WHERE l_returnflag <> 'N'
      AND NOT EXISTS (SELECT 1 FROM {lineitem} c WHERE c.l_returnflag = 'N' AND c.l_suppkey = l.l_suppkey AND c.l_partkey = l.l_partkey AND c.l_orderkey >= l.l_orderkey)""")
def cleared_corrections(spark, sf):
    """A change of a document's type clears the corrections before it."""
    from casebook.operators.fields import still_valid

    rows = given(spark, sf, "lineitem").select(F.col("l_suppkey").alias("job_id"), F.col("l_partkey").alias("doc_id"), "l_returnflag", F.col("l_orderkey").alias("entered_at"))
    entered = rows.filter("l_returnflag <> 'N'").drop("l_returnflag")
    changed = rows.filter("l_returnflag = 'N'").select("job_id", "doc_id", F.col("entered_at").alias("changed_at"))
    return still_valid(entered, changed)


@query("job_documents", """
    SELECT j.job_id, j.doc_id, f.filename, f.status FROM {job_links} j JOIN {files_held} f ON f.doc_id = j.doc_id ORDER BY 1, 2""")
def job_documents(spark, sf):
    rows = given(spark, sf, "job_links").join(given(spark, sf, "files_held"), "doc_id")
    return rows.select("job_id", "doc_id", "filename", "status").orderBy("job_id", "doc_id")


@query("unattached_documents", """
    SELECT s.s_suppkey AS job_id, f.doc_id FROM {supplier} s JOIN {files_held} f ON f.library = s.s_nationkey
    WHERE NOT EXISTS (SELECT 1 FROM {job_links} j WHERE j.job_id = s.s_suppkey AND j.doc_id = f.doc_id)""")
def unattached_documents(spark, sf):
    jobs = given(spark, sf, "supplier").select(F.col("s_suppkey").alias("job_id"), F.col("s_nationkey").cast("bigint").alias("library"))
    return scope.unattached(given(spark, sf, "files_held").select("doc_id", "library"), given(spark, sf, "job_links"), jobs)


@query("attach_documents", """
    SELECT j.job_id, j.doc_id, f.filename,
      CASE WHEN s.s_suppkey IS NULL THEN 'unknown job' WHEN f.doc_id IS NULL THEN 'unknown document'
        WHEN f.library IS NULL OR f.library <> s.s_nationkey THEN 'other library' ELSE 'attached' END AS outcome,
      CASE WHEN f.library = s.s_nationkey THEN coalesce(j.doc_type, CASE WHEN f.doc_id % 6 = 0 THEN 'wps' WHEN f.doc_id % 6 = 1 THEN 'weld_log'
        WHEN f.doc_id % 4 = 0 THEN 'pqr' WHEN f.doc_id % 4 = 1 THEN 'consumable' WHEN f.doc_id % 4 = 2 THEN 'wps' ELSE 'other' END) ELSE j.doc_type END AS doc_type
    FROM {attach_requests} j LEFT JOIN {supplier} s ON s.s_suppkey = j.job_id LEFT JOIN {files_named} f ON f.doc_id = j.doc_id""")
def attach_documents(spark, sf):
    from casebook.operators.fields import attach

    jobs = given(spark, sf, "supplier").select(F.col("s_suppkey").alias("job_id"), F.col("s_nationkey").cast("bigint").alias("library"))
    kept, refused = attach(jobs, given(spark, sf, "attach_requests"), given(spark, sf, "files_named"), given(spark, sf, "files_text"))
    names = ["job_id", "doc_id", "filename", "doc_type"]
    return kept.select(*names, F.lit("attached").alias("outcome")).unionByName(refused.select(*names, F.col("reason").alias("outcome")))


@query("thread_listing", """
    SELECT t.thread, l.name, md5(m.text) AS first_message FROM {threads} t LEFT JOIN {libraries} l ON l.library = t.library
    LEFT JOIN (SELECT conv_id, text FROM {conversations} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1) m ON m.conv_id = t.thread""")
def thread_listing(spark, sf):
    messages = given(spark, sf, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("ord"), F.col("text").alias("content"))
    rows = scope.thread_listing(given(spark, sf, "threads"), given(spark, sf, "libraries"), messages)
    return rows.select("thread", "name", F.md5("first_message").alias("first_message"))


@query("thread_titles", """
    SELECT t.thread, CASE WHEN t.title = 'New chat' THEN left(d.text, 70) ELSE t.title END AS title, coalesce(l.quality, -1) AS flag
    FROM {threads} t JOIN {documents} d ON d.doc_id = t.thread LEFT JOIN {labels} l ON l.doc_id = t.thread""")
def thread_titles(spark, sf):
    docs = given(spark, sf, "documents").select(F.col("doc_id").alias("thread"), "text")
    labels = given(spark, sf, "labels").select(F.col("doc_id").alias("thread"), "quality")
    rows = given(spark, sf, "threads").join(docs, "thread").join(labels, "thread", "left")
    return rows.select("thread", scope.titled(F.col("title"), F.col("text")).alias("title"),
                       scope.patched(F.col("quality"), F.lit(-1)).alias("flag"))


@query("filename_search", "SELECT doc_id, filename FROM {files_held} WHERE contains(lower(filename), 'widget')")
def filename_search(spark, sf):
    return scope.by_name(given(spark, sf, "files_held"), "Widget").select("doc_id", "filename")


@query("key_lookup", """
    SELECT a.c_custkey, b.n_name FROM (SELECT c_custkey, 'nation_' || c_nationkey AS k FROM {customer}) a JOIN {nation} b ON lower(a.k) = lower(b.n_name)""")
def key_lookup(spark, sf):
    asked = given(spark, sf, "customer").select("c_custkey", F.concat(F.lit("nation_"), "c_nationkey").alias("k"))
    named = given(spark, sf, "nation").select("n_name", F.col("n_name").alias("k"))
    return scope.same_key(asked, named, "k").select("c_custkey", "n_name")


@query("memory_listing", """
    SELECT library, entry_id, row_number() OVER (PARTITION BY library ORDER BY created_at DESC, entry_id DESC) AS rank FROM {notes} QUALIFY rank <= 200""")
def memory_listing(spark, sf):
    return scope.memory_listing(given(spark, sf, "notes")).select("library", "entry_id", "rank")


@query("memory_block", """
    WITH n AS (SELECT * FROM {notes} QUALIFY row_number() OVER (PARTITION BY library ORDER BY created_at DESC, entry_id DESC) <= 40)
    SELECT library, string_agg('- [' || entry_type || '] ' || content, chr(10) ORDER BY created_at, entry_id) AS memory FROM n GROUP BY library""")
def memory_block(spark, sf):
    return scope.memory_block(given(spark, sf, "notes"))


@query("memory_eligible", """
    SELECT e.conv_id, e.turn FROM {conversations} e JOIN {libraries} l ON l.library = e.conv_id % 25 JOIN {labels} b ON b.doc_id = e.conv_id
    WHERE e.role = 'user' AND b.quality = 1 AND NOT l.is_reference
      AND NOT regexp_matches(lower(e.text), '\\b(how many|count|number of|total number|total count|list|enumerate)\\b')
      AND NOT (regexp_matches(lower(e.text), '\\b(all|every|each)\\b') AND regexp_matches(lower(e.text), '\\b(names?|records?|rows?|entries|items|people|members|parts?|students?)\\b'))""")
def memory_eligible(spark, sf):
    from casebook.plans.evidence import remembers

    turns = given(spark, sf, "conversations").filter("role = 'user'").withColumn("library", F.col("conv_id") % 25)
    marked = turns.join(given(spark, sf, "labels").withColumnRenamed("doc_id", "conv_id"), "conv_id")
    rows = marked.withColumn("evidence_found", F.col("quality") == 1).withColumnRenamed("text", "question")
    return remembers(rows, given(spark, sf, "libraries")).select("conv_id", "turn")


@query("history", """
    SELECT conv_id, turn, coalesce(array_to_string(list(role || ':' || left(md5(text), 6)) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), ' '), '') AS history FROM {conversations} WHERE role <> 'system'""")
def history(spark, sf):
    turns = given(spark, sf, "conversations").withColumn("diagram", F.when(F.col("role") == "system", True))
    payload = F.concat_ws(":", "role", F.left(F.md5("text"), F.lit(6)))
    rows = talk.history(turns, payload, width=1024)
    return rows.select("conv_id", "turn", F.array_join("history", " ").alias("history"))


@query("listing_history", """
    SELECT conv_id, string_agg(turn, ',' ORDER BY turn) AS turns FROM (SELECT conv_id, turn FROM {conversations} WHERE role = 'user'
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY conv_id""")
def listing_history(spark, sf):
    kept = talk.last_questions(given(spark, sf, "conversations"), 2)
    turns = F.array_sort(F.collect_list("turn")).cast("array<string>")
    return kept.groupBy("conv_id").agg(F.array_join(turns, ",").alias("turns"))


@query("exchange_pairs", """
    SELECT conv_id, turn, md5(text) AS question, md5(next) AS answer FROM (
      SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND next_role = 'assistant'""")
def exchange_pairs(spark, sf):
    rows = talk.exchanges(given(spark, sf, "conversations"), width=1024)
    return rows.select("conv_id", "turn", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query("activity_before", """
    SELECT event_id, coalesce(array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), ','), '') AS before FROM {events}""")
def activity_before(spark, sf):
    """The eight events before each event of a user, users being uneven in size; event ids follow time."""
    rows = windows.with_preceding(given(spark, sf, "events").select("event_id", "user_id"), ["user_id"], "event_id", F.col("event_id"), 8, "before", 4096)
    return rows.select("event_id", F.array_join(F.col("before").cast("array<string>"), ",").alias("before"))
