"""Who sees what: libraries, roles, visible documents, and listing projections.

Access is a chain of equi-joins on requests. The users x reference-libraries product is never formed: a
reference library is listed once, for every account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.operators.windows import first_row, top_k

# Jobs and documents of a library meet in cells of some so many of either.
JOB_BLOCK = 4096
DOCUMENT_BLOCK = 4096


def role(requests: DataFrame, libraries: DataFrame, members: DataFrame) -> DataFrame:
    """(user, library) requests with the caller's role: own, else reader of a reference library.

    Requests without access are dropped.
    """
    known = requests.join(libraries.select("library", "is_reference"), "library")
    joined = known.join(members.select("library", "user_id", F.col("role").alias("_own")), ["library", "user_id"], "left")
    granted = F.coalesce("_own", F.when(F.col("is_reference"), "reader"))
    return joined.withColumn("role", granted).filter("role IS NOT NULL").drop("_own")


def writable(roles: DataFrame) -> DataFrame:
    """Libraries a caller may change."""
    return roles.filter(F.col("role") != "reader")


def library_listing(libraries: DataFrame, members: DataFrame, documents: DataFrame) -> DataFrame:
    """Memberships with their role, then reference libraries once for everyone (user null); document counts."""
    counts = documents.groupBy("library").agg(F.count(F.lit(1)).alias("document_count"))
    sized = libraries.join(counts, "library", "left").withColumn(
        "document_count", F.coalesce("document_count", F.lit(0)).cast("bigint")
    )
    own = members.select("user_id", "library", "role").join(sized, "library")
    shared = sized.filter("is_reference").withColumn("user_id", F.lit(None).cast(dict(members.dtypes)["user_id"])).withColumn(
        "role", F.lit("reader")
    )
    return own.unionByName(shared)


def visible_documents(requests: DataFrame, documents: DataFrame, threads: DataFrame, roles: DataFrame) -> DataFrame:
    """(user, document) requests that may be seen, with the library role.

    ``roles``: user_id, library, role as ``role`` gives them for these requests.
    """
    asked = requests.join(documents, "doc_id")
    by_library = asked.filter("library IS NOT NULL").join(roles.select("user_id", "library", "role"), ["user_id", "library"])
    by_thread = (
        asked.filter("library IS NULL")
        .join(threads.select("thread", F.col("user_id").alias("_owner")), "thread")
        .filter("_owner = user_id").drop("_owner").withColumn("role", F.lit(None).cast("string"))
    )
    return by_library.unionByName(by_thread)


def deletable(visible: DataFrame) -> DataFrame:
    """Of the visible documents, those the caller may delete."""
    return visible.filter(
        F.col("library").isNull() | F.coalesce(F.col("role") == "owner", F.lit(False)) | (F.col("uploaded_by") == F.col("user_id"))
    )


def question_scopes(questions: DataFrame, libraries: DataFrame) -> DataFrame:
    """The libraries each question searches: its own, and the reference ones behind one shared key.

    Every question names at most three scope keys, so the OR of the scope rule becomes an equi-join on
    ``scope_key`` against ``document_scopes``, where each document row appears once per key it answers to.
    """
    keys = F.array_compact(
        F.array(
            F.when(F.col("library").isNotNull(), F.concat(F.lit("library:"), F.col("library").cast("string"))),
            F.when(F.col("thread").isNotNull(), F.concat(F.lit("thread:"), F.col("thread").cast("string"))),
            F.when(F.col("use_reference"), F.lit("reference")),
        )
    )
    scoped = questions.select("question_id", "library", F.explode(keys).alias("scope_key"))
    reference = libraries.filter("is_reference").select("library", F.lit(True).alias("_own_is_reference"))
    return scoped.join(reference, "library", "left").select(
        "question_id", "scope_key", F.coalesce("_own_is_reference", F.lit(False)).alias("own_is_reference")
    )


def scope_sizes(questions: DataFrame, documents: DataFrame, libraries: DataFrame) -> DataFrame:
    """How many ready documents each question can search (F1).

    Documents are counted per scope key first; a question then adds up at most three counts. A question
    whose own library is a reference library counts it once.
    """
    ready = documents.filter("status = 'ready'").join(
        libraries.filter("is_reference").select("library", F.lit(True).alias("_ref")), "library", "left"
    )
    keys = F.array_compact(
        F.array(
            F.when(F.col("library").isNotNull(), F.concat(F.lit("library:"), F.col("library").cast("string"))),
            F.when(F.col("thread").isNotNull(), F.concat(F.lit("thread:"), F.col("thread").cast("string"))),
            F.when(F.col("_ref"), F.lit("reference")),
        )
    )
    sizes = ready.select(F.explode(keys).alias("scope_key")).groupBy("scope_key").agg(F.count(F.lit(1)).alias("n"))
    scopes = question_scopes(questions, libraries).withColumn(
        "_use", F.max(F.col("scope_key") == "reference").over(Window.partitionBy("question_id"))
    )
    once = ~(F.col("own_is_reference") & F.col("_use") & F.col("scope_key").startswith("library:"))
    found = scopes.filter(once).join(sizes, "scope_key").groupBy("question_id").agg(F.sum("n").alias("n"))
    return questions.select("question_id").join(found, "question_id", "left").select(
        "question_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("documents")
    )


def in_listing_order(rows: DataFrame, *first: str, newest: str, tie: str, place: str | None = None) -> DataFrame:
    """A listing: grouping columns first, then the newest row.

    With ``place`` each row carries its position under the first column, for listings that are read later or in pages.
    """
    order = [*first[1:], F.col(newest).desc(), F.col(tie).desc()]
    if place:
        rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(first[0]).orderBy(*order)))
    return rows.orderBy(first[0], *order)


def reference_counts(libraries: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents and ready documents per reference library (A3)."""
    counts = documents.groupBy("library").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "ready").alias("ready")
    )
    return libraries.filter("is_reference").join(counts, "library", "left").fillna(0, ["documents", "ready"])


def thread_listing(threads: DataFrame, libraries: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads with their library's name and first message."""
    firsts = first_row(messages.select("thread", "ord", "content"), ["thread"], F.col("ord")).select(
        "thread", F.col("content").alias("first_message")
    )
    return threads.join(libraries.select("library", "name"), "library", "left").join(firsts, "thread", "left")


def titled(title: Column, question: Column) -> Column:
    """A thread still called ``New chat`` takes the first 70 characters of its question."""
    return F.when(title == "New chat", F.left(question, F.lit(70))).otherwise(title)


def patched(patch: Column, current: Column) -> Column:
    """A patch value when given, else what is there."""
    return F.coalesce(patch, current)


def by_name(documents: DataFrame, search: str) -> DataFrame:
    """Documents whose file name contains the search text, case ignored."""
    return documents.filter(F.lower("filename").contains(search.lower()))


def same_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join on a key, case ignored."""
    a = left.withColumn("_key", F.lower(key))
    return a.join(right.withColumn("_key", F.lower(key)).drop(key), "_key").drop("_key")


def unattached(documents: DataFrame, job_documents: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Library documents that are not yet in the job.

    ``documents``: job_id, doc_id. With ``jobs`` (job_id, library) they are doc_id, library, and every job meets all documents of
    its library. These pairs are many times the input, so they are formed last and never move: jobs are dealt into blocks of
    some ``JOB_BLOCK`` (copies of a job into blocks of their own), links are gathered by document and block of jobs, so that no list is longer than
    a block, and a document's pairs are what its links leave of each block.
    """
    if jobs is None:
        return documents.join(job_documents.select("job_id", "doc_id"), ["job_id", "doc_id"], "left_anti")
    n = F.count(F.lit(1))
    in_jobs = jobs.groupBy("library").agg(F.ceil(n / JOB_BLOCK).cast("int").alias("_jobs"))
    in_documents = documents.groupBy("library").agg(F.ceil(n / DOCUMENT_BLOCK).cast("int").alias("_documents"))
    sizes = in_jobs.join(in_documents, "library")
    dealt = jobs.join(sizes, "library").withColumn("_block", F.pmod(F.xxhash64("job_id"), F.col("_jobs")).cast("int"))
    copy = F.row_number().over(Window.partitionBy("library", "job_id").orderBy("_block"))
    blocks = dealt.withColumn("_copy", copy).groupBy("library", "_block", "_copy", "_documents").agg(
        # a job without an id is in no link; its place in the list is kept
        F.flatten(F.collect_list(F.array("job_id"))).alias("_all"))
    blocks = blocks.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_documents") - 1))).drop("_documents", "_copy")

    linked = job_documents.select("job_id", "doc_id").join(dealt.select("job_id", "library", "_block").distinct(), "job_id")
    # most links are of documents of other libraries, which no cell asks for
    linked = linked.join(documents.select("doc_id", "library").distinct(), ["doc_id", "library"], "left_semi")
    linked = linked.groupBy("doc_id", "library", "_block").agg(F.collect_set("job_id").alias("_linked"))
    asked = documents.select("doc_id", "library").join(sizes, "library")
    asked = asked.withColumn("_deal", F.pmod(F.xxhash64("doc_id"), F.col("_documents")).cast("int"))
    asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_jobs") - 1))).drop("_jobs", "_documents")
    cells = asked.join(linked, ["doc_id", "library", "_block"], "left").join(blocks, ["library", "_block", "_deal"])
    left = F.when(F.col("_linked").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_linked"))
    return cells.select(F.explode(left).alias("job_id"), "doc_id")


def memory_listing(entries: DataFrame, k: int = 200) -> DataFrame:
    """The newest entries of each library."""
    return top_k(entries, ["library"], [F.col("created_at").desc(), F.col("entry_id").desc()], k)


def memory_block(entries: DataFrame, k: int = 40) -> DataFrame:
    """The last 40 entries of each library as one text, oldest first."""
    newest = memory_listing(entries, k)
    line = F.format_string("- [%s] %s", "entry_type", "content")
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))))
    return newest.groupBy("library").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("memory"))
