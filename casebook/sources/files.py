"""Admission of files and rows: scan, limits, type list, duplicates, load report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.operators.windows import first_row
from casebook.sources.logs import read_log  # noqa: F401

# File types that can hold a document.
EXTENSIONS = (
    "pdf", "docx", "txt", "md", "csv", "pptx", "xlsx", "html", "htm",
    "png", "jpg", "jpeg", "tif", "tiff", "bmp",
)
MIN_PAGE_TEXT = 24

EVALUATION = "question string, expected_keyword string, expected_source_file string"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every file under the paths with its bytes and whether its type is supported."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    ext = extension(F.col("path"))
    return files.withColumn("extension", ext).withColumn("supported", ext.isin(*EXTENSIONS))


def reject_reason(ext: Column, size: Column, max_bytes: int | None = None) -> Column:
    """Why a file is not taken, null when it is (S2). There is no limit of size unless one is given."""
    over = F.lit(False) if max_bytes is None else size > max_bytes
    return (
        F.when(~F.coalesce(ext, F.lit("")).isin(*EXTENSIONS), "unsupported type")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(over, "too large")
    )


def admit(files: DataFrame, ext: Column, size: Column, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(taken, rejected): the bulk load skips bad files and reports them."""
    judged = files.withColumn("reject_reason", reject_reason(ext, size, max_bytes))
    return judged.filter("reject_reason IS NULL").drop("reject_reason"), judged.filter("reject_reason IS NOT NULL")


def mark_duplicates(
    documents: DataFrame, indexed: DataFrame | None = None, key: str = "doc_id", library: str = "library"
) -> DataFrame:
    """Add ``duplicate``: the same content is already in the library, or earlier in this batch.

    Documents without a library (thread attachments) are never duplicates. The first of each group is
    found by a map-side combined aggregate and joined back on the unique document key, so a content
    that makes up a third of the batch costs no more than any other.
    """
    in_library = documents.filter(F.col(library).isNotNull())
    firsts = in_library.groupBy(library, "sha256").agg(F.min(key).alias(key))
    if indexed is not None:
        held = indexed.select(library, "sha256").distinct()
        firsts = firsts.join(held, [library, "sha256"], "left_anti")
    firsts = firsts.select(key, F.lit(True).alias("_first"))
    return (
        documents.join(firsts, key, "left")
        .withColumn("duplicate", F.col(library).isNotNull() & F.col("_first").isNull())
        .drop("_first")
    )


def load_report(judged: DataFrame, by: list[str]) -> DataFrame:
    """Counts of added, duplicate and skipped inputs."""
    outcome = F.when(F.col("reject_reason").isNotNull(), "skipped").when(F.col("duplicate"), "duplicate").otherwise("added")
    return judged.groupBy(*by, outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("files"))


def unreadable(documents: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without a single non-blank block."""
    return documents.join(blocks.filter(F.trim("text") != "").select(key).distinct(), key, "left_anti")


def page_route(text: Column, minimum: int = MIN_PAGE_TEXT) -> Column:
    """'text' for a page that can be read as is, 'ocr' for an image-only one."""
    from casebook.functions.text import SPACE

    stripped = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(F.length(stripped) < minimum, "ocr").otherwise("text")


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array."""
    return spark.read.schema(EVALUATION).option("multiLine", True).json(path)


def merge(current: DataFrame, changes: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """Keyed merge: insert, and update or ignore on conflict (S21). Keys are unique on each side."""
    if update:
        return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)
    return current.unionByName(changes.join(current.select(*keys), keys, "left_anti"))


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The most recent version per key (S21), combined map-side."""
    return first_row(rows, keys, order, last=True)


def without(derived: DataFrame, deleted: DataFrame, key: str = "doc_id") -> DataFrame:
    """A derived table after its documents were deleted."""
    return derived.join(deleted.select(key).distinct(), key, "left_anti")


def requeue_stale(documents: DataFrame, version: str) -> DataFrame:
    """Finished documents of another parser version go back to the queue."""
    stale = (F.col("parser_version") != version) & F.col("status").isin("ready", "failed")
    return documents.withColumn("requeued", stale).withColumn(
        "status", F.when(stale, "queued").otherwise(F.col("status"))
    )


def needs_extraction(job_documents: DataFrame, version: int) -> Column:
    """Whether a cached extraction must be redone."""
    stale = (
        F.col("extracted_version").isNull()
        | ~F.col("extracted_for").eqNullSafe(F.col("updated_at"))
        | (F.col("extracted_version") != version)
    )
    return F.coalesce((F.col("status") == "ready") & (F.col("doc_type") != "other") & stale, F.lit(False))
