"""The pipeline's stages on a small table: what each keeps, and the columns it returns."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import test_lines, test_simhash, test_spans
from tests.llm.helpers import DOCS
from tests.llm.test_classifiers import LABELS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Made-up prose with insults, shared lines, near copies, shared passages, nulls and repeated rows."""
    rng = random.Random(12)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(n))

    passage, line = words(30), "this very line stands in many documents"
    rows = []
    for i in range(240):
        parts = [words(rng.randint(30, 80))]
        if i % 4 == 0:
            parts.append(f"you zzinsult {words(3)}")
        if i % 5 == 0:
            parts.append(f"  {line.upper()} ")
        if i % 7 == 0:
            parts.append(words(5) + " " + passage + " " + words(5))
        rows.append((i, "\n".join(parts), "en", "s", 0))
    rows += [(300 + i, rows[i][1], "en", "s", 0) for i in range(1, 30)]
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (2, rows[2][1], "en", "s", 0), (None, words(40), "en", "s", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        following = stage(spark, docs, folder)
        kept[name] = (docs.collect(), following.collect())
        if name != "packing":
            assert following.columns == docs.columns
        docs = spark.createDataFrame(kept[name][1], following.schema) if kept[name][1] else following

    before, after = kept["toxicity"]
    assert sum("zzinsult" in (r.text or "") for r in after) <= 0.05 * sum("zzinsult" in (r.text or "") for r in before)
    assert sum("zzinsult" not in (r.text or "") for r in after) >= 0.98 * sum("zzinsult" not in (r.text or "") for r in before)

    before, after = kept["lines"]
    want = test_lines.expected([(r.doc_id, r.text) for r in before])
    got = [(r.doc_id, test_lines.hashlib.sha256((r.text or "").encode()).hexdigest()) for r in after]
    assert sorted(got, key=repr) == sorted(((w[0], w[3]) for w in want), key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)

    before, after = kept["simhash"]
    fps = {i: test_simhash.brute_fingerprint(r.text) for i, r in enumerate(before)}
    roots = test_simhash.brute_components(list(fps.values()))
    first = {}
    for i, f in fps.items():
        d = before[i].doc_id
        first[roots[f]] = min(first.get(roots[f], float("inf")), float("inf") if d is None else d)
    assert sorted(float("inf") if r.doc_id is None else r.doc_id for r in after) == sorted(first.values())

    before, after = kept["suffix"]
    want = {w[0]: w for w in test_spans.brute([(r.doc_id, r.text) for r in before])}
    for r in after:
        assert len((r.text or "").encode()) == want[r.doc_id][1] - want[r.doc_id][2]
    assert sum(w[2] for w in want.values()) > 100

    before, after = kept["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_run_is_registered(spark, folder):
    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    rows = corpus_pipeline.run(spark, folder).collect()
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_no_documents_and_clashing_columns(spark, folder):
    """Every stage on an empty table, and on one whose further columns are called like an operator's own."""
    from tests.llm.helpers import clash

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert labels.count()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == [], name
    odd = clash(docs.limit(40), "doc", "score", "keys", "kept", "fp", "slice", "hash", "piece", "length", "n_dropped")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        following = stage(spark, odd, folder)
        assert following.columns == odd.columns, name
        assert {r.kept for r in following.collect()} == {"clash"}, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, folder).count() >= 40
