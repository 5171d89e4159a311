"""Log files cut into many splits are read as one plain reader reads them."""

import csv
import io
import random

import pytest

from casebook.sources import logs


def plain(text):
    return [(i, row) for i, row in enumerate(csv.reader(io.StringIO(text)), 1)]


def test_state_behind_a_line():
    after = logs.inside_after
    assert not after("a,b", False) and after("a,b", True)
    assert after('a,"b', False) and not after('b",c', True) and after('b"",c', True)
    assert not after('12" pipe,x', False) and not after('"a""b",c', False) and after('x","y', True) and not after('"a"b"c', False)


@pytest.mark.parametrize("size", [40, 300, 1 << 27])
def test_splits_equal_one_reader(spark, tmp_path, size):
    rng = random.Random(2)
    pieces = ["plain", 'with "quotes"', "two\nlines", "a,b", "", '"', 'é\n\n"x",\ny', '12 mm', "\n"]
    texts = {}
    for n in range(3):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        for _ in range(60):
            writer.writerow([rng.choice(pieces) for _ in range(rng.randint(1, 5))])
        texts[f"log{n}.csv"] = "Joint,12\" pipe,Welder\n\n" + out.getvalue()
        (tmp_path / f"log{n}.csv").write_text(texts[f"log{n}.csv"], encoding="utf-8", newline="")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = logs._lines(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > {40: 20, 300: 10}.get(size, 2)
        rows = logs.read_log(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, text in texts.items():
        assert sorted((r.row, r.cells) for r in rows if r.file.endswith(name)) == plain(text)


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert logs.read_log(spark, str(tmp_path)).count() == 0
