"""Archives written and read back, the ZIP reader against files of the standard library, revisits against brute force."""

import hashlib
import io
import random
import zipfile

import pytest

from casebook.llm import warc
from tests.llm.helpers import clash

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).repartition(3)


def expected(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        target = max(same, default=None)
        revisit = len(payload) >= 1000 and target is not None and page != target
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(3)
    long, other = "x" * 999 + "é", "é" * 500
    rows = [(i, f"http://h/{i}?q=ä b\r\n", rng.choice([long, other, "x" * 999, "short", "", None, "y" * 400_000])) for i in range(60)]
    return rows + [(70, None, "a\r\n\r\nb" * 300), (None, None, long), (59, "again", long), (59, "again", long), (71, "u", "WARC/1.1\r\n\r\n" * 99)]


def test_round_trip(spark):
    rows = sample()
    got = warc.round_trip(clash(pages(spark, rows), "digest", "target", "archive", "n")).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_small_members_and_archives(spark):
    rows = sample()
    archives = warc.write_archives(pages(spark, rows), member_bytes=500, archive_bytes=2000)
    assert archives.count() > 3 and sum(r.records for r in archives.collect()) == len(rows)
    got = warc.read_archives(archives).collect()
    texts = {r.page_id: bytes(r.payload).decode() for r in got if r.payload is not None}
    given = {p: h or "" for p, _, h in rows}
    assert len(got) == len(rows) and all(texts[p] == given[p] for p in texts)
    assert {r.url for r in got} == {u for _, u, _ in rows}


def test_no_rows(spark):
    assert warc.round_trip(pages(spark, [(1, "u", "h")]).limit(0)).collect() == []


def reader(raw):
    return warc.ZipReader(lambda at, n: raw[at : at + n], len(raw))


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"with PK\x05\x06 in it" + b"." * 40])
def test_directory(wide, comment):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.comment = comment
        for name, body in {"a": b"1", "b/ü": b"22" * 50, "empty": b""}.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as f:
                f.write(body)
    raw = raw.getvalue()
    r = reader(raw)
    found = {m.name: raw[r.data_start(m) : r.data_start(m) + m.size] for m in r.members()}
    assert found == {"a": b"1", "b/ü": b"22" * 50, "empty": b""}


def test_zip64_directory(monkeypatch):
    """More members than the plain directory can count, and offsets that it has no room for."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 600)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 20)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(50):
            z.writestr(str(i), b"%d" % i * 30)
    raw = raw.getvalue()
    assert warc.LOCATOR64 in raw
    r = reader(raw)
    members = r.members()
    assert [raw[r.data_start(m) :][: m.size] for m in members] == [b"%d" % i * 30 for i in range(50)]


def test_deflated_or_damaged():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"1" * 100)
    r = reader(raw.getvalue())
    with pytest.raises(ValueError, match="deflated"):
        r.data_start(r.members()[0])
    with pytest.raises(ValueError, match="ZIP"):
        reader(b"nothing").members()
    good = warc.make_record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False, "d")
    assert warc.parse_record(good)["payload"] == b"abc"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(good.replace(b"abc", b"abd"))
