"""Records written to ZIP packages and read back by ranges."""

import base64
import gzip
import hashlib
import io
import json
import zipfile
from collections import Counter

import pyarrow.fs as pafs
import pytest
from compare import connect, difference
from conftest import TESTDATA

from footfall.llm import zip_archives as Z
from footfall.llm.common import fresh_path, look_up
from footfall.llm.queries import op13_zip_archives, oracle_sql

SCHEMA = "page_id long, url string, html string, digest string, size int, best int, path string"


def want_of(rows):
    """(page_id, url, type, bytes, digest, refers_to) of every row."""
    groups = {}
    for page_id, url, html in rows:
        raw = (html or "").encode()
        groups.setdefault(hashlib.sha1(raw).hexdigest(), []).append((page_id, url, len(raw)))
    found = []
    for digest, members in groups.items():
        def order(m):
            return m[0] is not None, m[0] or 0, m[1] is not None, m[1] or ""

        best = max(members, key=order)
        rest = list(members)
        rest.remove(best)
        if best[2] < 1000:
            found += [(p, u, "response", n, digest, None) for p, u, n in members]
        else:
            found.append((best[0], best[1], "response", best[2], digest, None))
            found += [(p, u, "revisit", n, digest, best[0]) for p, u, n in rest]
    return Counter(found)


def odd_rows():
    long, other = "<p>x</p>" * 500, "é" * 600
    rows = [
        (1, "http://a.example/x?y=1", long), (2, "http://a.example/", long), (3, None, None),
        (None, "http://b.example/ü b", ""), (4, "no url", "short"), (4, "no url", "short"),
        (None, None, other), (None, "u", other), (7, "line\r\nbreak", "<b>\r\n\r\n</b>" * 200),
        (5, "x", "a" * 999), (6, "x", "a" * 999), (8, "x", "b" * 1000), (8, "y", "b" * 1000),
        (9, "big", "z" * 9_000_000),
    ]
    rows += [(11, "same", "c" * 2000)] * 40  # repeated in full
    rows += [(100 + i, f"u{i}", "d" * 1500) for i in range(60)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "p") for r in rows], SCHEMA).repartition(3)


def as_rows(records):
    return Counter(tuple(r) for r in records.drop("payload").collect())


@pytest.fixture(scope="module")
def written(spark):
    folder = fresh_path(spark, "zip")
    packages = Z.write_packages(table(spark, odd_rows()), folder)
    return folder, packages


def cleaned(counter):
    return Counter({(p, u and u.replace("\r", "%0D").replace("\n", "%0A"), *r): n for (p, u, *r), n in counter.items()})


def test_round_trip(spark, written):
    folder, packages = written
    rows = odd_rows()
    records = Z.read_records(packages)
    assert as_rows(records) == cleaned(want_of(rows))
    payloads = {r.payload_digest: r.payload for r in records.filter("record_type = 'response'").collect()}
    assert all(hashlib.sha1(p).hexdigest() == d for d, p in payloads.items())
    # found by listing as well
    assert as_rows(Z.read_records(Z.packages_in(spark, folder))) == cleaned(want_of(rows))


def test_hot_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(Z, "COPIES_AT_ONCE", 7)
    rows = [(1, "same", "c" * 2000)] * 50 + [(i, "u", "d" * 1200) for i in range(50)]
    packages = Z.write_packages(table(spark, rows), fresh_path(spark, "zip"))
    assert as_rows(Z.read_records(packages)) == want_of(rows)


def test_many_packages_per_task(spark, monkeypatch):
    monkeypatch.setattr(Z, "PACKAGE_RECORDS", 3)
    rows = [(i, f"http://h{i}.example/", f"text {i}") for i in range(20)]
    packages = Z.write_packages(table(spark, rows).coalesce(1), fresh_path(spark, "zip"))
    # workers do not see the patch: one package or several, the records are the same
    assert as_rows(Z.read_records(packages)) == want_of(rows)


def test_empty_table(spark):
    packages = Z.write_packages(table(spark, []), fresh_path(spark, "zip"))
    assert packages.count() == 0 and Z.read_records(packages).count() == 0


def opened(data):
    return Z.ZipReader(pafs_file(data))


class pafs_file:
    """A file as pyarrow presents it."""

    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_packages_are_valid_zip64_files(written):
    folder, packages = written
    path = packages.first().path
    files, local = Z.file_system(path)
    with files.open_input_file(local) as f:
        data = f.read()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        about = json.loads(z.read("datapackage.json"))
        for resource in about["resources"]:
            content = z.read(resource["path"])
            assert len(content) == resource["bytes"]
            assert "sha256:" + hashlib.sha256(content).hexdigest() == resource["hash"]
            member = next(m for m in opened(data).members() if m.name == resource["path"])
            assert data[member.start : member.start + member.size] == content
        # each line of the index is a record
        archive = z.read("archive/data.warc.gz")
        for line in z.read("indexes/index.cdx").decode().splitlines():
            entry = json.loads(line[line.index("{") :])
            part = archive[entry["offset"] : entry["offset"] + entry["length"]]
            fields, _ = Z.parse_record(gzip.decompress(part))
            told = base64.b32decode(entry["digest"][5:])
            assert fields["warc-payload-digest"] == "sha1:" + base64.b32encode(told).decode()


def record(page_id, html):
    raw = html.encode()
    row = {"page_id": page_id, "url": "u", "html": html, "digest": hashlib.sha1(raw).digest(), "size": len(raw), "refers": None}
    return gzip.compress(Z.record_bytes(row))


def foreign(comment=b"", before=b"", index=True, method=zipfile.ZIP_STORED):
    parts = [record(i, f"page {i}" * 5) for i in range(4)]
    lines, at = [], 0
    for i, part in enumerate(parts):
        lines.append(f'k{i} 2000 {{"offset": {at}, "length": "{len(part)}", "filename": "x.warc.gz"}}')
        at += len(part)
    out = io.BytesIO()
    out.write(before)
    with zipfile.ZipFile(out, "a" if before else "w", method) as z:
        z.comment = comment
        z.writestr("pages/pages.jsonl", "{}" * 100, zipfile.ZIP_DEFLATED)
        z.writestr("archive/", "")
        z.writestr("archive/x.warc.gz", b"".join(parts))
        if index:
            z.writestr("indexes/index.cdxj", "\n".join(reversed(lines)))
    return out.getvalue()


@pytest.mark.parametrize(
    "kind",
    [{}, {"comment": b"PK\x05\x06 in a comment"}, {"before": b"#!" + bytes(1000)}, {"index": False}],
)
def test_packages_of_others(spark, tmp_path, kind):
    path = tmp_path / "a b.wacz"
    path.write_bytes(foreign(**kind))
    df = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "path string, bytes long")
    got = {r.page_id: r.payload.decode() for r in Z.read_records(df).collect()}
    assert got == {i: f"page {i}" * 5 for i in range(4)}


def test_zip64_fields_with_a_prefix():
    out = io.BytesIO()
    writer = Z.ZipWriter(out)
    writer.begin("archive/a")
    writer.write(b"abc" * 1000)
    writer.end()
    writer.close()
    for before in (b"", b"prefix"):
        data = before + out.getvalue()
        (member,) = opened(data).members()
        assert data[member.start : member.start + member.size] == b"abc" * 1000


def test_damage_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="not a ZIP"):
        list(opened(b"plain text").members())
    with pytest.raises(ValueError, match="compressed"):
        list(opened(foreign(method=zipfile.ZIP_DEFLATED)).members())
    raw = gzip.decompress(record(1, "page"))
    with pytest.raises(ValueError, match="too early"):
        Z.parse_record(raw[:-10])
    with pytest.raises(ValueError, match="damaged"):
        Z._record_row(raw.replace(b"\r\n\r\npage", b"\r\n\r\nPAGE"), False)


def test_index_key_of_odd_urls(spark):
    for url in (None, "", "http://[bad", "http://a.example/p?q=1 2", "x\ny"):
        line = Z._index_line(url, {"offset": 1})
        assert line.count("\n") == 1 and json.loads(line[line.index("{") :]) == {"offset": 1}


def test_look_up_with_hot_and_null_keys(spark):
    rows = [(i, "hot") for i in range(3000)] + [(i, None) for i in range(3000)]
    rows += [(i, f"k{i % 50}") for i in range(1000)] + [(1, "lone"), (2, "missing")]
    left = spark.createDataFrame(rows, "i long, key string")
    known = [("hot", 1, None), ("lone", 2, "x"), *((f"k{i}", i, "y") for i in range(40))]
    right = spark.createDataFrame(known, "key string, a int, b string")
    entries = {k: (a, b) for k, a, b in known}
    want = Counter((i, k, *entries.get(k, (None, None))) for i, k in rows)
    got = look_up(left, right, ["key"]).select("i", "key", "a", "b").collect()
    assert Counter(tuple(r) for r in got) == want


def test_query_equals_sql(spark):
    sf = f"{TESTDATA}/sf0.01"
    query = op13_zip_archives(spark, sf)
    assert difference(query, connect(sf), oracle_sql()["op13_zip_archives"]) is None
