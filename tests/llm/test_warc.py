import gzip
import random
from base64 import b32encode
from hashlib import sha1

import pytest

from tidemark.llm import warc
from tidemark.llm.common import folder

SCHEMA = "page_id long, url string, html string, digest string, payload string, first long, path string, pages long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", 1, "x", 2) for r in rows], SCHEMA).repartition(3)


def expected(rows, min_bytes=0):
    groups, out = {}, []
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    for page, _, html in rows:
        raw, known = (html or "").encode(), [p for p in groups[html or ""] if p is not None]
        first = min(known, default=None)
        refers = first if len(raw) >= min_bytes and page != first else None
        out.append((page, len(raw), b32encode(sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def shown(found):
    rows = found.select(warc.page_of(found.record_id).alias("p"), "payload_bytes", "payload_digest", "type", warc.page_of(found.refers_to).alias("r")).collect()
    return sorted((tuple(r) for r in rows), key=str)


ROWS = [
    (1, "http://a/", "<html>x</html>"), (2, "http://b/", "<html>x</html>"), (3, None, None), (4, "", ""), (5, "http://c/ü b\r\nX: y", "é漢😀"), (None, "http://d/", "<html>x</html>"), (None, "u", "only without an id"),
    (6, "http://e/", "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "http://f/", "x" * 300_000), (8, "http://g/", "x" * 300_000), (1, "http://a/", "<html>x</html>"), (-9, "http://h/", "negative"),
]


@pytest.mark.parametrize("min_bytes", [0, 15, 10**9])
@pytest.mark.parametrize("range_bytes", [1 << 25, 100, 7])
def test_round_trip(spark, min_bytes, range_bytes):
    written = warc.write(pages(spark, ROWS), folder(spark, "warc"), min_bytes=min_bytes, archive_bytes=600)
    assert sum(r.records for r in written.collect()) == len(ROWS)
    assert shown(warc.read(written, range_bytes)) == expected(ROWS, min_bytes)


def test_payloads_and_fields_come_back(spark):
    written = warc.write(pages(spark, ROWS), folder(spark, "warc"), min_bytes=10**9)
    found = warc.read(written).collect()
    assert sorted(r.payload.decode() for r in found) == sorted(h or "" for _, _, h in ROWS)
    assert {r.target_uri for r in found} == {None, "http://a/", "http://b/", "http://c/%C3%BC%20b%0D%0AX:%20y", "http://d/", "u", "http://e/", "http://f/", "http://g/", "http://h/"}
    path = written.first().path
    with gzip.open(path.removeprefix("file://").replace("file:", "")) as f:  # any reader of gzip members reads an archive
        assert f.read().count(b"WARC/1.1\r\nWARC-Type: response") >= 1


def test_common_payload_is_broadcast_and_rare_ones_are_joined(spark, monkeypatch):
    rows = [(i, "u", "common" if i % 2 else f"t{i // 3}") for i in range(120)]
    for parts in (1000, 4):
        monkeypatch.setattr(warc, "SALT_FROM", parts)
        assert shown(warc.read(warc.write(pages(spark, rows), folder(spark, "warc")))) == expected(rows)


def test_no_pages(spark):
    written = warc.write(pages(spark, []), folder(spark, "warc"))
    assert written.count() == 0 and warc.read(written).count() == 0


class Held:
    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.raw[self.at : self.at + n]
        self.at += len(out)
        return out


def records(raw, step):
    archive = warc.Archive(Held(raw), len(raw))
    return [(at, content) for begin in range(0, len(raw), step) for at, _, content, _ in archive.records(begin, min(begin + step, len(raw)))]


def test_ranges_own_what_begins_in_them_whatever_looks_like_a_member():
    """Stored payloads full of magics and of a whole stored member; other bytes between members; a cut-off last one."""
    rng = random.Random(5)
    inner = warc.member(warc.record(99, "u", b"inner", warc.digest_of(b"inner")), level=0)
    payloads = [warc.MAGIC * 50 + bytes(rng.randrange(256) for _ in range(200)), b"before" + inner + b"after", b"", warc.MAGIC + b"\x00" * 9]
    members = [warc.member(warc.record(i, "u", p, warc.digest_of(p)), level=0) for i, p in enumerate(payloads * 3)]
    raw = b"".join(members)
    whole = records(raw, len(raw))
    assert len(whole) == len(members)
    for step in (1, 13, 64, 300, 1001):
        assert records(raw, step) == whole
    padded = members[0] + b"\x00\x1f\x8b" + warc.MAGIC + b"\xff" + b"".join(members[1:3])
    assert [c for _, c in records(padded, len(padded))] == [c for _, c in whole[:3]]
    assert len(records(raw[:-5], 100)) == len(members) - 1


def test_a_wrong_digest_is_an_error():
    content = warc.record(1, "u", b"payload", "A" * 32)
    with pytest.raises(ValueError, match="digest"):
        warc.row_of(content, warc.parsed(content))
