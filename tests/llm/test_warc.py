import base64
import gzip
import hashlib
import os

import pytest

from quarry.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
ROWS = [
    (5, "http://a/\r\nX: y", "<p>one</p>", "x"), (3, "http://b/", "<p>one</p>", "x"), (9, None, None, None), (4, "u", "", ""), (-7, "u", "é" * 400_000, ""), (8, "u", "é" * 400_000, ""), (10, "u", "a\r\n\r\nb\r\n\r\n", ""),
    (11, "u", "".join(chr(33 + i * i % 90) for i in range(700_000)), ""), (None, "u", "<p>one</p>", ""), (None, "u", "alone", ""), (3, "http://b/", "<p>one</p>", "x"), (12, "u", "WARC/1.1\r\n" * 50, ""),
]


@pytest.fixture
def archives(spark, tmp_path):
    def make(rows, **options):
        folder = f"file://{tmp_path}/warc"
        return warc.write(warc.chunks(spark.createDataFrame(rows, SCHEMA), **options), folder), folder

    return make


def want(least=0):
    out = []
    for page, _, html, _ in ROWS:
        raw = (html or "").encode()
        same = [p for p, _, h, _ in ROWS if (h or "").encode() == raw and p is not None]
        first = min(same) if same and len(raw) >= least else None
        refers = None if first is None or first == page else first
        out.append((page, "response" if refers is None else "revisit", refers, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(archives, least):
    manifest, folder = archives(ROWS, least=least)
    got = warc.read(manifest, folder, payloads=False)
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got.collect()), key=str) == want(least)


def test_payloads_come_in_chunks(archives):
    manifest, folder = archives(ROWS, size=1000)
    rows = sorted((r for r in warc.read(manifest, folder).collect() if r.page_id == 11), key=lambda r: r.chunk_no)
    assert len(rows) > 2 and [r.chunk_no for r in rows] == list(range(len(rows)))
    whole = b""
    for r in rows:
        whole += r.chunk
        assert r.payload_bytes == len(whole) and r.payload_digest == base64.b32encode(hashlib.sha1(whole).digest()).decode()
    assert whole.decode() == ROWS[7][2]


def test_files_are_gzip_members_of_warc_records(archives, tmp_path):
    archives(ROWS)
    text = b"".join(gzip.open(f"{tmp_path}/warc/{f}").read() for f in os.listdir(f"{tmp_path}/warc"))
    assert text.count(b"WARC-Record-ID: ") == len(ROWS)


def test_damage_is_found(archives, tmp_path):
    manifest, folder = archives(ROWS[:2])
    path = manifest.first().path
    data = bytearray(open(path, "rb").read())
    data[len(data) // 4] ^= 255  # inside the first member
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception):
        warc.read(manifest, folder).collect()


def test_empty_table(archives):
    manifest, folder = archives([])
    assert warc.read(manifest, folder).count() == 0


def test_page_ids_survive():
    for page in (0, -1, 2**62, -(2**63)):
        assert warc.page_of(warc.record_id(page)) == page
    assert warc.page_of(warc.record_id(None, b"x")) is None
