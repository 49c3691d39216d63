"""Archives by their bytes; huge texts without a boundary."""

import base64
import hashlib

import pytest

from prismarc.llm import token_counts, warc


def parsed(raw):
    """(fields, block) of every record of an archive."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        assert first == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        yield fields, raw[end + 4 : end + 4 + size]
        at = end + 4 + size
        assert raw[at : at + 4] == b"\r\n\r\n"
        at += 4


@pytest.mark.parametrize("chunk", [7, 64, 1000, 1 << 18])
def test_archives_are_warc(spark, chunk):
    texts = ["", "x", "é" * 500, "a\r\n\r\nb" * 40, "z" * 1000, None]
    pages = [(i, f"http://a/{i}\n", texts[i % 6]) for i in range(14)] + [(2, "http://a/2", texts[2])] * 3 + [(None, None, texts[4])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = warc.archive_bytes(warc.chunk_rows(warc.plan_records(frame, "page_id", "url", "html"), chunk)).collect()
    archives, longest = {}, 0
    for r in rows:
        archives[r.archive_no] = archives.get(r.archive_no, b"") + r.data
        longest = max(longest, len(r.data) if r.chunk_no else 0)
    assert longest <= chunk + 4
    records = [r for raw in archives.values() for r in parsed(raw)]
    assert len(records) == len(pages) == len({f["WARC-Record-ID"] for f, _ in records})
    of = {i: (t or "").encode() for i, _, t in pages}
    for fields, block in records:
        page = int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None
        http, body = block.split(b"\r\n\r\n", 1)
        digest = "sha1:" + base64.b32encode(hashlib.sha1(of[page]).digest()).decode()
        assert fields["WARC-Payload-Digest"] == digest and fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        if fields["WARC-Type"] == "response":
            assert body == of[page] and f"Content-Length: {len(body)}".encode() in http
        else:
            to = int(fields["X-Refers-To-Page"])
            assert body == b"" and of[to] == of[page] and to < page and fields["WARC-Refers-To-Target-URI"] == f"http://a/{to}"


@pytest.mark.parametrize("n", [200_000, 800_000])
def test_text_without_boundaries_is_encoded_boundedly(n):
    seen = 0

    def encode(text):
        nonlocal seen
        seen += len(text)
        return [0] * len(text), [(i, i + 1) for i in range(len(text))]

    total, _, widened = token_counts.spliced_count("a" * n, encode, 65_536, 1_024, 4)
    assert total == n and widened and seen <= 8 * n


def test_splice_after_a_stretch_without_boundaries():
    text = "ab " * 5_000 + "a" * 30_000 + " cd" * 5_000 + "b" * 9_000 + " e" * 4_000

    def encode(text):
        import re

        found = [m.span() for m in re.finditer(r" ?[^ ]+| ", text)]
        return [hash(text[a:b]) for a, b in found], found

    assert token_counts.spliced_count(text, encode, 2_000, 64, 4)[0] == len(encode(text)[0])
