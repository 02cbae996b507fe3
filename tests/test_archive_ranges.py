"""Archives read by ranges: every range size gives the rows of the whole file."""

import gzip
import os
import random
import zlib

import pytest

from postlake.sources import warc


def record(kind, block, *more):
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"Content-Length: %d" % len(block), *more]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(url, body):
    return record(b"response", b"HTTP/1.1 200 OK\r\n\r\n" + body, b"WARC-Target-URI: " + url, b"WARC-Date: 2031-02-03T04:05:06Z")


def stored(data):
    """A gzip member that holds its bytes as they are."""
    return gzip.compress(data, 0)


def archives():
    rng = random.Random(8)
    pages = [response(b"https://a.test/%d" % k, bytes(rng.choices(b"abc \r\nWARC/1.1", k=rng.randint(0, 400)))) for k in range(30)]
    inner = b"".join(response(b"https://inner.test/%d" % k, b"x" * 40) for k in range(12))
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/"
    yield "many", b"".join(pages)
    yield "nested", pages[0] + response(b"https://outer.test/", inner) + b"".join(pages[1:4]) + response(b"https://outer.test/2", inner[:-9]) + pages[5]
    yield "false-heads", pages[0] + response(b"https://trap.test/", head * 20) + b"".join(pages[6:9])
    yield "damaged", pages[0] + b"WARC/1.1\r\nno length\r\n\r\n" + pages[1] + b"noise WARC/ more noise" + pages[2] + pages[3][:-9]
    yield "no-head-end", pages[0] + b"WARC/1.1\r\nContent-Length: 5"
    yield "noise", bytes(range(256)) * 5
    yield "members", b"".join(map(gzip.compress, pages))
    yield "one-member", gzip.compress(b"".join(pages))
    yield "nested-members", stored(response(b"https://outer.test/", b"".join(map(gzip.compress, pages[:8])))) + gzip.compress(pages[9]) + stored(pages[10] + pages[11])
    broken = bytearray(gzip.compress(pages[3]))
    broken[14:30] = b"\xff" * 16
    yield "damaged-members", gzip.compress(pages[0]) + bytes(broken) + gzip.compress(pages[1] + pages[2]) + b"padding" + gzip.compress(pages[4])[:-12]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("archives")
    for name, data in archives():
        (path / name).write_bytes(data)
    (path / "empty").write_bytes(b"")
    return path


def plain_rows(data):
    """The whole file at once: (offset, length, url, body, reason)."""
    rows, at = [], 0

    def parse(block, place):
        here = 0
        while (begin := block.find(b"WARC/", here)) >= 0:
            end = block.find(b"\r\n\r\n", begin)
            lines = block[begin:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else []
            fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines if ":" in line)}
            size = fields.get("content-length", "")
            stop = len(block) if end < 0 else end + 4 + (int(size) if size.isdigit() else 0)
            where = place or (begin, min(stop, len(block)) - begin)
            url = fields.get("warc-target-uri")
            if not size.isdigit():
                rows.append((*where, url, None, "damaged_record"))
            elif stop > len(block):
                rows.append((*where, url, None, "truncated_record"))
            elif fields["warc-type"] != "response" or "warc-date" not in fields:
                rows.append((*where, url, None, "not_a_response_record" if fields["warc-type"] != "response" else "missing_capture_time"))
            else:
                body = block[end + 4 : stop].partition(b"\r\n\r\n")[2]
                rows.append((*where, url, body.decode("utf-8", "replace"), None))
            here = stop

    if data[:2] != b"\x1f\x8b":
        parse(data, None)
        return rows
    while at < len(data):
        member = zlib.decompressobj(31)
        try:
            block = member.decompress(data[at:])
            reason = None if member.eof else "truncated_member"
        except zlib.error:
            reason = "damaged_member"
        after = data.find(b"\x1f\x8b\x08", at + 1)
        if reason:
            after = after if after >= 0 else len(data)
            rows.append((at, after - at, None, None, reason))
        else:
            after = len(data) - len(member.unused_data)
            parse(block, (at, after - at))
        at = after
    return rows


def rows_by_file(found):
    out = {}
    for r in found.collect():
        out.setdefault(os.path.basename(r.warc_filename), []).append(
            (r.warc_record_offset, r.warc_record_length, r.url, r.body, r.reject_reason))
    return {name: sorted(rows, key=repr) for name, rows in out.items()}


def test_every_range_size_gives_the_rows_of_the_whole_file(spark, folder):
    wanted = {name: sorted(rows, key=repr) for name, data in archives() if (rows := plain_rows(data))}
    whole = spark.read.format("binaryFile").load(str(folder)).select("path", "content")
    assert rows_by_file(warc.split_records(whole)) == wanted
    for size in (97, 1000, 1 << 20):
        assert rows_by_file(warc.read_warc(spark, str(folder), size)) == wanted


def test_wrong_guesses_are_found_and_mended(spark, folder):
    data = dict(archives())["nested"]
    path = folder / "nested"
    guesses = []
    with open(path, "rb") as file:
        for start in range(0, len(data), 97):
            guesses.append(warc._begin(file, start, min(start + 97, len(data))))
    begins = {r[0] for r in plain_rows(data)}
    assert any(g not in begins for g in guesses if g)  # heads of the inner archive prove right on inspection
    agreed = warc.agreed_ranges(spark, str(path), 97)
    assert {r.begin for r in agreed.collect()} <= begins | {0}


def test_blocks_are_bounded(monkeypatch, tmp_path):
    """Long members and blocks pass in pieces; only records are held whole."""
    monkeypatch.setattr(warc, "BLOCK_BYTES", 64)
    monkeypatch.setattr(warc, "KEPT_BYTES", 100)
    monkeypatch.setattr(warc, "HEAD_BYTES", 600)
    sizes = []
    fill = warc.Forward._fill

    def watched(self):
        more = fill(self)
        sizes.append(len(self.held))
        return more

    monkeypatch.setattr(warc.Forward, "_fill", watched)
    pages = [response(b"https://a.test/%d" % k, b"y" * 500) for k in range(40)]
    for data in (b"".join(pages), gzip.compress(b"".join(pages)), b"z" * 20_000 + pages[0], b"WARC/" + b"h" * 20_000):
        path = tmp_path / "one"
        path.write_bytes(data)
        with open(path, "rb") as file:
            got = [(c.warc_record_offset, c.warc_record_length, c.url, c.body, c.reject_reason) for c in warc._range(file, 0, None, len(data))]
        assert got == plain_rows(data)
    assert max(sizes) < 1000
