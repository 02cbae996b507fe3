"""Stored web-archive files to typed capture rows, read by ranges.

A file holds records one after another, plain or as gzip members (a member may hold several records).
A record's block is as long as its ``Content-Length`` says. Damage never ends the job: what can't be
read becomes a row with a reason, and reading goes on at the next record or member. A member that is
damaged or cut off is one such row.

Files are cut into ranges, and tasks read ranges: a record belongs to the range in which it begins (of
gzip, the range in which its member begins). Where a range's first record begins is first a guess, the
first head (or member) that proves right on inspection. That can be wrong, for a payload may be an
archive itself, so a first pass also finds out where the first record behind the range begins, and each
file's ranges are walked through once: where a range's guess is not what the range before it arrived
at, that range is looked through again from there, until all agree. Of plain files that pass reads
heads only and jumps over blocks; gzip members have to be inflated to find their ends.

A task holds blocks of a few hundred KB and one record; neither files nor members are held whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.urls import publisher_site
from postlake.session import cut_lineage
from postlake.sources.files import listed, open_file, spread

GZIP_START = b"\x1f\x8b\x08"
MAGIC, HEAD_END = b"WARC/", b"\r\n\r\n"
#: Ranges share the bytes among the cluster's cores, within these bounds, as Spark's own splits do.
LEAST_RANGE, MOST_RANGE = 256 << 10, 64 << 20
BLOCK_BYTES = 256 << 10
#: A head longer than this is damaged.
HEAD_BYTES = 1 << 20
BATCH_ROWS = 256
#: An inflated member up to this size is not inflated a second time.
KEPT_BYTES = 8 << 20
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
#: A batch of rows is given out at this many bytes of bodies.
BATCH_BYTES = 16 << 20
RECORD = (
    "warc_filename string, warc_record_offset bigint, warc_record_length bigint, url string, captured_at string, "
    "http_status int, body string, content_digest string, reject_reason string"
)
_FIELDS = [field.split()[0] for field in RECORD.split(", ")]


@dataclass
class Capture:
    """One archive record, or what is known of a damaged one."""

    warc_record_offset: int
    warc_record_length: int
    url: str | None = None
    captured_at: str | None = None
    http_status: int | None = None
    body: str | None = None
    content_digest: str | None = None
    reject_reason: str | None = None


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-cased name; a line that starts with a blank goes on with the one before."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name = line[: line.index(":")].strip().lower()
            found[name] = line[line.index(":") + 1 :].strip()
    return found


def _unchunked(data: bytes) -> bytes:
    """The body of a chunked transfer; ValueError if a chunk is cut off."""
    body, at = bytearray(), 0
    while True:
        line_end = data.index(b"\r\n", at)
        size = int(data[at:line_end].split(b";")[0], 16)
        if not size:
            return bytes(body)
        at = line_end + 2
        if at + size > len(data):
            raise ValueError("cut chunk")
        body += data[at : at + size]
        at += size + 2


def _http(block: bytes, capture: Capture) -> None:
    """Fill status, body and digest from an HTTP message."""
    end = block.find(b"\r\n\r\n")
    head, body = (block[:end], block[end + 4 :]) if end >= 0 else (block, b"")
    status_line, _, rest = head.partition(b"\r\n")
    status = status_line.split(b" ")[1:2]
    capture.http_status = int(status[0]) if status and status[0].isdigit() else None
    fields = _fields(rest)
    try:
        if fields.get("transfer-encoding", "").lower() == "chunked":
            body = _unchunked(body)
        coding = fields.get("content-encoding", "").lower()
        if coding in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif coding == "deflate":
            body = zlib.decompress(body)
    except (ValueError, EOFError, OSError, zlib.error):
        capture.reject_reason = "damaged_body"
        return
    capture.body = body.decode("utf-8", "replace")
    capture.content_digest = capture.content_digest or base64.b32encode(hashlib.sha1(body).digest()).decode()


class Forward:
    """Bytes read forward, block by block. ``at`` is the place of the first byte still held."""

    def __init__(self, more: Callable[[], bytes], at: int = 0, jump: Callable[[int], None] | None = None) -> None:
        self.more, self.at, self.jump, self.held = more, at, jump, bytearray()

    def _fill(self) -> bool:
        block = self.more()
        self.held += block
        return bool(block)

    def _drop(self, count: int) -> None:
        del self.held[:count]
        self.at += count

    def seek_to(self, pattern: bytes) -> bool:
        """Go to the next place of the pattern, or to the end."""
        while (found := self.held.find(pattern)) < 0:
            self._drop(max(0, len(self.held) - len(pattern) + 1))
            if not self._fill():
                self._drop(len(self.held))
                return False
        self._drop(found)
        return True

    def through(self, pattern: bytes, most: int) -> bytes | None:
        """The bytes before the next place of the pattern, and go behind it; at the end None.

        Of more bytes than ``most`` none are given, but the place is passed.
        """
        start = 0
        while (found := self.held.find(pattern, start)) < 0:
            start = max(0, len(self.held) - len(pattern) + 1)
            if start > most:
                return b"" if self.seek_to(pattern) and not self._drop(len(pattern)) else None
            if not self._fill():
                self._drop(len(self.held))
                return None
        out = bytes(self.held[:found])
        self._drop(found + len(pattern))
        return out

    def take(self, count: int) -> bytes:
        """The next bytes, fewer at the end."""
        while len(self.held) < count and self._fill():
            pass
        out = bytes(self.held[:count])
        self._drop(len(out))
        return out

    def skip(self, count: int) -> None:
        target = self.at + count
        if self.jump and count > len(self.held) + BLOCK_BYTES:
            self.held.clear()
            self.at = target
            self.jump(target)
            return
        while self.at < target and (self.held or self._fill()):
            self._drop(min(len(self.held), target - self.at))


def _plain(file: BinaryIO, at: int) -> Forward:
    file.seek(at)
    return Forward(lambda: file.read(BLOCK_BYTES), at, file.seek)


class Member:
    """One gzip member, inflated in blocks; in the end ``end`` is the place behind it, or ``reason`` says what is wrong."""

    def __init__(self, file: BinaryIO, at: int) -> None:
        self.file, self.read_to, self.inflater, self.waiting = file, at, zlib.decompressobj(31), b""
        self.end: int | None = None
        self.reason: str | None = None

    def block(self) -> bytes:
        """The next inflated bytes; none at the end."""
        while self.end is None and self.reason is None:
            if not self.waiting:
                self.file.seek(self.read_to)
                self.waiting = self.file.read(BLOCK_BYTES)
                self.read_to += len(self.waiting)
                if not self.waiting:
                    self.reason = "truncated_member"
                    break
            try:
                block = self.inflater.decompress(self.waiting, BLOCK_BYTES)
            except zlib.error:
                self.reason = "damaged_member"
                break
            self.waiting = self.inflater.unconsumed_tail
            if self.inflater.eof:
                self.end = self.read_to - len(self.inflater.unused_data)
            if block:
                return block
        return b""

    def finish(self, keep: int = 0) -> bytes | None:
        """Inflate all of it; gives the bytes if they are no more than ``keep``."""
        kept: bytearray | None = bytearray()
        while block := self.block():
            if kept is not None:
                kept += block
                kept = kept if len(kept) <= keep else None
        return None if kept is None else bytes(kept)


def _captures(data: Forward, end: int | None, place: Callable[[int, int], tuple[int, int]], bodies: bool = True) -> Iterator[Capture]:
    """The records that begin before ``end``; afterwards data stands where the next one begins, or at its end.

    ``place`` gives a record's stated offset and length. Without ``bodies`` nothing is yielded, and blocks are jumped over.
    """
    while data.seek_to(MAGIC) and (end is None or data.at < end):
        begin = data.at
        head = data.through(HEAD_END, HEAD_BYTES)
        fields = _fields(head) if head else {}
        length = fields.get("content-length", "")
        usable = head is not None and length.isdigit()
        if not bodies:
            if usable:
                data.skip(int(length))
            continue
        block = data.take(int(length)) if usable else b""
        found = Capture(*place(begin, data.at))
        found.url, found.captured_at = fields.get("warc-target-uri"), fields.get("warc-date")
        found.content_digest = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
        if not usable:
            found.reject_reason = "damaged_record"
        elif len(block) < int(length):
            found.reject_reason = "truncated_record"
        elif fields.get("warc-type") != "response":
            found.reject_reason = "not_a_response_record"
        elif found.captured_at is None:
            found.reject_reason = "missing_capture_time"
        else:
            _http(block, found)
        yield found


def _next(file: BinaryIO, pattern: bytes, at: int) -> int | None:
    data = _plain(file, at)
    return data.at if data.seek_to(pattern) else None


def _plain_range(file: BinaryIO, at: int, end: int | None, size: int, bodies: bool) -> Iterator[Capture]:
    """The records that begin from ``at`` up to ``end``; returns where the next one begins, or the size."""
    data = _plain(file, at)
    yield from _captures(data, end, lambda begin, stop: (begin, stop - begin), bodies)
    return min(data.at, size)


def _zipped_range(file: BinaryIO, at: int, end: int | None, size: int, bodies: bool) -> Iterator[Capture]:
    """The records of the members that begin from ``at`` up to ``end``; returns where the next one begins, or the size."""
    while at < (size if end is None else end):
        member = Member(file, at)
        held = member.finish(KEPT_BYTES if bodies else 0)
        after = member.end
        if after is None:
            after = _next(file, GZIP_START, at + 1)
            after = size if after is None else after
            if bodies:
                yield Capture(at, after - at, reject_reason=member.reason)
        elif bodies:
            parts = iter([held]) if held is not None else iter(Member(file, at).block, b"")
            yield from _captures(Forward(lambda parts=parts: next(parts, b"")), None, lambda *_, place=(at, after - at): place)
        at = after
    return at


def _zipped(file: BinaryIO) -> bool:
    file.seek(0)
    return file.read(2) == GZIP_START[:2]


def _range(file: BinaryIO, at: int, end: int | None, size: int, bodies: bool = True) -> Iterator[Capture]:
    return (_zipped_range if _zipped(file) else _plain_range)(file, at, end, size, bodies)


def _begin(file: BinaryIO, start: int, end: int) -> int | None:
    """A guess where a range's first record or member begins: the first that proves right; the file's start is no guess."""
    if not start:
        return 0
    zipped, at = _zipped(file), start
    while (found := _next(file, GZIP_START if zipped else MAGIC, at)) is not None and found < end:
        if Member(file, found).block()[: len(MAGIC)] == MAGIC if zipped else _head_holds(file, found):
            return found
        at = found + 1
    return None


def _head_holds(file: BinaryIO, at: int) -> bool:
    """Whether a record head stands here, and behind its block another one or the end."""
    data = _plain(file, at)
    head = data.through(HEAD_END, HEAD_BYTES) or b""
    fields = _fields(head)
    if not VERSION_LINE.match(head) or "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return False
    data.skip(int(fields["content-length"]))
    return data.take(len(HEAD_END) + len(MAGIC)) in (HEAD_END + MAGIC, HEAD_END)


# --- ranges ---

_RANGE = "path string, start bigint, stop bigint, size bigint, begin bigint, next bigint, state string"


def file_ranges(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(path, start, stop, size) of the ranges of all files below path; no file is opened."""
    files = listed(spark, path).select("path", "size").filter("size > 0")
    if range_bytes is None:
        total = files.agg(F.sum("size")).first()[0] or 0
        range_bytes = max(LEAST_RANGE, min(MOST_RANGE, total // spark.sparkContext.defaultParallelism))
    step = F.lit(range_bytes)
    cut = files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, step.cast("bigint"))).alias("start"))
    return cut.select("path", "start", F.least(F.col("start") + step, F.col("size")).alias("stop"), "size")


def _looked_through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the range's first record begins (as told, or guessed), and the first one behind the range."""
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            with open_file(r.path) as file:
                begin = _begin(file, r.start, r.stop) if r.state == "guess" else int(r.begin)
                after = None
                if begin is not None:
                    records = _range(file, begin, r.stop, r.size, bodies=False)
                    while after is None:
                        try:
                            next(records)
                        except StopIteration as done:
                            after = done.value
            rows.append((r.path, r.start, r.stop, r.size, begin, after, "seen"))
        yield pd.DataFrame(rows, columns=batch.columns).astype({"begin": "Int64", "next": "Int64"})


def _walked(ranges: pd.DataFrame) -> pd.DataFrame:
    """One file's ranges in order: each must begin where the one before it arrived."""
    out = ranges.sort_values("start").reset_index(drop=True)
    arrived: int | None = 0
    begins, states = [], []
    for r in out.itertuples():
        begin, state = (None if pd.isna(r.begin) else int(r.begin)), "open"
        if arrived is not None and arrived >= r.stop:
            begin, state = None, "empty"
        elif arrived is not None and begin == arrived:
            state, arrived = "agreed", int(r.next)
        elif arrived is not None:
            begin, state, arrived = arrived, "again", None
        begins.append(begin)
        states.append(state)
    return out.assign(begin=pd.array(begins, "Int64"), next=out["next"].astype("Int64"), state=states)


def agreed_ranges(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """The ranges in which records begin, each with its first record's place."""
    unknown = F.lit(None).cast("bigint")
    ranges = file_ranges(spark, path, range_bytes).select("*", unknown.alias("begin"), unknown.alias("next"), F.lit("guess").alias("state"))
    seen = cut_lineage(spread(ranges).mapInPandas(_looked_through, _RANGE))
    while True:
        walked = cut_lineage(seen.groupBy("path").applyInPandas(_walked, _RANGE))
        again = walked.filter("state = 'again'")
        if again.isEmpty():
            return walked.filter("state = 'agreed'")
        seen = walked.filter("state <> 'again'").unionByName(spread(again).mapInPandas(_looked_through, _RANGE))


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_FIELDS).astype({"http_status": "Int32"})


def _batches(found: Iterator[tuple[str, Capture]]) -> Iterator[pd.DataFrame]:
    rows: list[dict] = []
    size = 0
    for path, capture in found:
        rows.append({"warc_filename": path} | asdict(capture))
        size += len(capture.body or "")
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _frame(rows)
            rows, size = [], 0
    yield _frame(rows)


def _with_types(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"captured_at": F.try_to_timestamp("captured_at"), "domain": publisher_site("url")})


def read_warc(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """The records of all files below path, rejects included with a reason; the whole path names the file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple[str, Capture]]:
            for batch in batches:
                for r in batch.itertuples():
                    with open_file(r.path) as file:
                        for capture in _range(file, int(r.begin), r.stop, r.size):
                            yield r.path, capture

        return _batches(found())

    return _with_types(spread(agreed_ranges(spark, path, range_bytes)).mapInPandas(read, RECORD))


def split_records(files: DataFrame) -> DataFrame:
    """(path, content) rows, each a whole file, to one row per archive record, rejects included with a reason."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _batches(
            (path, capture) for batch in batches for path, content in zip(batch["path"], batch["content"])
            for capture in _range(io.BytesIO(content), 0, None, len(content)))

    return _with_types(files.select("path", "content").mapInPandas(split, RECORD))
