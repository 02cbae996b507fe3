"""WARC archives written and read back by Spark, with boundary-chain verification.

Writing: equal payloads of at least ``least_bytes`` keep one response, that of the largest page id;
the others become revisit records without payload that name it. Only page id, digest and length of a
page take part in that grouping. Digests that occur twice mark slots of a filter of fixed size; a page whose slot
is not marked is written where it was read, and only the others shuffle their payload, once, by page id.
The text writer puts the record terminator after each record, so a part file is an uncompressed WARC file.

Reading: archives are read in splits and cut at the magic line. A cut is only a candidate, for a
payload may hold the magic itself. Each task parses its candidates and emits the record length, that
is the step to the successor. Per file (16 bytes a candidate, files bounded by ``RECORDS_PER_FILE``)
pointers are doubled from the file's start, and only candidates that the start reaches are records.
A record that holds the magic in its payload is put together again from its pieces by one more read.

Null html: empty payload. Null ids stay null and are told apart by payload only. Repeated rows give
repeated records; among equal payloads all rows with the largest id are responses. Empty tables give
no records. Only page_id, url and html are read; other columns are ignored. A URL loses line breaks,
and a slash where its end would make the head line look like the magic. A file whose chain does not
end at its last byte is an error that names the byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.stage import written

MAGIC = b"WARC/1.1\r\n"
TERMINATOR = "\r\n\r\n"
RECORDS_PER_FILE = 100_000
LEAST_REVISIT_BYTES = 1000
#: Slots of the filter of digests that occur twice.
SLOTS = 1 << 20
RECORD_DATE = "2000-01-01T00:00:00Z"
ID_START = "urn:postlake:page:"

_CANDIDATE = (
    "file string, block long, local long, size long, span long, page_id long, record_type string, refers_to long, "
    "stated_digest string, payload_bytes long, payload_digest string"
)
_FIELDS = tuple(field.split()[0] for field in _CANDIDATE.split(", "))


def decide_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload another page keeps."""
    meta = pages.filter(F.col("bytes") >= least_bytes).select("page_id", "digest")
    keepers = meta.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return meta.join(keepers, "digest").filter(F.col("page_id") < F.col("refers_to")).distinct()


def shares_slot(digests: DataFrame) -> Column:
    """Whether a row's ``digest`` may be one that occurs twice in digests: one byte per slot, a fixed number of slots."""
    slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS))
    twice = digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select((slot + 1).alias("slot"))
    bitmaps = twice.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    marked = np.zeros(SLOTS, np.uint8)
    for row in bitmaps.collect():  # at most SLOTS / 8 bytes, whatever the table
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        first = (row["bucket"] - 1) * len(bits)
        marked[first : first + len(bits)] |= bits[: SLOTS - first]
    return F.substring(F.lit(bytearray(marked.tobytes())), (slot + 1).cast("int"), F.lit(1)) == F.lit(bytearray(b"\x01"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_REVISIT_BYTES) -> None:
    """One WARC record per page, below path."""
    body = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", ""), "WARC/1[.]1$", "WARC%2F1.1").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    shared = (F.col("bytes") >= least_bytes) & shares_slot(body.filter(F.col("bytes") >= least_bytes).select("digest"))
    revisits = decide_revisits(body, least_bytes)
    alone = body.filter(~F.coalesce(shared, F.lit(False))).withColumn("refers_to", F.lit(None).cast("long"))
    # A merge join at every size, so that the plan does not change as tables grow.
    records = alone.unionByName(body.filter(shared).join(revisits.hint("merge"), ["page_id", "digest"], "left"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"),
        F.lit(TERMINATOR),
    )
    block = F.concat(F.col("http"), F.when(again, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"\r\nWARC-Record-ID: <{ID_START}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {RECORD_DATE}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(
            F.lit(f"\r\nWARC-Refers-To: <{ID_START}"), F.col("refers_to").cast("string"),
            F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        )).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit(TERMINATOR),
    )
    lines = records.withColumn("http", http).withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))
    lines.write.option("lineSep", TERMINATOR).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _page(value: str | None) -> int | None:
    digits = (value or "").strip().removeprefix(f"<{ID_START}").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def parse_record(chunk: bytes) -> dict | None:
    """Head fields, block start and record length of what follows a magic line; None if it is no record head."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = {}
    for line in chunk[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        head[name.lower()] = value.strip()
    if not head.get("content-length", "").isdigit() or "warc-type" not in head:
        return None
    start = end + 4
    return {"head": head, "start": start, "length": int(head["content-length"]), "span": len(MAGIC) + start + int(head["content-length"]) + 4}


def payload_of(block: bytes, content_type: str) -> bytes:
    """The payload of a record block: behind the HTTP head where there is one."""
    if content_type.startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _row(chunk: bytes) -> tuple:
    """(span, page id, type, refers to, stated digest, payload bytes, payload digest) of a candidate."""
    record = parse_record(chunk)
    if record is None:
        return (-1, None, None, None, None, None, None)
    head, start = record["head"], record["start"]
    payload = payload_of(chunk[start : start + record["length"]], head.get("content-type", ""))
    return (
        record["span"], _page(head.get("warc-record-id")), head["warc-type"], _page(head.get("warc-refers-to")),
        head.get("warc-payload-digest", "").removeprefix("sha1:"), len(payload), hashlib.sha1(payload).hexdigest(),
    )


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """The chunks of every batch with their offsets from the first chunk of their split."""
    key, local = None, 0
    for batch in batches:
        for file, block, value in zip(batch.column(0), batch.column(1), batch.column(2)):
            here = (file.as_py(), block.as_py())
            if here != key:
                key, local = here, 0
            chunk = value.as_py()
            yield here[0], here[1], local, chunk
            local += len(chunk) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for file, block, local, chunk in _located(batches):
        rows.append((file, block, local, len(chunk), *_row(chunk)))
        if len(rows) >= 5000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64()}
    kinds = [types[field.split()[1]] for field in _CANDIDATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(_FIELDS))


def jump_pointers(starts: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which candidates the first one reaches: pointers are doubled until no new candidate is met."""
    count = len(starts)
    to = np.searchsorted(starts, successors)
    to = np.where((to < count) & (starts[np.minimum(to, count - 1)] == successors), to, count)
    jump = np.append(to, count)  # the last place stands for the end and for broken chains
    reached = np.zeros(count + 1, bool)
    reached[0] = True
    while True:
        met = jump[np.flatnonzero(reached)]
        if reached[met].all():
            return reached[:count]
        reached[met] = True
        jump = jump[jump]


def _verified(table: pa.Table) -> pa.Table:
    """The chain of one file: its records, and for records of several chunks every chunk with its owner."""
    order = np.lexsort((table["local"].to_numpy(), table["block"].to_numpy()))
    table = table.take(pa.array(order))
    size, span = table["size"].to_numpy() + len(MAGIC), table["span"].to_numpy()
    starts = np.cumsum(size) - size - len(MAGIC)  # of the magic before each chunk; -10 for the bytes before the first
    end = int(starts[-1] + size[-1])
    real = np.flatnonzero(starts >= 0)
    file = table["file"][0].as_py()
    empty = real.size == 0
    if empty and end > 0 or starts[0] >= 0:
        raise ValueError(f"{file} doesn't begin with a WARC record")
    reached = np.zeros(len(starts), bool)
    if not empty:
        begins, lengths = starts[real], span[real]
        successors = np.where(lengths > 0, begins + lengths, -1)
        reached[real] = jump_pointers(begins, successors)
        last = real[np.flatnonzero(reached[real])[-1]]
        if begins[0] != 0 or starts[last] + span[last] != end or span[last] <= 0:
            raise ValueError(f"{file}: the chain of records breaks at byte {starts[last]}")
    owner = np.maximum.accumulate(np.where(reached, np.arange(len(starts)), -1))
    split = np.zeros(len(starts), bool)
    split[reached] = span[reached] != size[reached]
    keep = reached | (owner >= 0) & split[owner]
    at = np.flatnonzero(keep)
    return pa.table({
        "file": table["file"].take(pa.array(at)), "block": table["block"].take(pa.array(at)), "local": table["local"].take(pa.array(at)),
        "start": pa.array(starts[owner[at]]), "part": pa.array(at - owner[at]), "split": pa.array(split[owner[at]]),
    })


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, stated_digest, payload_bytes, payload_digest) of every verified record."""
    found = written(_chunks(spark, path).mapInArrow(_candidates, _CANDIDATE), "warc-candidates")
    key = ["file", "block", "local"]
    chain = written(
        found.select(*key, "size", "span").groupBy("file").applyInArrow(
            _verified, "file string, block long, local long, start long, part long, split boolean"),
        "warc-chain",
    )
    fields = _FIELDS[5:]
    whole = chain.filter("not split").join(found, key).select(*fields)
    pieces = chain.filter("split")
    if pieces.isEmpty():
        return whole
    located = _chunks(spark, path).mapInArrow(_pieces, "file string, block long, local long, value binary")
    joined = (
        pieces.join(located, key).groupBy("file", "start")  # the pieces of one record
        .agg(F.sort_array(F.collect_list(F.struct("part", "value"))).alias("parts"))
        .select(F.col("parts.value").alias("parts"))
        .mapInArrow(_joined, ", ".join(f"{f} {'string' if f in ('record_type', 'stated_digest', 'payload_digest') else 'long'}" for f in fields))
    )
    return whole.unionByName(joined)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _located(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["file", "block", "local", "value"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(MAGIC.join(parts.as_py()))[1:] for parts in batch.column(0)]
        if rows:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(_FIELDS[5:]))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Payload length and digest of revisits from the response they name; digests must agree."""
    records = records.withColumn("at", F.when(F.col("record_type") == "revisit", F.col("refers_to")))
    kept = (
        records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("at"), F.col("payload_digest").alias("stated_digest"))
        .agg(F.max("payload_bytes").alias("kept_bytes"))
    )
    revisit = F.col("record_type") == "revisit"
    return records.join(kept, ["at", "stated_digest"], "left").select(
        "page_id", F.when(revisit, F.col("kept_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit & F.col("kept_bytes").isNotNull(), F.col("stated_digest")).when(~revisit, F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )
