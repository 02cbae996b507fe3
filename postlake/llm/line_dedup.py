"""Line dedup: lines that many documents hold stay in one of them only.

Lines are exploded with their position; a line's key is the line without ASCII white space at both
ends, A-Z lower-cased, and travels as 128 bits of hash. Distinct documents are counted per key. Of
the keys found in ``least_docs`` documents or more, the lines go in all documents but the one with
the largest id, and each text is put together again from the positions that stay.

Only hashes and positions are grouped by key. The heaviest ``HEAVY_KEYS`` keys (a fixed number of
rows, whatever the input) are broadcast, so their lines are never gathered by key; any other key has
at most one line in ``HEAVY_KEYS`` of all. The text is shuffled once, by document, where its dropped
positions come to it; a document's positions are no more than its own lines.

Null and empty texts: one empty line. A row is told by its id and text, so repeated rows count as one
document and give equal results, and rows with one id and different texts are one document in the
count. Null ids are one document, smaller than all others. Empty tables give no rows. Columns besides
the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.stage import written

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Keys that are broadcast instead of gathered.
HEAVY_KEYS = 1000

# White space of the contract and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stripped(line: Column | str) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_key(line: Column | str) -> Column:
    """The form in which lines are compared."""
    return F.translate(stripped(line), UPPER, LOWER)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, row_1, row_2)"""
    named = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    return named.withColumns({"row_1": F.xxhash64("doc_id", "text"), "row_2": F.xxhash64(F.lit("row"), "doc_id", "text")})


def exploded_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """(row_1, row_2, doc_id, position, key) of every line whose key is long enough."""
    lines = rows.select("row_1", "row_2", "doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    long_enough = lines.filter(F.length(stripped("line")) >= least_chars)
    return long_enough.select("row_1", "row_2", "doc_id", "position", F.unhex(F.md5(line_key("line"))).alias("key"))


def frequent_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """(key, holders, keeper) of the keys found in enough documents."""
    held = lines.select("key", "doc_id").distinct()
    counted = held.groupBy("key").agg(F.count("*").alias("holders"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("holders") >= least_docs)


def dropped_lines(lines: DataFrame, least_docs: int, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """(row_1, row_2, position) of every line that goes."""
    frequent = written(frequent_keys(lines, least_docs), "line-keys")
    heavy = F.broadcast(frequent.orderBy(F.desc("holders"), "key").limit(heavy_keys).select("key", "keeper"))
    rest = frequent.join(heavy, "key", "left_anti").select("key", "keeper")
    elsewhere = ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    gone = [
        lines.join(heavy, "key"),
        lines.join(heavy, "key", "left_anti").join(rest.hint("merge"), "key"),
    ]
    return gone[0].unionByName(gone[1]).filter(elsewhere).select("row_1", "row_2", "position")


def dedup_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for every row."""
    rows = _rows(docs, id_col, text_col)
    lines = written(exploded_lines(rows, least_chars), "lines")
    dropped = dropped_lines(lines, least_docs).groupBy("row_1", "row_2").agg(F.collect_set("position").alias("dropped"))
    # A merge join at every size: the plan that is tested is the plan that runs.
    both = rows.join(dropped.hint("merge"), ["row_1", "row_2"], "left")
    both = both.withColumns({"lines": F.split("text", "\n"), "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("long")})
    n_lines = F.size("lines")
    staying = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("dropped"))
    kept = F.array_join(F.transform(staying, lambda i: F.get("lines", i)), "\n")
    return both.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), "n_dropped",
        F.when(F.col("n_dropped") > 0, kept).otherwise(F.col("text")).alias("kept_text"),
    )
