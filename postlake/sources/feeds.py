"""JSON Lines feeds, CSV snapshots and board payloads as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import schemas
from postlake.functions.jobs import job_fingerprint
from postlake.functions.text import lookup
from postlake.functions.urls import import_domain
from postlake.rules import limits
from postlake.rules.words import BOARD_INTERVALS

IMPORT_VERSION = "jsonl-import/1"


def _line_problem(record: Column, url: Column, captured: Column) -> Column:
    is_object = F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False))
    has_time = F.try_variant_get(record, "$.captured_at", "variant").isNotNull()
    return (
        F.when(record.isNull(), "line is not JSON")
        .when(~is_object, "line is not a JSON object")
        .when(~F.coalesce(F.lower(url).rlike("^https?:"), F.lit(False)), "missing or invalid url")
        .when(~has_time, "missing captured_at")
        .when(captured.isNull(), "invalid captured_at")
    )


def validate_lines(lines: DataFrame, source_id: str, text: str = "value") -> DataFrame:
    """Capture columns of every non-blank line plus ``reject_reason``.

    Line numbers do not exist in a distributed scan, so a record's digest is that of its line.
    """
    lines = lines.filter(F.trim(F.col(text)) != "").withColumn("record", F.try_parse_json(F.col(text)))
    url = F.try_variant_get("record", "$.url", "string")
    seen = F.try_to_timestamp(F.try_variant_get("record", "$.captured_at", "string"))
    fields = F.from_json(F.col(text), "map<string,variant>")
    posting = F.to_json(
        F.map_concat(
            F.map_filter(fields, lambda k, v: ~k.isin("url", "captured_at", "@type")),
            F.create_map(F.lit("@type"), F.coalesce(F.try_element_at(fields, F.lit("@type")), F.parse_json(F.lit('"JobPosting"')))),
        )
    )
    rows = lines.withColumns({"url": url, "captured": seen}).withColumn(
        "reject_reason", _line_problem(F.col("record"), F.col("url"), F.col("captured"))
    )
    good = F.col("reject_reason").isNull()
    return rows.select(
        F.lit(f"import:{source_id}").alias("crawl"), "url",
        F.when(good, import_domain("url")).alias("domain"),
        F.col("captured").alias("index_fetch_time"), F.sha2(F.col(text), 256).alias("content_digest"),
        F.lit(None).cast("string").alias("warc_filename"), F.lit(None).cast("bigint").alias("warc_record_offset"),
        F.lit(None).cast("bigint").alias("warc_record_length"), F.col("captured").alias("captured_at"),
        F.lit(None).cast("int").alias("http_status"), F.lit("ok").alias("fetch_result"),
        F.lit(1).alias("jobposting_count"), F.lit(0).alias("malformed_jsonld"),
        F.when(good, F.concat(F.lit("["), posting, F.lit("]"))).alias("postings_json"),
        F.current_timestamp().alias("fetched_at"), F.lit(IMPORT_VERSION).alias("connector_version"),
        "reject_reason",
    )


def read_jsonl(spark: SparkSession, path: str, source_id: str, imported: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted captures, rejects). Lines already in ``imported`` are not accepted again."""
    rows = validate_lines(spark.read.text(path), source_id)
    accepted = rows.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    if imported is not None:
        accepted = accepted.join(imported.select("content_digest"), "content_digest", "left_anti")
    return accepted, rows.filter(F.col("reject_reason").isNotNull())


def import_summary(rows: DataFrame, samples: int = limits.REJECTION_SAMPLES) -> DataFrame:
    """One row (lines, imported, rejected, rejection_samples) of ``validate_lines`` output."""
    bad = F.col("reject_reason").isNotNull()
    sampled = rows.filter(bad).select("content_digest", "reject_reason").orderBy("content_digest").limit(samples)
    counts = rows.agg(F.count("*").alias("lines"), F.count_if(~bad).alias("imported"), F.count_if(bad).alias("rejected"))
    return counts.withColumn(
        "rejection_samples", sampled.agg(F.array_sort(F.collect_list("reject_reason"))).scalar()
    )


def read_snapshot_csv(spark: SparkSession, path: str) -> DataFrame:
    """The card snapshot with its header checked. A byte-order mark on the first name is dropped."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", False)
    df = reader.csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return schemas.required_columns(df, schemas.SNAPSHOT_COLUMNS, "card snapshot").select(*schemas.SNAPSHOT_COLUMNS)


def snapshot_source_jobs(df: DataFrame) -> DataFrame:
    """Card rows to source-record columns; the key is the content fingerprint."""
    c = F.col
    return df.select(
        job_fingerprint("job_title", "company_name", "location").alias("source_key"),
        F.lit("content_fingerprint").alias("source_key_kind"),
        c("job_title").alias("title"), "company_name", c("location").alias("location_text"),
        c("salary_range").alias("salary_text"), c("job_type").alias("employment_type_text"),
        c("experience_level").alias("experience_text"), c("education_req").alias("education_text"),
        F.split("job_requirements", r" \| ").alias("tags"), c("posted_date").alias("posted_text"),
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in schemas.SNAPSHOT_COLUMNS]), F.array(*schemas.SNAPSHOT_COLUMNS)
        ).alias("raw_fields"),
    )


def board_source_jobs(df: DataFrame, company: str, json_col: str = "value", keep_description: bool = False) -> DataFrame:
    """Board payload postings (one JSON object per row) to source-record columns.

    An object without ``id`` or ``text`` breaks the payload contract and gets a
    ``shape_problem`` instead of values.
    """
    p = df.withColumn("p", F.from_json(json_col, schemas.BOARD_POSTING))
    pay = F.col("p.salaryRange")
    return p.select(
        *[c for c in df.columns if c != json_col],
        F.col("p.id").alias("source_key"), F.lit("source_id").alias("source_key_kind"),
        F.col("p.text").alias("title"), F.lit(company).alias("company_name"),
        F.col("p.categories.location").alias("location_text"),
        F.col("p.categories.commitment").alias("employment_type_text"),
        F.col("p.workplaceType").alias("work_arrangement_text"),
        F.when(
            pay.isNotNull(),
            F.struct(
                pay["min"].cast("bigint").alias("minimum"), pay["max"].cast("bigint").alias("maximum"),
                pay["currency"].alias("currency"),
                F.coalesce(lookup(BOARD_INTERVALS, pay["interval"]), F.lit("UNKNOWN")).alias("period"),
            ),
        ).alias("structured_salary"),
        (F.col("p.descriptionPlain") if keep_description else F.lit(None).cast("string")).alias("description"),
        F.timestamp_millis("p.createdAt").alias("published_at"),
        F.col("p.hostedUrl").alias("source_url"),
        F.from_json(json_col, "map<string,string>").alias("raw_fields"),
        F.when(F.col("p.id").isNull() | F.col("p.text").isNull(), "posting lacks 'id' or 'text'").alias("shape_problem"),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Reviewer labels; see ``operators.evaluation.label_problems`` for the checks."""
    return spark.read.option("header", True).csv(path).select("*")
