"""Serving runs: refuse, import, publish a complete snapshot or nothing."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions.jobs import normalize_source_jobs
from postlake.operators.merge import merge_records, retire, snapshot_gate, unlisted_records
from postlake.operators.policy import refusal_reason
from postlake.rules import limits
from postlake.rules.words import NORMALIZATION_VERSION
from postlake.session import cut_lineage, spread
from postlake.sources.versions import StaleVersion, Version, VersionedTables

JOB_VALUES = (
    "title", "role_family", "company_name", "location_text", "city", "province", "location_confidence",
    "employment_type", "work_arrangement", "experience_band", "education_level", "salary_text",
    "salary_status", "salary_min", "salary_max", "salary_currency", "salary_period",
    "salary_period_assumed", "salary_monthly_min", "salary_monthly_max", "source_tags",
    "hidden_tag_count", "posted_age_days", "is_urgent", "published_at", "expires_at", "source_url",
    "quality_flags", "search_text",
)


@dataclass(frozen=True)
class Run:
    jobs: DataFrame
    records: DataFrame
    rejects: DataFrame
    published: bool


def _normalized(source_rows: DataFrame, observed_at, currency: str | None, period: str | None) -> DataFrame:
    """A source's rows normalized once; the gate, the rejects and both merges read them."""
    observed = F.lit(observed_at).cast("timestamp")
    rows = normalize_source_jobs(spread(source_rows), currency, period)
    last = F.coalesce("last_observed_at", observed)
    return cut_lineage(rows.withColumns({"last_seen_at": last, "first_seen_at": F.coalesce("first_observed_at", last)}))


def _one_per_key(rows: DataFrame) -> DataFrame:
    """The accepted rows. Listed twice with one key: the later sighting counts, ties by content."""
    good = rows.filter(F.col("reject_reason").isNull())
    return good.groupBy("source_key").agg(
        F.max_by(F.struct(*[c for c in good.columns if c not in ("source_key", "raw_fields")]),
                 F.struct("last_seen_at", "content_hash")).alias("r")
    ).select("source_key", "r.*")


def import_source(
    jobs: DataFrame, records: DataFrame, source_rows: DataFrame, source: str, observed_at, currency: str | None = None,
    period: str | None = None, replaces_snapshot: bool = False,
) -> Run:
    """Normalize and merge one source's rows. A complete snapshot (``replaces_snapshot``) with
    any rejected record changes nothing; otherwise its unlisted records are retired."""
    rows = _normalized(source_rows, observed_at, currency, period)
    rejects = rows.filter(F.col("reject_reason").isNotNull()).select("source_key", "reject_reason")
    if replaces_snapshot and not snapshot_gate(rows).first()["publishable"]:
        return Run(jobs, records, rejects, False)
    good = _one_per_key(rows)
    new_jobs, new_records = merge_records(jobs, records, good, source, JOB_VALUES)
    if replaces_snapshot:
        new_jobs, new_records = retire(new_jobs, new_records, good, source)
    return Run(new_jobs, new_records, rejects, True)


# --- published runs -------------------------------------------------------------------------

RECORD_SCHEMA = (
    "source_id string, source_key string, job_id string, match_rule string, content_hash string, normalization_version string, "
    "first_seen_at timestamp, last_seen_at timestamp"
)
#: Columns that a source's rows must have.
REQUIRED = ("source_key", "title")


class ConnectorFailure(RuntimeError):
    """A source stopped delivering; what it delivered before is still imported."""

    def __init__(self, category: str, message: str) -> None:
        super().__init__(message)
        self.category = category


def _tables(store: VersionedTables, version: Version, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, records) of a version; empty ones with the columns of the normalized rows before the first."""
    if "jobs" in version.schemas:
        return store.read("jobs", version), store.read("records", version)
    spark, typed = rows.sparkSession, {f.name: f.dataType.simpleString() for f in rows.schema}
    values = ", ".join(f"{v} {typed[v]}" for v in JOB_VALUES)
    jobs = f"id string, primary_source_id string, fingerprint string, {values}, normalization_version string, first_seen_at timestamp, last_seen_at timestamp"
    return spark.createDataFrame([], jobs), spark.createDataFrame([], RECORD_SCHEMA)


def _concerned(jobs: DataFrame, records: DataFrame, good: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """The jobs and records that a run of ``source`` can read or change.

    Jobs: the source's own, those its records are linked to, and those of other sources with a fingerprint
    of an incoming row. Records: the source's own, and all of those jobs.
    """
    mine = records.filter(F.col("source_id") == source)
    ids = (
        jobs.filter(F.col("primary_source_id") == source).select("id")
        .unionByName(mine.select(F.col("job_id").alias("id")))
        .unionByName(jobs.join(good.select("fingerprint").distinct(), "fingerprint", "left_semi").select("id"))
        .distinct()
    )
    near = cut_lineage(jobs.join(ids, "id", "left_semi"))
    others = records.filter(F.col("source_id") != source).join(near.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return near, mine.unionByName(others.select(*mine.columns))


def run_source(
    store: VersionedTables, registry: DataFrame, rows: DataFrame, source: str, observed_at, *, mode: str = "import",
    trigger: str = "job", replaces_snapshot: bool = False, max_records: int | None = None, currency: str | None = None,
    period: str | None = None, input_reference: str | None = None, failure: ConnectorFailure | None = None,
) -> Version:
    """One run of a source: refuse, import, and publish jobs and records as a new version; returns the run's version.

    The run row is committed in every case: REFUSED by the registry's policy, FAILED with nothing published (columns
    missing, every record rejected, a complete snapshot with a reject, a limit or a failure), PARTIAL or SUCCEEDED.
    ``failure`` says that ``rows`` is what came before the source stopped. A complete snapshot retires records that
    it no longer lists and jobs that only they backed, with an audit row. An unexpected error is recorded and raised.
    """
    started = datetime.now(timezone.utc)
    run = {
        "source_id": source, "mode": mode, "trigger": trigger, "observed_at": observed_at, "started_at": started,
        "parser_version": NORMALIZATION_VERSION, "input_reference": input_reference,
        "records_seen": 0, "records_created": 0, "records_updated": 0, "records_unchanged": 0, "records_rejected": 0,
        "cross_source_matches": 0,
    }
    base = store.current()

    def finish(status: str, category: str | None = None, message: str | None = None, parts=None, schemas=None, audit=()) -> Version:
        run.update(status=status, error_category=category, message=message, finished_at=datetime.now(timezone.utc))
        stamped = {k: v.astimezone(timezone.utc).isoformat() if isinstance(v, datetime) else v for k, v in run.items()}
        return store.commit(base, parts or {}, schemas or {}, stamped, list(audit))

    entry = registry.filter(F.col("id") == source).select(refusal_reason(mode, observed_at).alias("reason")).take(1)
    refusal = entry[0]["reason"] if entry else "not in the registry"
    if refusal:
        return finish("REFUSED", "POLICY_BLOCKED", refusal)
    missing = sorted(set(REQUIRED) - set(rows.columns))
    if missing:
        return finish("FAILED", "SCHEMA_CHANGED", f"columns are missing: {', '.join(missing)}")
    try:
        if max_records is not None:
            rows = cut_lineage(rows.orderBy("source_key").limit(max_records + 1))
            if rows.count() > max_records:
                run["stopped_at_record_limit"] = max_records
                rows = rows.orderBy("source_key").limit(max_records)
        rows = _normalized(rows, observed_at, currency, period)
        seen = snapshot_gate(rows).first()
        run.update(records_seen=seen["records_seen"], records_rejected=seen["records_rejected"])
        if run["records_rejected"]:
            samples = rows.filter("reject_reason is not null").select("source_key", F.col("reject_reason").alias("reason"))
            run["rejection_samples"] = [r.asDict() for r in samples.orderBy("source_key").limit(limits.REJECTION_SAMPLES).collect()]
        if not run["records_seen"]:
            run["empty_result"] = True
        limited = "stopped_at_record_limit" in run
        if replaces_snapshot and (failure or run["records_rejected"] or limited):
            run["rolled_back"] = True
            if failure:
                return finish("FAILED", failure.category, f"{failure}; nothing was published")
            reason = "a record limit was set" if limited else "some records were rejected"
            category = "INVALID_RECORDS" if run["records_rejected"] else None
            return finish("FAILED", category, f"incomplete snapshot ({reason}); nothing was published")
        accepted = run["records_seen"] - run["records_rejected"]
        status, category, message = "SUCCEEDED", None, None
        if failure:
            status, category, message = "PARTIAL" if accepted else "FAILED", failure.category, str(failure)
        elif run["records_rejected"]:
            status, category = "PARTIAL" if accepted else "FAILED", "INVALID_RECORDS"
            message = "some records were rejected" if accepted else "every record was rejected"
        if not accepted and not replaces_snapshot:
            return finish(status, category, message)
        parts, schemas, counts, audit = _published(store, base, rows, source, replaces_snapshot)
        run.update(counts)
        return finish(status, category, message, parts, schemas, audit)
    except StaleVersion:
        raise
    except Exception:
        finish("FAILED", "INTERNAL", "unexpected error; see the job's log")
        raise


def _published(store: VersionedTables, base: Version, rows: DataFrame, source: str, replaces_snapshot: bool):
    """(changed parts, schemas, counts, audit rows) after merging one source's rows; the parts' files are written."""
    jobs, records = _tables(store, base, rows)
    good = cut_lineage(_one_per_key(rows))
    near_jobs, near_records = _concerned(jobs, records, good, source)
    new_jobs, new_records = (cut_lineage(x) for x in merge_records(near_jobs, near_records, good, source, JOB_VALUES))
    counts, audit = {}, []
    changed = new_jobs.filter("outcome <> 'kept'").select("primary_source_id")
    if replaces_snapshot:
        stale = unlisted_records(new_records, good, source)
        left_jobs, left_records = retire(new_jobs, new_records, good, source)
        left_jobs = cut_lineage(left_jobs)
        counts = {"retired_records": stale.count(), "retired_jobs": new_jobs.count() - left_jobs.count()}
        if counts["retired_records"]:
            audit.append({
                "actor": f"run:{source}", "action": "source.records_retired", "entity_type": "source", "entity_id": source,
                "reason": "no longer present in the source's latest complete input",
                "records": counts["retired_records"], "jobs": counts["retired_jobs"],
            })
        changed = changed.unionByName(new_jobs.join(left_jobs.select("id"), "id", "left_anti").select("primary_source_id"))
    else:
        left_jobs, left_records = new_jobs, new_records
    # Registered sources, of which one run touches some: their names are few.
    touched = sorted({r[0] for r in changed.distinct().collect()} | {source})
    others = [s for s in touched if s != source]
    job_rows = left_jobs.filter(F.col("primary_source_id").isin(touched)).drop("outcome").select(*jobs.columns)
    if others:
        untouched = store.read("jobs", base, others).join(near_jobs.select("id"), "id", "left_anti")
        job_rows = job_rows.unionByName(untouched)
    outcome = F.col("outcome")
    linked = (outcome == "created") & (F.col("match_rule") == "cross_source_fingerprint")
    own = left_records.filter(F.col("source_id") == source)
    counts |= own.agg(
        *[F.count_if(outcome == o).alias(f"records_{o}") for o in ("created", "updated", "unchanged")],
        F.count_if(linked).alias("cross_source_matches")).first().asDict()
    folder = store.new_folder()
    parts = {
        "records": {source: None, **store.write("records", own.select(*records.columns), "source_id", folder)},
        "jobs": {**dict.fromkeys(touched), **store.write("jobs", job_rows, "primary_source_id", folder)},
    }
    schemas = {"jobs": job_rows.schema.jsonValue(), "records": own.select(*records.columns).schema.jsonValue()}
    return parts, schemas, counts, audit
