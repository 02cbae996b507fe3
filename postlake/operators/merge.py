"""Snapshot merges as full outer joins: upsert, cross-source match, retirement, run records.

A table version is a new DataFrame; nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.rules import limits
from postlake.rules.words import NORMALIZATION_VERSION


def upsert(
    old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], hash_col: str = "content_hash",
    version_col: str = "normalization_version", version: str = NORMALIZATION_VERSION,
    primary: Column | None = None,
) -> DataFrame:
    """New table version with an ``outcome``: kept, unchanged, updated or created.

    Seen-times only widen. Changed content or another rules version makes a row 'updated';
    ``primary`` (over the joined row's ``o``/``n`` structs) says whether the new row may
    rewrite the values, which only a row's own source may.
    """
    o = old.select(*keys, F.struct(*old.columns).alias("o"))
    n = new.select(*keys, F.struct(*new.columns).alias("n"))
    both = o.join(n, list(keys), "full_outer")
    had, got = F.col("o").isNotNull(), F.col("n").isNotNull()
    changed = (F.col(f"o.{hash_col}") != F.col(f"n.{hash_col}")) | (F.col(f"o.{version_col}") != F.lit(version))
    both = both.withColumn(
        "outcome",
        F.when(~got, "kept").when(~had, "created").when(F.coalesce(changed, F.lit(True)), "updated")
        .otherwise("unchanged"),
    )
    owns = F.lit(True) if primary is None else F.coalesce(primary, F.lit(False))
    rewrite = (F.col("outcome") == "created") | ((F.col("outcome") == "updated") & owns)
    taken = F.col("outcome").isin("created", "updated")
    picked = {v: F.when(rewrite, F.col(f"n.{v}")).otherwise(F.col(f"o.{v}")) for v in values}
    picked[hash_col] = F.when(taken, F.col(f"n.{hash_col}")).otherwise(F.col(f"o.{hash_col}"))
    picked[version_col] = F.when(rewrite, F.lit(version)).otherwise(F.col(f"o.{version_col}"))
    return both.select(
        *keys, *[c.alias(name) for name, c in picked.items()],
        F.least("o.first_seen_at", "n.first_seen_at").alias("first_seen_at"),
        F.greatest("o.last_seen_at", "n.last_seen_at").alias("last_seen_at"),
        "outcome",
    )


def cross_source_matches(jobs: DataFrame, incoming: DataFrame, source: str) -> DataFrame:
    """(source_key, job_id): incoming records whose fingerprint is held by exactly one job of
    another source. Ambiguous fingerprints link to nothing."""
    others = jobs.filter(F.col("primary_source_id") != source).groupBy("fingerprint").agg(
        F.count("*").alias("n"), F.min("id").alias("job_id")
    )
    unique = others.filter(F.col("n") == 1).select("fingerprint", "job_id")
    return incoming.join(unique, "fingerprint").select("source_key", "job_id")


def job_id(source: Column | str, key: Column | str) -> Column:
    """Deterministic id of a job created for a source record, so rebuilds are repeatable."""
    source = F.lit(source) if isinstance(source, str) else source
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", source, key))


def merge_records(
    jobs: DataFrame, records: DataFrame, incoming: DataFrame, source: str, job_values: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """(jobs, records) after one run of ``source``, each with an ``outcome`` column.

    ``records``: source_id, source_key, job_id, match_rule, content_hash, normalization_version,
    first/last_seen_at. ``jobs``: id, primary_source_id, fingerprint, job_values, version, times.
    """
    matched = cross_source_matches(jobs, incoming, source)
    known = records.filter(F.col("source_id") == source).select("source_key", F.col("job_id").alias("held"))
    arriving = (
        incoming.join(known, "source_key", "left").join(matched.withColumnRenamed("job_id", "linked"), "source_key", "left")
        .withColumns(
            {
                "source_id": F.lit(source),
                "job_id": F.coalesce("held", "linked", job_id(source, "source_key")),
                "match_rule": F.when(F.col("held").isNull() & F.col("linked").isNotNull(), "cross_source_fingerprint")
                .otherwise("new_job"),
            }
        )
    )
    new_records = arriving.select(
        "source_id", "source_key", "job_id", "match_rule", "content_hash", "normalization_version",
        "first_seen_at", "last_seen_at",
    )
    # A record's link is decided when it is created and never rewritten.
    merged_records = upsert(
        records, new_records, ["source_id", "source_key"], ["job_id", "match_rule"],
        primary=F.lit(False),
    )
    seen = arriving.groupBy(F.col("job_id").alias("id")).agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.max(F.struct("source_key", "source_id", "fingerprint", "content_hash", "normalization_version",
                       F.struct(*job_values).alias("v"))).alias("m"),
    )
    # The job's stored hash is its record's; a linked record of another source never owns it.
    old = jobs.join(
        records.groupBy(F.col("job_id").alias("id"), F.col("source_id").alias("primary_source_id"))
        .agg(F.max("content_hash").alias("content_hash")),
        ["id", "primary_source_id"], "left",
    )
    new_jobs = seen.select(
        "id", F.col("m.source_id").alias("primary_source_id"), F.col("m.fingerprint").alias("fingerprint"),
        *[F.col(f"m.v.{v}").alias(v) for v in job_values], F.col("m.content_hash").alias("content_hash"),
        F.col("m.normalization_version").alias("normalization_version"), "first_seen_at", "last_seen_at",
    )
    merged_jobs = upsert(
        old, new_jobs, ["id"], ["primary_source_id", "fingerprint", *job_values],
        primary=F.col("o.primary_source_id") == F.col("n.primary_source_id"),
    )
    return merged_jobs.drop("content_hash"), merged_records


def unlisted_records(records: DataFrame, snapshot: DataFrame, source: str) -> DataFrame:
    """The source's records its latest complete snapshot (source_key) no longer lists."""
    mine = records.filter(F.col("source_id") == source)
    return mine.join(snapshot.select("source_key"), "source_key", "left_anti")


def retire(jobs: DataFrame, records: DataFrame, snapshot: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, records) without unlisted records and without jobs only they backed."""
    stale = unlisted_records(records, snapshot, source).select("source_id", "source_key", "job_id")
    left = records.join(stale.select("source_id", "source_key"), ["source_id", "source_key"], "left_anti")
    orphans = stale.select("job_id").distinct().join(left.select("job_id"), "job_id", "left_anti")
    return jobs.join(orphans.withColumnRenamed("job_id", "id"), "id", "left_anti"), left


def snapshot_gate(incoming: DataFrame) -> DataFrame:
    """One row: may this complete snapshot be published? Any reject means nothing is."""
    rejected = F.count_if(F.col("reject_reason").isNotNull())
    return incoming.agg(F.count("*").alias("records_seen"), rejected.alias("records_rejected")).withColumn(
        "publishable", F.col("records_rejected") == 0
    )


def run_status(seen: Column, accepted: Column, rejected: Column, failed: Column | None = None) -> Column:
    """SUCCEEDED, PARTIAL or FAILED from the run's counts."""
    failed = F.lit(False) if failed is None else failed
    return (
        F.when(failed, F.when(accepted > 0, "PARTIAL").otherwise("FAILED"))
        .when(rejected == 0, "SUCCEEDED").when(accepted == 0, "FAILED").otherwise("PARTIAL")
    )


def run_record(outcomes: DataFrame, rejects: DataFrame, samples: int = limits.REJECTION_SAMPLES) -> DataFrame:
    """One run row from ``outcomes`` (outcome, matched) and ``rejects`` (source_key, reject_reason)."""
    counted = outcomes.filter(F.col("outcome") != "kept").agg(
        *[F.count_if(F.col("outcome") == o).alias(f"records_{o}") for o in ("created", "updated", "unchanged")],
        F.count_if(F.col("matched")).alias("cross_source_matches"),
    )
    rejected = rejects.agg(F.count("*").alias("n"))
    # At most ``samples`` rows are gathered, as the run record wants.
    sampled = rejects.select("source_key", "reject_reason").orderBy("source_key").limit(samples)
    sampled = sampled.agg(F.array_sort(F.collect_list(F.struct("source_key", "reject_reason"))).alias("s"))
    accepted = F.col("records_created") + F.col("records_updated") + F.col("records_unchanged")
    out = counted.withColumn("records_rejected", rejected.select("n").scalar())
    out = out.withColumn("records_seen", accepted + F.col("records_rejected"))
    return out.withColumns(
        {
            "status": run_status(F.col("records_seen"), accepted, F.col("records_rejected")),
            "empty_result": F.col("records_seen") == 0,
            "rejection_samples": sampled.select("s").scalar(),
        }
    )


# --- registry -------------------------------------------------------------------------------


def sync_registry(registry: DataFrame, reviewed: DataFrame, keep_if_older=("permission_status", "reviewed_at")) -> tuple[DataFrame, DataFrame]:
    """(registry, audit) after merging reviewed entries (id, ..., permission_status, reviewed_at).

    The permission and its review time are only replaced by a newer review.
    """
    o = registry.select("id", F.struct(*registry.columns).alias("o"))
    n = reviewed.select("id", F.struct(*reviewed.columns).alias("n"))
    both = o.join(n, "id", "full_outer")
    newer = F.col("o").isNull() | F.col("o.reviewed_at").isNull() | (F.col("n.reviewed_at") > F.col("o.reviewed_at"))
    both = both.withColumn("newer", F.coalesce(F.col("n").isNotNull() & newer, F.lit(False)))

    def merged(column: str) -> Column:
        if column not in reviewed.columns:
            return F.col(f"o.{column}")
        take = F.col("newer") if column in keep_if_older else F.col("n").isNotNull()
        return F.when(take, F.col(f"n.{column}")).otherwise(F.col(f"o.{column}"))

    table = both.select("id", *[merged(c).alias(c) for c in registry.columns if c != "id"])
    before, after = F.col("o.permission_status"), F.col("n.permission_status")
    action = F.when(F.col("o").isNull(), "source.created").when(
        F.col("newer") & (before != after), "source.permission_changed"
    )
    audit = both.filter(F.col("n").isNotNull()).select(
        F.lit("registry-sync").alias("actor"), action.alias("action"), F.col("id").alias("entity_id"),
        before.alias("from_status"), after.alias("to_status"),
    ).filter(F.col("action").isNotNull())
    return table, audit


def apply_decisions(registry: DataFrame, decisions: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(registry, audit) after decisions (id, actor, action, status, reason, evidence_url).

    Actions: set_status (needs a reason and evidence), pause, resume (refused for sources that
    are not approved). One decision per source and call.
    """
    d = decisions.select("id", F.struct(*decisions.columns).alias("d"))
    both = registry.select("id", F.struct(*registry.columns).alias("o")).join(d, "id", "left")
    act = F.col("d.action")
    documented = (F.trim(F.coalesce("d.reason", F.lit(""))) != "") & (F.trim(F.coalesce("d.evidence_url", F.lit(""))) != "")
    refused = (
        F.when((act == "set_status") & ~documented, "a permission change needs a reason and an evidence URL")
        .when((act == "resume") & ~F.col("o.permission_status").isin("APPROVED", "APPROVED_WITH_CONDITIONS"),
              "record an approval before resuming")
    )
    both = both.withColumn("refusal", refused)
    ok = F.col("d").isNotNull() & F.col("refusal").isNull()
    decided = ok & (act == "set_status")
    new = {
        "permission_status": F.when(decided, F.col("d.status")).otherwise(F.col("o.permission_status")),
        "reviewed_at": F.when(decided, F.lit(as_of).cast("timestamp")).otherwise(F.col("o.reviewed_at")),
        "is_paused": F.when(ok & (act == "pause"), True).when(ok & (act == "resume"), False)
        .otherwise(F.col("o.is_paused")),
    }
    table = both.select("id", *[new.get(c, F.col(f"o.{c}")).alias(c) for c in registry.columns if c != "id"])
    audit = both.filter(F.col("d").isNotNull()).select(
        F.col("d.actor").alias("actor"),
        F.when(act == "set_status", "source.permission_changed").when(act == "pause", "source.paused")
        .otherwise("source.resumed").alias("action"),
        F.col("id").alias("entity_id"), F.col("d.reason").alias("reason"), "refusal",
    )
    return table, audit
