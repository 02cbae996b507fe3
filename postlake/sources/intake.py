"""Batch-incremental intake: parse only files that are not in the manifest yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.rules.skills import SKILL_DICTIONARY_VERSION
from postlake.rules.words import PARSER_VERSION

LAYOUT = 2
VERSION = f"{PARSER_VERSION}+{SKILL_DICTIONARY_VERSION}+layout-{LAYOUT}"


def new_files(captures: DataFrame, manifest: DataFrame | None, version: str = VERSION) -> DataFrame:
    """Captures of files the manifest (registry_source_id, bronze_file, version) does not list
    under this version; another version means everything is parsed again."""
    if manifest is None:
        return captures
    done = manifest.filter(F.col("version") == version).select("registry_source_id", "bronze_file")
    return captures.join(done, ["registry_source_id", "bronze_file"], "left_anti")


def manifest_rows(captures: DataFrame, version: str = VERSION) -> DataFrame:
    return captures.select("registry_source_id", "bronze_file").distinct().withColumn("version", F.lit(version))
