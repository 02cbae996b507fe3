"""The manifest of index files: bounds from footers, refreshes that open new footers only, scans of covering files."""

import pytest
from pyspark.sql import functions as F

from postlake.sources import index_files

ROWS = "page_id bigint, url_surtkey string"


def add(spark, path, *keys):
    rows = [(n, k) for n, k in enumerate(keys)]
    spark.createDataFrame(rows, ROWS).coalesce(1).sortWithinPartitions("url_surtkey").write.mode("append").parquet(path)


@pytest.fixture
def index(spark, tmp_path):
    path = f"file:{tmp_path}/index"
    add(spark, path, "com,a)/", "com,z)/x")
    add(spark, path, "id,a)/1", "id,co,b)/2")
    add(spark, path, "com,y)/", "id,0)/", "net,a)/")
    add(spark, path, "id-x)/", "net,b)/")
    add(spark, path, None, None)
    return path


def test_files_are_chosen_by_their_intervals(spark, index):
    assert index_files.refresh_manifest(spark, index) == {"files": 5, "footers_read": 5}
    bounds = {(r.least_key, r.greatest_key): r.rows for r in index_files.manifest(spark, index).read("files").collect()}
    assert bounds[("id,a)/1", "id,co,b)/2")] == 2 and bounds[("com,y)/", "net,a)/")] == 3
    assert sorted(r.least_key for r in index_files.files_covering(spark, index).collect()) == ["com,y)/", "id,a)/1"]
    found = index_files.read_index_range(spark, index)
    assert len(found.inputFiles()) == 2
    assert sorted(r.url_surtkey for r in found.collect()) == ["id,0)/", "id,a)/1", "id,co,b)/2"]
    assert spark.read.parquet(index).count() == 11  # readers of the index pass over the manifest
    with pytest.raises(LookupError):
        index_files.read_index_range(spark, index, "zz", "zzz")


def test_a_refresh_opens_new_footers_only(spark, index, monkeypatch):
    index_files.refresh_manifest(spark, index)
    assert index_files.refresh_manifest(spark, index) == {"files": 5, "footers_read": 0}
    add(spark, index, "id,new)/")
    assert index_files.refresh_manifest(spark, index) == {"files": 6, "footers_read": 1}
    gone = spark.read.parquet(index).filter("url_surtkey = 'id,new)/'").select(F.input_file_name().alias("f")).first().f
    import os

    os.remove(gone.removeprefix("file://"))
    assert index_files.refresh_manifest(spark, index) == {"files": 5, "footers_read": 0}
    assert len(index_files.read_index_range(spark, index).inputFiles()) == 2


def test_a_file_without_statistics_is_always_read(spark, index, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"page_id": pa.array([9]), "url_surtkey": pa.array(["id,x)/"])}), tmp_path / "index" / "bare.parquet", write_statistics=False)
    index_files.refresh_manifest(spark, index)
    assert len(index_files.read_index_range(spark, index, "zz", "zzz").inputFiles()) == 1
    assert index_files.read_index_range(spark, index).count() == 4


def test_an_index_without_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert index_files.refresh_manifest(spark, f"file:{tmp_path}/none") == {"files": 0, "footers_read": 0}
    with pytest.raises(LookupError):
        index_files.read_index_range(spark, f"file:{tmp_path}/none")
