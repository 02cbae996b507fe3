import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from postlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(4, "postlake-tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture
def evaluate(spark):
    """Run one column function over a table of inputs and return the results in order."""

    def run(build, inputs, schema="v string"):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, {schema}").repartition(2)
        return [r.out for r in df.select("i", build.alias("out")).orderBy("i").collect()]

    return run
