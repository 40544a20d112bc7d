"""What a query writes to the shared folder goes once its result is stored."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from lexiforge.llm import queries
from lexiforge.llm.common import shared_dir


def listed(spark):
    root = Path(shared_dir(spark).removeprefix("file://"))
    return {str(p.relative_to(root)) for p in root.rglob("*") if p.is_dir() and p.parent.name == "lexiforge"}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_folder_is_as_before(name, spark, small, tmp_path):
    before = listed(spark)
    with entry.kept_tables():
        queries.queries()[name](spark, small).write.parquet(str(tmp_path / "out"))
    assert listed(spark) == before
    assert spark.read.parquet(str(tmp_path / "out")).columns
