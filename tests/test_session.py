"""Staged tables can be dropped by those who know that nothing reads them any more."""

from __future__ import annotations

from pathlib import Path

from salespark.session import drop_stages, shared_folder, stage, stages_written


def folders(spark):
    return {p.name for p in Path(shared_folder(spark), "salespark").iterdir()}


def test_only_later_tables_are_dropped(spark):
    first = stage(spark.range(3), "kept")
    before = stages_written(spark)
    stage(spark.range(4), "gone")
    last = stage(spark.range(5), "last")
    assert drop_stages(spark, before, but_last=1) == 1 and stages_written(spark) == before + 1
    assert first.count() == 3 and last.count() == 5 and not any(f.startswith("gone") for f in folders(spark))
    assert drop_stages(spark, before) == 1 and drop_stages(spark, before) == 0
