"""Jobs and tables that near_dedup makes: each one stays in the driver's memory for a while."""

from __future__ import annotations

from pathlib import Path

from tidemark.llm import near_dedup
from tidemark.llm._base import discard, materialize
from tidemark.sources import shared


def tables_and_jobs(spark, run, group: str) -> tuple[int, int]:
    known, context = shared._TABLES.setdefault(spark.sparkContext.applicationId, []), spark.sparkContext
    before = set(known)
    context.setJobGroup(group, group)
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(set(known) - before), len(context.statusTracker().getJobIdsForGroup(group))


def test_discard_runs_no_job(spark):
    table = materialize(spark.range(5).toDF("x"), "to-go")
    path = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists()
    assert tables_and_jobs(spark, lambda: discard(table), "discard") == (0, 0)
    assert not path.exists()


def test_groups_are_one_table(spark):
    """Rows of other texts under one doc_id are two classes of one node; a group's p is the least of its smallest node's."""
    classes = materialize(spark.createDataFrame([(1, 9, [7]), (1, 4, [8]), (2, 5, [3]), (3, 6, [2])], "node long, n long, parity array<long>"), "classes")
    rows = materialize(spark.createDataFrame([(10, 1), (10, 2), (11, 3), (12, 3), (12, 2)], "key long, node long"), "rows")
    out = []
    assert tables_and_jobs(spark, lambda: out.append(near_dedup._grouped(rows, classes)), "grouped")[0] == 1
    got = sorted((r.key, r.c, r.node, r.n, r.bits, tuple(r.p)) for r in out[0].collect())
    assert got == [(10, 2, 1, 4, 8, (1, 4, 8)), (10, 2, 1, 9, 7, (1, 4, 8)), (10, 2, 2, 5, 3, (1, 4, 8)), (12, 2, 2, 5, 3, (2, 5, 3)), (12, 2, 3, 6, 2, (2, 5, 3))]
