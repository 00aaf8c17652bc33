"""Saving the frames of a job."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from tabulon.sources import write_delimited, write_report

#: Reports that are written at the same time: most are small, so one alone would leave most tasks' places empty.
SIDE_BY_SIDE = 8
POOL = "spark.scheduler.pool"


def write_reports(
    reports: Mapping[str, DataFrame], folder: str, single_file: Collection[str] = (), side_by_side: int = SIDE_BY_SIDE
) -> None:
    """Write each frame below the folder: a CSV folder of its name, or one CSV file for the names in single_file.

    Several are written side by side, each in a scheduler pool of its own, so that a large one does not keep small ones waiting where the
    session schedules fairly (spark.scheduler.mode=FAIR). The first failure is raised when all have ended.
    """
    if not reports:
        return
    spark = next(iter(reports.values())).sparkSession

    def write(name: str) -> None:
        spark.sparkContext.setLocalProperty(POOL, f"report-{name}")
        if name in single_file:
            write_report(reports[name], f"{folder}/{name}.csv")
        else:
            write_delimited(reports[name], f"{folder}/{name}")

    with ThreadPool(max(1, min(side_by_side, len(reports)))) as pool:
        results = [pool.apply_async(inheritable_thread_target(spark)(write), (name,)) for name in reports]
        for result in results:
            result.wait()
        for result in results:
            result.get()
