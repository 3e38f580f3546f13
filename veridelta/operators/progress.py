"""Long jobs that report their progress and can be cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def followed(spark: SparkSession, stage: str, job: Callable[[], object], progress: Callable[[dict], None] | None, every: float = 0.1) -> object:
    """job()'s result. The job runs under a job group of its own while progress gets {stage, completed, total} in tasks,
    of the stages known so far; an exception that progress raises cancels the group and is raised here."""
    if progress is None:
        return job()
    context, group, found = spark.sparkContext, f"veridelta-{uuid.uuid4().hex}", {}

    def run() -> None:
        context.setJobGroup(group, stage, interruptOnCancel=True)
        try:
            found["result"] = job()
        except BaseException as e:  # handed to the caller's thread
            found["error"] = e

    def seen() -> tuple[int, int]:
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        stages = [tracker.getStageInfo(s) for s in {s for j in jobs if j for s in j.stageIds}]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    worker, last = threading.Thread(target=inheritable_thread_target(spark)(run), daemon=True), None
    progress({"stage": stage, "completed": 0, "total": 0})
    worker.start()
    try:
        while worker.is_alive():
            worker.join(every)
            if (now := seen()) != last and now[1]:
                last = now
                progress({"stage": stage, "completed": now[0], "total": now[1]})
    except BaseException:
        context.cancelJobGroup(group)
        worker.join()
        raise
    if "error" in found:
        raise found["error"]
    done = max(seen()[1], 1)
    progress({"stage": stage, "completed": done, "total": done})
    return found["result"]
