"""What a query shuffles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def shuffled_rows(df: DataFrame) -> int:
    """Rows that the stages of a run of df, all of whose columns count, write for their exchanges."""
    sc, group = df.sparkSession.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    done = [s for s in stages if tracker.getStageInfo(s) is not None]
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in done)
