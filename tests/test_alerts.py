"""Alerts at their limits: how much, how long, and what ends a run; in batch and as a stream."""

import datetime as dt

import pytest

from callscope import streaming

START = dt.datetime(2024, 1, 1, 10)
SCHEMA = "event string, n long, emitted_at timestamp"


def minute(m, s=1):
    return START + dt.timedelta(minutes=m, seconds=s)


def every(event, n, minutes):
    return [(event, n, minute(m)) for m in minutes]


#: Events, and the alerts that they fire as (alert, minute since, minute fired).
CASES = {
    "shed at once": ([("dropped_final", 1, minute(3))], [("final_segments_shed", 4, 4)]),
    "rows dropped twice": ([("row_dropped", 1, minute(0)), ("row_dropped", 2, minute(12))], [("rows_dropped", 1, 1), ("rows_dropped", 13, 13)]),
    "rows dropped, one run": ([("row_dropped", 1, minute(0)), ("row_dropped", 2, minute(9))], [("rows_dropped", 1, 1)]),
    "churn long enough": (every("final", 10, range(12)) + every("hold", 6, range(12)), [("hold_churn", 1, 11)]),
    "churn too short": (every("final", 10, range(6)) + every("hold", 6, range(6)) + every("final", 100, range(6, 12)), []),
    "churn at its limit": (every("final", 10, range(20)) + every("hold", 5, range(20)), []),
    "lag at its limit": (every("lag", 5000, range(20)), []),
    "lag for five minutes": (every("lag", 5001, range(6)) + [("lag", 10, minute(6))], [("consumer_lag", 1, 6)]),
    "lag for four minutes": (every("lag", 5001, range(5)) + [("lag", 10, minute(5))], []),
    "one peak of lag lasts as long as nothing newer is known, and then it is gone": ([("lag", 9000, minute(0))], []),
    "a tenth of summaries fails": (every("summary", 10, range(30)) + every("summary_failed", 1, range(30)), []),
    "more than a tenth fails": (every("summary", 10, range(30)) + every("summary_failed", 2, range(30)), [("summaries_failing", 1, 11)]),
    "nothing redacted": (every("segment", 7, range(40)), [("redaction_collapsed", 13, 28)]),
    "nothing redacted, little said": (every("segment", 6, range(40)), []),
    "redacted now and then": (every("segment", 7, range(60)) + every("redaction", 1, range(5, 60, 14)), []),
}


@pytest.fixture(scope="module")
def fired(spark):
    return {case: spark.createDataFrame(events, SCHEMA) for case, (events, _) in CASES.items()}


@pytest.mark.parametrize("case", CASES)
def test_limits(fired, case):
    got = sorted((r.alert, r.since, r.fired_at) for r in streaming.ops_alerts(fired[case]).collect())
    assert got == sorted((alert, minute(a, 0), minute(b, 0)) for alert, a, b in CASES[case][1])


def test_stream_fires_as_the_batch_does(spark, tmp_path):
    events = [e for name in ("churn long enough", "lag for five minutes", "nothing redacted") for e in CASES[name][0]]
    for part in (events[::2], events[1::2], [("tick", 1, minute(200))], [("tick", 1, minute(201))]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = streaming.ops_alerts(stream, late="2 hours").writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted(map(tuple, spark.table("fired").collect()))
    want = sorted(tuple(r) for r in streaming.ops_alerts(spark.createDataFrame(events, SCHEMA)).collect())
    assert got == want and len(got) == 3


def test_latency(spark):
    slow = [(2500.0, minute(m)) for m in range(10)]
    rows = lambda values: spark.createDataFrame(values, "duration_ms double, emitted_at timestamp")
    (one,) = streaming.latency_alerts(rows(slow)).collect()
    assert (one.since, one.fired_at, one.value) == (minute(1, 0), minute(4, 0), 2500.0)
    assert streaming.latency_alerts(rows([(2000.0, minute(m)) for m in range(10)])).count() == 0
    assert streaming.latency_alerts(rows(slow[:1]).limit(0)).count() == 0
