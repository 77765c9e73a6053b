"""Quota admission in slices of time, against the rule taken one request at a time."""

import random
from collections import deque

import pytest

from weftline.operators import scheduling
from weftline.operators.scheduling import DAY, MINUTE, Quota


def one_by_one(rows, quota):
    """(order, admitted) of a bucket's requests (at, order, tokens)."""
    recent, day, today, out = deque(), None, 0, {}
    for at, order, tokens in sorted(rows):
        while recent and recent[0][0] < at - MINUTE:
            recent.popleft()
        if at // DAY != day:
            day, today = at // DAY, 0
        ok = not (
            quota.requests_per_minute is not None and len(recent) >= quota.requests_per_minute
            or quota.tokens_per_minute is not None and sum(n for _, n in recent) + tokens > quota.tokens_per_minute
            or quota.requests_per_day is not None and today >= quota.requests_per_day
        )
        if ok:
            recent.append((at, tokens))
            today += 1
        out[order] = ok
    return out


@pytest.mark.parametrize("quota, gap", [(Quota(3, None, None), 7), (Quota(2, 60, 40), 25), (Quota(None, 100, None), 9), (Quota(5, None, 30), 40), (Quota(None, None, 10), 500), (Quota(), 30), (Quota(1, None, 400), 31)])
def test_slices_equal_the_rule(spark, quota, gap):
    draw, rows = random.Random(gap), []
    for b in ("hot", "cold", None):
        at = DAY - 3600_000_000
        for _ in range(500 if b == "hot" else 60):
            at += draw.choice([0, 1, draw.randrange(2 * gap * 1_000_000)])
            rows.append((b, at, len(rows), draw.randrange(1, 40)))
    rows.append(("hot", None, len(rows), 1))
    frame = spark.createDataFrame(rows, "b string, t long, k long, n long").selectExpr("b", "timestamp_micros(t) as ts", "k", "n")
    found = {r.order: r.admitted for r in scheduling.admitted(frame, "b", "ts", "n", "k", quota, slice_seconds=120).collect()}
    want = {k: v for b in ("hot", "cold", None) for k, v in one_by_one([(t, k, n) for x, t, k, n in rows if x == b and t is not None], quota).items()}
    assert found == want | {len(rows) - 1: False}


def test_one_bucket_is_many_groups(spark):
    rows = [("b", i * 5_000_000, i, 1) for i in range(2000)]
    frame = spark.createDataFrame(rows, "b string, t long, k long, n long").selectExpr("b", "timestamp_micros(t) as ts", "k", "n")
    found = scheduling.admitted(frame, "b", "ts", "n", "k", Quota(4, None, None), slice_seconds=600)
    assert found.filter("admitted").count() == sum(one_by_one([(t, k, n) for _, t, k, n in rows], Quota(4, None, None)).values())
    # No task has the bucket: it is dealt by bucket and slice.
    assert "hashpartitioning(bucket" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "slice" in plan.split("hashpartitioning(bucket")[1][:40]
    with pytest.raises(ValueError):
        scheduling.admitted(frame, "b", "ts", "n", "k", Quota(), slice_seconds=7)
