import datetime as dt
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairnspark.operators import traffic


@pytest.fixture(scope="module")
def requests(spark):
    """Requests over July and August 1995: a different number for each day, hosts of unequal weight."""
    rows = []
    for offset in range(62):
        day = dt.datetime(1995, 7, 1) + dt.timedelta(days=offset)
        for i in range((offset * 7) % 13 + 1):
            rows.append((day + dt.timedelta(minutes=i), f"h{i % 3}", f"/e{i % 4}"))
    rows.append((None, "h0", "/e0"))
    return spark.createDataFrame(rows, "time timestamp, host string, endpoint string").cache()


def expected_daily(requests):
    return Counter(r["time"].date() for r in requests.collect() if r["time"])


def test_daily_by_date_and_by_day(requests):
    want = expected_daily(requests)
    got = {r["date"]: r["total_reqs"] for r in traffic.daily_requests(requests).collect() if r["date"]}
    assert got == want
    by_day = {r["day"]: r["total_reqs"] for r in traffic.daily_requests(requests, by="day").collect() if r["day"]}
    merged = Counter()
    for day, n in want.items():
        merged[day.day] += n
    assert by_day == merged
    with pytest.raises(ValueError):
        traffic.daily_requests(requests, by="week")


@pytest.mark.parametrize("parity", [False, True])
def test_weekday_extremes(requests, parity):
    by_weekday = defaultdict(list)
    for day, n in expected_daily(requests).items():
        if not parity or day.day <= 28:
            by_weekday[day.isoweekday()].append(n)
    daily = traffic.daily_requests(requests)
    got = {r["weekday"]: (r["min_reqs"], r["max_reqs"]) for r in traffic.weekday_extremes(daily, parity).collect()}
    assert got == {w: (min(v), max(v)) for w, v in by_weekday.items()}


def test_weekday_numbers_are_real_weekdays(spark):
    daily = spark.sql("select date'1995-07-01' as date, 1L as total_reqs")
    assert traffic.number_weekdays(daily).first()["weekday"] == 6


def test_extremes_long(requests):
    rows = traffic.extremes_long(traffic.weekday_extremes(traffic.daily_requests(requests))).collect()
    assert len(rows) == 14 and {r["stat"] for r in rows} == {"min", "max"}


def test_one_scan_for_the_weekday_extremes(spark, requests, tmp_path):
    path = str(tmp_path / "log")
    requests.write.parquet(path)
    plan = traffic.weekday_extremes(traffic.daily_requests(spark.read.parquet(path)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Window" not in text
    assert "ReadSchema: struct<time:timestamp>" in text


def test_requests_per_host_and_share(requests):
    dated = requests.where(F.col("time").isNotNull())
    exact = {r["date"]: r for r in traffic.requests_per_host(dated).collect()}
    for day, n in expected_daily(requests).items():
        hosts = min(n, 3)
        assert (exact[day]["total_reqs"], exact[day]["total_hosts"]) == (n, hosts)
        assert exact[day]["avg_reqs"] == pytest.approx(n / hosts)
    rough = traffic.requests_per_host(dated, rsd=0.01).collect()
    assert {r["date"]: r["total_hosts"] for r in rough} == {d: r["total_hosts"] for d, r in exact.items()}
    share = {r["zero"]: r["total_reqs"] for r in traffic.bool_share(dated, F.col("endpoint") == "/e0", "zero").collect()}
    assert sum(share.values()) == dated.count()
