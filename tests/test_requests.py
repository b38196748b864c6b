"""Requests as a stream over a fake transport: retries, rates, errors, and a restart in the middle."""

import sys
from collections import Counter

from pyspark import cloudpickle

from tidemill.sources import fetch, requests
from tidemill.sources.requests import Request


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Python workers do not find the tests' folder


def connect():
    """Statuses of the attempts stand in the url: fake:200,403/n."""
    made = Counter()

    def get(url, headers, timeout):
        statuses = url.split(":")[1].split("/")[0].split(",")
        status = statuses[min(made[url], len(statuses) - 1)]
        made[url] += 1
        if status == "x":
            made[url] = made[url] % len(statuses)
            raise TimeoutError("no answer")
        if int(status) == 200 or made[url] >= 3:
            n, made[url] = made[url], 0
            return fetch.Answer(int(status), f"{url} {n} {timeout} {headers.get('Cookie', '')}".encode())
        return fetch.Answer(int(status), b"")

    return get


def quiet(seconds):
    pass


def plan(n):
    forms = ("200", "403,200", "500,429,200", "404", "x", "418,412,403")
    return [Request(f"k{i}", "weibo" if i % 3 else "news", 0, i, f"fake:{forms[i % len(forms)]}/{i}", "search" if i % 5 == 4 else "default") for i in range(n)]


def want(requests_):
    out = {}
    for r in requests_:
        statuses, most = r.url.split(":")[1].split("/")[0].split(","), fetch.RETRIES[r.kind] + 1
        tried = [statuses[min(i, len(statuses) - 1)] for i in range(most)]
        out[r.page] = next((i for i, s in enumerate(tried) if s == "200"), None)
    return out


def rows(df):
    return {r["page"]: (r["payload"], r["error"]) for r in df.collect()}


def test_a_request_is_tried_again_and_never_raises():
    for r in plan(30):
        row, used = requests.answer(r, connect(), quiet, {"WEIBO_COOKIE": "c=1"}), want([r])[r.page]
        assert (row[4] is None) == (used is None) and (row[5] is not None) == (used is None)
        if used is not None:
            assert row[4] == f"{r.url} {used + 1} 15 {'c=1' if r.platform == 'weibo' else ''}"


def test_buckets_admit_at_each_platforms_rate():
    now = [100.0]
    reader = requests.source(plan(30), connect, rate={"news": 1.0, "weibo": 3.0}, burst=3, clock=lambda: now[0])({}).streamReader(None)
    assert reader.latestOffset() == {"news": 3, "weibo": 3} and reader.latestOffset() == {"news": 3, "weibo": 3}
    now[0] += 1.0
    assert reader.latestOffset() == {"news": 4, "weibo": 6}
    now[0] += 1000
    assert reader.latestOffset() == {"news": 7, "weibo": 9}
    got = reader.partitions({"news": 1, "weibo": 0}, {"news": 3, "weibo": 1})
    assert [p.request.page for p in got] == [3, 6, 1]
    again = requests.source(plan(30), connect, burst=1, clock=lambda: now[0])({}).streamReader(None)
    again.partitions({"news": 0, "weibo": 0}, {"news": 9, "weibo": 20})
    assert again.latestOffset() == {"news": 10, "weibo": 20}  # goes on from the checkpoint


def test_a_restart_in_the_middle_gives_the_same_answers(spark, tmp_path):
    asked, how = plan(24), {"connect": connect, "sleep": quiet, "rate": 1000.0, "every": "0 seconds"}
    first = requests.fetch_plan(spark, asked, str(tmp_path / "a"), str(tmp_path / "c"), longest=0.1, burst=3, **how)
    done = requests.fetch_plan(spark, asked, str(tmp_path / "a"), str(tmp_path / "c"), longest=120, burst=5, **how)
    found = requests.stored(spark, str(tmp_path / "a"))
    assert done and not (first and done is None) and found.count() == 24
    assert {p: a[0] is not None for p, a in rows(found).items()} == {p: u is not None for p, u in want(asked).items()}


def test_a_large_plan_does_not_travel_with_its_tasks():
    reader = requests.source(plan(3000), connect, rate=1e6, burst=200, clock=lambda: 0.0)({}).streamReader(None)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert sorted(r.page for p in parts for r in p.requests) == sorted([3 * i for i in range(200)] + [i for i in range(300) if i % 3])
    assert len(parts) <= requests.TASKS and len(cloudpickle.dumps(reader)) < 20_000


def test_a_large_plan_does_not_travel_with_its_data_source():
    """Spark pickles the data source into the read function of every task."""
    kind = requests.source(plan(3000), connect, rate=1e6, burst=200, clock=lambda: 0.0)
    assert len(cloudpickle.dumps(kind({}))) < 20_000


def test_a_plan_is_read_by_ranges(tmp_path):
    asked = plan(20_000)
    stored = requests.Plan.written(iter(asked), str(tmp_path))
    by_platform = {p: [r for r in asked if r.platform == p] for p in ("news", "weibo")}
    assert stored.counts == {p: len(rs) for p, rs in by_platform.items()}
    for p, rs in by_platform.items():
        for start, end in ((0, 0), (0, 1), (4095, 4097), (4096, 8192), (5000, len(rs) + 9), (9, 5), (0, len(rs))):
            assert [Request(**r) for r in stored.part(p, start, end).to_pylist()] == rs[start:end]


def test_micro_batches_ahead_keep_each_platforms_rate():
    now, rate, burst = [100.0], {"news": 1.0, "weibo": 3.0}, 3
    reader = requests.source(plan(3000), connect, rate=rate, burst=burst, clock=lambda: now[0], ahead=10.0)({}).streamReader(None)
    end, due = reader.initialOffset(), {p: [] for p in rate}
    for spent in (5.0, 0.5, 20.0, 5.0, 5.0):
        start, end = end, reader.latestOffset()
        now[0] += 0.25
        for part in reader.partitions(start, end):
            assert part.due == sorted(part.due) and len(part.due) == len(part.requests)
            for r, at in zip(part.requests, part.due):
                due[r.platform].append(at)
        now[0] += spent
    assert end["news"] > 5 * burst and end["weibo"] > 50  # more than the bursts of five micro-batches
    for p, times in due.items():
        times.sort()
        assert len(times) == end[p] and times[-1] <= now[0] + 10
        for i, a in enumerate(times):
            assert all(j - i + 1 <= burst + rate[p] * (b - a) + 1e-6 for j, b in enumerate(times[i:], i))
