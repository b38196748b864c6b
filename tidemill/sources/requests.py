"""Requests as a stream: a plan of requests is admitted at each platform's rate, and each answer becomes a row.

The offset says how many requests of each platform have been admitted, in the plan's order. latestOffset() is the
rate limiter: a bucket per platform gains `rate` requests a second up to `burst`, so a platform is asked no faster
however many tasks a cluster runs, and platforms do not wait for each other. With `ahead`, a micro-batch also admits
what its bucket gains while it runs, taken to be as long as the one before; each request has the time from which its
bucket allows it, and its task waits for that (the clocks of the machines are taken to agree). So the pause between
micro-batches costs no rate, and no request begins before its time; one whose task is late begins later, and further
attempts at it count for no bucket.

A micro-batch deals its requests to at most TASKS partitions, each of which makes its own one after the other:
attempts, pauses between them, headers and the platform's cookie are safe_get()'s, over one session per Python worker.
An answer that never came is a row with its error.

Spark sends the data source with every task. So the plan lies in files of the driver's, which its planner maps into
memory; tasks get the requests of their partition and nothing else of the plan.

Offsets and rows go through the checkpoint: after a restart the requests that were admitted and not written are
made again and no others. Transport, clock and sleep are parameters, so tests need no network."""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import shutil
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import fetch

SCHEMA = "keyword string, platform string, step int, page int, payload string, error string"
#: Requests a second of each platform: one in the mean pause between two.
RATE = 2 / (fetch.LEAST_DELAY + fetch.MOST_DELAY)

#: Partitions of a micro-batch at most; with fewer requests each has one of its own.
TASKS = 48

#: Requests of a micro-batch at most, beyond a single one of each platform: they pass through the driver, and are what a failure makes again.
MOST = 100_000

#: Seconds that a micro-batch of fetch_plan() admits ahead at most.
AHEAD = 10.0


class Request(NamedTuple):
    keyword: str
    platform: str
    step: int
    page: int
    url: str
    kind: str = "default"
    """Of its timeout and retries: default, search, article, ..."""


class Plan(NamedTuple):
    """A plan in a folder of the driver's own: an Arrow file a platform, in batches of CHUNK requests."""

    folder: str
    counts: dict[str, int]
    """Of requests, by platform."""

    CHUNK = 4096
    FIELDS = pa.schema([("keyword", pa.string()), ("platform", pa.string()), ("step", pa.int64()), ("page", pa.int64()), ("url", pa.string()), ("kind", pa.string())])

    @classmethod
    def written(cls, plan: Iterable[Request], folder: str) -> Plan:
        waiting: dict[str, list[Request]] = {}
        counts: dict[str, int] = {}
        with contextlib.ExitStack() as files:
            out: dict[str, pa.RecordBatchFileWriter] = {}

            def flush(platform: str) -> None:
                out[platform].write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*waiting[platform]), cls.FIELDS)], schema=cls.FIELDS))
                waiting[platform] = []

            for request in map(Request._make, plan):
                platform = request.platform
                if platform not in out:
                    out[platform] = files.enter_context(pa.ipc.new_file(f"{folder}/{len(out)}.arrow", cls.FIELDS))
                    waiting[platform], counts[platform] = [], 0
                waiting[platform].append(request)
                counts[platform] += 1
                if len(waiting[platform]) == cls.CHUNK:
                    flush(platform)
            for platform in out:
                if waiting[platform]:
                    flush(platform)
        return cls(folder, counts)

    def part(self, platform: str, start: int, end: int) -> pa.Table:
        """A platform's requests from start up to end, in the plan's order."""
        end, found = min(end, self.counts[platform]), []
        if start < end:
            batches = pa.ipc.open_file(pa.memory_map(f"{self.folder}/{list(self.counts).index(platform)}.arrow"))
            for i in range(start // self.CHUNK, (end - 1) // self.CHUNK + 1):
                first = i * self.CHUNK
                low, high = max(start - first, 0), min(end - first, self.CHUNK)
                found.append(batches.get_batch(i).slice(low, high - low))
        return pa.Table.from_batches(found, self.FIELDS)


@contextlib.contextmanager
def kept(plan: Iterable[Request]) -> Iterator[Plan]:
    """The plan, in a folder that is there inside."""
    with tempfile.TemporaryDirectory(prefix="tidemill-plan-") as folder:
        yield Plan.written(plan, folder)


class _Admitted(InputPartition):
    def __init__(self, asked: pa.Table, due: np.ndarray) -> None:
        """asked: requests, and due: the times from which they are allowed. Both travel as bytes, which tasks read."""
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, asked.schema) as stream:
            stream.write_table(asked)
        self.asked, self.times = out.getvalue().to_pybytes(), due.tobytes()

    @property
    def requests(self) -> list[Request]:
        return list(map(Request._make, zip(*(c.to_pylist() for c in pa.ipc.open_stream(self.asked).read_all().columns))))

    @property
    def due(self) -> list[float]:
        return np.frombuffer(self.times).tolist()

    @property
    def request(self) -> Request:
        """The first one."""
        return self.requests[0]


def urlopen() -> Callable[..., fetch.Answer]:
    """Requests by the standard library, over one opener."""
    opener = urllib.request.build_opener()

    def get(url: str, headers: dict[str, str], timeout: int) -> fetch.Answer:
        try:
            with opener.open(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                return fetch.Answer(r.status, r.read(), r.headers.get_content_charset())
        except urllib.error.HTTPError as e:
            return fetch.Answer(e.code, e.read(), None)

    return get


def answer(request: Request, get: Callable[..., fetch.Answer], sleep: Callable[[float], None], env: dict[str, str]) -> tuple:
    """The row of a request. No failure is raised."""
    from ..plans.spec import credential

    seen: list[str] = []

    def told(url: str, headers: dict[str, str], timeout: int) -> fetch.Answer:
        try:
            got = get(url, headers=headers, timeout=timeout)
        except Exception as e:  # whatever a transport raises is this attempt's failure
            seen.append(f"{type(e).__name__}: {e}")
            raise OSError(str(e)) from e
        seen.append(f"HTTP {got.status}")
        return got

    headers = fetch.request_headers(cookie=credential(request.platform, env) if request.platform in fetch.COOKIES else "")
    got = fetch.safe_get(told, request.url, fetch.Limiter(sleep), headers, fetch.RETRIES.get(request.kind, fetch.RETRIES["default"]), fetch.TIMEOUTS.get(request.kind, fetch.TIMEOUTS["default"]))
    key = (request.keyword, request.platform, request.step, request.page)
    return (*key, None, seen[-1] if seen else "no attempt") if got is None else (*key, got.text(), None)


def source(plan: Iterable[Request] | Plan, connect: Callable[[], Callable[..., fetch.Answer]] = urlopen, rate: float | dict[str, float] = RATE, burst: int = 1, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time, name: str = "requests", ahead: float = 0.0) -> type[DataSource]:
    """A data source over a plan. connect: called once per Python worker, gives the function that makes a request. ahead: seconds that a micro-batch admits ahead at most."""
    if not isinstance(plan, Plan):
        folder = tempfile.mkdtemp(prefix="tidemill-plan-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        plan = Plan.written(plan, folder)
    most = max(1, MOST // max(1, len(plan.counts)))

    def per_second(platform: str) -> float:
        return rate.get(platform, RATE) if isinstance(rate, dict) else rate

    class Reader(DataSourceStreamReader):
        def __init__(self) -> None:
            self.admitted = self.initialOffset()
            # what may be admitted, and what may be made: a request is made after it is admitted
            self.tokens = dict.fromkeys(plan.counts, float(burst))
            self.slots = dict.fromkeys(plan.counts, float(burst))
            self.at = self.dealt = clock()
            self.running = False

        def __getstate__(self) -> dict:
            """For tasks, which read their own partitions' requests."""
            return {}

        def initialOffset(self) -> dict:
            return dict.fromkeys(plan.counts, 0)

        def latestOffset(self) -> dict:
            now = clock()
            spent, self.at = now - self.at, now
            coming = min(spent, ahead) if self.running else 0.0
            self.running = True
            for platform, total in plan.counts.items():
                self.tokens[platform] = min(float(burst), self.tokens[platform] + spent * per_second(platform))
                n = min(int(self.tokens[platform] + coming * per_second(platform)), most, total - self.admitted[platform])
                n = max(n, 0)
                self.tokens[platform] -= n
                self.admitted[platform] += n
            return dict(self.admitted)

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            # after a restart the checkpoint may be ahead of a new reader, which then goes on from there
            self.admitted = {p: max(end.get(p, 0), n) for p, n in self.admitted.items()}
            now = clock()
            passed, self.dealt = now - self.dealt, now
            asked, due = [plan.FIELDS.empty_table()], [np.empty(0)]
            for platform in plan.counts:
                gain = per_second(platform)
                free = min(float(burst), self.slots[platform] + passed * gain)
                asked.append(plan.part(platform, start.get(platform, 0), end.get(platform, 0)))
                late = np.maximum(np.arange(1, len(asked[-1]) + 1) - free, 0.0)
                due.append(now + (late / gain if gain > 0 else 0 * late))
                self.slots[platform] = free - len(asked[-1])
            requests, times = pa.concat_tables(asked), np.concatenate(due)
            order = np.argsort(times, kind="stable")  # so that in a task no platform waits for a slower one
            n = min(TASKS, len(order))
            return [_Admitted(requests.take(order[i::n]), times[order[i::n]]) for i in range(n)]  # a platform's requests go to many partitions

        def read(self, partition: _Admitted):
            get, env = fetch.session(connect), dict(os.environ)
            for request, due in zip(partition.requests, partition.due):
                if (early := due - clock()) > 0:
                    time.sleep(early)
                yield answer(request, get, sleep, env)

        def commit(self, end: dict) -> None:
            pass

    class Requests(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema):
            return Reader()

    return Requests


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The answers that a stream has written, as collect.run() takes them."""
    return spark.read.schema(SCHEMA).parquet(path)


def fetch_plan(spark: SparkSession, plan: Iterable[Request] | Plan, path: str, checkpoint: str, longest: float = float("inf"), every: str = "1 second", ahead: float = AHEAD, **how: Any) -> bool:
    """Makes the plan's requests and writes their answers as a table at path; call again, with the same plan and checkpoint, to go on.

    Ends when all have been made, or after `longest` seconds and a micro-batch; returns whether all have been."""
    if not isinstance(plan, Plan):
        with kept(plan) as plan:
            return fetch_plan(spark, plan, path, checkpoint, longest, every, ahead, **how)
    kind = source(plan, ahead=ahead, **how)
    spark.dataSource.register(kind)
    began, total = time.monotonic(), sum(plan.counts.values())
    query = spark.readStream.format(kind.name()).load().writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        while query.isActive and (query.lastProgress is None or time.monotonic() - began < longest):
            if _ended(query) >= total:
                return True
            query.awaitTermination(1)
        if query.exception() is not None:
            raise query.exception()
        return _ended(query) >= total
    finally:
        query.stop()


def _ended(query) -> int:
    """How many requests the finished micro-batches have covered."""
    last = query.lastProgress
    sources = json.loads(last.json)["sources"] if last else []
    end = sources[0]["endOffset"] if sources else None
    end = json.loads(end) if isinstance(end, str) else end
    return sum(end.values()) if end else 0
