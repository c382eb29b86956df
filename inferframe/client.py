"""The one stage that leaves Spark: requests go to model servers over HTTP, with routing, retries and health."""

from __future__ import annotations

import heapq
import http.client
import itertools
import json
import queue
import ssl
import threading
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Generator, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adapters import Adapter, OpenAIAdapter
from .functions import cost
from .functions.messages import with_system
from .operators.routing import Policy, Router, Server

TRIES = "attempt int, server string, ok boolean, error_type string, error string, latency_ms double, backoff_s double, cost double"
_TRY = pa.struct([("attempt", pa.int32()), ("server", pa.string()), ("ok", pa.bool_()), ("error_type", pa.string()), ("error", pa.string()), ("latency_ms", pa.float64()), ("backoff_s", pa.float64()), ("cost", pa.float64())])
ANSWER = f"request_id string, model_output string, error string, attempts array<struct<{TRIES.replace(', ', ',').replace(' ', ':')}>>"
CARRIED = "additional_data string, source_file string, source_dir string, line_num bigint, item_idx int"


@dataclass(frozen=True)
class ClientSettings:
    """concurrency counts requests in flight in one task; one that waits for its next try isn't in flight. The limits of the policy hold for a task, too.

    prefetch: requests that are read ahead of those in flight, or wait for their next try; batch and flush: rows, and seconds without a further answer, after which answers go on to
    the sink's side; connections and keepalive: open and idle connections of a task.
    """

    concurrency: int = 10
    max_retries: int = 3
    retry_delay: float = 1.0
    timeout: float = 120.0
    max_failures: int = 5
    health_interval: float = 30.0
    health_timeout: float = 5.0
    policy: Policy = field(default_factory=Policy)
    health_workers: int = 32
    prefetch: int = 100
    batch: int = 100
    flush: float = 0.1
    connections: int = 4096
    keepalive: int = 1000


class Connections:
    """HTTP/1.1 connections of one task, kept open and shared by its threads: at most `most` open at once, at most `idle` of them kept."""

    def __init__(self, most: int = 4096, idle: int = 1000):
        self.most, self.idle = max(1, most), max(0, idle)
        self.slots, self.lock, self.free = threading.BoundedSemaphore(self.most), threading.Lock(), {}
        self.kept = self.opened = 0

    def _take(self, key: tuple[str, str], timeout: float) -> tuple[http.client.HTTPConnection, bool]:
        with self.lock:
            if own := self.free.get(key):
                self.kept -= 1
                c = own.pop()
                if c.sock is not None:
                    c.sock.settimeout(timeout)
                return c, True
            self.opened += 1
        if key[0] == "https":
            return http.client.HTTPSConnection(key[1], timeout=timeout, context=ssl.create_default_context()), False
        return http.client.HTTPConnection(key[1], timeout=timeout), False

    def _give(self, key: tuple[str, str], c: http.client.HTTPConnection) -> None:
        with self.lock:
            if self.kept < self.idle:
                self.free.setdefault(key, []).append(c)
                self.kept += 1
                return
        c.close()

    def post(self, url: str, body: bytes, timeout: float, headers: tuple[tuple[str, str], ...] = ()) -> dict:
        """One POST of JSON; any status that isn't a success is an error. A kept connection that the server has closed meanwhile is replaced."""
        u = urllib.parse.urlsplit(url)
        key, target = (u.scheme, u.netloc), urllib.parse.urlunsplit(("", "", u.path or "/", u.query, ""))
        with self.slots:
            while True:
                c, used = self._take(key, timeout)
                try:
                    c.request("POST", target, body, {"Content-Type": "application/json", **dict(headers)})
                    r = c.getresponse()
                    got = r.read()
                except (http.client.RemoteDisconnected, ConnectionResetError, BrokenPipeError):
                    c.close()
                    if used:
                        continue
                    raise
                except BaseException:
                    c.close()
                    raise
                if r.will_close:
                    c.close()
                else:
                    self._give(key, c)
                if not 200 <= r.status < 300:
                    raise OSError(f"HTTP Error {r.status}: {r.reason}")
                return json.loads(got or b"{}")

    def close(self) -> None:
        with self.lock:
            for own in self.free.values():
                for c in own:
                    c.close()
            self.free.clear()
            self.kept = 0


def post(url: str, body: bytes, timeout: float, headers: tuple[tuple[str, str], ...] = ()) -> dict:
    """One POST of JSON; any status that isn't a success is an error."""
    request = urllib.request.Request(url, body, {"Content-Type": "application/json", **dict(headers)})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.loads(r.read() or b"{}")


def probe(url: str, timeout: float = 5.0) -> bool:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.status == 200
    except (OSError, ValueError):
        return False


#: What this process knows of servers: when each health URL was probed last, and how it answered. Tasks that follow each other in a worker share it.
_probes: dict[str, tuple[float, bool]] = {}


def probed(url: str, timeout: float, fresh: float) -> bool:
    """The answer of a probe, or that of the last one if it isn't older than fresh seconds."""
    known = _probes.get(url)
    if known is None or time.monotonic() - known[0] >= fresh:
        known = _probes[url] = (time.monotonic(), probe(url, timeout))
    return known[1]


def check_all(servers: list[Server], adapter: Adapter, max_failures: int = 5, timeout: float = 5.0, workers: int = 32, fresh: float = 0.0) -> list[str]:
    """Probe all servers at once; names of those whose state changed. Answers younger than fresh seconds aren't asked for again."""
    with ThreadPoolExecutor(min(workers, max(1, len(servers)))) as pool:
        results = list(pool.map(lambda s: probed(adapter.health_url(s.url), timeout, fresh), servers))
    return [s.name for s, ok in zip(servers, results, strict=True) if s.probed(ok, max_failures)]


class Session:
    """Requests of one task: a router behind a lock, and a thread that probes servers if an interval is set."""

    def __init__(self, servers: list[tuple[str, str]], settings: ClientSettings, adapter: Adapter, send: Callable[..., dict] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.connections = Connections(settings.connections, settings.keepalive)
        self.settings, self.adapter, self.send, self.sleep = settings, adapter, send or self.connections.post, sleep
        self.router, self.lock, self.stopped = Router([Server(n, u) for n, u in servers], settings.policy), threading.Lock(), threading.Event()
        if settings.health_interval > 0 and servers:
            check_all(self.router.servers, adapter, settings.max_failures, settings.health_timeout, settings.health_workers, settings.health_interval)
            threading.Thread(target=self._watch, daemon=True).start()

    def _watch(self) -> None:
        while not self.stopped.wait(self.settings.health_interval):
            if check_all(self.router.servers, self.adapter, self.settings.max_failures, self.settings.health_timeout, self.settings.health_workers):
                with self.lock:
                    self.router.changed()

    def ask(self, body: str, amount: float) -> tuple[str | None, str | None, list[dict]]:
        """The end of tries(), after its waits."""
        steps = self.tries(body, amount)
        while True:
            try:
                self.sleep(next(steps))
            except StopIteration as e:
                return e.value

    def tries(self, body: str, amount: float) -> Generator[float, None, tuple[str | None, str | None, list[dict]]]:
        """(answer as JSON, error, tries): up to max_retries + 1 tries, each at a server not tried before while there is one. Yields the seconds to wait between them."""
        s, tried, log, wait = self.settings, set(), [], 0.0
        error = None
        for attempt in range(s.max_retries + 1):
            with self.lock:
                server = self.router.pick(tried)
                if server is not None:
                    server.dispatched(amount)
            if server is None:
                return None, error or "no server available", log
            began, answer, kind = time.monotonic(), None, None
            try:
                got = self.send(self.adapter.chat_url(server.url), body.encode(), s.timeout, getattr(self.adapter, "headers", ()))
                answer = json.dumps(self.adapter.parse(got) if got else {}, ensure_ascii=False, separators=(",", ":"))
            except Exception as e:  # any failure of a try is a reason to try elsewhere
                kind, error = type(e).__name__, str(e)
            with self.lock:
                server.finished(answer is not None, amount)
            last = attempt == s.max_retries or answer is not None
            wait = 0.0 if last else s.retry_delay * 2**attempt
            log.append({"attempt": attempt, "server": server.name, "ok": answer is not None, "error_type": kind, "error": None if answer is not None else error, "latency_ms": (time.monotonic() - began) * 1000, "backoff_s": wait, "cost": amount})
            if answer is not None:
                return answer, None, log
            tried.add(server.name)
            if not last:
                yield wait
        return None, error, log

    def close(self) -> None:
        self.stopped.set()
        self.connections.close()


@dataclass(frozen=True)
class Later:
    """What work returns in place of a result if it goes on, by then(), after so many seconds."""

    seconds: float
    then: Callable


def _step(steps: Generator) -> object:
    try:
        seconds = next(steps)
    except StopIteration as e:
        return e.value
    return Later(seconds, lambda: _step(steps))


class _Pool:
    """At most n threads for work in the order in which it is due. A wait takes no thread; done gets (item, result, error)."""

    def __init__(self, n: int):
        self.n, self.due, self.changed, self.done = n, [], threading.Condition(), queue.SimpleQueue()
        self.threads, self.idle, self.number, self.first, self.closed = [], 0, itertools.count(), None, False

    def put(self, item: object, work: Callable, after: float = 0.0) -> None:
        with self.changed:
            heapq.heappush(self.due, one := (time.monotonic() + after, next(self.number), item, work))
            if self.idle < len(self.due) and len(self.threads) < self.n and not self.closed:
                self.threads.append(t := threading.Thread(target=self._run, daemon=True))
                t.start()
            elif self.due[0] is one:
                self.first = None
                self.changed.notify()

    def _take(self) -> tuple | None:
        with self.changed:
            self.idle += 1
            try:
                while not self.closed:
                    left = self.due[0][0] - time.monotonic() if self.due else None
                    if left is not None and left <= 0:
                        return heapq.heappop(self.due)
                    if left is None or self.first is not None:
                        self.changed.wait()
                        continue
                    self.first = me = threading.get_ident()  # one thread waits for what is due next
                    self.changed.wait(left)
                    if self.first == me:
                        self.first = None
                return None
            finally:
                self.idle -= 1
                if self.due and self.first is None:
                    self.changed.notify()

    def _run(self) -> None:
        while (one := self._take()) is not None:
            _, _, item, work = one
            try:
                got = work()
            except BaseException as e:  # goes on where results are read
                self.done.put((item, None, e))
                continue
            if isinstance(got, Later):
                self.put(item, got.then, got.seconds)
            else:
                self.done.put((item, got, None))

    def close(self) -> None:
        with self.changed:
            self.closed = True
            self.changed.notify_all()
        for t in self.threads:
            t.join()


def _in_flight(items: Iterator, work: Callable, n: int, prefetch: int = 0, flush: float | None = None) -> Iterator:
    """Results as they come, with n items in work at a time: a slot is filled again as soon as any of them is done, or waits (Later). Up to prefetch more
    items are read ahead or wait. None stands for flush seconds without a result."""
    pool, held, ended = _Pool(n), 0, False
    try:
        while True:
            while not ended and held < n + prefetch:
                try:
                    x = next(items)
                except StopIteration:
                    ended = True
                    break
                pool.put(x, lambda x=x: work(x))
                held += 1
                if held >= n and not pool.done.empty():
                    break  # answers go on before more is read
            if not held:
                return
            try:
                x, got, error = pool.done.get(timeout=flush)
            except queue.Empty:
                yield None
                continue
            held -= 1
            if error is not None:
                raise error
            yield x, got
    finally:
        pool.close()


def infer(requests: DataFrame, servers: list[tuple[str, str]], settings: ClientSettings = ClientSettings(), adapter: Adapter = OpenAIAdapter(), model: str = "default", temperature: float = 0.7, max_tokens: int = 1000, rollout_n: int = 1, system_prompt: str = "", top_p: float = 1.0, frequency_penalty: float = 0.0, presence_penalty: float = 0.0, send: Callable[..., dict] | None = None) -> DataFrame:
    """Answers of model servers to schema.REQUEST rows: schema.RESULT, a row for each request, failed ones with an error.

    servers: (name, base URL) pairs. Payloads and costs are columns, built before the stage; only the exchange itself is
    Python. A task keeps `concurrency` requests in flight over kept connections, and passes answers on in batches, in the order in which they come. Spark may run a task again, so a request can be sent more than once;
    results are made durable by the sink and deduplicated by request_id. Speculation must be off for this stage.
    """
    if rollout_n < 1:
        raise ValueError("rollout_n must be at least 1")
    if rollout_n > 1 and not isinstance(adapter, OpenAIAdapter):
        raise ValueError("several choices need the chat-completion adapter")
    options = {"model": model, "temperature": temperature, "max_tokens": max_tokens, "top_p": top_p, "frequency_penalty": frequency_penalty, "presence_penalty": presence_penalty, "rollout_n": rollout_n}
    said = with_system("messages", system_prompt)
    rows = requests.withColumn("messages", said).select("request_id", adapter.payload(F.col("messages"), options).alias("payload"), cost.runner_cost("dispatch_cost", "messages").alias("amount"), "additional_data", "source_file", "source_dir", "line_num", "item_idx")

    def run(batches):
        session = Session(servers, settings, adapter, send)
        try:
            def each():
                for b in batches:
                    for r in b.to_pylist():
                        yield r

            held = []
            for got in _in_flight(each(), lambda r: _step(session.tries(r["payload"], r["amount"])), settings.concurrency, settings.prefetch, settings.flush):
                if got is not None:
                    held.append((got[0], *got[1]))
                if held and (got is None or len(held) >= settings.batch):
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)
        finally:
            session.close()

    return rows.mapInArrow(run, f"{ANSWER}, {CARRIED}")


def _batch(held: list) -> pa.RecordBatch:
    r = [x[0] for x in held]
    cols = [pa.array([x["request_id"] for x in r], pa.string()), pa.array([x[1] for x in held], pa.string()), pa.array([x[2] for x in held], pa.string()), pa.array([x[3] for x in held], pa.list_(_TRY))]
    for name, kind in (("additional_data", pa.string()), ("source_file", pa.string()), ("source_dir", pa.string()), ("line_num", pa.int64()), ("item_idx", pa.int32())):
        cols.append(pa.array([x[name] for x in r], kind))
    return pa.RecordBatch.from_arrays(cols, ["request_id", "model_output", "error", "attempts", "additional_data", "source_file", "source_dir", "line_num", "item_idx"])


def attempt_log(results: DataFrame) -> DataFrame:
    """A row for each try of each request."""
    return results.select("request_id", F.explode("attempts").alias("a")).select("request_id", "a.*")
