"""Policies on live counters and on snapshots, health and retries."""

import random

import pytest
from pyspark.sql import functions as F

from inferframe.operators import chunks, health, retry, routing
from inferframe.operators.routing import Policy, Router, Server


def pool(n, **each):
    return [Server(f"server_{i + 1}", **{k: v[i] for k, v in each.items()}) for i in range(n)]


def picks(servers, n=1, excluded=(), **policy):
    r = Router(servers, Policy(**policy))
    return [s and s.name[-1] for s in (r.pick(set(excluded)) for _ in range(n))]


def test_round_robin():
    assert picks(pool(3), 4) == ["1", "2", "3", "1"]


def test_least_connections():
    assert picks(pool(3, active=[2, 1, 0]), strategy="least_connections") == ["3"]


def test_adaptive():
    p = {"strategy": "adaptive_round_robin", "max_active": 10}
    assert picks(pool(2, active=[15, 0]), **p) == ["2"]
    assert picks(pool(2, active=[20, 15]), **p) == ["2"]
    assert picks(pool(3, success=[2, 10, 10], error=[10, 0, 0]), threshold=0.7, window=5, **p) == ["2"]
    assert picks(pool(3), 6, **p) == ["1", "2", "3"] * 2


def test_load_aware():
    p = {"strategy": "load_aware_round_robin"}
    assert picks(pool(3), 6, **p) == ["1", "2", "3"] * 2
    many = [Server(f"server_{i}", active=80 if i == 0 else 20) for i in range(200)]
    assert Router(many, Policy("load_aware_round_robin", max_active=512)).pick().name == "server_1"
    assert picks(pool(2, success=[0, 10], error=[10, 0]), **p) == ["2"]
    assert picks(pool(2, active=[60, 70]), max_active=50, **p) == ["1"]


def test_power_of_two_choices():
    servers = pool(3, inflight=[512.0, 8.0, 64.0], active=[4, 1, 2])

    class First(random.Random):
        def sample(self, population, k, **_):
            return list(population)[:k]

    assert Router(servers, Policy("p2c_cost_aware"), rng=First()).pick().name == "server_2"


def test_exclusion_fallback_and_health():
    assert picks(pool(2), excluded={"server_1"}) == ["2"]
    assert picks(pool(2), excluded={"server_1", "server_2"}) == ["1"]
    assert picks(pool(2, healthy=[True, False]), 3) == ["1"] * 3
    assert picks(pool(1, healthy=[False])) == [None]
    assert picks(pool(1, healthy=[False]), allow_fallback=True) == ["1"]
    assert Router([]).pick() is None
    with pytest.raises(ValueError):
        Policy("fastest")


def test_update_and_stats():
    r = Router(pool(2))
    r.pick()
    r.update(pool(3))
    assert r.turn == 0
    s = Router(pool(2, healthy=[True, False])).stats()
    assert (s["total_servers"], s["healthy_servers"], s["unhealthy_servers"]) == (2, 1, 1)


def test_probes():
    s = Server("a")
    assert [s.probed(ok, 2) for ok in (False, False, False, True)] == [False, True, False, True] and s.healthy


def test_counters():
    s = Server("a")
    s.dispatched(40), s.dispatched(0.5)
    assert (s.active, s.inflight) == (2, 41.0)
    s.finished(True, 40), s.finished(False, 0.5), s.finished(False, 3)
    assert (s.active, s.inflight, s.success, s.error) == (0, 0.0, 1, 2)


@pytest.mark.parametrize("strategy", [s for s in routing.STRATEGIES if s not in ("random", "p2c_cost_aware")])
def test_snapshots_agree_with_live_counters(spark, strategy):
    rng = random.Random(7)
    snaps, want = [], {}
    p = Policy(strategy, threshold=0.8, window=4, max_active=6)
    for k in range(60):
        n, start = rng.randint(1, 7), rng.randint(0, 9)
        servers = [Server(f"s{i}", active=rng.randint(0, 9), inflight=float(rng.randint(0, 12)), success=rng.randint(0, 9), error=rng.randint(0, 6)) for i in range(n)]
        r = Router(servers, p, turn=start % n)
        want[k] = r.pick().name
        snaps += [(k, start % n, s.name, i, s.active, s.inflight, s.success, s.error) for i, s in enumerate(servers)]
    df = spark.createDataFrame(snaps, "k int, start int, server string, pos int, active long, inflight_cost double, success long, error long")
    got = {r["k"]: r["server"] for r in routing.route(df, ["k"], p, "start").collect()}
    assert got == want


def test_sampled_choice_agrees_with_live_counters(spark):
    rng, snaps, want = random.Random(3), [], {}
    p = Policy("p2c_cost_aware", threshold=0.8, window=4, max_active=6, max_cost=10)
    for k in range(60):
        servers = [Server(f"s{i}", active=rng.randint(0, 9), inflight=float(rng.randint(0, 12)), success=rng.randint(0, 9), error=rng.randint(0, 6)) for i in range(2)]
        want[k] = Router(servers, p).pick().name
        snaps += [(k, s.name, i, s.active, s.inflight, s.success, s.error) for i, s in enumerate(servers)]
    df = spark.createDataFrame(snaps, "k int, server string, pos int, active long, inflight_cost double, success long, error long")
    got = {r["k"]: r["server"] for r in routing.route(routing.hash_sample(df, ["k"], 2), ["k"], p, sampled="sampled").collect()}
    assert got == want


def test_hash_sample_takes_k_servers(spark):
    df = spark.sql("select a.id as k, explode(sequence(0, 4)) as server from range(50) a")
    s = routing.hash_sample(df, ["k"], 2)
    assert {r["count"] for r in s.where("sampled").groupBy("k").count().collect()} == {2}
    assert s.where("sampled").select("server").distinct().count() == 5


def test_health_log(spark):
    log = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([True, False, False, False, True, False])] + [("b", 0, False)], "s string, t int, ok boolean")
    h = health.health_states(log, "s", ["t"], F.col("ok"), 2)
    assert [(r["streak"], r["healthy"]) for r in h.where("s = 'a'").orderBy("t").collect()] == [(0, True), (1, True), (2, False), (3, False), (0, True), (1, True)]
    assert [(r["t"], r["healthy"]) for r in health.transitions(h.where("s = 'a'")).orderBy("t").collect()] == [(2, False), (4, True)]


@pytest.mark.parametrize("width", [1, 3, 100])
def test_health_and_running_sums_by_buckets(spark, width):
    """Pieces of any width give what one pass over each server gives."""
    rng = random.Random(width)
    rows = [(s, t, rng.random() < 0.4) for s in "ab" for t in range(60)]
    df = spark.createDataFrame(rows, "s string, t int, ok boolean")
    bucket = F.floor(F.col("t") / width)
    got = {(r["s"], r["t"]): r for r in health.health_states(df, "s", ["t"], F.col("ok"), 2, bucket).collect()}
    sums = {(r["s"], r["t"]): r["before"] for r in chunks.running_total(df, "s", bucket, ["t"], F.col("t"), "before").collect()}
    for s in "ab":
        streak, healthy, total = 0, True, 0
        for _, t, ok in (r for r in rows if r[0] == s):
            before, streak = healthy, 0 if ok else streak + 1
            healthy = streak < 2
            assert (got[s, t]["streak"], got[s, t]["healthy"], got[s, t]["healthy_before"]) == (streak, healthy, before)
            assert sums[s, t] == total
            total += t


def test_attempts_stop_at_success_or_limit(spark):
    log = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("a", 2, True), *[("b", i, False) for i in range(6)]], "r string, t int, ok boolean")
    acc = {r["r"]: (r["attempts"], r["retries"], r["succeeded"]) for r in retry.accounting(retry.attempts(log, "r", ["t"], F.col("ok"), 3), "r").collect()}
    assert acc == {"a": (2, 1, True), "b": (4, 3, False)}


def test_random_is_repeatable_and_spread(spark):
    df = spark.sql("select a.id as k, s as server, cast(s as int) as pos, 0L as active, 0.0D as inflight_cost, 0L as success, 0L as error from range(200) a lateral view explode(sequence(0, 3)) t as s")
    got = [tuple(r) for r in routing.route(df, ["k"], Policy("random")).select("k", "server").orderBy("k").collect()]
    assert got == [tuple(r) for r in routing.route(df.repartition(7), ["k"], Policy("random")).select("k", "server").orderBy("k").collect()]
    assert {s for _, s in got} == {0, 1, 2, 3} and len(got) == 200


def test_calls_are_tried_again():
    waits, tries = [], []

    def fn():
        tries.append(1)
        if len(tries) < 4:
            raise ValueError
        return "ok"

    assert retry.call(fn, 3, 1.0, 3.0, 5.0, sleep=waits.append) == "ok" and waits == [1.0, 3.0, 5.0]
    with pytest.raises(ZeroDivisionError):
        retry.call(lambda: 1 // 0, 1, errors=(ZeroDivisionError,), sleep=waits.append)
    with pytest.raises(ZeroDivisionError):
        retry.call(lambda: 1 // 0, 5, errors=(KeyError,), sleep=lambda _: pytest.fail("waited"))


def test_attempts_as_a_context():
    waits, tries = [], []
    for attempt in retry.Attempts(3, 1.0, 3.0, 5.0, sleep=waits.append):
        with attempt:
            tries.append(attempt.number)
            if len(tries) < 3:
                raise ValueError
    assert tries == [0, 1, 2] and waits == [1.0, 3.0]
    with pytest.raises(ZeroDivisionError):
        for attempt in retry.Attempts(1, sleep=waits.append):
            with attempt:
                1 // 0
    with pytest.raises(KeyError):
        for attempt in retry.Attempts(5, errors=(ValueError,), sleep=lambda _: pytest.fail("waited")):
            with attempt:
                raise KeyError


def test_watchers_are_told_of_changed_health():
    told = []
    r = Router([Server("a"), Server("b")], turn=1)
    r.subscribe(lambda servers: 1 / 0)  # an error of a watcher is only logged
    r.subscribe(lambda servers: told.append([s.healthy for s in servers]))
    r.update([Server("a"), Server("b")])
    assert told == [] and r.turn == 1
    r.update([Server("a"), Server("b", healthy=False)])
    assert told == [[True, False]] and r.turn == 0 and [s.name for s in r.healthy()] == ["a"]
