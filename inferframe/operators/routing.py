"""Choosing a server: each policy as one ordering of candidates, for tables of snapshots and for a client's live counters."""

from __future__ import annotations

import logging
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRATEGIES = ("round_robin", "least_connections", "adaptive_round_robin", "load_aware_round_robin", "p2c_cost_aware", "random")
#: A server whose rate is under this share of the mean may count as underperforming, and a rate never counts as less than the floor (fixed values).
WORSE_THAN_MEAN, RATE_FLOOR = 0.8, 0.1
#: Rates that differ from the bar by rounding only are at the bar, in whatever order the mean was summed.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Policy:
    strategy: str = "round_robin"
    allow_fallback: bool = False
    threshold: float = 0.5
    window: int = 10
    max_active: int = 50
    sample: int = 2
    max_cost: float = 0.0

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}: one of {', '.join(STRATEGIES)}")
        object.__setattr__(self, "sample", max(2, self.sample))


# ---------------------------------------------------------------- expressions


def success_rate(ok: Column, err: Column) -> Column:
    return F.when(ok + err > 0, ok / (ok + err)).otherwise(F.lit(1.0))


def effective_load(active: Column, inflight: Column, rate: Column) -> Column:
    """Active requests or cost in flight, whichever is more, times the reciprocal of the rate, cut to an integer."""
    base = F.greatest(active.cast("bigint"), inflight.cast("bigint"))
    return F.when(rate < 1, (base * (F.lit(1.0) / F.greatest(rate, F.lit(RATE_FLOOR)))).cast("bigint")).otherwise(base)


def cost_score(active: Column, inflight: Column, n: Column, rate: Column, window: int) -> Column:
    base = F.when(inflight > 0, inflight).otherwise(active.cast("double"))
    return base * F.when(n >= window, F.lit(1.0) / F.greatest(rate, F.lit(RATE_FLOOR))).otherwise(F.lit(1.0))


def underperforming(n: Column, rate: Column, mean: Column, p: Policy) -> Column:
    """Enough history, a low rate, and clearly below the mean; never without a mean."""
    return F.coalesce((n >= p.window) & (rate < p.threshold) & (rate < mean * WORSE_THAN_MEAN - ROUNDING), F.lit(False))


def admissible(active: Column, inflight: Column, p: Policy) -> Column:
    out = F.lit(True)
    if p.max_active > 0:
        out = out & (active < p.max_active)
    if p.max_cost > 0:
        out = out & (inflight < p.max_cost)
    return out


def fair_share(least: Column, total: Column, n: Column) -> Column:
    return F.greatest(least + 1, F.ceil((total + 1) / n)).cast("bigint")


# ---------------------------------------------------------------- snapshots


def candidates(servers: DataFrame, by: list[str], allow_fallback: bool = False, excluded: DataFrame | None = None) -> DataFrame:
    """Healthy servers of each snapshot, all if none is healthy and that is allowed; without the excluded ones, unless none would be left."""
    w = W.partitionBy(*by)
    up = F.max(F.col("healthy").cast("int")).over(w)
    df = servers.withColumn("_up", up).where((F.col("_up") == 1) & F.col("healthy") | (F.lit(allow_fallback) & (F.col("_up") == 0))).drop("_up")
    if excluded is None:
        return df
    out = excluded.select(*[F.col(c).alias(f"_x_{c}") for c in by], F.col("server").alias("_x")).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"_x_{c}")) for c in by] + [F.col("server") == F.col("_x")]
    df = df.join(out, on, "left").withColumn("_out", F.col("_x").isNotNull().cast("int")).drop("_x", *[f"_x_{c}" for c in by])
    return df.withColumn("_all", F.min("_out").over(w)).where((F.col("_out") == 0) | (F.col("_all") == 1)).drop("_out", "_all")


def route(servers: DataFrame, by: list[str], p: Policy, start: str | None = None, sampled: str | None = None) -> DataFrame:
    """One decision for each snapshot: the columns of by, server and what it was chosen for.

    servers has the columns of by (a snapshot), server, pos (its place in the list, 0-based), active, inflight_cost,
    success, error. start is the round-robin index (0 without it), sampled a boolean that limits p2c to the sample. All
    choices are top-1 by one ordering within a snapshot; a snapshot is bounded by the number of servers.
    """
    w = W.partitionBy(*by)
    n = F.col("success") + F.col("error")
    begin = F.col(start) if start else F.lit(0)
    df = servers.where(F.col(sampled)) if sampled and p.strategy == "p2c_cost_aware" else servers
    df = df.withColumn("_n", n).withColumn("_rate", success_rate(F.col("success"), F.col("error")))

    def flag(d: DataFrame) -> DataFrame:
        mean = F.avg(F.when(F.col("_n") >= p.window, F.col("_rate"))).over(w)
        return d.withColumn("_under", underperforming(F.col("_n"), F.col("_rate"), mean, p))

    def distance(d: DataFrame) -> DataFrame:
        d = d.withColumn("_k", F.row_number().over(w.orderBy("pos")) - 1).withColumn("_size", F.count("*").over(w))
        return d.withColumn("_far", F.pmod(F.col("_k") - F.pmod(begin, F.col("_size")), F.col("_size")))

    def preferred(d: DataFrame) -> DataFrame:
        """Without underperforming servers, unless that leaves none."""
        return d.withColumn("_fine", F.min(F.col("_under").cast("int")).over(w)).where(~F.col("_under") | (F.col("_fine") == 1)).drop("_fine")

    load = effective_load(F.col("active"), F.col("inflight_cost"), F.col("_rate"))
    score = cost_score(F.col("active"), F.col("inflight_cost"), F.col("_n"), F.col("_rate"), p.window)
    if p.strategy == "round_robin":
        df, order = distance(df), [F.col("_far")]
    elif p.strategy == "random":  # by a hash that reruns repeat
        order = [_draw("random", by), F.col("pos")]
    elif p.strategy == "least_connections":
        df, order = distance(preferred(flag(df))), [load, F.col("active"), F.col("_far")]
    elif p.strategy == "adaptive_round_robin":
        df = distance(flag(df))
        bad = (F.col("active") >= p.max_active) | F.col("_under")
        order = [bad, F.when(bad, F.col("active")).otherwise(0), F.when(bad, F.col("_k")).otherwise(F.col("_far"))]
    elif p.strategy == "load_aware_round_robin":
        df = distance(flag(df))
        share = fair_share(F.min("active").over(w), F.sum("active").over(w), F.col("_size").cast("double"))
        bad = (F.col("active") > share) | F.col("_under") | (F.lit(p.max_active > 0) & (F.col("active") >= p.max_active))
        # where all are bad, the least loaded of the preferred ones; their round-robin order skips the others
        df = df.withColumn("_bad", bad).withColumn("_none", F.min(F.col("_bad").cast("int")).over(w)).withColumn("_fine", F.min(F.col("_under").cast("int")).over(w))
        df = df.withColumn("_out", (F.col("_none") == 1) & F.col("_under") & (F.col("_fine") == 0))
        df = df.where(~F.col("_out") & ((F.col("_none") == 1) | ~F.col("_bad")))
        one = F.col("_none") == 1
        kept = distance(df.withColumn("_old", F.col("_far")))
        df, order = kept, [F.when(one, load).otherwise(0), F.when(one, F.col("active")).otherwise(0), F.when(one, F.col("_far")).otherwise(F.col("_old"))]
    else:
        fits = admissible(F.col("active"), F.col("inflight_cost"), p)
        df = df.withColumn("_fits", fits.cast("int")).withColumn("_any", F.max("_fits").over(w)).where((F.col("_fits") == 1) | (F.col("_any") == 0))
        df, order = preferred(flag(df)), [score, F.col("active"), F.col("pos")]
    best = df.withColumn("_rn", F.row_number().over(w.orderBy(*order))).where("_rn = 1")
    return best.select(*by, "server", F.col("active"), load.alias("effective_load"), score.alias("cost_score"))


def _draw(seed: str, by: list[str]):
    """A server's number in the lottery of a snapshot: md5 of the seed, the snapshot and the server, which any engine repeats."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], F.col("server").cast("string")))


def hash_sample(servers: DataFrame, by: list[str], k: int, seed: int = 0) -> DataFrame:
    """A boolean column sampled: k servers of each snapshot without replacement, by a hash that reruns repeat."""
    w = W.partitionBy(*by).orderBy(_draw(str(seed), by), "server")
    return servers.withColumn("sampled", F.row_number().over(w) <= k)


# ---------------------------------------------------------------- live counters


@dataclass
class Server:
    name: str
    url: str = ""
    healthy: bool = True
    active: int = 0
    inflight: float = 0.0
    success: int = 0
    error: int = 0
    failures: int = 0  # consecutive failed probes

    @property
    def n(self) -> int:
        return self.success + self.error

    @property
    def rate(self) -> float:
        return self.success / self.n if self.n else 1.0

    @property
    def load(self) -> int:
        base = max(self.active, int(self.inflight))
        return base if self.rate >= 1 else int(base * (1.0 / max(self.rate, RATE_FLOOR)))

    def score(self, window: int) -> float:
        return (self.inflight if self.inflight > 0 else float(self.active)) * (1.0 / max(self.rate, RATE_FLOOR) if self.n >= window else 1.0)

    def dispatched(self, cost: float = 1.0) -> None:
        self.active += 1
        self.inflight += max(1.0, cost)

    def finished(self, ok: bool, cost: float = 1.0) -> None:
        self.active, self.inflight = max(0, self.active - 1), max(0.0, self.inflight - max(1.0, cost))
        if ok:
            self.success += 1
        else:
            self.error += 1

    def probed(self, ok: bool, max_failures: int = 5) -> bool:
        """Take a health probe in; whether the state changed. One success recovers a server."""
        before = self.healthy
        self.failures = 0 if ok else self.failures + 1
        self.healthy = ok or (self.healthy and self.failures < max_failures)
        return before != self.healthy


@dataclass
class Router:
    """Decisions one after another on live counters, in one process."""

    servers: list[Server]
    policy: Policy = field(default_factory=Policy)
    turn: int = 0
    rng: random.Random = field(default_factory=lambda: random.Random(0))
    watchers: list[Callable[[list[Server]], None]] = field(default_factory=list)

    def subscribe(self, call: Callable[[list[Server]], None]) -> None:
        """call gets the servers whenever the health of any has changed; its errors are logged."""
        self.watchers.append(call)

    def healthy(self) -> list[Server]:
        return [s for s in self.servers if s.healthy]

    def changed(self) -> None:
        """The health of servers has changed: the turn starts over and the watchers are told."""
        self.turn = 0
        for call in self.watchers:
            try:
                call(list(self.servers))
            except Exception:
                logging.getLogger(__name__).exception("health watcher")

    def pick(self, excluded: frozenset[str] | set[str] = frozenset()) -> Server | None:
        pool = [s for s in self.servers if s.healthy] or (list(self.servers) if self.policy.allow_fallback else [])
        pool = [s for s in pool if s.name not in excluded] or pool
        if not pool:
            return None
        chosen = getattr(self, f"_{self.policy.strategy}")(pool)
        if "round_robin" in self.policy.strategy:
            self.turn = (pool.index(chosen) + 1) % len(pool)
        return chosen

    def update(self, servers: list[Server]) -> None:
        """A new list; the turn starts over if the number of healthy servers changed."""
        moved = sum(s.healthy for s in servers) != sum(s.healthy for s in self.servers)
        self.servers = servers
        if moved:
            self.changed()

    def stats(self) -> dict:
        up = sum(s.healthy for s in self.servers)
        each = [{"server": s.name, "healthy": s.healthy, "active": s.active, "success": s.success, "error": s.error, "success_rate": s.rate, "effective_load": s.load} for s in self.servers]
        return {"total_servers": len(self.servers), "healthy_servers": up, "unhealthy_servers": len(self.servers) - up, "total_requests": sum(s.n for s in self.servers), "servers": each}

    def _far(self, pool: list[Server]) -> dict[int, int]:
        return {id(s): (i - self.turn) % len(pool) for i, s in enumerate(pool)}

    def _under(self, pool: list[Server]) -> set[int]:
        known = [s.rate for s in pool if s.n >= self.policy.window]
        if not known:
            return set()
        bar = min(self.policy.threshold, WORSE_THAN_MEAN * sum(known) / len(known) - ROUNDING)
        return {id(s) for s in pool if s.n >= self.policy.window and s.rate < bar}

    def _preferred(self, pool: list[Server]) -> list[Server]:
        under = self._under(pool)
        return [s for s in pool if id(s) not in under] or pool

    def _lightest(self, pool: list[Server]) -> Server:
        far = self._far(pool)
        return min(pool, key=lambda s: (s.load, s.active, far[id(s)]))

    def _round_robin(self, pool: list[Server]) -> Server:
        return pool[self.turn % len(pool)]

    def _random(self, pool: list[Server]) -> Server:
        return self.rng.choice(pool)

    def _least_connections(self, pool: list[Server]) -> Server:
        return self._lightest(self._preferred(pool))

    def _in_turn(self, pool: list[Server], limit: float) -> Server | None:
        under, far = self._under(pool), self._far(pool)
        return min((s for s in pool if s.active < limit and id(s) not in under), key=lambda s: far[id(s)], default=None)

    def _adaptive_round_robin(self, pool: list[Server]) -> Server:
        return self._in_turn(pool, self.policy.max_active) or min(pool, key=lambda s: s.active)

    def _load_aware_round_robin(self, pool: list[Server]) -> Server:
        share = max(min(s.active for s in pool) + 1, math.ceil((sum(s.active for s in pool) + 1) / len(pool)))
        limit = min(share + 1, self.policy.max_active if self.policy.max_active > 0 else math.inf)
        return self._in_turn(pool, limit) or self._lightest(self._preferred(pool))

    def _p2c_cost_aware(self, pool: list[Server]) -> Server:
        p = self.policy
        drawn = self.rng.sample(pool, p.sample) if len(pool) > p.sample else pool
        fits = [s for s in drawn if (p.max_active <= 0 or s.active < p.max_active) and (p.max_cost <= 0 or s.inflight < p.max_cost)]
        return min(self._preferred(fits or drawn), key=lambda s: (s.score(p.window), s.active))
