"""Job configurations: YAML or JSON with loader, saver, runner, and maybe logging and custom_modules."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from . import registry
from .client import ClientSettings
from .operators.routing import Policy


@dataclass(frozen=True)
class Runner:
    """Settings of a run. Names and defaults are fixed values, so that configurations stay valid.

    Four have no effect, as Spark's tasks take their place: http2 (connections are HTTP/1.1, kept open), writer_queue_size, writer_workers
    and streaming (a source is always read lazily; a JSONL source reads its own streaming parameter).
    """

    max_concurrency: int = 10
    max_retries: int = 3
    retry_delay: float = 1.0
    request_timeout: float = 120
    http_max_connections: int = 4096
    http_max_keepalive_connections: int = 1000
    http2: bool = True
    model_name: str = "default"
    temperature: float = 0.7
    max_tokens: int = 1000
    rollout_n: int = 1
    system_prompt: str = ""
    servers_dir: str = "."
    server_pattern: str = r"server_(.+)_(\d+)"
    load_balancing_strategy: str = "round_robin"
    health_check_interval: float = 30
    health_check_timeout: float = 5
    health_check_concurrency: int = 32
    max_failures: int = 5
    allow_unhealthy_fallback: bool = False
    success_rate_threshold: float = 0.5
    success_rate_window: int = 10
    max_active_requests: int = 50
    progress_report_interval: float = 10
    top_p: float = 1.0
    frequency_penalty: float = 0.0
    presence_penalty: float = 0.0
    adapter_class: str = "OpenAIAdapter"
    adapter_params: dict = field(default_factory=dict)
    streaming: bool = True
    stream_queue_size: int = 100
    producer_prefetch: int = 100
    resume: bool = True
    resume_backend: str = "legacy_output_scan"
    writer_queue_size: int = 1000
    writer_batch_size: int = 100
    writer_flush_interval_ms: int = 100
    writer_workers: int = 1
    selection_sample_size: int = 2
    max_inflight_cost: float = 0.0
    image_encode_workers: int = 4
    work_dir: str | None = None  # results and resume log; beside the output by default

    def __post_init__(self):
        if self.rollout_n < 1:
            raise ValueError("rollout_n must be at least 1")

    def policy(self) -> Policy:
        return Policy(self.load_balancing_strategy, self.allow_unhealthy_fallback, self.success_rate_threshold, self.success_rate_window, self.max_active_requests, self.selection_sample_size, self.max_inflight_cost)

    def client(self, tasks: int = 1) -> ClientSettings:
        """Settings of one task of several at a time: concurrency and limits are shared out."""
        tasks = max(1, tasks)
        p = self.policy()
        if tasks > 1:
            p = Policy(p.strategy, p.allow_fallback, p.threshold, p.window, -(-p.max_active // tasks) if p.max_active > 0 else 0, p.sample, p.max_cost / tasks)
        return ClientSettings(-(-self.max_concurrency // tasks), self.max_retries, self.retry_delay, self.request_timeout, self.max_failures, self.health_check_interval, self.health_check_timeout, p,
                              self.health_check_concurrency, -(-self.producer_prefetch // tasks), self.writer_batch_size, self.writer_flush_interval_ms / 1000, -(-self.http_max_connections // tasks), -(-self.http_max_keepalive_connections // tasks))


@dataclass
class Config:
    loader: dict[str, Any]
    saver: dict[str, Any]
    runner: Runner
    logging: dict[str, Any] = field(default_factory=dict)


def parse(text: str, name: str = "config.yaml") -> dict:
    if name.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML configurations need PyYAML; JSON works without") from e
    return yaml.safe_load(text)


def build(raw: dict) -> Config:
    """Check a configuration and fill in defaults. Modules of custom_modules are imported first, as they may register what it names."""
    if not isinstance(raw, dict):
        raise ValueError("a configuration is a mapping")
    registry.import_modules(raw.get("custom_modules") or [])
    for part in ("loader", "saver", "runner"):
        if part not in raw:
            raise ValueError(f"missing in the configuration: {part}")
    for part in ("loader", "saver"):
        if "class" not in raw[part]:
            raise ValueError(f"{part} names no class")
    known = {f.name for f in fields(Runner)}
    runner = dict(raw["runner"] or {})
    if unknown := sorted(set(runner) - known):
        raise TypeError(f"unknown runner settings: {', '.join(unknown)}")
    if "stream_queue_size" in runner:
        runner.setdefault("producer_prefetch", runner["stream_queue_size"])
    return Config({"class": raw["loader"]["class"], "params": dict(raw["loader"].get("params") or {})}, {"class": raw["saver"]["class"], "params": dict(raw["saver"].get("params") or {})}, Runner(**runner), raw.get("logging") or {})


def load(path: str, overrides: dict[str, Any] | None = None) -> Config:
    """Configuration of a file; overrides by dotted names, as loader.params.chunk_index."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"no configuration at {path}")
    raw = parse(p.read_text(encoding="utf-8"), p.name)
    for name, value in (overrides or {}).items():
        at = raw
        *folders, last = name.split(".")
        for f in folders:
            at = at.setdefault(f, {})
        at[last] = value
    return build(raw)


def set_up_logging(settings: dict[str, Any]) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if settings.get("file"):
        Path(settings["file"]).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(settings["file"], encoding="utf-8"))
    logging.basicConfig(level=getattr(logging, str(settings.get("level", "INFO")).upper()), format=settings.get("format", "%(asctime)s - %(name)s - %(levelname)s - %(message)s"), handlers=handlers, force=True)
