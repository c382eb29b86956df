"""Command line: run a job from a configuration."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import components, config, registry
from .client import infer
from .plans.pipeline import Pipeline
from .sources import files, mock, servers
from .streaming.progress import TaskProgress
from .work import exists, shared_dir

log = logging.getLogger("inferframe")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inferframe", description="Batch inference over a pool of model servers.")
    p.add_argument("--config", "-c", required=True)
    p.add_argument("--concurrency", type=int)
    p.add_argument("--model")
    p.add_argument("--temperature", type=float)
    p.add_argument("--max-tokens", type=int)
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="override a setting, as loader.params.chunk_index=2")
    p.add_argument("--mock", action="store_true", help="answer by rule, without servers")
    p.add_argument("--verbose", "-v", action="store_true")
    return p


def overrides(args: argparse.Namespace) -> dict:
    out = {}
    for item in args.set:
        name, eq, value = item.partition("=")
        if not eq:
            raise ValueError(f"--set needs NAME=VALUE, not {item}")
        out[name] = config.parse(value)
    for name, value in (("max_concurrency", args.concurrency), ("model_name", args.model)):
        if value:
            out[f"runner.{name}"] = value
    for name, value in (("temperature", args.temperature), ("max_tokens", args.max_tokens)):
        if value is not None:
            out[f"runner.{name}"] = value
    return out


def pipeline(spark: SparkSession, c: config.Config, model: Callable[[DataFrame], DataFrame] | None = None) -> Pipeline:
    """The pipeline of a configuration; model stands in for the servers."""
    r = c.runner
    requests = registry.get("source", c.loader["class"])(spark, {"image_encode_workers": r.image_encode_workers} | c.loader["params"])
    sink = registry.get("sink", c.saver["class"])(c.saver["params"], c.loader["params"])
    options = dict(r.adapter_params)
    if key := options.pop("api_key", None):
        options["headers"] = (("Authorization", f"Bearer {key}"),)
    adapter = registry.get("adapter", r.adapter_class)(**options)
    if model is None:
        pool = [(s["name"], s["url"]) for s in servers.discover(spark, r.servers_dir, r.server_pattern).collect()]  # a fleet, not data
        tasks = min(spark.sparkContext.defaultParallelism, max(1, r.max_concurrency))
        spread, settings = requests.repartition(tasks), r.client(tasks)
        requests = spread

        def model(df: DataFrame) -> DataFrame:
            return infer(df, pool, settings, adapter, r.model_name, r.temperature, r.max_tokens, r.rollout_n, r.system_prompt, r.top_p, r.frequency_penalty, r.presence_penalty)

    path = c.saver["params"].get("output_dir") or (components.output_path(c.saver["params"], c.loader["params"]) if "output_path" in c.saver["params"] else None)
    done = files.completed(spark, path, components.FORMATS[c.saver["class"]]) if r.resume and path and c.saver["class"] in components.FORMATS and exists(spark, path) else None
    work = r.work_dir or (f"{path}.work" if path else f"{shared_dir(spark)}/job.work")
    return Pipeline(requests, model, sink, work, done, r.resume, backend=r.resume_backend)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        c = config.load(args.config, overrides(args))
        config.set_up_logging(c.logging | ({"level": "DEBUG"} if args.verbose else {}))
        spark = SparkSession.builder.appName("inferframe").config("spark.speculation", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        job = pipeline(spark, c, (lambda df: mock.complete(df, c.runner.rollout_n)) if args.mock else None)
        with TaskProgress(spark, c.runner.progress_report_interval, lambda done, tasks: log.info("%s of %s tasks done", done, tasks)):
            s = job.run()
        log.info("total %(total)s, skipped %(skipped)s, completed %(completed)s, failed %(failed)s, retried %(retried)s, tokens %(total_tokens)s", s)
        return 0
    except Exception as e:  # the exit code is all that a caller sees
        log.error("%s: %s", type(e).__name__, e, exc_info=args.verbose)
        return 1


if __name__ == "__main__":
    sys.exit(main())
