"""Sources and sinks under the names that configurations use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import OpenAIAdapter, SimpleAdapter
from .operators import chunks, normalize
from .registry import register, register_sink, register_source
from .sinks import files as sinks
from .sources import files, images

for _adapter in (OpenAIAdapter, SimpleAdapter):
    register("adapter")(_adapter)


def _fields(p: dict, multimodal: bool = False, **more) -> normalize.Fields:
    return normalize.Fields(
        p.get("prompt_field", "prompt"), p.get("id_field", "id"), p.get("image_field", "image"), p.get("images_field", "images"),
        multimodal, multimodal and p.get("encode_images", True), p.get("image_base_dir"), **more,
    )


def _chunk(p: dict) -> dict:
    return {"num_chunks": p.get("num_chunks", 1), "chunk_index": p.get("chunk_index", 0)}


def _parse(p: dict):
    return p["hooks"].parse_line if p.get("hooks") else None


def _built(items: DataFrame, p: dict, multimodal: bool = False, **more) -> DataFrame:
    f = _fields(p, multimodal, **more)
    requests = normalize.requests(items, f, p.get("hooks") or normalize.Hooks())
    return images.encoded(requests, f.image_base, p.get("image_encode_workers", 4)) if f.encode_images else requests


@register_source("JSONLDataLoader")
def jsonl(spark: SparkSession, p: dict, multimodal: bool = False) -> DataFrame:
    mode = "PERMISSIVE" if p.get("streaming", True) else "FAILFAST"
    return _built(files.jsonl(spark, p["file_path"], mode, p.get("id_field", "id"), _parse(p), **_chunk(p)), p, multimodal)


@register_source("JSONDataLoader")
def json_array(spark: SparkSession, p: dict, multimodal: bool = False) -> DataFrame:
    return _built(files.json_array(spark, p["file_path"], **_chunk(p)), p, multimodal, drop="none")


@register_source("CSVDataLoader")
def csv(spark: SparkSession, p: dict) -> DataFrame:
    return _built(files.csv(spark, p["file_path"], p.get("prompt_field", "prompt"), p.get("encoding", "UTF-8")), p, drop="empty", empty_prompt=False)


@register_source("PromptListLoader")
def prompt_list(spark: SparkSession, p: dict) -> DataFrame:
    if "prompts" not in p:
        raise ValueError("a prompt list needs prompts")
    return _built(files.prompt_list(spark, p["prompts"]), {})


@register_source("DirectoryJSONLDataLoader")
def directory(spark: SparkSession, p: dict, multimodal: bool = False) -> DataFrame:
    return _built(files.directory_jsonl(spark, p["input_dir"], p.get("file_pattern", "conv.jsonl"), p.get("recursive", True), p.get("id_field", "id"), _parse(p), **_chunk(p)), p | ({} if not multimodal or p.get("image_base_dir") else {"image_base_dir": None}), multimodal)


@register_source("ChatHistoryLoader")
def histories(spark: SparkSession, p: dict) -> DataFrame:
    return files.histories(spark, p["file_path"], p.get("system_prompt"))


@register_source("TextLinesLoader")
def text_lines(spark: SparkSession, p: dict) -> DataFrame:
    return _built(files.text_lines(spark, p["input_dir"], p.get("file_pattern", "*.txt")), p)


@register_source("MultimodalJSONLDataLoader")
def multimodal_jsonl(spark: SparkSession, p: dict) -> DataFrame:
    return jsonl(spark, p, True)


@register_source("MultimodalJSONDataLoader")
def multimodal_json(spark: SparkSession, p: dict) -> DataFrame:
    return json_array(spark, p, True)


@register_source("MultimodalDirectoryJSONLDataLoader")
def multimodal_directory(spark: SparkSession, p: dict) -> DataFrame:
    from pyspark.sql import functions as F

    items = files.directory_jsonl(spark, p["input_dir"], p.get("file_pattern", "conv.jsonl"), p.get("recursive", True), p.get("id_field", "id"), _parse(p), **_chunk(p))
    f = _fields(p, True)
    requests = normalize.requests(items, f, p.get("hooks") or normalize.Hooks())
    if not f.encode_images:
        return requests
    if f.image_base is not None:
        return images.encoded(requests, f.image_base, p.get("image_encode_workers", 4))
    # images lie beside the file of their row
    root = files.absolute(spark, p["input_dir"]).rstrip("/")
    placed = requests.withColumn("_dir", F.col("source_dir")).withColumn("source_dir", F.concat_ws("/", F.lit(root), F.nullif("source_dir", F.lit(""))))
    return images.encoded(placed, workers=p.get("image_encode_workers", 4)).withColumn("source_dir", F.col("_dir")).drop("_dir")


Sink = Callable[[DataFrame], None]


def _shape(p: dict) -> dict:
    return {"projection": p.get("output_projection", "full"), "fields": p.get("output_fields"), "timestamp": p.get("include_timestamp"), "form": p.get("form")}


def output_path(p: dict, loader: dict) -> str:
    """The saver's path; of several chunks each has its own."""
    n = p.get("num_chunks", loader.get("num_chunks", 1))
    return chunks.chunk_path(p["output_path"], n, p.get("chunk_index", loader.get("chunk_index", 0))) if p.get("add_chunk_suffix", True) else p["output_path"]


@register_sink("JSONLResultSaver")
def to_jsonl(p: dict, loader: dict) -> Sink:
    return lambda df: sinks.write_jsonl(df, output_path(p, loader), p.get("append", True), **_shape(p))


@register_sink("JSONResultSaver")
def to_json(p: dict, loader: dict) -> Sink:
    return lambda df: sinks.write_json(df, output_path(p, loader), p.get("pretty_print", True), **_shape(p))


@register_sink("CSVResultSaver")
def to_csv(p: dict, loader: dict) -> Sink:
    return lambda df: sinks.write_csv(df, output_path(p, loader), p.get("fields"), encoding=p.get("encoding", "UTF-8"))


@register_sink("ConsoleResultSaver")
def to_console(p: dict, loader: dict) -> Sink:
    return lambda df: sinks.show(df, p.get("show_details", False), p.get("separator", "-" * 60))


@register_sink("DirectoryJSONLResultSaver")
def to_directory(p: dict, loader: dict) -> Sink:
    return lambda df: sinks.write_mirrored(df, p["output_dir"], p.get("output_filename"), p.get("output_file_pattern", "result.jsonl"), p.get("preserve_structure", True), **_shape(p))


#: Output format by saver, for the scan of finished results.
FORMATS = {"JSONLResultSaver": "jsonl", "JSONResultSaver": "json", "CSVResultSaver": "csv", "DirectoryJSONLResultSaver": "jsonl"}
