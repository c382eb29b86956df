"""Queries that go through files, the client or whole jobs: a table is written in a source's format, read back by that source, and compared."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli, client, config, registry
from ..adapters import OpenAIAdapter, SimpleAdapter
from ..operators import normalize
from ..sinks import files as sinks
from ..sources import files, mock, udtf
from ..streaming import runner
from ..work import new_path
from .catalogue import query, table
from .pipeline import Lifecycle, Pipeline
from .result_queries import _RESULTS, _responses

PROMPTS = "SELECT doc_id::VARCHAR AS request_id, text AS prompt FROM documents WHERE text IS NOT NULL"


def _lines(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Documents as JSON lines in value, with doc_id and source."""
    return table(spark, sf, "documents").select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("prompt"), *more)).alias("value"), "doc_id", "source")


def _jsonl(spark: SparkSession, sf: str, *more: str) -> str:
    path = new_path(spark, "docs.jsonl")
    _lines(spark, sf, *more).select("value").write.text(path)
    return path


def _folders(spark: SparkSession, sf: str, *more: str) -> str:
    """A folder for each source, of part files."""
    path = new_path(spark, "in")
    _lines(spark, sf, *more).select("value", "source").write.partitionBy("source").text(path)
    return path


def _one_file(spark: SparkSession, name: str, text: str) -> str:
    """A small file at a path of its own."""
    path = new_path(spark, name)
    _put(spark, path, text.encode())
    return path


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()


def _nations(spark: SparkSession, sf: str) -> list:
    return table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows by definition


# ---------------------------------------------------------------- sources


@query("SELECT doc_id::VARCHAR AS request_id, text AS prompt, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) > 0 AS placed FROM documents WHERE text IS NOT NULL")
def q_source_jsonl(spark, sf):
    r = registry.get("source", "JSONLDataLoader")(spark, {"file_path": _jsonl(spark, sf, "lang")})
    return r.select("request_id", "prompt", F.get_json_object("additional_data", "$.lang").alias("lang"), (F.col("line_num") > 0).alias("placed"))


@query(PROMPTS)
def q_source_jsonl_strict(spark, sf):
    """The batch mode of the JSONL source, in which a malformed line is fatal."""
    return registry.get("source", "JSONLDataLoader")(spark, {"file_path": _jsonl(spark, sf), "streaming": False}).select("request_id", "prompt")


@query(PROMPTS + " AND doc_id % 7 NOT IN (2, 3, 5)")
def q_source_malformed(spark, sf):
    """Lines that are blank, cut off or no objects give no request; no other line is lost with them."""
    path, k = new_path(spark, "docs.jsonl"), F.col("doc_id") % 7
    bad = F.when(k == 2, F.expr("substring(value, 1, length(value) - 1)")).when(k == 3, F.lit("  ")).when(k == 5, F.lit('"text"')).otherwise(F.col("value"))
    _lines(spark, sf).select(bad.alias("value")).write.text(path)
    return registry.get("source", "JSONLDataLoader")(spark, {"file_path": path}).select("request_id", "prompt")


@query("SELECT n_nationkey::VARCHAR AS request_id, n_name AS prompt, (n_nationkey + 1)::BIGINT AS line_num, '{\"region\":' || n_regionkey || '}' AS additional_data FROM nation")
def q_source_json_array(spark, sf):
    rows = table(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows by definition
    path = _one_file(spark, "nations.json", json.dumps([{"id": r["n_nationkey"], "prompt": r["n_name"], "region": r["n_regionkey"]} for r in rows]))
    return registry.get("source", "JSONDataLoader")(spark, {"file_path": path}).select("request_id", "prompt", "line_num", "additional_data")


@query("SELECT doc_id::VARCHAR AS request_id, text AS prompt, lang FROM documents WHERE text <> ''")
def q_source_csv(spark, sf):
    path = new_path(spark, "docs.csv")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"), "lang")
    docs.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    r = registry.get("source", "CSVDataLoader")(spark, {"file_path": path})
    return r.select("request_id", "prompt", F.get_json_object("additional_data", "$.lang").alias("lang"))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'prompt_' || n_nationkey ELSE 'n' || n_nationkey END AS request_id, n_name AS prompt FROM nation WHERE n_nationkey % 5 <> 3")
def q_source_prompt_list(spark, sf):
    """Texts, objects with an id, and objects with an empty prompt, which go."""
    prompts = [{"prompt": ""} if k % 5 == 3 else name if k % 2 == 0 else {"prompt": name, "id": f"n{k}"} for k, name in _nations(spark, sf)]
    return registry.get("source", "PromptListLoader")(spark, {"prompts": prompts}).select("request_id", "prompt")


@query("SELECT doc_id::VARCHAR AS request_id, text AS prompt, 'source=' || source AS source_dir FROM documents WHERE text IS NOT NULL")
def q_source_directory(spark, sf):
    r = registry.get("source", "DirectoryJSONLDataLoader")(spark, {"input_dir": _folders(spark, sf), "file_pattern": "part-*"})
    return r.select("request_id", "prompt", "source_dir")


@query("SELECT doc_id::VARCHAR AS request_id, text AS prompt FROM documents WHERE text IS NOT NULL AND source <> 'src1'")
def q_source_skip(spark, sf):
    """A folder that a condition skips isn't read."""
    found = files.lines(spark, _folders(spark, sf), "part-*", skip_source=lambda f: f.contains("source=src1/"))
    return normalize.requests(normalize.fan_out(found)).select("request_id", "prompt")


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_ids, 3::BIGINT AS n_chunks FROM documents WHERE text IS NOT NULL")
def q_source_chunks(spark, sf):
    """Chunks of a folder's lines, read one by one, are disjoint and complete."""
    path, out = _folders(spark, sf), None
    for i in range(3):
        p = {"input_dir": path, "file_pattern": "part-*", "num_chunks": 3, "chunk_index": i}
        one = registry.get("source", "DirectoryJSONLDataLoader")(spark, p).select("request_id", F.lit(i).alias("chunk"))
        out = one if out is None else out.union(one)
    return out.agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("n_ids"), F.countDistinct("chunk").alias("n_chunks"))


@query(r"""
WITH l AS (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS prompt FROM documents)
SELECT prompt, count(*)::BIGINT AS n FROM l WHERE prompt <> '' GROUP BY prompt""")
def q_source_text_lines(spark, sf):
    path = new_path(spark, "texts")
    table(spark, sf, "documents").where("text is not null").select("text").write.text(path)
    r = registry.get("source", "TextLinesLoader")(spark, {"input_dir": path, "file_pattern": "part-*"})
    return r.groupBy("prompt").agg(F.countDistinct("source_file", "line_num").alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def q_source_row_count(spark, sf):
    return spark.createDataFrame([(files.row_count(normalize.requests(files.jsonl(spark, _jsonl(spark, sf)))),)], "n long")


@query("""SELECT n_name AS prompt, CASE WHEN n_nationkey % 2 = 0 THEN 'conv_' || (n_nationkey + 1) ELSE 'n' || n_nationkey END AS request_id,
  '[{"role":"user","content":"region ' || n_regionkey || '"},{"role":"user","content":"' || n_name || '"}]' AS messages,
  '{"history":[{"content":"region ' || n_regionkey || '","role":"user"}],"metadata":' || CASE WHEN n_nationkey % 2 = 0 THEN '{"topic":"x"}' ELSE '{"id":"n' || n_nationkey || '","topic":"x"}' END || '}' AS additional_data FROM nation""")
def q_source_histories(spark, sf):
    """An array of conversations: history, the prompt under either name, an id or a place."""
    from ..functions.messages import messages_json

    rows = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    convs = [{("prompt" if r["n_nationkey"] % 3 else "input"): r["n_name"], "history": [{"content": f"region {r['n_regionkey']}", "role": "user"}], **({"id": f"n{r['n_nationkey']}"} if r["n_nationkey"] % 2 else {}), "topic": "x"} for r in rows]
    h = files.histories(spark, _one_file(spark, "convs.json", json.dumps(convs)))
    return h.select("prompt", "request_id", messages_json("messages").alias("messages"), "additional_data")


@query("SELECT doc_id::VARCHAR AS request_id, source || '/' || doc_id AS prompt, upper(lang) AS lang FROM documents")
def q_hook_parse_line(spark, sf):
    """Lines of a format of the user's own, turned into JSON by a hook."""
    path = new_path(spark, "docs.tsv")
    table(spark, sf, "documents").select(F.concat_ws("\t", "doc_id", "source", "lang").alias("value")).write.text(path)

    def parse(line):
        part = F.split(line, "\t")
        return F.to_json(F.struct(part[0].alias("id"), F.concat(part[1], F.lit("/"), part[0]).alias("prompt"), F.upper(part[2]).alias("lang")))

    r = registry.get("source", "JSONLDataLoader")(spark, {"file_path": path, "hooks": normalize.Hooks(parse_line=parse)})
    return r.select("request_id", "prompt", F.get_json_object("additional_data", "$.lang").alias("lang"))


@query("""SELECT 'doc-' || doc_id AS request_id, 'Q: ' || text AS prompt, lang AS additional_data, length(text)::DOUBLE / 2 AS dispatch_cost FROM documents WHERE text IS NOT NULL AND lang <> 'fr'""")
def q_hooks(spark, sf):
    """Hooks for skipping, ids, prompts, additional data and costs."""
    h = normalize.Hooks(
        skip=lambda i: normalize.text_of(i, "lang") == "fr", request_id=lambda i: F.concat(F.lit("doc-"), normalize.text_of(i, "id")), transform_prompt=lambda p, _: F.concat(F.lit("Q: "), p),
        additional_data=lambda i: normalize.text_of(i, "lang"), dispatch_cost=lambda p, _: (F.length(p) - 3) / 2,
    )
    return normalize.requests(files.jsonl(spark, _jsonl(spark, sf, "lang")), hooks=h).select("request_id", "prompt", "additional_data", "dispatch_cost")


@query("SELECT doc_id::VARCHAR AS request_id, text AS prompt FROM documents WHERE text IS NOT NULL AND doc_id % 3 < 2")
def q_nested_item(spark, sf):
    """Objects that hold the item under a key, or are it."""
    k, inner = F.col("doc_id") % 3, F.struct(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    docs = table(spark, sf, "documents").where("text is not null")
    raw = F.when(k == 0, F.to_json(F.struct(inner.alias("data")))).when(k == 1, F.to_json(inner)).otherwise(F.to_json(F.struct(inner.alias("other"))))
    items = docs.select(F.lit("t").alias("source_file"), F.lit("").alias("source_dir"), F.col("doc_id").alias("line_num"), F.lit(0).alias("item_idx"), F.lit(1).alias("n_same"), raw.alias("raw"))
    items = items.withColumn("item", normalize.nested(normalize.parsed_item("raw"), "record", "data"))
    return normalize.requests(items, parsed=True).select("request_id", "prompt")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS item_idx, coalesce(text, '') AS prompt FROM conversations")
def q_sql_fan_out(spark, sf):
    """Fan-out in SQL, by a table function over lines."""
    udtf.register(spark)
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.expr("array_sort(collect_list(struct(turn, text)))").alias("t"))
    t.select("conv_id", F.to_json(F.transform("t", lambda m: F.struct(F.coalesce(m["text"], F.lit("")).alias("prompt")))).alias("value")).createOrReplaceTempView("inferframe_lines")
    return spark.sql("SELECT conv_id, item_idx, get_json_object(raw, '$.prompt') AS prompt FROM inferframe_lines, LATERAL fan_out(value)")


# ---------------------------------------------------------------- images


_IMAGES = """WITH i AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN ['a' || doc_id || '.png'] WHEN 1 THEN ['b.jpg', 'c' || doc_id || '.webp'] WHEN 2 THEN ['d.txt'] ELSE [] END AS images FROM documents WHERE text IS NOT NULL)"""


def _with_images(spark: SparkSession, sf: str, prefix: str = "") -> DataFrame:
    k, ident = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    one = F.when(k == 0, F.concat(F.lit("a"), ident, F.lit(".png"))).when(k == 2, F.lit("d.txt"))
    many = F.when(k == 1, F.array(F.lit("b.jpg"), F.concat(F.lit("c"), ident, F.lit(".webp"))))
    return table(spark, sf, "documents").select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("prompt"), one.alias("image"), many.alias("images"))).alias("value"), "source")


@query(_IMAGES + """SELECT doc_id::VARCHAR AS request_id, nullif(array_to_string(images, ' '), '') AS images,
  CASE WHEN len(images) = 0 THEN '[{"role":"user","content":' || to_json(text) || '}]' ELSE '[{"role":"user","content":['
  || array_to_string(list_transform(images, lambda x: '{"type":"image_url","image_url":{"url":"file://base/' || x || '"}}'), ',') || ',{"type":"text","text":' || to_json(text) || '}]}]' END AS messages FROM i""")
def q_multimodal_jsonl(spark, sf):
    from ..functions.messages import messages_json

    path = new_path(spark, "docs.jsonl")
    _with_images(spark, sf).select("value").write.text(path)
    r = registry.get("source", "MultimodalJSONLDataLoader")(spark, {"file_path": path, "encode_images": False, "image_base_dir": "base"})
    return r.select("request_id", F.array_join("images", " ").alias("images"), messages_json("messages").alias("messages"))


@query(_IMAGES + "SELECT doc_id::VARCHAR AS request_id, nullif(array_to_string(images, ' '), '') AS images, 'source=' || source AS source_dir FROM i JOIN documents USING (doc_id)")
def q_multimodal_directory(spark, sf):
    path = new_path(spark, "in")
    _with_images(spark, sf).write.partitionBy("source").text(path)
    r = registry.get("source", "MultimodalDirectoryJSONLDataLoader")(spark, {"input_dir": path, "file_pattern": "part-*", "encode_images": False})
    return r.select("request_id", F.array_join("images", " ").alias("images"), "source_dir")


@query(_IMAGES + "SELECT doc_id::VARCHAR AS request_id, CASE WHEN doc_id % 4 < 2 THEN array_to_string(images, ' ') END AS images FROM i")
def q_valid_images(spark, sf):
    """A hook that lets only known image types through."""
    from ..functions.images import is_supported

    path = new_path(spark, "docs.jsonl")
    _with_images(spark, sf).select("value").write.text(path)
    p = {"file_path": path, "encode_images": False, "hooks": normalize.Hooks(valid_image=is_supported)}
    return registry.get("source", "MultimodalJSONLDataLoader")(spark, p).select("request_id", F.array_join("images", " ").alias("images"))


@query("""SELECT n_nationkey::VARCHAR AS request_id, '[{"role":"user","content":[{"type":"image_url","image_url":{"url":"' || CASE WHEN n_nationkey % 4 = 3 THEN 'missing.png' ELSE 'data:image/png;base64,' || to_base64(encode(n_name)) END
  || '"}},{"type":"text","text":"see"}]}]' AS messages FROM nation""")
def q_images_encoded(spark, sf):
    """Image files as data URIs, read by executors; a file that isn't there stays a path."""
    from ..functions.messages import messages_json

    base, entries = new_path(spark, "images"), []
    for k, name in _nations(spark, sf):
        if k % 4 < 3:
            _put(spark, f"{base}/n{k}.png", name.encode())
        entries.append({"id": k, "prompt": "see", "image": f"n{k}.png" if k % 4 < 3 else "missing.png"})
    path = _one_file(spark, "images.json", json.dumps(entries))
    r = registry.get("source", "MultimodalJSONDataLoader")(spark, {"file_path": path, "image_base_dir": base})
    return r.select("request_id", messages_json("messages").alias("messages"))


# ---------------------------------------------------------------- sinks


@query(_RESULTS + "SELECT request_id, content, finish_reason, total_tokens, error FROM r")
def q_sink_jsonl(spark, sf):
    path = new_path(spark, "out.jsonl")
    registry.get("sink", "JSONLResultSaver")({"output_path": path, "output_projection": "minimal"}, {})(_responses(spark, sf))
    shape = "request_id string, content string, finish_reason string, usage struct<total_tokens:bigint>, error string"
    return spark.read.schema(shape).json(path).select("request_id", "content", "finish_reason", F.col("usage.total_tokens").alias("total_tokens"), "error")


@query("""SELECT '{"event_id":' || event_id || ',"event_type":' || to_json(event_type) || ',"props":' || to_json(props) || ',"user_id":' || CASE WHEN user_id % 3 = 0 THEN 'null' ELSE user_id::VARCHAR END || '}' AS value FROM events""")
def q_json_codec(spark, sf):
    """Compact JSON with nulls and quoted text, byte for byte."""
    return sinks.json_lines(table(spark, sf, "events").select("event_id", "event_type", "props", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("user_id")))


@query("SELECT DISTINCT conv_id::VARCHAR AS request_id FROM conversations")
def q_sink_json(spark, sf):
    """One JSON array, and the scan of what it says is finished."""
    path = new_path(spark, "out.json")
    registry.get("sink", "JSONResultSaver")({"output_path": path}, {})(_responses(spark, sf))
    return files.completed(spark, path, "json")


@query(_RESULTS + "SELECT request_id, nullif(content, '') AS content, num_choices::VARCHAR AS num_choices FROM r")
def q_sink_csv(spark, sf):
    path = new_path(spark, "out.csv")
    registry.get("sink", "CSVResultSaver")({"output_path": path}, {})(_responses(spark, sf))
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').select("request_id", "content", "num_choices")


@query("SELECT 'dir_' || source || '/answers_conv.jsonl' AS path, doc_id::VARCHAR AS request_id FROM documents WHERE text IS NOT NULL")
def q_sink_mirrored(spark, sf):
    """Results in folders like those of their sources."""
    docs = table(spark, sf, "documents").where("text is not null")
    body = F.lit('{"choices":[{"message":{"content":"x"}}]}')
    rows = docs.select(F.col("doc_id").cast("string").alias("request_id"), body.alias("model_output"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("additional_data"), F.concat(F.lit("dir_"), "source", F.lit("/conv.jsonl")).alias("source_file"), F.concat(F.lit("dir_"), "source").alias("source_dir"))
    path = new_path(spark, "out")
    sinks.write_mirrored(rows, path, "answers_{source}.jsonl", projection="minimal")
    # further files of a path have a number before the suffix
    own = F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), path.rpartition("/")[2] + "/", -1), r"-\d{5}\.jsonl$", ".jsonl")
    found = spark.read.option("recursiveFileLookup", "true").text(path)
    return found.select(own.alias("path"), F.get_json_object("value", "$.request_id").alias("request_id"))


@query("SELECT doc_id AS id, upper(lang) AS shape FROM documents WHERE text IS NOT NULL")
def q_sink_own_shape(spark, sf):
    """A saver's own form in place of a projection."""
    path = new_path(spark, "out.jsonl")
    rows = mock.complete(normalize.requests(files.jsonl(spark, _jsonl(spark, sf, "lang"))))
    form = lambda df: df.select(F.col("request_id").cast("bigint").alias("id"), F.upper(F.get_json_object("additional_data", "$.lang")).alias("shape"))
    registry.get("sink", "JSONLResultSaver")({"output_path": path, "form": form}, {})(rows)
    return spark.read.schema("id bigint, shape string").json(path)


@query("SELECT doc_id::VARCHAR AS request_id FROM documents WHERE text IS NOT NULL")
def q_chunk_merge(spark, sf):
    """Three jobs of a chunk each, and one output from theirs."""
    source, path = _folders(spark, sf), new_path(spark, "out") + "/all.jsonl"
    for i in range(3):
        job = {"loader": {"class": "DirectoryJSONLDataLoader", "params": {"input_dir": source, "file_pattern": "part-*", "num_chunks": 3, "chunk_index": i}}, "saver": {"class": "JSONLResultSaver", "params": {"output_path": path, "output_projection": "minimal"}}, "runner": {}}
        cli.pipeline(spark, config.build(job), mock.complete).run()
    sinks.merge_chunks(spark, path, 3)
    return spark.read.schema("request_id string").json(path)


# ---------------------------------------------------------------- jobs


_TOKENS = """WITH u AS (SELECT doc_id, greatest(1, length(text) // 4) AS p FROM documents WHERE text IS NOT NULL), v AS (SELECT doc_id, p + CASE WHEN p > 512 THEN 256 ELSE 32 END AS t FROM u)
SELECT 1::INT AS run, count(*)::BIGINT AS total, count(*)::BIGINT AS completed, 0::BIGINT AS failed, 0::BIGINT AS skipped, sum(t)::BIGINT AS total_tokens, sum(count(*)) OVER ()::BIGINT AS written FROM v WHERE doc_id % 2 = 0
UNION ALL SELECT 2, count(*) FILTER (WHERE doc_id % 2 = 1), count(*) FILTER (WHERE doc_id % 2 = 1), 0, count(*) FILTER (WHERE doc_id % 2 = 0), coalesce(sum(t) FILTER (WHERE doc_id % 2 = 1), 0)::BIGINT, count(*) FROM v"""


def _two_runs(spark: SparkSession, sf: str, backend: str) -> DataFrame:
    """A run over half of the documents, then one over all: the second leaves out what the first has done."""
    out, work, rows = new_path(spark, "out.jsonl"), new_path(spark, "work"), []
    lines = _lines(spark, sf).select("source", "doc_id", "value", F.lit("").alias("source_dir"), (F.col("doc_id") + 1).alias("line_num"), F.concat("source", F.lit("/conv.jsonl")).alias("source_file"))
    for n, some in enumerate((lines.where("doc_id % 2 = 0"), lines), 1):
        s = Pipeline(normalize.requests(normalize.fan_out(some)), mock.complete, lambda df: sinks.write_jsonl(df, out, projection="minimal"), work, backend=backend).run()
        rows.append((n, s["total"], s["completed"], s["failed"], s["skipped"], s["total_tokens"], spark.read.text(out).count()))
    return spark.createDataFrame(rows, "run int, total long, completed long, failed long, skipped long, total_tokens long, written long")


@query(_TOKENS)
def q_pipeline_resume(spark, sf):
    return _two_runs(spark, sf, "legacy_output_scan")


@query(_TOKENS)
def q_pipeline_resume_bitmap(spark, sf):
    return _two_runs(spark, sf, "bitmap")


@query("SELECT source AS source_file, count(*) FILTER (WHERE doc_id % 5 <> 0)::BIGINT AS completed, count(*) FILTER (WHERE doc_id % 5 = 0)::BIGINT AS failed, count(*) FILTER (WHERE doc_id % 5 <> 0 AND lang = 'en')::BIGINT AS saved FROM documents WHERE text IS NOT NULL GROUP BY source")
def q_pipeline_lifecycle(spark, sf):
    """What the hooks of a run are told of each source, and what a condition lets through to the sink."""
    lines = _lines(spark, sf, "lang").select(F.col("source").alias("source_file"), F.lit("").alias("source_dir"), (F.col("doc_id") + 1).alias("line_num"), "value")
    out, rows = new_path(spark, "out"), []

    def model(df):
        bad = F.col("request_id").cast("bigint") % 5 == 0
        return mock.complete(df).withColumn("error", F.when(bad, "refused")).withColumn("model_output", F.when(~bad, F.col("model_output")))

    Pipeline(
        normalize.requests(normalize.fan_out(lines)), model, lambda df: df.select("request_id", "source_file").write.parquet(out), new_path(spark, "work"),
        keep=lambda df: df.where(F.get_json_object("additional_data", "$.lang") == "en"), lifecycle=Lifecycle(on_source_complete=lambda *x: rows.append(x)),
    ).run()
    told = spark.createDataFrame(rows, "source_file string, completed long, failed long")
    kept = spark.read.parquet(out).groupBy(F.col("source_file").alias("s")).agg(F.count("*").alias("saved"))
    return told.join(kept, F.col("source_file") == F.col("s"), "left").select("source_file", "completed", "failed", F.coalesce("saved", F.lit(0)).alias("saved"))


@query("SELECT doc_id::VARCHAR AS request_id, 'mock response to ' || doc_id AS content FROM documents WHERE text IS NOT NULL")
def q_job(spark, sf):
    """A job from a configuration: source, mock model, sink, and its output."""
    out = new_path(spark, "out.jsonl")
    job = {"loader": {"class": "JSONLDataLoader", "params": {"file_path": _jsonl(spark, sf)}}, "saver": {"class": "JSONLResultSaver", "params": {"output_path": out, "output_projection": "minimal"}}, "runner": {"max_concurrency": 4, "resume_backend": "bitmap"}}
    cli.pipeline(spark, config.build(job), mock.complete).run()
    return spark.read.schema("request_id string, content string").json(out)


@query("SELECT doc_id::VARCHAR AS request_id, 'mock response to ' || doc_id AS content, 'source=' || source AS source_dir FROM documents WHERE text IS NOT NULL")
def q_stream_pipeline(spark, sf):
    """The pipeline over a folder of files as a stream, to its end; each micro-batch writes below its own number."""
    out = new_path(spark, "out")
    s = runner.Stream(_folders(spark, sf), "part-*", new_path(spark, "work"))
    keep = lambda df: df.select("request_id", F.get_json_object("model_output", "$.choices[0].message.content").alias("content"), "source_dir")
    q = runner.run_stream(spark, s, mock.complete, sinks.batch_jsonl(out, form=keep))
    q.awaitTermination()
    return spark.read.schema("request_id string, content string, source_dir string").option("recursiveFileLookup", "true").json(out)


# ---------------------------------------------------------------- client


def echo(url: str, body: bytes, timeout: float, headers=()) -> dict:
    """A server in place of HTTP: repeats the last message; the one called bad always fails."""
    if "//bad" in url:
        raise OSError("bad gateway")
    said = json.loads(body)["messages"][-1]["content"]
    return {"choices": [{"message": {"role": "assistant", "content": said}, "finish_reason": "stop"}], "usage": {"total_tokens": len(said)}}


@query("SELECT doc_id::VARCHAR AS request_id, text AS content, length(text)::BIGINT AS total_tokens, lang, TRUE AS good, NULL::VARCHAR AS error FROM documents WHERE text IS NOT NULL")
def q_client(spark, sf):
    """Requests through the client's routing and retries, over a server that fails and two that answer."""
    settings = client.ClientSettings(concurrency=2, max_retries=3, retry_delay=0.0, health_interval=0)
    r = client.infer(normalize.requests(files.jsonl(spark, _jsonl(spark, sf, "lang"))), [("bad", "http://bad"), ("a", "http://a"), ("b", "http://b")], settings, send=echo)
    last = F.element_at("attempts", -1)
    text = F.get_json_object("model_output", "$.choices[0].message.content")
    return r.select("request_id", text.alias("content"), F.get_json_object("model_output", "$.usage.total_tokens").cast("bigint").alias("total_tokens"), F.get_json_object("additional_data", "$.lang").alias("lang"), (last["ok"] & (last["server"] != "bad")).alias("good"), "error")


@query("""SELECT doc_id::VARCHAR AS request_id, e.error, e.n AS n_attempts, e.wait AS backoff_s FROM documents, (VALUES ('bad gateway', 3, 0.03::DOUBLE), ('no server available', 0, 0.0::DOUBLE)) e(error, n, wait)
WHERE text IS NOT NULL AND (doc_id % 2 = 0) = (e.n = 3)""")
def q_client_failures(spark, sf):
    """Rows of requests that no server answers: all tries failed, or there is no server."""
    rows = normalize.requests(files.jsonl(spark, _jsonl(spark, sf)))
    even = F.col("request_id").cast("bigint") % 2 == 0
    settings = client.ClientSettings(concurrency=8, max_retries=2, retry_delay=0.01, health_interval=0)
    r = client.infer(rows.where(even), [("bad", "http://bad")], settings, send=echo).union(client.infer(rows.where(~even), [], settings, send=echo))
    waits = F.aggregate("attempts", F.lit(0.0), lambda a, t: a + t["backoff_s"])
    return r.select("request_id", "error", F.size("attempts").alias("n_attempts"), F.round(waits, 6).alias("backoff_s"))


@query("SELECT n_nationkey AS k, 'http://' || n_name || '/v1/chat/completions' AS chat, 'http://' || n_name || '/health' AS health, 'http://' || n_name || '/generate' AS simple_chat, 'http://' || n_name || '/status' AS simple_health FROM nation")
def q_endpoints(spark, sf):
    a, b = OpenAIAdapter(), SimpleAdapter()
    rows = [(k, *(f(f"http://{name}/") for f in (a.chat_url, a.health_url, b.chat_url, b.health_url))) for k, name in _nations(spark, sf)]
    return spark.createDataFrame(rows, "k int, chat string, health string, simple_chat string, simple_health string")
