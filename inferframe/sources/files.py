"""File sources. Each gives items (schema.ITEM) for operators.normalize, lazily and split like any Spark scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost, messages
from ..functions.text import file_name, parent_dir, strip
from ..operators import chunks, normalize


def absolute(spark: SparkSession, path: str) -> str:
    """The path as Spark's file metadata names it, without percent escapes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toString()


def _plain(c: Column) -> Column:
    """Scheme, slashes and percent escapes of a file URL in one form."""
    c = F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(c, "^file:/+", "file:/")


def relative(spark: SparkSession, root: str) -> Column:
    """Path of a row's file below root."""
    base = absolute(spark, root).rstrip("/")
    base = "file:/" + base[5:].lstrip("/") if base.startswith("file:") else base
    return F.substring(_plain(F.col("_file")), len(base) + 2, 1 << 20)


def numbered(rows: DataFrame, index_by: Column | None = None, few: bool = False) -> DataFrame:
    """Add line_num to rows of value, _file and _block (from numbered_scan).

    A scan keeps the lines of a block of a file together and in order, so a line's number is the number of lines in earlier blocks
    plus its distance from the block's first row. Only one row for each block is aggregated; the lines aren't shuffled or sorted.
    index_by, a file's name: also add idx, the 0-based index of physical lines over all files in the order of their names, from the same
    counts. few: the table of blocks is small enough to go to every task, so that the lines aren't shuffled for the join either.
    """
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    blocks = rows.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    from pyspark.sql import Window as W

    before = F.sum("_n").over(W.partitionBy("_file").orderBy("_block")) - F.col("_n")
    places = blocks.withColumn("_before", before)
    if index_by is not None:
        places = places.withColumn("_name", index_by).withColumn("_start", F.sum("_n").over(W.orderBy("_name", "_file", "_block")) - F.col("_n"))
    places = places.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), "_first", "_before", *(["_start"] if index_by is not None else []))
    out = rows.join(F.broadcast(places) if few else places, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    if index_by is not None:
        out = out.withColumn("idx", F.col("_start") + F.col("_id") - F.col("_first")).drop("_start")
    return out.withColumn("line_num", F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_id", "_first", "_before", "_f", "_b", "_block")


#: Up to so many files, the table of their blocks goes to every task.
FEW_FILES = 50_000


def scan(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, stream: bool = False) -> DataFrame:
    """value, _file and _block of every physical line; \\n, \\r and \\r\\n end lines, blank ones count."""
    r = spark.readStream if stream else spark.read
    r = r.option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    text = r.text(path) if isinstance(path, str) or stream else r.text(list(path))
    return text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def lines(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True, num_chunks: int = 1, chunk_index: int = 0, skip_source: Callable[[Column], Column] | None = None) -> DataFrame:
    """source_file, source_dir, line_num and value (stripped) of the lines that aren't blank.

    path is a file, or a folder whose files match pattern; source_file is relative to the folder, or the file's given path.
    A chunk takes every num_chunks-th physical line over all files in path order; files are numbered by their sizes, not by what
    earlier chunks kept, so chunks are disjoint and complete. skip_source is a condition on a file's URL; files that it holds for aren't
    opened, and don't count.
    """
    rows = scan(spark, path, pattern)
    few = len(rows._jdf.inputFiles()) <= FEW_FILES
    if skip_source is not None:
        rows = rows.where(~skip_source(F.col("_file")))
    chunks.checked(num_chunks, chunk_index)
    if num_chunks == 1:
        return placed(spark, numbered(rows, few=few), path, pattern is not None, recursive)
    name = relative(spark, path) if pattern is not None else F.lit(path)
    if pattern is not None and not recursive:
        rows = rows.where(parent_dir(name) == "")
    own = numbered(rows, name, few).where(chunks.in_chunk(F.col("idx"), num_chunks, chunk_index)).drop("idx")
    return placed(spark, own, path, pattern is not None, recursive)


def placed(spark: SparkSession, rows: DataFrame, path: str, folder: bool, recursive: bool = True) -> DataFrame:
    rows = rows.withColumn("source_file", relative(spark, path) if folder else F.lit(path))
    rows = rows.withColumn("source_dir", parent_dir("source_file") if folder else parent_dir(F.lit(path)))
    if folder and not recursive:
        rows = rows.where("source_dir = ''")
    rows = rows.withColumn("value", strip("value"))
    return rows.where(F.length("value") > 0).select("source_file", "source_dir", "line_num", "value")


def malformed(lines_: DataFrame) -> DataFrame:
    """Lines that no item comes from because they aren't JSON."""
    v = F.try_parse_json("value")
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    return lines_.where(v.isNull() & ~F.coalesce(F.size(F.array_distinct(keys)) < F.size(keys), F.lit(False)))


def rewritten(found: DataFrame, parse_line: Callable[[Column], Column] | None) -> DataFrame:
    """Lines through a hook that turns their text into JSON; those that it makes null go."""
    return found if parse_line is None else found.withColumn("value", parse_line(F.col("value"))).where("value is not null")


def jsonl(spark: SparkSession, path: str, mode: str = "PERMISSIVE", id_field: str = "id", parse_line: Callable[[Column], Column] | None = None, **chunk) -> DataFrame:
    """Items of a JSONL file. Lines that aren't JSON are left out, or are an error (FAILFAST), as is a file without items then."""
    found = rewritten(lines(spark, path, **chunk), parse_line)
    items = normalize.fan_out(found, id_field)
    if mode == "FAILFAST":
        bad = malformed(found).select("source_file", "line_num").first()
        if bad:
            raise ValueError(f"not JSON: {bad['source_file']}:{bad['line_num']}")
        if items.isEmpty():
            raise ValueError(f"no data in {path}")
    return items


def directory_jsonl(spark: SparkSession, input_dir: str, file_pattern: str = "conv.jsonl", recursive: bool = True, id_field: str = "id", parse_line: Callable[[Column], Column] | None = None, **chunk) -> DataFrame:
    """Items of all JSONL files below a folder."""
    return normalize.fan_out(rewritten(lines(spark, input_dir, file_pattern, recursive, **chunk), parse_line), id_field)


def row_count(items: DataFrame) -> int:
    """Rows of a source, counted on demand; 0, for unknown, of a stream."""
    return 0 if items.isStreaming else items.count()


def histories(spark: SparkSession, path: str, system: str | None = None) -> DataFrame:
    """REQUEST rows of a JSON array of conversations: {prompt or input, history?: [{role, content}], id?, ...}.

    The id is the entry's own, else conv_{place from 1}; messages are the system prompt, the history and the prompt; additional_data is {history, metadata}, metadata
    all fields but prompt, input and history. A missing prompt is empty.
    """
    items = json_array(spark, path).withColumn("item", normalize.parsed_item("raw"))
    item = F.col("item")
    past = F.coalesce(F.from_json(normalize.text_of(item, "history"), "array<struct<role:string,content:string>>"), F.array().cast("array<struct<role:string,content:string>>"))
    rest = F.map_filter(item, lambda k, v: ~k.isin("prompt", "input", "history"))
    extra = F.concat(F.lit('{"history":'), F.coalesce(normalize.text_of(item, "history"), F.lit("[]")), F.lit(',"metadata":'), F.to_json(rest), F.lit("}"))
    prompt = F.when(F.map_contains_key(item, F.lit("prompt")), normalize.text_of(item, "prompt")).otherwise(normalize.text_of(item, "input"))
    df = items.withColumn("prompt", F.coalesce(prompt, F.lit("")))
    return df.select(
        F.coalesce(normalize.text_of(item, "id"), F.concat(F.lit("conv_"), F.col("line_num").cast("string"))).alias("request_id"), "prompt", messages.with_history("prompt", past, system).alias("messages"),
        F.lit(None).cast("array<string>").alias("images"), extra.alias("additional_data"), "source_file", "source_dir", "line_num", "item_idx", cost.dispatch_cost("prompt").cast("double").alias("dispatch_cost"),
    )


def json_array(spark: SparkSession, path: str, num_chunks: int = 1, chunk_index: int = 0) -> DataFrame:
    """Items of a file that is one JSON array; line_num is the entry's place from 1. Another root is an error.

    One task parses a file, as the format can't be split; JSONL is for large data.
    """
    whole = spark.read.text(path, wholetext=True)
    if not whole.where(~F.col("value").rlike(r"^\s*\[")).isEmpty():
        raise ValueError(f"the root of {path} isn't a list")
    entries = whole.select(F.posexplode(F.from_json(strip("value"), "array<string>")).alias("pos", "raw"))
    chunks.checked(num_chunks, chunk_index)
    rows = entries.where(F.col("raw").rlike(r"^\s*\{"))
    if num_chunks > 1:
        rows = rows.where(chunks.in_chunk(F.col("pos"), num_chunks, chunk_index))
    return rows.select(F.lit(path).alias("source_file"), F.lit(path.rpartition("/")[0]).alias("source_dir"), (F.col("pos") + 1).cast("bigint").alias("line_num"), F.lit(0).alias("item_idx"), F.lit(1).alias("n_same"), "raw")


def csv(spark: SparkSession, path: str, prompt_field: str = "prompt", encoding: str = "UTF-8") -> DataFrame:
    """Items of a CSV file with a header; all fields are text, empty ones null. There are no positions: a quoted field may span lines."""
    rows = spark.read.csv(path, header=True, encoding=encoding, inferSchema=False, multiLine=True, quote='"', escape='"')
    if prompt_field not in rows.columns:
        raise ValueError(f"{path} has no column {prompt_field}")
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return _unplaced(rows.select(raw.alias("raw")))


def prompt_list(spark: SparkSession, prompts: Iterable, prefix: str = "prompt_", first: int = 0) -> DataFrame:
    """Items of a list of prompts: texts, or objects with prompt and maybe id. The default id has the place in the list; an empty object prompt is dropped."""
    if not isinstance(prompts, (list, tuple)):
        raise ValueError("prompts must be a list")
    rows = []
    for i, p in enumerate(prompts, first):
        if isinstance(p, str):
            rows.append((p, f"{prefix}{i}"))
        elif isinstance(p, dict) and p.get("prompt"):
            rows.append((str(p["prompt"]), str(p.get("id", f"{prefix}{i}"))))
    df = spark.createDataFrame(rows, "prompt string, id string")
    return _unplaced(df.select(F.to_json(F.struct("id", "prompt")).alias("raw")))


def text_lines(spark: SparkSession, path: str, pattern: str | None = "*.txt") -> DataFrame:
    """Items of plain text: each line that isn't blank is a prompt with the id {file name}:{line}."""
    r = lines(spark, path, pattern)
    raw = F.to_json(F.struct(F.concat_ws(":", file_name("source_file"), F.col("line_num")).alias("id"), F.col("value").alias("prompt"), "source_file"))
    return r.select("source_file", "source_dir", "line_num", F.lit(0).alias("item_idx"), F.lit(1).alias("n_same"), raw.alias("raw"))


def table_items(df: DataFrame, source: str = "table") -> DataFrame:
    """Items of any DataFrame, its columns the fields."""
    return _unplaced(df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("raw")), source)


def _unplaced(raw: DataFrame, source: str | None = None) -> DataFrame:
    return raw.select(F.lit(source).cast("string").alias("source_file"), F.lit(None).cast("string").alias("source_dir"), F.lit(None).cast("bigint").alias("line_num"), F.lit(None).cast("int").alias("item_idx"), F.lit(1).alias("n_same"), "raw")


# ---------------------------------------------------------------- what earlier runs wrote

DONE = "request_id string, source_file string, line_num bigint, item_idx int"
_IDS = "array<struct<request_id:string>>"


def _head(spark: SparkSession, path: str, most: int = 8) -> str:
    """The first bytes of the first file below a path that has any; empty if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().getName()):
        if s.isFile() and s.getLen() > 0 and s.getPath().getName()[0] not in "_.":
            f = fs.open(s.getPath())
            try:
                read = (f.read() for _ in range(min(most, s.getLen())))
                return bytes(b for b in read if b >= 0).decode("latin-1")
            finally:
                f.close()
    return ""


def _array_ids(spark: SparkSession, path: str) -> DataFrame:
    """request_id of the entries of JSON arrays below a path.

    A file whose entries begin on lines of their own ({ at the margin, or after two spaces and alone) is split there over tasks. That holds only if
    each piece is a list of whole entries, which one pass over the pieces makes sure of: pieces that are whole between such lines make up the array.
    Any other layout streams through one task a file.
    """
    head = _head(spark, path)
    mark = next((m for m in ("\n{", "\n  {\n") if head.startswith("[" + m)), None)
    if mark is not None:
        text = F.rtrim("value", F.lit(" \n\r\t"))
        piece = F.when(F.substring(text, -1, 1).isin(",", "]"), F.concat(F.lit("[{"), F.substring(text, F.lit(1), F.length(text) - 1), F.lit("]")))
        found = spark.read.option("lineSep", mark).text(path).where(F.col("value") != "[").select(F.from_json(piece, _IDS).alias("ids"))
        if found.agg(F.count_if(F.col("ids").isNull())).first()[0] == 0:
            return found.select(F.explode("ids").alias("r")).select("r.request_id")
    return spark.read.schema("request_id string").option("multiLine", "true").json(path)


def completed(spark: SparkSession, path: str, fmt: str = "jsonl") -> DataFrame:
    """request_id of finished results below a path: jsonl, json (an array) or csv. Lines that don't parse are skipped; a path that isn't there gives no rows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "request_id string")
    if fmt == "csv":
        found = spark.read.csv(path, header=True, multiLine=True, escape='"')
        found = found.select("request_id") if "request_id" in found.columns else spark.createDataFrame([], "request_id string")
    elif fmt == "json":
        found = _array_ids(spark, path)
    else:
        found = spark.read.option("recursiveFileLookup", "true").schema("request_id string").json(path)
    return found.where("request_id is not null").distinct()
