"""Queries of the request side: prompts, ids, costs, fan-out, chunks, messages, images, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost, ids, images, messages
from ..functions.text import file_stem, first_truthy, parent_dir, snake_case, strip, truncated
from ..operators import chunks, normalize, resume
from .catalogue import query, table

TURNS = "array_sort(collect_list(struct(turn, role, text)))"


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each conversation, with its turns in order as messages of role and content."""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.expr(TURNS).alias("t"))
    return t.select("conv_id", F.transform("t", lambda m: messages.message(m["role"], m["text"])).alias("messages"))


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return chunks.with_index(docs, F.floor(F.col("doc_id") / 1_000_000), ["doc_id"])


# ---------------------------------------------------------------- prompts and lines


@query("SELECT doc_id::VARCHAR AS request_id, text AS prompt FROM documents WHERE text IS NOT NULL")
def q_prompt_project(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("request_id"), F.col("text").alias("prompt"))


@query(r"""
WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents)
SELECT doc_id, count(*)::BIGINT AS n_lines FROM l WHERE length(line) > 0 GROUP BY doc_id""")
def q_blank_line_drop(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.length(strip("line")) > 0).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("SELECT doc_id, coalesce(nullif(lang, ''), nullif(source, '')) AS prompt, coalesce(text, source) AS present FROM documents")
def q_multi_field_prompt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", first_truthy("lang", "source").alias("prompt"), F.coalesce("text", "source").alias("present"))


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN text WHEN 'fr' THEN source ELSE coalesce(text, source) END AS prompt,
  CASE lang WHEN 'en' THEN 'qa_' || doc_id WHEN 'fr' THEN 'task_' || doc_id ELSE doc_id::VARCHAR END AS request_id FROM documents""")
def q_conditional_prompt(spark, sf):
    lang, ident = F.col("lang"), F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(lang == "en", F.col("text")).when(lang == "fr", F.col("source")).otherwise(F.coalesce("text", "source")).alias("prompt"),
        F.when(lang == "en", F.concat(F.lit("qa_"), ident)).when(lang == "fr", F.concat(F.lit("task_"), ident)).otherwise(ident).alias("request_id"),
    )


@query("""
SELECT doc_id, doc_id::VARCHAR AS request_id, length(text)::BIGINT AS chars, greatest(1, length(text) // 4)::DOUBLE AS dispatch_cost,
  lang AS extra_lang, source AS extra_source FROM documents WHERE text IS NOT NULL""")
def q_requests(spark, sf):
    """The normaliser end to end: JSON lines to requests."""
    docs = table(spark, sf, "documents")
    lines = docs.select(
        F.concat("source", F.lit("/part.jsonl")).alias("source_file"), F.col("source").alias("source_dir"), F.col("doc_id").alias("line_num"),
        F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("prompt"), "lang", "source")).alias("value"),
    )
    r = normalize.requests(normalize.fan_out(lines))
    extra = F.from_json("additional_data", "lang string, source string")
    return r.select(F.col("line_num").alias("doc_id"), "request_id", F.length("prompt").cast("bigint").alias("chars"), "dispatch_cost", extra["lang"].alias("extra_lang"), extra["source"].alias("extra_source"))


# ---------------------------------------------------------------- ids


@query("SELECT doc_id, source || ':' || doc_id AS line_id, source || ':' || doc_id || '_' || (doc_id % 3) AS item_id FROM documents")
def q_positional_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.positional_id("source", "doc_id").alias("line_id"), ids.positional_id("source", "doc_id", F.col("doc_id") % 3).alias("item_id"))


@query("SELECT doc_id, concat_ws('_', source, lang, doc_id) AS request_id, source || '.jsonl:' || doc_id AS file_request_id FROM documents")
def q_composite_id(spark, sf):
    path = F.concat(F.lit("in/"), F.col("source"), F.lit(".jsonl"))
    return table(spark, sf, "documents").select("doc_id", ids.composite_id("source", "lang", "doc_id").alias("request_id"), ids.file_id(path, "doc_id").alias("file_request_id"))


@query("""SELECT doc_id, sha256('{"data": {"lang": "' || lang || '", "n": ' || n_chars || '}, "prompt": "' || source || '/' || doc_id || '"}') AS request_id FROM documents""")
def q_canonical_id(spark, sf):
    """The id of a request without one: a digest of its canonical JSON."""
    raw = F.to_json(F.struct(F.concat_ws("/", "source", "doc_id").alias("prompt"), F.col("n_chars").alias("n"), "lang"))
    return table(spark, sf, "documents").select("doc_id", ids.content_hash(raw).alias("request_id"))


@query("SELECT doc_id, sha256(coalesce(text, '') || '|' || coalesce(lang, '') || '|' || coalesce(source, '')) AS request_id FROM documents")
def q_content_hash_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.column_hash("text", "lang", "source").alias("request_id"))


@query("""
SELECT DISTINCT source, sha1(source) AS digest, substr(sha1(source), 1, 2) || '/' || sha1(source) || '_idx0.bitmap' AS path FROM documents""")
def q_source_sha1(spark, sf):
    d = table(spark, sf, "documents").select("source").distinct()
    return d.select("source", F.sha1(F.col("source").cast("binary")).alias("digest"), ids.bitmap_path("source", F.lit(0)).alias("path"))


# ---------------------------------------------------------------- costs


@query("SELECT doc_id, greatest(1, coalesce(length(text), 0) // 4)::DOUBLE AS dispatch_cost FROM documents")
def q_dispatch_cost(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cost.dispatch_cost("text").alias("dispatch_cost"))


@query("""
SELECT event_id, coalesce(CASE WHEN k > 0 THEN k END, greatest(1, length(props) // 4)::DOUBLE) AS dispatch_cost
FROM (SELECT *, json_extract_string(props, '$.k')::DOUBLE - 20 AS k FROM events)""")
def q_cost_metadata_override(spark, sf):
    item = F.from_json("props", "map<string,variant>")
    k = cost.stated_costs(item, ("k",))[0] - 20
    return table(spark, sf, "events").select("event_id", cost.dispatch_cost("props", k).alias("dispatch_cost"))


@query("""
SELECT page_id, greatest(1, length(url) // 4)::DOUBLE + 256 * len(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dispatch_cost FROM pages""")
def q_multimodal_cost(spark, sf):
    links = F.size(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return table(spark, sf, "pages").select("page_id", cost.multimodal_cost(cost.dispatch_cost("url"), links).alias("dispatch_cost"))


@query("SELECT conv_id, greatest(1, sum(coalesce(length(text), 0)) // 4)::DOUBLE AS cost FROM conversations GROUP BY conv_id")
def q_conversation_cost(spark, sf):
    return _conversations(spark, sf).select("conv_id", cost.message_cost("messages").alias("cost"))


@query("""
SELECT doc_id, p::BIGINT AS prompt_tokens, c::BIGINT AS completion_tokens, (p + c)::BIGINT AS total_tokens, (5 + least(p // 16, 100) + doc_id % 7)::DOUBLE AS latency_ms
FROM (SELECT doc_id, p, CASE WHEN p > 512 THEN 256 ELSE 32 END AS c FROM (SELECT doc_id, greatest(1, coalesce(length(text), 0) // 4) AS p FROM documents))""")
def q_mock_tokens(spark, sf):
    u = table(spark, sf, "documents").select("doc_id", cost.mock_usage(F.coalesce(F.length("text"), F.lit(0))).alias("u")).select("doc_id", "u.*")
    return u.withColumn("latency_ms", cost.mock_latency_ms(F.col("prompt_tokens"), F.col("doc_id")).cast("double"))


# ---------------------------------------------------------------- filters


@query("""
SELECT d.doc_id, d.lang FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)
WHERE d.lang = 'en' AND coalesce(l.quality, 1.0) >= 0.8""")
def q_filter_lang_quality(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "lang")
    return docs.join(labels, "doc_id", "left").where(F.coalesce(F.col("quality").cast("double"), F.lit(1.0)) >= 0.8).select("doc_id", "lang")


_INDEX = "WITH i AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS total FROM documents) "


@query(_INDEX + "SELECT doc_id, idx::BIGINT AS idx FROM i WHERE idx % 4 = 1")
def q_chunk_modulo(spark, sf):
    return _indexed(spark, sf).where(chunks.in_chunk(F.col("idx"), 4, 1)).select("doc_id", "idx")


@query(_INDEX + "SELECT (idx % 4)::BIGINT AS chunk, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM i GROUP BY 1")
def q_chunk_coverage(spark, sf):
    return _indexed(spark, sf).groupBy((F.col("idx") % 4).alias("chunk")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(_INDEX + "SELECT doc_id, idx::BIGINT AS idx FROM i WHERE idx >= 2 * ceil(total / 7) AND idx < least(3 * ceil(total / 7), total)")
def q_chunk_slice(spark, sf):
    total = table(spark, sf, "documents").agg(F.count("*").alias("total"))  # one row
    rows = _indexed(spark, sf).join(F.broadcast(total))
    return rows.where(chunks.in_slice(F.col("idx"), F.col("total"), 7, 2)).select("doc_id", "idx")


@query("SELECT k::BIGINT AS chunk, (n // 7 + CASE WHEN k < n % 7 THEN 1 ELSE 0 END)::BIGINT AS n_rows FROM range(7) r(k), (SELECT count(*) AS n FROM documents)")
def q_chunk_estimate(spark, sf):
    n = table(spark, sf, "documents").agg(F.count("*").alias("n"))
    return n.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint"))).alias("chunk")).select("chunk", chunks.chunk_rows(F.col("n"), F.lit(7), F.col("chunk")).alias("n_rows"))


@query("""
SELECT DISTINCT source, 'out/' || source || '.jsonl' AS path, 'out/' || source || '_chunk_' || (length(source) % 3) || '.jsonl' AS chunk_path FROM documents""")
def q_chunk_suffix(spark, sf):
    d = table(spark, sf, "documents").select("source").distinct()
    path = F.concat(F.lit("out/"), F.col("source"), F.lit(".jsonl"))
    return d.select("source", path.alias("path"), chunks.chunk_path_column(path, F.length("source") % 3).alias("chunk_path"))


# ---------------------------------------------------------------- fan-out


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, i::BIGINT AS item_idx, doc_id || '_' || i AS request_id, line AS prompt FROM l
WHERE length(regexp_replace(line, '^\s+|\s+$', '', 'g')) > 0""")
def q_fanout_lines(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("item_idx", "prompt")).where(F.length(strip("prompt")) > 0)
    return rows.select("doc_id", F.col("item_idx").cast("bigint").alias("item_idx"), F.concat_ws("_", "doc_id", "item_idx").alias("request_id"), "prompt")


@query("""
SELECT conv_id, (turn - 1)::BIGINT AS item_idx, text AS prompt FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, text FROM conversations)
WHERE text IS NOT NULL""")
def q_fanout_lists(spark, sf):
    """Lines that hold a list: one request for each entry, with its place."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.expr(TURNS).alias("t"))
    value = F.to_json(F.transform("t", lambda m: F.struct(m["text"].alias("prompt"), m["turn"].alias("turn"))))
    lines = c.select(F.lit("conversations").alias("source_file"), F.lit("").alias("source_dir"), F.col("conv_id").alias("line_num"), value.alias("value"))
    return normalize.requests(normalize.fan_out(lines)).select(F.col("line_num").alias("conv_id"), F.col("item_idx").cast("bigint").alias("item_idx"), "prompt")


@query(r"""
WITH v AS (SELECT conv_id * 1000 + turn AS k, string_split(text, '. ') AS parts FROM conversations WHERE text IS NOT NULL),
e AS (SELECT k, unnest(parts) AS prompt, generate_subscripts(parts, 1) - 1 AS i FROM v)
SELECT k || '_var_' || i AS request_id, prompt, i::BIGINT AS variation FROM e""")
def q_fanout_variations(spark, sf):
    """A list field of JSON items becomes one request for each entry."""
    c = table(spark, sf, "conversations").where("text is not null")
    raw = F.to_json(F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.split("text", r"\. ").alias("variations")))
    items = c.select(F.lit("conversations").alias("source_file"), F.lit("").alias("source_dir"), F.col("conv_id").alias("line_num"), F.lit(0).alias("item_idx"), F.lit(1).alias("n_same"), raw.alias("raw"))
    r = normalize.requests(normalize.explode_field(items, "variations"))
    return r.select("request_id", "prompt", F.col("item_idx").cast("bigint").alias("variation"))


@query("""
SELECT conv_id, CASE WHEN count(*) = 1 THEN min(conv_id * 1000 + turn)::VARCHAR ELSE 'conv.jsonl:' || conv_id END AS request_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS prompt, count(*)::BIGINT AS n_items
FROM conversations GROUP BY conv_id""")
def q_list_combine(spark, sf):
    """Lines that are lists, one item each: a single entry is itself, several are joined."""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.expr(TURNS).alias("t"))
    entry = F.transform("t", lambda m: F.struct((F.col("conv_id") * 1000 + m["turn"]).alias("id"), F.coalesce(m["text"], F.lit("")).alias("prompt")))
    lines = t.select(F.lit("conv.jsonl").alias("source_file"), F.lit("").alias("source_dir"), F.col("conv_id").alias("line_num"), F.to_json(entry).alias("value"))
    r = normalize.requests(normalize.fan_out(normalize.combined(lines)))
    n = F.coalesce(F.size(F.from_json(F.get_json_object("additional_data", "$.items"), "array<string>")), F.lit(-1))
    return r.select(F.col("line_num").alias("conv_id"), "request_id", "prompt", F.when(n < 0, 1).otherwise(n).cast("bigint").alias("n_items"))


# ---------------------------------------------------------------- messages and payloads


@query("""SELECT doc_id, '[{"role":"user","content":"' || source || '/' || doc_id || '"}]' AS messages FROM documents""")
def q_messages_user(spark, sf):
    prompt = F.concat_ws("/", "source", "doc_id")
    return table(spark, sf, "documents").select("doc_id", messages.messages_json(messages.user_message(prompt)).alias("messages"))


_SAID = """string_agg('{"role":' || to_json(role) || ',"content":' || coalesce(to_json(text), 'null') || '}', ',' ORDER BY turn)"""


@query("""SELECT conv_id, '[{"role":"system","content":"Answer briefly."},' || """ + _SAID + """ || ']' AS messages FROM conversations GROUP BY conv_id""")
def q_messages_system(spark, sf):
    return _conversations(spark, sf).select("conv_id", messages.messages_json(messages.with_system("messages", "Answer briefly.")).alias("messages"))


@query("""SELECT conv_id, '[{"role":"system","content":"You help."},' || """ + _SAID + """ || ',{"role":"user","content":"Go on."}]' AS messages FROM conversations GROUP BY conv_id""")
def q_messages_history(spark, sf):
    past = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return _conversations(spark, sf).select("conv_id", messages.messages_json(messages.with_history(F.lit("Go on."), past, "You help.")).alias("messages"))


@query("SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS prompt FROM conversations GROUP BY conv_id")
def q_history_last_user(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(messages.last_user_message("text", "role", "turn").alias("prompt"))


@query("""
SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10) ORDER BY turn) AS prompt
FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id""")
def q_simple_prompt(spark, sf):
    return _conversations(spark, sf).select("conv_id", messages.simple_prompt("messages").alias("prompt"))


@query("SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def q_conversation_flatten(spark, sf):
    return _conversations(spark, sf).select("conv_id", messages.flattened("messages").alias("prompt"))


@query("""
SELECT doc_id, '{"model":"m","messages":[{"role":"user","content":"' || source || '"}],"temperature":0.5,"max_tokens":64,"top_p":1.0,"frequency_penalty":0.0,"presence_penalty":0.0}' AS one,
  '{"model":"m","messages":[{"role":"user","content":"' || source || '"}],"temperature":0.5,"max_tokens":64,"top_p":1.0,"frequency_penalty":0.0,"presence_penalty":0.0,"n":3}' AS three,
  '{"prompt":"User: ' || source || '","max_tokens":64,"temperature":0.5}' AS simple FROM documents""")
def q_openai_payload_n(spark, sf):
    m = messages.user_message("source")
    return table(spark, sf, "documents").select(
        "doc_id", messages.chat_payload(m, "m", 0.5, 64).alias("one"), messages.chat_payload(m, "m", 0.5, 64, rollout_n=3).alias("three"), messages.simple_payload(m, 64, 0.5).alias("simple")
    )


# ---------------------------------------------------------------- additional data


@query("""
SELECT doc_id, (1 + (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT)::BIGINT AS n_fields, lang, source, n_chars FROM documents WHERE text IS NOT NULL""")
def q_additional_data(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    item = F.from_json(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("prompt"), "lang", "source", "n_chars")), "map<string,variant>")
    rest = F.from_json(normalize.additional(item, normalize.Fields()), "map<string,string>")
    return docs.select("doc_id", rest.alias("r")).select("doc_id", F.size("r").cast("bigint").alias("n_fields"), F.col("r")["lang"].alias("lang"), F.col("r")["source"].alias("source"), F.col("r")["n_chars"].cast("bigint").alias("n_chars"))


@query("""SELECT doc_id, CASE WHEN lang IS NOT NULL THEN '{"lang":"' || lang || '"}' END AS additional_data FROM documents""")
def q_metadata_allowlist(spark, sf):
    item = F.from_json(F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", "source")), "map<string,variant>")
    return table(spark, sf, "documents").select("doc_id", normalize.additional(item, normalize.Fields(keep=("lang", "tags"))).alias("additional_data"))


# ---------------------------------------------------------------- images


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN (CASE WHEN page_id % 2 = 0 THEN url END)
  ELSE array_to_string(CASE WHEN len(l) > 0 THEN l END, ' ') END AS images
FROM (SELECT *, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages)""")
def q_image_precedence(spark, sf):
    """Every third page has an image field; on odd ones it is empty and still wins over images."""
    has, p = F.col("page_id") % 3 == 0, table(spark, sf, "pages")
    image = F.when(F.col("page_id") % 2 == 0, F.array("url"))
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return p.select("page_id", F.array_join(images.image_list(has, image, links), " ").alias("images"))


_LINKS = "l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages)"


@query("WITH " + _LINKS + """
SELECT page_id, href, CASE WHEN regexp_matches(href, '^(data:|https?://)') OR starts_with(href, '/') THEN href ELSE 'root/' || (page_id % 5) || '/' || href END AS path,
  CASE WHEN regexp_matches(href, '^(data:|https?://)') THEN href WHEN starts_with(href, '/') THEN 'file://' || href ELSE 'file://root/' || (page_id % 5) || '/' || href END AS url FROM l""")
def q_image_path(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    base = F.concat(F.lit("root/"), (F.col("page_id") % 5).cast("string"))
    return links.select("page_id", "href", images.resolved("href", base).alias("path"), images.reference(F.col("href"), base).alias("url"))


@query("""
SELECT doc_id, name, CASE doc_id % 7 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/webp' WHEN 5 THEN 'image/bmp' END AS media_type,
  doc_id % 7 < 6 AS supported FROM (SELECT doc_id, source || CASE doc_id % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.png' WHEN 3 THEN '.gif' WHEN 4 THEN '.webp' WHEN 5 THEN '.bmp' ELSE '.tiff' END AS name FROM documents)""")
def q_mime(spark, sf):
    suffixes = F.array(*[F.lit(x) for x in (".jpg", ".JPEG", ".png", ".gif", ".webp", ".bmp", ".tiff")])
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.get(suffixes, F.col("doc_id") % 7)).alias("name"))
    return d.select("doc_id", "name", images.media_type("name").alias("media_type"), images.is_supported("name").alias("supported"))


@query("SELECT doc_id, 'data:image/png;base64,' || to_base64(encode(text)) AS uri FROM documents WHERE text IS NOT NULL")
def q_data_uri(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", images.data_uri(F.col("text").cast("binary"), F.lit("image/png")).alias("uri"))


@query("""
WITH l AS (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]+)"', 1) AS links FROM pages)
SELECT page_id, '[' || array_to_string(list_transform(links, lambda x: '{"type":"image_url","image_url":{"url":' || to_json(x) || '}}') || ['{"type":"text","text":' || to_json(url) || '}'], ',') || ']' AS parts FROM l""")
def q_content_parts(spark, sf):
    """Every part: the images in their order, then the text."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.to_json(images.content_parts("url", links)).alias("parts"))


# ---------------------------------------------------------------- names and paths


@query(r"""
SELECT DISTINCT p_type, lower(regexp_replace(regexp_replace(name, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS module
FROM (SELECT p_type, replace(replace(lower(p_type), ' ', ''), 'a', 'JSONLa') AS name FROM part)""")
def q_snake_case(spark, sf):
    d = table(spark, sf, "part").select("p_type").distinct()
    name = F.replace(F.replace(F.lower("p_type"), F.lit(" "), F.lit("")), F.lit("a"), F.lit("JSONLa"))
    return d.select("p_type", snake_case(name).alias("module"))


@query("""
SELECT s_suppkey, name, '10.0.0.' || (s_suppkey % 200) AS ip, (8000 + s_suppkey % 100)::INT AS port
FROM (SELECT s_suppkey, 'server_10.0.0.' || (s_suppkey % 200) || '_' || (8000 + s_suppkey % 100) || CASE WHEN s_suppkey % 5 = 0 THEN '.bak' ELSE '' END AS name FROM supplier) WHERE s_suppkey % 5 <> 0""")
def q_server_parse(spark, sf):
    from ..sources.servers import parsed

    k = F.col("s_suppkey")
    name = F.concat(F.lit("server_10.0.0."), (k % 200).cast("string"), F.lit("_"), (8000 + k % 100).cast("string"), F.when(k % 5 == 0, F.lit(".bak")).otherwise(F.lit("")))
    return parsed(table(spark, sf, "supplier").select("s_suppkey", name.alias("name"))).select("s_suppkey", "name", "ip", "port")


@query("""
SELECT doc_id, 'out/' || source || '/' || coalesce(lang, 'und') || '/conv_result.jsonl' AS output_path, source || '/' || coalesce(lang, 'und') AS source_dir FROM documents""")
def q_output_path(spark, sf):
    from ..sinks.paths import mirrored

    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.coalesce("lang", F.lit("und")), F.lit("conv.jsonl")).alias("source_file"))
    return d.withColumn("source_dir", parent_dir("source_file")).select("doc_id", mirrored("out", F.col("source_file"), F.col("source_dir"), "{source}_result.jsonl").alias("output_path"), "source_dir")


@query("""
SELECT output_path, count(*)::BIGINT AS n_rows FROM (SELECT 'out/' || source || '/' || coalesce(lang, 'und') || '/result.jsonl' AS output_path FROM documents) GROUP BY 1""")
def q_output_groups(spark, sf):
    from ..sinks.paths import mirrored

    d = table(spark, sf, "documents").select(F.concat_ws("/", "source", F.coalesce("lang", F.lit("und")), F.lit("conv.jsonl")).alias("source_file"))
    return d.select(mirrored("out", F.col("source_file"), parent_dir("source_file"), None).alias("output_path")).groupBy("output_path").agg(F.count("*").alias("n_rows"))


@query("SELECT DISTINCT 'a/b/' || source || '.jsonl' AS path, 'a/b' AS folder, source AS stem FROM documents")
def q_path_parts(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("a/b/"), F.col("source"), F.lit(".jsonl")).alias("path")).distinct()
    return d.select("path", parent_dir("path").alias("folder"), file_stem("path").alias("stem"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS shown FROM documents")
def q_console_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", truncated("text", 200).alias("shown"))


@query("""
SELECT 'documents' AS origin, doc_id AS id, length(text)::BIGINT AS chars FROM documents
UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark UNION ALL SELECT 'pages', page_id, length(html) FROM pages""")
def q_union_sources(spark, sf):
    def one(name, ident, text):
        return table(spark, sf, name).select(F.lit(name).alias("origin"), F.col(ident).alias("id"), F.length(text).cast("bigint").alias("chars"))

    return one("documents", "doc_id", "text").unionByName(one("benchmark", "item_id", "text")).unionByName(one("pages", "page_id", "html"))


# ---------------------------------------------------------------- resume


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_resume_anti_id(spark, sf):
    return resume.pending_by_id(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id", "doc_id")


@query("""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d
  WHERE d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber AND d.l_returnflag = 'R')""")
def q_resume_anti_key(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")  # noqa: E741
    out = resume.pending_by_key(l.drop("l_returnflag"), l.where("l_returnflag = 'R'").drop("l_returnflag"), ("l_orderkey", "l_linenumber"))
    return out.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))


@query("""
WITH r AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN user_id % 4 END AS part, event_id // 2 AS line FROM events),
d AS (SELECT * FROM r WHERE event_type = 'purchase')
SELECT event_id FROM r WHERE CASE WHEN part IS NULL THEN NOT EXISTS (SELECT 1 FROM d WHERE d.event_id = r.event_id)
  ELSE NOT EXISTS (SELECT 1 FROM d WHERE d.part = r.part AND d.line = r.line) END""")
def q_resume_hybrid(spark, sf):
    e = table(spark, sf, "events")
    r = e.select("event_id", "event_type", F.when(F.col("event_id") % 3 > 0, F.col("user_id") % 4).alias("part"), F.floor(F.col("event_id") / 2).alias("line"))
    return resume.pending(r, r.where("event_type = 'purchase'"), "event_id", ("part", "line"), "event_id").select("event_id")


@query("SELECT source AS source_file, count(DISTINCT doc_id)::BIGINT AS n_done FROM documents GROUP BY source")
def q_bitmap_count(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("source_file"), F.lit(0).alias("item_idx"), (F.col("doc_id") + 1).alias("line_num"))
    return resume.bitmaps(d).groupBy("source_file").agg(F.sum(F.bitmap_count("bits")).alias("n_done"))


@query("SELECT doc_id, (1 + doc_id // 32768)::BIGINT AS bucket, (doc_id % 32768)::BIGINT AS position FROM documents")
def q_bitmap_position(spark, sf):
    line = F.col("doc_id") + 1
    return table(spark, sf, "documents").select("doc_id", F.bitmap_bucket_number(line).alias("bucket"), F.bitmap_bit_position(line).alias("position"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents x USING (doc_id) WHERE x.source = d.source AND x.doc_id = d.doc_id)")
def q_resume_bitmap(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("source_file"), F.lit(0).alias("item_idx"), (F.col("doc_id") + 1).alias("line_num"), "doc_id")
    done = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return resume.pending_by_bitmap(d, resume.bitmaps(done)).select("doc_id")


@query("SELECT DISTINCT user_id FROM events WHERE event_type <> 'error'")
def q_completed_distinct(spark, sf):
    return table(spark, sf, "events").where("event_type <> 'error'").select("user_id").dropDuplicates(["user_id"])


@query("""
SELECT source_dir, count(*)::BIGINT AS n, min(idx)::BIGINT AS first_idx, max(idx)::BIGINT AS last_idx FROM (
  SELECT source AS source_dir, rank() OVER (ORDER BY source, doc_id) - 1 AS idx FROM documents) GROUP BY 1""")
def q_line_index(spark, sf):
    """Global line numbers over files, from sizes of files alone; lines are numbered within ranges of a file."""
    d = table(spark, sf, "documents").select(F.col("source").alias("source_file"), "doc_id")
    d = chunks.running_total(d, "source_file", F.floor(F.col("doc_id") / 1_000_000), ["doc_id"], F.lit(1), "line_num").withColumn("line_num", F.col("line_num") + 1)
    i = chunks.with_line_index(d)
    return i.groupBy(F.col("source_file").alias("source_dir")).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
