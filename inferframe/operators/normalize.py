"""From source items to chat requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cost, ids, images, messages

Expr = Callable[[Column], Column]


@dataclass(frozen=True)
class Hooks:
    """Column functions that replace a step. They get the item, a map<string, variant>; transform_prompt also the prompt,
    build_messages the prompt and the item; parse_line, before all of these, gets a line's text and gives JSON text (null drops the line)."""

    skip: Expr | None = None
    request_id: Expr | None = None
    prompt: Expr | None = None
    transform_prompt: Callable[[Column, Column], Column] | None = None
    additional_data: Expr | None = None
    build_messages: Callable[[Column, Column], Column] | None = None
    images: Expr | None = None
    valid_image: Expr | None = None
    dispatch_cost: Callable[[Column, Column], Column] | None = None
    parse_line: Expr | None = None


@dataclass(frozen=True)
class Fields:
    """Names of the fields that a request is built from, and the rules of its format."""

    prompt: str = "prompt"
    id: str = "id"
    image: str = "image"
    images: str = "images"
    multimodal: bool = False
    encode_images: bool = False
    image_base: str | None = None  # None: the folder of the row's file
    drop: str = "null"  # additional data to leave out: null, none or empty (null and "")
    empty_prompt: bool = True  # whether an empty prompt is a prompt
    keep: tuple[str, ...] | None = None  # allow-list of additional data
    hidden: tuple[str, ...] = field(default=())


def parsed_item(raw: str | Column) -> Column:
    """A JSON object as map<string, variant>; of a repeated key the last value counts. Null for anything else."""
    m = F.from_json(raw, "map<string,variant>")
    keys = F.map_keys(m)
    last = F.filter(F.map_entries(m), lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(last)).otherwise(m)


def fenced(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which condition holds, tested on columns as they are. Pushed below them, it would parse each text once more for every column it
    names; no predicate is pushed through a projection that numbers its rows."""
    return df.withColumn("_fence", F.monotonically_increasing_id()).where(condition & (F.col("_fence") >= 0)).drop("_fence")


def text_of(item: Column, name: str) -> Column:
    """A field as text; null where it is missing or null. Objects and lists come as JSON."""
    v = F.try_element_at(item, F.lit(name))
    return F.when(F.is_variant_null(v), None).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def strings_of(item: Column, name: str) -> Column:
    """A field as array<string>; a single string is an array of one."""
    v = F.try_element_at(item, F.lit(name))
    one = F.try_variant_get(v, "$", "string")
    return F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.when(one.isNotNull(), F.array(one)))


def first_present(item: Column, *names: str) -> Column:
    """Text of the first of the fields that isn't null."""
    return F.coalesce(*[text_of(item, n) for n in names])


def nested(item: Column, *names: str) -> Column:
    """The object under the first of these keys that holds one, else the item itself."""
    def inner(n):
        v = F.try_element_at(item, F.lit(n))
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.from_json(F.to_json(v), "map<string,variant>"))
    return F.coalesce(*[inner(n) for n in names], item)


def additional(item: Column, f: Fields) -> Column:
    """What remains of an item, as JSON text; null if nothing does."""
    taken = [f.prompt, f.id, *([f.image, f.images] if f.multimodal else []), *f.hidden]
    rest = F.map_filter(item, lambda k, v: ~k.isin(*taken))
    if f.drop != "none":
        rest = F.map_filter(rest, lambda k, v: ~F.is_variant_null(v))
    if f.drop == "empty":
        rest = F.map_filter(rest, lambda k, v: F.coalesce(F.try_variant_get(v, "$", "string") != "", F.lit(True)))
    if f.keep is not None:
        rest = F.map_filter(rest, lambda k, v: k.isin(*f.keep))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def fan_out(lines: DataFrame, id_field: str = "id") -> DataFrame:
    """Rows of source_file, source_dir, line_num and value to items: a list is one row for each entry, an object is one row.

    n_same counts the items of a line that share the item's id (its content where it has none). Other JSON values and malformed text give no row. An entry that isn't an object is dropped, but counts in positions.
    """
    lines = lines.select("source_file", "source_dir", "line_num", "value", F.col("value").rlike(r"^\s*\[").alias("_list"), F.try_parse_json("value").alias("_v"))
    texts = F.from_json("value", "array<string>")
    objects = F.transform(F.try_variant_get("_v", "$", "array<variant>"), lambda e: F.schema_of_variant(e).startswith("OBJECT"))
    entries = F.when(F.col("_list"), F.transform(F.arrays_zip(texts.alias("t"), objects.alias("o")), lambda e: F.when(F.coalesce(e["o"], F.lit(True)), e["t"])))
    # an object that isn't a variant is malformed, unless it repeats a key
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    twice = F.when(F.col("_v").isNull(), F.size(F.array_distinct(keys)) < F.size(keys))
    lines = lines.withColumn("_raws", F.when(F.col("_list"), F.coalesce(entries, texts)).when(F.col("_v").isNotNull() | twice, F.array("value")))
    lines = fenced(lines, F.size("_raws") > 0)
    several = F.size("_raws") > 1
    names = F.when(several, F.transform("_raws", lambda r: F.coalesce(F.from_json(r, "map<string,string>")[id_field], r)))
    rows = lines.select("source_file", "source_dir", "line_num", "_raws", names.alias("_ids")).select("*", F.posexplode("_raws").alias("item_idx", "raw"))
    own = F.get("_ids", F.col("item_idx"))
    same = F.when(F.col("_ids").isNull(), 1).otherwise(F.size(F.filter("_ids", lambda x: x == own)))
    rows = rows.select("source_file", "source_dir", "line_num", "item_idx", same.alias("n_same"), "raw")
    return rows.where(F.col("raw").rlike(r"^\s*\{"))


def combined(lines: DataFrame, names: tuple[str, ...] = ("text", "prompt"), by: str = " ", prompt: str = "prompt", ident: str = "id") -> DataFrame:
    """Lines whose value is a JSON list, rewritten as one object each: a list of one object is that object, any other becomes {items, id, prompt}.

    The id is {source_file}:{line_num}, the prompt joins the first of the fields names that each entry has as text (an entry without one, or with null, counts as
    empty; one that isn't an object gives nothing). Other lines, empty lists among them, stay as they are but for an empty list, whose prompt is empty.
    """
    listed = F.col("value").rlike(r"^\s*\[")
    entries = F.from_json(F.when(listed, F.col("value")), "array<string>")

    def said(raw: Column) -> Column:
        item = F.from_json(raw, "map<string,string>")
        return F.when(raw.rlike(r"^\s*\{"), F.coalesce(*[F.try_element_at(item, F.lit(n)) for n in names], F.lit("")))

    body = F.to_json(F.struct(F.concat_ws(":", "source_file", F.col("line_num").cast("string")).alias(ident), F.array_join(F.transform(entries, said), by).alias(prompt)))
    whole = F.concat(F.lit('{"items":'), F.col("value"), F.lit(","), F.substring(body, F.lit(2), F.length(body)))
    one = (F.size(entries) == 1) & F.get(entries, F.lit(0)).rlike(r"^\s*\{")
    return lines.withColumn("value", F.when(entries.isNull(), F.col("value")).when(one, F.get(entries, F.lit(0))).otherwise(whole))


def explode_field(items: DataFrame, name: str, prompt: str = "prompt", ident: str = "id", index: str = "_variation_index") -> DataFrame:
    """Fan out over a list field of each item: an entry becomes the prompt, the id gets _var_{i}, other fields stay."""
    item = parsed_item("raw")
    base = F.map_filter(item, lambda k, v: ~k.isin(name, prompt, ident, index))
    rows = items.select("*", F.posexplode_outer(strings_of(item, name)).alias("_i", "_v")).where(F.col("_v").isNotNull())
    own = F.to_json(F.named_struct(F.lit(prompt), F.col("_v"), F.lit(ident), F.concat(text_of(item, ident), F.lit("_var_"), F.col("_i").cast("string")), F.lit(index), F.col("_i")))
    rest = F.to_json(base)
    raw = F.when(F.size(base) > 0, F.concat(F.expr("substring(own, 1, length(own) - 1)"), F.lit(","), F.expr("substring(rest, 2)"))).otherwise(F.col("own"))
    out = rows.withColumn("own", own).withColumn("rest", rest).withColumn("raw", raw)
    return out.withColumn("item_idx", F.col("_i")).drop("_i", "_v", "own", "rest")


def requests(items: DataFrame, fields: Fields = Fields(), hooks: Hooks = Hooks(), parsed: bool = False) -> DataFrame:
    """Source items to REQUEST rows.

    Rows without a prompt go, as do those that hooks.skip holds true for. The id is the id field as text, else a hash of
    the item's content; where several items of a line have the same id, _{item_idx} follows it. additional_data keeps
    every other field. parsed: items have a column item map<string, variant> of their own.
    """
    f, h = fields, hooks
    df = items if parsed else items.withColumn("item", parsed_item("raw"))
    item = F.col("item")
    df = fenced(df, item.isNotNull() if h.skip is None else item.isNotNull() & ~F.coalesce(h.skip(item), F.lit(False)))
    df = df.withColumn("prompt", (h.prompt or (lambda i: text_of(i, f.prompt)))(item))
    df = df.where(F.col("prompt").isNotNull() if f.empty_prompt else F.coalesce(F.col("prompt"), F.lit("")) != "")
    if h.transform_prompt is not None:
        df = df.withColumn("prompt", h.transform_prompt(F.col("prompt"), item))
    given = h.request_id(item) if h.request_id is not None else text_of(item, f.id)
    df = df.withColumn("_given", given)
    # the hash needs Python, which gets the text of rows without an id only; one pass over the source serves both kinds
    hashed = ids.content_hash(F.when(F.col("_given").isNull(), F.col("raw")), f.prompt, f.id)
    df = df.withColumn("request_id", F.coalesce("_given", hashed))
    # siblings of one line that share an id
    twin = (F.col("n_same") > 1) & ~F.col("request_id").endswith(F.concat(F.lit("_"), F.col("item_idx").cast("string")))
    if h.request_id is None:
        df = df.withColumn("request_id", F.when(twin, F.concat("request_id", F.lit("_"), F.col("item_idx").cast("string"))).otherwise(F.col("request_id")))
    df = df.withColumn("additional_data", (h.additional_data or (lambda i: additional(i, f)))(item))
    amount = h.dispatch_cost(F.col("prompt"), item) if h.dispatch_cost is not None else cost.dispatch_cost("prompt", *cost.stated_costs(item))
    if f.multimodal:
        found = h.images(item) if h.images is not None else images.image_list(F.map_contains_key(item, F.lit(f.image)), strings_of(item, f.image), strings_of(item, f.images))
        if h.valid_image is not None:
            found = F.filter(found, h.valid_image)
        found = F.when(F.size(found) > 0, images.ordered(found))
        df = df.withColumn("images", found)
        base = F.lit(f.image_base) if f.image_base is not None else F.coalesce(F.col("source_dir"), F.lit(""))
        urls = F.transform("images", lambda x: images.resolved(x, base) if f.encode_images else images.reference(x, base))
        amount = cost.multimodal_cost(amount, F.greatest(F.size(F.coalesce(urls, F.array().cast("array<string>"))), F.lit(0)))
        shown = messages.multimodal_message(images.content_parts("prompt", urls))
        df = df.withColumn("messages", F.when(F.col("images").isNull(), messages.user_message("prompt")).otherwise(shown) if h.build_messages is None else h.build_messages(F.col("prompt"), item))
    else:
        df = df.withColumn("images", F.lit(None).cast("array<string>"))
        df = df.withColumn("messages", (h.build_messages or (lambda p, _: messages.user_message(p)))(F.col("prompt"), item))
    df = df.withColumn("dispatch_cost", amount.cast("double"))
    return df.select("request_id", "prompt", "messages", "images", "additional_data", "source_file", "source_dir", "line_num", "item_idx", "dispatch_cost")
