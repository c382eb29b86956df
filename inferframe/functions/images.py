"""Image lists, paths and content parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PART
from .text import col

#: Media types by file suffix (fixed values).
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp"}


def suffix(c: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(c), r"(\.[^./]*)$", 1))


def media_type(c: str | Column) -> Column:
    """Media type by suffix; null for a suffix that isn't known."""
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.try_element_at(known, suffix(c))


def is_supported(c: str | Column) -> Column:
    return suffix(c).isin(*MEDIA_TYPES)


def data_uri(content: Column, media: Column) -> Column:
    """data: URI of binary content, base64 without line breaks."""
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def image_list(has_image: Column, image: Column, images: Column) -> Column:
    """Images of an item. A present image field wins, even if it is empty; an empty list becomes null.

    has_image: whether the key is there; image and images are array<string> (a single string as an array of one).
    """
    chosen = F.when(has_image, image).otherwise(images)
    chosen = F.filter(chosen, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(chosen) > 0, chosen)


def media_paths(media: str | Column) -> Column:
    """Paths of the entries of type image in array<struct<type, path>>."""
    return F.transform(F.filter(col(media), lambda m: m["type"] == "image"), lambda m: m["path"])


def is_remote(c: Column) -> Column:
    return c.rlike("^(data:|https?://)")


def resolved(c: str | Column, base: Column) -> Column:
    """Data and web URLs and absolute paths as they are, others under the base folder."""
    c = col(c)
    return F.when(is_remote(c) | c.startswith("/") | (base == ""), c).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), c))


def reference(c: Column, base: Column) -> Column:
    """URL of an image that isn't encoded."""
    return F.when(is_remote(c), c).otherwise(F.concat(F.lit("file://"), resolved(c, base)))


def ordered(images: Column) -> Column:
    """Ready data: URLs come first, the others after them, each in their order."""
    ready = F.filter(images, lambda x: x.startswith("data:"))
    return F.concat(ready, F.filter(images, lambda x: ~x.startswith("data:")))


def content_parts(prompt: str | Column, urls: Column) -> Column:
    """Message parts: images first, the text last."""
    null_url = F.lit(None).cast("struct<url:string>")
    pictures = F.transform(urls, lambda u: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(u.alias("url")).alias("image_url")))
    text = F.array(F.struct(F.lit("text").alias("type"), col(prompt).alias("text"), null_url.alias("image_url")))
    return F.concat(F.coalesce(pictures, F.array().cast(f"array<{PART}>")), text)
