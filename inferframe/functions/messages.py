"""Chat messages and request payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PART
from .text import col


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"), F.lit(None).cast(f"array<{PART}>").alias("parts"))


def user_message(prompt: str | Column) -> Column:
    return F.array(message("user", col(prompt)))


def multimodal_message(parts: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("content"), parts.alias("parts")))


def with_system(messages: str | Column, system: str | None) -> Column:
    """The system prompt in front, if there is one."""
    return F.concat(F.array(message("system", F.lit(system))), col(messages)) if system else col(messages)


def with_history(prompt: str | Column, history: str | Column, system: str | None = None) -> Column:
    """History (array of role and content) before the user's prompt."""
    past = F.transform(F.coalesce(col(history), F.array().cast("array<struct<role:string,content:string>>")), lambda m: message(m["role"], m["content"]))
    return with_system(F.concat(past, user_message(prompt)), system)


def messages_json(messages: str | Column) -> Column:
    """JSON as the chat endpoint takes it: content is the text, or the parts."""
    rendered = F.transform(
        col(messages),
        lambda m: F.concat(
            F.lit('{"role":'), _quoted(m["role"]), F.lit(',"content":'),
            F.coalesce(F.to_json(m["parts"]), _quoted(m["content"]), F.lit("null")), F.lit("}"),
        ),
    )
    return F.concat(F.lit("["), F.array_join(rendered, ","), F.lit("]"))


def _quoted(c: Column) -> Column:
    """A JSON string; null stays null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def simple_prompt(messages: str | Column) -> Column:
    """Lines "Role: text" of system, user and assistant messages; other roles are left out."""
    known = F.filter(col(messages), lambda m: m["role"].isin("system", "user", "assistant"))
    return F.array_join(F.transform(known, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def flattened(messages: str | Column) -> Column:
    """Lines "role: text" of all messages."""
    return F.array_join(F.transform(col(messages), lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def last_user_message(text: str | Column, role: str | Column, turn: str | Column) -> Column:
    """Aggregate: the text of the user's last turn."""
    user = col(role) == "user"
    return F.max_by(F.when(user, col(text)), F.when(user, col(turn)))


def chat_payload(messages: str | Column, model: str = "default", temperature: float = 0.7, max_tokens: int = 1000, top_p: float = 1.0, frequency_penalty: float = 0.0, presence_penalty: float = 0.0, rollout_n: int = 1) -> Column:
    """Body of a chat-completion request as JSON text; n only when several choices are asked for."""
    rest = F.to_json(
        F.struct(
            F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), F.lit(top_p).alias("top_p"),
            F.lit(frequency_penalty).alias("frequency_penalty"), F.lit(presence_penalty).alias("presence_penalty"), *([F.lit(rollout_n).alias("n")] if rollout_n > 1 else []),
        )
    )
    return F.concat(F.lit('{"model":'), _quoted(F.lit(model)), F.lit(',"messages":'), messages_json(messages), F.lit(","), F.substring(rest, 2, 1 << 30))


def simple_payload(messages: str | Column, max_tokens: int = 1000, temperature: float = 0.7) -> Column:
    return F.to_json(F.struct(simple_prompt(messages).alias("prompt"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature")))


