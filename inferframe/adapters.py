"""How a model server is asked and what its answers mean. Instances travel to executors by pickle."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column

from .functions import messages as m


class Adapter(Protocol):
    def payload(self, messages: Column, options: dict) -> Column:
        """Request body as JSON text, a Column."""
        ...

    def parse(self, response: dict) -> dict:
        """A chat response from the server's answer."""
        ...

    def chat_url(self, base: str) -> str: ...

    def health_url(self, base: str) -> str: ...


@dataclass(frozen=True)
class OpenAIAdapter:
    """Chat completions."""

    headers: tuple[tuple[str, str], ...] = ()

    def payload(self, messages: Column, options: dict) -> Column:
        return m.chat_payload(messages, **options)

    def parse(self, response: dict) -> dict:
        return response

    def chat_url(self, base: str) -> str:
        return f"{base.rstrip('/')}/v1/chat/completions"

    def health_url(self, base: str) -> str:
        return f"{base.rstrip('/')}/health"


@dataclass(frozen=True)
class SimpleAdapter:
    """Plain completion services: one prompt text, one answer text."""

    headers: tuple[tuple[str, str], ...] = ()

    def payload(self, messages: Column, options: dict) -> Column:
        if options.get("rollout_n", 1) != 1:
            raise ValueError("several choices need the chat-completion adapter")
        return m.simple_payload(messages, options.get("max_tokens", 1000), options.get("temperature", 0.7))

    def parse(self, response: dict) -> dict:
        said = next((response[k] for k in ("text", "completion", "output") if response.get(k)), "")
        tokens = next((response[k] for k in ("tokens_used", "tokens") if response.get(k)), 0)
        return {"choices": [{"message": {"role": "assistant", "content": said}, "finish_reason": "stop"}], "usage": {"total_tokens": tokens}}

    def chat_url(self, base: str) -> str:
        return f"{base.rstrip('/')}/generate"

    def health_url(self, base: str) -> str:
        return f"{base.rstrip('/')}/status"
