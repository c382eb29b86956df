"""Names of sources, sinks and adapters that configurations use; users add their own."""

from __future__ import annotations

import importlib
import logging
import re
from collections.abc import Callable

_kinds: dict[str, dict[str, Callable]] = {"source": {}, "sink": {}, "adapter": {}}


def register(kind: str, name: str | None = None) -> Callable:
    """Decorator: register a function or class of a kind (source, sink, adapter) under a name, its own by default."""

    def keep(thing: Callable) -> Callable:
        if not callable(thing):
            raise TypeError(f"{thing!r} can't be a {kind}")
        _kinds[kind][name or thing.__name__] = thing
        return thing

    return keep


def register_source(name: str | None = None) -> Callable:
    return register("source", name)


def register_sink(name: str | None = None) -> Callable:
    return register("sink", name)


def register_adapter(name: str | None = None) -> Callable:
    return register("adapter", name)


def snake(name: str) -> str:
    """MyJSONLoader to my_json_loader."""
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"(.)([A-Z][a-z]+)", r"\1_\2", name)).lower()


def get(kind: str, name: str) -> Callable:
    """What is registered under a name; else package.module.Name is imported, and Name from the module whose name is Name in snake case."""
    if name in _kinds[kind]:
        return _kinds[kind][name]
    module, dot, own = name.rpartition(".")
    try:
        loaded = importlib.import_module(module if dot else snake(name))
        return _kinds[kind].get(own) or getattr(loaded, own)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"unknown {kind} {name}: one of {', '.join(sorted(_kinds[kind]))}, or a module's ({e})") from None


def names(kind: str) -> list[str]:
    return sorted(_kinds[kind])


def unregister(kind: str, name: str) -> bool:
    return _kinds[kind].pop(name, None) is not None


def clear(kind: str) -> None:
    _kinds[kind].clear()


def import_modules(modules: list[str]) -> list[str]:
    """Import users' modules, which register what they add; one that fails is reported and skipped. Returns those that were imported."""
    done = []
    for m in modules or ():
        try:
            importlib.import_module(m)
            done.append(m)
        except Exception as e:  # a broken extension mustn't stop jobs that don't use it
            logging.getLogger(__name__).warning("can't import %s: %s", m, e)
    return done
