"""What a long-running host needs around the plans: settings, recent log lines and stage spans, and bounded concurrency."""

from __future__ import annotations

import json
import os
import re
import time
from collections import deque
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

A = TypeVar("A")
B = TypeVar("B")

#: Without these two nothing can be parsed or embedded; all other settings are optional.
REQUIRED = ("DOCUMENT_SERVICE_URL", "PROVIDERS_FILE")
_SECRET = re.compile(r"^(password|token|secret|api_?key|authorization|cookie|request_?body|response_?(body|headers))$", re.IGNORECASE)
_settings: dict[str, object] | None = None


def invariant(holds: object, message: str) -> None:
    if not holds:
        raise AssertionError(f"invariant: {message}")


def configure(**settings: object) -> None:
    """The settings of the process, in place of its environment. The required ones must be there."""
    global _settings
    if missing := [name for name in REQUIRED if not settings.get(name)]:
        raise ValueError(f"settings are missing: {', '.join(missing)}")
    _settings = dict(settings)


def setting(name: str) -> object | None:
    """A setting, of the environment where none were given; a required one that is nowhere is an error where it is read."""
    value = os.environ.get(name) if _settings is None else _settings.get(name)
    if value is None and name in REQUIRED:
        raise LookupError(f"{name} is not set")
    return value


def stubbed() -> bool:
    """Whether models and services are to be stood in for, in tests."""
    return bool(setting("LOOM_STUBS"))


def redacted(value: object) -> object:
    """value with whatever goes by the name of a secret blotted out, at any depth."""
    if isinstance(value, dict):
        return {k: "[redacted]" if _SECRET.match(str(k)) else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, list | tuple) else value


class Ring:
    """The last `size` entries; older ones go."""

    def __init__(self, size: int):
        self._held: deque[dict] = deque(maxlen=size)

    def add(self, **entry: object) -> None:
        self._held.append(redacted(entry) | {"at": time.time()})  # type: ignore[operator]

    def recent(self, limit: int = 200) -> list[dict]:
        return list(self._held)[-limit:]

    def lines(self, limit: int = 200) -> list[str]:
        return [json.dumps(e, ensure_ascii=False, default=str) for e in self.recent(limit)]


LOG, SPANS = Ring(300), Ring(256)


def record_stage(metric: dict, model: str | None = None, cost_estimate: float | None = None) -> None:
    """A span of a stage that runs.meter has timed."""
    SPANS.add(name=f"stage.{metric['stage']}", model=model, cost_estimate=cost_estimate, status="error" if metric.get("error") else "ok", **metric)


def map_pool(items: Iterable[A], limit: int, work: Callable[[A], B]) -> list[B]:
    """work over items, at most limit at a time, results in the items' order. For calls to services from the driver; data
    goes through Spark."""
    todo = list(items)
    with ThreadPoolExecutor(max(1, min(limit, len(todo) or 1))) as pool:
        return list(pool.map(work, todo))
