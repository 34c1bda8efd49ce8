"""Settings, with their ranges, and the ports through which services are plugged in."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

STRATEGIES = ("character", "recursive", "sentence", "token", "markdown", "semantic", "structural", "hierarchical")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be {low}..{high}, not {value}")


@dataclass(frozen=True)
class RetrieveConfig:
    candidate_depth: int = 50
    context_budget: int = 4000
    ef_search: int = 100
    fusion: str = "arithmetic_mean"
    fusion_weight: float = 0.7
    top_k: int = 10
    rerank_model: str = ""

    def __post_init__(self) -> None:
        _within("candidate_depth", self.candidate_depth, 1, 200)
        _within("context_budget", self.context_budget, 500, 16000)
        _within("fusion_weight", self.fusion_weight, 0, 1)
        _within("top_k", self.top_k, 1, 50)


@dataclass(frozen=True)
class GenerateConfig:
    max_output_tokens: int = 2048
    seed: int = 0
    temperature: float = 0.0
    top_p: float = 1.0


@dataclass(frozen=True)
class ParseConfig:
    do_ocr: bool = False
    pipeline: str = "standard"

    def __post_init__(self) -> None:
        if self.pipeline not in ("standard", "vlm"):
            raise ValueError(f"unknown pipeline {self.pipeline}")


@dataclass(frozen=True)
class ChunkConfig:
    max_size: int = 800
    overlap: int = 100
    strategy: str = "semantic"
    contextual_retrieval: bool = False

    def __post_init__(self) -> None:
        _within("max_size", self.max_size, 1, 8000)
        _within("overlap", self.overlap, 0, 4000)
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")


@dataclass(frozen=True)
class Provider:
    id: str
    base_url: str | None = None
    vertex: str | None = None
    models: dict[str, Sequence[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if (self.base_url is None) == (self.vertex is None):
            raise ValueError(f"provider {self.id} needs either base_url or vertex")


def read_providers(path: str | os.PathLike) -> dict[str, Provider]:
    """The [[provider]] entries of a TOML file by id; a repeated id is an error."""
    with open(path, "rb") as f:
        rows = tomllib.load(f).get("provider", [])
    out: dict[str, Provider] = {}
    for r in rows:
        if r["id"] in out:
            raise ValueError(f"provider {r['id']} comes twice")
        out[r["id"]] = Provider(r["id"], r.get("base_url"), r.get("vertex"), r.get("models", {}))
    return out


def resolve_ref(providers: dict[str, Provider], ref: str, role: str) -> tuple[Provider, str]:
    """(provider, model) of 'provider:model', which must serve that role."""
    name, _, model = ref.partition(":")
    provider = providers.get(name)
    if provider is None or not model:
        raise LookupError(f"no provider for {ref}")
    if model not in provider.models.get(role, ()):
        raise LookupError(f"{name} has no {role} model {model}")
    return provider, model


_NOT_CHAT = re.compile("embed|rerank|ranker|imagen|image|veo|video|lyria|tts|audio|aqa|robotics|computer-use|live|realtime", re.IGNORECASE)


def role_allows_model(role: str, model: str) -> bool:
    """By its name alone: whether a model that a provider lists can be meant for a role."""
    if role == "embed":
        return "embed" in model.lower()
    return "rank" in model.lower() and re.search("rerank|ranker", model, re.IGNORECASE) is not None if role == "rerank" else not _NOT_CHAT.search(model)


def providers_for_role(providers: dict[str, Provider], role: str) -> list[Provider]:
    return [p for p in providers.values() if role in p.models]


def list_models_by_role(providers: dict[str, Provider], role: str, ask: Callable[[Provider], Sequence[str]] | None = None) -> list[str]:
    """References 'provider:model' for a role: those configured, and of a provider that names none those that it tells; one
    that can't be asked is left out."""
    out: list[str] = []
    for p in providers_for_role(providers, role):
        names = list(p.models[role])
        if not names and ask is not None:
            try:
                names = [m for m in ask(p) if role_allows_model(role, m)]
            except Exception:  # noqa: BLE001 - a provider that is down must not hide the others
                names = []
        out += [f"{p.id}:{m}" for m in names]
    return out


def assert_served(providers: dict[str, Provider], refs: dict[str, str], ask: Callable[[Provider], Sequence[str]] | None = None) -> str | None:
    """What is wrong with the first reference (by role) that no provider serves; None if all are served."""
    bad = next(((role, ref) for role, ref in refs.items() if ref not in list_models_by_role(providers, role, ask)), None)
    return None if bad is None else f"no {bad[0]} model {bad[1]}"


def model_identity(providers: dict[str, Provider], ref: str) -> tuple[str, str | None]:
    """(provider, base URL) of a reference, for keys under which its results are kept."""
    name, _, model = ref.partition(":")
    if name not in providers or not model:
        raise LookupError(f"no provider for {ref}")
    return name, providers[name].base_url


def default_ref(providers: dict[str, Provider], role: str) -> str | None:
    return next((f"{p.id}:{m}" for p in providers.values() for m in p.models.get(role, ())), None)


def normalize_base_url(url: str) -> str:
    return re.sub(r"/+$", "", url.strip())


class Parser(Protocol):
    def __call__(self, data: bytes) -> list[tuple[str, str | None, int, int | None]]: ...


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def __call__(self, query: str, texts: Sequence[str]) -> list[float]: ...


class Generator(Protocol):
    def __call__(self, question: str, context: str) -> str: ...


CountTokens = Callable[[str], int]
