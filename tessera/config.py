"""Settings: defaults, then a TOML file, then TESSERA_<SECTION>_<FIELD> variables."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from tessera.errors import ConfigError


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 10
    chunk_size: int = 512
    chunk_overlap: int = 64
    mode: str = "hybrid"
    similarity: str = "cosine"
    duplicate_threshold: float = 0.85
    trade_off: float = 1.0
    rerank_window: int = 50

    def __post_init__(self) -> None:
        if self.top_k < 1 or self.chunk_size < 1 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ConfigError("top_k and chunk_size must be positive, and the overlap below the size")


@dataclass(frozen=True)
class AnswerConfig:
    token_budget: int = 4096
    output_tokens: int = 512
    abstain_threshold: float = 0.0

    def __post_init__(self) -> None:
        if self.token_budget < 0 or self.output_tokens < 1:
            raise ConfigError("token budgets can't be negative")


@dataclass(frozen=True)
class StoreConfig:
    root: str = "tessera-store"
    corpus: str = "default"


@dataclass(frozen=True)
class Config:
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    answer: AnswerConfig = field(default_factory=AnswerConfig)
    store: StoreConfig = field(default_factory=StoreConfig)


_KINDS = {"int": int, "float": float, "str": str}


def build(values: Mapping[str, Mapping[str, object]]) -> Config:
    """A config from sections of fields; unknown ones are errors."""
    config = Config()
    for section, given in values.items():
        if section not in {f.name for f in fields(Config)}:
            raise ConfigError(f"unknown section {section!r}")
        part = getattr(config, section)
        types = {f.name: f.type for f in fields(part)}
        if unknown := set(given) - set(types):
            raise ConfigError(f"unknown fields in {section}: {', '.join(sorted(unknown))}")
        try:
            typed = {k: _KINDS[types[k]](v) for k, v in given.items()}
        except ValueError as e:
            raise ConfigError(f"{section}: {e}") from e
        config = replace(config, **{section: replace(part, **typed)})
    return config


def load(path: str | None = None, env: Mapping[str, str] = os.environ) -> Config:
    values: dict[str, dict[str, object]] = {}
    if path is not None:
        if not Path(path).is_file():
            raise ConfigError(f"no such file: {path}")
        try:
            values = {k: dict(v) for k, v in tomllib.loads(Path(path).read_text()).items()}
        except (tomllib.TOMLDecodeError, TypeError, ValueError) as e:
            raise ConfigError(f"{path}: {e}") from e
    for section in fields(Config):
        for f in fields(section.default_factory):
            key = f"TESSERA_{section.name}_{f.name}".upper()
            if key in env:
                values.setdefault(section.name, {})[f.name] = env[key]
    return build(values)
