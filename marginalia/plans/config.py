"""Retrieval settings: defaults, named profiles, overrides."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


# Names and defaults of the settings that a profile holds.
@dataclass(frozen=True)
class RetrievalConfig:
    retrieve_k: int = 30
    context_k: int = 5
    ai_only: bool = False
    include_moc: bool = False
    dedupe: bool = True
    mmr: bool = False
    mmr_lambda: float = 0.7
    rerank: bool = False
    rerank_candidates: int = 20


# The named profiles.
PROFILES = {
    "code": RetrievalConfig(30, 5, ai_only=True, rerank_candidates=15),
    "math": RetrievalConfig(50, 5, ai_only=True, mmr=True, mmr_lambda=0.7, rerank=True, rerank_candidates=20),
    "reflection": RetrievalConfig(60, 6, mmr=True, mmr_lambda=0.65, rerank=True, rerank_candidates=25),
}


def load_profile(name: str, folder: str | None = None) -> RetrievalConfig:
    """A profile by name, or from ``folder/name.json`` over the defaults; unknown keys are ignored."""
    if folder is None:
        return PROFILES[name]
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        given = json.load(f)
    known = {f.name for f in fields(RetrievalConfig)}
    return RetrievalConfig(**{k: v for k, v in given.items() if k in known})


def override(config: RetrievalConfig, **values: object) -> RetrievalConfig:
    """``config`` with the values that are not None."""
    return replace(config, **{k: v for k, v in values.items() if v is not None})


def from_flags(config: RetrievalConfig, mmr: bool = False, rerank: bool = False, ai_only: bool = False, include_moc: bool = False, no_dedupe: bool = False, **values: object) -> RetrievalConfig:
    """Command-line flags: they switch things on only, and dedupe off only."""
    return override(config, mmr=mmr or None, rerank=rerank or None, ai_only=ai_only or None, include_moc=include_moc or None, dedupe=False if no_dedupe else None, **values)


# The keys of a settings file, all required, and the environment's variables with their defaults.
SETTINGS = {
    "paths": {"vault_dir": "path", "index_dir": "path"},
    "chunking": {"method": "text", "chunk_size": "number", "chunk_overlap": "number"},
    "embeddings": {"provider": "text", "model": "text"},
    "llm": {"provider": "text", "model": "text"},
    "retrieval": {"top_k": "number"},
    "rerank": {"enabled": "switch", "keep_k": "number"},
}
ENVIRONMENT = {
    "VAULT_PATH": "your_vault_path_here",
    "CHROMA_PATH": "./data/chroma",
    "MODE": "local",
    "OLLAMA_BASE_URL": "http://localhost:11434",
    "OLLAMA_MODEL": "llama3.1",
    "OPENAI_API_KEY": "",
}


def whole_path(path: str) -> str:
    """An absolute path, with ``~`` and variables replaced."""
    return os.path.realpath(os.path.expandvars(os.path.expanduser(path)))


def load_settings(path: str = "settings.toml") -> dict[str, dict[str, object]]:
    """Sections and values of a settings file. Without the file or one of its keys it raises; other keys are left out."""
    with open(path, "rb") as f:
        given = tomllib.load(f)
    read = {"path": whole_path, "text": lambda x: x, "number": int, "switch": bool}
    found: dict[str, dict[str, object]] = {}
    for section, keys in SETTINGS.items():
        for key, kind in keys.items():
            if key not in given.get(section, {}):
                raise KeyError(f"{path} lacks {section}.{key}")
            found.setdefault(section, {})[key] = read[kind](given[section][key])
    return found


def from_environment(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """The environment's settings, with defaults for those that are not set."""
    env = os.environ if env is None else env
    return {name: env.get(name, default) for name, default in ENVIRONMENT.items()}
