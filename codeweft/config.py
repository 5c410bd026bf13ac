"""Settings from TOML (S17): a workspace's file over the user's, clamped; a malformed file counts as absent."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """``budget`` tokens (100 at least), days until observations expire, the constants of centrality and ranking."""

    budget: int = 4000
    max_pivots: int = 8
    auto_ttl_days: int = 7
    manual_ttl_days: int | None = None
    centrality_k: float | None = None
    centrality_percentile: float = 0.5
    compress_from: int = 3
    consolidate_at: float = 0.92
    token_usd_per_million: float = 3.0

    def clamped(self) -> Config:
        k = None if self.centrality_k is None else max(1.0, float(self.centrality_k))
        return dataclasses.replace(self, budget=max(100, int(self.budget)), max_pivots=max(1, int(self.max_pivots)), auto_ttl_days=max(1, int(self.auto_ttl_days)), centrality_k=k, centrality_percentile=min(1.0, max(0.0, float(self.centrality_percentile))))


def _read(path: str | None) -> dict:
    try:
        with open(path or "", "rb") as f:
            data = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return {}
    flat = {k: v for k, v in data.items() if not isinstance(v, dict)}
    for section in data.values():
        if isinstance(section, dict):
            flat |= section
    known = {f.name for f in dataclasses.fields(Config)}
    return {k: v for k, v in flat.items() if k in known}


def load(workspace: str | None = None, user: str | None = None) -> Config:
    """The settings of a workspace; ``CODEWEFT_BUDGET`` in the environment wins over both files."""
    merged = _read(user) | _read(os.path.join(workspace, ".codeweft", "config.toml") if workspace else None)
    env = os.environ.get("CODEWEFT_BUDGET", "")
    if env.isdigit():
        merged["budget"] = int(env)
    try:
        return Config(**merged).clamped()
    except (TypeError, ValueError):
        return Config()
