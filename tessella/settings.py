"""Settings: defaults, a file of ``name: value`` lines, then environment variables, the last one winning."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    top_k: int = 3
    min_similarity: float = 0.3
    chars_per_page: int = 50
    vision_at_once: int = 4
    text_at_once: int = 8
    retries: int = 5
    max_tokens: int = 16384


def load(path: str | None = None, environment: dict[str, str] | None = None, prefix: str = "TESSELLA_") -> Settings:
    """Unknown names raise ValueError; blank lines and comments are skipped."""
    said: dict[str, str] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines() if path else ():
        name, mark, value = line.split("#")[0].partition(":")
        if mark:
            said[name.strip()] = value.strip()
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    if unknown := set(said) - set(kinds):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    environment = os.environ if environment is None else environment
    said |= {n: environment[prefix + n.upper()] for n in kinds if prefix + n.upper() in environment}
    return replace(Settings(), **{n: kinds[n](v) for n, v in said.items()})
