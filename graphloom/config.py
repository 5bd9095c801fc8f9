"""Settings out of defaults, a .env file and the environment, in rising order of precedence; arguments beat all."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

from graphloom.schema import IGNORED

PREFIX = "GRAPHLOOM_"


@dataclass
class Settings:
    project_root: str = "."
    data_dir: str = ".graphloom"
    flush_seconds: float = 0.3
    ignored: list[str] = field(default_factory=lambda: list(IGNORED))
    max_iterations: int = 3
    confidence_threshold: float = 0.7
    token_budget: int = 4000
    port: int = 8421


def _env_file(path: str) -> dict[str, str]:
    if not Path(path).is_file():
        return {}
    lines = (line.strip() for line in Path(path).read_text().splitlines())
    return dict(map(str.strip, line.split("=", 1)) for line in lines if "=" in line and not line.startswith("#"))


def load(env_file: str = ".env", **overrides) -> Settings:
    out = Settings()
    known = {f.name: type(getattr(out, f.name)) for f in fields(Settings)}
    for source in (_env_file(env_file), os.environ):
        for name, kind in known.items():
            if (raw := source.get(PREFIX + name.upper())) is not None:
                setattr(out, name, [x.strip() for x in raw.split(",")] if kind is list else kind(raw))
    for name, value in overrides.items():
        if name not in known:
            raise TypeError(f"no setting {name}")
        if value is not None:
            setattr(out, name, value)
    return out
