"""Settings of an analysis: one frozen record, read from a file and overridden by the environment."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """All knobs; paths are absolute once loaded."""

    threads_path: str = ""
    author_threads_csv: str = ""
    user_history_path: str = ""
    outputs: str = ""
    min_comments: int = 50
    max_comments: int | None = 1000
    window_size: int = 10
    support_size: int = 30
    late_windows: int = 3
    window_pool: str = "mean_comments"
    high_quantile: float = 0.8
    low_quantile: float = 0.2
    cluster_distance: float = 0.55
    seed: int = 42
    embedding: dict = field(default_factory=lambda: {"backend": "hashing", "hash_dim": 256})
    title_embedding: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.window_size < 1 or self.support_size < self.window_size or self.late_windows < 1:
            raise ValueError("windows must hold something, and support windows as much as windows")
        if not 0 <= self.low_quantile <= self.high_quantile <= 1:
            raise ValueError("quantiles out of order")
        if self.window_pool not in ("mean_comments", "concat"):
            raise ValueError(f"unknown window_pool {self.window_pool}")


#: Setting -> environment variable that overrides it.
ENVIRONMENT = {"threads_path": "SKEIN_THREADS", "author_threads_csv": "SKEIN_AUTHOR_THREADS", "user_history_path": "SKEIN_USER_HISTORY", "outputs": "SKEIN_OUTPUTS"}


def load(path: str | None = None, environ: dict[str, str] | None = None) -> Settings:
    """Settings of a JSON file (defaults without one); relative paths start at the parent of its folder.

    Unknown names raise ValueError.
    """
    environ = os.environ if environ is None else environ
    held = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    unknown = set(held) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    base = Path(path).resolve().parent.parent if path else Path.cwd()
    for name, variable in ENVIRONMENT.items():
        value = environ.get(variable, "").strip() or held.get(name, "")
        held[name] = value if not value or "://" in value or Path(value).is_absolute() else str((base / value).resolve())
    return Settings(**held)


def title_settings(s: Settings, backend: str | None = None, allow_accelerator: bool = False) -> dict:
    """Embedding settings for titles: the general ones, overridden by those for titles that are set.

    A device other than the processor needs ``allow_accelerator``.
    """
    out = s.embedding | {k: v for k, v in s.title_embedding.items() if v is not None} | ({"backend": backend} if backend else {})
    if str(out.get("device", "cpu")).lower() != "cpu" and not allow_accelerator:
        raise ValueError("a device other than the processor was not allowed")
    return out


def changed(s: Settings, **values) -> Settings:
    return replace(s, **values)


def record(s: Settings) -> dict:
    """What is kept beside results, so that a later run can tell whether they still hold."""
    return asdict(s)
