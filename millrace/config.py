"""Settings: MILLRACE_ environment variables over a .env file over defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from millrace.errors import ConfigurationError

PREFIX = "MILLRACE_"


@dataclass(frozen=True)
class Settings:
    data_dir: Path = Path("data")
    catalog: str | None = None
    model_host: str = "http://localhost:11434"
    model_timeout: float = 300.0
    concurrency: int = 4
    corpus: str = "OpenSubtitles"
    release: str = "v2024"
    language: str = "en"
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        if not 1 <= self.concurrency <= 64:
            raise ConfigurationError("concurrency must be 1 to 64")
        if self.model_timeout <= 0:
            raise ConfigurationError("model_timeout must be above 0")

    @property
    def catalog_path(self) -> str:
        return self.catalog or str(self.data_dir / "catalog")

    @property
    def downloads_dir(self) -> Path:
        return (self.data_dir / "downloads").resolve()  # Spark and its tasks have working folders of their own

    @property
    def exports_dir(self) -> Path:
        return (self.data_dir / "exports").resolve()


def load(env_file: str | None = ".env") -> Settings:
    values: dict[str, str] = {}
    if env_file and Path(env_file).is_file():
        for line in Path(env_file).read_text().splitlines():
            key, eq, value = line.strip().partition("=")
            if eq and not key.startswith("#"):
                values[key.strip()] = value.strip().strip("\"'")
    values |= os.environ
    kinds = {"data_dir": Path, "model_timeout": float, "concurrency": int}
    try:
        return Settings(**{k: kinds.get(k, str)(values[PREFIX + k.upper()]) for k in Settings.__dataclass_fields__ if PREFIX + k.upper() in values})
    except ValueError as e:
        raise ConfigurationError(str(e)) from e
