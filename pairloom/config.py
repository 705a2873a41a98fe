"""Settings in a JSON file, and a rotating log."""

from __future__ import annotations

import json
import logging
import os
import sys
from dataclasses import asdict, dataclass, field, fields, replace
from logging.handlers import RotatingFileHandler
from pathlib import Path
from threading import Lock

from pairloom.errors import ConfigError

RECENT = 20


def default_config_dir() -> Path:
    base = os.environ.get("APPDATA") if sys.platform == "win32" else os.environ.get("XDG_CONFIG_HOME")
    return (Path(base) if base else Path.home() / ".config") / "pairloom"


@dataclass(frozen=True)
class Settings:
    language: str = "en"
    theme: str = "dark"
    log_level: str = "INFO"
    max_workers: int = 0
    tile_size: int = 0
    memory_limit_mb: int = 0
    last_directory: str = ""
    recent_files: list[str] = field(default_factory=list)

    def validate(self) -> None:
        if self.language not in ("en", "ar") or self.theme not in ("dark", "light") or self.log_level not in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"):
            raise ConfigError("language, theme or log level is unknown")
        if min(self.max_workers, self.tile_size, self.memory_limit_mb) < 0:
            raise ConfigError("numbers must not be negative")


class SettingsFile:
    def __init__(self, path: Path | None = None) -> None:
        self.path, self._lock = path or default_config_dir() / "config.json", Lock()

    def load(self) -> Settings:
        """Unknown keys are passed over; a missing file gives the defaults."""
        if not self.path.exists():
            return Settings()
        try:
            raw = json.loads(self.path.read_text("utf-8"))
            out = Settings(**{k: v for k, v in raw.items() if k in {f.name for f in fields(Settings)}})
        except (ValueError, TypeError, AttributeError) as e:
            raise ConfigError(f"{self.path} can't be read: {e}") from e
        out.validate()
        return out

    def save(self, settings: Settings) -> None:
        settings.validate()
        with self._lock:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            part = self.path.with_suffix(".part")
            part.write_text(json.dumps(asdict(settings), ensure_ascii=False, indent=2), "utf-8")
            part.replace(self.path)

    def update(self, **changes: object) -> Settings:
        unknown = set(changes) - {f.name for f in fields(Settings)}
        if unknown:
            raise ConfigError(f"unknown settings {sorted(unknown)}")
        out = replace(self.load(), **changes)
        self.save(out)
        return out

    def opened(self, file: str) -> Settings:
        """Newest first, each once, RECENT at most."""
        return self.update(recent_files=[file, *(x for x in self.load().recent_files if x != file)][:RECENT])


def setup_logging(directory: Path | None = None, level: str = "INFO") -> logging.Logger:
    log = logging.getLogger("pairloom")
    log.setLevel(level)
    if not log.handlers:
        folder = directory or default_config_dir() / "logs"
        folder.mkdir(parents=True, exist_ok=True)
        file = RotatingFileHandler(folder / "pairloom.log", maxBytes=5 << 20, backupCount=3, encoding="utf-8")
        file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(file)
        log.addHandler(logging.StreamHandler())
    return log


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(f"pairloom.{name}")
