"""What the machine has, its tier, and what follows from it."""

from __future__ import annotations

import os
import shutil
import subprocess
from dataclasses import asdict, dataclass, field

TIERS = ("LOW", "MEDIUM", "HIGH", "WORKSTATION")
# Fixed values by tier: tile edge, registration windows.
TILE_EDGE = dict(zip(TIERS, (512, 1024, 2048, 4096)))
WINDOW_COUNT = dict(zip(TIERS, (9, 16, 25, 25)))


def classify_tier(cores: int, ram_mb: int, gpu: bool) -> str:
    if cores < 4 or ram_mb < 4096:
        return "LOW"
    if cores < 8 or ram_mb < 8192:
        return "MEDIUM"
    return "WORKSTATION" if cores >= 16 and ram_mb >= 32768 and gpu else "HIGH"


@dataclass
class Hardware:
    cores: int
    ram_mb: int
    available_mb: int
    free_disk_mb: int
    gpus: list[str] = field(default_factory=list)

    @property
    def tier(self) -> str:
        return classify_tier(self.cores, self.ram_mb, bool(self.gpus))

    @property
    def workers(self) -> int:
        return {"LOW": 1, "MEDIUM": max(1, self.cores // 2)}.get(self.tier, max(1, self.cores - 1))

    @property
    def tile_size(self) -> int:
        return TILE_EDGE[self.tier]

    @property
    def in_memory_mb(self) -> int:
        return max(64, self.available_mb // 4)

    def to_dict(self) -> dict:
        return asdict(self) | {"tier": self.tier, "workers": self.workers, "tile_size": self.tile_size, "in_memory_mb": self.in_memory_mb}


def _ram_mb() -> tuple[int, int]:
    try:
        import psutil

        m = psutil.virtual_memory()
        return m.total >> 20, m.available >> 20
    except Exception:  # noqa: BLE001  any failure leaves the next way
        try:
            total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 20
            return total, total // 2
        except (ValueError, OSError, AttributeError):
            return 2048, 1024


def _gpus() -> list[str]:
    try:
        out = subprocess.run(["nvidia-smi", "--query-gpu=name", "--format=csv,noheader"], capture_output=True, text=True, timeout=5, check=False)
        return [x.strip() for x in out.stdout.splitlines() if x.strip()] if out.returncode == 0 else []
    except (OSError, subprocess.SubprocessError):
        return []


def detect_hardware(path: str = ".") -> Hardware:
    total, free = _ram_mb()
    try:
        disk = shutil.disk_usage(path).free >> 20
    except OSError:
        disk = 0
    return Hardware(os.cpu_count() or 1, total, free, disk, _gpus())
