"""Settings of a service, read from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass
class Config:
    """Where the tables and packs are, how streams flush, how long entries stay, and what counts as a correlation."""

    data_dir: str = "/var/lib/emberlog"
    flush_interval_ms: int = 500
    files_per_batch: int = 1000
    batch_bytes: int = 256 << 20
    entry_idle_ms: int = 2000
    retention_days: int = 30
    window_seconds: int = 2
    min_confidence: float = 0.7
    late_seconds: int = 10
    syslog_port: int = 1514
    otlp_port: int = 4318

    @property
    def logs(self) -> str:
        return f"{self.data_dir}/logs"

    @property
    def correlations(self) -> str:
        return f"{self.data_dir}/correlations"

    @property
    def alerts(self) -> str:
        return f"{self.data_dir}/alerts"

    @property
    def rule_pairs(self) -> str:
        return f"{self.data_dir}/rule_pairs"

    @property
    def spool(self) -> str:
        return f"{self.data_dir}/spool"

    @property
    def packs(self) -> str:
        return f"{self.data_dir}/packs"

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Settings of a file; what it doesn't name has its default, what isn't a setting is refused."""
        given = tomllib.loads(Path(path).read_text())
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
        return cls(**given)

    def save(self, path: str | Path) -> None:
        shown = lambda v: f'"{v}"' if isinstance(v, str) else str(v)
        Path(path).write_text("".join(f"{f.name} = {shown(getattr(self, f.name))}\n" for f in fields(self)))
