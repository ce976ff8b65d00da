"""Settings from a TOML file and the environment."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    data_dir: str = "./data"
    snapshot_dir: str = "snapshots"
    log_dir: str = "log"
    archive_dir: str = "archive"
    keep_snapshots: int = 2
    snapshot_every_versions: int = 1000
    snapshot_every_seconds: int = 300
    compression: str = "zstd"
    compact_ratio: float = 0.3
    log_bucket: int = 1000  # versions in a partition of the log
    delta_ring: int = 1000
    conflict_ring: int = 1000
    max_clients: int = 100
    tick_ms: int = 100

    @classmethod
    def load(cls, path: str | Path | None = None, env: Mapping[str, str] = os.environ, prefix: str = "CAIRN_") -> Config:
        """Defaults, then the file, then the environment's CAIRN_<NAME>."""
        values = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if unknown := set(values) - set(kinds):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        values |= {n: env[prefix + n.upper()] for n in kinds if prefix + n.upper() in env}
        return cls(**{n: kinds[n](v) for n, v in values.items()})

    def save(self, path: str | Path) -> None:
        Path(path).write_text("".join(f"{k} = {v if not isinstance(v, str) else chr(34) + v + chr(34)}\n" for k, v in asdict(self).items()), encoding="utf-8")

    def path(self, name: str) -> str:
        return f"{self.data_dir.rstrip('/')}/{getattr(self, name)}"
