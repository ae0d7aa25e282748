"""Orchestration: stage fingerprints, staleness, timing and guarded evaluation."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

log = logging.getLogger("framewright")


def fingerprint(params: dict) -> str:
    """Short digest of the settings a stage depends on, whatever their order."""
    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:12]


class Stages:
    """Which stages must run again, and how long they took; kept as one JSON file that is replaced by a swap."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def load(self) -> dict:
        """The record by stage; a missing or broken file reads as empty."""
        try:
            return json.loads(self.path.read_text())
        except (OSError, ValueError):
            return {}

    def _store(self, stage: str, **fields) -> None:
        record = self.load()
        record[stage] = record.get(stage, {}) | fields
        new = self.path.with_suffix(".new")
        new.write_text(json.dumps(record, sort_keys=True))
        new.replace(self.path)

    def stale(self, stage: str, outputs: list[str | Path], params: dict, force: bool = False, upstream: bool = False) -> bool:
        """Whether to run: forced, run upstream, an output is missing, or the settings are new or changed."""
        known = self.load().get(stage, {}).get("fingerprint")
        return force or upstream or any(not Path(o).exists() for o in outputs) or known != fingerprint(params)

    @contextmanager
    def run(self, stage: str, params: dict | None = None, network: bool = False) -> Iterator[None]:
        """Times a stage and records it, with its fingerprint, only if it succeeds."""
        began = time.monotonic()
        yield
        self._store(stage, seconds=round(time.monotonic() - began, 3), network=network, fingerprint=fingerprint(params or {}))


def guarded(jobs: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Results by name; a job that fails is logged and gives None, the others still run."""
    out: dict[str, object] = {}
    for name, job in jobs.items():
        try:
            out[name] = job()
        except Exception:  # noqa: BLE001 - one report must not take the others down
            log.exception("%s failed", name)
            out[name] = None
    return out
