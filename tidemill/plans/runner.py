"""A plain stage runner: bounded retries, one run at a time."""

from __future__ import annotations

import time
from collections.abc import Callable

from ..sources.files import Files


class AlreadyRunning(RuntimeError):
    """Another run of the pipeline holds its lock."""


def run_stages(stages: list[tuple[str, Callable[[], object]]], *, retries: int = 2, delay_s: float = 120, files: Files | None = None, lock: str | None = None, sleep=time.sleep) -> dict[str, object]:
    """Runs stages in order; a stage is tried ``retries`` times more before the run fails."""
    if lock and not files.create(lock, "running"):
        raise AlreadyRunning(lock)
    results: dict[str, object] = {}
    try:
        for name, stage in stages:
            for attempt in range(retries + 1):
                try:
                    results[name] = stage()
                    break
                except Exception:
                    if attempt == retries:
                        raise
                    sleep(delay_s)
    finally:
        if lock:
            files.delete(lock)
    return results
