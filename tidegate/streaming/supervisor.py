"""Restarts with backoff, and health from query progress."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery


def backoff(streak: int, initial_ms: int = 100, longest_ms: int = 10_000) -> int:
    return 0 if streak <= 0 else min(longest_ms, initial_ms << min(streak - 1, 40))


def supervised(start: Callable[[], StreamingQuery], attempts: int = 5, timeout_s: float = 120, sleep: Callable[[float], None] = time.sleep, fatal: tuple[str, ...] = ("FailPolicy",)) -> int:
    """Run a query to its end, again after failures with growing pauses; the number of failures. After `attempts` in a row, or a fatal one, the error goes on."""
    failures = 0
    while True:
        query = start()
        try:
            if not query.awaitTermination(timeout_s):
                query.stop()
                raise TimeoutError(f"query still runs after {timeout_s} s")
            return failures
        except TimeoutError:
            raise
        except Exception as e:
            failures += 1
            if failures >= attempts or any(name in str(e) for name in fatal):
                raise
            sleep(backoff(failures) / 1000)


def health(progress: dict | None, now_ms: int, last_progress_ms: int | None, stale_ms: int = 60_000, failures: int = 0) -> dict:
    """Liveness and readiness as a plain record."""
    alive = last_progress_ms is None or now_ms - last_progress_ms <= stale_ms
    return {"live": alive, "ready": alive and progress is not None and failures == 0, "degraded": failures >= 5, "batch": (progress or {}).get("batchId"), "rows": (progress or {}).get("numInputRows")}
