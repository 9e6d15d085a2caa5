"""Wall-clock log of runs: timestamp,label,phase,time_ms,time_s,success. The phase is `job` for what Spark
runs and `total` for all of a command."""

from __future__ import annotations

import csv
import os
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

HEADER = ["timestamp", "label", "phase", "time_ms", "time_s", "success"]
ENVIRONMENT = "KINWEAVE_TIMING_FILE"


def append(label: str, phase: str, seconds: float, success: bool, path: str | None = None) -> None:
    """Add a row, with a header in a new file. A log that can't be written never stops a run."""
    named = os.environ.get(ENVIRONMENT, "")
    target = path or (named if named.strip() else "task_times.csv")
    row = [datetime.now().isoformat(timespec="seconds"), label, phase, round(seconds * 1000), f"{seconds:.3f}", int(success)]
    try:
        fresh = not os.path.exists(target) or os.path.getsize(target) == 0
        with open(target, "a", newline="") as out:
            csv.writer(out).writerows([HEADER, row] if fresh else [row])
    except OSError as e:
        print(f"timing log not written: {e}")


@contextmanager
def timed(label: str, phase: str = "total", path: str | None = None) -> Iterator[None]:
    """Log how long the block took and whether it ended well."""
    start, success = time.monotonic(), False
    try:
        yield
        success = True
    finally:
        seconds = time.monotonic() - start
        kind = "total_" if phase == "total" else ""
        print(f"{label} {kind}time_ms={round(seconds * 1000)} {kind}time_s={seconds:.3f}")
        append(label, phase, seconds, success, path)
