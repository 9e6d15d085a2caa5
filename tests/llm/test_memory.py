"""What a Python worker takes at once, and what it keeps after a task."""

import re
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from kinweave.llm import common, setjoin, simhash


def sorted_rows(names, n, run):
    """Batches of n rows sorted by the first column, in runs of about `run` equal ones."""
    r = np.random.default_rng(1)
    k = np.sort(r.integers(0, n // run, n))
    for at in range(0, n, 10_000):
        part = k[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(r.integers(1, 1 << 40, len(part))) for _ in names[1:]]], names=names)


@pytest.mark.parametrize(
    ("run", "names", "most"),
    [
        (simhash._emit_links(["f0", "f1"], "row", simhash.REACH, 1 << 16, 8, True), ["k", "f0", "f1", "row"], 50e6),
        (setjoin._meet(0.8, 64, 1 << 16), setjoin.COLUMNS, 35e6),
    ],
    ids=["links", "pairs"],
)
def test_sorted_rows_are_worked_off_in_small_chunks(run, names, most):
    rows = list(sorted_rows(names, 700_000, 4))
    tracemalloc.start()
    try:
        for _ in run(iter(rows)):
            pass
        assert tracemalloc.get_traced_memory()[1] < most
    finally:
        tracemalloc.stop()


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_task_hands_its_memory_back():
    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

    def run(batches):
        for n in batches:
            held = [np.ones(1 << 12) for _ in range(n)]  # 32 KB each, from the heap; the last one stays and keeps the rest there
            kept.append(held[-1])
            del held
            yield n

    kept: list = []
    before = anonymous()
    assert list(common.lean(run)(iter([4096, 4096]))) == [4096, 4096]
    assert anonymous() - before < 24
