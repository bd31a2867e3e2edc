"""What a finished task had goes back to the machine."""

import numpy as np

from lodestead.llm.frames import give_back, map_batches


def resident():
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(line.split()[1]) for line in f if line.startswith("Rss")) / 1024


def test_freed_memory_is_given_back():
    held = [np.ones(8000) for _ in range(4000)]
    last = held[-1]
    full = resident()
    del held
    give_back()
    assert resident() < full - 200
    assert last[0] == 1


def test_rows_are_unchanged(spark):
    rows = map_batches(spark.range(2500).select("id"), lambda batches: ({"id": b.column(0)} for b in batches), "id long")
    assert sorted(r["id"] for r in rows.collect()) == list(range(2500))
