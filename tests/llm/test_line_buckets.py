"""Entries of buckets, met in small steps and part by part, lead to the same buckets as all at once."""

import numpy as np
import pytest

from terravet.llm import lines


@pytest.mark.parametrize("flush", [1, 24 * 50, 1 << 20])
def test_every_member_meets_one_pivot(spark, flush):
    rng, parts = np.random.default_rng(2), 13
    keys = rng.integers(-(2**62), 2**62, 40)
    rows = [(int(keys[rng.integers(40)]), int(rng.integers(25)), 7) for _ in range(900)]
    blobs = []
    for at in range(0, len(rows), 30):
        by_part = {}
        for r in rows[at : at + 30]:
            by_part.setdefault(int(np.uint64(r[0] & (2**64 - 1)) % np.uint64(parts)), []).append(r)
        blobs += [(p, bytearray(np.array(v, np.int64).tobytes())) for p, v in by_part.items()]
    packed = spark.createDataFrame(blobs, "part int, entries binary")
    name = lambda b: int(np.frombuffer(b, np.int64)[0])
    members, pivots = {}, {}
    for r in lines.buckets(packed, parts, flush).collect():
        members.setdefault(r["key"], set()).add(name(r["id"]))
        pivots.setdefault(r["key"], set()).add(name(r["pivot"]))
    expected = {}
    for key, line, _ in rows:
        expected.setdefault(key, set()).add(line)
    assert all(len(p) == 1 for p in pivots.values())
    assert {k: v | pivots[k] for k, v in members.items()} == {k: v for k, v in expected.items() if len(v) > 1}
    assert all(not pivots[k] & v for k, v in members.items())
