"""Intervals of any length against merging one by one."""

import random

from framewright.operators.intervals import periods_and_gaps


def brute(rows):
    out = set()
    for e in {r[0] for r in rows}:
        found = []
        for a, b in sorted((a, b) for k, a, b in rows if k == e and a <= b):
            if found and a <= found[-1][1]:
                found[-1][1] = max(found[-1][1], b)
            else:
                found.append([a, b])
        out |= {(e, "period", a, b) for a, b in found} | {(e, "gap", p[1], q[0]) for p, q in zip(found, found[1:])}
    return out


def test_intervals_of_any_length(spark):
    rng = random.Random(11)
    bucket = 1 << 21  # milliseconds of a bucket of the first level
    rows = []
    for e in "abcdefgh":
        for _ in range(60):
            a = rng.choice([rng.randint(-50, 50), rng.randint(-3, 3) * bucket + rng.randint(-2, 2), rng.randint(-(10**13), 10**13), rng.randint(-5, 5) * bucket * (1 << 22) + rng.randint(-2, 2)])
            rows.append((e, a, a + rng.choice([0, 1, rng.randint(0, 100), bucket, 3 * bucket - 1, rng.randint(0, 40) * bucket, bucket * (1 << 22), rng.randint(0, 10**12)])))
    rows += [("long", -(10**15), 10**15), ("long", 2 * 10**15, 2 * 10**15), ("long", 5, 6), ("longer", -(1 << 52), 1 << 52)]
    df = spark.createDataFrame([(e, float(a), float(b)) for e, a, b in rows], "e string, a double, b double")
    got = {tuple(r) for r in periods_and_gaps(df, "e", "a", "b", unit_ms=1.0).collect()}
    assert got == brute(rows)


def test_bounds_out_of_range_count_for_nothing(spark):
    df = spark.createDataFrame([("a", 0.0, 1e30), ("a", float("nan"), 1.0), ("a", float("-inf"), 1.0), ("b", -1e18, 1e18)], "e string, a double, b double")
    assert {tuple(r) for r in periods_and_gaps(df, "e", "a", "b", unit_ms=1.0).collect()} == {("b", "period", -(10**18), 10**18)}
