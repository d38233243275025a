from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planeframe.model import Settings
from planeframe.operators import admission
from planeframe.operators.schema import frames

S = Settings(output_path="x", width=2, height=2, pixel_type="uint8", significant_bits=8, position_count=2, channel_count=2, z_count=3)


def model(rows, capacity):
    """One frame after the other."""
    nexts, out = {}, []
    for position, seq, plane in rows:
        n = nexts.get(position, 0)
        if plane is None:
            ok = capacity is None or n < capacity
            plane = n
        else:
            ok = plane >= n
        out.append((position, seq, plane if ok else None, n))
        if ok:
            nexts[position] = plane + 1
    return sorted(out)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.one_of(st.none(), st.integers(0, 40))), max_size=40), st.sampled_from([0, 4]), st.sampled_from([None, 1, 5]))
def test_against_sequential_model(spark, steps, times, bucket):
    s = replace(S, time_count=times)
    cap = s.capacity
    steps = [(p, None if x is None or (cap and x >= cap) else x) for p, x in steps]
    rows = [(p, k, x) for k, (p, x) in enumerate(steps)]
    data = [(p, k, None if x is None else x // 6, 0 if x is None else x // 3 % 2, 0 if x is None else x % 3) for p, k, x in rows]
    df = spark.createDataFrame(data, "position_index int, seq long, t long, c int, z int")
    got = admission.admitted(df, s, bucket=None if bucket is None else F.call_function("div", F.col("seq"), F.lit(bucket).cast("long")))
    out = sorted((r.position_index, r.seq, r.plane_index if r.accepted else None, r.next_before) for r in got.collect())
    assert [x[:3] for x in out] == [x[:3] for x in model(rows, cap)]
    if not cap:
        assert out == model(rows, cap)
    planes = admission.filled(got.where("accepted"), s)
    for p in (0, 1):
        found = sorted(r.plane_index for r in planes.where(F.col("position_index") == p).collect())
        assert found == list(range(len(found)))


@pytest.mark.parametrize("order", ["TCZ", "ZTC", "CZT"])
def test_coordinates_are_the_inverse(spark, order):
    s = replace(S, time_count=5, acquisition_order=order)
    df = spark.range(30)
    at = admission.plane_coordinates(s, F.col("id"))
    rows = df.select("id", *[at[k].alias(k) for k in "tcz"]).withColumn("back", admission.plane_index(s, F.col("t"), F.col("c"), F.col("z"))).collect()
    assert all(r.id == r.back for r in rows) and len({(r.t, r.c, r.z) for r in rows}) == 30


def test_overflow_raises(spark):
    df = spark.range(1).select(admission.plane_index(S, F.lit(2**62), F.lit(1), F.lit(1)))
    with pytest.raises(Exception, match="(?i)overflow"):
        df.collect()


def test_invalid_frames_do_not_take_planes(spark):
    rows = [(0, 0, None, b"1234"), (0, 1, None, b"123"), (0, 2, None, b"1234"), (5, 3, None, b"1234"), (0, 4, 0, b"1234")]
    df = frames(spark.createDataFrame(rows, "position_index int, seq long, t long, bytes binary"))
    ok, bad = admission.split(df, S)
    assert sorted((r.seq, r.plane_index) for r in ok.collect()) == [(0, 0), (2, 1)]
    assert {r.seq: r.reason for r in bad.collect()} == {1: admission.LAYOUT, 3: admission.OUTSIDE, 4: admission.LATE}


def test_fixture_counts(spark, sf):
    """Known results of the log at the smallest scale."""
    from planeframe.plans.adapter import LOG, ORDER, events

    a = admission.admitted(events(spark, sf), LOG, ORDER)
    got = {r.position_index: (r.n, r.ok) for r in a.groupBy("position_index").agg(F.count("*").alias("n"), F.sum(F.col("accepted").cast("long")).alias("ok")).collect()}
    assert got == {0: (327, 302), 1: (320, 294), 2: (353, 326)}


def test_gap_guard(spark):
    df = spark.createDataFrame([(0, 0, 100, 0, 0)], "position_index int, seq long, t long, c int, z int")
    a = admission.admitted(df, S).where("accepted")
    with pytest.raises(Exception, match="gap of more than"):
        admission.filled(a, S, max_gap=10).collect()
