"""The period rule against a plain loop, by row, for both ways of reading a key."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfcast.operators import keyed_scan
from shelfcast.operators.keyed_scan import hot_keys, period_openers

SCHEMA = "k string, at_us bigint, id bigint, eligible boolean"


def by_loop(rows, period):
    openers, out = {}, {}
    for key, at, row_id, eligible in sorted(rows, key=lambda r: r[:3]):
        opener = openers.get(key)
        if opener and at - opener[0] >= period:
            opener = None
        if opener is None and eligible:
            opener = (at, row_id)
        openers[key] = opener
        out[row_id] = opener
    return out


def by_spark(spark, rows, period, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    found = period_openers(df, ["k"], period, **how).collect()
    assert len(found) == len(rows)
    return {r.id: (r.opener_us, r.opener_id) if r.opener_id is not None else None for r in found}


def events(seed, n, keys, span, eligible, start=0):
    rnd = random.Random(seed)
    return [(rnd.choice(keys), start + rnd.randrange(span), i, rnd.random() < eligible) for i in range(n)]


WAYS = [
    {"hot_rows": None},
    {"hot_rows": 1, "bands": 1},
    {"hot_rows": 1, "bands": 7},
    {"hot_rows": 1, "bands": 64},
    {"hot_rows": 800, "bands": 16},  # one key in cells, the others whole
]


@pytest.mark.parametrize("how", WAYS, ids=str)
@pytest.mark.parametrize(
    "rows, period",
    [
        (events(1, 2000, "aaaaab", 20_000, 0.8), 97),  # dense, never idle
        (events(2, 2000, "aaaaab", 400_000, 1.0), 1000),  # sparse
        (events(3, 2000, "aaaaab", 300, 0.5), 100),  # many equal times
        (events(4, 1500, "a", 50_000, 0.05, start=-25_000), 500),  # times before the epoch
        (events(5, 1500, "ab", 10**6, 0.9, start=10**15), 10_000),  # times of today's size
        ([("a", i * 7, i, True) for i in range(1000)], 70),  # even steps: chains never meet
        ([("a", i * 7, i, True) for i in range(1000)], 71),
        ([("a", 5, i, i > 3) for i in range(900)], 10),  # all at once
    ],
    ids=["dense", "sparse", "ties", "negative", "large", "even", "odd", "same"],
)
def test_matches_loop(spark, rows, period, how):
    assert by_spark(spark, rows, period, **how) == by_loop(rows, period)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(st.sampled_from("ab"), st.integers(-60, 300), st.booleans()), min_size=1, max_size=80),
    period=st.integers(1, 60),
    bands=st.integers(1, 9),
)
def test_cells_match_loop(spark, rows, period, bands):
    rows = [(k, at, i, eligible) for i, (k, at, eligible) in enumerate(rows)]
    assert by_spark(spark, rows, period, hot_rows=1, bands=bands) == by_loop(rows, period)


def test_openers_are_a_period_apart_and_limits_are_strict(spark):
    rows = [("a", at, i, True) for i, at in enumerate([0, 99, 100, 199, 201, 300])]
    for how in ({"hot_rows": None}, {"hot_rows": 1, "bands": 4}):
        found = by_spark(spark, rows, 100, **how)
        # exactly one period later opens the next one; what lies inside does not prolong it
        assert sorted(i for i, opener in found.items() if opener[1] == i) == [0, 2, 4]


def test_payload_passes_through(spark):
    df = spark.createDataFrame(
        [("a", 0, 1, True, "x", None), ("a", 5, 2, True, None, 2.5)], SCHEMA + ", note string, score double"
    )
    rows = {r.id: r for r in period_openers(df, ["k"], 10).collect()}
    assert (rows[1].note, rows[1].score) == ("x", None)
    assert (rows[2].note, rows[2].score, rows[2].opener_id) == (None, 2.5, 1)


@pytest.mark.parametrize("bands, chunk_cells, span", [(5, 200, 20_000), (3, 10, 3_000)])
def test_many_chunks_are_joined_by_doubling(spark, bands, chunk_cells, span):
    rows = events(7, 900, "aaaaab", span, 0.8)
    assert by_spark(spark, rows, 97, hot_rows=1, bands=bands, chunk_cells=chunk_cells) == by_loop(rows, 97)


def test_every_hot_key_is_cut_and_a_long_list_is_joined(spark, monkeypatch):
    rows = events(6, 1200, "aaabbc", 5_000, 0.9)
    hot = hot_keys(spark.createDataFrame(rows, SCHEMA), ["k"], 10)
    assert sorted((r.k, r.n) for r in hot.collect()) == sorted(Counter(r[0] for r in rows).items())
    monkeypatch.setattr(keyed_scan, "BROADCAST_KEYS", 1)
    assert by_spark(spark, rows, 60, hot_rows=10, bands=8) == by_loop(rows, 60)


def test_reach_is_that_of_a_walk():
    rnd = random.Random(3)
    for n in (1, 2, 9, 300):
        following = np.array([rnd.randint(i + 1, n) for i in range(n)])
        heads = np.array([rnd.random() < 0.1 for _ in range(n)])
        want = heads.copy()
        for i in range(n):
            if want[i] and following[i] < n:
                want[following[i]] = True
        assert keyed_scan.reachable(following, heads).tolist() == want.tolist()


def test_batches_of_far_times_and_keys_that_go_on():
    """Rows of several keys cut anywhere into batches, with spans that do not fit into 64 bits together."""
    rnd = random.Random(5)
    rows = sorted((key, rnd.choice([-(10**18), 0, 4 * 10**18]) + rnd.randrange(400), i, rnd.random() < 0.7) for i, key in enumerate("abcdefg" * 60))
    period, carried, got = 50, None, {}
    at, ids, eligible = (np.array(c) for c in list(zip(*rows))[1:])
    starts = np.array([i == 0 or rows[i][0] != rows[i - 1][0] for i in range(len(rows))])
    for a in range(0, len(rows), 37):
        for x, y in keyed_scan._safe_parts(starts[a : a + 37], at[a : a + 37], period):
            part = slice(a + x, a + y)
            us, by, covered = np.zeros(y - x, np.int64), np.zeros(y - x, np.int64), np.zeros(y - x, bool)
            carried = keyed_scan.judge_range(starts[part], at[part], ids[part], eligible[part], period, carried, us, by, covered)
            got |= {int(i): (int(u), int(o)) if c else None for i, u, o, c in zip(ids[part], us, by, covered)}
    assert got == by_loop(rows, period)


def test_no_hot_keys_no_extra_plan(spark):
    assert hot_keys(spark.createDataFrame([("a", 1, 1, True)], SCHEMA), ["k"], 100) is None
