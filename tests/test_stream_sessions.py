"""Sessions of many pairs: they share state and timers, and what does not fit in memory goes to the state."""

from __future__ import annotations

import random

import pytest

from test_streams import HOUR, MINUTE, in_batches, plain
from vigilframe.streaming import operators as st

BASE = 1_700_000_000_000_000


@pytest.mark.parametrize("most", [3, 1000])
def test_sessions_of_many_pairs(spark, tmp_path, most):
    rng = random.Random(most)
    events = [(f"e{k:04}", BASE + rng.randrange(30 * 60) * MINUTE // 3, rng.choice(["auth.login", "auth.logout"]), f"u{rng.randrange(90)}", f"h{rng.randrange(2)}") for k in range(700)]
    late = sorted(events, key=lambda e: e[1] + rng.randrange(50) * MINUTE)
    batches = [late[:300], late[300:], [("z", BASE + 100 * HOUR, "auth.logout", "end", "end")]]
    timeout = HOUR // 2
    found, kept = in_batches(spark, tmp_path, batches, lambda s: st.open_sessions(s, "1 hour", timeout, most))
    assert sorted(tuple(r) for r in found if r.actor_id != "end") == plain(events, timeout)
    assert kept[-1] <= 2


def test_pairs_share_buckets_and_timers(spark, tmp_path):
    """A bucket of 400 pairs takes a row of state for each shard, not for each pair."""
    events = [(f"e{k}", BASE + k, "auth.login", f"u{k}", "h") for k in range(400)]
    _, kept = in_batches(spark, tmp_path, [events], lambda s: st.open_sessions(s, "1 hour", HOUR))
    assert kept[0] <= st.SHARDS
