"""Source mixing, conversation repair and vector codes against plain forms, on small tables with nulls, ties, repeats, long rows and clashing columns."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from vigilframe.llm import dualtree, mixing, repair  # noqa: E402


def same(found, wanted):
    def order(r):
        return tuple((x is None, str(x)) for x in r)

    assert sorted(map(tuple, found), key=order) == sorted(map(tuple, wanted), key=order)


# --- mixing


def mixed_rows():
    rng = random.Random(2)
    rows = []
    for k, (source, n) in enumerate([("web", 900), ("Books", 40), ("é", 7), (None, 25), ("tiny", 1), ("none", 4)]):
        for i in range(n):
            size = 0 if source == "none" else rng.choice([1, 2, 3, 5, 8, 40, 41, 300]) if source != "tiny" else 60_000
            rows.append((k * 10_000 + i, " ".join(["w"] * size), source))
    rows += [(1, "a b c", "web")] * 30 + [(None, "x y", "web"), (None, None, "web"), (2, "", "web"), (3, " \x1d\t ", None)]
    return rows


def test_mixing(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "doc_id long, text string, source string, size long, bucket int, target double")
    found = mixing.mixture(docs.repartition(5)).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.SPACED.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    wanted = dict(zip(order, brute.targets([sizes[s] for s in order]), strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in found) == sorted((d is None, d or 0, len(brute.SPACED.findall(t or ""))) for d, t, _ in rows)
    by = {}
    for d, t, s in rows:
        by.setdefault((d, len(brute.SPACED.findall(t or ""))), s)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        s = by[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(wanted[s], rel=1e-12) and (r.taken == 0 if not r.size else r.taken % r.size == 0) and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert sum(wanted.values()) == pytest.approx(sum(sizes.values()))
    for s, n in taken.items():  # to the word, where single words are there; else as near as whole texts come
        assert abs(n - wanted[s]) <= (30_000 if s == "tiny" else 0.5 if s in ("web", "Books", None) else 4)
    again = mixing.mixture(docs.repartition(2).orderBy("text")).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_budget_is_met_where_it_can_be():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.unique(rng.integers(0, 30, 6))
        counts = rng.integers(1, 4, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, 4 * total + 2))
        copies = mixing.plan(lengths, counts, budget, window=8)
        assert (copies >= 0).all() and (copies <= 3 * counts).all()
        free = mixing.plan(lengths, counts, budget)  # one dynamic program over what proportional copies leave
        base = np.where(lengths > 0, counts * min(budget, 3 * total) // max(total, 1), 0)
        sums = {0}
        for size, n in zip(lengths.tolist(), (3 * counts - base).tolist(), strict=True):
            sums = {s + size * k for s in sums for k in range(n + 1)}
        rest = min(budget, 3 * total) - int((lengths * base).sum())
        assert abs(int((lengths * free).sum()) - min(budget, 3 * total)) == min(abs(s - rest) for s in sums)


def test_long_documents_and_large_budgets():
    lengths, counts = np.array([7, 30_000, 1_000_000, 5_000_000]), np.array([10, 3, 400, 2])
    for budget in (3, 40_000, 123_456_789, 410_090_070, 900_000_000):
        copies = mixing.plan(lengths, counts, budget)
        assert (copies <= 3 * counts).all() and abs(int((lengths * copies).sum()) - budget) <= 500_000


# --- conversations


def talk():
    rng = random.Random(6)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]) if conv % 3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "cut off", "", " \x0b", None, "Why? ", f"t{rng.randrange(9)}.", "É…"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), role, text))
    rows += [(500, t, ("user", "assistant")[t % 2] if t % 97 else "tool", f"row {t}{'.' if t % 13 else ''}") for t in range(1500)]  # longer than a block
    rows += [(501, t % 5, "user", f"same turn {t}.") for t in range(700)]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (-7, -(2**60), "user", "a."), (-7, 2**60, "assistant", "b.")]
    rows += [(502, 4, "user", "twice.")] * 3
    return rows


def test_repairs(spark):
    rows = talk()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, found int, audit string")
    wanted = brute.repairs(rows)
    for parts in (4, 23):  # few and many sort ranges: long conversations meet again from other blocks
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 4)
        try:
            same(repair.repairs(table.repartition(7)).collect(), wanted)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert repair.repairs(table.limit(0)).count() == 0


def test_dropped_conversation_has_zeros(spark):
    import hashlib

    gone = next(i for i in range(10_000) if not brute.damage(i, 0, "user", "x"))
    row = repair.repairs(spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_blocks_join_to_the_whole():
    rng = random.Random(9)
    for _ in range(200):
        codes = [rng.choice("sua?") + rng.choice("...tx") for _ in range(rng.randint(0, 14))]
        cuts = sorted(rng.choices(range(len(codes) + 1), k=3))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
        blocks = [list(repair.block_items("".join(p), (0,) if not k else (0, 1, 2, 3))) for k, p in enumerate(parts)]
        assert repair.joined(blocks) == repair.repaired("".join(codes))


# --- vector codes


def vectors(n, width=32, seed=3):
    rng = np.random.default_rng(seed)
    out = [(int(i), rng.normal(0, 0.3, width).astype(np.float32).tolist(), int(i) % 4) for i in rng.permutation(n)]
    out += [(i, out[0][1], None) for i in range(n, n + 40)]  # copies
    out += [(n + 50, None, 1), (n + 51, [], 1), (n + 52, [None, *out[0][1][1:]], 1), (n + 53, [float("nan"), *out[0][1][1:]], 1), (n + 54, [*out[0][1][1:], float("inf")], 1)]
    return [*out, (3, out[7][1], 2), (None, out[8][1], 2), (n + 60, [-(2.0**20)] * width, 5)]


def test_vector_codes(spark):
    rows = vectors(700)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(5)
    same(dualtree.compressed(table).collect(), brute.vector_codes(rows))
    few = rows[:9]
    same(dualtree.compressed(table.limit(0).union(spark.createDataFrame([(*r, "x", 1) for r in few], table.schema))).collect(), brute.vector_codes(few))
    assert dualtree.compressed(table.limit(0)).count() == 0
    assert dualtree.compressed(table.where("embedding IS NULL")).count() == 0


def test_other_lengths_go(spark):
    rows = [(1, [0.5] * 32, 0), (2, [0.5] * 16, 0), (3, [0.25] * 32, 0), (4, [1.0] * 17, 0)]
    out = dualtree.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(r.vec_id for r in out) == [1, 3]


@pytest.mark.parametrize(("n", "k", "d", "spread"), [(1, 1, 4, 9), (5, 3, 4, 3), (500, 64, 4, 200), (3000, 64, 4, 40), (2000, 37, 3, 4), (1000, 64, 1, 30)])
def test_dual_tree_equals_all_distances(n, k, d, spread):
    rng = np.random.default_rng(n + k)
    points, entries = rng.integers(-spread, spread, (5, n, d)), rng.integers(-spread, spread, (5, k, d))  # many ties
    dist = ((points[:, :, None] - entries[:, None]) ** 2).sum(-1)
    code, error = dualtree.assign(points, entries)
    assert (code == dist.argmin(2)).all() and (error == dist.min(2)).all()
    count, sums = dualtree.assign(points, entries, want="sums")
    for p in range(5):
        assert (count[p] == np.bincount(code[p], minlength=k)).all()
        assert all((sums[p, e] == points[p][code[p] == e].sum(0)).all() for e in range(k))
