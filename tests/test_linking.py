import itertools
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from colloquy import config as c
from colloquy.operators import kernels, linking
from colloquy.plans.meetings import link_passes
from colloquy.schemas import LOCAL_SEGMENTS, NODES, WINDOWS


def test_assignment_is_the_first_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = sorted(rng.integers(1, 6, 2).tolist())
        cost = rng.integers(0, 4, (n, m)).astype(float)
        best = min(itertools.permutations(range(m), n), key=lambda p: (sum(cost[i, j] for i, j in enumerate(p)), p))
        assert tuple(kernels.assign(cost)) == best
    cost = rng.random((9, 15))
    exact = kernels._augment(cost[:4, :6])
    assert np.isclose(cost[np.arange(4), exact].sum(), min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(6), 4)))
    assert len(set(kernels.assign(cost))) == 9 and (kernels.assign(np.array([[1.0], [0.0]])) == [-1, 0]).all()


def slow_link(d, count, limit):
    groups = [{i} for i in range(len(d))]
    while len(groups) > (count or 1):
        s, i, j = min((np.mean([d[a, b] for a in groups[i] for b in groups[j]]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if limit is not None and s > limit:
            break
        groups[i] |= groups.pop(j)
    return [next(k for k, g in enumerate(groups) if i in g) for i in range(len(d))]


def test_average_link_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        d = rng.random((7, 7))
        d = (d + d.T) / 2
        for count, limit in ((3, None), (None, 0.5), (None, 0.0), (None, 2.0)):
            assert kernels.average_link(d, clusters=count, limit=limit).tolist() == slow_link(d, count, limit)


def test_cosine_distances_with_zero_rows():
    a = np.array([[0.0, 0.0], [1.0, 0.0]])
    assert kernels.cosine_distances(a, a).tolist() == [[0, 1], [1, 0]]


def meeting(name, seconds, *, voices=2, noise=0.01, seed=1):
    """Alternating speakers every 12 s on two grids; local numbers start anew in each window."""
    rng = np.random.default_rng(seed)
    talk, at, k = [], 0.0, 0
    while at + 10 < seconds:
        talk.append((at + 2, at + 10, k % voices))
        at, k = at + 12, k + 1
    windows, local, nodes = [], [], []
    for grid, cuts in (("A", [*np.arange(0, seconds, 30.0).tolist(), seconds]), ("B", [0.0, *np.arange(15.0, seconds, 25.0).tolist(), seconds])):
        for ci, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            windows.append((name, grid, ci, float(s), float(e)))
            order: list[int] = []
            per: dict[int, float] = {}
            for a, b, v in talk:
                x, y = max(a, s), min(b, e)
                if y - x > 0.2:
                    if v not in order:
                        order.append(v)
                    local.append((name, grid, ci, order.index(v) + 1, order.index(v) + 1, len(local), float(x - s), float(y - s), f"v{v}"))
                    per[v] = per.get(v, 0.0) + y - x
            for v, total in per.items():
                emb = np.eye(24)[v] + rng.normal(0, noise, 24)
                nodes.append((name, grid, ci, order.index(v) + 1, order.index(v) + 1, total, total >= 0.5, total, emb.tolist() if total >= 0.5 else None, emb.tolist()))
    return windows, local, nodes


def tables(spark, *meetings):
    parts = [sum((m[k] for m in meetings), []) for k in range(3)]
    return [spark.createDataFrame(p, s) for p, s in zip(parts, (WINDOWS, LOCAL_SEGMENTS, NODES), strict=True)]


def identities(spark, options, *meetings):
    grid, local, nodes = tables(spark, *meetings)
    rows = link_passes(local, grid, nodes, options).collect()
    voice = {(r["meeting_id"], r["ci"], r["lspk"]): r["text"] for r in local.where("pass = 'A'").collect()}
    out = {}
    for r in rows:
        out.setdefault(r["meeting_id"], {}).setdefault(r["gid"], set()).add(voice[r["meeting_id"], r["ci"], r["lspk"]])
    return rows, out


def test_two_pass_and_single_pass_find_the_voices(spark):
    rows, found = identities(spark, c.LinkOptions(samples=10), meeting("long", 1500.0, voices=3), meeting("short", 90.0), meeting("one", 25.0))
    modes = {r["meeting_id"]: r["mode"] for r in rows}
    assert modes == {"long": "two_pass_calibrated", "short": "single_pass", "one": "single_pass"}
    assert all(len(v) == 1 for g in found.values() for v in g.values()) and {m: len(g) for m, g in found.items()} == {"long": 3, "short": 2, "one": 2}
    assert {r["attribution"] for r in rows if r["meeting_id"] == "one"} == {"single_window"}


def test_too_few_samples_fall_back(spark):
    rows, found = identities(spark, c.LinkOptions(samples=10_000), meeting("m", 600.0))
    assert {r["mode"] for r in rows} == {"single_pass_fallback"} and all(len(v) == 1 for v in found["m"].values())
    rows, _ = identities(spark, c.LinkOptions(two_pass=False), meeting("m", 600.0))
    assert {r["mode"] for r in rows} == {"single_pass"}


def node(ci, lspk, total, emb, *, clean=True, concat=True):
    v = np.asarray(emb, dtype=float)
    return {"pass": "A", "ci": ci, "lspk": lspk, "spk_ord": lspk, "total_dur": total, "is_clean": clean, "window_s": total, "spine_emb": v if clean else None, "concat_emb": v if concat else None}


def frame(*nodes):
    return pd.DataFrame(list(nodes))


E = np.eye(8)


def test_without_spine_names_go_round_within_the_cap():
    m = linking.link_once(frame(*(node(k, 1, 0.2, E[0], clean=False) for k in range(5))), c.LinkOptions(most_speakers=2))
    assert list(m.gids.values()) == [0, 1, 0, 1, 0] and set(m.why.values()) == {"no_spine"}


def test_floor_and_cap_of_clusters():
    same_window = frame(*(node(0, k, 9.0, E[0]) for k in (1, 2, 3)), *(node(1, k, 9.0, E[0]) for k in (1, 2)))
    free = c.LinkOptions(demote_weak=False, low_mass_merge=False)
    assert len(set(linking.link_once(same_window, free).gids.values())) == 3  # three durable speakers in one window
    assert len(set(linking.link_once(same_window, replace(free, most_speakers=2)).gids.values())) == 2
    apart = frame(*(node(k, 1, 9.0, E[k]) for k in range(6)))
    assert len(set(linking.link_once(apart, replace(free, most_speakers=4)).gids.values())) == 4


def test_leftovers_go_by_voice_then_time_then_window():
    nodes = [node(0, 1, 20, E[0]), node(1, 1, 20, E[1]), node(2, 1, 20, E[0]), node(3, 1, 20, E[1])]
    voice = linking.link_once(frame(*nodes, node(2, 2, 0.4, E[1], clean=False)), c.LinkOptions())
    assert voice.gids[2, 2] == voice.gids[1, 1] and voice.why[2, 2].startswith("voice")
    time = linking.link_once(frame(*nodes, node(2, 2, 0.4, E[5], clean=False)), c.LinkOptions())
    assert time.gids[2, 2] == time.gids[1, 1] and time.why[2, 2] == "time"
    simple = linking.link_once(frame(*nodes, node(2, 2, 0.4, E[5], clean=False)), c.LinkOptions(simplified=True))
    assert simple.gids[2, 2] == simple.gids[2, 1] and simple.why[2, 2] == "window_main"


def test_light_and_weak_identities():
    nodes = [node(k, 1, 20, E[0]) for k in range(3)] + [node(k, 2, 20, E[1]) for k in range(3)]
    near = 0.8 * E[0] + 0.6 * E[2]
    weak = linking.link_once(frame(*nodes, node(5, 1, 4.0, E[4])), c.LinkOptions())
    assert len(set(weak.gids.values())) == 2  # demoted, then attributed by time
    light = linking.link_once(frame(*nodes, node(5, 1, 3.0, near), node(6, 1, 3.0, near)), c.LinkOptions(cluster_distance=0.1, attribution_distance=0.01))
    assert light.gids[5, 1] == light.gids[0, 1] and "merged" in light.why[5, 1]
    kept = linking.link_once(frame(*nodes, node(5, 1, 3.0, near), node(6, 1, 3.0, near)), c.LinkOptions(cluster_distance=0.1, attribution_distance=0.01, low_mass_merge=False))
    assert kept.gids[5, 1] != kept.gids[0, 1]


def test_failed_second_pass_is_told(monkeypatch, spark):
    assert linking.degraded(MemoryError("CUDA out of memory"))["oom"] and not linking.degraded(ValueError("x"))["oom"]
    assert len(linking.degraded(ValueError("y" * 999))["error"]) == 200


@pytest.mark.parametrize("co,want", [([(1, 1, 5.0), (1, 2, 4.0), (2, 1, 4.9), (2, 2, 0.0)], set()), ([(1, 1, 5.0), (2, 2, 3.0), (1, 2, 0.1)], {(1, 1), (2, 2)}), ([(1, 1, 0.4)], set()), ([(1, 1, 1.0), (1, 2, 0.9)], set())])
def test_witnesses(spark, co, want):
    df = spark.createDataFrame([("m", 0, a, 0, b, s) for a, b, s in co], "meeting_id string, ci_a int, l_a int, ci_b int, l_b int, co_s double")
    none = spark.createDataFrame([], "meeting_id string, ci int, lspk int, concat_emb array<double>")
    assert {(r["l_a"], r["l_b"]) for r in linking.witness_pairs(df, none, none).collect()} == want


def test_witnesses_with_far_voices_are_refused(spark):
    df = spark.createDataFrame([("m", 0, 1, 0, 1, 5.0)], "meeting_id string, ci_a int, l_a int, ci_b int, l_b int, co_s double")
    one = lambda v: spark.createDataFrame([("m", 0, 1, v)], "meeting_id string, ci int, lspk int, concat_emb array<double>")
    assert linking.witness_pairs(df, one([1.0, 0.0]), one([0.0, 1.0])).count() == 0 and linking.witness_pairs(df, one([1.0, 0.0]), one([1.0, 0.1])).count() == 1
