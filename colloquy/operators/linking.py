"""Speakers of windows to identities of a meeting.

What is relational (evidence, co-time, witnesses, thresholds, nearest centroids) is DataFrame
code; the greedy part that depends on its own earlier steps runs as one grouped kernel per
meeting on at most a few thousand nodes (a recording is limited to three hours).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions.math import clip, cosine_distance
from ..schemas import IDENTITIES
from .kernels import assign, average_link, cosine_distances, weighted_centroids

NODE = ["meeting_id", "ci", "lspk"]


# --- DataFrame operators -------------------------------------------------------------------

def node_pairs(nodes: DataFrame, vector: str = "spine_emb") -> DataFrame:
    """Cosine distances of all unordered node pairs of a meeting, each once."""
    a = nodes.where(F.col(vector).isNotNull()).select("meeting_id", F.struct("ci", "lspk").alias("k1"), F.col(vector).alias("v1"))
    b = a.select("meeting_id", F.col("k1").alias("k2"), F.col("v1").alias("v2"))
    return a.join(b, "meeting_id").where("k1 < k2").select("meeting_id", F.col("k1.ci").alias("ci_1"), F.col("k1.lspk").alias("l_1"), F.col("k2.ci").alias("ci_2"), F.col("k2.lspk").alias("l_2"), cosine_distance(F.col("v1"), F.col("v2")).alias("d"))


def centroids(nodes: DataFrame, label: str, vector: str = "spine_emb", weight: str = "total_dur") -> DataFrame:
    """Weighted mean vector of each label of a meeting."""
    flat = nodes.where(F.col(vector).isNotNull()).select("meeting_id", F.col(label).alias("gid"), F.col(weight).alias("w"), F.posexplode(vector).alias("i", "x"))
    summed = flat.groupBy("meeting_id", "gid", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return summed.groupBy("meeting_id", "gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))


def nearest_two(nodes: DataFrame, centres: DataFrame, vector: str = "concat_emb", *, gate: float = c.ATTRIBUTION_DISTANCE, margin: float = c.ATTRIBUTION_MARGIN) -> DataFrame:
    """The nearest centroid of each node, the distance of the second, and whether the gates let it pass."""
    near = nodes.where(F.col(vector).isNotNull()).select(*NODE, vector).join(centres, "meeting_id").withColumn("d", cosine_distance(F.col(vector), F.col("centroid")))
    best = near.groupBy(*NODE).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "gid"))), 1, 2).alias("two"))
    d1, d2 = F.get("two", F.lit(0))["d"], F.get("two", F.lit(1))["d"]
    passes = (d1 <= gate) & F.coalesce(d2 / F.greatest(d1, F.lit(c.SMALLEST_DISTANCE)) >= margin, F.lit(True))
    return best.select(*NODE, F.get("two", F.lit(0))["gid"].alias("gid"), d1.alias("d1"), d2.alias("d2"), passes.alias("passes"))


def durable_floor(nodes: DataFrame, least: float = c.LEAST_DURABLE_SECONDS) -> DataFrame:
    """Most speakers with ``least`` seconds in one window of a meeting, 1 at least."""
    per = nodes.groupBy("meeting_id", "ci").agg(F.count_distinct(F.when(F.col("total_dur") >= least, F.col("lspk"))).alias("n"))
    return per.groupBy("meeting_id").agg(F.greatest(F.max("n"), F.lit(1)).alias("min_k"))


def identity_mass(identities: DataFrame) -> DataFrame:
    """Seconds and nodes of each identity (nodes count, not distinct windows)."""
    return identities.groupBy("meeting_id", "gid").agg(F.sum("total_dur").alias("mass"), F.count(F.lit(1)).alias("windows"))


def weak_identities(mass: DataFrame, *, least_mass: float, least_windows: int, fewest: int = 1) -> DataFrame:
    """``mass`` with ``weak``: too little evidence, but never so many that fewer than ``fewest`` stay."""
    weak = (F.col("mass") < least_mass) | (F.col("windows") < least_windows)
    meeting = Window.partitionBy("meeting_id")
    flagged = mass.withColumn("weak", weak).withColumn("strong", F.sum((~F.col("weak")).cast("int")).over(meeting))
    rank = F.row_number().over(Window.partitionBy("meeting_id", "weak").orderBy(F.desc("mass"), "gid"))
    return flagged.withColumn("weak", F.col("weak") & (rank > F.greatest(F.lit(fewest), F.lit(1)) - F.col("strong"))).drop("strong")


def absorb_low_mass(mass: DataFrame, centres: DataFrame, least: float = c.LEAST_SPINE_MASS_SECONDS) -> DataFrame:
    """(meeting_id, gid, target): clusters under ``least`` seconds and the nearest one above."""
    known = mass.join(centres, ["meeting_id", "gid"])
    low = known.where(F.col("mass") < least).select("meeting_id", "gid", F.col("centroid").alias("own"))
    high = known.where(F.col("mass") >= least).select("meeting_id", F.col("gid").alias("target"), "centroid")
    near = low.join(high, "meeting_id").withColumn("d", cosine_distance(F.col("own"), F.col("centroid")))
    return near.groupBy("meeting_id", "gid").agg(F.min_by("target", F.struct("d", "target")).alias("target"))


def merge_low_mass(mass: DataFrame, centres: DataFrame) -> DataFrame:
    """Decision for each identity of little mass: merged into a clearly nearest durable one, or kept."""
    known = mass.join(centres, ["meeting_id", "gid"], "left")
    low = known.where((F.col("mass") > 0) & (F.col("mass") < c.LOW_MASS_SECONDS))
    high = known.where((F.col("mass") >= c.LOW_MASS_SECONDS) & F.col("centroid").isNotNull()).select("meeting_id", F.col("gid").alias("to"), F.col("centroid").alias("their"))
    two = low.join(high, "meeting_id", "left").groupBy("meeting_id", "gid").agg(
        F.first("mass").alias("mass"), F.first(F.col("centroid").isNull()).alias("bare"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("their").isNotNull() & F.col("centroid").isNotNull(), F.struct(cosine_distance(F.col("centroid"), F.col("their")).alias("d"), "to")))), 1, 2).alias("two"),
    )
    d1, d2 = F.get("two", F.lit(0))["d"], F.get("two", F.lit(1))["d"]
    margin = d2 / F.greatest(d1, F.lit(c.SMALLEST_DISTANCE))
    good = (d1 <= c.LOW_MASS_DISTANCE) & F.coalesce(margin >= c.LOW_MASS_MARGIN, F.lit(True))
    decision = F.when(F.col("bare"), "keep_no_centroid").when(F.size("two") == 0, "keep_no_durable_centroid").when(good, "merge").otherwise("keep_not_confident")
    return two.select("meeting_id", "gid", "mass", decision.alias("decision"), F.get("two", F.lit(0))["to"].alias("to_gid"), d1.alias("best"), d2.alias("second"))


def witness_pairs(co: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame) -> DataFrame:
    """Nodes of two passes that are the same speaker: best joint assignment of each window pair by
    co-time, if long enough, clearly ahead of the next in row and column, and not far apart in voice."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="l_a", columns="l_b", values="co_s").fillna(0.0)
        m = table.to_numpy()
        flip = m.shape[0] > m.shape[1]
        col = assign(-(m.T if flip else m))
        hits = [(int(x), r) if flip else (r, int(x)) for r, x in enumerate(col)]
        keep = []
        for i, j in hits:
            runner = max([0.0, *np.delete(m[i], j), *np.delete(m[:, j], i)])
            if m[i, j] >= c.WITNESS_SECONDS and m[i, j] - runner >= c.WITNESS_MARGIN_SECONDS:
                keep.append((table.index[i], table.columns[j], m[i, j]))
        head = pdf.iloc[0]
        return pd.DataFrame([(head.meeting_id, head.ci_a, a, head.ci_b, b, s) for a, b, s in keep], columns=["meeting_id", "ci_a", "l_a", "ci_b", "l_b", "co_s"])

    best = co.groupBy("meeting_id", "ci_a", "ci_b").applyInPandas(solve, "meeting_id string, ci_a int, l_a int, ci_b int, l_b int, co_s double")
    va = nodes_a.select("meeting_id", F.col("ci").alias("ci_a"), F.col("lspk").alias("l_a"), F.col("concat_emb").alias("va"))
    vb = nodes_b.select("meeting_id", F.col("ci").alias("ci_b"), F.col("lspk").alias("l_b"), F.col("concat_emb").alias("vb"))
    guarded = best.join(va, ["meeting_id", "ci_a", "l_a"], "left").join(vb, ["meeting_id", "ci_b", "l_b"], "left")
    return guarded.where(~F.coalesce(cosine_distance(F.col("va"), F.col("vb")) > c.WITNESS_DISTANCE, F.lit(False))).select("meeting_id", "ci_a", "l_a", "ci_b", "l_b", "co_s").dropDuplicates(["meeting_id", "ci_a", "l_a", "ci_b", "l_b"])


def calibrated_threshold(same: DataFrame, cross: DataFrame, samples: int = c.CALIBRATION_SAMPLES) -> DataFrame:
    """Middle between the upper quartile of distances ``d`` of one speaker and the lower quartile of
    those of two, clipped; null with fewer than ``samples`` of either."""
    s = same.groupBy("meeting_id").agg(F.percentile("d", F.lit(0.75)).alias("q_same"), F.count("d").alias("n_same"))
    x = cross.groupBy("meeting_id").agg(F.percentile("d", F.lit(0.25)).alias("q_cross"), F.count("d").alias("n_cross"))
    both = s.join(x, "meeting_id", "full").fillna(0, ["n_same", "n_cross"])
    enough = (F.col("n_same") >= samples) & (F.col("n_cross") >= samples)
    return both.select("meeting_id", "n_same", "n_cross", F.when(enough, clip((F.col("q_same") + F.col("q_cross")) / 2, c.CALIBRATED_LOW, c.CALIBRATED_HIGH)).alias("threshold"))


def cannot_links(pairs: DataFrame, nodes_b: DataFrame) -> DataFrame:
    """Nodes of pass A that witnesses put beside different durable speakers of one window of pass B."""
    durable = nodes_b.where(F.col("total_dur") >= c.LEAST_DURABLE_SECONDS).select("meeting_id", F.col("ci").alias("ci_b"), F.col("lspk").alias("l_b"))
    seen = pairs.join(durable, ["meeting_id", "ci_b", "l_b"]).select("meeting_id", "ci_b", "l_b", "ci_a", "l_a")
    other = seen.select("meeting_id", "ci_b", F.col("l_b").alias("m_b"), F.col("ci_a").alias("ci_a2"), F.col("l_a").alias("l_a2"))
    both = seen.join(other, ["meeting_id", "ci_b"]).where("l_b < m_b AND NOT (ci_a = ci_a2 AND l_a = l_a2)")
    return both.groupBy("meeting_id", "ci_a", "l_a", "ci_a2", "l_a2").agg(F.array_sort(F.collect_set("ci_b")).alias("windows_b"))


def chain_votes(pairs: DataFrame, identities: DataFrame) -> DataFrame:
    """Votes of identities for nodes without one, through a node of pass B that both met."""
    named = pairs.join(identities.select("meeting_id", F.col("ci").alias("ci_a"), F.col("lspk").alias("l_a"), "gid"), ["meeting_id", "ci_a", "l_a"], "left")
    held = named.where("gid IS NOT NULL").groupBy("meeting_id", "ci_b", "l_b", "gid").agg(F.sum("co_s").alias("w"))
    free = named.where("gid IS NULL").select("meeting_id", "ci_b", "l_b", "ci_a", "l_a", "co_s")
    return free.join(held, ["meeting_id", "ci_b", "l_b"]).groupBy("meeting_id", "ci_a", "l_a", "gid").agg(F.sum(F.least("w", "co_s")).alias("vote"))


def nearest_identity_in_time(nodes: DataFrame, spine: DataFrame) -> DataFrame:
    """For each node the identity, absent from its own window, whose nearest window is closest;
    one behind wins a tie with one ahead.  (meeting_id, ci, lspk, gid, score)."""
    places = spine.groupBy("meeting_id", "gid").agg(F.array_sort(F.collect_set("ci")).alias("places"), F.min(F.struct("ci", "lspk")).alias("since"))
    met = nodes.select(*NODE).join(places, "meeting_id").where(~F.array_contains("places", F.col("ci")))
    behind = F.array_max(F.filter("places", lambda p: p <= F.col("ci")))
    ahead = F.array_min(F.filter("places", lambda p: p > F.col("ci")))
    back, forth = F.col("ci") - behind, ahead - F.col("ci")
    score = F.when(back.isNotNull() & (forth.isNull() | (back <= forth)), back.cast("double")).otherwise(forth + F.lit(c.FORWARD_PENALTY))
    scored = met.withColumn("score", score)
    return scored.groupBy(*NODE).agg(F.min_by("gid", F.struct("score", "since", "gid")).alias("gid"), F.min("score").alias("score"))


# --- Kernels --------------------------------------------------------------------------------

Key = tuple[int, int]


class Meeting:
    """One meeting's nodes of pass A, in order, with their evidence."""

    def __init__(self, nodes: pd.DataFrame, options: c.LinkOptions) -> None:
        self.options = options
        rows = nodes.sort_values(["ci", "spk_ord"]).itertuples()
        self.nodes = {(int(r.ci), int(r.lspk)): r for r in rows}
        self.gids: dict[Key, int] = {}
        self.why: dict[Key, str] = {}
        self.centres: dict[int, np.ndarray] = {}
        self.spine: list[Key] = []

    def seconds(self, key: Key) -> float:
        return float(self.nodes[key].total_dur)

    def vector(self, key: Key, name: str) -> np.ndarray | None:
        v = getattr(self.nodes[key], name)
        return None if v is None else np.asarray(v, dtype=float)

    def pick_spine(self, *, strict: bool = False) -> None:
        """Nodes with a clean stretch that is long enough and a vector."""
        least, total = (c.STRICT_EMBED_SECONDS, c.STRICT_TOTAL_SECONDS) if strict else (c.LEAST_EMBED_SECONDS, 0.0)
        self.spine = [k for k, r in self.nodes.items() if r.is_clean and self.vector(k, "spine_emb") is not None and r.window_s >= least and r.total_dur >= total]

    def mass(self) -> dict[int, float]:
        out: dict[int, float] = {}
        for k, g in self.gids.items():
            out[g] = out.get(g, 0.0) + self.seconds(k)
        return out

    def floor(self) -> int:
        per: dict[int, int] = {}
        for k in self.spine:
            per[k[0]] = per.get(k[0], 0) + (self.seconds(k) >= c.LEAST_DURABLE_SECONDS)
        return max([1, self.options.fewest_speakers, *per.values()])

    def cap(self) -> int:
        return c.MOST_SPEAKERS if self.options.most_speakers is None else min(c.MOST_SPEAKERS, max(1, int(self.options.most_speakers)))

    def absorb(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Clusters of too little speech join the nearest one that has enough."""
        weights = np.array([self.seconds(k) for k in self.spine])
        mass = {int(k): weights[labels == k].sum() for k in dict.fromkeys(labels.tolist())}
        high = {k for k, m in mass.items() if m >= c.LEAST_SPINE_MASS_SECONDS}
        low = [k for k in mass if k not in high]
        need = self.options.fewest_speakers
        while need > 1 and low and len(high) < need:
            best = max(low, key=lambda k: mass[k])
            high.add(best)
            low.remove(best)
        if high and low:
            centres = weighted_centroids(x, labels, weights)
            targets = sorted(high)
            for k in low:
                d = cosine_distances(centres[k][None], np.stack([centres[t] for t in targets]))[0]
                labels = np.where(labels == k, targets[int(d.argmin())], labels)
        self.centres = weighted_centroids(x, labels, weights)
        return labels

    def name_spine(self, labels: np.ndarray) -> None:
        self.gids = {k: int(label) for k, label in zip(self.spine, labels, strict=True)}

    def demote(self, least_mass: float, least_windows: int, protected: Iterable[int] = ()) -> None:
        """Identities of little evidence give their nodes back, but for the strongest ones needed."""
        mass = self.mass()
        if len(mass) < 2:
            return
        count = pd.Series(list(self.gids.values())).value_counts()
        weak = {g for g, m in mass.items() if m < least_mass or count[g] < least_windows} - set(protected)
        while weak and len(mass) - len(weak) < max(1, self.options.fewest_speakers):
            weak.remove(max((g for g in mass if g in weak), key=lambda g: mass[g]))
        self.gids = {k: g for k, g in self.gids.items() if g not in weak}
        self.centres = {g: v for g, v in self.centres.items() if g not in weak}

    def by_voice(self, key: Key, gate: float) -> tuple[int, float] | None:
        v = self.vector(key, "concat_emb")
        if v is None or not self.centres:
            return None
        names = list(self.centres)
        d = cosine_distances(v[None], np.stack([self.centres[g] for g in names]))[0]
        order = np.argsort(d, kind="stable")
        best = d[order[0]]
        clear = len(d) == 1 or d[order[1]] / max(best, c.SMALLEST_DISTANCE) >= c.ATTRIBUTION_MARGIN
        return (names[order[0]], float(best)) if best <= gate and clear else None

    def by_time(self, ci: int, places: dict[int, list[int]]) -> int | None:
        best: tuple[float, int] | None = None
        for g, held in places.items():
            if ci in held:
                continue
            back = min((ci - p for p in held if p <= ci), default=None)
            forth = min((p - ci for p in held if p > ci), default=None)
            score = float(back) if back is not None and (forth is None or back <= forth) else forth + c.FORWARD_PENALTY
            if best is None or score < best[0]:
                best = score, g
        return best[1] if best else None

    def attribute(self, gate: float, prefix: str, votes: dict[Key, dict[int, float]] | None = None) -> None:
        """Nodes without identity: by voice, by witness votes, by time, else with the window's main speaker."""
        for k in self.gids:
            self.why[k] = f"{prefix}spine"
        places: dict[int, list[int]] = {}
        for (ci, _), g in self.gids.items():
            places.setdefault(g, []).append(ci)
        spine_mass = self.mass()
        for key in self.nodes:
            if key in self.gids:
                continue
            voice = self.by_voice(key, gate)
            vote = (votes or {}).get(key)
            near = None if self.options.simplified else self.by_time(key[0], places)
            if voice is not None:
                g, why = voice[0], f"{prefix}voice_{voice[1]:.2f}"
            elif vote:
                g, why = max(vote, key=lambda x: vote[x]), f"{prefix}votes"
            elif near is not None:
                g, why = near, f"{prefix}time"
            else:
                here = [k for k in self.nodes if k[0] == key[0] and k in self.gids]
                if here:
                    g, why = self.gids[max(here, key=self.seconds)], f"{prefix}window_main"
                elif self.options.simplified and spine_mass:
                    g, why = max(spine_mass, key=lambda x: spine_mass[x]), f"{prefix}global_main"
                else:
                    g, why = max(self.gids.values(), default=-1) + 1, f"{prefix}new"
            self.gids[key], self.why[key] = g, why

    def merge_light(self) -> None:
        """Identities of little mass join a clearly nearest durable one; targets do not move."""
        mass = self.mass()
        durable = sorted(g for g, m in mass.items() if m >= c.LOW_MASS_SECONDS and g in self.centres)
        to: dict[int, int] = {}
        for g in sorted(g for g, m in mass.items() if 0 < m < c.LOW_MASS_SECONDS and g in self.centres):
            if not durable:
                break
            d = cosine_distances(self.centres[g][None], np.stack([self.centres[x] for x in durable]))[0]
            order = np.argsort(d, kind="stable")
            best = d[order[0]]
            clear = len(d) == 1 or d[order[1]] / max(best, c.SMALLEST_DISTANCE) >= c.LOW_MASS_MARGIN
            if best <= c.LOW_MASS_DISTANCE and clear:
                to[g] = durable[order[0]]
        for k, g in self.gids.items():
            if g in to:
                self.gids[k] = to[g]
                self.why[k] += f"|merged_{to[g]}"

    def rows(self, meeting_id: str, mode: str) -> pd.DataFrame:
        spine = set(self.spine)
        data = [(meeting_id, k[0], k[1], g, k in spine and "spine" in self.why[k], self.why[k], mode) for k, g in self.gids.items()]
        return pd.DataFrame(data, columns=["meeting_id", "ci", "lspk", "gid", "in_spine", "attribution", "mode"])


def link_once(nodes: pd.DataFrame, options: c.LinkOptions) -> Meeting:
    """One pass: cluster the spine at a fixed distance, attach the rest."""
    m = Meeting(nodes, options)
    m.pick_spine(strict=options.strict_spine)
    if options.strict_spine and len(m.spine) < 2:
        return link_once(nodes, replace(options, strict_spine=False))
    if len(m.spine) < 2:  # nothing to compare: names go round, within the cap
        cap = min(m.cap(), c.MOST_SPEAKERS)
        m.gids = {k: i % cap for i, k in enumerate(m.nodes)}
        m.why = dict.fromkeys(m.gids, "no_spine")
        return m
    x = np.stack([m.vector(k, "spine_emb") for k in m.spine])
    d = cosine_distances(x, x)
    most = min(m.cap(), len(x))
    least = min(m.floor(), most)
    labels = average_link(d, limit=options.cluster_distance)
    k = labels.max() + 1
    if not least <= k <= most:
        labels = average_link(d, clusters=int(min(max(k, least), most)))
    m.name_spine(m.absorb(x, labels))
    if options.demote_weak:
        m.demote(options.demote_mass, options.demote_windows)
    m.attribute(options.attribution_distance, "")
    if options.low_mass_merge:
        m.merge_light()
    return m


def link_calibrated(nodes_a: pd.DataFrame, nodes_b: pd.DataFrame, pairs: pd.DataFrame, threshold: float, options: c.LinkOptions) -> Meeting | None:
    """Two passes: cluster at the meeting's own threshold, with the second pass as witness."""
    m = Meeting(nodes_a, options)
    m.pick_spine()
    if len(m.spine) < 2:
        return None
    met = [((int(r.ci_a), int(r.l_a)), (int(r.ci_b), int(r.l_b)), float(r.co_s)) for r in pairs.itertuples()]
    met.sort()
    durable_b = {(int(r.ci), int(r.lspk)) for r in nodes_b.itertuples() if r.total_dur >= c.LEAST_DURABLE_SECONDS}
    per_b: dict[int, int] = {}
    for ci, _ in durable_b:
        per_b[ci] = per_b.get(ci, 0) + 1
    apart: dict[frozenset, set[int]] = {}
    for a1, b1, _ in met:
        for a2, b2, _ in met:
            if b1[0] == b2[0] and b1[1] < b2[1] and a1 != a2 and b1 in durable_b and b2 in durable_b:
                apart.setdefault(frozenset((a1, a2)), set()).add(b1[0])
    x = np.stack([m.vector(k, "spine_emb") for k in m.spine])
    d = cosine_distances(x, x)
    place = {k: i for i, k in enumerate(m.spine)}
    forbidden = [tuple(place[k] for k in p) for p in apart if all(k in place for k in p)]
    for i, j in forbidden:
        d[i, j] = d[j, i] = max(d[i, j], 1.0)
    most = min(m.cap(), len(x))
    least = min(max([m.floor(), *per_b.values()]), most)
    labels = average_link(d, limit=threshold)
    if labels.max() + 1 < least:
        labels = average_link(d, clusters=least)
    while labels.max() + 1 < most and any(labels[i] == labels[j] for i, j in forbidden):
        labels = average_link(d, clusters=int(labels.max()) + 2)
    m.name_spine(m.absorb(x, labels))
    _protect_and_demote(m, apart, options)
    _cap(m)
    _must_link(m, met, apart, threshold)
    m.attribute(max(options.attribution_distance, threshold), "calibrated_", _votes(m, met))
    return m


def _protect_and_demote(m: Meeting, apart: dict[frozenset, set[int]], options: c.LinkOptions) -> None:
    mass = m.mass()
    count = pd.Series(list(m.gids.values())).value_counts()
    weak = {g for g, s in mass.items() if s < options.calibrated_demote_mass or count[g] < options.calibrated_demote_windows}
    seen: dict[int, set[int]] = {}
    for pair, windows in apart.items():
        g = {m.gids.get(k) for k in pair}
        if None in g or len(g) < 2 or len(g & weak) != 1:
            continue
        seen.setdefault(next(iter(g & weak)), set()).update(windows)
    safe = {g for g, w in seen.items() if len(w) >= c.PROTECTED_WINDOWS and mass[g] >= c.PROTECTED_MASS_SECONDS}
    m.demote(options.calibrated_demote_mass, options.calibrated_demote_windows, safe)


def _cap(m: Meeting) -> None:
    """Too many identities: the lightest joins its nearest; centroids stay as they were."""
    while len(mass := m.mass()) > m.cap():
        light = min(mass, key=lambda g: mass[g])
        others = [g for g in mass if g != light and g in m.centres]
        if light not in m.centres or not others:
            return
        dist = cosine_distances(m.centres[light][None], np.stack([m.centres[g] for g in others]))[0]
        to = others[int(dist.argmin())]
        m.gids = {k: to if g == light else g for k, g in m.gids.items()}
        del m.centres[light]


def _must_link(m: Meeting, met: list[tuple[Key, Key, float]], apart: dict[frozenset, set[int]], threshold: float) -> None:
    """Merge identities nearer than the threshold, those with most shared witnesses first, unless they
    are known to be apart; ties go by number."""
    while len(live := sorted(set(m.gids.values()))) > max(1, m.options.fewest_speakers):
        held: dict[Key, dict[int, float]] = {}
        for a, b, s in met:
            if a in m.gids:
                per = held.setdefault(b, {})
                per[m.gids[a]] = per.get(m.gids[a], 0.0) + s
        blocked = {frozenset(m.gids[k] for k in p) for p in apart if all(k in m.gids for k in p)}
        options = []
        for i, g in enumerate(live):
            for h in live[i + 1 :]:
                if g in m.centres and h in m.centres and frozenset((g, h)) not in blocked:
                    votes = sum(min(per[g], per[h]) for per in held.values() if g in per and h in per)
                    options.append((-votes, g, h))
        for _, g, h in sorted(options):
            if cosine_distances(m.centres[g][None], m.centres[h][None])[0, 0] < threshold:
                break
        else:
            return
        m.gids = {k: g if x == h else x for k, x in m.gids.items()}
        del m.centres[h]
        own = [k for k, x in m.gids.items() if x == g and m.vector(k, "spine_emb") is not None]
        m.centres[g] = np.average(np.stack([m.vector(k, "spine_emb") for k in own]), axis=0, weights=[max(m.seconds(k), 1e-3) for k in own])


def _votes(m: Meeting, met: list[tuple[Key, Key, float]]) -> dict[Key, dict[int, float]]:
    held: dict[Key, dict[int, float]] = {}
    for a, b, s in met:
        if a in m.gids:
            per = held.setdefault(b, {})
            per[m.gids[a]] = per.get(m.gids[a], 0.0) + s
    out: dict[Key, dict[int, float]] = {}
    for a, b, s in met:
        if a not in m.gids:
            for g, w in held.get(b, {}).items():
                own = out.setdefault(a, {})
                own[g] = own.get(g, 0.0) + min(w, s)
    return out


def degraded(error: BaseException) -> dict:
    """What is told when the second pass fails and one pass is used instead."""
    name = type(error).__name__
    return {"engaged": False, "degraded": True, "oom": "OutOfMemory" in name or "out of memory" in str(error).lower(), "error": f"{name}: {error}"[:200]}


def _local(nodes: pd.DataFrame, meeting_id: str, mode: str) -> pd.DataFrame:
    """A single window with speech keeps its own numbers."""
    data = [(meeting_id, int(r.ci), int(r.lspk), int(r.lspk) - 1, False, "single_window", mode) for r in nodes.itertuples()]
    return pd.DataFrame(data, columns=["meeting_id", "ci", "lspk", "gid", "in_spine", "attribution", "mode"])


def link(nodes: DataFrame, pairs: DataFrame, thresholds: DataFrame, windows: DataFrame, options: c.LinkOptions = c.LinkOptions()) -> DataFrame:
    """Identities of all meetings.

    ``nodes`` holds both passes, ``pairs`` the witnesses, ``thresholds`` a row per meeting with a
    calibrated threshold or null, ``windows`` the count of windows of pass A.  A meeting goes the
    two-pass way with enough windows, more than one with speech, and a threshold; else the one-pass
    way, which also takes over if the second pass fails.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        meeting = key[0]
        if not len(left):
            return _local(left, meeting, "single_pass")
        a, b = left[left["pass"] == "A"], left[left["pass"] == "B"]
        head = left.iloc[0]
        spoken = a["ci"].nunique()
        wanted = options.two_pass and head["n_windows"] >= c.SECOND_PASS_LEAST_WINDOWS and spoken > 1
        mode = "single_pass"
        if wanted:
            mode = "single_pass_fallback"
            if pd.notna(head["threshold"]):
                try:
                    found = link_calibrated(a, b, right, float(head["threshold"]), options)
                except Exception as error:  # noqa: BLE001  the second pass is evidence only
                    found, mode = None, f"single_pass_fallback:{degraded(error)['error']}"
                if found is not None:
                    return found.rows(meeting, "two_pass_calibrated")
        if spoken <= 1:
            return _local(a, meeting, mode)
        return link_once(a, options).rows(meeting, mode)

    known = nodes.join(windows.select("meeting_id", "n_windows"), "meeting_id", "left").join(thresholds.select("meeting_id", "threshold"), "meeting_id", "left").fillna(0, ["n_windows"])
    return known.groupBy("meeting_id").cogroup(pairs.groupBy("meeting_id")).applyInPandas(run, IDENTITIES)
