"""Problem 6: roster rows and persons without a common key, by soft logic.

Every candidate pair (roster row i, person j) has a truth value x_ij in [0, 1]. Weighted rules give hinge losses:

    2.0 * s_ij    alike(i, j)                           -> same(i, j)        max(0, s_ij - x_ij)
    0.7           (prior)                                  !same(i, j)        x_ij
    1.5 / 1.0     other party / other province          -> !same(i, j)
    0.6 / 0.6     same party / same province            -> same(i, j)        1 - x_ij
    8.0           same(i, j) & same(i, k)               -> false              max(0, sum_j x_ij - 1), and per person
    0.3           same(i, j) & like(j, k)               -> same(i, k)        max(0, x_ij + like_jk - 1 - x_ik)

Their sum is convex and is minimised by consensus alternating directions: each potential keeps its own copies of its
variables and moves them by a closed-form step, the copies' mean is the new truth value. Potentials never cross the
connected components of the candidate pairs, so the components are spread over the tasks; a task takes whole components
until BATCH pairs are together, and runs the steps for them at once, as flat arrays (about 500 bytes a pair: a component is
solved in one task). The steps go on until truth values and copies agree; a problem that does not get there in ROUNDS is
an error, not a result. like(j, k) is the likeness of the two persons' own spellings. The final value is the match's
confidence.

Cases: a roster row with a known person, or persons already held by one, take no part; null names, parties and provinces
are no evidence; repeated rows count once; ties go to the greater likeness, then the lesser id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import names as N
from .graph import components
from .storage import cut
from .variants import likeness, meeting_forms, name_forms, spellings

CONFIDENT = 0.5
STEP, ROUNDS, CLOSE = 1.0, 20_000, 1e-4
#: Candidate pairs that a task solves at once, if they are not of one component.
BATCH = 50_000
# What a roster writes instead of a province for seats from a list, and short forms of "province".
PARTY_LIST = ("แบบบัญชีรายชื่อ", "บัญชีรายชื่อ")
PROVINCE = re.compile(r"^(?:จังหวัด|จ\.)\s*")


def place(raw: str | None) -> tuple[str, str]:
    """A province in one notation, as written and in Latin letters; empty where there is none."""
    if not raw:
        return "", ""
    s = PROVINCE.sub("", N.plain(raw)).strip()
    if not s or s in PARTY_LIST or not any(c.isalpha() for c in s):
        return "", ""
    flat = s.replace(" ", "")
    return flat, N.latin(flat)


def same_place(a: str | None, b: str | None) -> float | None:
    """1 same, 0 other, None unknown."""
    (a1, a2), (b1, b2) = place(a), place(b)
    if not a1 or not b1:
        return None
    if a1 == b1 or a1.isascii() == b1.isascii() and N.distance(a1, b1, 1) <= 1:
        return 1.0
    return 1.0 if a1.isascii() != b1.isascii() and N.distance(a2, b2, 2) <= 2 else 0.0


def solve(member: np.ndarray, person: np.ndarray, like: np.ndarray, party: np.ndarray, province: np.ndarray, alike: list[tuple[int, int, float]]) -> np.ndarray:
    """The truth values of the candidate pairs. party, province: 1 same, 0 other, nan unknown; alike: (pair, pair, like of their persons)."""
    n = len(like)
    if not n:
        return np.zeros(0)
    var, pot, coef, const, weight = [], [], [], [], []

    def add(v: np.ndarray, c: np.ndarray, groups: np.ndarray, k: np.ndarray, w: np.ndarray) -> None:
        base = len(const)
        var.extend(v)
        coef.extend(c)
        pot.extend(groups + base)
        const.extend(k)
        weight.extend(w)

    i = np.arange(n)
    one = np.ones(n)
    add(i, -one, i, like, 2.0 * like)  # max(0, const + coef * x)
    add(i, one, i, 0 * one, 0.7 * one)
    for known, w_other, w_same in ((party, 1.5, 0.6), (province, 1.0, 0.6)):
        o, s = np.flatnonzero(known == 0), np.flatnonzero(known == 1)
        add(o, np.ones(len(o)), np.arange(len(o)), np.zeros(len(o)), np.full(len(o), w_other))
        add(s, -np.ones(len(s)), np.arange(len(s)), np.ones(len(s)), np.full(len(s), w_same))
    for side in (member, person):
        _, group, size = np.unique(side, return_inverse=True, return_counts=True)
        many = np.flatnonzero(size[group] > 1)
        _, dense = np.unique(group[many], return_inverse=True)
        k = dense.max() + 1 if len(dense) else 0
        add(many, np.ones(len(many)), dense, -np.ones(k), np.full(k, 8.0))
    for a, b, s in alike:
        add(np.array([a, b]), np.array([1.0, -1.0]), np.zeros(2, int), np.array([s - 1]), np.array([0.3]))
    var_, pot_, coef_ = np.array(var), np.array(pot), np.array(coef)
    const_, weight_ = np.array(const), np.array(weight)
    m = len(const_)
    norm = np.bincount(pot_, coef_**2, m)
    degree = np.maximum(np.bincount(var_, minlength=n), 1)
    z = like.copy()
    u = np.zeros(len(var_))
    for _ in range(ROUNDS):
        v = z[var_] - u
        value = const_ + np.bincount(pot_, coef_ * v, m)
        # hinge: stay where it is inactive, take the whole step, or stop on the hinge
        step = np.clip(value / norm, 0, weight_ / STEP)
        x = v - coef_ * step[pot_]
        new = np.clip(np.bincount(var_, x + u, n) / degree, 0, 1)
        u += x - new[var_]
        moved = np.abs(new - z).max()
        z = new
        if moved < CLOSE and np.abs(x - z[var_]).max() < 10 * CLOSE:
            return z
    raise ArithmeticError(f"no agreement after {ROUNDS} rounds: {moved:.2g}")


def _solved(f: pd.DataFrame) -> pd.DataFrame:
    """The truth values of whole components."""
    party = np.where(f["party_id"].isna() | f["p_party_id"].isna(), np.nan, (f["party_id"] == f["p_party_id"]).astype(float))
    province = np.array([np.nan if s is None else s for s in map(same_place, f["province"], f["p_province"])], float)
    at = {pair: i for i, pair in enumerate(zip(f["m"], f["p"]))}
    alike = [(i, at[m, x["q"]], x["like"]) for i, (m, near) in enumerate(zip(f["m"], f["near"])) if near is not None for x in near]
    x = solve(f["m"].to_numpy(), f["p"].to_numpy(), f["like"].to_numpy(), party, province, alike)
    return pd.DataFrame({"member_no": f["m"], "person_id": f["p"], "like": f["like"], "x": x})


def _alike_candidates(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """(m, p, near): for every candidate pair the persons q, also candidates of m, whose spellings are like those of p."""
    own = cut(forms.join(pairs.groupBy("m").agg(F.collect_set("p").alias("p")).where(F.size("p") > 1).select(F.explode("p").alias("id")).distinct().hint("merge"), "id"))
    alike = likeness(meeting_forms(own.select("form"))).select("fa", "fb", "like")
    same = own.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select(F.col("form").alias("fa"), F.col("form").alias("fb"), F.lit(1.0).alias("like"))
    side = lambda f, i: own.select(F.col("form").alias(f), F.col("id").alias(i)).hint("merge")
    one_way = alike.unionByName(same).join(side("fa", "p"), "fa").join(side("fb", "q"), "fb").where("p <> q")
    both = one_way.select("p", "q", "like").unionByName(one_way.select(F.col("q").alias("p"), F.col("p").alias("q"), "like")).groupBy("p", "q").agg(F.max("like").alias("like"))
    met = pairs.join(both.hint("merge"), "p").join(pairs.select("m", F.col("p").alias("q")).hint("merge"), ["m", "q"])
    return met.groupBy("m", "p").agg(F.array_sort(F.collect_list(F.struct("q", "like"))).alias("near"))


def match(members: DataFrame, persons: DataFrame, aliases: DataFrame, speeches: DataFrame) -> DataFrame:
    """(member_no, person_id, confidence): the persons row of each roster row that has none, where there is one."""
    roster = members.dropDuplicates(["member_no"]).where("member_no is not null")
    open_ = roster.where("person_id is null and name is not null").select(F.col("member_no").cast("long").alias("id"), "name", "party_id", "province")
    held = roster.where("person_id is not null").select(F.col("person_id").cast("long").alias("id")).distinct()
    left = cut(name_forms(open_))
    right = cut(name_forms(spellings(persons, aliases)).join(held, "id", "left_anti"))
    alike = likeness(meeting_forms(left, right)).select("fa", "fb", "like")
    # all joins of growing sides are merged by key: none is sent whole to every task
    equal = left.select(F.col("form").alias("fa")).join(right.select(F.col("form").alias("fb")).hint("merge"), F.col("fa") == F.col("fb")).distinct().withColumn("like", F.lit(1.0))
    side = lambda d, f, i: d.withColumnRenamed("form", f).withColumnRenamed("id", i).hint("merge")
    pairs = alike.unionByName(equal).join(side(left, "fa", "m"), "fa").join(side(right, "fb", "p"), "fb")
    pairs = cut(pairs.groupBy("m", "p").agg(F.max("like").alias("like")))

    titled = lambda d: d.mapInPandas(_titles, "id long, title string").groupBy("id").agg(F.collect_set("title").alias("titles"))
    mt, pt = titled(open_.select("id", "name")), titled(spellings(persons, aliases).where("id is not null and name is not null").select(F.col("id").cast("long").alias("id"), "name"))
    spoken = speeches.where("person_id is not null").select(F.col("person_id").cast("long").alias("p"), "id", "party_id", "province").join(pairs.select("p").distinct().hint("merge"), "p").distinct()
    usual = lambda c: spoken.where(F.col(c).isNotNull()).groupBy("p", c).agg(F.count("*").alias("n")).groupBy("p").agg(F.max_by(c, F.struct("n", c)).alias(f"p_{c}"))
    known = (
        pairs.join(open_.select(F.col("id").alias("m"), "party_id", "province").hint("merge"), "m").join(usual("party_id").hint("merge"), "p", "left").join(usual("province").hint("merge"), "p", "left")
        .join(mt.select(F.col("id").alias("m"), F.col("titles").alias("mt")).hint("merge"), "m", "left").join(pt.select(F.col("id").alias("p"), F.col("titles").alias("pt")).hint("merge"), "p", "left")
    )
    # titles that exclude one another are two people
    known = cut(known.where(~(F.coalesce(F.size("mt"), F.lit(0)) > 0) | ~(F.coalesce(F.size("pt"), F.lit(0)) > 0) | F.arrays_overlap("mt", "pt")).drop("mt", "pt"))
    # persons are numbered below zero so that both sides share one graph
    parts = components(known.select(F.col("m").alias("a"), (-F.col("p") - 1).alias("b")))
    near = _alike_candidates(known.select("m", "p"), right)
    grouped = known.join(parts.select(F.col("node").alias("m"), "component").hint("merge"), "m").join(near.hint("merge"), ["m", "p"], "left")
    grouped = grouped.repartition("component").sortWithinPartitions("component", "m", "p")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            held.append(f)
            if sum(map(len, held)) >= BATCH and held[0]["component"].iloc[0] != f["component"].iloc[-1]:
                whole = pd.concat(held, ignore_index=True)
                begun = whole["component"] == whole["component"].iloc[-1]
                yield _solved(whole[~begun].reset_index(drop=True))
                held = [whole[begun]]
        if held:
            yield _solved(pd.concat(held, ignore_index=True))

    solved = grouped.mapInPandas(run, "member_no long, person_id long, like double, x double")
    chosen = solved.groupBy("member_no").agg(F.max(F.struct("x", "like", (-F.col("person_id")).alias("neg"))).alias("c"))
    one_way = chosen.select("member_no", (-F.col("c.neg")).alias("person_id"), F.col("c.x").alias("x"), F.col("c.like").alias("like")).where(F.col("x") >= CONFIDENT)
    both = one_way.groupBy("person_id").agg(F.max(F.struct("x", "like", (-F.col("member_no")).alias("neg"))).alias("c"))
    return both.select((-F.col("c.neg")).alias("member_no"), "person_id", F.round("c.x", 4).alias("confidence"))


def _titles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(i, t) for i, n in zip(f["id"], f["name"]) for t in N.titles(n)]
        yield pd.DataFrame(rows, columns=["id", "title"])
