"""Problem 3: variant spellings of names that people typed.

Every spelling of a row (its name, its aliases) becomes a form: the parts of the bare name, as written and in Latin
transcription. A symmetric-delete index finds forms with a part in common up to a small edit: every part is
entered with each of its one-character deletions, beside the first letter of another part. Forms that meet there
and whose other parts are within the edits that count as alike, however many they are, are compared by the best assignment
of their parts, which may be misspelt, cut short, swapped, transcribed, or given by an initial; a bracketed nickname
stands for the given name.

Two rows are not one human being if both hold a seat (is_mp), or if both have titles and share none. A row with neither,
which may resemble several people, joins only the one it is most like; where two are equally like, or an initial fits
several, it joins none.

Cases: null and empty names match nothing; equal bare names are one human being; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import names as N
from .graph import all_pairs, components
from .storage import cut

#: A key shared by more forms gives its pairs in blocks of this size; the result does not depend on it.
CROWDED = 2_000
LIKE, LIKE_LATIN, LIKE_INITIAL = 0.86, 0.95, 0.75
#: Components of more rows give their pairs in blocks of this size; the result does not depend on it.
FULL_CLASS = 200


def _forms_of(name: str) -> set[str]:
    """The comparison forms of a spelling: "T" or "L" and its parts, blank-separated."""
    base, nick = N.bare(name)
    out = set()
    for s in [base] + [f"{k} {base.split(' ', 1)[1]}" for k in nick if " " in base and "," not in base]:
        parts = [p for p in s.replace(",", " ").split(" ") if p]
        if not parts:
            continue
        if s.isascii():
            out.add("L " + " ".join(p.lower() for p in parts))
        else:
            out.add("T " + " ".join(p.lower() for p in parts))
            if len(parts) > 1 and not any(N.is_initial(p) for p in parts):
                out.add("L " + " ".join(N.latin(p) for p in parts))
    return out


def name_forms(spellings: DataFrame) -> DataFrame:
    """(id, form) of the distinct spellings (id, name)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, x) for i, n in zip(f["id"], f["name"]) for x in _forms_of(n)]
            yield pd.DataFrame(rows, columns=["id", "form"])

    clean = spellings.where(F.col("id").isNotNull() & F.col("name").isNotNull()).select(F.col("id").cast("long").alias("id"), "name").distinct()
    return clean.mapInPandas(run, "id long, form string").distinct()


def _index(forms: DataFrame) -> DataFrame:
    """(form, k, other, initial): the entries of each distinct form, with the other part and whether that is an initial."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for form in f["form"]:
                script, *parts = form.split(" ")
                seen = set()
                for i, p in enumerate(parts):
                    if N.is_initial(p):
                        continue
                    for j, q in enumerate(parts):
                        if i != j or len(parts) == 1:
                            letter, other = ("", "") if i == j else (N.first_letter(q), q)
                            seen |= {(f"{script}{d}|{letter}", other, N.is_initial(q)) for d in N.deletes(p)}
                rows += [(form, k, o, x) for k, o, x in seen]
            yield pd.DataFrame(rows, columns=["form", "k", "other", "initial"])

    return forms.select("form").distinct().mapInPandas(run, "form string, k string, other string, initial boolean")


def meeting_forms(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(fa, fb) of the distinct forms that share an entry of the index and whose other parts may be alike; with one side, fa < fb.

    Every two entries of a key meet; a crowded key is dealt over blocks of the right side, which changes no pair.
    """
    a = cut(_index(left))
    b = a if right is None else cut(_index(right))
    order = F.col("fa") < F.col("fb") if right is None else F.lit(True)
    sizes = b.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > (1 if right is None else 0))
    blocks = sizes.select("k", F.ceil(F.col("n") / CROWDED).cast("int").alias("blocks"))
    la = a.join(blocks, "k").select("k", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.col("form").alias("fa"), F.col("other").alias("oa"), F.col("initial").alias("ia"))
    lb = b.join(blocks, "k").select("k", F.pmod(F.xxhash64("form"), F.col("blocks")).cast("int").alias("block"), F.col("form").alias("fb"), F.col("other").alias("ob"), F.col("initial").alias("ib"))
    # what token_likeness accepts at most: two edits, or up to four letters cut off and one edit; a swap of neighbours is two edits here
    longer = F.abs(F.length("oa") - F.length("ob"))
    near = F.col("ia") | F.col("ib") | ((longer <= 4) & F.levenshtein("oa", "ob", 6).between(0, F.greatest(F.lit(4), longer + 2)))
    return la.join(lb, ["k", "block"]).where(order & near).select("fa", "fb").distinct()


def likeness(pairs: DataFrame) -> DataFrame:
    """(fa, fb, like, initial) of the pairs that are alike enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for fa, fb in zip(f["fa"], f["fb"]):
                a, b = fa.split(" "), fb.split(" ")
                if a[0] != b[0]:
                    continue
                short = [sum(map(N.is_initial, x[1:])) for x in (a, b)]
                if sum(short) and min(short):
                    if sorted(a) == sorted(b):
                        rows.append((fa, fb, 1.0, False))
                    continue
                s = N.align(a[1:], b[1:])
                if s >= (LIKE_INITIAL if sum(short) else LIKE_LATIN if a[0] == "L" else LIKE):
                    rows.append((fa, fb, s, sum(short) > 0))
            yield pd.DataFrame(rows, columns=["fa", "fb", "like", "initial"])

    return pairs.mapInPandas(run, "fa string, fb string, like double, initial boolean")


def spellings(persons: DataFrame, aliases: DataFrame) -> DataFrame:
    return persons.select("id", "name").unionByName(aliases.select(F.col("person_id").alias("id"), F.col("alias").alias("name")))


def _titles(spelled: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, t) for i, n in zip(f["id"], f["name"]) for t in N.titles(n)]
            yield pd.DataFrame(rows, columns=["id", "title"])

    clean = spelled.where(F.col("id").isNotNull() & F.col("name").isNotNull()).select(F.col("id").cast("long").alias("id"), "name")
    # a row has a few spellings with a fixed set of titles
    return clean.mapInPandas(run, "id long, title string").groupBy("id").agg(F.array_sort(F.collect_set("title")).alias("titles"))


def same_person(persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """(node, component): the rows of persons that have variants, and the least id of their human being."""
    spelled = spellings(persons, aliases)
    seat = persons.groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.coalesce("is_mp", F.lit(False))).alias("seat"))
    about = seat.join(_titles(spelled), "id", "left").select("id", "seat", F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))
    forms = cut(name_forms(spelled).join(about, "id"))
    # one row stands for all with the same form, titles and no seat; seats are kept apart
    own = F.when(F.col("seat"), F.col("id"))
    reps = cut(forms.groupBy("form", "seat", "titles", own.alias("own")).agg(F.min("id").alias("rep")).drop("own"))
    inside = forms.where("not seat").join(reps.where("not seat"), ["form", "titles"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("like"), F.lit(False).alias("initial"))
    alike = likeness(meeting_forms(forms))
    same_form = reps.select(F.col("form").alias("fa"), F.col("form").alias("fb"), F.lit(1.0).alias("like"), F.lit(False).alias("initial")).distinct()
    side = lambda n, f: reps.select(F.col("form").alias(f), F.col("rep").alias(n), F.col("seat").alias(f"{n}_seat"), F.col("titles").alias(f"{n}_titles"))
    met = alike.unionByName(same_form).join(side("a", "fa"), "fa").join(side("b", "fb"), "fb").where("a <> b")
    apart = (F.col("a_seat") & F.col("b_seat")) | ((F.size("a_titles") > 0) & (F.size("b_titles") > 0) & ~F.arrays_overlap("a_titles", "b_titles"))
    loose = lambda n: ~F.col(f"{n}_seat") & (F.size(f"{n}_titles") == 0)
    edges = cut(met.where(~apart).select("a", "b", "like", "initial", loose("a").alias("a_loose"), loose("b").alias("b_loose")))
    firm = edges.where("not a_loose and not b_loose and not initial").select("a", "b").unionByName(inside.select("a", "b"))
    first = components(firm)
    human = lambda d, c: d.join(first.select(F.col("node").alias(c), F.col("component").alias(f"{c}_h")), c, "left").withColumn(f"{c}_h", F.coalesce(f"{c}_h", c))
    both_ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "like", "initial", F.col("b_loose").alias("a_loose"), F.col("a_loose").alias("b_loose")))
    # a loose row against the human beings it resembles: its best one, if there is one best
    options = human(both_ways.where("a_loose and not b_loose"), "b").groupBy("a", "b_h").agg(F.max("like").alias("like"))
    best = options.groupBy("a").agg(F.max("like").alias("best"))
    top = options.join(best, "a").where("like = best").groupBy("a").agg(F.min("b_h").alias("b"), F.count("*").alias("n"))
    placed = cut(top)
    joined = placed.where("n = 1").select("a", "b")
    free = both_ways.where("a_loose and b_loose and a < b and not initial").join(placed.select(F.col("a").alias("p"), F.lit(1).alias("a_placed")), F.col("a") == F.col("p"), "left").drop("p")
    free = free.join(placed.select(F.col("a").alias("p"), F.lit(1).alias("b_placed")), F.col("b") == F.col("p"), "left").where("a_placed is null or b_placed is null").select("a", "b")
    return components(firm.unionByName(joined).unionByName(free))


def same_person_pairs(persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """(person_id_a, person_id_b), a < b, of rows that are one human being, directly or through further rows."""
    own = persons.select(F.col("id").alias("node")).distinct()
    members = cut(same_person(persons, aliases).join(own, "node"))
    pairs = all_pairs(members, "component", "node", FULL_CLASS)
    return pairs.select(F.col("a").alias("person_id_a"), F.col("b").alias("person_id_b"))
