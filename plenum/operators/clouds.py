"""Word clouds of all entities at once: raw counts, tf-idf and weighted log-odds.

A person's cloud leaves out the words of the person's own name; those of parties and meetings leave out everyone's names,
places and party names. Thresholds and totals are taken before anything is left out. A weight must be positive before it is rounded to two decimals; words are ranked by the rounded weight, then the lower
term id, and the first `k` kept per entity. Corpus statistics are small aggregates that Catalyst broadcasts by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CLOUD_TERM
from ..plans.model import Model

#: Words kept per cloud, and pseudo-words of the log-odds prior.
TOP, PRIOR = 120, 5000


def top_terms(scored: DataFrame, entity: str, weight: Column, shown: str, k: int = TOP) -> DataFrame:
    kept = scored.withColumn("w", weight).where(F.col("w") > 0).withColumn("weight", F.round("w", 2))
    order = Window.partitionBy(entity).orderBy(F.desc("weight"), "term_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(entity, "term_id", "weight", F.col(shown).alias("n"), "rank")


def spread(m: Model) -> DataFrame:
    """How many people use each term."""
    return m.member_term().groupBy("term_id").agg(F.count_distinct("person_id").alias("people"))


def speech_frequency(m: Model) -> DataFrame:
    return m.member_term().groupBy("term_id").agg(F.sum("sp").alias("speeches"))


def meeting_frequency(m: Model) -> DataFrame:
    return m.meeting_term().groupBy("term_id").agg(F.count("*").alias("meetings"))


def house(m: Model) -> DataFrame:
    """What party members said outside the chair, without stop words: (party_id, term_id, n, sp)."""
    rows = m.member_term().where("party_id is not null and person_id is not null").join(m.presiding(), "person_id", "left_anti")
    return rows.join(m.content_term().select("term_id"), "term_id").groupBy("party_id", "term_id").agg(F.sum("n").alias("n"), F.sum("sp").alias("sp"))


def house_baseline(m: Model) -> DataFrame:
    return house(m).groupBy("term_id").agg(F.sum("n").alias("n"), F.sum("sp").alias("sp"))


def _scalar(df: DataFrame, one: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k").drop("_k")


def person_cloud(m: Model, mode: str) -> DataFrame:
    """distinctive: n * ln(people / spread); tfidf: speeches * ln(all speeches / speeches with it); frequent: n.

    A person with more than 300 distinct terms needs a count of 2; the own name's words are left out. Presiding officers and rows without a party count.
    """
    rows = m.member_term().where("person_id is not null").groupBy("person_id", "term_id").agg(F.sum("n").alias("n"), F.sum("sp").alias("sp"))
    rows = rows.join(m.content_term(), "term_id").withColumn("least", F.when(F.count("*").over(Window.partitionBy("person_id")) > 300, 2).otherwise(1))
    rows = rows.where((F.col("n") >= F.col("least")) & F.col("term").rlike(CLOUD_TERM)).join(m.own_words(), ["person_id", "term"], "left_anti")
    if mode == "distinctive":
        rows = _scalar(rows.join(spread(m), "term_id", "left").fillna(1, ["people"]), m.member_term().agg(F.count_distinct("person_id").alias("all")))
        return top_terms(rows, "person_id", F.col("n") * F.ln(F.col("all") / F.col("people")), "n")
    if mode == "tfidf":
        total = m.speech().where("person_id is not null").agg(F.count("*").alias("all"))
        rows = _scalar(rows.where("sp >= least").join(speech_frequency(m), "term_id", "left").fillna(1, ["speeches"]), total)
        return top_terms(rows, "person_id", F.col("sp") * F.ln(F.col("all") / F.col("speeches")), "sp")
    return top_terms(rows, "person_id", F.col("n").cast("double"), "n")


def party_cloud(m: Model, mode: str, parties: DataFrame | None = None) -> DataFrame:
    """Log-odds with an informative Dirichlet prior against all other parties, in words or in speeches; or raw counts."""
    unit = "sp" if mode == "distinctive_speech" else "n"
    base = house(m).select("party_id", "term_id", F.col(unit).alias("y"))
    # a row a party: small, and no window holds a party's terms
    rows = base.join(base.groupBy("party_id").agg(F.sum("y").alias("own")), "party_id")
    rows = rows.join(m.content_term().join(m.skipped_terms(parties), "term", "left_anti"), "term_id").where((F.col("y") >= F.when(F.col("own") > 50_000, 5).otherwise(2)) & F.col("term").rlike(CLOUD_TERM))
    if mode == "frequent":
        return top_terms(rows, "party_id", F.col("y").cast("double"), "y")
    totals = base.groupBy("term_id").agg(F.sum("y").alias("total"))
    rows = _scalar(rows.join(totals, "term_id"), base.agg(F.sum("y").alias("grand")))
    y, total, grand, own = (F.col(c).cast("double") for c in ("y", "total", "grand", "own"))
    prior, rest, other = PRIOR * total / grand, F.greatest(grand - own, F.lit(1.0)), total - y
    delta = F.ln((y + prior) / (own + PRIOR - y - prior)) - F.ln((other + prior) / (rest + PRIOR - other - prior))
    return top_terms(rows, "party_id", delta / F.sqrt(1 / (y + prior) + 1 / (other + prior)), "y")


def meeting_cloud(m: Model, mode: str, parties: DataFrame | None = None) -> DataFrame:
    rows = m.meeting_term().where("n >= 2").join(m.content_term().join(m.skipped_terms(parties), "term", "left_anti"), "term_id").where(F.col("term").rlike(CLOUD_TERM))
    if mode == "frequent":
        return top_terms(rows, "meeting_id", F.col("n").cast("double"), "n")
    rows = _scalar(rows.join(meeting_frequency(m), "term_id", "left").fillna(1, ["meetings"]), m.meeting_term().agg(F.count_distinct("meeting_id").alias("all")))
    return top_terms(rows, "meeting_id", F.col("n") * F.ln(F.col("all") / F.col("meetings")), "n")
