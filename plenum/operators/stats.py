"""Rankings, shares and listings over speeches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contrast_text
from ..plans.model import Model


def totals(speech: DataFrame, by: str) -> DataFrame:
    return speech.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias("speeches"), F.sum("word_count").alias("words"), F.count_distinct("meeting_id").alias("meetings"),
        F.count_distinct("person_id").alias("members"), F.min("meeting_date").alias("first_day"), F.max("meeting_date").alias("last_day"),
    )


def latest_party(m: Model) -> DataFrame:
    """The party of each person's last speech that has one (date, then ordinal, then id)."""
    w = Window.partitionBy("person_id").orderBy(F.desc("meeting_date"), F.desc("ordinal"), F.desc("speech_id"))
    rows = m.speech().where("person_id is not null and party_id is not null")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("person_id", "party_id", "meeting_date")


def modal(m: Model, by: str, value: str) -> DataFrame:
    """The most frequent value per key; ties to the least value."""
    counts = m.speech().where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), value)
    return counts.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(by, value, "n")


def person_ranks(m: Model) -> DataFrame:
    """Competition ranks of all people; each stat is counted per value first, so no task sorts all people."""
    return _ranks(totals(m.speech(), "person_id"), "person_id", ["speeches", "words", "meetings"])


def party_ranks(m: Model) -> DataFrame:
    t = totals(m.speech(), "party_id").withColumn("words_per_member", F.bround(F.col("words") / F.col("members")).cast("long"))
    return _ranks(t, "party_id", ["speeches", "words", "meetings", "words_per_member"], True)


def _ranks(t: DataFrame, key: str, stats: list[str], ties: bool = False) -> DataFrame:
    """Long form (key, stat, value, rank[, of, tied]). Ranking runs over the distinct values of a stat."""
    long_ = t.select(key, F.explode(F.create_map(*[x for s in stats for x in (F.lit(s), F.col(s).cast("long"))])).alias("stat", "value"))
    per_value = long_.groupBy("stat", "value").agg(F.count("*").alias("tied"))
    above = F.sum("tied").over(Window.partitionBy("stat").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))
    ranked = per_value.withColumn("rank", F.coalesce(above, F.lit(0)) + 1).withColumn("of", F.sum("tied").over(Window.partitionBy("stat")))
    out = long_.join(ranked, ["stat", "value"]).select(key, "stat", "value", "rank", *(["of", "tied"] if ties else []))
    return out


def day_shares(m: Model, small: float = 0.02) -> DataFrame:
    """Each party's share of a day's words; parties under `small` fold into party -1. Presiding officers and unlabelled speech are out."""
    rows = m.speech().where("person_id is not null and party_id is not null").join(m.presiding(), "person_id", "left_anti")
    per = rows.groupBy("meeting_date", "party_id").agg(F.sum("word_count").alias("words"))
    share = F.col("words") / F.sum("words").over(Window.partitionBy("meeting_date"))
    folded = per.withColumn("share", share).withColumn("party", F.when(F.col("share") >= small, F.col("party_id")).otherwise(-1))
    return folded.groupBy("meeting_date", "party").agg(F.sum("words").alias("words"), F.round(F.sum("share"), 6).alias("share"))


# Gap between the segments of a ring, and the least length that is drawn, in hundredths of the circle.
RING_GAP, RING_LEAST = 0.8, 0.3


def ring_offsets(m: Model) -> DataFrame:
    """Where each party's segment of a day's ring begins: the words before it, largest first; and its dash and offset strings.

    Segments leave a gap where the day has several; one that is too short to be drawn has no strings.
    """
    day = Window.partitionBy("meeting_date")
    before = F.coalesce(F.sum("words").over(day.orderBy(F.desc("words"), "party").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = day_shares(m).select("meeting_date", "party", "words", before.alias("before"), F.sum("words").over(day).alias("_all"), F.count("*").over(day).alias("_n"))
    part = lambda c: F.col(c) / F.greatest("_all", F.lit(1)) * 100
    rows = rows.withColumn("_len", part("words") - F.when(F.col("_n") > 1, RING_GAP).otherwise(0.0))
    drawn = F.col("_len") > RING_LEAST
    dash = F.format_string("%.2f %.2f", "_len", 100 - F.col("_len"))
    return rows.select("meeting_date", "party", "words", "before", F.when(drawn, dash).alias("dash"), F.when(drawn, F.format_string("%.2f", -part("before"))).alias("offset"))


def party_tags(parties: DataFrame, logos: list[str]) -> DataFrame:
    """(party, style, logo, letter): the tag of each party; its first letter where its logo is not among the files.

    parties (party, color, logo); a colour that is none gives no style. `logos` are the names of a folder's files.
    """
    ink = contrast_text(F.col("color"))
    logo = F.when(F.col("logo").isin(*logos), F.col("logo")) if logos else F.lit(None).cast("string")
    style = F.when(ink.isNotNull(), F.concat(F.lit("--pc: "), F.col("color"), F.lit("; --pf: "), ink)).otherwise("")
    return parties.select("party", style.alias("style"), logo.alias("logo"), F.when(logo.isNull(), F.substring("party", 1, 1)).alias("letter"))


def day_totals(m: Model) -> DataFrame:
    return m.speech().groupBy("meeting_date").agg(F.count("*").alias("speeches"), F.sum("word_count").alias("words"), F.count_distinct("person_id").alias("people"))


def neighbours(m: Model) -> DataFrame:
    """Every meeting day with the one before and after; the days are few even in a large archive."""
    w = Window.partitionBy(F.lit(1)).orderBy("meeting_date")
    return m.speech().select("meeting_date").distinct().select("meeting_date", F.lag("meeting_date").over(w).alias("previous"), F.lead("meeting_date").over(w).alias("following"))


def disc_scale(m: Model) -> DataFrame:
    """Disc size of a day: 1.5 times the root of its share of the busiest day's words, at least 0.6."""
    days = day_totals(m)
    most = days.agg(F.max("words").alias("most")).withColumn("_k", F.lit(1))
    return days.withColumn("_k", F.lit(1)).join(F.broadcast(most), "_k").select("meeting_date", F.round(F.greatest(F.lit(0.6), 1.5 * F.sqrt(F.col("words") / F.col("most"))), 6).alias("scale"))


def others(m: Model, shown: int = 200) -> DataFrame:
    """The speakers with the most words, and one row per party for the rest."""
    t = totals(m.speech(), "person_id").select("person_id", "words").join(latest_party(m).select("person_id", "party_id"), "person_id", "left")
    first = t.orderBy(F.desc("words"), "person_id").limit(shown)
    rest = t.join(first.select("person_id"), "person_id", "left_anti").groupBy("party_id").agg(F.sum("words").alias("words"), F.count("*").alias("people"))
    return first.select("person_id", "party_id", "words", F.lit(1).cast("long").alias("people")).unionByName(rest.select(F.lit(None).cast("long").alias("person_id"), "party_id", "words", "people"))


def calendar(m: Model) -> DataFrame:
    """Every day of each month that has a meeting, with the meeting's words where there is one."""
    days = day_totals(m).select("meeting_date", "words")
    months = days.select(F.trunc("meeting_date", "month").alias("month")).distinct()
    spine = months.select("month", F.explode(F.sequence("month", F.last_day("month"))).alias("day"))
    return spine.join(days, spine["day"] == days["meeting_date"], "left").select("month", "day", (F.dayofweek("day") - 1).alias("weekday"), "words")


def roles(m: Model) -> DataFrame:
    """The roles people were announced with: no provinces, no generic labels; spellings that differ in blanks are one."""
    s = m.speech().where("person_id is not null and speaker_label is not null")
    places = m.speech().where("province is not null").select(F.col("province").alias("speaker_label")).distinct()
    rows = s.join(places, "speaker_label", "left_anti").where(~F.col("speaker_label").isin("แบบบัญชีรายชื่อ", "สมาชิกสภาผู้แทนราษฎร") & ~F.col("speaker_label").contains("ได้ยืน"))
    per = rows.groupBy("person_id", "speaker_label").agg(F.count("*").alias("n")).withColumn("flat", F.regexp_replace("speaker_label", " ", ""))
    w = Window.partitionBy("person_id", "flat").orderBy(F.desc("n"), "speaker_label")
    best = per.withColumn("total", F.sum("n").over(Window.partitionBy("person_id", "flat"))).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.select("person_id", F.trim("speaker_label").alias("role"), F.col("total").alias("n"))


def person_parties(m: Model) -> DataFrame:
    return m.speech().where("person_id is not null and party_id is not null").groupBy("person_id", "party_id").agg(F.count("*").alias("n"), F.max("meeting_date").alias("last_day"))


def party_overview(m: Model) -> DataFrame:
    """Per-party totals and share of all words, party-less speech included in the whole."""
    whole = m.speech().agg(F.sum("word_count").alias("whole")).withColumn("_k", F.lit(1))
    t = totals(m.speech(), "party_id").withColumn("_k", F.lit(1)).join(F.broadcast(whole), "_k")
    return t.select("party_id", "speeches", "words", "meetings", "members", F.round(F.col("words") / F.col("whole"), 6).alias("share"))


def speech_topics(topics: DataFrame, labels: DataFrame, speeches: DataFrame) -> DataFrame:
    """Topic labels with their speech, null where the speech is gone: topics (topic_id, topic), labels (topic_id, speech_key, source, confidence)."""
    return labels.join(topics, "topic_id").join(speeches, "speech_key", "left")


def relative_to_largest(t: DataFrame, value: str, within: list[str] | None = None) -> DataFrame:
    """Adds `relative`: each value against the largest of its group, for bars and discs."""
    return t.withColumn("relative", F.round(F.col(value) / F.max(value).over(Window.partitionBy(*(within or [F.lit(1)]))), 6))


def share_pivot(m: Model, parties: list[int]) -> DataFrame:
    """One column a party with its share of each day's words (0 where it said nothing); the parties are given."""
    return day_shares(m).groupBy("meeting_date").pivot("party", parties).agg(F.first("share")).na.fill(0.0)


def bubbles(m: Model) -> DataFrame:
    """One bubble a speaker with words: the area follows the words, so the radius their root against the largest."""
    t = totals(m.speech(), "person_id").select("person_id", "words").where("words > 0")
    most = t.agg(F.max("words").alias("most")).withColumn("_k", F.lit(1))
    rows = t.join(m.person().select("person_id", "name"), "person_id").withColumn("_k", F.lit(1)).join(F.broadcast(most), "_k")
    return rows.select("person_id", "name", "words", F.round(F.sqrt(F.col("words") / F.col("most")), 6).alias("radius"))
