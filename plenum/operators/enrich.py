"""Dimensions and gap filling: roster match, party and province fills, presiding officers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import Model
from ..session import short_list

# Labels under which the chair speaks.
CHAIR = ("ประธานสภา", "รองประธานสภา", "ประธานในที่ประชุม", "ประธานที่ประชุม")


def is_chair(label: Column) -> Column:
    found = F.lit(False)
    for c in CHAIR:
        found = found | F.coalesce(F.trim(label).startswith(c), F.lit(False))
    return found


def presiding(m: Model) -> DataFrame:
    """Everyone who spoke at least once under a chair's label."""
    return m.speech().where("person_id is not null").groupBy("person_id").agg(F.bool_or(is_chair(F.col("speaker_label"))).alias("is_presiding"))


def roster_match(m: Model) -> DataFrame:
    """Roster rows with the person of the same name key (the least id of equal keys), null where there is none."""
    people = m.person().groupBy("name_key").agg(F.min("person_id").alias("found_id"))
    return m.raw("members").dropDuplicates(["member_no"]).select("member_no", "name_key").join(people, "name_key", "left").select("member_no", "found_id")


def is_mp(m: Model) -> DataFrame:
    matched = m.raw("members").where("person_id is not null").select("person_id").distinct().withColumn("is_mp", F.lit(True))
    return m.person().select("person_id").join(matched, "person_id", "left").select("person_id", F.coalesce("is_mp", F.lit(False)).alias("is_mp"))


def roster_fill(m: Model) -> DataFrame:
    """Speeches with parties and provinces filled from the roster.

    A party only where the person has none on any speech, a province wherever it is missing; of several roster rows of a
    person the lowest member number counts.
    """
    roster = m.raw("members").where("person_id is not null").groupBy("person_id").agg(F.min_by("party_id", "member_no").alias("r_party"), F.min_by("province", "member_no").alias("r_province"))
    s = m.speech()
    partyless = s.groupBy("person_id").agg(F.max("party_id").alias("any_party")).where("any_party is null and person_id is not null").select("person_id", F.lit(True).alias("partyless"))
    rows = s.join(roster, "person_id", "left").join(partyless, "person_id", "left")
    party = F.when(F.col("partyless"), F.coalesce("party_id", "r_party")).otherwise(F.col("party_id"))
    source = F.when(F.col("party_id").isNull() & party.isNotNull(), "roster")
    return rows.select("speech_id", party.alias("party_id"), F.coalesce("province", "r_province").alias("province"), source.alias("filled_by"))


def intro_fill(speeches: DataFrame, persons: DataFrame, parties: DataFrame) -> DataFrame:
    """(person_id, party): people without any party who name exactly one when they introduce themselves.

    persons (person_id, first_name), parties (party), speeches (person_id, party_id, text): the first name must stand in
    the first 250 characters, the introduction in the first 400. The party list is a small dimension turned to a pattern.
    """
    names = sorted((r[0] for r in short_list(parties.select("party").where("party is not null").distinct(), 1000)), key=lambda p: (-len(p), p))
    escape = lambda s: "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in s)
    pattern = r"(?:สมาชิก(?:สภา)?ผู้แทนราษฎร|ส\.ส\.).{0,60}?พรรค\s?(" + "|".join(map(escape, names)) + ")"
    known = speeches.groupBy("person_id").agg(F.max("party_id").alias("p")).where("p is null and person_id is not null").select("person_id")
    heads = speeches.join(known, "person_id", "left_semi").select("person_id", F.substring("text", 1, 400).alias("head")).join(persons, "person_id")
    said = heads.where(F.substring("head", 1, 250).contains(F.col("first_name"))).select("person_id", F.regexp_extract("head", pattern, 1).alias("party")).where("party <> ''")
    return said.groupBy("person_id").agg(F.count_distinct("party").alias("n"), F.min("party").alias("party")).where("n = 1").select("person_id", "party")


def usual_party(m: Model) -> DataFrame:
    """The most frequent site party of a person; ties to the one seen first."""
    s = m.speech().where("person_id is not null and party_id is not null and party_source = 'site'")
    per = s.groupBy("person_id", "party_id").agg(F.count("*").alias("n"), F.min(F.struct("meeting_date", "ordinal", "speech_id")).alias("first"))
    w = Window.partitionBy("person_id").orderBy(F.desc("n"), "first")
    return per.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("person_id", "party_id")


def fill_colours(parties: DataFrame, colours: DataFrame) -> DataFrame:
    """Parties with their colours; null where the list has none."""
    return parties.join(colours, "party", "left")


def uncoloured(parties: DataFrame) -> DataFrame:
    """The parties that still have no colour, to be reported."""
    return parties.where("color is null").select("party")
