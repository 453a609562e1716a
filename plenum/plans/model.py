"""The analytic tables behind all queries: repeats removed, counts added up, no texts unless asked for."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import TITLES
from ..operators import names
from ..session import table

_SPEECH = ["meeting_id", "meeting_date", "ordinal", "person_id", "party_id", "province", "party_source", "speaker_source", "speaker_label", "start_clock", "word_count"]


class Model:
    """Lazy frames over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def speech(self, *extra: str | Column, where: Column | None = None) -> DataFrame:
        """One row a speech. Repeats differ only in scraped_at, so distinct rows without it are the speeches.

        `extra` columns and `where` are evaluated before repeats are removed: what is small is computed from a text before
        the shuffle, and texts that are not asked for never take part in it.
        """
        rows = self.raw("speeches") if where is None else self.raw("speeches").where(where)
        return rows.select(F.col("id").alias("speech_id"), *_SPEECH, *extra).dropDuplicates(["speech_id"])

    def speech_term(self) -> DataFrame:
        return self.raw("speech_terms").where("count > 0").groupBy("speech_id", "term_id").agg(F.max("count").cast("long").alias("n"))

    def member_term(self) -> DataFrame:
        return self.raw("member_terms").groupBy("party_id", "person_id", "term_id").agg(F.sum("count").alias("n"), F.sum("speeches").alias("sp"))

    def meeting_term(self) -> DataFrame:
        return self.raw("meeting_terms").groupBy("meeting_id", "term_id").agg(F.sum("count").alias("n"))

    def term(self) -> DataFrame:
        return self.raw("terms").groupBy(F.col("id").alias("term_id")).agg(F.min("term").alias("term"), F.max(F.coalesce("is_stopword", F.lit(False))).alias("is_stopword"))

    def content_term(self) -> DataFrame:
        return self.term().where("not is_stopword").select("term_id", "term")

    def person(self) -> DataFrame:
        return self.raw("persons").groupBy(F.col("id").alias("person_id")).agg(F.min("name").alias("name"), F.min("name_key").alias("name_key"), F.max(F.coalesce("is_presiding", F.lit(False))).alias("is_presiding"), F.max(F.coalesce("is_mp", F.lit(False))).alias("is_mp"))

    def own_words(self) -> DataFrame:
        """(person_id, term): the words of everyone's own name."""
        rows = self.person().where("name is not null").select("person_id", F.explode(names.bare_words("name")).alias("term"))
        return rows.where("term <> ''").distinct()

    def skipped_terms(self, parties: DataFrame | None = None) -> DataFrame:
        """(term): people's names, places and "พรรค" with a party's name, which say nothing about a party or a meeting."""
        places = self.raw("speeches").where("province is not null").select(F.col("province").alias("term"))
        words = self.own_words().select("term").unionByName(places)
        if parties is not None:
            words = words.unionByName(parties.select(F.concat(F.lit("พรรค"), F.col("party")).alias("term")))
        return words.distinct()

    def presiding(self) -> DataFrame:
        return self.person().where("is_presiding").select("person_id")


TITLED = "|".join(re.escape(t) for t in sorted(TITLES, key=lambda t: (-len(t), t)))
#: The same tables as SQL, to stand before a query.
SQL = """
WITH speech AS (SELECT id AS speech_id, ANY_VALUE(meeting_id) AS meeting_id, ANY_VALUE(meeting_date) AS meeting_date, ANY_VALUE(ordinal) AS ordinal,
    ANY_VALUE(person_id) AS person_id, ANY_VALUE(party_id) AS party_id, ANY_VALUE(province) AS province, ANY_VALUE(speaker_label) AS speaker_label,
    ANY_VALUE(speaker_source) AS speaker_source, ANY_VALUE(start_clock) AS start_clock, ANY_VALUE(word_count) AS word_count, ANY_VALUE(text) AS text, ANY_VALUE(breaks) AS breaks FROM speeches GROUP BY id),
speech_term AS (SELECT speech_id, term_id, CAST(MAX(count) AS BIGINT) AS n FROM speech_terms WHERE count > 0 GROUP BY ALL),
member_term AS (SELECT party_id, person_id, term_id, CAST(SUM(count) AS BIGINT) AS n, CAST(SUM(speeches) AS BIGINT) AS sp FROM member_terms GROUP BY ALL),
meeting_term AS (SELECT meeting_id, term_id, CAST(SUM(count) AS BIGINT) AS n FROM meeting_terms GROUP BY ALL),
term AS (SELECT id AS term_id, MIN(term) AS term, MAX(COALESCE(is_stopword, FALSE)) AS is_stopword FROM terms GROUP BY id),
content_term AS (SELECT term_id, term FROM term WHERE NOT is_stopword),
person AS (SELECT id AS person_id, MIN(name) AS name, MIN(name_key) AS name_key, MAX(COALESCE(is_presiding, FALSE)) AS is_presiding, MAX(COALESCE(is_mp, FALSE)) AS is_mp FROM persons GROUP BY id),
own_words AS (SELECT DISTINCT person_id, unnest(string_split_regex(regexp_replace(name, '^(?:(?:%s) ?)+', ''), ' +')) AS term FROM person WHERE name IS NOT NULL),
skipped AS (SELECT term FROM own_words UNION SELECT province FROM speeches WHERE province IS NOT NULL)
""" % TITLED
