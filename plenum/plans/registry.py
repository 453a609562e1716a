"""The queries by name, and the same questions as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clouds, enrich, incremental, mining, names, search, sequence, stats, tokenize
from ..session import short_list
from ..sources import meetings
from .model import SQL, TITLED, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: How many keys of repeated rows are sent to all tasks; more are joined in a shuffle.
BROADCAST_KEYS = 1_000_000


def _add(name: str, query: Callable[[Model], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: query(Model(spark, folder))
    if sql:
        ORACLE[name] = SQL + ("" if sql.lstrip().upper().startswith("SELECT") else ", ") + sql


# --- aggregates ---------------------------------------------------------------------------------------------------
_HOUSE = """house AS (SELECT m.party_id, m.term_id, SUM(n) AS n, SUM(sp) AS sp FROM member_term m JOIN content_term USING (term_id) JOIN person p USING (person_id)
  WHERE m.party_id IS NOT NULL AND NOT p.is_presiding GROUP BY ALL)"""
_add("agg4_spread", clouds.spread, "SELECT term_id, COUNT(DISTINCT person_id) AS people FROM member_term GROUP BY term_id")
_add("agg5_house_baseline", clouds.house_baseline, _HOUSE + " SELECT term_id, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(sp) AS BIGINT) AS sp FROM house GROUP BY term_id")
_add("agg6_speech_frequency", clouds.speech_frequency, "SELECT term_id, CAST(SUM(sp) AS BIGINT) AS speeches FROM member_term GROUP BY term_id")
_add("agg6_meeting_frequency", clouds.meeting_frequency, "SELECT term_id, COUNT(*) AS meetings FROM meeting_term GROUP BY term_id")


def member_terms(m: Model) -> DataFrame:
    """What each (party, person) said: counts and speeches per term; no party is a group of its own."""
    s = m.speech().where("person_id is not null").select("speech_id", "party_id", "person_id")
    return m.speech_term().join(s, "speech_id").groupBy("party_id", "person_id", "term_id").agg(F.sum("n").alias("n"), F.count("*").alias("sp"))


def meeting_terms(m: Model) -> DataFrame:
    """What each meeting was about: presiding officers and unlabelled speeches are left out."""
    s = m.speech().where("person_id is not null").join(m.presiding(), "person_id", "left_anti").select("speech_id", "meeting_id")
    return m.speech_term().join(s, "speech_id").groupBy("meeting_id", "term_id").agg(F.sum("n").alias("n"))


_add("agg7_member_terms", member_terms, "SELECT s.party_id, s.person_id, t.term_id, CAST(SUM(t.n) AS BIGINT) AS n, COUNT(*) AS sp FROM speech s JOIN speech_term t USING (speech_id) WHERE s.person_id IS NOT NULL GROUP BY ALL")
_add("agg8_meeting_terms", meeting_terms, "SELECT s.meeting_id, t.term_id, CAST(SUM(t.n) AS BIGINT) AS n FROM speech s JOIN speech_term t USING (speech_id) JOIN person p USING (person_id) WHERE NOT p.is_presiding GROUP BY ALL")
_CHAIR = " OR ".join(f"starts_with(trim(speaker_label), '{c}')" for c in enrich.CHAIR)
_add("agg9_presiding", enrich.presiding, f"SELECT person_id, COALESCE(BOOL_OR(COALESCE({_CHAIR}, FALSE)), FALSE) AS is_presiding FROM speech WHERE person_id IS NOT NULL GROUP BY person_id")
_LATIN = "tok AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[-''][A-Za-z0-9]+)*'), lambda x: lower(x)), lambda x: length(x) >= 2)) AS term FROM documents)"
_add("agg10_bag_of_words", lambda m: tokenize.bag_of_words(m.raw("documents"), "doc_id", tokenize.latin_tokens(F.col("text"))), _LATIN + " SELECT doc_id, term, COUNT(*) AS n FROM tok GROUP BY ALL")
_add("agg12_usual_party", enrich.usual_party, """
c AS (SELECT person_id, party_id, COUNT(*) AS n, MIN((meeting_date, ordinal, speech_id)) AS f FROM (SELECT s.*, party_source FROM speech s JOIN (SELECT id, ANY_VALUE(party_source) AS party_source FROM speeches GROUP BY id) x ON x.id = s.speech_id)
  WHERE person_id IS NOT NULL AND party_id IS NOT NULL AND party_source = 'site' GROUP BY ALL)
SELECT person_id, party_id FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY n DESC, f) = 1""")
_add("agg20_bigrams", lambda m: m.raw("documents").select(F.explode(tokenize.ngrams(tokenize.latin_tokens(F.col("text")), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), """
l AS (SELECT list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[-''][A-Za-z0-9]+)*'), lambda x: lower(x)), lambda x: length(x) >= 2) AS t FROM documents),
g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM l WHERE len(t) > 1)
SELECT gram, COUNT(*) AS n FROM g GROUP BY gram""")
_add("agg21_abbreviations", lambda m: tokenize.abbreviation_counts(m.raw("documents").select("doc_id", "text"), "text"))
_add("agg23_others", stats.others, """
t AS (SELECT person_id, CAST(SUM(word_count) AS BIGINT) AS words FROM speech WHERE person_id IS NOT NULL GROUP BY person_id),
l AS (SELECT person_id, party_id FROM speech WHERE person_id IS NOT NULL AND party_id IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY meeting_date DESC, ordinal DESC, speech_id DESC) = 1),
r AS (SELECT t.person_id, party_id, words, ROW_NUMBER() OVER (ORDER BY words DESC, t.person_id) AS rn FROM t LEFT JOIN l USING (person_id))
SELECT person_id, party_id, words, CAST(1 AS BIGINT) AS people FROM r WHERE rn <= 200
UNION ALL SELECT NULL, party_id, CAST(SUM(words) AS BIGINT), COUNT(*) FROM r WHERE rn > 200 GROUP BY party_id""")
_add("agg26_day_counts", stats.day_totals, "SELECT meeting_date, COUNT(*) AS speeches, CAST(SUM(word_count) AS BIGINT) AS words, COUNT(DISTINCT person_id) AS people FROM speech GROUP BY meeting_date")
_add("agg27_months", lambda m: m.speech().groupBy(F.date_format("meeting_date", "yyyy-MM").alias("month")).agg(F.count_distinct("meeting_id").alias("meetings"), F.count("*").alias("speeches")), "SELECT strftime(meeting_date, '%Y-%m') AS month, COUNT(DISTINCT meeting_id) AS meetings, COUNT(*) AS speeches FROM speech GROUP BY 1")

# --- clouds -------------------------------------------------------------------------------------------------------
_RE = "regexp_matches(term, '^[ก-๏A-Za-z][ก-๏A-Za-z0-9 .]*$')"
_PERSON = f""", pt AS (SELECT person_id, term_id, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(sp) AS BIGINT) AS sp FROM member_term WHERE person_id IS NOT NULL GROUP BY ALL),
base AS (SELECT pt.*, term, CASE WHEN COUNT(*) OVER (PARTITION BY person_id) > 300 THEN 2 ELSE 1 END AS least FROM pt JOIN content_term USING (term_id)),
b AS (SELECT * FROM base WHERE n >= least AND {_RE} AND (person_id, term) NOT IN (SELECT person_id, term FROM own_words WHERE term IS NOT NULL))"""
_SKIP = "term NOT IN (SELECT term FROM skipped WHERE term IS NOT NULL)"


def _cloud_sql(rows: str, entity: str, shown: str) -> str:
    return f""", w AS ({rows}), r AS (SELECT *, ROUND(w, 2) AS weight FROM w WHERE w > 0)
SELECT {entity}, term_id, weight, CAST({shown} AS BIGINT) AS n, CAST(ROW_NUMBER() OVER (PARTITION BY {entity} ORDER BY weight DESC, term_id) AS INTEGER) AS rank FROM r
QUALIFY ROW_NUMBER() OVER (PARTITION BY {entity} ORDER BY weight DESC, term_id) <= {clouds.TOP}"""


def _cloud(name: str, query: Callable[[Model], DataFrame], sql: str) -> None:
    _add(name, query)
    ORACLE[name] = SQL + sql


_cloud("cld1_person_distinctive", lambda m: clouds.person_cloud(m, "distinctive"), _PERSON + _cloud_sql("SELECT *, n * ln(CAST((SELECT COUNT(DISTINCT person_id) FROM member_term) AS DOUBLE) / people) AS w FROM b JOIN (SELECT term_id, COUNT(DISTINCT person_id) AS people FROM member_term GROUP BY 1) USING (term_id)", "person_id", "n"))
_cloud("cld2_person_tfidf", lambda m: clouds.person_cloud(m, "tfidf"), _PERSON + _cloud_sql("SELECT *, sp * ln(CAST((SELECT COUNT(*) FROM speech WHERE person_id IS NOT NULL) AS DOUBLE) / f) AS w FROM b JOIN (SELECT term_id, SUM(sp) AS f FROM member_term GROUP BY 1) USING (term_id) WHERE sp >= least", "person_id", "sp"))
_cloud("cld3_person_frequent", lambda m: clouds.person_cloud(m, "frequent"), _PERSON + _cloud_sql("SELECT *, CAST(n AS DOUBLE) AS w FROM b", "person_id", "n"))


def _party_sql(unit: str, frequent: bool = False) -> str:
    head = f""", {_HOUSE}, h AS (SELECT party_id, term_id, CAST({unit} AS DOUBLE) AS y FROM house),
o AS (SELECT *, SUM(y) OVER (PARTITION BY party_id) AS own FROM h),
b AS (SELECT o.*, term FROM o JOIN content_term USING (term_id) WHERE y >= CASE WHEN own > 50000 THEN 5 ELSE 2 END AND {_RE} AND {_SKIP}),
g AS (SELECT SUM(y) AS grand FROM h), t AS (SELECT term_id, SUM(y) AS total FROM h GROUP BY 1),
x AS (SELECT b.*, total, grand, 5000 * total / grand AS a, GREATEST(grand - own, 1) AS rest, total - y AS z FROM b JOIN t USING (term_id) CROSS JOIN g)"""
    rows = "SELECT *, y AS w FROM x" if frequent else "SELECT *, (ln((y + a) / (own + 5000 - y - a)) - ln((z + a) / (rest + 5000 - z - a))) / sqrt(1 / (y + a) + 1 / (z + a)) AS w FROM x"
    return head + _cloud_sql(rows, "party_id", "y")


_cloud("cld4_party_distinctive", lambda m: clouds.party_cloud(m, "distinctive"), _party_sql("n"))
_cloud("cld5_party_distinctive_speech", lambda m: clouds.party_cloud(m, "distinctive_speech"), _party_sql("sp"))
_cloud("cld6_party_frequent", lambda m: clouds.party_cloud(m, "frequent"), _party_sql("n", True))
_MEETING = f", b AS (SELECT * FROM meeting_term JOIN content_term USING (term_id) WHERE n >= 2 AND {_RE} AND {_SKIP})"
_cloud("cld7_meeting_distinctive", lambda m: clouds.meeting_cloud(m, "distinctive"), _MEETING + _cloud_sql("SELECT *, n * ln(CAST((SELECT COUNT(DISTINCT meeting_id) FROM meeting_term) AS DOUBLE) / f) AS w FROM b JOIN (SELECT term_id, COUNT(*) AS f FROM meeting_term GROUP BY 1) USING (term_id)", "meeting_id", "n"))
_cloud("cld8_meeting_frequent", lambda m: clouds.meeting_cloud(m, "frequent"), _MEETING + _cloud_sql("SELECT *, CAST(n AS DOUBLE) AS w FROM b", "meeting_id", "n"))

# --- windows, ranks, shares ---------------------------------------------------------------------------------------
_TOTALS = "t AS (SELECT {k} AS k, COUNT(*) AS speeches, SUM(word_count) AS words, COUNT(DISTINCT meeting_id) AS meetings, COUNT(DISTINCT person_id) AS members FROM speech WHERE {k} IS NOT NULL GROUP BY 1)"
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT k, '{s}' AS stat, CAST({e} AS BIGINT) AS value FROM t" for s, e in (("speeches", "speeches"), ("words", "words"), ("meetings", "meetings"))) + "{more})"
_add("win1_latest_party", stats.latest_party, "SELECT person_id, party_id, meeting_date FROM speech WHERE person_id IS NOT NULL AND party_id IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY meeting_date DESC, ordinal DESC, speech_id DESC) = 1")
_add("win2_person_ranks", stats.person_ranks, _TOTALS.format(k="person_id") + ", " + _LONG.format(more="") + " SELECT k AS person_id, stat, value, RANK() OVER (PARTITION BY stat ORDER BY value DESC) AS rank FROM l")
_add("win3_party_ranks", stats.party_ranks, _TOTALS.format(k="party_id") + ", " + _LONG.format(more=" UNION ALL SELECT k, 'words_per_member', CAST(round_even(words / members, 0) AS BIGINT) FROM t") + " SELECT k AS party_id, stat, value, RANK() OVER (PARTITION BY stat ORDER BY value DESC) AS rank, COUNT(*) OVER (PARTITION BY stat) AS \"of\", COUNT(*) OVER (PARTITION BY stat, value) AS tied FROM l")
_SHARES = """d AS (SELECT meeting_date, s.party_id, SUM(word_count) AS words FROM speech s JOIN person p USING (person_id) WHERE s.party_id IS NOT NULL AND NOT p.is_presiding GROUP BY ALL),
e AS (SELECT *, words / SUM(words) OVER (PARTITION BY meeting_date) AS share FROM d),
f AS (SELECT meeting_date, CASE WHEN share >= 0.02 THEN party_id ELSE -1 END AS party, CAST(SUM(words) AS BIGINT) AS words, ROUND(SUM(share), 6) AS share FROM e GROUP BY ALL)"""
_add("win4_day_shares", stats.day_shares, _SHARES + " SELECT meeting_date, party, words, share FROM f")
_add("win6_neighbours", stats.neighbours, "SELECT meeting_date, LAG(meeting_date) OVER (ORDER BY meeting_date) AS previous, LEAD(meeting_date) OVER (ORDER BY meeting_date) AS following FROM (SELECT DISTINCT meeting_date FROM speech)")
_add("win7_ring_offsets", lambda m: stats.ring_offsets(m).select("meeting_date", "party", "words", "before"), _SHARES + " SELECT meeting_date, party, words, CAST(COALESCE(SUM(words) OVER (PARTITION BY meeting_date ORDER BY words DESC, party ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM f")
_add("mea2_ring", lambda m: stats.ring_offsets(m).select("meeting_date", "party", F.split("dash", " ").alias("d"), "offset").select("meeting_date", "party", F.get("d", F.lit(0)).cast("double").alias("length"), F.get("d", F.lit(1)).cast("double").alias("rest"), F.col("offset").cast("double").alias("offset")), _SHARES + """,
o AS (SELECT *, COALESCE(SUM(words) OVER (PARTITION BY meeting_date ORDER BY words DESC, party ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, SUM(words) OVER (PARTITION BY meeting_date) AS whole, COUNT(*) OVER (PARTITION BY meeting_date) AS n FROM f),
l AS (SELECT *, words / whole * 100 - CASE WHEN n > 1 THEN 0.8 ELSE 0 END AS len FROM o)
SELECT meeting_date, party, CASE WHEN len > 0.3 THEN ROUND(len, 2) END AS length, CASE WHEN len > 0.3 THEN ROUND(100 - len, 2) END AS rest, CASE WHEN len > 0.3 THEN -ROUND(before / whole * 100, 2) END AS offset FROM l""")
_add("fil2_parameter", lambda m: m.spark.sql("SELECT speech_id, person_id FROM {s} WHERE party_id = :party AND meeting_date >= :day", args={"party": 2, "day": "2020-01-01"}, s=m.speech()), "SELECT speech_id, person_id FROM speech WHERE party_id = 2 AND meeting_date >= DATE '2020-01-01'")
_add("joi13_modal_province", lambda m: stats.modal(m, "person_id", "province"), "c AS (SELECT person_id, province, COUNT(*) AS n FROM speech WHERE person_id IS NOT NULL AND province IS NOT NULL GROUP BY 1, 2) SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY n DESC, province) = 1")
_add("mea3_disc_scale", stats.disc_scale, "d AS (SELECT meeting_date, SUM(word_count) AS w FROM speech GROUP BY 1) SELECT meeting_date, ROUND(GREATEST(0.6, 1.5 * sqrt(w / (SELECT MAX(w) FROM d))), 6) AS scale FROM d")
_add("mea4_roles", stats.roles, """
l AS (SELECT person_id, speaker_label, COUNT(*) AS n FROM speech WHERE person_id IS NOT NULL AND speaker_label IS NOT NULL AND speaker_label NOT IN (SELECT province FROM speech WHERE province IS NOT NULL)
  AND speaker_label NOT IN ('แบบบัญชีรายชื่อ', 'สมาชิกสภาผู้แทนราษฎร') AND NOT contains(speaker_label, 'ได้ยืน') GROUP BY ALL),
f AS (SELECT *, replace(speaker_label, ' ', '') AS flat FROM l)
SELECT person_id, trim(speaker_label) AS role, CAST(SUM(n) OVER (PARTITION BY person_id, flat) AS BIGINT) AS n FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY person_id, flat ORDER BY n DESC, speaker_label) = 1""")
_add("mea5_person_parties", stats.person_parties, "SELECT person_id, party_id, COUNT(*) AS n, MAX(meeting_date) AS last_day FROM speech WHERE person_id IS NOT NULL AND party_id IS NOT NULL GROUP BY ALL")


def _colour() -> Column:
    """Colours made from term ids, some of them no colour or missing."""
    return F.when(F.col("term_id") % 7 == 0, "red").when(F.col("term_id") % 11 != 0, F.concat(F.lit("#"), F.lpad(F.hex(F.col("term_id") * 7919 % 16777216), 6, "0")))


_add("mea7_contrast", lambda m: m.term().select("term_id", _colour().alias("color")).withColumn("text_color", X.contrast_text(F.col("color"))), """
c AS (SELECT term_id, term_id * 7919 % 16777216 AS v, CASE WHEN term_id % 7 = 0 THEN 'red' WHEN term_id % 11 <> 0 THEN '#' || lpad(to_hex(term_id * 7919 % 16777216), 6, '0') END AS color FROM term),
x AS (SELECT *, [(v // 65536) / 255.0, ((v // 256) % 256) / 255.0, (v % 256) / 255.0] AS p FROM c),
y AS (SELECT *, list_transform(p, lambda q: CASE WHEN q <= 0.04045 THEN q / 12.92 ELSE pow((q + 0.055) / 1.055, 2.4) END) AS l FROM x)
SELECT term_id, color, CASE WHEN NOT starts_with(color, '#') OR color IS NULL THEN NULL WHEN 0.2126 * l[1] + 0.7152 * l[2] + 0.0722 * l[3] > 0.179 THEN '#111111' ELSE '#ffffff' END AS text_color FROM y""")
_add("mea10_calendar", stats.calendar, """
d AS (SELECT meeting_date, CAST(SUM(word_count) AS BIGINT) AS words FROM speech GROUP BY 1), mo AS (SELECT DISTINCT CAST(date_trunc('month', meeting_date) AS DATE) AS month FROM d),
s AS (SELECT month, CAST(unnest(generate_series(month, last_day(month), INTERVAL 1 DAY)) AS DATE) AS day FROM mo)
SELECT month, day, CAST(dayofweek(day) AS INTEGER) AS weekday, words FROM s LEFT JOIN d ON d.meeting_date = s.day""")

# --- joins, fills, increments -------------------------------------------------------------------------------------
_ROSTER = "r AS (SELECT person_id, arg_min(party_id, member_no) AS r_party, arg_min(province, member_no) AS r_province FROM members WHERE person_id IS NOT NULL GROUP BY 1)"
_add("joi14_roster_match", enrich.roster_match, "k AS (SELECT name_key, MIN(person_id) AS found_id FROM person GROUP BY 1), m AS (SELECT DISTINCT member_no, name_key FROM members) SELECT member_no, found_id FROM m LEFT JOIN k USING (name_key)")
_add("dml7_roster_fill", enrich.roster_fill, _ROSTER + """, q AS (SELECT person_id FROM speech WHERE person_id IS NOT NULL GROUP BY 1 HAVING MAX(party_id) IS NULL)
SELECT speech_id, CASE WHEN q.person_id IS NOT NULL THEN COALESCE(party_id, r_party) ELSE party_id END AS party_id, COALESCE(province, r_province) AS province,
CASE WHEN party_id IS NULL AND q.person_id IS NOT NULL AND r_party IS NOT NULL THEN 'roster' END AS filled_by FROM speech s LEFT JOIN r USING (person_id) LEFT JOIN q USING (person_id)""")
_add("dml9_is_mp", enrich.is_mp, "SELECT person_id, person_id IN (SELECT person_id FROM members WHERE person_id IS NOT NULL) AS is_mp FROM person")


def _changed(m: Model) -> DataFrame:
    """Speeches delivered again with another scraped_at than the first delivery."""
    s = m.raw("speeches").select(F.col("id").alias("speech_id"), "scraped_at")
    return incremental.changed(s.groupBy("speech_id").agg(F.max("scraped_at").alias("scraped_at")), s.groupBy("speech_id").agg(F.min("scraped_at").alias("scraped_at")), ["speech_id"])


_add("dml1_changed", _changed, "SELECT id AS speech_id, MAX(scraped_at) AS scraped_at FROM speeches GROUP BY 1 HAVING MAX(scraped_at) <> MIN(scraped_at)")
_add("dml3_new_terms", lambda m: incremental.new_keys(m.speech_term(), m.content_term(), "term_id", {"is_stopword": F.lit(False)}), "SELECT DISTINCT term_id, FALSE AS is_stopword FROM speech_term WHERE term_id NOT IN (SELECT term_id FROM content_term)")
_add("dml4_first_alias", lambda m: incremental.first_wins(m.raw("person_aliases").select("person_id", "alias"), "person_id", F.col("alias")), "SELECT person_id, MIN(alias) AS alias FROM person_aliases GROUP BY person_id")
_add("set2_unused_terms", lambda m: m.term().select("term_id").exceptAll(m.speech_term().select("term_id").distinct()), "SELECT term_id FROM term EXCEPT SELECT term_id FROM speech_term")

# --- sequences ----------------------------------------------------------------------------------------------------


def _runs(m: Model) -> DataFrame:
    """Runs of neighbouring speeches of one speaker in a meeting."""
    r = sequence.runs(m.speech().select("meeting_id", "ordinal", "speech_id", "person_id", "word_count"), "meeting_id", ["ordinal", "speech_id"], "person_id")
    return r.groupBy("meeting_id", "run").agg(F.min("person_id").alias("person_id"), F.count("*").alias("speeches"), F.sum("word_count").alias("words")).select("meeting_id", F.col("run").cast("long").alias("run"), "person_id", "speeches", "words")


_add("seq5_runs", _runs, """
a AS (SELECT *, CASE WHEN person_id IS NULL OR ROW_NUMBER() OVER w = 1 OR person_id IS DISTINCT FROM LAG(person_id) OVER w THEN 1 ELSE 0 END AS new FROM speech WINDOW w AS (PARTITION BY meeting_id ORDER BY ordinal, speech_id)),
b AS (SELECT *, SUM(new) OVER (PARTITION BY meeting_id ORDER BY ordinal, speech_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT meeting_id, CAST(run AS BIGINT) AS run, MIN(person_id) AS person_id, COUNT(*) AS speeches, CAST(SUM(word_count) AS BIGINT) AS words FROM b GROUP BY meeting_id, run""")


def _attributed(m: Model) -> DataFrame:
    """Each speech's speaker when an inferred speaker holds until the label changes."""
    s = m.speech().select("meeting_id", "ordinal", "speech_id", F.trim("speaker_label").alias("site"), F.when(F.lower("speaker_source") == "inferred", F.col("person_id").cast("string")).alias("marker"))
    return sequence.attribute(s, "meeting_id", ["ordinal", "speech_id"], "site", "marker").select("speech_id", "who")


_add("seq4_attribution", _attributed, """
a AS (SELECT speech_id, meeting_id, ordinal, trim(speaker_label) AS site, CASE WHEN lower(speaker_source) = 'inferred' THEN CAST(person_id AS VARCHAR) END AS marker FROM speech),
b AS (SELECT *, CASE WHEN ROW_NUMBER() OVER w = 1 OR site IS DISTINCT FROM LAG(site) OVER w THEN 1 ELSE 0 END AS chg FROM a WINDOW w AS (PARTITION BY meeting_id ORDER BY ordinal, speech_id)),
c AS (SELECT *, SUM(chg) OVER (PARTITION BY meeting_id ORDER BY ordinal, speech_id ROWS UNBOUNDED PRECEDING) AS isl FROM b),
d AS (SELECT *, LAST_VALUE(marker IGNORE NULLS) OVER (PARTITION BY meeting_id, isl ORDER BY ordinal, speech_id ROWS UNBOUNDED PRECEDING) AS carried FROM c)
SELECT speech_id, CASE WHEN carried IS NOT NULL AND carried IS DISTINCT FROM site THEN carried ELSE site END AS who FROM d""")


def _assembled(m: Model) -> DataFrame:
    """Every speech's text from its segments, and whether it is the stored one."""
    parts = m.raw("speech_segments").dropDuplicates(["segment_id", "part"]).select("speech_id", "segment_id", "part", "text")
    whole = sequence.assemble(parts, ["speech_id"], ["segment_id", "part"])
    stored = m.speech(F.sha2("text", 256).alias("stored")).select("speech_id", "stored")
    return whole.join(stored, "speech_id").select("speech_id", "segments", F.length("text").alias("chars"), (F.sha2("text", 256) == F.col("stored")).alias("same"))


_add("seq7_assembly", _assembled, """
d AS (SELECT DISTINCT speech_id, segment_id, part, text FROM speech_segments),
w AS (SELECT speech_id, COUNT(*) AS segments, string_agg(text, ' ' ORDER BY segment_id, part) AS t FROM d GROUP BY 1)
SELECT speech_id, segments, CAST(length(t) AS INTEGER) AS chars, t = text AS same FROM w JOIN speech USING (speech_id)""")


def _overlaps(m: Model) -> DataFrame:
    """How many characters at each speech's start repeat the end of the one before in the meeting."""
    s = m.speech(sequence.text_ends("text").alias("ends"), where=F.trim(F.coalesce("text", F.lit(""))) != "").select("meeting_id", "ordinal", "speech_id", "ends")
    return sequence.trim_overlaps(s, "meeting_id", ["ordinal", "speech_id"], "ends").select("speech_id", "cut")


_add("seq1_overlaps", _overlaps)


def _segments(m: Model) -> DataFrame:
    """The stored segments in the form of meeting files: labelled with the speech's person, in the order of their ids."""
    parts = m.raw("speech_segments").dropDuplicates(["segment_id", "part"])
    about = m.speech(F.col("first_start_sec").alias("start")).join(m.person().select("person_id", F.col("name").alias("speaker")), "person_id", "left")
    about = about.select("speech_id", "meeting_id", "speaker", F.col("party_id").cast("string").alias("party"), "province", "start", F.col("start_clock").alias("clip_start"))
    rows = parts.join(about, "speech_id")
    return rows.select("meeting_id", "segment_id", "part", F.concat_ws("-", "segment_id", "part").alias("id"), "start", F.col("start").alias("stop"), "clip_start", "speaker", "party", "province", "text").withColumnRenamed("part", "piece")


def _rebuilt(m: Model) -> DataFrame:
    """Speeches rebuilt from segments by the whole chain: overlap, headings in the text, attribution, runs, assembly."""
    spoken, _ = sequence.speeches(_segments(m), ["meeting_id"], ["segment_id", "piece"])
    return spoken.select("meeting_id", "ordinal", "speech_key", "person", "source", "label", "province", "segments", "chars", F.sha2("text", 256).alias("text_hash"))


_add("seq3_headings", lambda m: sequence.headings(m.raw("speech_segments").dropDuplicates(["segment_id", "part"]), ["segment_id", "part"], "text", m.raw("person_aliases").select(F.trim(F.regexp_replace("alias", r"(?U)\s+", " ")).alias("name"))))
_add("seq7_speeches", _rebuilt)
_add("seq8_lineage", lambda m: sequence.speeches(_segments(m), ["meeting_id"], ["segment_id", "piece"])[1].select("speech_key", "id", "part", F.length("text").alias("chars")))
_add("seq10_clock", lambda m: m.speech(F.col("first_start_sec").alias("sec")).select("speech_id", X.clock_add(F.col("start_clock"), F.col("sec")).alias("clock")), """
x AS (SELECT id AS speech_id, ANY_VALUE(start_clock) AS c, CAST(floor(COALESCE(ANY_VALUE(first_start_sec), 0)) AS BIGINT) AS s FROM speeches GROUP BY id),
y AS (SELECT *, regexp_matches(c, '^([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]$') AS ok FROM x),
z AS (SELECT *, CASE WHEN ok THEN (CAST(split_part(c, ':', 1) AS BIGINT) * 3600 + CAST(split_part(c, ':', 2) AS BIGINT) * 60 + CAST(split_part(c, ':', 3) AS BIGINT) + s) % 86400 END AS t FROM y)
SELECT speech_id, CASE WHEN c IS NULL THEN NULL WHEN ok THEN lpad(CAST(t // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST((t // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') ELSE c END AS clock FROM z""")

# --- names, words, search -----------------------------------------------------------------------------------------
_add("txt6_person_keys", lambda m: names.with_names(m.raw("person_aliases").select("alias", "person_id"), "alias").select("alias", F.col("name_parts.clean").alias("clean"), F.col("name_parts.key").alias("key")))
_add("txt7_pick_display", lambda m: names.pick_display(m.raw("person_aliases").withColumn("n", F.lit(1)), "person_id", "alias", "n"))
_add("tok7_latin_tokens", lambda m: m.raw("documents").select(F.explode(tokenize.latin_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")), _LATIN + " SELECT term, COUNT(*) AS n FROM tok GROUP BY term")
_add("tok9_breaks", lambda m: m.speech("breaks").where("breaks is not null").select("speech_id", F.size(X.decode_breaks(F.col("breaks"))).alias("words"), (X.encode_breaks(X.decode_breaks(F.col("breaks"))) == F.col("breaks")).alias("same")), """
b AS (SELECT speech_id, breaks, regexp_extract_all(breaks, '_[0-9]+_|[0-9a-zA-Z]') AS p FROM speech WHERE breaks IS NOT NULL)
SELECT speech_id, CAST(len(p) AS INTEGER) AS words, COALESCE(array_to_string(p, '') = breaks AND len(list_filter(p, lambda x: x[1] = '_' AND TRY_CAST(replace(x, '_', '') AS BIGINT) < 62)) = 0, FALSE) AS same FROM b""")


def _words(m: Model) -> dict[str, int]:
    """The term list as word frequencies; every term is equally frequent here."""
    return {r[0]: 1000 for r in short_list(m.raw("terms").select("term").where("term is not null").distinct(), 200_000)}


def _thai_words(m: Model) -> DataFrame:
    """Speech texts cut into the words of the term list."""
    s = m.raw("speeches").select(F.col("id").alias("speech_id"), "scraped_at", "text")
    t = tokenize.thai_tokens(s, "text", tokenize.Lexicon(_words(m)))
    # each delivery is counted, and one of equal deliveries kept: no text is shuffled to remove repeats
    per = t.select("speech_id", "scraped_at", F.explode("tokens").alias("term")).groupBy("speech_id", "scraped_at", "term").agg(F.count("*").alias("n"))
    return per.groupBy("speech_id", "term").agg(F.max("n").alias("n"))


_add("tok6_thai_words", _thai_words)


def _texts(m: Model) -> DataFrame:
    """All texts: of speeches, each once, and of documents."""
    return m.speech("text").select("text").unionByName(m.raw("documents").dropDuplicates(["doc_id"]).select("text")).where("text is not null")


def _weighted(m: Model) -> DataFrame:
    """(text, weight): the same texts for sums over them. Every row counts, and later rows of a key are taken off again, so only
    rows of repeated keys are shuffled with their texts."""
    out = []
    for name, key, order in (("speeches", "id", "scraped_at"), ("documents", "doc_id", "ingested_at")):
        rows = m.raw(name)
        again = rows.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").select(F.col(key).alias("again"))
        # a short list of keys goes to the rows; a long one (no limit to it) meets them in a shuffle
        small = again.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        twice = rows.join(F.broadcast(again) if small else again, F.col(key).eqNullSafe(F.col("again")), "left_semi")
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last(), "text"))
        later = twice.select("text", place.alias("place")).where("place > 1 and text is not null")
        out += [rows.where("text is not null").select("text", F.lit(1).alias("weight")), mining.cut(later.select("text", F.lit(-1).alias("weight")))]
    return reduce(DataFrame.unionByName, out)


def _token_bag(m: Model) -> DataFrame:
    """The words of each document in any script; those of each speech are in tok6_thai_words."""
    d = m.raw("documents").dropDuplicates(["doc_id"]).select("doc_id", "text")
    return tokenize.bag_of_words(tokenize.thai_tokens(d, "text", tokenize.Lexicon(_words(m))), "doc_id", F.col("tokens"))


def _token_ngrams(m: Model) -> DataFrame:
    """Counts of all runs of 1 to 5 tokens of all texts; runs of two or more have at most 25 characters."""
    docs = tokenize.thai_tokens(_texts(m), "text", tokenize.Lexicon(_words(m))).select("tokens")
    one = mining.unigrams(docs, "tokens").select(F.array("part").alias("parts"), F.col("uses").alias("n"))
    return one.unionByName(mining.gram_counts(docs, "tokens").select("parts", "n")).select(F.size("parts").alias("length"), F.array_join("parts", " ").alias("gram"), "n")


def _phrases(m: Model) -> DataFrame:
    """Phrases mined in passes over all texts and pruned; names and provinces are blocked."""
    lexicon = m.term().where("term is not null").select(F.col("term").alias("word"), F.lit("dictionary").alias("tier"))
    named = m.raw("person_aliases").select("alias").union(m.person().select("name")).union(m.raw("speeches").select("province").distinct())
    blocked = named.select(F.explode(F.split("alias", r"\s+")).alias("word")).unionByName(named.select(F.regexp_replace("alias", r"\s+", "").alias("word"))).where("word <> ''").distinct()
    found = mining.mine_passes(_weighted(m), "text", _words(m), lexicon, mining.cut(blocked), weight="weight")
    mined = m.spark.createDataFrame([(w, t, n) for w, (t, n) in found.items()], "word string, tier string, n long")
    return m.spark.createDataFrame(mining.prune(mined), "word string, tier string, n long")


_add("agg10_token_bag", _token_bag)
_add("agg20_token_ngrams", _token_ngrams)
_add("min5_phrases", _phrases)
_WORD = "โรงเรียน"


def _hits_sql(word: str) -> str:
    """(speech_id, whole, any): how often the speeches with a word hold it as a whole word, and at all."""
    return f"""c AS (SELECT speech_id, lower(text) AS t, CASE WHEN length(breaks) > 0 THEN breaks END AS b FROM speech WHERE contains(lower(text), '{word}')),
h AS (SELECT *, list_filter(range(0, length(t)), lambda i: substr(t, CAST(i + 1 AS BIGINT), {len(word)}) = '{word}') AS places,
  list_transform(regexp_extract_all(b, '_[0-9]+_|[0-9a-zA-Z]'), lambda x: CASE WHEN x[1] = '_' THEN CAST(replace(x, '_', '') AS BIGINT) ELSE strpos('{X.BASE62}', x) - 1 END) AS gaps FROM c),
k AS (SELECT *, list_transform(range(1, len(gaps) + 1), lambda j: list_sum(gaps[1:j])) AS ends FROM h),
hits AS (SELECT speech_id, CAST(CASE WHEN b IS NULL THEN len(places) ELSE len(list_filter(places, lambda i: list_contains(ends, i) AND list_contains(ends, i + {len(word)}))) END AS INTEGER) AS whole, CAST(len(places) AS INTEGER) AS "any" FROM k)"""


_add("sea1_whole_words", lambda m: search.hits(m.speech("text", "breaks", where=F.lower("text").contains(_WORD)), _WORD).select("speech_id", F.size("hits").alias("whole"), F.size("places").alias("any")).where("any > 0"), _hits_sql(_WORD) + ' SELECT speech_id, whole, "any" FROM hits')
_add("sea3_fallback", lambda m: search.search(m.speech("text", "breaks", where=F.lower("text").contains("โรงเรีย")), "โรงเรีย", "speech_id"), _hits_sql("โรงเรีย") + ', m AS (SELECT MAX(whole) AS most FROM hits) SELECT * FROM (SELECT speech_id, CASE WHEN most > 0 THEN whole ELSE "any" END AS n, most = 0 AS partial FROM hits CROSS JOIN m) WHERE n > 0')
_add("sea2_speaker_search", lambda m: m.person().where(F.lower("name").contains("ชัย")).select("person_id"), "SELECT person_id FROM person WHERE contains(lower(name), 'ชัย')")
_add("sea6_preview", lambda m: m.speech(search.preview(F.col("text"), F.locate(_WORD, "text") - 1).alias("preview"), where=F.col("text").contains(_WORD)).select("speech_id", "preview"), f"SELECT speech_id, substr(text, CAST(CASE WHEN strpos(text, '{_WORD}') - 1 > 200 THEN strpos(text, '{_WORD}') - 200 ELSE 1 END AS BIGINT), 400) AS preview FROM speech WHERE contains(text, '{_WORD}')")
_add("srt8_empties_last", lambda m: m.speech().select("speech_id", search.empties_last(F.col("province")).alias("key")), "SELECT speech_id, CASE WHEN COALESCE(province, '') = '' THEN 2 WHEN province = 'แบบบัญชีรายชื่อ' THEN 1 ELSE 0 END AS key FROM speech")
_add("srt10_pages", lambda m: search.numbered(m.speech().where("person_id is not null").select("person_id", "speech_id", "meeting_date", "ordinal"), "person_id", [F.desc("meeting_date"), F.col("ordinal"), F.col("speech_id")]).select("person_id", "speech_id", "row", "page"), "SELECT person_id, speech_id, CAST(ROW_NUMBER() OVER w AS INTEGER) AS row, CAST(ceil(ROW_NUMBER() OVER w / 20.0) AS INTEGER) AS page FROM speech WHERE person_id IS NOT NULL WINDOW w AS (PARTITION BY person_id ORDER BY meeting_date DESC, ordinal, speech_id)")


def _thai_places(m: Model) -> DataFrame:
    """Every person's place in the dictionary order of names: ranks inside first letters, and the names of the letters before."""
    first = F.regexp_extract("name", "^[เแโใไ]?(.)", 1)
    each = m.person().where("name is not null").select("name").distinct().withColumn("first", first)
    inside = F.row_number().over(Window.partitionBy("first").orderBy(search.thai_order(F.col("name"))))
    sizes = each.groupBy("first").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(search.thai_order(F.col("first"))).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.withColumn("inside", inside).join(sizes.withColumn("before", before), "first").select("name", (F.col("before") + F.col("inside")).alias("place"))
    return m.person().select("person_id", "name").join(placed, "name", "left").select("person_id", "place")


_add("srt7_thai_order", _thai_places)

# --- scalar functions ---------------------------------------------------------------------------------------------
_MONTHS = "[" + ", ".join(f"'{x}'" for x in X.MONTHS) + "]"
_add("fun_thai_date", lambda m: m.speech().select("speech_id", X.thai_date(F.col("meeting_date")).alias("shown")), f"SELECT speech_id, CAST(day(meeting_date) AS VARCHAR) || ' ' || {_MONTHS}[month(meeting_date)] || ' ' || CAST(year(meeting_date) + 543 AS VARCHAR) AS shown FROM speech")
_BLANKS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_add("fun_squeeze", lambda m: m.raw("person_aliases").select("alias", X.squeeze(F.col("alias")).alias("squeezed")), f"SELECT alias, trim(regexp_replace(alias, '{_BLANKS}', ' ', 'g'), ' ') AS squeezed FROM person_aliases")
_add("ext4_formats", lambda m: m.speech(F.col("first_start_sec").alias("sec")).select("speech_id", X.minutes(F.col("sec")).alias("at"), X.number(F.col("word_count")).alias("words")), """
x AS (SELECT id AS speech_id, CAST(floor(ANY_VALUE(first_start_sec)) AS BIGINT) AS s FROM speeches GROUP BY id)
SELECT speech_id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') WHEN s IS NOT NULL THEN CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS at,
  format('{:,}', CAST(COALESCE(word_count, 0) AS BIGINT)) AS words FROM x JOIN speech USING (speech_id)""")

# --- endpoints ----------------------------------------------------------------------------------------------------


def _home(m: Model) -> DataFrame:
    t = stats.totals(m.speech(), "person_id").select("person_id", "speeches", "words", "meetings")
    return m.person().select("person_id", "name").join(t, "person_id").join(stats.latest_party(m).select("person_id", "party_id"), "person_id", "left").join(stats.modal(m, "person_id", "province").select("person_id", "province"), "person_id", "left")


_add("api1_speakers", _home, """
t AS (SELECT person_id, COUNT(*) AS speeches, CAST(SUM(word_count) AS BIGINT) AS words, COUNT(DISTINCT meeting_id) AS meetings FROM speech WHERE person_id IS NOT NULL GROUP BY 1),
l AS (SELECT person_id, party_id FROM speech WHERE person_id IS NOT NULL AND party_id IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY meeting_date DESC, ordinal DESC, speech_id DESC) = 1),
c AS (SELECT person_id, province, COUNT(*) AS n FROM speech WHERE person_id IS NOT NULL AND province IS NOT NULL GROUP BY 1, 2),
v AS (SELECT person_id, province FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY n DESC, province) = 1)
SELECT person_id, name, speeches, words, meetings, party_id, province FROM person JOIN t USING (person_id) LEFT JOIN l USING (person_id) LEFT JOIN v USING (person_id)""")
_add("api2_day_words", lambda m: _day_words(m))


def _day_words(m: Model) -> DataFrame:
    """The five most distinctive words of each meeting."""
    return clouds.meeting_cloud(m, "distinctive").where("rank <= 5").join(m.term().select("term_id", "term"), "term_id").select("meeting_id", "rank", "term", "weight")


ORACLE["api2_day_words"] = "SELECT meeting_id, rank, term, weight FROM (" + ORACLE["cld7_meeting_distinctive"] + ") JOIN (SELECT id AS term_id, MIN(term) AS term FROM terms GROUP BY 1) USING (term_id) WHERE rank <= 5"
_add("api4_meeting_speeches", lambda m: m.speech(F.length("text").alias("chars")).join(m.person().select("person_id", "name"), "person_id", "left").select("meeting_id", "ordinal", "speech_id", "name", "party_id", "chars"), "SELECT meeting_id, ordinal, speech_id, name, s.party_id, CAST(length(text) AS INTEGER) AS chars FROM speech s LEFT JOIN person USING (person_id)")
_add("api9_parties", stats.party_overview, _TOTALS.format(k="party_id") + " SELECT k AS party_id, speeches, CAST(words AS BIGINT) AS words, meetings, members, ROUND(words / (SELECT SUM(word_count) FROM speech), 6) AS share FROM t")


def _party_members(m: Model) -> DataFrame:
    """Members of each party with their counts in it, and their current party where it is another."""
    own = m.speech().where("party_id is not null and person_id is not null").groupBy("party_id", "person_id").agg(F.count("*").alias("speeches"), F.sum("word_count").alias("words"))
    now = stats.latest_party(m).select("person_id", F.col("party_id").alias("now"))
    home = stats.modal(m, "person_id", "province").select("person_id", "province")
    return own.join(now, "person_id").join(home, "person_id", "left").select("party_id", "person_id", "province", "speeches", "words", F.when(F.col("now") != F.col("party_id"), F.col("now")).alias("current_party"))


_add("api10_party_members", _party_members, """
l AS (SELECT person_id, party_id AS cur FROM speech WHERE person_id IS NOT NULL AND party_id IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY meeting_date DESC, ordinal DESC, speech_id DESC) = 1),
o AS (SELECT party_id, person_id, COUNT(*) AS speeches, CAST(SUM(word_count) AS BIGINT) AS words FROM speech WHERE party_id IS NOT NULL AND person_id IS NOT NULL GROUP BY ALL),
c AS (SELECT person_id, province, COUNT(*) AS n FROM speech WHERE person_id IS NOT NULL AND province IS NOT NULL GROUP BY 1, 2),
v AS (SELECT person_id, province FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY n DESC, province) = 1)
SELECT party_id, person_id, province, speeches, words, CASE WHEN cur <> party_id THEN cur END AS current_party FROM o JOIN l USING (person_id) LEFT JOIN v USING (person_id)""")
_add("snk7_json", lambda m: m.speech().select(F.to_json(F.struct("speech_id", "person_id", "province")).alias("value")), """SELECT '{"speech_id":' || speech_id || COALESCE(',"person_id":' || person_id, '') || COALESCE(',"province":"' || province || '"', '') || '}' AS value FROM speech""")


def _day_page(m: Model) -> DataFrame:
    """Every meeting day with the one before and after, its counts, and each speaker's words on it."""
    said = m.speech().where("person_id is not null").groupBy("meeting_date", "person_id").agg(F.count("*").alias("speeches"), F.sum("word_count").alias("words"))
    return said.join(stats.neighbours(m), "meeting_date").join(m.person().select("person_id", "name"), "person_id").select("meeting_date", "previous", "following", "person_id", "name", "speeches", "words")


_add("api3_day_page", _day_page, """
n AS (SELECT meeting_date, LAG(meeting_date) OVER (ORDER BY meeting_date) AS previous, LEAD(meeting_date) OVER (ORDER BY meeting_date) AS following FROM (SELECT DISTINCT meeting_date FROM speech)),
s AS (SELECT meeting_date, person_id, COUNT(*) AS speeches, CAST(SUM(word_count) AS BIGINT) AS words FROM speech WHERE person_id IS NOT NULL GROUP BY ALL)
SELECT meeting_date, previous, following, person_id, name, speeches, words FROM s JOIN n USING (meeting_date) JOIN person USING (person_id)""")


def _answers(m: Model) -> DataFrame:
    """What a request for a person's speeches gets: unknown persons an error, known ones without speeches an empty list."""
    asked = m.person().select("person_id").unionByName(m.spark.createDataFrame([(-1,)], "person_id long"))
    said = m.speech().where("person_id is not null").groupBy("person_id").agg(F.count("*").alias("n"))
    known = m.person().select("person_id", F.lit(True).alias("known"))
    status = F.when(F.col("known"), 200).otherwise(404)
    return asked.join(known, "person_id", "left").join(said, "person_id", "left").select("person_id", status.alias("status"), F.when(F.col("known"), F.coalesce("n", F.lit(0))).alias("speeches"))


_add("api14_answers", _answers, """
a AS (SELECT person_id, TRUE AS known FROM person UNION ALL SELECT -1, FALSE), s AS (SELECT person_id, COUNT(*) AS n FROM speech WHERE person_id IS NOT NULL GROUP BY 1)
SELECT person_id, CASE WHEN known THEN 200 ELSE 404 END AS status, CASE WHEN known THEN COALESCE(n, 0) END AS speeches FROM a LEFT JOIN s USING (person_id)""")


def _listing(m: Model, query: str, day: str, party: int | None) -> DataFrame:
    """Speeches of a day whose speaker's name or province holds a query, of one party (none: no party), with the counts found and in all."""
    rows = m.speech().join(m.person().select("person_id", "name"), "person_id", "left")
    of_party = F.col("party_id").isNull() if party is None else F.col("party_id") == F.lit(party)
    found = F.coalesce(search.holds(["name", "province"], query) & (F.col("meeting_date") >= F.lit(day).cast("date")) & of_party, F.lit(False))
    counts = rows.agg(F.count_if(found).alias("found"), F.count("*").alias("total")).withColumn("_k", F.lit(1))
    return rows.where(found).withColumn("_k", F.lit(1)).join(F.broadcast(counts), "_k").select("speech_id", "found", "total")


_LIST = "r AS (SELECT speech_id, meeting_date, s.party_id, COALESCE(contains(lower(name), '{q}'), FALSE) OR COALESCE(contains(lower(s.province), '{q}'), FALSE) AS hit FROM speech s LEFT JOIN person USING (person_id)), f AS (SELECT speech_id FROM r WHERE hit AND meeting_date >= DATE '{d}' AND {p}) SELECT speech_id, (SELECT COUNT(*) FROM f) AS found, (SELECT COUNT(*) FROM r) AS total FROM f"
_add("sea4_day_filter", lambda m: _listing(m, "ชัย", "2020-01-01", 1), _LIST.format(q="ชัย", d="2020-01-01", p="party_id = 1"))
_add("sea8_no_party", lambda m: _listing(m, "บ", "2020-01-01", None), _LIST.format(q="บ", d="2020-01-01", p="party_id IS NULL"))


def _days_by_share(m: Model) -> DataFrame:
    """The place of every day in the order of one party's share (0 where it said nothing), the larger first, then the later day."""
    shares = stats.day_shares(m).where("party = 1").select("meeting_date", "share")
    rows = m.speech().select("meeting_date").distinct().join(shares, "meeting_date", "left").select("meeting_date", F.coalesce("share", F.lit(0.0)).alias("share"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("share"), F.desc("meeting_date"))))


_add("sea9_days_by_share", _days_by_share, _SHARES + " SELECT meeting_date, COALESCE(share, 0) AS share, CAST(ROW_NUMBER() OVER (ORDER BY COALESCE(share, 0) DESC, meeting_date DESC) AS INTEGER) AS place FROM (SELECT DISTINCT meeting_date FROM speech) LEFT JOIN (SELECT meeting_date, share FROM f WHERE party = 1) USING (meeting_date)")


def _token_index(m: Model) -> DataFrame:
    """The token index of the documents: (doc_id, position, term) of the Latin words, for phrase search."""
    return m.raw("documents").select("doc_id", F.posexplode(tokenize.latin_tokens(F.col("text"))).alias("position", "term"))


_TOKENS = "d AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[-''][A-Za-z0-9]+)*'), lambda x: lower(x)), lambda x: length(x) >= 2) AS t FROM documents)"
_add("snk5_token_index", _token_index, _TOKENS + " SELECT doc_id, CAST(i AS INTEGER) AS position, t[i + 1] AS term FROM d, unnest(range(0, len(t))) AS u(i)")
_add("sea10_phrase", lambda m: search.phrase(m.raw("documents").select("doc_id", tokenize.latin_tokens(F.col("text")).alias("tokens")), "tokens", ["the", "budget"]).select("doc_id", "n"), _TOKENS + " SELECT doc_id, CAST(len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' AND t[i + 1] = 'budget')) AS INTEGER) AS n FROM d WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' AND t[i + 1] = 'budget')) > 0")


def _sorted_table(m: Model) -> DataFrame:
    """Rows of a table under a stacked sort: the newest key first, the ones chosen before as tie-breaks, empties last."""
    rows = _home(m).select("person_id", "province", "words", "name")
    order = search.stacked([("words", False), ("province", True)], F.col("person_id"))
    return rows.select("person_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("place"))


_add("srt9_stacked", _sorted_table, """
t AS (SELECT person_id, CAST(SUM(word_count) AS BIGINT) AS words FROM speech WHERE person_id IS NOT NULL GROUP BY 1),
c AS (SELECT person_id, province, COUNT(*) AS n FROM speech WHERE person_id IS NOT NULL AND province IS NOT NULL GROUP BY 1, 2),
v AS (SELECT person_id, province FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY n DESC, province) = 1)
SELECT person_id, CAST(ROW_NUMBER() OVER (ORDER BY words IS NULL, words DESC, province IS NULL OR province = '', province, person_id) AS INTEGER) AS place FROM person JOIN t USING (person_id) LEFT JOIN v USING (person_id)""")


def _display_refresh(m: Model) -> DataFrame:
    """Display names after aliases came in: the stored name stays unless it has no formal title and an alias has one."""
    picked = names.pick_display(m.raw("person_aliases").select("person_id", "alias").withColumn("n", F.lit(1)), "person_id", "alias", "n")
    return names.refresh_display(m.person().select("person_id", "name"), picked, "person_id")


_add("dml5_display", _display_refresh)


def _refilled(m: Model) -> DataFrame:
    """Party fills undone and derived again: only parties that the site gave are the base."""
    return incremental.undo_fills(m.speech(), "party_id", "party_source", "site").select("speech_id", "party_id", "party_source")


_add("srt9_sort_names", lambda m: m.person().select("person_id", names.sort_name("name").alias("sort_name")), f"SELECT person_id, trim(regexp_replace(name, '^(?:(?:{TITLED}) ?)+', '')) AS sort_name FROM person")
_add("dml6_undo_fills", _refilled, "x AS (SELECT id, ANY_VALUE(party_source) AS src FROM speeches GROUP BY id) SELECT speech_id, CASE WHEN src = 'site' THEN party_id END AS party_id, CASE WHEN src = 'site' THEN src END AS party_source FROM speech JOIN x ON x.id = speech_id")
_add("fil14_urls", lambda m: m.speech().select("speech_id", F.concat_ws("/", F.lit(""), F.lit("meeting"), F.col("meeting_date").cast("string"), F.col("ordinal").cast("string")).alias("url")), "SELECT speech_id, '/meeting/' || CAST(meeting_date AS VARCHAR) || '/' || CAST(ordinal AS VARCHAR) AS url FROM speech")
_add("mea8_bubbles", stats.bubbles, """
t AS (SELECT person_id, CAST(SUM(word_count) AS BIGINT) AS words FROM speech WHERE person_id IS NOT NULL GROUP BY 1)
SELECT person_id, name, words, ROUND(sqrt(words / (SELECT MAX(words) FROM t)), 6) AS radius FROM t JOIN person USING (person_id) WHERE words > 0""")
_add("src5_tiles", lambda m: meetings.tiles(m.spark, "2026-01-01", "2026-02-10"), "SELECT CAST(b AS DATE) AS begin, LEAST(CAST(b + INTERVAL 6 DAY AS DATE), DATE '2026-02-10') AS finish FROM unnest(generate_series(DATE '2026-01-01', DATE '2026-02-10', INTERVAL 7 DAY)) AS u(b)")


# --- further views ------------------------------------------------------------------------------------------------
_add("win5_relative", lambda m: stats.relative_to_largest(stats.day_shares(m).select("meeting_date", "party", "words"), "words", ["meeting_date"]), _SHARES + " SELECT meeting_date, party, words, ROUND(words / MAX(words) OVER (PARTITION BY meeting_date), 6) AS relative FROM f")


def _all_shares(m: Model) -> DataFrame:
    """Every day's share of each party that has one, and of the folded rest; one column a party found in the data."""
    parties = sorted(r[0] for r in short_list(stats.day_shares(m).select("party").distinct(), 1000))
    wide = stats.share_pivot(m, parties)
    return wide.select("meeting_date", *[F.col(f"`{p}`").alias("party_rest" if p == -1 else f"party_{p}") for p in parties])


_add("agg25_all_shares", _all_shares, _SHARES + """,
g AS (SELECT meeting_date, CASE WHEN party = -1 THEN 'party_rest' ELSE 'party_' || CAST(party AS VARCHAR) END AS party, COALESCE(share, 0) AS share FROM (SELECT DISTINCT meeting_date FROM f) CROSS JOIN (SELECT DISTINCT party FROM f) LEFT JOIN f USING (meeting_date, party))
SELECT * FROM (PIVOT g ON party USING MAX(share) GROUP BY meeting_date)""")
_add("joi8_not_presiding", lambda m: m.speech().where("person_id is not null").join(m.presiding(), "person_id", "left_anti").groupBy("meeting_id").agg(F.count("*").alias("speeches"), F.count_distinct("person_id").alias("people")), "SELECT meeting_id, COUNT(*) AS speeches, COUNT(DISTINCT person_id) AS people FROM speech WHERE person_id NOT IN (SELECT person_id FROM person WHERE is_presiding) GROUP BY 1")
_add("joi10_no_province_labels", lambda m: m.speech().where("speaker_label is not null").select("speaker_label").distinct().join(m.speech().where("province is not null").select(F.col("province").alias("speaker_label")).distinct(), "speaker_label", "left_anti"), "SELECT DISTINCT speaker_label FROM speech WHERE speaker_label NOT IN (SELECT province FROM speech WHERE province IS NOT NULL)")
_add("fil7_cloud_terms", lambda m: m.term().where(F.col("term").rlike(X.CLOUD_TERM)).select("term_id"), f"SELECT term_id FROM term WHERE {_RE}")
_add("agg24_legend", lambda m: stats.day_shares(m).groupBy("party").agg(F.sum("words").alias("words"), F.count("*").alias("days")), _SHARES + " SELECT party, CAST(SUM(words) AS BIGINT) AS words, COUNT(*) AS days FROM f GROUP BY 1")


def _person_page(m: Model) -> DataFrame:
    """Every person's counts, first and last day, most frequent province and number of parties."""
    t = stats.totals(m.speech(), "person_id").select("person_id", "speeches", "words", "meetings", "first_day", "last_day")
    parties = stats.person_parties(m).groupBy("person_id").agg(F.count("*").alias("parties"))
    kinds = ["speeches", "words", "meetings"]
    ranks = stats.person_ranks(m).groupBy("person_id").pivot("stat", kinds).agg(F.first("rank")).select("person_id", *[F.col(k).alias(f"rank_{k}") for k in kinds])
    roles = stats.roles(m).groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_list("role")), "; ").alias("roles"))
    page = t.join(stats.modal(m, "person_id", "province").select("person_id", "province"), "person_id", "left").join(parties, "person_id", "left").join(ranks, "person_id", "left").join(roles, "person_id", "left")
    return page.select(*t.columns, "province", F.coalesce("parties", F.lit(0)).alias("parties"), *[f"rank_{k}" for k in kinds], "roles")


_add("api6_person", _person_page, """
t AS (SELECT person_id, COUNT(*) AS speeches, CAST(SUM(word_count) AS BIGINT) AS words, COUNT(DISTINCT meeting_id) AS meetings, MIN(meeting_date) AS first_day, MAX(meeting_date) AS last_day, COUNT(DISTINCT party_id) AS parties FROM speech WHERE person_id IS NOT NULL GROUP BY 1),
c AS (SELECT person_id, province, COUNT(*) AS n FROM speech WHERE person_id IS NOT NULL AND province IS NOT NULL GROUP BY 1, 2),
v AS (SELECT person_id, province FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY n DESC, province) = 1)
SELECT person_id, speeches, words, meetings, first_day, last_day, province, parties, RANK() OVER (ORDER BY speeches DESC) AS rank_speeches, RANK() OVER (ORDER BY words DESC) AS rank_words, RANK() OVER (ORDER BY meetings DESC) AS rank_meetings, roles
FROM t LEFT JOIN v USING (person_id) LEFT JOIN (SELECT person_id, string_agg(role, '; ' ORDER BY role) AS roles FROM (""" + ORACLE["mea4_roles"] + """) GROUP BY 1) USING (person_id)""")
_add("api13_speech_view", lambda m: m.speech().join(m.person().select("person_id", "name"), "person_id", "left").select("speech_id", "meeting_id", "meeting_date", "ordinal", "name", "party_id", "province", "word_count"), "SELECT speech_id, meeting_id, meeting_date, ordinal, name, party_id, province, word_count FROM speech LEFT JOIN person USING (person_id)")
_add("api8_party_speeches", lambda m: search.numbered(m.speech().where("party_id is not null").select("party_id", "person_id", "speech_id", "meeting_date", "ordinal"), "party_id", [F.desc("meeting_date"), F.col("ordinal"), F.col("speech_id")]).join(m.person().select("person_id", "name"), "person_id", "left").select("party_id", "speech_id", "name", "row"), "SELECT s.party_id, speech_id, name, CAST(ROW_NUMBER() OVER (PARTITION BY s.party_id ORDER BY meeting_date DESC, ordinal, speech_id) AS INTEGER) AS row FROM speech s LEFT JOIN person USING (person_id) WHERE s.party_id IS NOT NULL")
_add("seq5_event_runs", lambda m: sequence.runs(m.raw("events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"], "event_type").groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n")).select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n"), """
a AS (SELECT *, CASE WHEN event_type IS NULL OR ROW_NUMBER() OVER w = 1 OR event_type IS DISTINCT FROM LAG(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, CAST(run AS BIGINT) AS run, MIN(event_type) AS event_type, COUNT(*) AS n FROM b GROUP BY user_id, run""")
