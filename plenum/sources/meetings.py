"""Meeting, roster, colour and lexicon files as frames with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze, strip_markup

MEETING = """phase string, meeting_id string, meeting_group string, meeting_year string, meeting_number string, meeting_date string,
meeting_title string, meeting_council string, meeting_type string, meeting_episode string, meeting_room string, volume string, scraped_at string,
clips array<struct<seq int, url string, start_time string, end_time string, video_path string, tags array<string>,
  all_speakers array<struct<name string, party string, province string>>,
  segments array<struct<id string, start double, stop double, speaker string, speaker_party string, speaker_province string, text string, text_raw string>>>>"""
ROSTER = """source string, fetched_at string, members array<struct<member_no int, name string, party string, constituency string,
party_list boolean, province string, district int>>"""
COLOURS = "parties map<string, struct<name_en string, color string, logo string, logo_source string, verified boolean>>"
# Fixed value: what a roster writes for a seat from the party list.
PARTY_LIST = "แบบบัญชีรายชื่อ"
#: A roster with fewer rows is taken for a broken page.
LEAST_MEMBERS = 400


def meetings(spark: SparkSession, path: str) -> DataFrame:
    """One row per meeting file; a broken file is kept as a row of nulls in `_corrupt` and skipped."""
    df = spark.read.schema(MEETING + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    ints = ["phase", "meeting_id", "meeting_group", "meeting_year", "meeting_number"]
    df = df.where("_corrupt is null and meeting_id is not null").drop("_corrupt").withColumn("file", F.col("_metadata.file_path"))
    for c in ints:
        df = df.withColumn(c, F.col(c).try_cast("int"))
    return df.withColumn("meeting_date", F.col("meeting_date").try_cast("date"))


def records(playlist: DataFrame, docs: DataFrame, base: str) -> DataFrame:
    """Meeting records from search results: playlist (phase, meeting_id, header fields..., order) and docs (phase, meeting_id,
    seq, order, _id, start, stop, text, speaker[], speaker_party[], speaker_province[], start_time, end_time, video_path,
    tag[], all_speaker[], all_speaker_party[], all_speaker_province[]).

    The header is that of the first playlist entry, a clip's fields those of its first document; of each list of speakers
    the first counts; parallel lists end with the shortest. A meeting is one record by nature.
    """
    keys = ["phase", "meeting_id"]
    header = [c for c in playlist.columns if c not in (*keys, "order")]
    heads = playlist.groupBy(*keys).agg(F.min_by(F.struct(*header), "order").alias("h")).select(*keys, "h.*")
    lists = ["all_speaker", "all_speaker_party", "all_speaker_province"]
    shortest = lambda d: F.least(*[F.coalesce(F.size(d[c]), F.lit(0)) for c in lists])
    cut = lambda d, c: F.slice(F.coalesce(d[c], F.array().cast("array<string>")), F.lit(1), F.greatest(shortest(d), F.lit(0)))
    spoken = F.struct(
        F.col("_id").alias("id"), "start", "stop", F.get("speaker", F.lit(0)).alias("speaker"), F.get("speaker_party", F.lit(0)).alias("speaker_party"), F.get("speaker_province", F.lit(0)).alias("speaker_province"),
        strip_markup(F.coalesce("text", F.lit(""))).alias("text"), F.col("text").alias("text_raw"),
    )
    first = F.struct("start_time", "end_time", "video_path", "tag", *lists)
    per_clip = docs.groupBy(*keys, "seq").agg(F.array_sort(F.collect_list(F.struct("order", spoken.alias("s")))).alias("s"), F.min_by(first, "order").alias("f"))
    f = F.col("f")
    people = F.transform(F.arrays_zip(cut(f, lists[0]).alias("a"), cut(f, lists[1]).alias("b"), cut(f, lists[2]).alias("c")), lambda x: F.struct(x["a"].alias("name"), x["b"].alias("party"), x["c"].alias("province")))
    clip = F.struct(
        "seq", F.concat_ws("/", F.lit(base), F.lit("video"), *[F.col(k).cast("string") for k in (*keys, "seq")]).alias("url"), f["start_time"].alias("start_time"), f["end_time"].alias("end_time"), f["video_path"].alias("video_path"),
        F.coalesce(f["tag"], F.array().cast("array<string>")).alias("tags"), people.alias("all_speakers"), F.transform("s", lambda x: x["s"]).alias("segments"),
    )
    clips_ = per_clip.select(*keys, clip.alias("c")).groupBy(*keys).agg(F.array_sort(F.collect_list("c"), lambda x, y: x["seq"] - y["seq"]).alias("clips"))
    return heads.join(clips_, keys, "left").withColumn("scraped_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def failures(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the meeting files that meetings() leaves out: broken ones, and those without an id."""
    df = spark.read.schema(MEETING + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.select("*", F.col("_metadata.file_path").alias("file")).where("_corrupt is not null or meeting_id is null").select("file", F.col("_corrupt").alias("text"))


def clips(meeting: DataFrame) -> DataFrame:
    rows = meeting.select("phase", "meeting_id", F.explode("clips").alias("c"))
    return rows.select("phase", "meeting_id", "c.seq", "c.url", "c.start_time", "c.end_time", "c.video_path", F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"))


def segments(meeting: DataFrame) -> DataFrame:
    """One row per segment, with its place (clip, position) in the meeting."""
    rows = meeting.select("phase", "meeting_id", F.explode("clips").alias("c")).select("phase", "meeting_id", "c.seq", "c.start_time", F.posexplode("c.segments").alias("pos", "s"))
    return rows.select("phase", "meeting_id", "seq", "start_time", "pos", "s.*")


def for_speeches(meeting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, listed): the input of sequence.speeches from meeting files, and the speakers that clips only list."""
    rows = segments(meeting).select("phase", "meeting_id", "seq", "pos", "id", "start", "stop", F.col("start_time").alias("clip_start"), "speaker", F.col("speaker_party").alias("party"), F.col("speaker_province").alias("province"), "text")
    listed = meeting.select(F.explode("clips").alias("c")).select(F.explode("c.all_speakers").alias("s")).select(F.col("s.name").alias("speaker"))
    return rows, listed


def roster(spark: SparkSession, path: str, least: int = LEAST_MEMBERS) -> DataFrame:
    rows = spark.read.schema(ROSTER).option("multiLine", True).json(path).select(F.explode("members").alias("m")).select("m.*")
    n = rows.count()
    if n < least:
        raise ValueError(f"the roster has {n} rows, at least {least} are expected")
    return rows


def roster_page(spark: SparkSession, path: str) -> DataFrame:
    """Roster items of an HTML page: number, name, party, seat, province, district; items without number or name are left out.

    Party and seat are told by how their lines begin, wherever they stand; a seat from the list has the list as province.
    """
    item = F.explode(F.regexp_extract_all("value", F.lit(r'(?s)<li class="tb_[^"]*".*?</li>'), F.lit(0)))
    rows = spark.read.text(path, wholetext=True).select(item.alias("li"))
    heads = F.transform(F.regexp_extract_all("li", F.lit(r"(?s)<h4>(.*?)</h4>"), F.lit(1)), lambda x: squeeze(strip_markup(x)))
    begins = lambda word: F.coalesce(F.get(F.filter(heads, lambda x: x.startswith(word)), F.lit(0)), F.lit(""))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = rows.select(
        F.regexp_extract("li", r"เลขประจำตัวสมาชิก\s*:\s*(\d+)", 1).try_cast("int").alias("member_no"),
        squeeze(strip_markup(F.regexp_extract("li", r'(?s)<h4 style="margin-top:8px;">(.*?)</h4>', 1))).alias("name"),
        text(F.regexp_replace(begins("พรรค"), "^พรรค", "")).alias("party"), begins("สมาชิกสภาผู้แทนราษฎร").alias("seat"),
    )
    seat = r"สมาชิกสภาผู้แทนราษฎร\s*(?:จังหวัด)?\s*(\S+?)\s*เขตเลือกตั้งที่\s*(\d+)"
    listed = F.col("seat").contains(PARTY_LIST)
    return out.where("member_no is not null and name <> ''").select(
        "*", listed.alias("party_list"), F.when(listed, PARTY_LIST).otherwise(text(F.regexp_extract("seat", seat, 1))).alias("province"),
        F.when(~listed, F.regexp_extract("seat", seat, 2).try_cast("int")).alias("district"),
    )


def party_colours(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(COLOURS).option("multiLine", True).json(path).select(F.explode("parties").alias("party", "p"))
    return rows.select("party", "p.*")


def word_list(spark: SparkSession, path: str, keep_blanks: bool = False) -> DataFrame:
    """(word): one entry per line, comments from # on, blanks dropped or made single."""
    line = F.trim(F.get(F.split("value", "#"), F.lit(0)))
    word = F.regexp_replace(line, r"(?U)\s+", " " if keep_blanks else "")
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct()


def phrases(mined: DataFrame, manual: DataFrame, blocked: DataFrame) -> DataFrame:
    """(word): mined and manual phrases without the blocked ones."""
    return mined.unionByName(manual).distinct().join(blocked, "word", "left_anti")


def abbreviations(mined: DataFrame, blocked: DataFrame) -> DataFrame:
    """(word): mined abbreviations without the blocked ones."""
    return mined.select("word").distinct().join(blocked, "word", "left_anti")


def manual_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The Thai and the Latin entries of a manual list."""
    thai = F.col("word").rlike("[ก-๏]")
    return words.where(thai), words.where(~thai)


def frequencies(lexicon: DataFrame) -> DataFrame:
    """(word, freq): repeated entries of a frequency list are added up."""
    return lexicon.groupBy("word").agg(F.sum("freq").alias("freq"))


def tiles(spark: SparkSession, since: str, until: str, days: int = 7) -> DataFrame:
    """The date ranges (begin, finish) that discovery asks for."""
    starts = spark.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"), F.expr(f"interval {days} days"))).alias("begin"))
    return starts.select("begin", F.least(F.date_add("begin", days - 1), F.lit(until).cast("date")).alias("finish"))
