"""Tables, JSON endpoints and readable transcripts as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, null fields left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_clouds(cloud: DataFrame, path: str, entity: str, mode: str) -> None:
    """All clouds of one kind in one pass, a folder per entity and mode."""
    cloud.withColumn("mode", F.lit(mode)).repartition(entity).write.mode("overwrite").partitionBy("mode", entity).json(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        keys = [c for c in ("phase", "meeting_id") if c in df.columns]
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{path}/{name}")


def write_phrases(mined: DataFrame, path: str) -> None:
    """The mined list: tier, then count; a short list in one file."""
    mined.orderBy("tier", F.desc("n"), "word").select(F.concat_ws("  ", "word", F.concat(F.lit("# n="), F.col("n").cast("string")))).coalesce(1).write.mode("overwrite").text(path)


def write_meetings(meeting: DataFrame, path: str, force: bool = False) -> None:
    """Writes meeting records as JSON, a folder per meeting; meetings that are there stay unless forced.

    Spark's commit makes the writing whole or void: readers never see half a meeting.
    """
    keys = ["phase", "meeting_id"]
    spark = meeting.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not force and target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        saved = spark.read.schema(", ".join(f"{k} {meeting.schema[k].dataType.simpleString()}" for k in keys)).json(path)
        meeting = meeting.join(saved.distinct(), keys, "left_anti")
    # without force only new folders come, so nothing that is there is touched
    writer = meeting.write.mode("overwrite" if force else "append").option("partitionOverwriteMode", "dynamic")
    writer.option("ignoreNullFields", "false").partitionBy(*keys).json(path)


def write_roster(members: DataFrame, path: str, source: str, fetched_at: str) -> None:
    """The roster as one JSON document; the roster is a short list."""
    rows = members.orderBy("member_no").select(F.struct("*").alias("m")).agg(F.array_sort(F.collect_list("m"), lambda x, y: x["member_no"] - y["member_no"]).alias("members"))
    rows.select(F.lit(source).alias("source"), F.lit(fetched_at).alias("fetched_at"), "members").coalesce(1).write.mode("overwrite").json(path)


def transcript(meeting: DataFrame) -> DataFrame:
    """(phase, meeting_id, text) of meeting records: a header, then clips in order, each with its line, the speaker named (with
    party and province) where it changes and at each clip; empty segments are left out."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    head = F.concat(
        some(F.col("meeting_title")), F.lit(" ("), some(F.col("meeting_council")), F.lit(")\n"), some(F.col("meeting_episode")), F.lit("  ชุดที่ "), some(F.col("meeting_group")), F.lit(" ปีที่ "),
        some(F.col("meeting_year")), F.lit(" ครั้งที่ "), some(F.col("meeting_number")), F.lit("\nDate: "), some(F.col("meeting_date")), F.lit("   Meeting ID: "), some(F.col("phase")), F.lit("/"), some(F.col("meeting_id")), F.lit("\n"),
    )

    def clip(c: Column) -> Column:
        said = F.filter(c["segments"], lambda s: F.coalesce(s["text"], F.lit("")) != "")
        extra = lambda s: F.array_join(F.filter(F.array(s["speaker_party"], s["speaker_province"]), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
        who = lambda s: F.concat(F.lit("\n["), F.coalesce(F.nullif(s["speaker"], F.lit("")), F.lit("(ไม่ระบุผู้พูด)")), F.when(extra(s) != "", F.concat(F.lit(" — "), extra(s))).otherwise(""), F.lit("]\n"))
        line = lambda s, i: F.concat(F.when((i == 0) | ~s["speaker"].eqNullSafe(F.get(said, i - 1)["speaker"]), who(s)).otherwise(""), s["text"], F.lit("\n"))
        mark = F.concat(F.lit("===== Clip "), some(c["seq"]), F.lit("  "), some(c["start_time"]), F.lit("-"), some(c["end_time"]), F.lit("  "), some(c["url"]), F.lit("\n"))
        return F.concat(mark, F.array_join(F.transform(said, line), ""), F.lit("\n"))

    ordered = F.array_sort("clips", lambda x, y: x["seq"] - y["seq"])
    return meeting.select("phase", "meeting_id", F.concat(head, F.lit("\n"), F.array_join(F.transform(ordered, clip), "")).alias("text"))
