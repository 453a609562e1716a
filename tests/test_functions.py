from pyspark.sql import functions as F

from plenum.functions import names as N
from plenum.functions import text as X


def test_names():
    assert N.person_key("รองศาสตราจารย์อนุสรณ์ ธรรมใจ") == "อนุสรณ์ธรรมใจ"
    assert N.clean_name("รองศาสตราจารย์อนุสรณ์ ธรรมใจ") == "รองศาสตราจารย์อนุสรณ์ ธรรมใจ"
    assert N.strip_titles("นายอนุสรณ์ ธรรมใจ") == "อนุสรณ์ ธรรมใจ"
    assert N.person_key("นายรังสิมันต์ โรม นายรังสิมันต์ โรม") == "รังสิมันต์โรม"
    assert N.display_name("รองศาสตราจารย์อนุสรณ์ ธรรมใจ") == "รศ. อนุสรณ์ ธรรมใจ"
    assert N.display_name("พลตำรวจโท X Yy") == "พล.ต.ท. X Yy"
    assert N.display_name("ว่าที่ร้อยตรี นายสม ชาย") == "ว่าที่ ร.ต. สม ชาย"
    assert N.clean_name("๑๙๓. นางบุญยิ่ง ใจดี สมาชิกสภาผู้แทนราษฎร") == "นางบุญยิ่ง ใจดี"
    assert N.clean_name("นาย") is None and N.clean_name(None) is None and N.clean_name("") is None
    assert N.has_formal_title("พันเอกสมชาย") and not N.has_formal_title("นายสมชาย")


def test_breaks_round_trip(spark):
    df = spark.createDataFrame([([3, 70, 75],), ([],), ([0, 61, 123, 500],)], "o array<int>")
    rows = df.select("o", X.encode_breaks(F.col("o")).alias("c")).select("o", "c", X.decode_breaks(F.col("c")).alias("d")).collect()
    assert rows[0]["c"] == "3_67_5"
    assert all(r["o"] == r["d"] for r in rows)


def test_text_helpers(spark):
    r = spark.sql("select date'2026-03-15' d, '&lt;b&gt;a&lt;/b&gt;<br>b &amp; c' h, '23:59:50' c, 'later' bad").select(
        X.thai_date(F.col("d")).alias("d"), X.strip_markup(F.col("h")).alias("h"), X.clock_add(F.col("c"), F.lit(20.5)).alias("c"), X.clock_add(F.col("bad"), F.lit(1.0)).alias("bad"),
        X.percent(F.lit(0.0004)).alias("p"), X.contrast_text(F.lit("#ffff00")).alias("k"),
    ).first()
    assert (r.d, r.h, r.c, r.bad, r.p, r.k) == ("15 มี.ค. 2569", "a\nb & c", "00:00:10", "later", "<0.1%", "#111111")
