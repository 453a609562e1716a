"""Text, date and number helpers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviated Thai months.
MONTHS = "ม.ค. ก.พ. มี.ค. เม.ย. พ.ค. มิ.ย. ก.ค. ส.ค. ก.ย. ต.ค. พ.ย. ธ.ค.".split()
BASE62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A term fit for a word cloud: a Thai or Latin letter first, then letters, digits, blanks and dots.
CLOUD_TERM = r"^[ก-๏A-Za-z][ก-๏A-Za-z0-9 .]*$"
LATIN_TOKEN = r"[A-Za-z][A-Za-z0-9]*(?:[-'][A-Za-z0-9]+)*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row even where the body names it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_markup(c: Column) -> Column:
    """Entities decoded first, then line breaks kept and tags dropped, so escaped tags go too."""
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", ""))


def thai_date(c: Column) -> Column:
    """Day, short month, year of the Buddhist era."""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(c))
    return F.concat_ws(" ", F.dayofmonth(c).cast("string"), month, (F.year(c) + 543).cast("string"))


def percent(share: Column) -> Column:
    return F.when(share <= 0, "0%").when(share < 0.001, "<0.1%").otherwise(F.concat(F.format_number(share * 100, 1), F.lit("%")))


def clock_add(start: Column, seconds: Column) -> Column:
    """HH:MM:SS plus seconds, modulo a day; text that is no clock time is returned as it is."""
    part = lambda i: F.try_element_at(F.split(start, ":"), F.lit(i)).try_cast("int")
    valid = start.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$")
    total = F.pmod(part(1) * 3600 + part(2) * 60 + part(3) + F.floor(F.coalesce(seconds, F.lit(0.0))).cast("int"), F.lit(86400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    shown = F.concat_ws(":", two(F.floor(total / 3600)), two(F.pmod(F.floor(total / 60), F.lit(60))), two(F.pmod(total, F.lit(60))))
    return F.when(start.isNull(), F.lit(None)).when(valid, shown).otherwise(start)


def encode_breaks(offsets: Column) -> Column:
    """Delta coding of ascending offsets: one base-62 digit a gap, larger gaps decimal between underscores."""
    gaps = lambda o: F.transform(o, lambda x, i: x - F.when(i == 0, 0).otherwise(F.get(o, i - 1)))
    digit = lambda g: F.when(g < 62, F.substring(F.lit(BASE62), (g + 1).cast("int"), F.lit(1))).otherwise(F.concat(F.lit("_"), g.cast("string"), F.lit("_")))
    return F.array_join(F.transform(let(offsets, gaps), digit), "")


def decode_breaks(code: Column) -> Column:
    """The offsets of a coded string; null for null."""
    parts = F.regexp_extract_all(code, F.lit(r"_\d+_|[0-9a-zA-Z]"), F.lit(0))
    gap = lambda p: F.when(p.startswith("_"), F.replace(p, F.lit("_"), F.lit("")).try_cast("int")).otherwise(F.position(p, F.lit(BASE62)) - 1)
    gaps = F.transform(parts, gap)
    step = lambda acc, g: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + g))
    return F.aggregate(gaps, F.array().cast("array<int>"), step)


def contrast_text(color: Column) -> Column:
    """Dark or white text for a #RRGGBB ground, by relative luminance above 0.179; null where it is no such colour."""

    def channel(at: int) -> Column:
        v = F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    light = 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)
    usable = color.rlike("^#[0-9A-Fa-f]{6}$")
    return F.when(usable & (light > 0.179), "#111111").when(usable, "#ffffff")


def minutes(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; null for null."""
    s = F.floor(seconds).cast("long")
    short = F.format_string("%d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60)))
    long_ = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))
    return F.when(s >= 3600, long_).when(s.isNotNull(), short)


def number(value: Column) -> Column:
    """A count with separators of thousands; 0 for null."""
    return F.format_number(F.coalesce(value, F.lit(0)), 0)
