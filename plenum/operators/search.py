"""Transcript search: whole-word hits, the substring fallback, previews, sorting and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decode_breaks, let


def places(text: Column, query: str) -> Column:
    """All offsets (from 0, overlapping) where the query stands, ignoring case."""
    q = query.lower()

    def scan(low: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(low) - len(q))
        return F.when(F.length(low) >= len(q), F.filter(starts, lambda i: F.substring(low, i + 1, F.lit(len(q))) == q)).otherwise(F.array().cast("array<int>"))

    return let(F.lower(text), scan)


def hits(df: DataFrame, query: str, text: str = "text", breaks: str = "breaks") -> DataFrame:
    """Adds `hits` (whole words: both ends on a boundary; any place where a text has no boundaries) and `places`.

    Only rows that hold the query at all are scanned for offsets; the others are filtered by a native contains.
    """
    rows = df.where(F.lower(text).contains(query.lower())).withColumn("places", places(F.col(text), query))
    known = decode_breaks(F.when(F.length(breaks) > 0, F.col(breaks)))
    whole = lambda b: F.when(b.isNull(), F.col("places")).otherwise(F.filter("places", lambda i: F.array_contains(b, i) & F.array_contains(b, i + len(query))))
    return rows.withColumn("hits", let(known, whole))


def search(df: DataFrame, query: str, key: str) -> DataFrame:
    """(key, n, partial): texts with whole-word hits; where no text at all has one, texts with any hit."""
    found = hits(df, query).select(key, F.size("hits").alias("whole"), F.size("places").alias("any"))
    best = found.agg(F.max("whole").alias("most")).withColumn("_k", F.lit(1))
    rows = found.withColumn("_k", F.lit(1)).join(F.broadcast(best), "_k")
    n = F.when(F.col("most") > 0, F.col("whole")).otherwise(F.col("any"))
    return rows.select(key, n.alias("n"), (F.col("most") == 0).alias("partial")).where("n > 0")


def preview(text: Column, first_hit: Column, size: int = 400) -> Column:
    """Up to `size` characters; centred on the first hit (offset from 0) where that lies beyond half of it."""
    begin = F.when(first_hit > size // 2, first_hit - size // 2).otherwise(0)
    return F.substring(text, begin + 1, F.lit(size))


def page(df: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """One page of a total order; a number outside the pages is clamped by the caller's count."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def numbered(df: DataFrame, partition: str, order: list[Column], size: int = 20) -> DataFrame:
    """Adds `row` and `page` within each partition."""
    row = F.row_number().over(Window.partitionBy(partition).orderBy(*order))
    return df.withColumn("row", row).withColumn("page", F.ceil(F.col("row") / size).cast("int"))


def thai_order(c: Column) -> Column:
    """Dictionary order of Thai names and words."""
    return F.collate(c, "th")


def empties_last(c: Column, special: str = "แบบบัญชีรายชื่อ") -> Column:
    """A leading sort key: values, then the special value, then empties, whatever the direction."""
    return F.when(F.coalesce(c, F.lit("")) == "", 2).when(c == special, 1).otherwise(0)


def highlight(text: Column, found: Column, size: int) -> Column:
    """Spans (begin, end) to mark: overlapping hits merged from the left."""
    spans = F.transform(found, lambda i: F.struct(i.cast("int").alias("begin"), (i + size).cast("int").alias("end")))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x["begin"] <= last(acc)["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["begin"].alias("begin"), x["end"].alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(spans, F.array().cast("array<struct<begin:int,end:int>>"), step)


def holds(columns: list[str], query: str) -> Column:
    """Whether any of the columns holds the query, ignoring case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return found


def phrase(df: DataFrame, tokens: str, words: list[str]) -> DataFrame:
    """Rows whose token array holds the words one after another, with `n`, how often."""
    t = F.col(tokens)
    rows = df.where(F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.array_contains(t, w)))
    starts = F.when(F.size(t) >= len(words), F.sequence(F.lit(1), F.size(t) - len(words) + 1)).otherwise(F.array().cast("array<int>"))
    same = lambda i: F.slice(t, i, F.lit(len(words))) == F.array(*[F.lit(w) for w in words])
    return rows.withColumn("n", F.size(F.filter(starts, same))).where("n > 0")


def pushed(keys: list[tuple[str, bool]], name: str, number: bool, most: int = 3) -> list[tuple[str, bool]]:
    """Sort keys (column, ascending) after a click on a column: it comes first, the others stay behind it, up to `most`.

    A click on the first one turns its direction; a new one begins downwards for numbers, upwards for text.
    """
    ascending = not keys[0][1] if keys and keys[0][0] == name else not number
    return [(name, ascending), *[k for k in keys if k[0] != name]][:most]


def stacked(keys: list[tuple[str, bool]], tie: Column) -> list[Column]:
    """The order of a table under sort keys (column, ascending), the newest first: empties stand last whatever the direction."""
    order: list[Column] = []
    for name, ascending in keys:
        c = F.col(name)
        order += [c.isNull() | (c.cast("string") == ""), c.asc() if ascending else c.desc()]
    return [*order, tie]
