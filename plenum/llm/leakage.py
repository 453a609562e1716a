"""Problem 9: held-out test items inside a training corpus.

A positional inverted index over the documents: a term is a stretch of TERM letters and digits of the text's comparison
form (one look for each character, lower case, plain digits, nothing else), a posting is (term, document, position).
Only terms of some item are stored, so the index follows the leaked text and not the corpus.

The posting lists of an item's terms are intersected by offset: a posting at position p of the item's term at i votes for
the diagonal p - i. Lists are taken from the item's rarest terms on: the rarest KEPT share of its positions always takes
part, of the others only those that are neither in another item nor far more frequent than the item's usual term; so an
opening formula that many items share proposes no document, and any passage of half an item still holds kept terms. A
(document, item) goes on only with LEAST different positions of the item on neighbouring diagonals. Where one diagonal
holds an unbroken stretch of SHARE of the item, that is an exact match, read from the postings alone. The others are
proximity matches: the item is aligned with the window of the document that its diagonals point to.

What can be lost: a passage whose unbroken stretches are all shorter than TERM + LEAST - 1 characters (less for short
items).

Cases: null, empty and blank texts match nothing; an item without letters matches nothing; repeated rows of a key
count once (the postings of all its texts count); items must be few (ITEM_LIMIT rows and ITEM_CHARS characters,
checked), as the hashes of their terms are sent to every task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codepoints as C
from . import lookalike
from ..session import short_list
from .storage import cut

TERM, ITEM_LIMIT, ITEM_CHARS = 26, 20_000, 4_000_000
#: Positions of an item that always take part, rarest first; a term is common beyond so many times the item's median.
KEPT, COMMON = 0.75, 8
#: Positions of an item that must agree, and the width of the bands of diagonals that are neighbours.
LEAST, BAND = 4, 64
#: An exact run counts in proximity matching from this length on; a gap between runs may hold so many characters.
RUN, GAP = 5, 30
#: Share of an item that a passage must hold, and share of the passage that exchanged words may take.
SHARE, EXCHANGED = 0.5, 0.18


@lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """For code points in the common form: lower case, ASCII digit, or 0 where the character is no letter, mark or digit."""
    to = np.zeros(lookalike.TOP, np.uint32)
    for i in range(lookalike.TOP):
        if 0x3400 <= i < 0xA000 or 0xAC00 <= i < 0xD7A4 or 0x20000 <= i < 0x2F800:
            to[i] = i
            continue
        ch = chr(i)
        kind = unicodedata.category(ch)
        if kind == "Nd":
            to[i] = 0x30 + unicodedata.digit(ch)
        elif kind[0] in "LM":
            low = ch.lower()
            to[i] = ord(low) if len(low) == 1 else i
    return to


def comparison_form(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    cp, offsets = lookalike.fold(*C.to_codepoints(col))
    cp = _plain()[np.minimum(cp, lookalike.TOP - 1)]
    return C.keep(cp, offsets, cp > 0)


def _plain_texts(texts: list[str]) -> list[str]:
    cp, offsets = comparison_form(pa.array(texts, pa.string()))
    whole = cp.tobytes().decode("utf-32-le")
    return [whole[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def passage(item: str, text: str) -> tuple[int, int]:
    """The best passage of an item in a text, both in comparison form: (characters of the item it spans, of those exchanged).

    Runs of at least RUN equal characters are chained in the order of both, over gaps of up to GAP characters.
    """
    places: dict[str, list[int]] = {}
    for i in range(len(item) - RUN + 1):
        places.setdefault(item[i : i + RUN], []).append(i)
    open_: dict[int, tuple[int, int]] = {}
    runs = []
    for d in range(len(text) - RUN + 1):
        for i in places.get(text[d : d + RUN], ()):
            a = open_.get(i - d)
            if a and a[1] == i - 1:
                open_[i - d] = (a[0], i)
            else:
                if a:
                    runs.append((a[0] - (i - d), a[0], a[1] + RUN - a[0]))
                open_[i - d] = (i, i)
    runs += [(a - k, a, b + RUN - a) for k, (a, b) in open_.items()]
    runs = sorted((x for x in runs if x[2] >= RUN), key=lambda x: (x[0] + x[2], x))
    cost = (1 - EXCHANGED) / EXCHANGED
    best: list[tuple[float, int, int, int]] = []  # score, first position in the item, end, exchanged
    for k, (d, i, n) in enumerate(runs):
        mine = (float(n), i, i + n, 0)
        for j in range(k - 1, -1, -1):
            pd_, pi, pn = runs[j]
            gd, gi = d - (pd_ + pn), i - (pi + pn)
            if gd > GAP:  # runs are in the order of their ends
                break
            over = max(0, -gd, -gi)
            if over >= n or gi > GAP:
                continue
            gap = max(gd, gi, 0)
            score = best[j][0] + n - over - cost * gap
            if score > mine[0]:
                mine = (score, best[j][1], i + n, best[j][3] + gap)
        best.append(mine)
    if not best:
        return 0, 0
    spans = [(end - start, gone) for _, start, end, gone in best if gone <= EXCHANGED * (end - start)]
    return max(spans, key=lambda x: (x[0], -x[1]), default=(0, 0))


def rare_anchors(anchors: DataFrame, postings: DataFrame) -> DataFrame:
    """The anchors (term, item, i) that propose documents: the rarest positions of every item, and those that are not common."""
    lists = postings.groupBy("term").agg(F.count("*").alias("n"))
    owners = anchors.groupBy("term").agg(F.count_distinct("item").alias("owners"))
    rated = anchors.join(lists, "term").join(owners, "term").withColumn("f", F.col("n") * F.col("owners"))
    usual = rated.groupBy("item").agg(F.median("f").alias("usual"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("f", "i"))
    # terms that no document holds count among the rarest
    whole = anchors.groupBy("item").agg(F.count("*").alias("whole"))
    ranked = rated.withColumn("place", place).join(usual, "item").join(whole, "item")
    absent = F.col("whole") - F.count("*").over(Window.partitionBy("item"))
    plain = (F.col("owners") == 1) & (F.col("f") <= COMMON * F.col("usual"))
    return ranked.withColumn("absent", absent).where(plain | (F.col("place") + F.col("absent") <= F.ceil(KEPT * F.col("whole")))).select("term", "item", "i")


def intersect(postings: DataFrame, anchors: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item, exact, low, high): documents and items with enough agreeing positions on neighbouring diagonals.

    postings (key, term, pos), anchors (term, item, i), items (item, k, least). exact: the longest unbroken stretch, where
    one diagonal's positions are unbroken; low, high: the diagonals of the band.
    """
    hits = postings.join(anchors, "term").groupBy("key", "item", (F.col("pos") - F.col("i")).alias("diagonal"))
    per = hits.agg(F.count_distinct("i").alias("n"), F.min("i").alias("first"), F.max("i").alias("last")).join(items, "item")
    whole = F.when(F.col("last") - F.col("first") + 1 == F.col("n"), F.col("n") + F.col("k") - 1).otherwise(0)
    # a band and the next one, so that no two near diagonals are parted by a border
    band = F.floor(F.col("diagonal") / BAND)
    both = per.withColumn("run", whole).withColumn("band", F.explode(F.array(band, band + 1)))
    bands = both.groupBy("key", "item", "band").agg(F.sum("n").alias("n"), F.max("run").alias("exact"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.first("least").alias("least"))
    # the same diagonals seen from two bands count once
    return bands.where("n >= least").groupBy("key", "item", "low", "high").agg(F.max("exact").alias("exact"))


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, kind, share, exchanged): documents that hold at least SHARE of an item as one passage; kind exact or near."""
    rows = items.select(item_key, item_text).where(F.col(item_text).isNotNull()).dropDuplicates([item_key])
    rows = sorted(short_list(rows, ITEM_LIMIT))
    if sum(len(r[1]) for r in rows) > ITEM_CHARS:
        raise ValueError(f"the items have more than {ITEM_CHARS} characters")
    spark = documents.sparkSession
    plain = _plain_texts([r[1] for r in rows])
    about: list[tuple] = []
    listed: list[tuple[int, int, int]] = []
    sizes: dict[int, np.ndarray] = {}
    for n, p in enumerate(plain):
        k = min(TERM, max(RUN, len(p) // 5))
        if len(p) >= k and p:
            hashes = C.rolling_hash(np.frombuffer(p.encode("utf-32-le"), np.uint32), k).view(np.int64)
            listed += [(int(h), n, i) for i, h in enumerate(hashes)]
            sizes[k] = np.union1d(sizes.get(k, np.zeros(0, np.int64)), hashes)
            about.append((n, rows[n][0], p, k, max(1, min(LEAST, len(p) // 2 - k))))
    doc_type = documents.schema[key].dataType
    known_terms = spark.sparkContext.broadcast(sizes)  # at most ITEM_CHARS hashes

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {}
        for k, known in known_terms.value.items():
            filters[k] = np.zeros(1 << 22, bool)
            filters[k][known & 0x3FFFFF] = True
        for whole in batches:
            for b in C.slices(whole, "text"):
                cp, offsets = comparison_form(b.column(1))
                hits = [(np.zeros(0, np.int64),) * 3]
                for k, known in known_terms.value.items():
                    h = C.rolling_hash(cp, k).view(np.int64)
                    at = np.flatnonzero(filters[k][h & 0x3FFFFF])
                    at = at[np.isin(h[at], known, assume_unique=False)]
                    row = np.searchsorted(offsets, at, "right") - 1
                    inside = at + k <= offsets[row + 1]
                    hits.append((row[inside], h[at[inside]], at[inside] - offsets[row[inside]]))
                row, term, pos = (np.concatenate(x) for x in zip(*hits))
                if not len(row):
                    continue
                order = np.argsort(row, kind="stable")
                row, term, pos = row[order], term[order], pos[order]
                rows_, first = np.unique(row, return_index=True)
                ends = np.append(first, len(row)).astype(np.int32)
                sub, sub_off = C.keep(cp, offsets, np.repeat(np.isin(np.arange(len(offsets) - 1), rows_), np.diff(offsets)))
                sub_off = np.append(sub_off[rows_], len(sub))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows_)), C.to_arrow(sub, sub_off), pa.ListArray.from_arrays(ends, pa.array(term, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(pos.astype(np.int32)))],
                    names=["key", "form", "terms", "positions"],
                )

    schema = T.StructType(
        [T.StructField("key", doc_type), T.StructField("form", T.StringType()), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("positions", T.ArrayType(T.IntegerType()))]
    )
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull() & F.col("key").isNotNull())
    found = cut(source.mapInArrow(index, schema))
    postings = found.select("key", F.explode(F.arrays_zip("terms", "positions")).alias("p")).select("key", F.col("p.terms").alias("term"), F.col("p.positions").alias("pos"))
    anchors = spark.createDataFrame(pd.DataFrame(listed, columns=["term", "item", "i"]).astype({"term": "int64", "item": "int64", "i": "int32"}), "term long, item long, i int")
    kind = T.StructType([T.StructField("item", T.LongType()), T.StructField(item_key, items.schema[item_key].dataType), T.StructField("plain", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("least", T.IntegerType())])
    known = spark.createDataFrame(about, kind).withColumn("size", F.length("plain"))
    met = cut(intersect(postings, rare_anchors(anchors, postings), known.select("item", "k", "least")).join(known.select("item", "size"), "item"))
    exact = met.where(F.col("exact") >= SHARE * F.col("size"))
    whole = exact.groupBy("key", "item").agg(F.max(F.least(F.col("exact") / F.col("size"), F.lit(1.0))).alias("share")).select("key", "item", F.lit("exact").alias("kind"), "share", F.lit(0.0).alias("exchanged"))

    out = T.StructType([T.StructField("key", doc_type), T.StructField("item", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("exchanged", T.DoubleType())])

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for k, n, p, window in zip(f["key"], f["item"], f["plain"], f["window"]):
                span, gone = passage(p, window)
                if span >= SHARE * len(p):
                    got.append((k, n, span / len(p), gone / span))
            yield pd.DataFrame(got, columns=["key", "item", "share", "exchanged"])

    # only the part of a document that the diagonals point to is aligned
    begin = F.greatest(F.col("low") - F.ceil(EXCHANGED * F.col("size")).cast("int") - GAP, F.lit(0))
    end = F.col("high") + F.col("size") + F.ceil(EXCHANGED * F.col("size")).cast("int") + GAP
    near = met.join(whole.select("key", "item"), ["key", "item"], "left_anti").join(found.select("key", "form"), "key").join(known.select("item", "plain"), "item")
    near = near.select("key", "item", "plain", F.substring("form", begin + 1, end - begin).alias("window")).distinct()
    aligned = near.mapInPandas(match, out).groupBy("key", "item").agg(F.max(F.struct("share", (-F.col("exchanged")).alias("e"))).alias("b"))
    both = whole.unionByName(aligned.select("key", "item", F.lit("near").alias("kind"), "b.share", (-F.col("b.e")).alias("exchanged")))
    return both.join(known.select("item", item_key), "item").select(F.col("key").alias(key), item_key, "kind", F.round("share", 4).alias("share"), F.round("exchanged", 4).alias("exchanged"))
