"""Problem 4: frequency of every term and n-gram, in occurrences and in records.

A distributed suffix array: every suffix of every record is a row with its next STEP tokens; the rows of one first token
are sorted together, so each group is a stretch of the suffix array. Neighbouring rows give their common-prefix length;
the intervals of prefix length >= d are the d-grams, their occurrences the weights in the interval, and their records the
rows less the within-record duplicates, which are adjacent once an interval is ordered by record. A first token with more
than GROUP suffixes is dealt over salts of the record, as many as its frequency asks for: a record's suffixes share their
salt, so the counts of the salted parts add up and no group outgrows a task.

N-grams of any length: after STEP tokens only the suffixes whose prefix is repeated go on, with their prefix as first key
and the next STEP tokens, until none is left. All longer n-grams stand at one place only. Records with equal tokens are
one text with a weight, so copies add no rounds; a longer n-gram that only copies repeat stands at one place.

Cases: null tokens end nothing and count nowhere; records without tokens add nothing; a weight that is null or not
positive removes its token; rows repeated in (record, term) count once, with the largest weight; ties do not arise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import cut

#: Suffixes of one first token that a task sorts together, and tokens a suffix shows at a time.
GROUP, STEP = 200_000, 8
END = np.iinfo(np.int64).min


def suffix_counts(suffixes: DataFrame, depth: int, least: int = 1) -> DataFrame:
    """(d, gram, first, occurrences, records, places, record, place) from rows (prefix, t1..tN, record, place, weight).

    One row for each distinct (prefix, t1..td), d = 1..depth; gram is its hash, first its t1, (record, place) one of its
    places and `places` their number. t1 is never null; a later null stands for the record's end. All columns are bigint, place is int. Rows equal in record and
    suffix that are no different places (place null) count once, with the largest weight.
    """
    names = [f"t{i}" for i in range(1, depth + 1)]
    sizes = suffixes.groupBy("prefix", "t1").agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP)
    hot = sizes.select("prefix", "t1", F.ceil(F.col("_n") / GROUP).cast("int").alias("_salts"))
    salted = suffixes.join(hot, ["prefix", "t1"], "left").withColumn("salt", F.pmod(F.xxhash64("record"), F.coalesce("_salts", F.lit(1))).cast("int")).withColumn("whole", F.col("_salts").isNull())
    parts = salted.repartition("prefix", "t1", "salt").sortWithinPartitions("prefix", "t1", "salt", *names[1:], "record", F.desc("weight"))

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches, ["prefix", "t1", "salt"]):
            yield from _count(group, names, least)

    kind = [T.StructField("d", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("gram", "first", "occurrences", "records", "places", "record")] + [T.StructField("place", T.IntegerType())]
    counted = parts.select("prefix", "salt", "whole", *names, "record", "place", F.col("weight").cast("long").alias("weight")).mapInArrow(intervals, T.StructType(kind))
    total = counted.groupBy("d", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), F.sum("places").alias("places"), F.min("first").alias("first"), F.min(F.struct("record", "place")).alias("_at")).select("d", "gram", "first", "occurrences", "records", "places", "_at.*")
    return total if least < 2 else total.where((F.col("occurrences") >= least) | (F.col("d") == 1))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 50_000) -> Iterator[pa.Table]:
    """Joins the sorted batches of a partition so that no group is cut across two; only the newest batch is searched for a border."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        if rows >= least:
            change = np.zeros(b.num_rows, bool)
            for k in keys:
                v, before = b.column(k).to_numpy(), held[-1].column(k)[held[-1].num_rows - 1].as_py()
                change |= np.concatenate([[v[0] != before], v[1:] != v[:-1]])
            at = np.flatnonzero(change)
            if len(at):
                yield pa.Table.from_batches([*held, b.slice(0, int(at[-1]))])
                held, rows, b = [], 0, b.slice(int(at[-1]))
        held.append(b)
        rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _mix(gram: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The hash of a gram with one more token."""
    with np.errstate(over="ignore"):
        x = (gram.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) ^ token.view(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def _count(t: pa.Table, names: list[str], least: int = 1) -> Iterator[pa.RecordBatch]:
    n = t.num_rows
    cols = [np.ascontiguousarray(t.column(c).fill_null(END).to_numpy()) for c in names]
    prefix, salt, record, weight = (np.ascontiguousarray(t.column(c).to_numpy()) for c in ("prefix", "salt", "record", "weight"))
    entire = t.column("whole").to_numpy(zero_copy_only=False)
    place = np.ascontiguousarray(t.column("place").fill_null(-1).to_numpy())
    # common-prefix length with the row before; -1 at the begin of a group
    shared = np.full(n, -1, np.int64)
    same = np.concatenate([[False], (prefix[1:] == prefix[:-1]) & (salt[1:] == salt[:-1])])
    shared += same
    for c in cols:
        same[1:] &= (c[1:] == c[:-1]) & (c[1:] != END)
        shared += same
    gram, real = prefix, np.ones(n, bool)
    for d, c in enumerate(cols, 1):
        real = real & (c != END)
        if not real.any():
            return
        gram = _mix(gram, c)
        rows = np.flatnonzero(real)
        interval = np.cumsum(shared < d)[rows]
        # within an interval by record: a record's further suffixes are the duplicates beside its first
        order = np.lexsort((record[rows], interval))
        at = rows[order]
        iv, r, w = interval[order], record[at], weight[at]
        duplicate = np.concatenate([[False], (iv[1:] == iv[:-1]) & (r[1:] == r[:-1])])
        w = np.where(duplicate & (place[at] < 0), 0, w)  # the same row again; equal rows come with the largest weight first
        starts = np.flatnonzero(np.concatenate([[True], iv[1:] != iv[:-1]]))
        head = at[starts]
        first_weight = np.where(duplicate, 0, np.where(place[at] < 0, 1, weight[at]))
        places = np.diff(np.append(starts, len(at)))
        out = [np.full(len(head), d, np.int32), gram[head], cols[0][head], np.add.reduceat(w, starts), np.add.reduceat(first_weight, starts), places.astype(np.int64), record[head], place[head].astype(np.int32)]
        if least > 1 and d > 1:  # a group that is not dealt over salts has all of a gram's places
            kept = (out[3] >= least) | ~entire[head]
            out = [x[kept] for x in out]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["d", "gram", "first", "occurrences", "records", "places", "record", "place"])


def _suffixes(docs: DataFrame, begins: Column, skip: Column, prefix: Column, depth: int) -> DataFrame:
    """One row a suffix: `begins` (array of places) of docs (record, h, weight), showing the tokens from place + skip on."""
    rows = docs.select("record", "weight", "h", F.explode(begins).alias("place"))
    shown = [F.get("h", F.col("place") + skip + j).alias(f"t{j + 1}") for j in range(depth)]
    return rows.select("record", "place", "weight", prefix.alias("prefix"), *shown).where("t1 is not null")


def ngram_counts(df: DataFrame, record: str, tokens: str, max_n: int | None = None, least: int = 1) -> DataFrame:
    """(n, gram array<string>, occurrences, records) of the n-grams of an array<string> column.

    Up to max_n all n-grams are given; without it, all up to STEP and every longer one that stands at more than one place.
    `least` leaves out n-grams of two or more tokens with fewer occurrences.
    """
    rows = df.where(F.col(record).isNotNull()).select(F.filter(F.col(tokens), lambda x: x.isNotNull()).alias("tokens")).where(F.size("tokens") > 0)
    # records with equal tokens are one with a weight; a 128-bit hash stands for the tokens
    hashed = rows.withColumn("_m", F.md5(F.concat_ws("\u0000", "tokens"))).withColumn("_s", F.size("tokens"))
    docs = cut(hashed.groupBy("_m", "_s").agg(F.count("*").alias("weight"), F.first("tokens").alias("tokens")).select(F.xxhash64("_m", "_s").alias("record"), "weight", "tokens", F.transform("tokens", lambda x: F.xxhash64(x)).alias("h")))
    depth = min(max_n or STEP, STEP)
    every = F.sequence(F.lit(0), F.size("h") - 1)
    suffixes = _suffixes(docs, every, F.lit(0), F.lit(0).cast("long"), depth)
    found, done = [], 0
    while True:
        counts = cut(suffix_counts(suffixes, depth, least))
        counts = counts if not done else counts.where((F.col("places") > 1 if max_n is None else F.lit(True)) & (F.col("occurrences") >= least))
        whole = counts
        found.append(whole.select((F.col("d") + done).alias("n"), "occurrences", "records", "record", "place"))
        done += depth
        if max_n is not None and done >= max_n:
            break
        # the places of grams that go on: for max_n all of them, else the repeated ones
        full = suffixes.where(F.col(f"t{depth}").isNotNull()).withColumn("_g", F.struct("prefix", *[f"t{j}" for j in range(1, depth + 1)]))
        many = full.groupBy("_g").agg(F.count("*").alias("_rows")).where("true" if max_n is not None else "_rows > 1")
        alive = cut(full.join(many.select("_g"), "_g").select("record", "place", F.xxhash64("_g").alias("prefix")))
        if not alive.limit(1).count():
            break
        if max_n is not None:
            depth = min(STEP, max_n - done)
        begins = alive.groupBy("record").agg(F.collect_list(F.struct("place", "prefix")).alias("at"))
        onward = docs.join(begins, "record").select("record", "weight", "h", F.explode("at").alias("a"))
        shown = [F.get("h", F.col("a.place") + done + j).alias(f"t{j + 1}") for j in range(depth)]
        suffixes = onward.select("record", F.col("a.place").alias("place"), "weight", F.col("a.prefix").alias("prefix"), *shown).where("t1 is not null")
    every_gram = found[0]
    for f in found[1:]:
        every_gram = every_gram.unionByName(f)
    spelled = every_gram.join(docs.select("record", "tokens"), "record")
    return spelled.select("n", F.slice("tokens", F.col("place") + 1, F.col("n")).alias("gram"), "occurrences", "records")


def term_frequencies(speech_terms: DataFrame, record: str = "speech_id", term: str = "term_id", count: str = "count") -> DataFrame:
    """(term, occurrences, records) of a bag-of-words table: each row is a suffix of one token, weighted by its count.

    Repeated rows of one (record, term) count once (the largest count, if they differ); null or zero counts not at all.
    """
    clean = speech_terms.where(F.col(count) > 0).dropna(subset=[record, term])
    rows = clean.select(F.lit(0).cast("long").alias("prefix"), F.col(term).cast("long").alias("t1"), F.col(record).cast("long").alias("record"), F.lit(None).cast("int").alias("place"), F.col(count).cast("long").alias("weight"))
    return suffix_counts(rows, 1).select(F.col("first").alias(term), "occurrences", "records")


def marks(speech_terms: DataFrame, terms: DataFrame, rare_occurrences: int = 3, rare_records: int = 2, common_share: float = 0.1) -> DataFrame:
    """(term_id, mark): terms that occur and are not flagged as stop words, too rare or too common to be useful."""
    total = speech_terms.where((F.col("count") > 0) & F.col("term_id").isNotNull()).agg(F.count_distinct("speech_id").alias("total"))
    counts = term_frequencies(speech_terms)
    plain = terms.groupBy(F.col("id").alias("term_id")).agg(F.max(F.coalesce(F.col("is_stopword"), F.lit(False))).alias("stop")).where("not stop")
    mark = F.when((F.col("occurrences") < rare_occurrences) | (F.col("records") < rare_records), "rare").when(F.col("records") > common_share * F.col("total"), "common")
    # `total` is one row: the join on a constant adds a scalar, not pairs
    scalar = total.withColumn("one", F.lit(1))
    return counts.join(plain, "term_id").withColumn("one", F.lit(1)).join(F.broadcast(scalar), "one").select("term_id", mark.alias("mark")).where("mark is not null")
