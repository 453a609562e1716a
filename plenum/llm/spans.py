"""Problem 5: long exact spans shared between records.

Rows are routed, not paired. Winnowing picks in every stretch of SPAN characters at least one anchor of ANCHOR
characters; a shared stretch of SPAN characters has an anchor with at least SIDE more shared characters to its left or
right, so an occurrence is kept only if (anchor, its SIDE characters on one side) occurs in another row too. What stays
are the rows that share at least ANCHOR + SIDE characters. Keys that occur in the same rows form a class: its surroundings
in a row (which hold every stretch of SPAN characters around its anchors) are united to ranges and sent once. A class is a
reference shard: a suffix automaton over its ranges, through which every one of them is streamed for its matching
statistics against the other rows; the maximal spans of SPAN or more characters are mapped back and united per row.

Automata live in the task that holds the class and are not broadcast: broadcasting every shard to every row would grow as
the square of the collection. Long copies are cut into blocks of BLOCK characters by the mean place of a key, which is the
same in all rows. A shard takes keys with up to SHARD places; a key with more (it may hold a third of all rows) counts
the exact windows of SPAN characters in its ranges by aggregation instead, which needs no group in one task; copies are
counted once there.

Cases: null texts and texts shorter than SPAN share nothing; equal texts under different keys share everything;
repeated rows of one key count once; offsets count characters (code points).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codepoints as C
from .storage import cut

SPAN, ANCHOR, SHARD, BLOCK = 100, 30, 64, 4096
WINDOW = SPAN - ANCHOR + 1
SIDE = (SPAN - ANCHOR + 1) // 2


def anchors(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, position, hash with the left side, hash with the right side) of every anchor; 0 where a side is too short.

    A window's anchor is its least hash, the first of equal ones: the same choice wherever the window's text stands.
    """
    n = len(cp) - ANCHOR + 1
    none = (np.zeros(0, np.int64),) * 4
    if n < WINDOW:
        return none
    h = C.rolling_hash(cp, ANCHOR)
    low = np.uint64((1 << 28) - 1)
    packed = (h & ~low) | (np.arange(n, dtype=np.uint64) & low)
    # least of every WINDOW neighbours, from running minima over blocks
    full = np.concatenate([packed, np.full((-n) % WINDOW, ~np.uint64(0))]).reshape(-1, WINDOW)
    left = np.minimum.accumulate(full, 1).ravel()[:n]
    right = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()[:n]
    least = np.minimum(right[: n - WINDOW + 1], left[WINDOW - 1 :])
    begin = np.arange(len(least))
    row_of = np.searchsorted(offsets, begin, "right") - 1
    inside = begin + SPAN <= offsets[row_of + 1]
    at = np.unique((least[inside] & low).astype(np.int64))
    if not len(at):
        return none
    row = np.searchsorted(offsets, at, "right") - 1
    pos = at - offsets[row]
    side = C.rolling_hash(cp, ANCHOR + SIDE)
    right_ok, left_ok = at + ANCHOR + SIDE <= offsets[row + 1], pos >= SIDE
    with np.errstate(over="ignore"):
        r = np.where(right_ok, side[np.minimum(at, len(side) - 1)], 0)
        l = np.where(left_ok, side[np.maximum(at - SIDE, 0)] * np.uint64(3) + np.uint64(1), 0)
    return row, pos, l.view(np.int64), r.view(np.int64)


class Automaton:
    """A suffix automaton over several texts that knows whose text each state occurs in (one owner, or several)."""

    def __init__(self, texts: list[str], owners: list[int]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.owner = [-1], [0], [-1]
        for t, n in zip(texts, owners):
            self._add(t, n)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p = self.link[v]
            if p > 0 and self.owner[v] != -1 and self.owner[p] != self.owner[v]:
                self.owner[p] = self.owner[v] if self.owner[p] == -1 else -2

    def _new(self, size: int, link: int, nxt: dict[str, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(nxt)
        self.owner.append(-1)
        return len(self.size) - 1

    def _add(self, text: str, n: int) -> None:
        last = 0
        nxt, link, size = self.next, self.link, self.size
        for c in text:
            q = nxt[last].get(c)
            if q is not None and size[q] == size[last] + 1:
                last = q
            elif q is not None:
                clone = self._new(size[last] + 1, link[q], dict(nxt[q]))
                link[q] = clone
                self._redirect(last, c, q, clone)
                self.owner[clone] = self.owner[q] if self.owner[q] == n else -1
                last = clone
            else:
                v = self._new(size[last] + 1, 0, {})
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = v
                    p = link[p]
                if p != -1:
                    q = nxt[p][c]
                    if size[q] == size[p] + 1:
                        link[v] = q
                    else:
                        clone = self._new(size[p] + 1, link[q], dict(nxt[q]))
                        link[q] = link[v] = clone
                        self._redirect(p, c, q, clone)
                last = v
            # the state's own occurrence; -2 marks several owners
            self.owner[last] = n if self.owner[last] in (-1, n) else -2

    def _redirect(self, p: int, c: str, q: int, clone: int) -> None:
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]

    def shared(self, text: str, n: int, least: int) -> list[tuple[int, int]]:
        """The maximal stretches of `text` (owner n) of at least `least` characters that another owner's text holds."""
        out: list[tuple[int, int]] = []
        v = 0
        for i, c in enumerate(text):
            v = self.next[v][c]  # its own text is in the automaton
            w = v
            while w > 0 and self.owner[w] == n:
                w = self.link[w]
            m = min(self.size[w], i + 1) if w > 0 else 0
            if m >= least:
                a = i + 1 - m
                if out and a <= out[-1][1]:
                    out[-1] = (min(a, out[-1][0]), i + 1)
                else:
                    out.append((a, i + 1))
        return out


def shared_spans(segments: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., begin, end): the united shared spans of every row, end exclusive."""
    id_ = F.struct(*key)
    kind = segments.select(id_.alias("id")).schema["id"].dataType
    source = segments.select(id_.alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") >= SPAN)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole, "text"):
                row, pos, left, right = anchors(*C.to_codepoints(b.column(1)))
                for which, side in ((0, left), (1, right)):
                    ok = side != 0
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[ok])), pa.array(pos[ok].astype(np.int32)), pa.array(side[ok])], names=["id", "pos", "k"])

    places = source.mapInArrow(mark, T.StructType([T.StructField("id", kind), T.StructField("pos", T.IntegerType()), T.StructField("k", T.LongType())]))
    # counted with map-side aggregation over numbers: no list of a key's rows is ever built
    hashed = places.withColumn("h", F.xxhash64("id"))
    counts = hashed.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n"), F.try_sum(F.col("h").bitwiseAND(F.lit((1 << 40) - 1))).alias("rows"), F.sum(F.col("pos").cast("long")).alias("at"))
    several = counts.where("a <> b").select("k", "n", F.xxhash64("n", F.coalesce("rows", "k"), F.floor(F.col("at") / F.col("n") / BLOCK)).alias("c"))
    chosen = places.join(several, "k").groupBy("id", "c").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("pos")).alias("at"))
    lead = SPAN - ANCHOR
    ranges = F.expr(
        f"""aggregate(at, cast(array() as array<struct<b:int,e:int>>), (acc, x) ->
             if(size(acc) > 0 and greatest(x - {lead}, 0) <= acc[size(acc) - 1].e,
                concat(slice(acc, 1, size(acc) - 1), array(named_struct('b', acc[size(acc) - 1].b, 'e', x + {ANCHOR + lead}))),
                concat(acc, array(named_struct('b', greatest(x - {lead}, 0), 'e', x + {ANCHOR + lead})))))"""
    )
    per_row = cut(chosen.select("id", "c", "n", F.explode(ranges).alias("r")))
    around = source.join(per_row.groupBy("id").agg(F.collect_list(F.struct("c", "n", "r")).alias("at")), "id")
    cuts = (
        around.select("id", "text", F.explode("at").alias("p"))
        .select("id", F.col("p.c").alias("k"), F.col("p.n").alias("n"), F.col("p.r.b").alias("from"), F.substring("text", F.col("p.r.b") + 1, F.col("p.r.e") - F.col("p.r.b")).alias("around"))
    )
    small, large = cuts.where(F.col("n") <= SHARD), cuts.where(F.col("n") > SHARD)
    span_schema = T.StructType([T.StructField("id", kind), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f])
            if not len(f):
                continue
            final = f["k"].iloc[-1]
            yield _run(f[f["k"] != final])
            held = f[f["k"] == final]
        if held is not None:
            yield _run(held)

    def _run(f: pd.DataFrame) -> pd.DataFrame:
        got = []
        for _, g in f.groupby("k", sort=False):
            ids = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in g["id"]]
            owners = {x: i for i, x in enumerate(dict.fromkeys(ids))}
            if len(owners) < 2:
                continue
            texts = list(g["around"])
            machine = Automaton(texts, [owners[x] for x in ids])
            for x, raw, t, at in zip(ids, g["id"], texts, g["from"]):
                got += [(raw, at + a, at + b) for a, b in machine.shared(t, owners[x], SPAN)]
        return pd.DataFrame(got, columns=["id", "begin", "end"])

    by_shard = small.repartition("k").sortWithinPartitions("k").select("id", "k", "from", "around").mapInPandas(stream, span_schema)

    # crowded keys: the exact windows of SPAN characters that hold the anchor; equal surroundings (copies) count once,
    # with the least and greatest row they stand in
    placed = large.where(F.length("around") >= SPAN).withColumn("c", F.md5(F.concat_ws("|", F.col("k").cast("string"), "around")))
    distinct = placed.groupBy("c").agg(F.first("around").alias("around"), F.min("id").alias("a"), F.max("id").alias("b"))
    windows = distinct.select("c", "a", "b", F.posexplode(F.expr(f"transform(sequence(1, length(around) - {SPAN - 1}), i -> xxhash64(substring(around, i, {SPAN})))")).alias("i", "w"))
    twice = windows.groupBy("w").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("w")
    crowded = (
        placed.select("id", "from", "c")
        .join(windows.join(twice, "w").select("c", "i"), "c")
        .select("id", (F.col("from") + F.col("i")).cast("int").alias("begin"), (F.col("from") + F.col("i") + SPAN).cast("int").alias("end"))
    )
    # a row's spans are bounded by its own length
    united = by_shard.unionByName(crowded).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("s"))
    merged = F.expr(
        """aggregate(s, cast(array() as array<struct<begin:int,end:int>>), (acc, x) ->
             if(size(acc) > 0 and x.begin <= acc[size(acc) - 1].end,
                concat(slice(acc, 1, size(acc) - 1), array(named_struct('begin', acc[size(acc) - 1].begin, 'end', greatest(acc[size(acc) - 1].end, x.end)))),
                concat(acc, array(x))))"""
    )
    return united.select("id.*", F.explode(merged).alias("x")).select(*key, F.col("x.begin").alias("begin"), F.col("x.end").alias("end"))


def shared_share(segments: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., spans, shared_chars) of every row that shares a span."""
    return shared_spans(segments, key, text).groupBy(*key).agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("begin")).alias("shared_chars"))
