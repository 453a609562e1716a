"""Problem 1: speech transcripts into clean speaker turns.

A text is cut at headings that name the next speaker by a known spelling. The stretches are ordered as a graph of
precedence constraints: dialogue order (each stretch before the next one in the text), cues (words that a heading without
words of its own announces stay behind it) and timing (an earlier machine time mark before a later one). Timing is the
strongest where the marks of a text prove reliable, that is, where at least RELIABLE stretches have one and all but one
in OUTLIERS of them already ascend; then a stretch that was moved returns to its time. Marks that contradict each other
more often than that say nothing and give no constraint. Constraints enter by strength, timing before cue before
dialogue, and one that would close a circle with those already in is dropped as conflicting; a topological order of what
remains, earliest in the text first, gives the sequence. Stretches are then cleaned, those without words dropped, and
neighbours of one speaker merged.

Headings are found without shipping the names to every task: each place that has the shape of a heading gives its
possible names (for a heading ended by a colon, the last 1..n words before it, n the longest known name's number of
words), and these meet the known spellings in an equi-join; the longest known name wins.

Cases: null and empty texts have no turns; a null person stays null; repeated rows of an id count once (the latest
scraped_at); a spelling of several persons stands for the least id; a heading that names nobody known is ordinary text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import cut
from .transcript import ASIDES, BLANKS, first_time, has_words, spoken

#: Fewest time marks that can order stretches, and one in how many of them may stand out of order.
RELIABLE, OUTLIERS = 6, 6
ROLE = r"(?:\s*\([^()\n]*\))?"
#: A colon that may end a heading: after a name and perhaps a role, not inside a clock time.
COLON = re.compile(ROLE + r"[^\S\n]*[:：](?!\d)")
BRACKET = re.compile(r"<([^<>\n]{2,})>|\[([^\[\]\n]{2,})\]")
TOKEN = re.compile(r"[^\s]+")
CUE = re.compile(r">>[^\S\n]*$")


def candidates(text: str, longest: int) -> list[tuple[int, int, str]]:
    """(begin, end, name) of every way to read a heading in a text; offsets in code points."""
    out = []
    for m in BRACKET.finditer(text):
        name = BLANKS.sub(" ", m.group(1) or m.group(2)).strip()
        if " " in name or len(name) > 3:
            out.append((m.start(), m.end(), name))
    for m in COLON.finditer(text):
        end = m.start()
        line = text.rfind("\n", 0, end) + 1
        # a role may itself belong to the name, as a nickname does: read it both ways
        for stop in {end, text.find(":", m.start(), m.end()) if ":" in m.group() else m.end() - 1}:
            begins = [t.start() for t in TOKEN.finditer(text, line, stop)][-longest:]
            for b in begins:
                name = BLANKS.sub(" ", text[b:stop]).strip()
                if name:
                    cue = CUE.search(text, line, b)
                    out.append((cue.start() if cue else b, m.end(), name))
    return out


def reliable(times: list[float]) -> bool:
    """Whether marks in text order ascend but for a few: their longest ascending subsequence leaves out at most one in OUTLIERS."""
    if len(times) < RELIABLE:
        return False
    tops: list[float] = []
    for t in times:
        at = bisect_right(tops, t)
        tops[at : at + 1] = [t]
    return len(times) - len(tops) <= len(times) // OUTLIERS


def order_stretches(times: list[float | None], cued: list[bool]) -> list[int]:
    """The sequence of a text's stretches under their precedence constraints. cued: opened by the stretch before it."""
    n = len(times)
    timed = [i for i in range(n) if times[i] is not None]
    marks = [times[i] for i in timed]
    if marks == sorted(marks) or not reliable(marks):
        return list(range(n))  # no timing edge contradicts the chain of dialogue
    timed.sort(key=lambda i: (times[i], i))
    edges = list(zip(timed, timed[1:]))
    edges += [(i, i + 1) for i in range(n - 1) if cued[i + 1]] + [(i, i + 1) for i in range(n - 1)]
    after: list[set[int]] = [set() for _ in range(n)]

    def reaches(a: int, b: int) -> bool:
        todo, seen = [a], set()
        while todo:
            x = todo.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                todo += after[x]
        return False

    for a, b in edges:
        if not reaches(b, a):
            after[a].add(b)
    waiting = [0] * n
    for a in range(n):
        for b in after[a]:
            waiting[b] += 1
    ready, out = [i for i in range(n) if not waiting[i]], []
    heapify(ready)
    while ready:
        a = heappop(ready)
        out.append(a)
        for b in after[a]:
            waiting[b] -= 1
            if not waiting[b]:
                heappush(ready, b)
    return out


def turns_of(text: str, person: int | None, headings: list[tuple[int, int, int]]) -> list[tuple[int | None, str]]:
    """(person, clean words) of the turns of one text, given its headings (begin, end, person)."""
    places, last = [], 0
    for b, e, p in sorted(headings, key=lambda h: (h[0], -h[1])):
        if b >= last:
            places.append((b, e, p))
            last = e
    begins = [(0, person)] + [(e, p) for _, e, p in places]
    ends = [b for b, _, _ in places] + [len(text)]
    stretches = [text[b:e] for (b, _), e in zip(begins, ends)]
    worded = [has_words(s) for s in stretches]
    order = order_stretches([first_time(s) for s in stretches], [i > 0 and not worded[i - 1] for i in range(len(stretches))])
    out: list[tuple[int | None, str]] = []
    for i in order:
        if not worded[i]:
            continue
        who, words = begins[i][1], spoken(stretches[i])
        if out and out[-1][0] == who:
            out[-1] = (who, out[-1][1] + " " + words)
        else:
            out.append((who, words))
    return out


def known_names(persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, person_id): every known spelling with blanks made single."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    both = aliases.select(squeeze("alias").alias("name"), F.lit(0).alias("r"), F.col("person_id")).unionByName(persons.select(squeeze("name").alias("name"), F.lit(1).alias("r"), F.col("id").alias("person_id")))
    return both.where("name <> '' and person_id is not null").groupBy("name").agg(F.min(F.struct("r", "person_id")).alias("p")).select("name", "p.person_id")


def headings(speeches: DataFrame, names: DataFrame) -> DataFrame:
    """(id, person_id, text, found) of the texts with a place shaped like a heading; found: the headings (begin, end, person)."""
    longest = names.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    kind = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("name", T.StringType())]))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("person_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("at", kind)])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, p, t, c) for i, p, t in zip(f["id"], f["person_id"].astype("Int64"), f["text"]) if (c := candidates(t, longest))]
            yield pd.DataFrame(rows, columns=["id", "person_id", "text", "at"]).astype({"person_id": "Int64"})

    shaped = speeches.where(F.col("text").rlike(r"[:：]|<[^<>\n]{2,}>|\[[^\[\]\n]{2,}\]")).select(F.col("id").cast("long").alias("id"), F.col("person_id").cast("long").alias("person_id"), "text")
    shaped = cut(shaped.mapInPandas(read, schema).dropDuplicates(["id"]))
    read_as = shaped.select("id", F.explode("at").alias("c")).select("id", "c.begin", "c.end", "c.name")
    hits = read_as.join(names.withColumnRenamed("person_id", "who"), "name")
    # at one end the longest name wins
    best = hits.groupBy("id", "end").agg(F.min(F.struct("begin", "who")).alias("h"))
    found = best.groupBy("id").agg(F.collect_list(F.struct(F.col("h.begin").alias("begin"), "end", F.col("h.who").alias("who"))).alias("found"))
    return shaped.select("id", "person_id", "text").join(found, "id")


_TURNS = "id long, person_id long, turn_no int, text string"


def _turn_rows(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        found = f["found"] if "found" in f else [()] * len(f)
        for i, p, t, h in zip(f["id"], f["person_id"].astype("Int64"), f["text"], found):
            turns = turns_of(t, None if p is pd.NA else int(p), [(x["begin"], x["end"], x["who"]) for x in h] if h is not None else [])
            if len(turns) >= least:
                rows += [(i, who, n, words) for n, (who, words) in enumerate(turns, 1)]
        yield pd.DataFrame(rows, columns=["id", "person_id", "turn_no", "text"]).astype({"person_id": "Int64"})


def dialogue_turns(speeches: DataFrame, persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """(speech_id, turn_no, person_id, text): all turns of each speech that has at least two."""
    found = headings(speeches.where(F.col("text").isNotNull()), known_names(persons, aliases))
    rows = found.mapInPandas(lambda fs: _turn_rows(fs, 2), _TURNS)
    return rows.select(F.col("id").alias("speech_id"), "turn_no", "person_id", "text")


def speaker_turns(speeches: DataFrame, persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """(speech_id, meeting_id, ordinal, turn_no, person_id, label, source, clock, text) of every speech, in clean form.

    Labels and sources get one notation, clocks become HH:MM:SS; label and clock stand on a speech's first turn.
    """
    latest = Window.partitionBy("id").orderBy(F.desc("scraped_at"))
    slim = speeches.where(F.col("text").isNotNull()).withColumn("nth", F.row_number().over(latest)).where("nth = 1")
    found = headings(slim, known_names(persons, aliases)).select("id", "found")
    all_ = slim.select("id", F.col("person_id").cast("long").alias("person_id"), "text").join(found, "id", "left")
    rows = all_.mapInPandas(lambda fs: _turn_rows(fs, 1), _TURNS)
    label = F.regexp_replace(F.trim(F.regexp_replace("speaker_label", r"(?U)\s+", " ")), "^จังหวัด|^จ\\.\\s*", "")
    parts = F.split("start_clock", ":")
    two = lambda i: F.lpad(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("00")), 2, "0")
    clock = F.when(F.col("start_clock").rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), F.concat_ws(":", two(1), two(2), two(3)))
    about = slim.select(F.col("id"), "meeting_id", "ordinal", label.alias("label"), F.lower(F.trim("speaker_source")).alias("source"), clock.alias("clock"))
    first = F.col("turn_no") == 1
    return rows.join(about, "id").select(
        F.col("id").alias("speech_id"), "meeting_id", "ordinal", "turn_no", "person_id", F.when(first, F.col("label")).alias("label"),
        F.when(first, F.col("source")).otherwise("text").alias("source"), F.when(first, F.col("clock")).alias("clock"), "text",
    )
