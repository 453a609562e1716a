"""Problem 7: sentence boundaries across languages and scripts.

One pass over the text proposes gaps; each is classified by what stands before and after it.

Spaceless scripts (Thai and its neighbours): a gap follows a polite final particle before a blank. The run of letters
that ends there is a word lattice: dictionary words, particles and unknown signs are its edges, and the gap is kept if the
least-cost path ends in the particle and not in a word that reaches into it (stored word boundaries decide where they fit
the text). Where both paths cost the same, the word after the gap decides: an opening word speaks for the gap. The path
is only searched where some dictionary word does cross the particle's begin; elsewhere it must end in the particle.

Spaced scripts: the full stops of a stretch are a lattice of readings. Each is inside its sentence (abbreviation,
initial, number, enumerator of a heading) or its end, at a cost given by the token before and the word after it (opening
word, capital, lower case); two ends with no more than a letter or two between them cost extra. The cheapest path through
all readings is taken. Other terminators, line breaks and the text's end close a sentence; quotations, brackets, remarks
and time marks hold no gap, nor does an address to the chair. Stretches without words are no sentence.

Cases: null, empty and wordless texts have no sentences; stale boundaries (that do not end at the text's end) are not
used; repeated rows of an id give one set of rows; offsets count code points; a quotation that does not close on its line
is plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import short_list
from .transcript import ASIDE, FILLER, TIME, WORD

# Final particles of polite speech.
PARTICLES = ("ครับ", "คะ", "ค่ะ", "ครับผม", "จ้ะ", "จ้า", "ฮะ", "นะครับ", "นะคะ", "นะค่ะ")
# Words that open a sentence.
OPENERS_TH = ("กราบเรียน", "เรียน", "ขอ", "ผม", "ดิฉัน", "ท่าน", "สำหรับ", "ส่วน", "ดังนั้น", "เพราะฉะนั้น", "แต่", "และ", "ซึ่ง", "ประเด็น", "วันนี้", "ถ้า", "เมื่อ")
OPENERS = frozenset("he she they we i you it this that these those the a an in on at but and so then now there here when if what who why how my our his her their its as for yet still however".split())
# Abbreviations that may stand at the end of a sentence as well.
MAY_END = frozenset("u.n u.s u.k e.u p.m a.m etc inc ltd co jr sr".split())
# Abbreviations that a full stop belongs to.
ABBREVIATIONS = frozenset(
    "ดร ผศ รศ ศ นพ พญ ทพ น.ส ส.ส ส.ว พ.ร.บ พ.ร.ก ค.ร.ม ครม พ.ศ ค.ศ พ.ต.ท พ.ต.อ พ.ต.ต พล.ต.ท พล.ต.อ พล.ต.ต พล.อ อบต อบจ กทม กม ตร.กม ม ซม กก รพ รพ.สต สต น "
    "ม.ค ก.พ มี.ค เม.ย พ.ค มิ.ย ก.ค ส.ค ก.ย ต.ค พ.ย ธ.ค ป.ป.ช ก.ก.ต ก.พ.ร จ อ ต ถ ซ ข้อ "
    "dr mr mrs ms prof hon no sec art ch fig approx vs etc e.g i.e p.m a.m u.n u.s u.k st inc ltd co jr sr".split()
)
_closing = "|".join(sorted(PARTICLES, key=len, reverse=True))
EVENT = re.compile(
    rf"(?P<aside>{ASIDE}|{TIME}|>>)"
    r"|(?P<quote>[\"“«‘「『])"
    r"|(?P<end>[.!?…。！？।॥។៕؟۔｡]+)"
    r"|(?P<line>[\n\r  \u0085]+)"
    rf"|(?P<chair>(?:กราบ)?(?:เรียน)?(?:ท่าน)?ประธาน(?:สภา|ที่ประชุม)?(?:ที่เคารพ)?(?:อย่างสูง)?(?:{_closing})(?=\s|$))"
    rf"|(?P<polite>(?:{_closing})(?=\s|$))"
)
CLOSER = {'"': '"', "“": "”", "«": "»", "‘": "’", "「": "」", "『": "』"}
CLOSERS = "\"”’»」』)]"
BEFORE_TOKEN = frozenset(" \t\n\r\u2028\u2029\u0085\u00a0([<{\"“«‘「")
HEADING = re.compile(r"^\s*(?:>>)?\s*(?:\d{1,3}\.)?[^:：\n]{2,}?[:：](?!\d)")
ENUMERATED = re.compile(r"\s[^\n:：!?]{2,}?[:：](?!\d)")
NEXT_WORD = re.compile(r"[^\S\n]+([^\W\d_]+)")
#: Words of a dictionary at most (it is sent to every task), and costs of the word lattice.
LEXICON, WORD_COST, UNKNOWN_COST = 1_000_000, 1, 2
SPACELESS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
DIGITS = re.compile(r"\d{1,3}")
BASE62 = {c: i for i, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}


def decode_breaks(breaks: str) -> list[int]:
    out, at = [], 0
    for i, part in enumerate(breaks.split("_")):
        for gap in [int(part)] if i % 2 else [BASE62[c] for c in part]:
            at += gap
            out.append(at)
    return out


class Boundaries:
    def __init__(self, dictionary: frozenset[str] = frozenset()) -> None:
        self.words = {w for w in dictionary if w not in PARTICLES and SPACELESS.search(w)}
        self.longest = max(map(len, self.words), default=1)
        # for every particle, the dictionary words that end k letters inside it, by k and length
        self.crossing: dict[str, list[tuple[int, dict[int, set[str]]]]] = {}
        for p in PARTICLES:
            by_k = []
            for k in range(1, len(p) + 1):
                sizes: dict[int, set[str]] = {}
                for w in self.words:
                    if len(w) > k and w.endswith(p[:k]):
                        sizes.setdefault(len(w), set()).add(w)
                if sizes:
                    by_k.append((k, sizes))
            self.crossing[p] = by_k

    def _particle(self, text: str, begin: int, end: int, breaks: str | None) -> bool:
        """Whether the word lattice of the run that ends here ends in the particle."""
        crossed = any(text[begin + k - n : begin + k] in ws for k, sizes in self.crossing[text[begin:end]] for n, ws in sizes.items() if begin + k >= n)
        if not crossed:
            return True
        if breaks:
            try:
                known = decode_breaks(breaks)
            except (KeyError, ValueError):
                known = []
            if known and known[-1] == len(text):
                return begin in known
        start = begin
        while start and SPACELESS.match(text, start - 1):
            start -= 1
        cost = [0] + [UNKNOWN_COST * (end - start + 1)] * (end - start)
        for j in range(start + 1, end):
            best = cost[j - start - 1] + UNKNOWN_COST
            for i in range(max(start, j - self.longest), j):
                if text[i:j] in self.words and cost[i - start] + WORD_COST < best:
                    best = cost[i - start] + WORD_COST
            cost[j - start] = best
        spoken = cost[begin - start] + WORD_COST
        other = min([cost[end - start - 1] + UNKNOWN_COST] + [cost[i - start] + WORD_COST for i in range(max(start, end - self.longest), end) if i != begin and text[i:end] in self.words])
        return spoken < other or spoken == other and (end == len(text) or text.startswith(OPENERS_TH, end + 1))

    @staticmethod
    def _readings(text: str, begin: int, end: int) -> tuple[float, float]:
        """What it costs to read a single full stop as inside its sentence, and as the end of one."""
        inside, final = (0.0, 9.0), (9.0, 0.0)
        after = text[end : end + 1]
        if after and not after.isspace():
            return final if after in CLOSERS or not after.isalnum() and after not in ".,-%" else inside
        at = begin
        while at and text[at - 1] not in BEFORE_TOKEN:
            at -= 1
        token = text[at:begin]
        low = token.lower()
        m = NEXT_WORD.match(text, end)
        word = m.group(1) if m else ""
        opens = word[:1].isupper() and word.lower() in OPENERS
        if low in MAY_END:
            return (1.0, 0.0) if opens else (0.0, 2.0)
        if low in ABBREVIATIONS:
            return (0.0, 3.0)
        if len(token) == 1 and token.isalpha():
            return (0.0, 2.0)
        if "." in token and all(len(x) <= 3 for x in token.split(".")) and not token.replace(".", "").isdigit():
            return (1.0, 0.0) if opens and token.isascii() else (0.0, 2.0)
        if DIGITS.fullmatch(token) and ENUMERATED.match(text, end):
            return (0.0, 2.0)
        if token[-1:].isascii() and token[-1:].isalpha() and word[:1].isascii() and word[:1].islower():
            return (0.0, 2.0)
        return (2.0, 0.0)

    @staticmethod
    def _path(stops: list[tuple[int, int, float, float]], text: str) -> list[bool]:
        """Which full stops (begin, end, cost inside, cost final) of one stretch end a sentence, by the cheapest path."""
        costs, back = (stops[0][2], stops[0][3]), []
        for (_, before, _, _), (begin, _, c_in, c_end) in zip(stops, stops[1:]):
            short = 1.5 if len(text[before:begin].strip()) <= 2 else 0.0
            to_in = 0 if costs[0] <= costs[1] else 1
            to_end = 0 if costs[0] <= costs[1] + short else 1
            back.append((to_in, to_end))
            costs = (costs[to_in] + c_in, costs[to_end] + (short if to_end else 0.0) + c_end)
        state = 0 if costs[0] <= costs[1] else 1
        out = [state == 1]
        for b in reversed(back):
            state = b[state]
            out.append(state == 1)
        return out[::-1]

    def _scan(self, text: str, breaks: str | None) -> list[tuple]:
        """The text as operations: (0, a, b) plain stretch, (1, end) sentence end, (2, stop) a full stop to be read, (3, next line)."""
        ops: list[tuple] = []
        at, n = 0, len(text)
        while at < n:
            m = EVENT.search(text, at)
            if not m:
                break
            kind, a, b = m.lastgroup, m.start(), m.end()
            if a > at:
                ops.append((0, at, a))
            at = b
            if kind == "aside":
                continue
            if kind == "quote":
                line = text.find("\n", b)
                z = text.find(CLOSER[m.group()], b, n if line < 0 else line)
                if z >= 0:
                    ops.append((0, a, z + 1))
                    at = z + 1
                    if text[z - 1] in ".!?" and re.match(r" [A-Z]", text[at : at + 2]):
                        ops.append((1, at))
                else:
                    ops.append((0, a, b))
            elif kind == "line":
                ops.append((3, b))
            elif kind == "chair":
                ops.append((0, a, b))
            elif kind == "polite":
                ops.append((0, a, b))
                if self._particle(text, a, b, breaks):
                    ops.append((1, b))
            else:
                ops.append((0, a, b))
                if m.group() in "!?" and text[b : b + 1] in ",;":
                    continue
                stop = self._readings(text, a, b) if m.group() == "." else None
                while at < n and text[at] in CLOSERS:
                    at += 1
                if stop and stop[1] == 9.0:
                    at = b
                    continue
                if at > b:
                    ops.append((0, b, at))
                ops.append((1, at) if stop is None or stop[0] == 9.0 else (2, a, at, *stop))
        if at < n:
            ops.append((0, at, n))
        return ops

    def ends(self, text: str, breaks: str | None = None) -> list[int]:
        """The number of characters up to the end of each sentence."""
        out: list[int] = []
        begin, words, last = 0, [], 0  # sentence begin, its plain stretches, end of the last plain character

        def close(end: int) -> None:
            nonlocal begin, words
            said = FILLER.sub(" ", " ".join(words))
            if WORD.search(said):
                whole = text[begin:end]
                head = HEADING.match(whole)
                if not head or WORD.search(FILLER.sub(" ", re.sub(f"{ASIDE}|{TIME}", " ", whole[head.end() :]))):
                    out.append(end)
            begin, words = end, []

        ops = self._scan(text, breaks)
        chosen: dict[int, bool] = {}
        stretch: list[tuple[int, int, float, float]] = []
        for op in [*ops, (1, 0)]:
            if op[0] == 2:
                stretch.append(op[1:])
            elif op[0] in (1, 3) and stretch:
                chosen.update((x[1], y) for x, y in zip(stretch, self._path(stretch, text)))
                stretch = []
        for op in ops:
            if op[0] == 0:
                s = text[op[1] : op[2]]
                words.append(s)
                kept = s.rstrip()
                if kept:
                    last = op[1] + len(kept)
            elif op[0] == 1:
                close(op[1])
            elif op[0] == 2:
                if chosen[op[2]]:
                    close(op[2])
            else:
                close(last)
                begin = op[1]
        close(last)
        return out


def sentence_ends(speeches: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(speech_id, end_char) of every sentence. `words` (term) is the dictionary of the lattice; a list of more than LEXICON words is refused."""
    spark = speeches.sparkSession
    listed: list[str] = []
    if words is not None:
        spaceless = words.select("term").where(F.col("term").rlike(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")).distinct()
        listed = sorted(r[0] for r in short_list(spaceless, LEXICON))
    shipped = spark.sparkContext.broadcast(listed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Boundaries(frozenset(shipped.value))
        for f in frames:
            ends = [finder.ends(t, b) for t, b in zip(f["text"], f["breaks"])]
            yield pd.DataFrame({"speech_id": np.repeat(f["id"].to_numpy(), [len(e) for e in ends]), "end_char": np.array([x for e in ends for x in e], np.int32)})

    rows = speeches.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "text", "breaks")
    return rows.mapInPandas(run, "speech_id long, end_char int").distinct()
