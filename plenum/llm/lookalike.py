"""Problem 10: one form for each look of a text.

Arrow text becomes numpy code-point arrays; a lookup table gathers the replacement of every code point, expansion
offsets make room for those that become two or three, invisible ones vanish, and marks that sit on one base are
brought into one order by a single stable sort over the marks of the whole batch. Then bases and marks are composed: in
each round the first mark behind every base is looked up with it in the sorted table of pairs, until none fits. Hangul
is taken apart and composed by arithmetic.

Cases: a null text stays null; an empty text, or one without any visible character, has the empty form and is in no
pair; byte-equal texts are no pair; letter case, digit shape, quotation marks and line breaks stay visible.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codepoints as C
from .graph import all_pairs
from .storage import cut

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԛ": "q", "ԝ": "w", "һ": "h", "ԁ": "d", "ӏ": "l", "ү": "y", "ɡ": "g", "ɑ": "a",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ı": "i", "ⅼ": "l", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x",
    "Ӏ": "I", "Ԍ": "G", "Ѵ": "V", "ѵ": "v", "Ϲ": "C", "օ": "o", "Օ": "O", "ո": "n", "ս": "u", "հ": "h", "Ս": "U", "Ꭺ": "A", "Ᏼ": "B",
    "Ꮯ": "C", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
# Hyphens and dashes of one length, and Thai sequences that are drawn alike.
SAME_SIGN = {"‐": "-", "‑": "-", "−": "-", "ำ": "ํา", "แ": "เเ", " ": "\n", " ": "\n", "\u0085": "\n"}
# Place of Thai and Lao marks on their base, vowels before tone marks before the silencer.
MARK_ORDER = {**dict.fromkeys("ฺุู", 103), **dict.fromkeys("ัิีึื็ํ", 104), **dict.fromkeys("่้๊๋", 107), "์": 108, "๎": 108}
# Format characters that are not drawn (soft hyphen, joiners, direction marks, fillers).
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎ㅤ﻿ﾠ"
#: The lookup table ends here; beyond it stand tags and variation selectors, which are not drawn, and private characters.
TOP, TAGS = 0x30000, (0xE0000, 0xE1000)
#: Hangul: first syllable, first letters of a beginning, a vowel and an end, vowels and ends (with none) a syllable can have.
SYLLABLE, LEAD, VOWEL, TAIL, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28


def _whole(i: int) -> bool:
    """Ideographs, syllables and surrogates, which have no table entry of their own."""
    return 0xD800 <= i < 0xE000 or 0x3400 <= i < 0xA000 or 0xAC00 <= i < 0xD7A4 or 0x20000 <= i < 0x2F800


def _parts(ch: str) -> str:
    """Full canonical decomposition, with wide, narrow and no-break forms folded."""
    kind = unicodedata.decomposition(ch)
    if kind.startswith(("<wide>", "<narrow>", "<noBreak>")):
        return "".join(_parts(chr(int(x, 16))) for x in kind.split()[1:])
    return unicodedata.normalize("NFD", ch)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point below TOP: how many code points replace it, those (up to 4), and the order of a mark (0: no mark)."""
    size = np.ones(TOP, np.int8)
    to = np.zeros((TOP, 4), np.uint32)
    to[:, 0] = np.arange(TOP)
    order = np.zeros(TOP, np.uint8)
    for i in range(TOP):
        if _whole(i):
            continue
        ch = chr(i)
        kind = unicodedata.category(ch)
        order[i] = MARK_ORDER.get(ch, unicodedata.combining(ch))
        if ch in INVISIBLE or kind == "Cf" or 0xFE00 <= i < 0xFE10 or (kind == "Cc" and ch not in "\n\t\r\x0b\x0c\x85"):
            size[i] = 0
            continue
        out = "".join(SAME_SIGN.get(x, LOOKALIKES.get(x, x)) for x in _parts(ch))
        if kind == "Zs" or ch in "\t\r\x0b\x0c":
            out = " "
        size[i] = len(out)
        to[i, : len(out)] = [ord(x) for x in out]
    return size, to, order


@lru_cache(maxsize=1)
def compositions() -> tuple[np.ndarray, np.ndarray]:
    """The pairs (base << 32 | mark) that are drawn as one character, sorted, and those characters."""
    pairs = []
    for i in range(0xC0, TOP):
        if not _whole(i):
            kind = unicodedata.decomposition(chr(i))
            if kind and kind[0] != "<" and " " in kind:
                base, mark = (int(x, 16) for x in kind.split())
                if unicodedata.normalize("NFC", chr(base) + chr(mark)) == chr(i):
                    pairs.append((base << 32 | mark, i))
    key, to = np.array(sorted(pairs), np.uint64).T
    return key, to.astype(np.uint32)


def compose(out: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts bases and their marks together, in rounds over all rows at once."""
    order = tables()[2]
    key, to = compositions()
    while True:
        marks = np.flatnonzero(np.where(out < TOP, order[np.minimum(out, TOP - 1)], 0))
        marks = marks[marks > 0]
        begins = np.zeros(len(out) + 1, bool)
        begins[offsets] = True
        marks = marks[~begins[marks]]
        before = out[marks - 1]
        first = np.where(before < TOP, order[np.minimum(before, TOP - 1)], 0) == 0
        marks, before = marks[first], before[first]
        pair = before.astype(np.uint64) << np.uint64(32) | out[marks].astype(np.uint64)
        at = np.minimum(np.searchsorted(key, pair), len(key) - 1)
        hit = key[at] == pair
        if not hit.any():
            break
        out = out.copy()
        out[marks[hit] - 1] = to[at[hit]]
        mask = np.ones(len(out), bool)
        mask[marks[hit]] = False
        out, offsets = C.keep(out, offsets, mask)
    vowels = np.flatnonzero((out >= VOWEL) & (out < VOWEL + VOWELS))
    if len(vowels):
        begins = np.zeros(len(out) + 1, bool)
        begins[offsets] = True
        led = vowels[(vowels > 0) & ~begins[vowels]]
        led = led[(out[led - 1] >= LEAD) & (out[led - 1] < LEAD + 19)]
        out = out.copy()
        out[led - 1] = SYLLABLE + ((out[led - 1] - LEAD) * VOWELS + out[led] - VOWEL) * TAILS
        ended = led[(led + 1 < len(out)) & ~begins[led + 1]]
        ended = ended[(out[ended + 1] > TAIL) & (out[ended + 1] < TAIL + TAILS)]
        out[ended - 1] += out[ended + 1] - TAIL
        mask = np.ones(len(out), bool)
        mask[led] = False
        mask[ended + 1] = False
        out, offsets = C.keep(out, offsets, mask)
    return out, offsets


def fold(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The common form of every row of a flat code-point array."""
    size, to, order = tables()
    low = np.minimum(cp, TOP - 1)
    n = size[low].astype(np.int64)
    n[cp >= TOP] = 1
    n[(cp >= TAGS[0]) & (cp < TAGS[1])] = 0
    hangul = np.flatnonzero((cp >= SYLLABLE) & (cp < SYLLABLE + 19 * VOWELS * TAILS))
    if len(hangul):
        place = cp[hangul] - SYLLABLE
        n[hangul] = 2 + (place % TAILS > 0)
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    out = np.zeros(at[-1], np.uint32)
    one = n > 0
    out[at[:-1][one]] = np.where(cp >= TOP, cp, to[low, 0])[one]
    for j in (1, 2, 3):
        more = np.flatnonzero(n > j)
        out[at[more] + j] = to[low[more], j]
    if len(hangul):
        out[at[hangul]] = LEAD + place // (VOWELS * TAILS)
        out[at[hangul] + 1] = VOWEL + place // TAILS % VOWELS
        ended = place % TAILS > 0
        out[at[hangul[ended]] + 2] = TAIL + place[ended] % TAILS
    offsets = at[offsets]
    # marks: a stable sort by (base, order) of the positions that hold one
    kind = np.where(out < TOP, order[np.minimum(out, TOP - 1)], 0)
    row_start = np.zeros(len(out) + 1, bool)
    row_start[offsets] = True
    marks = np.flatnonzero(kind)
    if len(marks):
        base = np.cumsum((kind == 0) | row_start[:-1])
        sorted_ = marks[np.lexsort((out[marks], kind[marks], base[marks]))]
        out[marks] = out[sorted_]
    out, offsets = compose(out, offsets)
    row_start = np.zeros(len(out) + 1, bool)
    row_start[offsets] = True
    # one blank for a run; none next to a line break or at the ends
    blank = out == 0x20
    edge = (out == 0x0A) | blank
    before = np.ones(len(out), bool)
    before[1:] = edge[:-1]
    before |= row_start[:-1]
    mask = ~(blank & before)
    out, offsets = C.keep(out, offsets, mask)
    blank = out == 0x20
    row_end = np.zeros(len(out) + 1, bool)
    row_end[offsets] = True
    after = np.zeros(len(out), bool)
    after[:-1] = out[1:] == 0x0A
    mask = ~(blank & (after | row_end[1:]))
    return C.keep(out, offsets, mask)


def common_form(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, form, form_hash, text_hash) of every row; null texts give nulls. Texts themselves are not shuffled by it."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.slices(whole, "text"):
                col = b.column(1)
                form = C.to_arrow(*fold(*C.to_codepoints(col)), valid=~np.asarray(col.is_null()))
                yield pa.RecordBatch.from_arrays([b.column(0), col, form], names=["key", "text", "form"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("text", T.StringType()), T.StructField("form", T.StringType())])
    folded = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return folded.select(F.col("key").alias(key), "form", F.sha2("form", 256).alias("form_hash"), F.sha2("text", 256).alias("text_hash"))


def same_look_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", full_class: int = 200) -> DataFrame:
    """(key_a, key_b), a < b: all rows that look the same and differ in bytes.

    Pairs of different stored forms are made first, then their rows: copies of one form never meet. Forms of a class and
    rows of a form are dealt in blocks of about `full_class`, so that a class may hold a third of all rows; the result
    does not depend on it. Repeated rows of one key count once. Rows with a null or invisible text are in no pair.
    """
    forms = cut(common_form(df, key, text).where(F.length("form") > 0).select(key, "form_hash", "text_hash").distinct())
    per_text = forms.groupBy("form_hash", "text_hash").agg(F.ceil(F.count("*") / full_class).cast("int").alias("blocks"))
    classes = per_text.groupBy("form_hash").agg(F.count("*").alias("texts")).where("texts > 1").select("form_hash")
    texts = cut(per_text.join(classes, "form_hash"))
    pairs = all_pairs(texts.select("form_hash", "text_hash"), "form_hash", "text_hash", full_class).select("a", "b")
    rows = forms.join(texts.select("text_hash", "blocks"), "text_hash").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    side = lambda n: rows.select(F.col("text_hash").alias(n), F.col("block").alias(f"block_{n}"), F.col(key).alias(f"k{n}"))
    blocks = lambda n: texts.select(F.col("text_hash").alias(n), F.explode(F.expr("sequence(0, blocks - 1)")).alias(f"block_{n}"))
    met = pairs.join(blocks("a"), "a").join(blocks("b"), "b").join(side("a"), ["a", "block_a"]).join(side("b"), ["b", "block_b"]).where("ka <> kb")
    return met.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()
