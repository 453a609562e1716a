"""What transcripts hold beside spoken words: fillers, sound remarks, time marks, headings of speakers."""

from __future__ import annotations

import re

# Hesitations that carry no meaning.
FILLERS = ("เอ่อ", "เอ้อ", "อ้า", "อ่า", "อืม", "แบบว่า", "คือแบบ", "uh", "um", "er", "erm", "you know")
#: 01:02, 01:02:03, 01:02:03.456 or 01:02:03,456 in any digits, alone or as a range of two.
CLOCK = r"(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
TIME = rf"(?<![\w:]){CLOCK}(?:\s*-->\s*{CLOCK})?(?![\w:])"
#: Anything set apart by brackets, dashes, notes or stars: a remark, a time mark, a role or a heading, never speech.
#: It ends on its line; its length has no bound.
ASIDE = r"\[[^\[\]\n]*\]|<[^<>\n]*>|\{[^{}\n]*\}|\([^()\n]*\)|—[^—\n]+—|♪[^♪\n]*♪|\*[^*\n]+\*"
ASIDES = re.compile(rf"{ASIDE}|{TIME}|>>")
FILLER = re.compile(r"(?<![^\s,])(?:%s)(?:\s*ๆ)?(?=[\s,.!?…]|$),?" % "|".join(map(re.escape, sorted(FILLERS, key=len, reverse=True))), re.I)
WORD = re.compile(r"[^\W_]")
BLANKS = re.compile(r"\s+")
CLOCK_PARTS = re.compile(r"(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?")
OFFSET_MARK = re.compile(r"t=(\d+(?:\.\d+)?)")


def spoken(text: str) -> str:
    """The words of a stretch: without asides, time marks and fillers, blanks made single."""
    return BLANKS.sub(" ", FILLER.sub(" ", ASIDES.sub(" ", text))).strip()


def has_words(text: str) -> bool:
    return bool(WORD.search(FILLER.sub(" ", ASIDES.sub(" ", text))))


def first_time(text: str) -> float | None:
    """Seconds of the first time mark that a machine set: in brackets, as a range, or with a fraction; no spoken clock time."""
    for m in ASIDES.finditer(text):
        mark = m.group()
        t = OFFSET_MARK.search(mark)
        if t:
            return float(t.group(1))
        c = CLOCK_PARTS.search(mark)
        if c and (not mark[0].isdigit() or "-->" in mark or c.group(4)):
            h, mi, s, f = c.groups()
            return int(h or 0) * 3600 + int(mi) * 60 + int(s) + (float("0." + "".join(str(int(d)) for d in f)) if f else 0.0)
    return None
