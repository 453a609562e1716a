"""Names as people type them: titles off, one spelling of look-alike signs, Latin transcription, comparison of parts."""

from __future__ import annotations

import re
import unicodedata

# Titles and forms of address that may precede a name.
TITLES = (
    "พันตำรวจเอกหญิง พันตำรวจโทหญิง พันตำรวจตรีหญิง ร้อยตำรวจเอกหญิง พันเอกหญิง พันโทหญิง พันตรีหญิง พลตำรวจเอก พลตำรวจโท พลตำรวจตรี พันตำรวจเอก พันตำรวจโท พันตำรวจตรี "
    "ร้อยตำรวจเอก ร้อยตำรวจโท ร้อยตำรวจตรี พลเอก พลโท พลตรี พันเอก พันโท พันตรี ร้อยเอก ร้อยโท ร้อยตรี ว่าที่ร้อยตรีหญิง ว่าที่ร้อยตรี พลเรือเอก พลอากาศเอก นาวาเอก "
    "ผู้ช่วยศาสตราจารย์ รองศาสตราจารย์ ศาสตราจารย์ นายแพทย์ แพทย์หญิง ทันตแพทย์ สัตวแพทย์ เภสัชกร ดอกเตอร์ ดร. ผศ. รศ. ศ. นพ. พญ. ทพ. น.ส. ด.ร. พล.ต.ท. พล.ต.อ. พล.ต.ต. พ.ต.อ. "
    "พ.ต.ท. พ.ต.ต. พ.อ. พ.ท. พ.ต. ร.ต.อ. ร.ต.ท. ร.ต.ต. ร.อ. ร.ท. ร.ต. ส.ส. สส. ส.ว. สว. นางสาว นาง นาย ท่าน คุณ หม่อมหลวง หม่อมราชวงศ์ ม.ล. ม.ร.ว. Mr. Mrs. Ms. Miss Dr."
).split()
_TITLE = re.compile("(?:%s)\\s*" % "|".join(map(re.escape, sorted(TITLES, key=len, reverse=True))))
# Remarks that may follow a name.
TAILS = re.compile(r"\s*(?:สมาชิกสภาผู้แทนราษฎร|สมาชิกวุฒิสภา|ครับ|ค่ะ|คะ)\s*$")
NUMBERING = re.compile(r"^\s*\d{1,4}\s*[.)]\s*")
NICKNAME = re.compile(r"\(([^()]{1,40})\)")
# Forms of address that anyone may get, and short forms of titles.
ADDRESS = frozenset("ส.ส. สส. ส.ว. สว. คุณ ท่าน".split())
SAME_TITLE = {"น.ส.": "นางสาว", "นพ.": "นายแพทย์", "พญ.": "แพทย์หญิง", "ผศ.": "ผู้ช่วยศาสตราจารย์", "รศ.": "รองศาสตราจารย์", "ศ.": "ศาสตราจารย์", "พ.อ.": "พันเอก", "พล.ต.ท.": "พลตำรวจโท"}
#: Likeness of a part of the longer name that has no partner.
UNMATCHED = 0.6
CONSONANTS = "กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ"
# The general system of transcription, first and last sounds.
FIRST = dict(zip(CONSONANTS, "k kh kh kh kh kh ng j ch ch s ch y d t th th th n d t th th th n b p ph f ph f ph m y r l w s s s h l o h".split()))
LAST = {**dict.fromkeys("กขคฆ", "k"), **dict.fromkeys("จฉชซฌฎฏฐฑฒดตถทธศษส", "t"), **dict.fromkeys("นณญรลฬ", "n"), **dict.fromkeys("บปผฝพฟภ", "p"), "ง": "ng", "ม": "m", "ย": "i", "ว": "o", "ห": "", "อ": "", "ฮ": ""}
VOWEL = {"ั": "a", "า": "a", "ิ": "i", "ี": "i", "ึ": "ue", "ื": "ue", "ุ": "u", "ู": "u", "อ": "o", "เ": "e", "แ": "ae", "โ": "o", "ไ": "ai", "ใ": "ai"}
SIGNS = "ัาิีึืุู"


def plain(raw: str) -> str:
    """One spelling: decomposed signs composed, invisible characters and hyphens gone, blanks single, digits ASCII."""
    s = unicodedata.normalize("NFKC", raw).replace("ํา", "ำ").replace("เเ", "แ")
    s = "".join(c for c in s if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n")
    s = re.sub(r"\d", lambda m: str(unicodedata.digit(m.group())), s)
    return re.sub(r"\s+", " ", s.replace("‐", "").replace("-", "")).strip()


def bare(raw: str) -> tuple[str, list[str]]:
    """(name without titles, numbering, tails and doubling; nicknames in brackets)."""
    s = plain(raw)
    nick = [m.strip() for m in NICKNAME.findall(s)]
    s = re.sub(r"\s+", " ", NICKNAME.sub(" ", s)).strip()
    s = TAILS.sub("", NUMBERING.sub("", s))
    for _ in range(4):
        m = _TITLE.match(s)
        if not m or len(s) - m.end() < 2:
            break
        s = s[m.end() :].strip()
    words = s.split(" ")
    half = len(words) // 2
    if len(words) >= 2 and len(words) % 2 == 0 and [_TITLE.sub("", w, count=1) if i == 0 else w for i, w in enumerate(words[half:])] == words[:half]:
        s = " ".join(words[:half])
    else:
        tail = [i for i in range(2, len(words)) if _TITLE.match(words[i]) and bare_words(words[i:]) == words[:i]]
        if tail:
            s = " ".join(words[: tail[0]])
    return s, nick


def bare_words(words: list[str]) -> list[str]:
    s = " ".join(words)
    for _ in range(4):
        m = _TITLE.match(s)
        if not m or len(s) - m.end() < 2:
            break
        s = s[m.end() :].strip()
    return s.split(" ")


def titles(raw: str) -> set[str]:
    """The titles at the front of a name that say something about the person (not mere address)."""
    s, out = NUMBERING.sub("", plain(raw)), set()
    for _ in range(4):
        m = _TITLE.match(s)
        if not m or len(s) - m.end() < 2:
            break
        out.add(m.group().strip())
        s = s[m.end() :]
    return {SAME_TITLE.get(t, t) for t in out - ADDRESS}


def latin(token: str) -> str:
    """The transcription of a Thai token; a Latin one in lower case."""
    if token.isascii():
        return token.lower()
    s = re.sub("[่้๊๋็]", "", _silence(token))
    out, i, n = [], 0, len(s)

    def opens(j: int) -> bool:  # a syllable begins with the consonant at j
        return j + 1 < n and s[j + 1] in SIGNS or j + 2 < n and s[j + 1] == "อ" and s[j + 2] in CONSONANTS and not (j + 3 < n and s[j + 3] in SIGNS)

    while i < n:
        lead = s[i] if s[i] in "เแโไใ" else ""
        i += bool(lead)
        if i >= n or s[i] not in CONSONANTS:
            i += 1
            continue
        out.append("" if s[i] == "อ" else FIRST[s[i]])
        i += 1
        sign = ""
        if i < n and s[i] in SIGNS:
            sign = s[i]
            i += 1
        elif not lead and i < n and s[i] == "อ" and out[-1]:
            sign = "อ"
            i += 1
        final = i < n and s[i] in CONSONANTS and not opens(i)
        if lead or sign:
            out.append(VOWEL[lead or sign])
        else:
            out.append("o" if final else "a")
        if final:
            out.append(LAST[s[i]])
            i += 1
    return "".join(out)


def _silence(token: str) -> str:
    s = token.replace("ษณ์", "").replace("ดิ์", "").replace("ตร์", "").replace("ทร์", "")
    return re.sub(r"[ก-ฮ][ิุ]?์", "", s)


def first_letter(token: str) -> str:
    return token[1] if token[:1] in "เแโไใ" and len(token) > 1 else token[:1]


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b, or most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before = last
        if min(row) > most:
            return most + 1
    return row[-1]


def is_initial(token: str) -> bool:
    """An initial or an abbreviation: letters and a full stop."""
    return 1 < len(token) <= 6 and token.endswith(".")


def token_likeness(a: str, b: str) -> float:
    """0 to 1 for two parts of a name (canonical, one script): equal, misspelt, cut short, or an initial."""
    if a == b:
        return 1.0
    if is_initial(a) or is_initial(b):
        short, long_ = sorted((a.rstrip("."), b.rstrip(".")), key=len)
        if len(short) <= 1:
            return 0.6 if first_letter(short) == first_letter(long_) else 0.0
        return 0.6 if long_.startswith(short) else 0.0
    short, long_ = sorted((a, b), key=len)
    if len(short) >= 4:
        d = distance(a, b, 2)
        if d == 1:
            return 0.92
        if d == 2 and len(short) >= 8:
            return 0.85
        if len(short) >= 6 and 2 <= len(long_) - len(short) <= 4 and long_.startswith(short):
            return 0.82
        if len(short) >= 7 and 2 <= len(long_) - len(short) <= 4 and distance(short, long_[: len(short)], 1) <= 1:
            return 0.8
    return 0.0


def assignment(score: list[list[float]]) -> list[tuple[int, int]]:
    """The pairs (row, column) of a best assignment of a score matrix with no more rows than columns (shortest augmenting paths)."""
    n, m = len(score), len(score[0])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0] = True
            row, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    slack = -score[row - 1][j - 1] - u[row] - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


def align(a: list[str], b: list[str]) -> float:
    """The likeness of two names by the best assignment of their parts, whatever their number and order.

    Every part of the shorter name must find a partner; a part of the longer one may be without (a middle name), at the
    likeness UNMATCHED, if at least two others have theirs.
    """
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long_ = sorted((a, b), key=len)
    if len(short) < len(long_) and len(short) < 2:
        return 0.0
    if len(short) == len(long_) == 2:  # both orders, without the machinery
        best = 0.0
        for x, y in ((0, 1), (1, 0)):
            first = token_likeness(a[0], b[x])
            second = first and token_likeness(a[1], b[y])
            if second:
                best = max(best, (first + second) / 2)
        return best
    score = [[token_likeness(x, y) for y in long_] for x in short]
    # a pair that is not alike must cost more than all others together
    pairs = assignment([[s if s else -float(len(long_)) for s in row] for row in score])
    got = [score[i][j] for i, j in pairs]
    return (sum(got) + UNMATCHED * (len(long_) - len(short))) / len(long_) if min(got) > 0 else 0.0


def deletes(token: str) -> set[str]:
    """The token and what remains of it with one character left out."""
    return {token, *(token[:i] + token[i + 1 :] for i in range(len(token)))}
