"""Sentence boundaries across languages and scripts by a pushdown automaton.

The automaton reads only the events of a text (final marks, opening and closing quotations and
brackets, blank lines, white space in Thai) and keeps a stack of what is open. Boundaries found
inside a quotation or bracket wait until it closes: if the surrounding sentence goes on after it,
they are dropped, else they hold.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import TAG, WS, by_rows, spread

SENTENCES = pa.schema([("doc_id", pa.int64()), ("sent_no", pa.int32()), ("end_char", pa.int32())])
SENTENCES_DDL = "doc_id long, sent_no int, end_char int"

# Abbreviations by what may follow them. Lower case, without the last point.
#: A name or the rest of an expression follows: never an end.
TITLES = "m mm mme mmes mlle mlles dr dre pr prof st ste sts stes mgr mr mrs ms messrs rev hon gen col capt lt sgt sr sra srta sres dra d dña hr fr frl av bd boul apr env ca cf conf ex éd ed eds vgl bzw evtl ggf inkl bspw sog u.a z.b d.h u.u i.e e.g c.-à-d c.-a-d p.ex approx aprox vs ud uds डॉ श्री श्रीमती प्रो पं د أ م".split()
#: A number follows: no end before a digit, a Roman numeral or a small letter.
NUMBERED = "p pp pág págs pag fig figs ch chap cap caps vol vols n no nos nr nrn num núm t tom v vv app art arts abs abb kap bd. s.v sq sqq f ff § l ll".split()
#: These may close a sentence: no end before a small letter or a digit.
CLOSING = "etc usw u.s.w h s min sec p.m a.m j.-c apr.j.-c av.j.-c jr inc ltd co corp cie".split()
#: Words after which a German number with a point is an ordinal, and words that such an ordinal stands before.
ORDINAL_BEFORE = frozenset("am im vom zum beim dem den der des das ab seit bis".split())
ORDINAL_AFTER = frozenset("januar februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts jh tag woche".split())
PAIRS = {"«": "»", "“": "”", "„": "“”", "‹": "›", "(": ")", "（": "）", "「": "」", "『": "』", "[": "]", "【": "】", "《": "》", "〈": "〉"}
GOES_ON = frozenset(",;:،؛、，；：")

_OPENERS = {c: [o for o, ends in PAIRS.items() if c in ends] for c in set("".join(PAIRS.values()))} | {'"': ['"']}
_CLOSERS = "".join(sorted(set("".join(PAIRS.values()))))
#: Closing marks that can't open anything; they are taken in even if a blank line has parted them from what they close.
_ONLY_CLOSERS = frozenset("»”›)）」』]】》〉")
_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x85  ])"
_LINE_WS = r"[\t \xa0  -   　]"
_EVENT = re.compile(
    rf"(?P<blank>{_BREAK}(?:{_LINE_WS}|{TAG})*{_BREAK}[{WS}]*)|(?P<thai>(?<=[ก-๏๚-๿)\]”»\"])(?:{TAG})*[{WS}](?:[{WS}]|{TAG})*)|(?P<tag>{TAG})|(?P<mark>[.!?…。！？।॥؟۔]+)"
    rf"|(?P<open>[{re.escape(''.join(PAIRS))}])|(?P<close>[{re.escape(_CLOSERS)}])|(?P<straight>\")"
)
#: Characters that may belong to white space or a tag.
_NOT_SURE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000>") | {chr(c) for c in range(0x2000, 0x200B)}
_SKIP = re.compile(rf"(?:[{WS}]|{TAG})*")
_GAP_BLANK = re.compile(rf"{_BREAK}(?:{_LINE_WS}|{TAG})*{_BREAK}")
_TOKEN = re.compile(rf"[^{WS}<]+|<")
_ENTITY = re.compile(r"&#?\w+;")
_LINE_LEAD = re.compile(rf"(?:{_LINE_WS}|{TAG})*\(?")
_LIST_HEAD = re.compile(rf"(?:[{WS}]|{TAG})*(?:\(?\d+[.)])?")
_LINE_END = re.compile(_BREAK)
_WORD_AHEAD = re.compile(rf"[.,;:!?]*(\w{{1,{max(map(len, ORDINAL_AFTER))}}})[.,;:!?]*(?=[{WS}<]|$)")
_ROMAN = re.compile(r"[IVXLC]+\b")
_ALWAYS = frozenset("。！？।॥؟۔")
_CASELESS_WIDE = re.compile(r"[⺀-鿿가-힯豈-﫿ｦ-ﾟ]")
_THAI = re.compile(r"[ก-๏๚-๿]")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]")
_IPA = re.compile(r"[ɐ-ʯ]")


def _trie() -> dict:
    """Abbreviations letter by letter from their last one back; '' holds the class."""
    root: dict = {}
    for kind, words in (("title", TITLES), ("numbered", NUMBERED), ("closing", CLOSING)):
        for w in words:
            node = root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = kind
    return root


_ABBREVIATIONS = _trie()
#: Characters before a point that can decide about an abbreviation: the longest one, each letter with an accent of its own, and what stands before it.
_REACH = 2 * max(map(len, TITLES + NUMBERED + CLOSING)) + 3
_ORDINAL_REACH = max(map(len, ORDINAL_BEFORE)) + 1


def _abbreviation(text: str, end: int) -> str:
    """Class of the abbreviation whose last point is at `end`, or ''. The longest one counts."""
    word = unicodedata.normalize("NFC", text[max(0, end - _REACH) : end]).lower()
    node, found, i = _ABBREVIATIONS, "", len(word) - 1
    while i >= -1:
        if "" in node and (i < 0 or not (word[i].isalnum() or word[i] in ".-_" or unicodedata.category(word[i])[0] == "M")):
            found = node[""]
        if i < 0 or word[i] not in node:
            break
        node, i = node[word[i]], i - 1
    return found


class _Reader:
    """What the automaton asks about a text, in time proportional to its length for all questions
    together, as they come in ascending order of place: what was found out once is kept."""

    def __init__(self, text: str):
        self.text = text
        self._letters_to, self._latin = 0, False
        self._breaks, self._next_break, self._line = _LINE_END.finditer(text), -1, 0
        self._token = (0, 0, -1, -1, -1, -1)
        self._cases: dict[tuple[int, bool], str] = {}
        self._lead = (-1, 0)

    def latin_before(self, at: int) -> bool:
        """The last letter before a place is Latin."""
        if at > self._letters_to:
            for c in reversed(self.text[self._letters_to : at]):
                if c.isalpha():
                    self._latin = _LATIN.match(c) is not None
                    break
            self._letters_to = at
        return self._latin

    def line_start(self, at: int) -> int:
        """Begin of the line that a place lies in."""
        while self._next_break is not None and self._next_break <= at:
            self._line = max(self._next_break, 0)
            m = next(self._breaks, None)
            self._next_break = m.end() if m else None
        return self._line

    def first_visible(self, begin: int) -> int:
        if self._lead[0] != begin:
            self._lead = begin, _SKIP.match(self.text, begin).end()
        return self._lead[1]

    def _signs(self, at: int) -> tuple[int, int, int, int]:
        """End of the token at a place, and its last Latin letter, last letter, last phonetic sign and last stray accent."""
        if not self._token[0] <= at < self._token[1]:
            m = _TOKEN.match(self.text, at)
            if not m:
                self._token = (at, at, -1, -1, -1, -1)
            else:
                token = m[0]
                latin = alpha = ipa = stray = -1
                if not token.isascii():
                    for i, c in enumerate(token):
                        if c.isalpha():
                            alpha = i
                            if _LATIN.match(c):
                                latin = i
                        if _IPA.match(c):
                            ipa = i
                        elif i and unicodedata.combining(c) and unicodedata.category(c) == "Mn" and len(unicodedata.normalize("NFC", token[i - 1 : i + 1])) > 1:
                            stray = i
                self._token = (at, m.end(), *(at + i if i >= 0 else -1 for i in (latin, alpha, ipa, stray)))
        return self._token[1:]

    def case(self, at: int, latin: bool) -> str:
        """lower, upper, digit, none (a script without case) or end: what the words from a place on begin with. Tokens without
        letters, entities, phonetic signs, stray accents and words of another script within Latin text say nothing and are passed over."""
        text, passed, found = self.text, [], "none"
        while True:
            if (at, latin) in self._cases:
                found = self._cases[at, latin]
                break
            end, last_latin, last_alpha, ipa, stray = self._signs(at)
            if end == at:
                found = "none" if passed else "end"
                break
            passed.append((at, latin))
            foreign = latin and last_alpha >= at and last_latin < at
            if not foreign and not (last_latin >= at and stray >= at) and ipa < at and not (end - at == 2 and text.startswith("\\n", at)) and not (text[at] == "&" and _ENTITY.match(text, at)):
                c = next((c for c in map(text.__getitem__, range(at, end)) if c.isalnum()), "")
                if c:
                    found = "lower" if c.islower() else "digit" if c.isdigit() else "upper" if c.isupper() or c.istitle() else "none"
                    break
            at = _SKIP.match(text, end).end()
        for k in passed:
            self._cases[k] = found
        return found


class _Ahead:
    """What follows a place: the next visible character, and the case of the next word."""

    __slots__ = ("at", "blank", "case", "char", "gap")

    def __init__(self, reader: _Reader, at: int):
        text = reader.text
        m = _SKIP.match(text, at)
        self.at = m.end()
        self.gap = m.end() > at
        self.char = text[self.at] if self.at < len(text) else ""
        self.blank = self.gap and _GAP_BLANK.search(text, at, self.at) is not None
        self.case = reader.case(self.at, reader.latin_before(at)) if self.char else "end"


class _Open:
    """What is open, with the number of each kind, so that a mark that closes nothing costs nothing."""

    def __init__(self) -> None:
        self.marks: list[str] = []
        self.count: dict[str, int] = {}

    def __bool__(self) -> bool:
        return bool(self.marks)

    def holds(self, c: str) -> bool:
        return self.count.get(c, 0) > 0

    def open(self, c: str) -> None:
        self.marks.append(c)
        self.count[c] = self.count.get(c, 0) + 1

    def clear(self) -> None:
        self.marks.clear()
        self.count.clear()

    def close(self, c: str) -> bool:
        """Closes the last mark that c ends, and all that was opened after it."""
        ends = [o for o in _OPENERS.get(c, ()) if self.holds(o)]
        if not ends:
            return False
        while True:
            o = self.marks.pop()
            self.count[o] -= 1
            if o in ends:
                return True


def _visible_end(text: str, begin: int, end: int) -> int:
    """Place after the last visible character of text[begin:end], or begin."""
    last = begin
    for m in _TOKEN_OR_TAG.finditer(text, begin, end):
        if m["seen"]:
            last = m.end()
    return last


_TOKEN_OR_TAG = re.compile(rf"{TAG}|(?P<seen>[^{WS}<]+|<)")


def _has_word(text: str, begin: int, end: int) -> bool:
    """A letter or digit stands there, outside of tags."""
    return any(m["seen"] and any(c.isalnum() for c in m["seen"]) for m in _TOKEN_OR_TAG.finditer(text, begin, end))


def sentence_ends(text: str) -> list[int]:
    """end_char of every sentence, ascending."""
    ends: list[int] = []
    reader, stack = _Reader(text), _Open()
    waiting: list[int] = []  # boundaries inside what is open
    skip_to = opened = 0

    def emit(e: int) -> None:
        begin = ends[-1] if ends else 0
        if e > begin and (text[e - 1] not in _NOT_SURE or _visible_end(text, begin, e) > begin):
            ends.append(e)

    for m in _EVENT.finditer(text):
        if m.start() < skip_to or m["tag"]:
            continue
        a, b = m.span()
        if m["blank"] or m["thai"] and _GAP_BLANK.search(text, a, b):
            for e in waiting:
                emit(e)
            stack.clear()
            waiting.clear()
            begin = ends[-1] if ends else 0
            emit(_visible_end(text, begin, a))
        elif m["open"] or m["straight"]:
            c = m[0]
            if (c == '"' or c == "“" and stack.holds("„")) and stack.close(c):
                if not stack:
                    waiting.clear()
            else:
                opened = opened if stack else a
                stack.open(c)
        elif m["close"]:
            if stack.close(m[0]) and not stack:
                # No mark stands right before it, so the surrounding sentence goes on; unless that is
                # only the quotation, whose last mark comes after it.
                begin = ends[-1] if ends else 0
                if _EVENT.match(text, b) and text[b] in ".!?…" and not _has_word(text, _LIST_HEAD.match(text, begin, opened).end(), opened):
                    for w in waiting:
                        emit(w)
                waiting.clear()
        elif m["thai"]:
            before, ahead = text[a - 1], _Ahead(reader, a)
            if not _THAI.match(before):
                before = text[a - 2] if a > 1 else ""
            if _THAI.match(before) and ahead.char and not ahead.char.isdigit() and not ahead.blank:
                if stack:
                    waiting.append(a)
                else:
                    emit(a)
        else:
            ahead = _Ahead(reader, b)
            if not _may_end(reader, a, b, m["mark"], ahead, ends[-1] if ends else 0):
                continue
            e, closed = b, False
            while ahead.char and not ahead.blank and (stack.close(ahead.char) if stack and (ahead.char in _CLOSERS or ahead.char == '"') else ahead.char in _ONLY_CLOSERS):
                e = skip_to = ahead.at + 1
                closed, ahead = True, _Ahead(reader, e)
            on = ahead.case == "lower" or ahead.char in GOES_ON or ahead.char in _ALWAYS or (ahead.char in ".!?…" and ahead.char != "")
            if closed and ahead.case == "none" and not on and ahead.char:
                # Scripts without case: what follows a quotation goes on with it (he said, and then).
                on = not (ahead.gap and _CASELESS_WIDE.match(ahead.char)) and (ahead.char.isalnum() or unicodedata.category(ahead.char)[0] == "L")
                if ahead.gap and _THAI.match(ahead.char):
                    on = False
            if ahead.blank or not ahead.char:
                on = False
            if stack:
                if not on:
                    waiting.append(e)
            elif on:
                waiting.clear()
            else:
                for w in waiting:
                    emit(w)
                waiting.clear()
                emit(e)
    for e in waiting:
        emit(e)
    begin = ends[-1] if ends else 0
    emit(_visible_end(text, begin, len(text)))
    if len(ends) > 1 and not _has_word(text, ends[-2], ends[-1]):
        ends.pop()  # signs without a word after the last sentence are no sentence
    return ends


def _may_end(reader: _Reader, a: int, b: int, mark: str, ahead: _Ahead, begin: int) -> bool:
    """Whether the mark at [a, b) can end a sentence, before what is open is looked at."""
    text = reader.text
    if ahead.blank or not ahead.char:
        return True
    if any(c in _ALWAYS for c in mark):
        return True
    if not ahead.gap and (ahead.char.isalnum() or ahead.char in "_/\\@"):
        return _space_is_missing(text, a, mark, ahead.char)
    if mark != ".":
        return True
    if a == 0:
        return True
    before = text[a - 1]
    if before.isdigit():
        k = a
        while k > begin and text[k - 1].isdigit():
            k -= 1
        if _LINE_LEAD.fullmatch(text, reader.line_start(k), k) or reader.first_visible(begin) in (k, k - 1) and a - k <= 4:
            return False
        follows = _WORD_AHEAD.match(text, ahead.at)
        if follows and follows[1].lower() in ORDINAL_AFTER:
            return False
        space = k
        while space > begin and text[space - 1].isspace():
            space -= 1
        earlier = text[max(0, space - _ORDINAL_REACH) : space].split() if space < k else []
        if earlier and earlier[-1].lower() in ORDINAL_BEFORE and ahead.case == "upper":
            return False
        return True
    alone = before.isalpha() and (a == 1 or not (text[a - 2].isalnum() or text[a - 2] in "._-" or unicodedata.category(text[a - 2])[0] == "M"))
    if alone and "a" <= before <= "z" and ahead.case == "upper":
        # A small letter before a capital: a word at the end, unless a Roman numeral (t. II) or z. B. follows.
        return not _ROMAN.match(text, ahead.at) and not (before == "z" and text.startswith("B.", ahead.at))
    kind = _abbreviation(text, a)
    if kind == "title":
        return False
    if kind == "numbered":
        return ahead.case not in ("lower", "digit") and not _ROMAN.match(text, ahead.at)
    if kind == "closing":
        if ahead.case == "digit":
            return "\n" in text[b : ahead.at] or "\r" in text[b : ahead.at]
        return ahead.case != "lower"
    if alone:
        # A single letter with a point is an initial, in scripts that have them.
        return not ("A" <= before.upper() <= "Z" or before.isupper())
    return True


def _space_is_missing(text: str, a: int, mark: str, follows: str) -> bool:
    """A mark right before a letter ends a sentence only where a space has been lost: after a word of
    three letters or more and before a capital, or in scripts without case but with spaces."""
    word = text[max(0, a - 3) : a].rstrip(" \xa0\u202f") if mark[0] in "!?…" else text[max(0, a - 3) : a]
    if "LATIN" in unicodedata.name(follows, "") or "GREEK" in unicodedata.name(follows, "") or "CYRILLIC" in unicodedata.name(follows, ""):
        return follows.isupper() and word[-1:].isalnum() and (mark != "." or len(word) == 3 and word.isalpha() and not word.isupper())
    return bool(_SPACED.match(follows) and word and (_SPACED.match(word[-1]) or unicodedata.category(word[-1])[0] == "M"))


_SPACED = re.compile(r"[\u0590-\u06ff\u0750-\u077f\u0900-\u0dff]")


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """SENTENCES_DDL of every text: one row per sentence, sent_no from 0, end_char in code points.

    Null, empty and blank texts have no rows; neither has a text of tags only. A text without any
    mark is one sentence per block between blank lines. Rows are independent of each other; a text is
    read once, in time proportional to its length.
    """

    def emit(k: int, t: str | None) -> Iterator[tuple]:
        if t:
            for i, e in enumerate(sentence_ends(t)):
                yield k, i, e

    return spread(df.where(F.col(text).isNotNull()).select(F.col(key).cast("long"), F.col(text)), key).mapInArrow(by_rows(emit, SENTENCES), SENTENCES_DDL)
