"""Text functions on columns. Null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectorised import vectorised

# Accents and the letters they are written as.
ACCENTS = ("éèêëàâäîïôöùûüÿç", "eeeeaaaiioouuuyc")
ACCENTS_WIDE = ("âàäáãéèêëîïìíôöòóõûùüúçÿñ", "aaaaaeeeeiiiiooooouuuucyn")
FUNCTION_WORDS = "que et ou mais donc car ni où dont à de du au aux en par pour avec sans sur sous".split()
#: Closed classes that no pause may follow (DET ADP CCONJ SCONJ PART PRON), seeded by the function words.
NO_PAUSE_AFTER = sorted({*FUNCTION_WORDS, *"le la les l un une des ce cet cette ces mon ma mes son sa ses leur leurs je tu il elle on nous vous ils elles se ne qui".split()})
SPELLING = {"predestinait": "prédestinait", "appatride": "apatride", "magellane": "Magellan", "qu'est-ce": "Qu'est-ce"}
#: The word and space classes of the reference, which is Python: combining marks are no part of words, the separators 1C to 1F are white space.
MARK = r"(?U)[^\p{L}\p{N}_\s\x1C-\x1F]"
SPACE = r"(?U)[\s\x1C-\x1F]"
#: Spaces of any width (class Zs), without tabs and line ends.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def has_word(c: Column) -> Column:
    """Holds a letter, digit or underscore of any script; false for null."""
    return F.coalesce(c.rlike(r"(?U)\w"), F.lit(False))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def squeeze_all(c: Column) -> Column:
    """Single spaces for white space of any kind, no-break spaces among it."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def strip_all(c: Column) -> Column:
    """No white space of any kind at the ends."""
    return F.regexp_replace(c, rf"{SPACE}+\z|\A{SPACE[4:]}+", "")


def trim_spaces(c: Column) -> Column:
    """No spaces of any width at the ends; tabs and line ends stay. SQL's trim, where F.trim takes the plain space only."""
    return F.btrim(c, F.lit(SPACES))


def whole_word(group: str) -> str:
    """Pattern of one of the words, without letters, digits or underscores beside it."""
    return rf"(?iU)(?<![\p{{L}}\p{{N}}_])({group})(?![\p{{L}}\p{{N}}_])"


def fold_word(c: Column) -> Column:
    """small letters, no punctuation, French accents dropped."""
    return F.translate(F.regexp_replace(F.lower(c), MARK, ""), *ACCENTS)


def fold_word_plain(c: Column) -> Column:
    """accents and spaces dropped, then . ! ? ; : - and small letters. A comma stays, as spaces go before the mark ', ' is looked for."""
    return F.lower(F.translate(F.translate(c, ACCENTS_WIDE[0] + ACCENTS_WIDE[0].upper(), ACCENTS_WIDE[1] + ACCENTS_WIDE[1].upper()), " .!?;:-", ""))


def alignment_token(c: Column) -> Column:
    """tokens with one of ß ? . , ; lose them and become small; others stay as they are."""
    return F.when(c.rlike("[ß?.,;]"), F.lower(F.translate(c, "ß?.,;", ""))).otherwise(c)


def loose(c: Column) -> Column:
    """small letters, no punctuation, single spaces."""
    return squeeze_all(F.regexp_replace(F.lower(c), MARK, ""))


def without_punctuation(c: Column) -> Column:
    """small letters, no punctuation, spaces inside kept."""
    return F.trim(F.regexp_replace(F.lower(c), MARK, ""))


def without_ascii_punctuation(c: Column) -> Column:
    """ASCII punctuation dropped, small letters, single spaces."""
    return squeeze_all(F.lower(F.translate(c, ASCII_PUNCTUATION, "")))


@vectorised("string")
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(c: Column) -> Column:
    """NFC, small letters, single spaces. Composed in Python, as Spark has no normaliser."""
    return squeeze(F.lower(_nfc(c)))


def drop_marks_after(c: Column, words: list[str]) -> Column:
    """F8 3a: commas and points right after one of the words are dropped."""
    group = "|".join(words)
    return F.regexp_replace(c, rf"{whole_word(group)}{SPACE[4:]}*[,.]+", "$1")


def clean_transcript(c: Column) -> Column:
    """F8 without the tagger's part: single spaces, no comma, point or [*] after function words, no semicolon.
    Dropping [*] also takes the space after it."""
    group = "|".join(FUNCTION_WORDS)
    c = F.regexp_replace(drop_marks_after(squeeze_all(c), FUNCTION_WORDS), rf"{whole_word(group)}\s*\[\*\]\s*", "$1")
    return F.translate(c, ";", "")


def drop_spurious_marks(c: Column, also_points: bool = False) -> Column:
    """commas and [*] after a word that no pause may follow. The word's class comes from the
    closed list NO_PAUSE_AFTER, in place of a tagger."""
    group = "|".join(NO_PAUSE_AFTER)
    return F.regexp_replace(c, rf"{whole_word(group)}{SPACE[4:]}*(?:\[\*\]|{'[,.]' if also_points else ','})+", "$1")


def without_commas(c: Column) -> Column:
    """F10."""
    return F.translate(c, ",;", "")


def aligner_text(c: Column) -> Column:
    """punctuation to spaces, then single spaces."""
    return squeeze_all(F.regexp_replace(c, r'[.,!?;:"\\()\-_“”«»]', " "))


def manifest_words(c: Column) -> Column:
    """array of (word, original) pairs: quotes to apostrophes, no punctuation, - and _ part words, accents dropped."""
    plain = F.translate(F.translate(F.trim(c), '"', "'"), ".,;:!?()[]{}", "")
    words = F.filter(F.split(F.translate(plain, "-_", "  "), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(F.translate(F.lower(w), *ACCENTS_WIDE).alias("word"), w.alias("original")))


def straight_to_apostrophe(c: Column) -> Column:
    """F13."""
    return F.translate(c, '"', "'")


def word_count(c: Column) -> Column:
    """words between white space of any kind; 0 for blank and null."""
    return F.coalesce(F.size(F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")), F.lit(0))


def ascii_word_count(c: Column) -> Column:
    """P10: words between ASCII white space, as its SQL counts them: a no-break space inside stays within its word. 0 where there
    are spaces only, and 1 for tabs or line ends alone."""
    return F.when(trim_spaces(c) == "", F.lit(0)).otherwise(F.size(F.split(trim_spaces(F.regexp_replace(c, r"\s+", " ")), " ")))


def sentence_count(c: Column) -> Column:
    """non-blank parts between runs of . ! ?"""
    return F.size(F.filter(F.split(c, r"[.!?]+"), lambda p: strip_all(p) != ""))


def mark_count(c: Column) -> Column:
    """F15, second form: number of . ! ?, at least 1."""
    return F.greatest(F.regexp_count(c, F.lit(r"[.!?]")), F.lit(1))


def xml_escape(c: Column) -> Column:
    """F16."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def without_control(c: Column) -> Column:
    """F16: control characters dropped."""
    return F.regexp_replace(c, r"[\x00-\x1F\x7F]", "")


def breath_hint(c: Column) -> Column:
    """a last comma or ß becomes ', h', a last ! or ? gets ' h'."""
    head = F.substring(c, F.lit(1), F.length(c) - 1)
    return F.when(F.endswith(c, F.lit(",")) | F.endswith(c, F.lit("ß")), F.concat(head, F.lit(", h"))).when(F.endswith(c, F.lit("!")), F.concat(head, F.lit("! h"))).when(F.endswith(c, F.lit("?")), F.concat(head, F.lit("? h"))).otherwise(c)


def correct_spelling(c: Column, corrections: dict[str, str] | None = None) -> Column:
    """whole words, whatever their case."""
    for wrong, right in (corrections or SPELLING).items():
        c = F.regexp_replace(c, whole_word(wrong), right)
    return c


def model_label(c: Column) -> Column:
    """a model's name as shown in tables: a size after ':' in brackets and capitals for the families that have one
    (qwen, deepseek), each part between '-' with a capital for deepseek, a blank before a version for granite; else only
    the first letter is made a capital and the rest small."""
    capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))
    base, size = F.substring_index(c, ":", 1), F.upper(F.substring_index(c, ":", -1))
    sized = lambda shown: F.when(c.contains(":"), F.concat(shown, F.lit(" ("), size, F.lit(")"))).otherwise(shown)
    family = F.lower(c)
    first = F.concat(F.upper(F.substring(base, 1, 1)), F.substring(base, F.lit(2), F.length(base)))
    parts = F.array_join(F.transform(F.split(base, "-"), capital), "-")
    version = F.concat(capital(F.substring_index(c, ".", 1)), F.lit(" ."), F.substring_index(c, ".", -1))
    return F.when(family.contains("qwen"), sized(first)).when(family.contains("deepseek"), sized(parts)).when(family.contains("granite") & c.contains("."), version).otherwise(capital(c))


def speaker_of(voice: Column) -> Column:
    """the part before _EPnn, else before the first underscore."""
    s = F.regexp_extract(voice, r"^(.+)_EP\d+$", 1)
    return F.when(s != "", s).otherwise(F.split_part(voice, F.lit("_"), F.lit(1)))


def episode_of(voice: Column) -> Column:
    return F.regexp_extract(voice, r"_(EP\d+)$", 1)


def tight_breaks(c: Column) -> Column:
    """no white space around <break/>."""
    return F.trim(F.regexp_replace(c, r"\s*<break\s*/>\s*", "<break/>"))


def prompt(instruction: str, text: Column, marker: str = "### Response:") -> Column:
    """a prompt that ends in the marker."""
    return F.concat(F.lit(f"{instruction}\n\n### Input:\n"), text, F.lit(f"\n\n{marker}\n"))


def after_marker(c: Column, marker: str = "### Response:") -> Column:
    """what follows the first marker, trimmed; the whole text where there is none."""
    at = F.instr(c, marker)
    return F.trim(F.when(at > 0, F.substring(c, at + len(marker), F.length(c))).otherwise(c))


def number_in(c: Column, unit: str = "%") -> Column:
    """The number before a unit, null where there is none."""
    return F.regexp_replace(F.trim(c), rf"\s*{unit}$", "").try_cast("double")


def percent(c: Column) -> Column:
    return number_in(c, "%")


def milliseconds(c: Column) -> Column:
    """Whole milliseconds of '350ms' or '350'; null for other forms."""
    return F.regexp_extract(F.trim(c), r"^(\d+)\s*(?:ms)?$", 1).try_cast("int")


def sortable_number(c: Column) -> Column:
    """The last number in a name, null if none."""
    return F.regexp_extract(c, r"(\d+)(?!.*\d)", 1).try_cast("bigint")
