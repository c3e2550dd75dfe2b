"""SSML as columns: building, cleaning, reading and the layouts of training pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import breath_hint, milliseconds, percent, squeeze, without_control, xml_escape
from .vectorised import vectorised

# Fixed values.
SYNTHESIS = "http://www.w3.org/2001/10/synthesis"
MSTTS = "http://www.w3.org/2001/mstts"
SPEAK = f'<speak xmlns="{SYNTHESIS}" version="1.0" xml:lang="fr-FR">'
SPEAK_MSTTS = f'<speak xmlns="{SYNTHESIS}" xmlns:mstts="{MSTTS}" version="1.0" xml:lang="fr-FR">'
LEADING, TRAILING = '<mstts:silence type="Leading-exact" value="0"/>', '<mstts:silence type="Tailing-exact" value="0"/>'


@vectorised("string")
def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if pd.isna(x) else f"{x:+.2f}")


def signed(c: Column) -> Column:
    """Signed number with two decimals, rounded half to even on the exact value (the JVM's format rounds
    half up and differs on about one value in a thousand). Vectorised Python for that reason only."""
    return _signed(c.cast("double"))


def prosody(pitch: Column, rate: Column, volume: Column, inner: Column, quote: str = '"') -> Column:
    """A prosody element; the attributes are texts such as +1.00%."""
    q = F.lit(quote)
    return F.concat(F.lit("<prosody pitch="), q, pitch, q, F.lit(" rate="), q, rate, q, F.lit(" volume="), q, volume, q, F.lit(">"), inner, F.lit("</prosody>"))


def break_tag(ms: Column) -> Column:
    return F.concat(F.lit('<break time="'), ms.cast("string"), F.lit('ms"/>'))


def chunk_element(text: Column, pitch: Column, rate: Column, volume: Column, pause_ms: Column, factor: float = 1.0, least_ms: int = 50, with_break: bool = True) -> Column:
    """A chunk's prosody with its pause inside. A pause after a text that ends in . ? ! stays whole, others are
    multiplied and cut to whole milliseconds; short ones are left out."""
    pct = lambda c: F.concat(signed(c), F.lit("%"))
    kept = F.when(text.rlike(r"[.?!]$"), pause_ms).otherwise(F.floor(pause_ms * factor)).cast("bigint")
    tail = F.when(pause_ms >= least_ms, break_tag(kept)).otherwise("") if with_break else F.lit("")
    return prosody(pct(pitch), pct(rate), pct(volume), F.concat(xml_escape(text), tail))


def speak(inner: Column, voice: Column, silences: bool = False) -> Column:
    """The document around elements."""
    head, tail = (F.lit(SPEAK_MSTTS), F.lit(TRAILING)) if silences else (F.lit(SPEAK), F.lit(""))
    return F.concat(head, F.lit('<voice name="'), voice, F.lit('">'), F.lit(LEADING if silences else ""), inner, tail, F.lit("</voice></speak>"))


def legacy_fragment(text: Column, pitch: Column, rate: Column, volume: Column, pause_ms: Column, style: str | None = None, degree: str = "1") -> Column:
    """A break for blank texts, else a prosody element with damped values (see prosody.damped_*), breath
    hints and, if given, a style around it. The numbers come damped; 0 is written +0%."""
    pct = lambda c: F.when(c == 0, "+0%").otherwise(F.concat(signed(c), F.lit("%")))
    clean = breath_hint(xml_escape(without_control(text)))
    spoken = prosody(pct(pitch), pct(rate), pct(volume), clean, "'")
    if style:
        spoken = F.concat(F.lit(f"<mstts:express-as style='{style}' styledegree='{degree}'>"), spoken, F.lit("</mstts:express-as>"))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.concat(F.lit("<break time='"), pause_ms.cast("string"), F.lit("ms'/>"))).otherwise(spoken)


def legacy_speak(content: Column, voice: Column) -> Column:
    """The document, without line feeds and runs of four spaces."""
    doc = F.concat(F.lit(f"<speak version='1.0' xmlns='{SYNTHESIS}' xmlns:mstts='{MSTTS}' xml:lang='fr-FR'><voice name='"), voice, F.lit("'>"), content, F.lit("</voice></speak>"))
    return F.replace(F.replace(doc, F.lit("\n"), F.lit("")), F.lit("    "), F.lit(" "))


def without_namespaces(c: Column) -> Column:
    """No xmlns attributes, no prefixes of tags."""
    return F.regexp_replace(F.regexp_replace(c, r'\s+xmlns(?::\w+)?="[^"]*"', ""), r"(</?)\w+:", "$1")


def attribute_values(c: Column, attribute: str, unit: str = "") -> Column:
    """Array of the numbers of an attribute, wherever it stands."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf'{attribute}="([+-]?[0-9.]+){unit}"'), F.lit(1)), lambda v: v.cast("double"))


def metrics(c: Column) -> Column:
    """Struct of tag counts, adjustments by attribute, break times and tags per sentence. Values that are no numbers are left out."""
    tags = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    pros, brk = tags("<prosody[^>]*>"), tags("<break[^>]*>")
    held = lambda a: F.filter(a, lambda x: x.isNotNull())
    adj = lambda a: held(F.transform(pros, lambda t: F.rtrim(F.regexp_extract(t, rf'{a}="([^"]*)"', 1), F.lit("%")).try_cast("double")))
    total = F.size(tags("<[^/][^>]*>"))
    times = held(F.transform(brk, lambda t: F.regexp_extract(F.rtrim(F.regexp_extract(t, r'time="([^"]*)"', 1), F.lit("ms")), r"^\s*([+-]?\d+)\s*$", 1).try_cast("int")))
    return F.struct(
        total.alias("total_tags"), F.size(pros).alias("prosody_count"), F.size(brk).alias("break_count"),
        adj("pitch").alias("pitch_adjustments"), adj("rate").alias("rate_adjustments"), adj("volume").alias("volume_adjustments"),
        times.alias("break_times"), (total / F.greatest(F.regexp_count(c, F.lit("[.!?]")), F.lit(1))).alias("tags_per_sentence"),
    )


def for_service(c: Column, voice: str) -> Column:
    """X11: no XML declaration, a voice element inside speak, xml:lang in place of lang."""
    c = F.when(F.contains(c, F.lit("<?xml")) & F.contains(c, F.lit("<speak")), F.substring(c, F.instr(c, "<speak"), F.length(c))).otherwise(c)
    c = F.when(~F.contains(c, F.lit("<voice")), F.regexp_replace(c, r"(?s)^(.*?<speak[^>]*>)(.*)(</speak>)", f'$1<voice name="{voice}">$2</voice>$3')).otherwise(c)
    return F.when(~F.contains(c, F.lit('xml:lang="fr-FR"')), F.replace(c, F.lit('lang="fr-FR"'), F.lit('xml:lang="fr-FR"'))).otherwise(c)


def plain_text(c: Column) -> Column:
    """Tags to spaces, single spaces."""
    return squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def simple_document(text: Column, voice: str) -> Column:
    """X13."""
    return F.concat(F.lit(f'{SPEAK}\n<voice name="{voice}">\n'), text, F.lit("\n</voice>\n</speak>"))


def from_params(segments: Column) -> Column:
    """An array of {text, break_before, break_after, prosody} as lines of SSML. Null arrays give an empty document, null segments are skipped."""
    def lines(s: Column) -> Column:
        brk = lambda t: F.when(t.isNotNull() & ~t.isin("", "0ms"), F.array(F.concat(F.lit('<break time="'), t, F.lit('"/>')))).otherwise(F.array().cast("array<string>"))
        p, text = s["prosody"], F.coalesce(xml_escape(s["text"]), F.lit(""))
        pct = lambda f: F.coalesce(p[f], F.lit("0%"))
        spoken = F.when(p.isNotNull(), prosody(pct("pitch"), pct("rate"), pct("volume"), text)).otherwise(text)
        return F.concat(brk(s["break_before"]), F.array(spoken), brk(s["break_after"]))

    held = F.filter(F.coalesce(segments, F.array().cast("array<struct<text:string,break_before:string,break_after:string,prosody:struct<pitch:string,rate:string,volume:string>>>")), lambda s: s.isNotNull())
    return F.array_join(F.concat(F.array(F.lit("<speak>")), F.flatten(F.transform(held, lines)), F.array(F.lit("</speak>"))), "\n")


def ensure_speak(c: Column) -> Column:
    """Wrapped in speak if it doesn't start with it; doubled closings merged."""
    wrapped = F.when(F.startswith(c, F.lit("<speak>")), c).otherwise(F.concat(F.lit("<speak>\n"), c, F.lit("\n</speak>")))
    return F.regexp_replace(wrapped, r"(?s)</?speak>\s*</speak>", "</speak>")


# Layouts of parsed sequences: ARRAY<STRUCT<segment, type, text, time, prosody STRUCT<pitch, rate, volume>>>.


def _held(seq: Column) -> Column:
    return F.filter(seq, lambda e: e.isNotNull())


def _text(e: Column) -> Column:
    return F.coalesce(e["text"], F.lit(""))


def plain_of(seq: Column) -> Column:
    """X19 x: the texts, trimmed, blank ones left out, joined by spaces."""
    texts = F.transform(F.filter(_held(seq), lambda e: e["type"] == "text"), lambda e: F.trim(_text(e)))
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


def with_breaks_of(seq: Column) -> Column:
    """X19 y: the same with <break/> in place."""
    parts = F.transform(F.filter(_held(seq), lambda e: e["type"].isin("text", "break")), lambda e: F.when(e["type"] == "break", "<break/>").otherwise(F.trim(_text(e))))
    return F.array_join(F.filter(parts, lambda t: t != ""), " ")


def pure_of(seq: Column) -> Column:
    """Tags without attributes for the eight known types; other types give their text."""
    wrap = lambda e, t: F.concat(F.lit(f"<{t}>"), _text(e), F.lit(f"</{t}>"))
    def one(e: Column) -> Column:
        c = F.when(e["type"] == "break", "<break/>").when(e["type"] == "audio", "<audio/>")
        for t in ("emphasis", "say-as", "phoneme", "sub", "voice"):
            c = c.when(e["type"] == t, wrap(e, t))
        return c.otherwise(_text(e))

    return F.array_join(F.transform(_held(seq), one), "")


def structure_of(seq: Column) -> Column:
    """Tags with the names of their attributes, without values."""
    def one(e: Column) -> Column:
        p = e["prosody"]
        names = F.array_join(F.filter(F.array(*[F.when(p[k].isNotNull(), k) for k in ("pitch", "rate", "volume")]), lambda x: x.isNotNull()), " ")
        spoken = F.when(p.isNull(), _text(e)).when(names == "", F.concat(F.lit("<prosody>"), _text(e), F.lit("</prosody>"))).otherwise(F.concat(F.lit("<prosody "), names, F.lit(">"), _text(e), F.lit("</prosody>")))
        return F.when(e["type"] == "text", spoken).when(e["type"] == "break", F.when(e["time"].isNotNull(), "<break time/>").otherwise("<break/>")).otherwise(_text(e))

    return F.array_join(F.transform(_held(seq), one), "")


def breaks_of(seq: Column) -> Column:
    """The breaks alone, with their times."""
    tags = F.transform(F.filter(_held(seq), lambda e: e["type"] == "break"), _timed_break)
    return F.array_join(tags, "")


def _timed_break(e: Column) -> Column:
    return F.when(e["time"].isNotNull(), F.concat(F.lit('<break time="'), e["time"], F.lit('"/>'))).otherwise("<break/>")


def break_input_of(seq: Column) -> Column:
    """Texts and <break/> without anything between."""
    parts = F.transform(F.filter(_held(seq), lambda e: e["type"].isin("text", "break")), lambda e: F.when(e["type"] == "break", "<break/>").otherwise(_text(e)))
    return F.array_join(parts, "")


def _lined(seq: Column, spoken, brk) -> Column:
    """One element a line, neighbouring breaks on one line, a blank line between breaks and a prosody."""
    held = _held(seq)
    before = lambda i: F.when(i > 0, F.get(held, i - 1)["type"])

    def one(e: Column, i: Column) -> Column:
        follows_break = before(i) == "break"
        lead = F.when(e["type"] == "break", F.when(F.coalesce(follows_break, F.lit(False)), "").otherwise("\n  "))
        lead = lead.when(e["type"] == "text", F.when(F.coalesce(follows_break, F.lit(False)), "\n\n").otherwise("\n")).otherwise("\n  ")
        body = F.when(e["type"] == "break", brk(e)).when(e["type"] == "text", spoken(e)).otherwise(_text(e))
        return F.when(e["type"].isin("text", "break") | (_text(e) != ""), F.concat(lead, body)).otherwise("")

    lines = F.array_join(F.transform(held, one), "")
    return F.when(lines == "", "").otherwise(F.concat(F.lit(" "), F.substring(lines, F.lit(2), F.length(lines))))


def full_of(seq: Column) -> Column:
    """Prosody elements with values and timed breaks. Attributes that are null are left out."""
    def spoken(e: Column) -> Column:
        p = e["prosody"]
        attrs = F.concat(*[F.when(p[k].isNotNull(), F.concat(F.lit(f' {k}="'), p[k], F.lit('"'))).otherwise("") for k in ("pitch", "rate", "volume")])
        return F.concat(F.lit("  <prosody"), F.coalesce(attrs, F.lit("")), F.lit(">\n    "), _text(e), F.lit("\n  </prosody>"))

    return _lined(seq, spoken, lambda e: F.when(F.coalesce(e["time"], F.lit("")) != "", F.concat(F.lit('<break time="'), e["time"], F.lit('"/>'))).otherwise("<break/>"))


def template_of(seq: Column) -> Column:
    """The same with placeholders for all values."""
    return _lined(seq, lambda e: F.concat(F.lit('  <prosody pitch="_%" rate="_%" volume="_%">\n    '), _text(e), F.lit("\n  </prosody>")), lambda e: F.lit('<break time="_ms"/>'))


def is_empty_prosody(c: Column) -> Column:
    """One prosody element with the placeholders ___; false for null."""
    return F.coalesce(c.rlike(r'^<prosody pitch="___" rate="___" volume="___">.+</prosody>$'), F.lit(False))


#: What is broken into lines of its own, and the attributes that are marked with the class of their span (fixed values).
SHOWN_LINES = ((r"(<[^/][^>]*>)([^<]+)", "$1\n$2\n"), (r"(</[^>]+>)", "\n$1\n"))
SHOWN_VALUES = {"pitch": "pitch", "rate": "rate", "volume": "volume", "time": "break"}


def highlighted(c: Column) -> Column:
    """SSML with its tags on lines of their own and spans around the values of its attributes."""
    for pattern, lines in SHOWN_LINES:
        c = F.regexp_replace(c, pattern, lines)
    for name, shown in SHOWN_VALUES.items():
        c = F.regexp_replace(c, f'({name}="[^"]*")', f'<span class="{shown}">$1</span>')
    return c


def element_values(e: Column) -> Column:
    """Numbers of an element: break time in ms, pitch, rate and volume in percent; null where they don't apply."""
    pct = lambda k: F.when(e["type"] == "text", percent(e["prosody"][k]))
    return F.struct(F.when(e["type"] == "break", milliseconds(e["time"])).alias("break_ms"), pct("pitch").alias("pitch"), pct("rate").alias("rate"), pct("volume").alias("volume"))
