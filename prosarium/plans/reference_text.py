"""Queries of the text and SSML functions, with their SQL. Texts come from `documents`, `heldout_items`, `bdd_ssml`, `predictions` and `corpus`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prosody, ssml, text
from ..operators import corpus
from .tables import dealt_out, table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts of all documents that have one."""
    d = dealt_out(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", F.col("text").alias("t")).where(F.col("t").isNotNull())


def f1_f6_normal_forms(spark, folder):
    """No SQL here and for F8, F9, F12 and F18, as engines differ in case and in the classes of letters."""
    t = F.col("t")
    cols = {"f1": text.fold_word(t), "f2": text.fold_word_plain(t), "f3": text.alignment_token(t), "f4": text.loose(t), "f5": text.strip_all(text.without_punctuation(t)), "f6": text.without_ascii_punctuation(t)}
    return _docs(spark, folder).select("doc_id", *[F.md5(c).alias(n) for n, c in cols.items()])


def f7_composed(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(text.composed(F.col("text"))).alias("f7"))


def f8_f9_f12_cleaning(spark, folder):
    """F12 drops line ends at both ends first."""
    t = F.col("t")
    manifest = F.transform(text.manifest_words(F.btrim(t, F.lit("\n"))), lambda p: F.concat(p["word"], F.lit("|"), p["original"]))
    cols = {"f8": text.clean_transcript(t), "f9": text.drop_spurious_marks(t), "f12": F.array_join(manifest, " ")}
    return _docs(spark, folder).select("doc_id", *[F.md5(c).alias(n) for n, c in cols.items()])


def f10_f11_f13_marks(spark, folder):
    """F13 drops line ends at both ends first."""
    t = F.col("t")
    cols = {"f10": text.without_commas(t), "f11": text.aligner_text(t), "f13": text.straight_to_apostrophe(F.btrim(t, F.lit("\n")))}
    return _docs(spark, folder).select("doc_id", *[F.md5(c).alias(n) for n, c in cols.items()])


def f14_f15_counts(spark, folder):
    t = F.col("t")
    return _docs(spark, folder).select("doc_id", text.word_count(t).alias("words"), text.sentence_count(t).alias("sentences"), text.mark_count(t).alias("marks"))


def f16_f17_escapes(spark, folder):
    t = F.col("t")
    return _docs(spark, folder).select("doc_id", F.md5(text.xml_escape(text.without_control(t))).alias("f16"), F.md5(text.breath_hint(t)).alias("f17"))


def f18_spelling(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(text.correct_spelling(F.col("t"))).alias("f18"))


def f19_f21_names(spark, folder):
    p = table(spark, folder, "predictions")
    return p.select("pred_id", text.model_label(F.col("model")).alias("label"), text.speaker_of(F.col("voice")).alias("speaker"), text.episode_of(F.col("voice")).alias("episode"))


def f22_f23_prompts(spark, folder):
    p = table(spark, folder, "predictions").where(F.col("input_text").isNotNull())
    made = text.prompt("Add the breaks.", F.col("input_text"))
    return p.select("pred_id", F.md5(made).alias("prompt"), F.md5(text.after_marker(F.concat(made, F.lit(" "), "input_text"))).alias("answer"), F.md5(text.tight_breaks(F.replace(F.col("input_text"), F.lit(","), F.lit(" <break /> ")))).alias("tight"))


def p1_to_p9_predicates(spark, folder):
    """Registered under a name of its own, as pN_ names are the data-preparation queries."""
    c = table(spark, folder, "bdd_syntagme_ssml")
    line = F.concat(F.lit("12: "), F.trim(F.coalesce("syntagme", F.lit(""))), F.format_string(" (%.2f-%.2f, %.2f)", F.col("syn_no") * 1.0, F.col("syn_no") + 1.5, F.lit(1.5)))
    g = lambda i: F.regexp_extract(line, r"(.+?):\s*(.*)\s*\((\d+\.\d+)-(\d+\.\d+),\s*(\d+\.\d+)\)", i)
    pause = ~F.coalesce(F.col("syntagme").rlike("[A-Za-z]"), F.lit(False))
    return c.select(
        "row_id", text.is_blank(F.col("syntagme")).alias("blank"), text.has_word(F.col("syntagme")).alias("word"), text.sortable_number(F.col("segment")).alias("seg_no"),
        g(3).try_cast("double").alias("line_begin"), g(4).try_cast("double").alias("line_end"), F.when(pause, g(5).try_cast("double")).otherwise(0.0).alias("line_pause"),
        F.when(F.contains("syntagme", F.lit("-:  (0-0, 0)")), " (0.01)").otherwise(F.col("syntagme")).alias("filled_gap"),
        F.concat_ws("/", F.lit("base"), F.concat(F.regexp_extract("natural_syntagme_audio_path", r"^(.*)segment", 1), F.lit("all.wav"))).alias("path"),
        F.coalesce(text.sortable_number(F.regexp_extract("natural_syntagme_audio_path", r"segment_ph(\d+)", 1)), text.sortable_number(F.regexp_extract("synthesized_syntagme_audio_path", r"segment_ph(\d+)", 1)), F.lit(-10)).alias("file_no"),
    )


def x2_x4_x12_reading(spark, folder):
    p = table(spark, folder, "predictions").where(F.col("predicted_ssml").isNotNull())
    s = F.col("predicted_ssml")
    m = ssml.metrics(s)
    r = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), 4)
    return p.select(
        "pred_id", F.md5(ssml.without_namespaces(ssml.speak(s, F.lit("v"), silences=True))).alias("bare"), r(ssml.attribute_values(s, "pitch", "%")).alias("pitch_sum"), F.size(ssml.attribute_values(s, "time", "ms")).alias("times"),
        m["total_tags"].alias("total_tags"), m["prosody_count"].alias("prosody_count"), m["break_count"].alias("break_count"), r(m["rate_adjustments"]).alias("rate_sum"), r(m["volume_adjustments"]).alias("volume_sum"),
        F.aggregate(m["break_times"], F.lit(0), lambda x, y: x + y).alias("break_ms"), F.round(m["tags_per_sentence"], 4).alias("tags_per_sentence"), F.md5(ssml.plain_text(s)).alias("plain"),
    )


def _adjusted(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "bdd_syntagme_ssml")
    ok = lambda n, lo, hi: F.coalesce(F.when((F.col(n) > lo) & (F.col(n) < hi), F.col(n)), F.lit(0.0))
    return c.select("row_id", "voice", "segment", "syn_no", F.coalesce("syntagme", F.lit("")).alias("t"), ok("rate_adjustment", -100, 100).alias("rate"), ok("loudness_adjustment", -100, 100).alias("vol"), ok("natural_pitch_syntagme", 0, 1000).alias("pitch"), F.floor(ok("duration_pause_syntagme_natural", 0, 60) * 1000).alias("pause_ms"))


_ADJUSTED = """adj AS (SELECT row_id, voice, segment, syn_no, coalesce(syntagme, '') AS t,
  coalesce(CASE WHEN NOT isnan(rate_adjustment) AND rate_adjustment > -100 AND rate_adjustment < 100 THEN rate_adjustment END, 0.0) AS rate, coalesce(CASE WHEN NOT isnan(loudness_adjustment) AND loudness_adjustment > -100 AND loudness_adjustment < 100 THEN loudness_adjustment END, 0.0) AS vol,
  coalesce(CASE WHEN NOT isnan(natural_pitch_syntagme) AND natural_pitch_syntagme > 0 AND natural_pitch_syntagme < 1000 THEN natural_pitch_syntagme END, 0.0) AS pitch,
  CAST(floor(coalesce(CASE WHEN NOT isnan(duration_pause_syntagme_natural) AND duration_pause_syntagme_natural > 0 AND duration_pause_syntagme_natural < 60 THEN duration_pause_syntagme_natural END, 0.0) * 1000) AS BIGINT) AS pause_ms FROM bdd_syntagme_ssml)"""


def x5_x7_documents(spark, folder):
    """Segment documents (X5, G2) from chunk elements, in order; pauses of 50 ms or more inside, whole after . ? !"""
    a = _adjusted(spark, folder).withColumn("el", ssml.chunk_element(F.col("t"), F.col("pitch"), F.col("rate"), F.col("vol"), F.col("pause_ms"), factor=0.9))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("syn_no", "row_id", "el"))), lambda s: s["el"]), "")
    return a.groupBy("voice", "segment").agg(F.md5(ssml.speak(parts, F.lit("fr-FR-XNeural"), silences=True)).alias("doc"))


def x6_chunk_documents(spark, folder):
    a = _adjusted(spark, folder)
    el = lambda brk: ssml.chunk_element(F.col("t"), F.col("pitch"), F.col("rate"), F.col("vol"), F.col("pause_ms"), with_break=brk)
    return a.select("row_id", F.md5(ssml.speak(el(True), F.lit("v"))).alias("training"), F.md5(ssml.speak(el(False), F.lit("v"), silences=True)).alias("synthesis"))


def x8_damping(spark, folder):
    """Numbers of the legacy fragment: damped rate and pitch, shortened pause."""
    a = table(spark, folder, "bdd_syntagme_ssml")
    return a.select("row_id", F.round(prosody.damped_rate(F.when(F.abs("rate_adjustment") < 100, F.col("rate_adjustment"))), 4).alias("rate"), F.round(prosody.damped_pitch(F.when(F.abs("loudness_adjustment") < 100, F.col("loudness_adjustment"))), 4).alias("pitch"), prosody.short_pause_ms(F.when(F.col("duration_pause_syntagme_natural") < 600, F.col("duration_pause_syntagme_natural"))).alias("pause"))


def x8_x9_legacy_documents(spark, folder):
    a = _adjusted(spark, folder)
    f = ssml.legacy_fragment(F.col("t"), F.round(F.col("pitch") / 100, 0), F.round("rate", 0), F.round("vol", 0), F.greatest(F.lit(1), F.least(F.lit(500), F.col("pause_ms"))))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("syn_no", "row_id", f.alias("f")))), lambda s: s["f"]), " ")
    return a.groupBy("voice", "segment").agg(F.md5(ssml.legacy_speak(parts, F.lit("v"))).alias("doc"))


def x11_x13_service(spark, folder):
    p = table(spark, folder, "bdd_ssml").where(F.col("ssml").isNotNull())
    bare = F.regexp_replace(F.concat(F.lit('<?xml version="1.0"?>'), F.col("ssml")), r"</?voice[^>]*>", "")
    return p.select("row_id", F.md5(ssml.for_service(bare, "V")).alias("served"), F.md5(ssml.for_service(F.replace("ssml", F.lit("xml:lang"), F.lit("lang")), "V")).alias("relang"), F.md5(ssml.simple_document(F.col("syntagme"), "V")).alias("simple"))


def x10_breaks_of_150(spark, folder):
    """Words and breaks of an aligned sequence, breaks below 150 ms left out."""
    a = _adjusted(spark, folder)
    piece = F.when(F.trim("t") != "", text.xml_escape(F.trim("t"))).when(F.col("pause_ms") >= 150, ssml.break_tag(F.col("pause_ms"))).otherwise("")
    parts = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("syn_no", "row_id", piece.alias("p")))), lambda s: s["p"]), lambda x: x != ""), " ")
    return a.groupBy("voice", "segment").agg(F.md5(F.concat(F.lit("<speak>"), parts, F.lit("</speak>"))).alias("doc"))


def x16_x17_from_params(spark, folder):
    p = table(spark, folder, "predictions")
    return p.select("pred_id", F.md5(ssml.from_params(F.col("params.segments"))).alias("built"), F.md5(ssml.ensure_speak(F.col("predicted_ssml"))).alias("wrapped"))


def _seqs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corpus").select("record_id", "voice", corpus.canonical_sequence(F.col("parsed_sequence")).alias("s")).where(F.size("s") > 0)


_SEQS = "seqs AS (SELECT record_id, voice, list_transform(list_filter(parsed_sequence, lambda e: e IS NOT NULL), lambda e: struct_pack(segment := e.segment, type := coalesce(lower(trim(e.type)), ''), text := coalesce(e.text, ''), time := e.time, p := e.prosody)) AS s FROM corpus WHERE len(list_filter(parsed_sequence, lambda e: e IS NOT NULL)) > 0)"


def x19_x23_layouts(spark, folder):
    s = F.col("s")
    cols = {"plain": ssml.plain_of(s), "breaky": ssml.with_breaks_of(s), "pure": ssml.pure_of(s), "structure": ssml.structure_of(s), "breaks": ssml.breaks_of(s), "x": ssml.break_input_of(s)}
    return _seqs(spark, folder).select("record_id", *[F.md5(c).alias(n) for n, c in cols.items()])


def x24_x25_layouts(spark, folder):
    return _seqs(spark, folder).select("record_id", F.md5(ssml.full_of(F.col("s"))).alias("y"), F.md5(ssml.template_of(F.col("s"))).alias("z"))


def x18_element_values(spark, folder):
    e = _seqs(spark, folder).select("record_id", F.posexplode("s").alias("i", "e"))
    return e.select("record_id", "i", ssml.element_values(F.col("e")).alias("v")).select("record_id", "i", "v.*")


def x29_x30_checks(spark, folder):
    s = table(spark, folder, "predictions").where(F.col("predicted_ssml").isNotNull())
    blanked = F.regexp_replace("predicted_ssml", '="[^"]*"', '="___"')
    return s.select("pred_id", ssml.is_empty_prosody(blanked).alias("valid"), F.md5(ssml.highlighted(F.col("predicted_ssml"))).alias("shown"))


def x1_parsed(spark, folder):
    """Elements of every segment's document."""
    p = table(spark, folder, "bdd_ssml").where(F.col("ssml").isNotNull())
    e = p.select("row_id", F.posexplode(corpus.parse_ssml(F.col("ssml"), F.col("segment"))).alias("i", "e"))
    return e.select("row_id", "i", "e.type", "e.text", "e.time", F.col("e.prosody.pitch").alias("pitch"), F.col("e.prosody.rate").alias("rate"))


def x14_respeed(spark, folder):
    return table(spark, folder, "bdd_ssml").where(F.col("ssml").isNotNull()).select("row_id", corpus.respeed_column(F.col("ssml"), "+5%").alias("ssml"))


def x15_parse_answers(spark, folder):
    p = table(spark, folder, "predictions").select("pred_id", corpus.parse_answer(F.col("response")).alias("p"))
    return p.select("pred_id", F.size("p.segments").alias("segments"), F.array_join(F.transform("p.segments", lambda s: F.coalesce(s["text"], F.lit(""))), "|").alias("texts"))


def x26_x27_chunks(spark, folder):
    """Chunks of at most 100 words, after a point where there is one, with their layouts."""
    c = corpus.chunk_rows(_seqs(spark, folder), "record_id", "s", 100)
    return c.select("id", "chunk_no", ssml.plain_of(F.col("chunk")).alias("x"), ssml.with_breaks_of(F.col("chunk")).alias("y"), ssml.full_of(F.col("chunk")).alias("z")).where(F.col("x") != "")


def x28_paragraphs(spark, folder):
    c = corpus.chunk_rows(_seqs(spark, folder), "record_id", "s", 100, backtrack=False)
    return c.select("id", "chunk_no", ssml.plain_of(F.col("chunk")).alias("x"), ssml.pure_of(F.col("chunk")).alias("y"))


def x28_segments(spark, folder):
    """One pair per text element."""
    e = _seqs(spark, folder).select("record_id", F.posexplode("s").alias("i", "e")).where("e.type = 'text' AND e.text <> ''")
    return e.select("record_id", "i", F.col("e.text").alias("x"), ssml.pure_of(F.array("e")).alias("y"))


def i22_segment_samples(spark, folder):
    s = corpus.segment_samples(_seqs(spark, folder), "record_id", "s")
    return s.select("record_id", "segment", F.md5("text").alias("text"), F.size("elements").alias("elements"))


def i23_params(spark, folder):
    """No SQL: a state machine over elements."""
    s = _seqs(spark, folder).select("record_id", corpus.sequence_to_params(F.col("s")).alias("p"))
    return s.select("record_id", F.to_json("p").alias("params"))


def i24_prediction_sequence(spark, folder):
    p = table(spark, folder, "predictions").where(F.col("params.segments").isNotNull())
    e = p.select("pred_id", F.posexplode(corpus.params_to_sequence(F.col("params.segments"))).alias("i", "e"))
    return e.select("pred_id", "i", "e.type", "e.text", "e.time")


def g24_merged_maps(spark, folder):
    c = table(spark, folder, "corpus").select("voice", F.col("record_id").alias("ord"), "raw_ssml").where(F.col("voice").isNotNull())
    m = corpus.merge_by_segment(c, ["voice"], "raw_ssml")
    return m.select("voice", F.explode("raw_ssml").alias("segment", "strings")).select("voice", "segment", F.size("strings").alias("n"), F.md5(F.array_join("strings", "\n")).alias("joined"))


def p10_p11_filters(spark, folder):
    """Types and texts are trimmed and words counted as in the SQL; the reference's split() would part words at no-break spaces, too."""
    trimmed = lambda e: F.struct(text.trim_spaces(e["type"]).alias("type"), text.trim_spaces(e["text"]).alias("text"))
    s = _seqs(spark, folder).select("record_id", F.transform("s", trimmed).alias("s"))
    s = s.select("record_id", ssml.plain_of(F.col("s")).alias("x"), ssml.with_breaks_of(F.col("s")).alias("y"), F.exists("s", lambda e: F.coalesce(e["type"] == "break", F.lit(False))).alias("has_break"))
    w = (text.ascii_word_count(F.col("x")) + text.ascii_word_count(F.col("y"))) * 1.3
    return s.select("record_id", (w < 200 * 0.8).alias("short"), "has_break")


QUERIES = {
    f.__name__: f
    for f in (
        f1_f6_normal_forms, f7_composed, f8_f9_f12_cleaning, f10_f11_f13_marks, f14_f15_counts, f16_f17_escapes, f18_spelling, f19_f21_names, f22_f23_prompts, x1_parsed, x2_x4_x12_reading, x5_x7_documents, x6_chunk_documents, x8_damping,
        x8_x9_legacy_documents, x10_breaks_of_150, x11_x13_service, x14_respeed, x15_parse_answers, x16_x17_from_params, x18_element_values, x19_x23_layouts, x24_x25_layouts, x26_x27_chunks, x28_paragraphs,
        x28_segments, x29_x30_checks, i22_segment_samples, i23_params, i24_prediction_sequence, g24_merged_maps,
    )
} | {"s_p1_p9_predicates": p1_to_p9_predicates, "s_p10_p11_filters": p10_p11_filters}

_G = lambda x, p, r="": f"regexp_replace({x}, '{p}', '{r}', 'g')"
_PUNCT = r"[^\p{L}\p{N}_\s]"
_SQ = lambda x: f"trim({_G(x, r'[ \t\n\x0B\f\r]+', ' ')})"
_FW = "|".join(text.FUNCTION_WORDS)
_NP = "|".join(text.NO_PAUSE_AFTER)
#: Word borders that know accented letters: the letter before is captured and put back.
_AFTER = lambda x, words, tail: _G(x, rf"(?i)(^|[^\p{{L}}\p{{N}}_])({words}){tail}", r"\1\2")
_ESC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_PCT = lambda x: f"printf('%+.2f', {x}) || '%'"
_EL = lambda brk, factor="1.0": f"""'<prosody pitch="' || {_PCT("pitch")} || '" rate="' || {_PCT("rate")} || '" volume="' || {_PCT("vol")} || '">' || {_ESC("t")} || """ + (f"""CASE WHEN pause_ms >= 50 THEN '<break time="' || CAST(CASE WHEN regexp_matches(t, '[.?!]$') THEN pause_ms ELSE floor(pause_ms * {factor}) END AS BIGINT) || 'ms"/>' ELSE '' END || """ if brk else "") + "'</prosody>'"
_SPEAK = lambda inner, voice, sil: f"""'{ssml.SPEAK_MSTTS if sil else ssml.SPEAK}<voice name="{voice}">{ssml.LEADING if sil else ""}' || {inner} || '{ssml.TRAILING if sil else ""}</voice></speak>'"""
_NUMS = lambda x, a, u: f"""list_transform(regexp_extract_all({x}, '{a}="([+-]?[0-9.]+){u}"', 1), lambda v: CAST(v AS DOUBLE))"""
_ADJ = lambda a: f"""list_filter(list_transform(regexp_extract_all(s, '<prosody[^>]*>'), lambda t: TRY_CAST(rtrim(regexp_extract(t, '{a}="([^"]*)"', 1), '%') AS DOUBLE)), lambda v: v IS NOT NULL)"""
_SUM = lambda x: f"round(coalesce(list_sum({x}), 0.0), 4)"
_TEXTS = "list_filter(list_transform(list_filter(s, lambda e: e.type = 'text'), lambda e: trim(e.text)), lambda t: t <> '')"
_BREAKY = "list_filter(list_transform(list_filter(s, lambda e: e.type IN ('text', 'break')), lambda e: CASE WHEN e.type = 'break' THEN '<break/>' ELSE trim(e.text) END), lambda t: t <> '')"
_J = lambda x, sep="": f"coalesce(array_to_string({x}, '{sep}'), '')"
_PURE = "CASE WHEN e.type = 'break' THEN '<break/>' WHEN e.type = 'audio' THEN '<audio/>' WHEN e.type IN ('emphasis', 'say-as', 'phoneme', 'sub', 'voice') THEN '<' || e.type || '>' || e.text || '</' || e.type || '>' ELSE e.text END"
_ATTRS = lambda f: "||".join(f"CASE WHEN e.p.{k} IS NOT NULL THEN {f(k)} ELSE '' END" for k in ("pitch", "rate", "volume"))
_LINED = lambda spoken, brk: f"""list_transform(range(1, len(s) + 1), lambda i: CASE WHEN s[i].type IN ('text', 'break') OR s[i].text <> '' THEN
    CASE WHEN s[i].type = 'break' THEN CASE WHEN i > 1 AND s[i - 1].type = 'break' THEN '' ELSE chr(10) || '  ' END WHEN s[i].type = 'text' THEN CASE WHEN i > 1 AND s[i - 1].type = 'break' THEN chr(10) || chr(10) ELSE chr(10) END ELSE chr(10) || '  ' END
    || CASE WHEN s[i].type = 'break' THEN {brk} WHEN s[i].type = 'text' THEN {spoken} ELSE s[i].text END ELSE '' END)"""  # noqa: E731
_WHOLE = lambda lines: f"md5(CASE WHEN {_J(lines)} = '' THEN '' ELSE ' ' || substr({_J(lines)}, 2) END)"

_DOCS = "docs AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL)"
#: White space of any kind, as str.split() has it.
_WIDE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_SHOWN = f"""regexp_replace(regexp_replace(predicted_ssml, '(<[^/][^>]*>)([^<]+)', '\\1' || chr(10) || '\\2' || chr(10), 'g'), '(</[^>]+>)', chr(10) || '\\1' || chr(10), 'g')"""
for _name, _class in (("pitch", "pitch"), ("rate", "rate"), ("volume", "volume"), ("time", "break")):
    _SHOWN = f"""regexp_replace({_SHOWN}, '({_name}="[^"]*")', '<span class="{_class}">\\1</span>', 'g')"""

SQL = {
    "f7_composed": f"SELECT doc_id, md5({_SQ('lower(nfc_normalize(text))')}) AS f7 FROM documents",
    "f10_f11_f13_marks": f"""WITH {_DOCS} SELECT doc_id, md5(translate(t, ',;', '')) AS f10,
        md5(trim({_G(_G("t", "[.,!?;:" + chr(34) + r"\\()\-_“”«»]", " "), f"{_WIDE}+", " ")})) AS f11, md5(translate(trim(t, chr(10)), '"', '''')) AS f13 FROM docs""",
    "f14_f15_counts": f"""WITH {_DOCS} SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(t, '{_WIDE}+'), lambda w: w <> '')) AS INTEGER) AS words,
        CAST(len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda p: regexp_replace(p, '{_WIDE}+', '', 'g') <> '')) AS INTEGER) AS sentences,
        CAST(greatest(len(regexp_extract_all(t, '[.!?]')), 1) AS INTEGER) AS marks FROM docs""",
    "f16_f17_escapes": rf"""WITH {_DOCS} SELECT doc_id, md5({_ESC(_G("t", r"[\x00-\x1F\x7F]"))}) AS f16,
        md5(CASE WHEN t LIKE '%,' OR t LIKE '%ß' THEN left(t, -1) || ', h' WHEN t LIKE '%!' THEN left(t, -1) || '! h' WHEN t LIKE '%?' THEN left(t, -1) || '? h' ELSE t END) AS f17 FROM docs""",
    "f19_f21_names": r"""SELECT pred_id, upper(model[1:1]) || lower(model[2:]) AS label,
        CASE WHEN regexp_matches(voice, '^.+_EP[0-9]+$') THEN regexp_extract(voice, '^(.+)_EP[0-9]+$', 1) ELSE split_part(voice, '_', 1) END AS speaker, regexp_extract(voice, '_(EP[0-9]+)$', 1) AS episode FROM predictions""",
    "f22_f23_prompts": f"""SELECT pred_id, md5('Add the breaks.' || chr(10) || chr(10) || '### Input:' || chr(10) || input_text || chr(10) || chr(10) || '### Response:' || chr(10)) AS prompt,
        md5(trim(chr(10) || ' ' || input_text, ' ')) AS answer, md5(trim({_G("replace(input_text, ',', ' <break /> ')", r"[ \t\n\x0B\f\r]*<break[ \t\n\x0B\f\r]*/>[ \t\n\x0B\f\r]*", "<break/>")}, ' ')) AS tight FROM predictions WHERE input_text IS NOT NULL""",
    "s_p1_p9_predicates": r"""SELECT row_id, trim(coalesce(syntagme, '')) = '' AS blank, coalesce(regexp_matches(syntagme, '[\p{L}\p{N}_]'), false) AS word, CAST(regexp_extract(segment, '([0-9]+)$', 1) AS BIGINT) AS seg_no,
        CAST(syn_no AS DOUBLE) AS line_begin, syn_no + 1.5::DOUBLE AS line_end, CASE WHEN NOT coalesce(regexp_matches(syntagme, '[A-Za-z]'), false) THEN 1.5 ELSE 0.0 END::DOUBLE AS line_pause, CASE WHEN contains(syntagme, '-:  (0-0, 0)') THEN ' (0.01)' ELSE syntagme END AS filled_gap,
        concat_ws('/', 'base', regexp_extract(natural_syntagme_audio_path, '^(.*)segment', 1) || 'all.wav') AS path,
        coalesce(TRY_CAST(regexp_extract(natural_syntagme_audio_path, 'segment_ph([0-9]+)', 1) AS BIGINT), TRY_CAST(regexp_extract(synthesized_syntagme_audio_path, 'segment_ph([0-9]+)', 1) AS BIGINT), -10) AS file_no FROM bdd_syntagme_ssml""",
    "s_p10_p11_filters": f"""WITH {_SEQS}, w AS (SELECT record_id, s, {_J(_TEXTS, " ")} AS x, {_J(_BREAKY, " ")} AS y FROM seqs)
        SELECT record_id, (CASE WHEN trim(x) = '' THEN 0 ELSE len(string_split({_SQ("x")}, ' ')) END + CASE WHEN trim(y) = '' THEN 0 ELSE len(string_split({_SQ("y")}, ' ')) END) * 1.3 < 160 AS short, len(list_filter(s, lambda e: e.type = 'break')) > 0 AS has_break FROM w""",
    "x2_x4_x12_reading": f"""WITH p AS (SELECT pred_id, predicted_ssml AS s FROM predictions WHERE predicted_ssml IS NOT NULL), m AS (SELECT *, len(regexp_extract_all(s, '<[^/][^>]*>')) AS tags,
          list_filter(list_transform(regexp_extract_all(s, '<break[^>]*>'), lambda t: TRY_CAST(nullif(regexp_extract(rtrim(regexp_extract(t, 'time="([^"]*)"', 1), 'ms'), '^[ ]*([+-]?[0-9]+)[ ]*$', 1), '') AS INTEGER)), lambda v: v IS NOT NULL) AS bt FROM p)
        SELECT pred_id, md5({_G(_G(_SPEAK("s", "v", True), r'[ \t\n\x0B\f\r]+xmlns(?::[A-Za-z0-9_]+)?="[^"]*"'), "(</?)[A-Za-z0-9_]+:", chr(92) + "1")}) AS bare, {_SUM(_NUMS("s", "pitch", "%"))} AS pitch_sum, CAST(len({_NUMS("s", "time", "ms")}) AS INTEGER) AS times,
        CAST(tags AS INTEGER) AS total_tags, CAST(len(regexp_extract_all(s, '<prosody[^>]*>')) AS INTEGER) AS prosody_count, CAST(len(regexp_extract_all(s, '<break[^>]*>')) AS INTEGER) AS break_count, {_SUM(_ADJ("rate"))} AS rate_sum, {_SUM(_ADJ("volume"))} AS volume_sum,
        CAST(coalesce(list_sum(bt), 0) AS INTEGER) AS break_ms, round(tags / greatest(len(regexp_extract_all(s, '[.!?]')), 1), 4) AS tags_per_sentence, md5({_SQ(_G("s", "<[^>]+>", " "))}) AS plain FROM m""",
    "x5_x7_documents": f"""WITH {_ADJUSTED} SELECT voice, segment, md5({_SPEAK(f"string_agg({_EL(True, '0.9')}, '' ORDER BY syn_no, row_id)", "fr-FR-XNeural", True)}) AS doc FROM adj GROUP BY voice, segment""",
    "x6_chunk_documents": f"""WITH {_ADJUSTED} SELECT row_id, md5({_SPEAK(_EL(True), "v", False)}) AS training, md5({_SPEAK(_EL(False), "v", True)}) AS synthesis FROM adj""",
    "x8_damping": """WITH a AS (SELECT row_id, coalesce(CASE WHEN NOT isnan(rate_adjustment) AND abs(rate_adjustment) < 100 THEN rate_adjustment END, 0) AS r, coalesce(CASE WHEN NOT isnan(loudness_adjustment) AND abs(loudness_adjustment) < 100 THEN loudness_adjustment END, 0) AS v,
          CASE WHEN NOT isnan(duration_pause_syntagme_natural) AND duration_pause_syntagme_natural < 600 THEN duration_pause_syntagme_natural END AS d FROM bdd_syntagme_ssml)
        SELECT row_id, round(least(sign(r) * pow(abs(r), 0.8), 2), 4) AS rate, round(sign(v) * sqrt(abs(v)), 4) AS pitch, CAST(CASE WHEN d IS NULL OR d = 0 THEN 500 ELSE floor(least(greatest(d * 1000 / 3, 1), 500)) END AS INTEGER) AS pause FROM a""",
    "x8_x9_legacy_documents": f"""WITH {_ADJUSTED}, n AS (SELECT *, round(pitch / 100, 0) AS p0, round(rate, 0) AS r0, round(vol, 0) AS v0, {_ESC(_G("t", r"[\x00-\x1F\x7F]"))} AS c FROM adj),
        f AS (SELECT *, CASE WHEN trim(t) = '' THEN '<break time=''' || greatest(1, least(500, pause_ms)) || 'ms''/>' ELSE '<prosody pitch=''' || {"||".join(f"CASE WHEN {n} = 0 THEN '+0%' ELSE {_PCT(n)} END || {q}" for n, q in (("p0", "''' rate='''"), ("r0", "''' volume='''"), ("v0", "'''>'")))} ||
          CASE WHEN c LIKE '%,' OR c LIKE '%ß' THEN left(c, -1) || ', h' WHEN c LIKE '%!' THEN left(c, -1) || '! h' WHEN c LIKE '%?' THEN left(c, -1) || '? h' ELSE c END || '</prosody>' END AS f FROM n)
        SELECT voice, segment, md5(replace(replace('<speak version=''1.0'' xmlns=''{ssml.SYNTHESIS}'' xmlns:mstts=''{ssml.MSTTS}'' xml:lang=''fr-FR''><voice name=''v''>' || string_agg(f, ' ' ORDER BY syn_no, row_id) || '</voice></speak>', chr(10), ''), '    ', ' ')) AS doc FROM f GROUP BY voice, segment""",
    "x10_breaks_of_150": f"""WITH {_ADJUSTED} SELECT voice, segment, md5('<speak>' || coalesce(string_agg(CASE WHEN trim(t) <> '' THEN {_ESC("trim(t)")} ELSE '<break time="' || pause_ms || 'ms"/>' END, ' ' ORDER BY syn_no, row_id) FILTER (trim(t) <> '' OR pause_ms >= 150), '') || '</speak>') AS doc FROM adj GROUP BY voice, segment""",
    "x11_x13_service": f"""WITH b AS (SELECT row_id, ssml, syntagme, {_G("ssml", "</?voice[^>]*>")} AS bare FROM bdd_ssml WHERE ssml IS NOT NULL)
        SELECT row_id, md5(regexp_replace(bare, '(?s)^(.*?<speak[^>]*>)(.*)(</speak>)', '\\1<voice name="V">\\2</voice>\\3')) AS served, md5(ssml) AS relang, md5('{ssml.SPEAK}' || chr(10) || '<voice name="V">' || chr(10) || syntagme || chr(10) || '</voice>' || chr(10) || '</speak>') AS simple FROM b""".replace("\\\\", "\\"),
    "x16_x17_from_params": f"""WITH s AS (SELECT pred_id, predicted_ssml, list_transform(list_filter(coalesce(params.segments, []), lambda s: s IS NOT NULL), lambda s:
          CASE WHEN coalesce(s.break_before, '') NOT IN ('', '0ms') THEN '<break time="' || s.break_before || '"/>' || chr(10) ELSE '' END ||
          CASE WHEN s.prosody IS NOT NULL THEN '<prosody pitch="' || coalesce(s.prosody.pitch, '0%') || '" rate="' || coalesce(s.prosody.rate, '0%') || '" volume="' || coalesce(s.prosody.volume, '0%') || '">' || {_ESC("coalesce(s.text, '')")} || '</prosody>' ELSE {_ESC("coalesce(s.text, '')")} END ||
          CASE WHEN coalesce(s.break_after, '') NOT IN ('', '0ms') THEN chr(10) || '<break time="' || s.break_after || '"/>' ELSE '' END) AS l FROM predictions)
        SELECT pred_id, md5('<speak>' || chr(10) || CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) || chr(10) ELSE '' END || '</speak>') AS built,
        md5(regexp_replace(CASE WHEN starts_with(predicted_ssml, '<speak>') THEN predicted_ssml ELSE '<speak>' || chr(10) || predicted_ssml || chr(10) || '</speak>' END, '</?speak>\\s*</speak>', '</speak>', 'g')) AS wrapped FROM s""".replace("\\\\", "\\"),
    "x19_x23_layouts": f"""WITH {_SEQS} SELECT record_id, md5({_J(_TEXTS, " ")}) AS plain, md5({_J(_BREAKY, " ")}) AS breaky, md5({_J(f"list_transform(s, lambda e: {_PURE})")}) AS pure,
        md5({_J("list_transform(s, lambda e: CASE WHEN e.type = 'text' THEN CASE WHEN e.p IS NULL THEN e.text ELSE '<prosody' || " + _ATTRS(lambda k: f"' {k}'") + " || '>' || e.text || '</prosody>' END WHEN e.type = 'break' THEN CASE WHEN e.time IS NOT NULL THEN '<break time/>' ELSE '<break/>' END ELSE e.text END)")}) AS structure,
        md5({_J("list_transform(list_filter(s, lambda e: e.type = 'break'), lambda e: CASE WHEN e.time IS NOT NULL THEN '<break time=" + chr(34) + "' || e.time || '" + chr(34) + "/>' ELSE '<break/>' END)")}) AS breaks,
        md5({_J("list_transform(list_filter(s, lambda e: e.type IN ('text', 'break')), lambda e: CASE WHEN e.type = 'break' THEN '<break/>' ELSE e.text END)")}) AS x FROM seqs""",
    "x24_x25_layouts": f"""WITH {_SEQS} SELECT record_id, {_WHOLE(_LINED("'  <prosody' || " + _ATTRS(lambda k: f"' {k}=" + chr(34) + f"' || e.p.{k} || '" + chr(34) + "'").replace("e.p.", "s[i].p.") + " || '>' || chr(10) || '    ' || s[i].text || chr(10) || '  </prosody>'", "CASE WHEN coalesce(s[i].time, '') <> '' THEN '<break time=" + chr(34) + "' || s[i].time || '" + chr(34) + "/>' ELSE '<break/>' END"))} AS y,
        {_WHOLE(_LINED("'  <prosody pitch=" + chr(34) + "_%" + chr(34) + " rate=" + chr(34) + "_%" + chr(34) + " volume=" + chr(34) + "_%" + chr(34) + ">' || chr(10) || '    ' || s[i].text || chr(10) || '  </prosody>'", "'<break time=" + chr(34) + "_ms" + chr(34) + "/>'"))} AS z FROM seqs""",
    "x18_element_values": f"""WITH {_SEQS}, e AS (SELECT record_id, CAST(i - 1 AS INTEGER) AS i, s[i] AS e FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM seqs))
        SELECT record_id, i, CASE WHEN e.type = 'break' THEN TRY_CAST(nullif(regexp_extract(trim(e.time), '^([0-9]+)[ ]*(?:ms)?$', 1), '') AS INTEGER) END AS break_ms, {", ".join(f"CASE WHEN e.type = 'text' THEN TRY_CAST(regexp_replace(trim(e.p.{k}), '[ ]*%$', '') AS DOUBLE) END AS {k}" for k in ("pitch", "rate", "volume"))} FROM e""",
    "x29_x30_checks": f"""SELECT pred_id, regexp_matches({_G("predicted_ssml", '="[^"]*"', '="___"')}, '^<prosody pitch="___" rate="___" volume="___">.+</prosody>$') AS valid,
        md5({_SHOWN}) AS shown FROM predictions WHERE predicted_ssml IS NOT NULL""",
    "x1_parsed": r"""WITH t AS (SELECT row_id, regexp_extract_all(ssml, '<prosody[^>]*>|</prosody>|<break[^>]*/?>|<[^>]+>|[^<]+') AS t FROM bdd_ssml WHERE ssml IS NOT NULL), u AS (SELECT row_id, k, t[k] AS x FROM (SELECT *, unnest(range(1, len(t) + 1)) AS k FROM t)),
        o AS (SELECT *, last_value(CASE WHEN starts_with(x, '<prosody') OR x = '</prosody>' THEN x END IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS tag FROM u),
        e AS (SELECT *, starts_with(x, '<break') AS b FROM o WHERE starts_with(x, '<break') OR (NOT starts_with(x, '<') AND starts_with(tag, '<prosody') AND trim(x) <> ''))
        SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY k) - 1 AS INTEGER) AS i, CASE WHEN b THEN 'break' ELSE 'text' END AS type, CASE WHEN NOT b THEN trim(x) END AS text, CASE WHEN b THEN regexp_extract(x, 'time="([^"]*)"', 1) END AS time,
          CASE WHEN NOT b THEN regexp_extract(tag, 'pitch="([^"]*)"', 1) END AS pitch, CASE WHEN NOT b THEN regexp_extract(tag, 'rate="([^"]*)"', 1) END AS rate FROM e""",
    "x28_segments": f"""WITH {_SEQS}, e AS (SELECT record_id, CAST(i - 1 AS INTEGER) AS i, s[i] AS e FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM seqs)) SELECT record_id, i, e.text AS x, e.text AS y FROM e WHERE e.type = 'text' AND e.text <> ''""",
    "i22_segment_samples": f"""WITH {_SEQS}, e AS (SELECT record_id, i, s[i] AS e FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM seqs))
        SELECT record_id, segment, md5(t) AS text, n AS elements FROM (SELECT record_id, e.segment AS segment, string_agg(trim(e.text), ' ' ORDER BY i) FILTER (e.type = 'text' AND trim(e.text) <> '') AS t, CAST(count(*) AS INTEGER) AS n FROM e GROUP BY record_id, e.segment) WHERE t <> ''""",
    "i24_prediction_sequence": """WITH s AS (SELECT pred_id, list_filter(params.segments, lambda x: x IS NOT NULL) AS l FROM predictions WHERE params.segments IS NOT NULL), e AS (SELECT pred_id, k, l[k] AS e FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM s)),
        r AS (SELECT pred_id, k, 0 AS o, 'break' AS type, NULL AS text, e.break_before AS time FROM e WHERE e.break_before <> '0ms' UNION ALL SELECT pred_id, k, 1, 'text', e.text, NULL FROM e UNION ALL SELECT pred_id, k, 2, 'break', NULL, e.break_after FROM e WHERE e.break_after <> '0ms')
        SELECT pred_id, CAST(row_number() OVER (PARTITION BY pred_id ORDER BY k, o) - 1 AS INTEGER) AS i, type, text, time FROM r""",
    "g24_merged_maps": """WITH m AS (SELECT voice, record_id, unnest(map_entries(raw_ssml)) AS e FROM corpus WHERE voice IS NOT NULL AND raw_ssml IS NOT NULL), l AS (SELECT voice, record_id, e.key AS segment, coalesce(e.value, []) AS v FROM m),
        a AS (SELECT voice, segment, flatten(list(v ORDER BY record_id)) AS v FROM l GROUP BY voice, segment) SELECT voice, segment, CAST(len(v) AS INTEGER) AS n, md5(coalesce(array_to_string(v, chr(10)), '')) AS joined FROM a""",
}
