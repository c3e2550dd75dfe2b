"""Queries over whole texts, of any script, against brute force."""

import hashlib
import re
import string
import unicodedata

import pytest

from prosarium.functions import text
from prosarium.plans import reference

TEXTS = [
    "« L’été, où\u00a0: ça… » dit-il ; “Œuvre” d’art, cœur et, [*] puis de. la mer ?", unicodedata.normalize("NFD", "Élève où, déjà et, après. Ça"), "\n\u00a0Un\u202fdeux\u2003trois\x1cquatre\x85cinq. \u00a0\n",
    "静かだ。「東京」、と言った! 東, 京.", "यह हिन्दी, है। क्या?", "سأل: «هل انتهى؟» ثم, ذهب.", "ค่าจาก 2.5 ถึง, 3 วัน!", "STRASSE ß, x² Ⅳ ½ a_b", "ΟΔΟΣ Σ, İstanbul", "fin ß", "fin,", "Quoi ?", "Oui !",
    "e\u0301de, réde, de\u0301, de , que\u00a0, ou\u00a0[*]\u00a0x", "Predestinait xpredestinait prédestinait MAGELLANE appatride\u0301 qu'est-ce qu’est-ce", "", "  ", "\u00a0", "𝄞 a, b; c", "<a> & \"b\"\x00\x07\x7f\x80", "a\tb\r\nc\x0bd", "...", "a.\u00a0. b! \n", "\n  \"x\"\n\n",
]


def brute(t):
    words, no_pause = ("|".join(w) for w in (text.FUNCTION_WORDS, text.NO_PAUSE_AFTER))
    fold = lambda t, a: t.translate(str.maketrans(*a))
    bare = re.sub(r"[^\w\s]", "", t.lower())
    narrow, wide = text.ACCENTS, tuple(a + a.upper() for a in text.ACCENTS_WIDE)
    f2 = fold(t, wide)
    for c in " .!?;:-":
        f2 = f2.replace(c, "")
    f3 = t
    if re.search("[ß?.,;]", t):
        f3 = re.sub("[ß?.,;]", "", t).lower()
    f8 = re.sub(rf"\b({words})\b\s*[,.]+", r"\1", re.sub(r"\s+", " ", t).strip(), flags=re.I)
    f8 = re.sub(rf"\b({words})\b\s*\[\*\]\s*", r"\1", f8, flags=re.I).replace(";", "")
    line = t.strip("\n").replace('"', "'")
    manifest = [w for w in re.sub("[-_]", " ", re.sub(r"[.,;:!?()\[\]{}]", "", line)).split(" ") if w]
    f17 = t[:-1] + ", h" if t.endswith((",", "ß")) else t[:-1] + t[-1] + " h" if t.endswith(("!", "?")) else t
    f18 = t
    for wrong, right in text.SPELLING.items():
        f18 = re.sub(rf"\b{wrong}\b", right, f18, flags=re.I)
    return {
        "f1": fold(bare, narrow), "f2": f2.lower(), "f3": f3, "f4": re.sub(r"\s+", " ", bare).strip(), "f5": bare.strip(), "f6": " ".join(t.translate(str.maketrans("", "", string.punctuation)).lower().split()),
        "f8": f8, "f9": re.sub(rf"\b({no_pause})\b\s*(?:\[\*\]|,)+", r"\1", t, flags=re.I), "f10": re.sub("[,;]", "", t), "f11": re.sub(r"\s+", " ", re.sub(r'[.,!?;:"\\()\-_“”«»]', " ", t)).strip(),
        "f12": " ".join(f"{fold(w.lower(), text.ACCENTS_WIDE)}|{w}" for w in manifest), "f13": line,
        "words": len(t.split()), "sentences": sum(1 for p in re.split(r"[.!?]+", t) if p.strip()), "marks": len(re.findall("[.!?]", t)) or 1,
        "f16": re.sub(r"[\x00-\x1F\x7F]", "", t).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"), "f17": f17, "f18": f18,
    }


@pytest.mark.parametrize("name", ["f1_f6_normal_forms", "f8_f9_f12_cleaning", "f10_f11_f13_marks", "f14_f15_counts", "f16_f17_escapes", "f18_spelling"])
def test_whole_texts_match_brute_force(spark, tmp_path, name):
    docs = [*enumerate(TEXTS), (99, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = reference.QUERIES[name](spark, str(tmp_path))
    got = {r["doc_id"]: {c: r[c] for c in df.columns if c != "doc_id"} for r in df.collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    for k, t in enumerate(TEXTS):
        want = {c: v if isinstance(v, int) else hashlib.md5(v.encode()).hexdigest() for c, v in brute(t).items() if c in df.columns}
        assert (k, got[k]) == (k, want)


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_edit_distance_of_whole_texts(spark, tmp_path):
    pairs = [("L’été à Noël", "L'ete a Noel"), ("été", "t"), ("«\u00a0Oui\u00a0»", "<p>« Oui »</p>"), ("静かだ", "静<break/>か"), ("𝄞a", "a"), ("e\u0301", "é"), ("", "<s>é</s>"), ("abc", "abc"), (None, "x"), ("x", None)]
    data = [(k, a, b) for k, (a, b) in enumerate(pairs)]
    spark.createDataFrame(data, "pred_id long, input_text string, gold_ssml string").write.parquet(f"{tmp_path}/predictions.parquet")
    got = {r["pred_id"]: r["distance"] for r in reference.QUERIES["a4_levenshtein"](spark, str(tmp_path)).collect()}
    assert got == {k: edits(a, re.sub("<[^>]+>", "", b)) for k, a, b in data if a is not None and b is not None} and got[0] == 5 and got[1] == 2
