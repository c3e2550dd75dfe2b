"""Sentence boundaries take time in proportion to the text, whatever is opened and never closed."""

import time

import pytest

from prosarium.llm.sentences import sentence_ends


@pytest.mark.parametrize("part", ["a.", "你好。", "1.", " . -", "“”\" ", "\n1. x", "<a ", "è.", "(a. "])
def test_linear_time(part):
    def took(n):
        best = 1e9
        for _ in range(2):
            began = time.process_time()
            sentence_ends(part * n)
            best = min(best, time.process_time() - began)
        return best

    took(100)
    assert took(40_000) < 16 * took(10_000) + 0.5  # 4 if linear, 16 if quadratic


def test_unmatched_marks():
    began = time.process_time()
    text = "(" * 500_000 + "]" * 500_000
    assert sentence_ends(text) == [] or sentence_ends(text) == [len(text)]
    assert time.process_time() - began < 60


def test_sentences_of_a_quotation_in_a_list_item():
    text = "(2) «A uno.\n3. B dos».\n(4) C."
    assert [text[: e][-4:] for e in sentence_ends(text)] == ["uno.", "os».", ") C."]
    # Words outside of the quotation: the sentence goes on.
    assert len(sentence_ends("Dijo «A uno. B dos».")) == 1


def test_no_fixed_windows():
    wide = " " * 200
    assert sentence_ends(f"Am{wide}3. Mai ist es gut.") == [len(f"Am{wide}3. Mai ist es gut.")]
    indented = "Eins.\n" + " " * 200 + "2. Zwei kommt."
    assert sentence_ends(indented) == [5, len(indented)]
    signs = "Une note. " + "– • ★ ☆ ✓ ✗ † ‡ § " + "et la suite."
    assert sentence_ends(signs) == [len(signs)]
