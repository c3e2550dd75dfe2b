"""Providers of what needs a model, a codec or a service: interfaces and fixed stand-ins.

Recognition, synthesis, source separation, forced alignment, tagging, pitch and loudness extraction and
language models are not part of this engine. A provider turns a batch of inputs into outputs; `provided` runs it by
Arrow batches with a few threads for waiting on services. The stand-ins give the same output for the same input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import NO_PAUSE_AFTER


class TextProvider(Protocol):
    """Text to text: phonemes, language models, tagging."""

    def __call__(self, text: str) -> str: ...


class AudioProvider(Protocol):
    """Samples to a number: median pitch, loudness."""

    def __call__(self, samples: np.ndarray, rate: int) -> float: ...


def provided(provider: TextProvider, c: Column, threads: int = 4) -> Column:
    """A text provider on a column; null stays null, an error gives null."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else provider(x)
        except Exception:  # noqa: BLE001 - one failing request must not end the job
            return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(threads) as pool:
            for s in batches:
                yield pd.Series(list(pool.map(one, s)), dtype=object)

    return F.pandas_udf(run, "string")(c)


def stub_phones(word: str) -> str:
    """letters as phones."""
    return " ".join(re.sub(r"[^\w]", "", word.lower()))


def stub_tagger(word: str) -> str:
    """Closed-class list in place of a tagger: FUNC or OPEN."""
    return "FUNC" if word.lower() in NO_PAUSE_AFTER else "OPEN"


def stub_speech(text: str, rate: int = 8000) -> np.ndarray:
    """Samples of a tone per word, the pitch taken from a hash of the word."""
    out = []
    for w in text.split():
        f = 100 + int(hashlib.sha256(w.encode()).hexdigest()[:4], 16) % 150
        out.append(np.sin(2 * np.pi * f * np.arange(rate // 10 * max(1, len(w) // 3)) / rate))
    return np.concatenate(out) if out else np.zeros(0)


def stub_pitch(samples: np.ndarray, rate: int) -> float:
    """Autocorrelation pitch between 75 and 400 Hz, 0 if unvoiced."""
    x = samples - samples.mean() if len(samples) else samples
    if len(x) < rate // 50 or not np.any(x):
        return 0.0
    x = x[: rate // 2]
    corr = np.correlate(x, x, "full")[len(x) - 1 :]
    lo, hi = rate // 400, min(rate // 75, len(corr) - 1)
    k = lo + int(np.argmax(corr[lo : hi + 1]))
    return rate / k if corr[k] > 0.3 * corr[0] else 0.0


def stub_loudness(samples: np.ndarray, rate: int) -> float:
    """Root-mean-square level in dB after peak normalisation, in place of gated loudness."""
    peak = np.max(np.abs(samples)) if len(samples) else 0.0
    return float(20 * np.log10(max(np.sqrt(np.mean((samples / peak) ** 2)), 1e-6))) if peak > 0 else -120.0
