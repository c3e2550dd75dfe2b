"""S18 and the parts of the audio functions that need no model: PCM WAV to samples, slices, energy islands, spectra."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectorised import vectorised


def decode_wav(content: bytes | None) -> dict | None:
    """Samples in [-1, 1] (mono, channels averaged), rate and seconds of PCM WAV bytes; None for what can't be decoded."""
    try:
        with wave.open(io.BytesIO(content or b"")) as w:
            width, channels, rate, frames = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if width == 1:
        x = (np.frombuffer(frames, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(frames, "<i2" if width == 2 else "<i4").astype(np.float32) / float(1 << (8 * width - 1))
    else:
        return None
    mono = x.reshape(-1, channels).mean(axis=1)
    return {"rate": rate, "seconds": len(mono) / rate, "samples": mono.tolist()}


@vectorised("struct<rate:int,seconds:double,samples:array<float>>")
def wav_samples(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        rows = [decode_wav(b) or {"rate": None, "seconds": None, "samples": None} for b in s]
        yield pd.DataFrame({"rate": pd.array([r["rate"] for r in rows], dtype="Int32"), "seconds": [r["seconds"] for r in rows], "samples": [r["samples"] for r in rows]})


def read_wavs(spark: SparkSession, folder: str) -> DataFrame:
    """Path, rate, seconds, samples of all *.wav; files that can't be decoded are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(folder)
    return files.select("path", wav_samples("content").alias("a")).where(F.col("a.rate").isNotNull()).select("path", "a.*")


def slice_samples(samples: Column, rate: Column, begin_s: Column, end_s: Column) -> Column:
    """The samples between two times, inside the JVM."""
    at = F.greatest(F.floor(begin_s * rate), F.lit(0)).cast("int")
    return F.slice(samples, at + 1, F.greatest(F.floor(end_s * rate).cast("int") - at, F.lit(0)))


def silent_islands(x: np.ndarray, rate: int, least_ms: int = 1000, dbfs: float = -50.0, keep_ms: int = 300, frame_ms: int = 10) -> list[tuple[float, float]]:
    """(begin, end) in seconds of the stretches between silences of at least `least_ms` below `dbfs`, with `keep_ms` of silence kept at both sides."""
    step = max(1, rate * frame_ms // 1000)
    n = len(x) // step
    if n == 0:
        return []
    level = 20 * np.log10(np.maximum(np.sqrt(np.mean(x[: n * step].reshape(n, step) ** 2, axis=1)), 1e-9))
    quiet = level < dbfs
    starts = np.flatnonzero(np.r_[True, quiet[1:] != quiet[:-1]])
    ends = np.r_[starts[1:], n]
    cuts = [(a, b) for a, b in zip(starts, ends) if quiet[a] and (b - a) * frame_ms >= least_ms]
    borders = [0, *[k for c in cuts for k in c], n]
    keep = keep_ms // frame_ms
    return [(max(0, a - keep) * frame_ms / 1000, min(n, b + keep) * frame_ms / 1000) for a, b in zip(borders[::2], borders[1::2]) if b > a]


@vectorised("array<struct<begin:double,end:double>>")
def _islands(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for x, r in batches:
        yield pd.Series([None if a is None else [{"begin": b, "end": e} for b, e in silent_islands(np.asarray(a, float), int(k))] for a, k in zip(x, r)])


def silence_split(df: DataFrame, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """df's other columns, segment ('segment_ph1' on), begin, end."""
    keep = [c for c in df.columns if c not in (samples, rate)]
    rows = df.withColumn("__s", _islands(samples, rate)).select(*keep, F.posexplode("__s").alias("i", "s"))
    return rows.select(*keep, F.concat(F.lit("segment_ph"), (F.col("i") + 1).cast("string")).alias("segment"), "s.*")


def spectrogram(x: np.ndarray, size: int = 512, hop: int = 128) -> np.ndarray:
    """Levels in dB by frame and frequency."""
    if len(x) < size:
        return np.zeros((0, size // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size)
    return 20 * np.log10(np.maximum(np.abs(np.fft.rfft(frames, axis=1)), 1e-9))


@vectorised("array<array<double>>")
def _spectra(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([None if x is None else spectrogram(np.asarray(x, float)).tolist() for x in s])


def spectra(samples: Column) -> Column:
    """M13 on a column."""
    return _spectra(samples)
