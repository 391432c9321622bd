"""Quality rules by tokeniser fertility (operator 10).

A public sentencepiece vocabulary with byte fallback cuts every word; per text this gives characters per token, the
share of byte-fallback tokens and the entropy of the token distribution. A text is rejected if a measure leaves the
band of its language, or, for a language without a band, of its script. Plain base rules (length, repeated
three-word windows) come first.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm._common import bytes_of, claim, map_batches

#: Fixed values. Characters per token (low, high), highest share of byte-fallback tokens, lowest entropy in bits of
#: a text of FULL_TOKENS tokens or more (see least_entropy); by language, then by script. The lower limits of the four languages are fitted
#: to the labelled documents of sf0.1: just below those of quality 1 (in English two of 1973 lie below).
BANDS = {
    "en": (1.99, 7.0, 0.05, 5.3),
    "de": (2.04, 7.0, 0.05, 5.3),
    "fr": (1.65, 7.0, 0.05, 5.3),
    "es": (1.79, 7.0, 0.05, 5.3),
    "Latin": (1.2, 8.0, 0.15, 5.0),
    "Cyrillic": (1.0, 7.0, 0.25, 5.0),
    "Greek": (0.6, 6.0, 0.6, 4.0),
    "Arabic": (0.6, 6.0, 0.6, 4.0),
    "Han": (0.3, 3.0, 0.9, 4.0),
    "other": (0.2, 8.0, 1.0, 3.0),
}
FULL_TOKENS, KEPT_WORDS = 100, 200_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Code points of scripts, first to last.
_SCRIPTS = {"Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)), "Cyrillic": ((0x400, 0x4FF),), "Greek": ((0x370, 0x3FF),), "Arabic": ((0x600, 0x6FF),), "Han": ((0x3040, 0x30FF), (0x3400, 0x9FFF))}
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, script string"


def script_of(text: str) -> str:
    """The script of most letters; 'other' if there are none."""
    if text.isascii():
        return "Latin" if re.search("[A-Za-z]", text) else "other"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n, name = max((sum(int(((points >= a) & (points <= b)).sum()) for a, b in ranges), name) for name, ranges in _SCRIPTS.items())
    return name if n else "other"


class _Numbers(dict):
    """Numbers of words by first sight; those not seen before gather in fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Pieces:
    """Words as numbers, with the pieces each is cut into."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.flat, self.start, self.width = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        fresh, self.number.fresh = self.number.fresh, []
        if fresh:
            cut = self.model.encode([w.decode() for w in fresh], num_threads=1)
            widths = np.fromiter(map(len, cut), np.int64, len(cut))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(widths) - widths])
            self.width = np.concatenate([self.width, widths])
            self.flat = np.concatenate([self.flat, np.fromiter((p for c in cut for p in c), np.int32, int(widths.sum()))])
        return out

    def histogram(self, numbers: np.ndarray) -> np.ndarray:
        """How often each piece occurs in a text of these words."""
        own, counts = np.unique(numbers, return_counts=True)
        widths = self.width[own]
        ends = np.cumsum(widths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[own] - ends + widths, widths)
        return np.bincount(self.flat[at], np.repeat(counts, widths), self.size)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def repeated_words(numbers: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(numbers) < 4:
        return 0
    if numbers.max() < 1 << 21:
        windows = numbers[:-2] << 42 | numbers[1:-1] << 21 | numbers[2:]
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(np.stack([numbers[:-2], numbers[1:-1], numbers[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    twice = counts[inverse.reshape(-1)] > 1
    covered = np.zeros(len(numbers), bool)
    for i in range(3):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def measures_of(texts: list[bytes], vocabulary: Pieces) -> list[tuple]:
    if len(vocabulary.number) > KEPT_WORDS:
        vocabulary.forget()
    split = [t.split() for t in texts]
    numbers = vocabulary.numbers([w for words in split for w in words])
    out, at = [], 0
    for data, words in zip(texts, split, strict=True):
        own = numbers[at : at + len(words)]
        at += len(words)
        text = data.decode()
        lines = [x for x in data.split(b"\n") if x.strip()]
        chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
        hist = vocabulary.histogram(own)
        total = float(hist.sum())
        share = hist[hist > 0] / total if total else np.zeros(0)
        out.append((len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(own), int(total), chars / total if total else None, float(hist[vocabulary.fallback].sum() / total) if total else None, float(-(share * np.log2(share)).sum()) if total else None, script_of(text)))
    return out


def measures(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """docs with the columns of MEASURES after its own; own columns of these names are an error.

    Map-only, over whole texts. A null text counts as empty: no words, null ratios.
    """
    names = MEASURES.replace(" long", "").replace(" double", "").replace(" string", "").split(", ")
    if taken := set(names) & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(taken)}")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("quality", pieces.cache_clear)
        found = measures_of(bytes_of(batch, text_col), pieces(vocabulary_path))
        kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds))], [*batch.schema.names, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, run, f"{own}, {MEASURES}", text_col)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def least_entropy(limit: float) -> Column:
    """The limit for a text's length: n tokens have log2 n bits at most, so a shorter text's limit falls in proportion."""
    return limit * F.least(F.lit(1.0), F.log2(F.greatest(F.col("n_tokens"), F.lit(1))) / math.log2(FULL_TOKENS))


def in_band(language: Column, bands: dict = BANDS) -> Column:
    """Whether the measures lie in the band of the language, else of the script; texts without tokens do not."""
    out = F.lit(None).cast("boolean")
    for name, (low, high, byte_share, entropy) in reversed(bands.items()):
        inside = F.col("chars_per_token").between(low, high) & (F.col("byte_share") <= byte_share) & (F.col("entropy") >= least_entropy(entropy))
        out = F.when(F.coalesce(F.when(language.isin(list(bands)), language), F.col("script")) == name, inside).otherwise(out)
    return F.coalesce(out, F.lit(False))


def verdicts(docs: DataFrame, vocabulary_path: str, text_col: str = "text", language_col: str = "lang", bands: dict = BANDS) -> DataFrame:
    """docs with its measures, base_failed and kept (a rejection by a base rule or a band makes it false).

    A null or unknown language is judged by the text's script. No row is lost and repeated rows fare alike. Own
    columns named like an added one are an error.
    """
    if taken := {"base_failed", "kept"} & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(taken)}")
    out = measures(docs, vocabulary_path, text_col).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & in_band(F.col(language_col), bands))
