"""Hashed letter n-grams of many texts at once, and a naive Bayes over them."""

from __future__ import annotations

import re

import numpy as np

_NO_LETTERS = re.compile(r"[\W\d_]+")
BUCKETS = 1 << 16
#: Ways of writing a label of each language, in lower case; longer tags are read by what stands before their hyphen or underscore.
LANGUAGES = {"en": ("en", "eng", "english"), "fr": ("fr", "fra", "fre", "french", "français"), "de": ("de", "deu", "ger", "german", "deutsch"), "es": ("es", "spa", "spanish", "español"), "pt": ("pt", "por", "portuguese", "português")}
CODES = tuple(LANGUAGES)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in small letters, each text between blanks and every run of other characters than letters as one blank, and where each text begins."""
    clean = [f" {_NO_LETTERS.sub(' ', t.lower()).strip(' ')} " for t in texts]
    starts = np.zeros(len(clean) + 1, np.int64)
    np.cumsum([len(t) for t in clean], out=starts[1:])
    return np.frombuffer("".join(clean).encode("utf-32-le"), np.uint32).astype(np.uint64), starts


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams, and the text each belongs to."""
    points, starts = codepoints(texts)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(13)
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    within = owner[:-2] == owner[2:]
    return h[within].astype(np.int64), owner[:-2][within]


def fit_naive_bayes(texts: list[str], labels: np.ndarray, classes: int, rounds: int = 2, smooth: float = 0.5) -> np.ndarray:
    """Log-probabilities (buckets x classes) of trigrams. Labels are noisy, so after the first fit each text is given the class it is likeliest in, and the fit repeated."""
    grams, owner = trigrams(texts)
    for turn in range(rounds):
        counts = np.full((BUCKETS, classes), smooth)
        np.add.at(counts, (grams, labels[owner]), 1.0)
        table = np.log(counts / counts.sum(0))
        if turn + 1 < rounds:
            labels = scores(table, texts).argmax(1)
    return table.astype(np.float32)


def scores(table: np.ndarray, texts: list[str]) -> np.ndarray:
    """Log-likelihood of each text in each class, up to a constant of the text; zeros for texts without letters."""
    grams, owner = trigrams(texts)
    out = np.zeros((len(texts), table.shape[1]))
    for k in range(table.shape[1]):
        out[:, k] = np.bincount(owner, weights=table[grams, k], minlength=len(texts))
    return out
