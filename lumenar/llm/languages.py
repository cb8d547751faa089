"""Languages of documents and of the segments of mixed ones (problem 9).

A sentence is the average of hashed embeddings of its words' letter 2- to 4-grams and of the words themselves; a linear softmax over it gives the language. Embeddings and softmax are trained
together by stochastic gradient descent in numpy on a bounded sample of labelled documents, whose labels are partly wrong: after a first fit, sentences take
the language that the model finds likelier than all others together, and the rest is left out. The softmax is calibrated on held-out sentences by a temperature, and sentences below a confidence, chosen on them too, are rejected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_labels import labelled_sample, read_label
from .letters import CODES, codepoints

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 3000
BUCKETS, DIM = 1 << 15, 16
#: A sentence ends with its mark and a blank, or with its line; the point of a day's number ("am 5. Juni") ends none.
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|\n")
_DAY = re.compile(r"(?<!\w)\d{1,2}\.$")
_CLOSED = re.compile(r"[.!?…][\"'”’»)\]]*$")
#: Titles and names in quotation marks or brackets.
_ASIDE = re.compile(r"[“\"«„][^“”\"«»„]{1,60}[”\"»“]|\([^)]*\)")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Classifier:
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5


def _grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the 2-, 3- and 4-grams and the words: their buckets, text by text, and the text of each."""
    points, starts = codepoints(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
    found = []
    mixed = points * np.uint64(0x9E3779B97F4A7C15)
    rolling = mixed
    for n in (2, 3, 4):
        if len(points) < n:
            return found
        rolling = rolling[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ mixed[n - 1 :] >> np.uint64(7)
        within = owner[: len(owner) - n + 1] == owner[n - 1 :]
        found.append((((rolling * np.uint64(0x165667B19E3779F9)) >> np.uint64(49)).astype(np.uint16)[within], owner[: len(owner) - n + 1][within]))
    blank = np.flatnonzero(points == 32)
    sizes = np.diff(np.append(blank, len(points)))
    place = (np.arange(len(points)) - np.repeat(blank, sizes)).astype(np.uint64)
    power = mixed * ((place + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1))
    real = sizes > 1
    found.append((((np.add.reduceat(power, blank) * np.uint64(0x165667B19E3779F9)) >> np.uint64(49)).astype(np.uint16)[real], owner[blank][real]))
    return found


def features(texts: list[str], part: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all grams, text by text, and where each text's begin; made in parts, so that no more than a part's intermediate arrays are held."""
    grams, sizes = [], []
    for at in range(0, len(texts), part):
        found = _grams(texts[at : at + part])
        whose = np.concatenate([o for _, o in found]) if found else np.zeros(0, np.int32)
        grams.append((np.concatenate([g for g, _ in found]) if found else np.zeros(0, np.uint16))[np.argsort(whose, kind="stable")])
        sizes.append(np.bincount(whose, minlength=len(texts[at : at + part])))
    starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    return np.concatenate(grams) if grams else np.zeros(0, np.uint16), starts


def _averages(embedding: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff(starts)
    out = np.zeros((len(sizes), embedding.shape[1]), np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(embedding[grams], starts[:-1][full], axis=0) / sizes[full][:, None]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _train(texts: list[str], labels: np.ndarray, rng: np.random.Generator, epochs: int, rate: float = 1.0, batch: int = 64) -> Classifier:
    grams, starts = features(texts)
    model = Classifier(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(CODES)), np.float32), np.zeros(len(CODES), np.float32))
    each = max(1, -(-len(texts) // batch))
    epochs = max(epochs, min(40, 600 // each))  # few sentences are gone through more often
    steps, total = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(texts), batch):
            rows = order[at : at + batch]
            sizes = starts[rows + 1] - starts[rows]
            rows, sizes = rows[sizes > 0], sizes[sizes > 0]
            if not len(rows):
                continue
            lr = rate * (1 - steps / total)
            steps += 1
            place = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
            own = grams[place]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            mean = _averages(model.embedding, own, begin)
            p = _softmax(mean @ model.weights + model.bias)
            p[np.arange(len(rows)), labels[rows]] -= 1
            back = (p @ model.weights.T) / sizes[:, None]
            model.weights -= lr * mean.T @ p / len(rows) * 8
            model.bias -= lr * p.mean(0)
            np.add.at(model.embedding, own, -lr * 4 * np.repeat(back, sizes, axis=0).astype(np.float32))
    return model


def probabilities(model: Classifier, texts: list[str], part: int = 2000) -> np.ndarray:
    """Calibrated probabilities. The average of embeddings times the softmax's weights is the average of their products, so only a bucket's row of the product is looked up."""
    table = (model.embedding @ model.weights).astype(np.float32)
    out = np.zeros((len(texts), len(CODES)))
    for at in range(0, len(texts), part):
        some = texts[at : at + part]
        total, count = np.zeros((len(some), len(CODES))), np.zeros(len(some))
        for grams, owner in _grams(some):
            count += np.bincount(owner, minlength=len(some))
            for k in range(len(CODES)):
                total[:, k] += np.bincount(owner, weights=table[grams, k], minlength=len(some))
        out[at : at + part] = _softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
    return out


def without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def sentences_of(text: str) -> list[str]:
    out, begin = [], 0
    for end in _END.finditer(text):
        if not _DAY.search(text, max(begin, end.start() - 3), end.end()):
            out.append(text[begin : end.end()].strip())
            begin = end.end()
    out.append(text[begin:].strip())
    return [s for s in out if _LETTERS.search(s)]


def is_full(sentence: str) -> bool:
    """It has an end mark and, titles and names in quotation marks or brackets aside, three words."""
    return _CLOSED.search(sentence) is not None and len(_LETTERS.findall(_ASIDE.sub(" ", sentence))) >= 3


def fit_classifier(texts: list[str], labels: np.ndarray, seed: int = 11, epochs: int = 4) -> Classifier:
    """Trained on the sentences of ``texts``; every fourth is learnt without its accents too. A tenth is held out for the temperature and the rejection."""
    rng = np.random.default_rng(seed)
    parts = [(s, k) for t, k in zip(texts, labels, strict=True) for s in sentences_of(t)]
    if not parts:
        return Classifier(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, len(CODES)), np.float32), np.zeros(len(CODES), np.float32))
    said, y = [s for s, _ in parts], np.array([k for _, k in parts])
    held = rng.random(len(said)) < 0.1
    first = _train(said, y, rng, 2)
    p = probabilities(first, said)
    clean, told = p.argmax(1), p.max(1) > 0.5
    held &= told
    learnt = [(s, k) for s, k, h, t in zip(said, clean, held, told, strict=True) if t and not h]
    learnt += [(without_accents(s), k) for s, k in learnt[::4]]
    model = _train([s for s, _ in learnt], np.array([k for _, k in learnt]), rng, epochs)
    if held.sum() >= 50:
        out, truth = [s for s, h in zip(said, held, strict=True) if h], clean[held]
        loss = {}
        for t in (0.25, 0.5, 1.0, 1.5, 2.0, 3.0):
            model.temperature = t
            loss[t] = -np.log(np.maximum(probabilities(model, out)[np.arange(len(out)), truth], 1e-9)).mean()
        model.temperature = min(loss, key=loss.get)
        q = probabilities(model, out)
        sure, right = q.max(1), q.argmax(1) == truth
        levels = [c for c in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9) if (sure >= c).any() and right[sure >= c].mean() >= 0.995]
        model.least = levels[0] if levels else 0.9
    return model


def _segmented(model: Classifier):
    @F.pandas_udf("array<struct<first:int,sentences:int,full:int,lang:string,confidence:double>>")
    def segmented(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[list[dict]] = [[] for _ in texts]
            said, owner = [], []
            for i, t in enumerate(texts):
                own = sentences_of(t or "")
                said += own
                owner += [i] * len(own)
            for at in range(0, len(said), 2000):  # so that a very long text costs no more memory
                p = probabilities(model, said[at : at + 2000])
                for n, (best, sure) in enumerate(zip(p.argmax(1), p.max(1), strict=True)):
                    segments, text = out[owner[at + n]], said[at + n]
                    full = int(is_full(text))
                    lang, place = (CODES[best] if sure >= model.least else None), (segments[-1]["first"] + segments[-1]["sentences"] if segments else 0)
                    if segments and (segments[-1]["lang"] == lang or lang is None):
                        last = segments[-1]
                        last["confidence"] = (last["confidence"] * last["sentences"] + float(sure)) / (last["sentences"] + 1)
                        last["sentences"] += 1
                        last["full"] += full * (lang is not None)
                    else:
                        segments.append({"first": place, "sentences": 1, "full": full * (lang is not None), "lang": lang, "confidence": float(sure)})
            yield pd.Series(out, dtype=object)

    return segmented


def language_segments(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(``doc_id``, ``label``, ``first``, ``sentences``, ``full``, ``lang``, ``confidence``): each run of sentences of one language of each document, from its ``first`` (0) on.

    ``label`` is the recorded language as a code ('' if missing, 'other' if none of the five), ``full`` counts whole sentences (``is_full``), ``confidence`` is the mean
    calibrated probability. Sentences that are rejected go with the run before them; a run at the beginning that is rejected has null for ``lang``. Texts that are null or without
    letters give no row. Whole texts are read; repeated rows of a ``doc_id`` count once.
    """
    texts, labels = labelled_sample(documents, sample)
    model = fit_classifier(texts, labels)
    rows = documents.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", read_label(F.col("lang")).alias("label"), _segmented(model)("text").alias("segments"))
    return rows.dropDuplicates(["doc_id"]).select("doc_id", "label", F.inline("segments"))


def document_languages(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(``doc_id``, ``label``, ``lang``, ``sentences``, ``confidence``, ``languages``): a row for each language a document holds.

    A language counts from two full sentences on; where none has two, the one with the most sentences counts, of equals the surer one.
    """
    segments = language_segments(documents, sample).filter("lang is not null")
    per = segments.groupBy("doc_id", "lang").agg(F.first("label").alias("label"), F.sum("sentences").alias("sentences"), F.sum("full").alias("full"), (F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")).alias("confidence"))
    each = per.groupBy("doc_id").agg(F.first("label").alias("label"), F.collect_list(F.struct("full", "sentences", "confidence", "lang")).alias("all"))
    held = F.filter("all", lambda s: s.full >= 2)
    kept = F.when(F.size(held) > 0, held).otherwise(F.array(F.array_max("all")))
    return each.select("doc_id", "label", F.size(kept).alias("languages"), F.inline(kept)).select("doc_id", "label", "lang", "sentences", "confidence", "languages")


def mislabelled(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(``doc_id``, ``lang``) of documents without a label, with a wrong one, or of several languages, a row for each language."""
    return document_languages(documents, sample).filter((F.col("languages") > 1) | (F.col("label") != F.col("lang"))).select("doc_id", "lang")
