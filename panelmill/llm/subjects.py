"""Subject areas of documents: interpolated n-gram language models per subject, judged sentence by sentence."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.text import plain, skeleton

_TOKEN = re.compile(r"[^\W_]+|[.!?…]+(?=[\s»\")\]]|$)|\n+")
_OTHER, _NUMBER, _STOP = 0, 1, 2  # numbers of: an unknown word, a number, the end of a sentence


class _Numbers(dict):
    """Number of a token; remembers spellings, up to a bound."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[token] = k = _kind(token, self.vocabulary)
        return k


def _kind(token: str, vocabulary: dict[str, int]) -> int:
    if not token[0].isalnum():
        return _STOP
    return _NUMBER if token.isdigit() else vocabulary.get(skeleton(token), _OTHER)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(plain(text))


@dataclass
class Models:
    """Log-probabilities of words and known word pairs: one column per subject, the last one for all text.

    The background of a subject is the best of the models of the others.
    margins: for each subject, the nats by which its cross-entropy must lie below that of its
    background, over the whole sentence; per token that is the margin divided by the number of tokens,
    so a short sentence must differ more per token than a long one. Sentences that fit any
    subject lie near 0. The margins are set by `calibrate` on documents that the models have not seen.
    """

    subjects: list[str]
    vocabulary: dict[str, int]
    pairs: np.ndarray
    table: np.ndarray
    margins: np.ndarray | None = None

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """One row of log-probabilities per token, given the token before it."""
        size = len(self.table) - len(self.pairs)
        before = np.concatenate([[_STOP], ids[:-1]]).astype(np.int64)
        key = before * size + ids
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        known = self.pairs[at] == key if len(self.pairs) else np.zeros(len(ids), bool)
        return self.table[np.where(known, size + at, ids)]

    def sentences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, length without stops, and summed log-probabilities of each sentence."""
        stop = ids == _STOP
        start = np.flatnonzero(np.concatenate([[True], stop[:-1]]))
        sums = np.add.reduceat(np.where(stop[:, None], 0, self.scores(ids)), start, axis=0)
        return start, np.add.reduceat((~stop).astype(int), start), sums


def estimate(ids: np.ndarray, sentence: np.ndarray, weight: np.ndarray, size: int, weights=(0.4, 0.5, 0.1)) -> tuple[np.ndarray, np.ndarray]:
    """Jelinek-Mercer models: pair, word and background word frequencies, mixed by `weights`.

    weight has a row per sentence and a column per model, the last one being the background.
    """
    before = np.concatenate([[_STOP], ids[:-1]]).astype(np.int64)
    use = ids != _STOP
    key, which = before[use] * size + ids[use], sentence[use]
    word, prior = ids[use], before[use]
    pairs, inverse = np.unique(key, return_inverse=True)
    k = weight.shape[1]
    uni, hist, bi = np.zeros((size, k)), np.zeros((size, k)), np.zeros((len(pairs), k))
    for c in range(k):
        w = weight[which, c]
        uni[:, c] = np.bincount(word, w, size)
        hist[:, c] = np.bincount(prior, w, size)
        bi[:, c] = np.bincount(inverse, w, len(pairs))
    keep = bi[:, -1] >= 2
    pairs, bi = pairs[keep], bi[keep]
    ground = (uni[:, -1:] + 0.5) / (uni[:, -1:].sum() + 0.5 * size)
    one = uni / np.maximum(uni.sum(0), 1e-9)
    low = weights[1] * one + weights[2] * ground
    high = weights[0] * bi / np.maximum(hist[pairs // size], 1e-9) + low[pairs % size]
    return pairs, np.log(np.vstack([low, high])).astype(np.float32)


def lead(sums: np.ndarray) -> np.ndarray:
    """Nats by which the best subject is ahead of the second."""
    order = np.sort(sums[:, :-1], 1)
    return order[:, -1] - order[:, -2]


def gain(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cross-entropy per token of the background less that of the best subject."""
    return lead(sums) / np.maximum(n, 1)


def train(rows: list[tuple[str, set[str]]], subjects: list[str], rounds: int = 4, least: int = 3, trust: float = 3.0, sure: float = 3.0) -> Models:
    """Models from labelled documents (text, labels), labels being incomplete and partly wrong.

    The first models take every sentence of a document for its labels, in equal parts.
    Each round then gives a sentence to the subjects that explain it best - `trust` nats
    in favour of the labels of its document - and to all alike if the best model is not `sure`
    nats ahead of the second: so sentences that fit any subject favour none.
    """
    lists = [tokens(t) for t, _ in rows]
    counts: dict[str, int] = {}
    for t in lists:
        for w in t:
            if w[0].isalnum() and not w.isdigit():
                s = skeleton(w)
                counts[s] = counts.get(s, 0) + 1
    vocabulary = {w: k + 3 for k, w in enumerate(sorted(w for w, n in counts.items() if n >= least))}
    size, numbers = len(vocabulary) + 3, _Numbers(vocabulary)
    parts = [np.array([*map(numbers.__getitem__, t), _STOP], np.int64) for t in lists]
    ids = np.concatenate(parts) if parts else np.array([_STOP])
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.array([0])
    stop = ids == _STOP
    start = np.flatnonzero(np.concatenate([[True], stop[:-1]]))
    sentence = np.cumsum(np.concatenate([[0], stop[:-1]])).astype(int)
    labelled = np.array([[float(s in labels) for s in subjects] for _, labels in rows] or [[0.0] * len(subjects)])[doc[start]]
    k, every = len(subjects), np.ones((len(start), 1))
    weight = np.hstack([labelled / np.maximum(labelled.sum(1, keepdims=True), 1), every])
    models = Models(subjects, vocabulary, *estimate(ids, sentence, weight, size))
    for _ in range(rounds):
        sums = models.sentences(ids)[2]
        prior = sums[:, :k] + trust * labelled
        p = np.exp(np.clip(prior - prior.max(1, keepdims=True), -50, 0))
        p /= p.sum(1, keepdims=True)
        clear = (lead(sums) > sure)[:, None]
        weight = np.hstack([np.where(clear, p, 1 / k), every])
        models = Models(subjects, vocabulary, *estimate(ids, sentence, weight, size))
    return models


def judged(models: Models, texts: list[str], numbers: _Numbers | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence: its text, its best subject, the gain per token, its tokens."""
    numbers = _Numbers(models.vocabulary) if numbers is None else numbers
    parts = [np.array([*map(numbers.__getitem__, tokens(t)), _STOP], np.int64) for t in texts]
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    start, n, sums = models.sentences(np.concatenate(parts))
    doc = np.searchsorted(np.cumsum([len(p) for p in parts]), start, side="right")
    return doc, sums[:, :-1].argmax(1), gain(sums, n), n


def counted(doc: np.ndarray, best: np.ndarray, gained: np.ndarray, n: np.ndarray, margins: np.ndarray, texts: int) -> np.ndarray:
    """Sentences of each text about each subject: those whose gain per token reaches the margin of their subject over their length."""
    about = (n > 0) & (gained > margins[best] / np.maximum(n, 1))
    out = np.zeros((texts, len(margins)))
    np.add.at(out, (doc[about], best[about]), 1)
    return out


def shares(models: Models, texts: list[str], numbers: _Numbers | None = None) -> np.ndarray:
    """Sentences of each text that are about each subject."""
    return counted(*judged(models, texts, numbers), models.margins, len(texts))


def calibrate(models: Models, rows: list[tuple[str, set[str]]], least: float, most: int, grid: np.ndarray = np.arange(1.0, 9.1, 0.5), slack: float = 0.0005, gain_of_own: float = 0.002) -> np.ndarray:
    """Margins with the best agreement (F1 over pairs of document and subject) between accepted subjects and labels.

    First one margin for all: of those that agree as well as the best but for `slack` the least,
    since labels are incomplete, so that a subject found beyond them is often right. Then each subject's in turn; it leaves the common margin only
    where that adds gain_of_own, as single documents would move it otherwise.
    """
    truth = np.array([[s in labels for s in models.subjects] for _, labels in rows])
    sentences = judged(models, [t for t, _ in rows])

    def agreement(margins: np.ndarray) -> float:
        got = accepted(counted(*sentences, margins, len(rows)), least, most)
        return 2 * (got & truth).sum() / max(got.sum() + truth.sum(), 1)

    k = len(models.subjects)
    scores = np.array([agreement(np.full(k, m)) for m in grid])
    margins = np.full(k, grid[scores >= scores.max() - slack][0])
    for c in range(k):
        now = agreement(margins)
        own = np.array([agreement(np.where(np.arange(k) == c, m, margins)) for m in grid])
        if own.max() >= now + gain_of_own:
            margins[c] = grid[own >= own.max() - slack][0]
    return margins


def accepted(counts: np.ndarray, least: float, most: int) -> np.ndarray:
    """Mask of the subjects with at least the share `least` of a text's sentences about any; the `most` largest if there are more (ties: first in order)."""
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    order = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    return (share >= least - 1e-9) & (order < most)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc: str, text: str, subjects: list[str], bound: int, bound_chars: int) -> list[tuple[str, set[str]]]:
    """Labelled documents with their labels: the first by a hash of their id, at most `bound` documents of together at most bound_chars characters (texts that would go beyond are passed over)."""
    known = labels.where(F.col("subject").isin(subjects)).groupBy(F.col(doc).alias("_id")).agg(F.collect_set("subject").alias("_labels"))
    few = known.orderBy(F.xxhash64("_id"), "_id").limit(bound)
    ids = docs.select(F.col(doc).alias("_id"), F.length(text).alias("_n")).join(F.broadcast(few.select("_id")), "_id").where("_n > 0").groupBy("_id").agg(F.max("_n").alias("_n"))
    room, keep = bound_chars, []
    for r in ids.orderBy(F.xxhash64("_id"), "_id").collect():
        if r["_n"] <= room:
            keep.append(r["_id"])
            room -= r["_n"]
    chosen = few.where(F.col("_id").isin(keep)) if len(keep) < 50 else few.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in keep], few.select("_id").schema)), "_id")
    rows = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").where("_text is not null").orderBy("_id").collect()
    return [(r["_text"], set(r["_labels"])) for r in {r["_id"]: r for r in rows}.values()]


def fit(rows: list[tuple[str, set[str]]], subjects: list[str], least: float, most: int) -> Models:
    """Models of all labelled documents; their margins come from models of every other document, calibrated on the documents in between."""
    models = train(rows, subjects)
    held, seen = rows[::2], rows[1::2]
    models.margins = calibrate(train(seen, subjects), held, least, most) if held and seen else np.full(len(subjects), 4.0)
    return models


def classify(docs: DataFrame, labels: DataFrame, areas: DataFrame, doc: str = "doc_id", text: str = "text", least: float = 0.2, most: int = 3, bound: int = 4000, bound_chars: int = 40_000_000) -> DataFrame:
    """Subjects of each document: doc_id, subject, sentences (about it), about (about any subject).

    areas lists the subjects (column subject, a short fixed list); labels has doc_id and
    subject for a sample of documents. The models are fitted on at most `bound` labelled
    documents of at most bound_chars characters together, and are the only thing sent to the tasks (their size follows the bounds);
    every document is then judged in one scan without a shuffle. Null and blank
    texts and texts without a sentence about any subject give no row. Without labels no
    sentence has a lead, so there are no rows.
    """
    subjects = [r["subject"] for r in areas.select("subject").where("subject is not null").distinct().orderBy("subject").collect()]
    models = fit(labelled_sample(docs, labels, doc, text, subjects, bound, bound_chars), subjects, least, most) if len(subjects) > 1 else None
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = np.array(subjects, dtype=object)

    def judge(batches):
        fitted = shared.value
        numbers = _Numbers(fitted.vocabulary) if fitted else None
        for pdf in batches:
            if fitted is None or not len(pdf):
                continue
            counts = shares(fitted, pdf["text"].tolist(), numbers)
            d, k = np.nonzero(accepted(counts, least, most))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[d], "subject": names[k], "sentences": counts[d, k].astype("int32"), "about": counts.sum(1)[d].astype("int32")})

    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInPandas(judge, "doc_id bigint, subject string, sentences int, about int")
