"""Toxicity by a logistic classifier that is regularised with counterfactual texts.

A text's features are its distinct lower-cased words, and the prefixes of 4 to 6 letters of each, so inflected forms of
a stem share evidence. For each labelled text that names a group, a counterfactual swaps its identity terms for those of
another group; training adds WEIGHT times the mean squared difference of the two logits, so a mention of a group alone
cannot move the score, while the words around it still can.

Identity terms are a fixed list in a few languages, and mentions that are induced from the labelled sample, whatever its
language: words that stand in at least MIN_DOCS texts of either label and mostly in clean ones, but in more of the toxic
ones than chance explains. Both are features whatever their evidence, so that the model could weigh them and the penalty
has to keep it from that. A mention is swapped for the word most like it by the texts they share (cosine) among those that
stand on both sides as well and are no features.

A word's weight is the sum of its features' weights, and a text's logit the sum over its distinct words and the bias, so
a text is scored in one pass over its words however long it is. Fitting reads a bounded sample (about PER_LABEL labelled
rows of each label, the documented parameter per_label); scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .langid import _with, labelled_sample

PER_LABEL = 2500
WEIGHT = 1.0
MIN_DOCS = 5
HASH_BITS = 20
#: Least log-likelihood ratio of a feature's counts by label; chance exceeds it once in two million features.
EVIDENCE = 25.0
#: Identity terms by kind; a counterfactual swaps a term for the next one of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)
#: At most so many induced mentions, those of most evidence, and so many words to swap them for, the most frequent.
MENTIONS, EXCHANGES = 200, 500
#: Least log-likelihood ratio of a mention; chance exceeds it once in a hundred words.
MENTION_EVIDENCE = 6.6
#: Texts of one label whose word sets are this much alike are copies, and teach once.
COPY = 0.8
_SWAP = {a: row[(i + 1) % len(row)] for row in IDENTITY_TERMS for i, a in enumerate(row)}
_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n)]


def swapped(found: set[str], swaps: dict[str, str]) -> tuple[set[str], set[str]]:
    """The words that only the text has, and those that only its counterfactual has."""
    gone = found & swaps.keys()
    new = {swaps[w] for w in gone}
    return gone - new, new - found


def counterfactual(found: set[str], swaps: dict[str, str] = _SWAP) -> set[str] | None:
    gone, new = swapped(found, swaps)
    return (found - gone) | new if gone or new else None


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    swaps: dict[str, str] = field(default_factory=dict)  # identity terms and induced mentions
    pairs: int = 0  # labelled texts that have a counterfactual
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def of(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= 200_000:
                self.cache.clear()
            self.cache[word] = found = sum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def score(self, text: str | None) -> float:
        z = self.bias + math.fsum(map(self.of, words(text)))  # exact, so the order of words does not matter
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def evidence(a: int, b: int, n1: float, n0: float) -> float:
    """Log-likelihood ratio of a feature in a of n1 and b of n0 texts."""
    p = (a + b) / (n1 + n0)
    return 2 * sum(k * np.log(k / (n * q)) for k, n, q in ((a, n1, p), (b, n0, p), (n1 - a, n1, 1 - p), (n0 - b, n0, 1 - p)) if k > 0)


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) >> (32 - HASH_BITS)


def coded(texts: Iterable[Iterable[str]]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of all texts, and each text's as rising numbers among them: 4 bytes for a word of a text."""
    number: dict[str, int] = {}
    own = [np.unique(np.array([number.setdefault(w, len(number)) for w in sorted(t)], np.int32)) for t in texts]
    return list(number), own


def _rows(sets: list[set[str]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and row number of each feature of each text, once a text for each word that has it."""
    at, row = [], []
    for i, s in enumerate(sets):
        hit = [index[f] for w in sorted(s) for f in features(w) if f in index]
        at += hit
        row += [i] * len(hit)
    return np.array(at, np.int64), np.array(row, np.int64)


def without_copies(texts: Iterable[Iterable[str]], labels: list[int]) -> list[int]:
    """Places of the texts that are no copy of an earlier one of their label: candidates share the three least hashes of
    their words under one of three orders, and are compared exactly."""
    return _without_copies(*coded(texts), labels)


def _without_copies(vocabulary: list[str], own: list[np.ndarray], labels: list[int]) -> list[int]:
    crc = np.fromiter((zlib.crc32(w.encode()) for w in vocabulary), np.uint64, len(vocabulary))
    orders = [crc * np.uint64(odd) & np.uint64(0xFFFFFFFF) for odd in (1, 0x9E3779B1, 0x85EBCA6B)]
    seen: dict[tuple, list[int]] = {}
    out = []
    for i, (s, label) in enumerate(zip(own, labels, strict=True)):
        keys = []
        for k, order in enumerate(orders):
            h = order[s]
            keys.append((label, k, *np.sort(np.partition(h, 2)[:3] if len(h) > 3 else h).tolist()))
        for j in {j for key in keys for j in seen.get(key, ())}:
            both = len(np.intersect1d(s, own[j], assume_unique=True))
            if both >= COPY * (len(s) + len(own[j]) - both):
                break
        else:
            out.append(i)
            for key in keys:
                seen.setdefault(key, []).append(i)
    return out


def induced(vocabulary: list[str], own: list[np.ndarray], pos: Counter, neg: Counter, known: set[str], n1: float, n0: float, min_docs: int) -> dict[str, str]:
    """mention -> the word it is swapped for, where known are the features that have the evidence; see above."""
    both = [w for w in pos if not w.endswith("-") and w not in _SWAP and pos[w] >= min_docs and neg[w] > max(min_docs - 1, pos[w])]
    odd = {w: evidence(pos[w], neg[w], n1, n0) for w in both if pos[w] * n0 > neg[w] * n1}
    mentions = sorted((w for w, e in odd.items() if e > MENTION_EVIDENCE), key=lambda w: (-odd[w], w))[:MENTIONS]
    known = known | set(mentions)
    plain = sorted((w for w in both if not any(f in known for f in features(w))), key=lambda w: (-pos[w] - neg[w], w))[:EXCHANGES]
    if not mentions or not plain:
        return {}
    place = {w: i for i, w in enumerate([*mentions, *plain])}
    column = np.fromiter((place.get(w, -1) for w in vocabulary), np.int32, len(vocabulary))
    held = np.zeros((len(own), len(place)), np.float32)
    for i, s in enumerate(own):
        hit = column[s]
        held[i, hit[hit >= 0]] = 1
    size = np.sqrt(held.sum(0))
    like = held[:, : len(mentions)].T @ held[:, len(mentions) :] / np.outer(size[: len(mentions)], size[len(mentions) :])
    return {w: plain[int(like[i].argmax())] for i, w in enumerate(mentions)}


def _counted(vocabulary: list[str], own: list[np.ndarray], labels: list[int], min_docs: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(features, number of each word's features or -1, texts of label 0 and of label 1 that have each feature) for the
    features that stand in min_docs texts, and some others."""
    # A first count by hash, in fixed memory, says which features can be that frequent; only those are counted by name.
    none = 1 << HASH_BITS
    bucket = np.full((len(vocabulary), 4), none, np.int32)
    for i, w in enumerate(vocabulary):
        found = [_bucket(f) for f in features(w)]
        bucket[i, : len(found)] = found
    rough = np.zeros(none + 1, np.int32)
    for s in own:
        rough[np.unique(bucket[s])] += 1
    likely = rough >= min_docs
    likely[none] = False
    likely = likely[bucket]
    del bucket, rough
    number: dict[str, int] = {}
    ids = np.full((len(vocabulary), 4), -1, np.int32)
    for i in np.nonzero(likely.any(1))[0]:
        for j, f in enumerate(features(vocabulary[i])):
            if likely[i, j]:
                ids[i, j] = number.setdefault(f, len(number))
    counts = np.zeros((2, len(number) + 1), np.int32)  # the last one has what is no feature
    for s, label in zip(own, labels, strict=True):
        counts[label, np.unique(ids[s])] += 1
    return list(number), ids, counts[:, :-1]


def train(texts: Iterable[Iterable[str]], labels: list[int], weight: float = WEIGHT, min_docs: int = MIN_DOCS, ridge: float = 2e-3, rounds: int = 300) -> Model:
    """Copies teach once.

    Adam on the mean logistic loss + ridge + weight x mean squared logit change under identity swaps.

    Features are kept if they occur in min_docs texts and their counts differ between labels beyond chance
    (log-likelihood ratio over EVIDENCE), so words without evidence have no weight at all. Identity terms are always kept.
    """
    vocabulary, own = coded(texts)
    kept = _without_copies(vocabulary, own, labels)
    own, labels = [own[i] for i in kept], [labels[i] for i in kept]
    y = np.array(labels, float)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return Model(8.0 if n1 and not n0 else -8.0, {})
    names, ids, counts = _counted(vocabulary, own, labels, min_docs)
    neg, pos = (Counter(dict(zip(names, c.tolist(), strict=True))) for c in counts)
    kept = [f for f in names if pos[f] + neg[f] >= min_docs and (f in _SWAP or evidence(pos[f], neg[f], n1, n0) > EVIDENCE)]
    swaps = _SWAP | induced(vocabulary, own, pos, neg, set(kept), n1, n0, min_docs)
    kept = sorted({*kept, *(w for w in swaps if w not in _SWAP)})
    index = {f: i for i, f in enumerate(kept)}
    kept_ids = np.array([*(index.get(f, -1) for f in names), -1])[ids]
    hits = [(x := kept_ids[s].ravel())[x >= 0] for s in own]
    at, row = np.concatenate(hits), np.repeat(np.arange(len(own)), [len(x) for x in hits])
    named = np.fromiter((w in swaps for w in vocabulary), bool, len(vocabulary))
    changed = ({vocabulary[i] for i in s.tolist()} for s in own if named[s].any())
    pairs = [p for s in changed if any(p := swapped(s, swaps))]  # words that both sides have change nothing
    at_a, row_a = _rows([a for a, _ in pairs], index)
    at_b, row_b = _rows([b for _, b in pairs], index)
    balance = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    theta, m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, rounds + 1):
        z = theta[-1] + np.bincount(row, theta[at], len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        gradient = np.append(np.bincount(at, error[row], len(kept)), error.sum())
        gradient[:-1] += ridge * theta[:-1] / max(len(kept), 1)
        if pairs:
            change = 2 * weight / len(pairs) * (np.bincount(row_a, theta[at_a], len(pairs)) - np.bincount(row_b, theta[at_b], len(pairs)))
            gradient[:-1] += np.bincount(at_a, change[row_a], len(kept)) - np.bincount(at_b, change[row_b], len(kept))
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(float(theta[-1]), dict(zip(kept, theta[:-1].tolist(), strict=True)), swaps, len(pairs))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, weight: float = WEIGHT) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1). Null labels and documents without a label teach nothing."""
    prepare(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [" ".join(sorted(words(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["toxic", "words"])

    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = labelled_sample(known, "toxic", per_label)
    few = F.broadcast(chosen.select("doc_id", "toxic"))  # about per_label rows of each label, however large the table
    rows = docs.select("doc_id", "text").join(few, "doc_id").select("toxic", "text")
    found = sorted(tuple(r) for r in rows.mapInArrow(sets, "toxic int, words string").collect())  # bounded by per_label
    toxic = [int(label == 1) for label, _ in found]

    def texts() -> Iterator[list[str]]:
        for i, (_, text) in enumerate(found):
            found[i] = None  # no text is held twice
            yield text.split()

    return train(texts(), toxic, weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, with toxicity double: 0 to 1, higher where label 1 is likelier. A null text counts as empty."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "toxicity"])

    return _with(docs, run, "toxicity double")
