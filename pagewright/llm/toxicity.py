"""Toxicity by weak supervision.

1. Voters.  Lexicon voters are families of words (a word, or all words with a
   stem) that a bounded sample of labelled training rows shows to go with the
   label; pattern voters look at the shape of a text.  A voter says yes or no.
2. Label model.  A generative model of all votes given an unseen label: each
   voter has its accuracy under either label, and the strongest class-wise
   correlations between voters are modelled as a forest (the parent of a voter
   conditions its vote).  It is fitted by expectation-maximisation; the given
   label of a training row is one more voter, whose errors are estimated too.
3. Classifier.  A linear (logistic) model over voter counts and text shape is
   fitted to the posterior labels; it scores every document.

The fits see at most ``max_rows`` labelled rows, chosen by a hash of the id;
scoring sees all text of all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that the fits may see at most.
MAX_ROWS = 6_000
#: Lexicon voters at most, and voters that the families are dealt to.
FAMILIES, LEXICONS = 400, 24
#: Lengths of stems, in characters; a family is a stem's words or one whole word.
STEMS = (4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")
#: A fitted model as a row.
_FITTED = pa.schema([("chosen", pa.list_(pa.string())), ("weights", pa.list_(pa.float64())), ("shift", pa.float64())])
_PATTERNS = {
    "shouting": re.compile(r"[A-ZÀ-ÖØ-Þ]{3,}"),
    "exclaims": re.compile(r"!{2,}|\?!"),
    "masked": re.compile(r"[^\W\d_]\*{2,}|[@#$%&]{4,}"),
    "drawn_out": re.compile(r"(\w)\1{3,}"),
    "addresses": re.compile(r"\b(?:you|your|du|dich|tu|toi|usted)\b", re.IGNORECASE),
}


@dataclass(frozen=True)
class Families:
    """Hits of all words, as ``word``, and of all stems, as ``stem*``.

    A text hits a word once, and a stem as often as it has different words with
    it, 3 times at most.  ``hits`` are those of texts with label 1, ``labelled`` is
    the number of these texts, ``most`` the hits of a stem's commonest word.
    """

    names: list[str]
    seen: np.ndarray
    hits: np.ndarray
    labelled: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, texts: list[str], labels: np.ndarray) -> Families:
        number: dict[str, int] = {}
        held = [np.fromiter({number.setdefault(w, len(number)) for w in _WORD.findall(text.lower())}, dtype=np.int64) for text in texts]
        words, text = list(number), np.repeat(np.arange(len(texts)), [len(x) for x in held])
        word, label = np.concatenate([*held, np.zeros(0, dtype=np.int64)]), (np.asarray(labels) > 0).astype(np.float64)
        hits = np.bincount(word, label[text], len(words))
        parts = [(words, np.bincount(word, minlength=len(words)), hits, hits, np.zeros(len(words)))]
        for k in STEMS:
            stems: dict[str, int] = {}
            stem = np.array([stems.setdefault(w[:k], len(stems)) if len(w) >= k else -1 for w in words], dtype=np.int64)
            n, most, long = len(stems), np.zeros(len(stems)), stem >= 0
            np.maximum.at(most, stem[long], hits[long])
            fits = stem[word] >= 0
            pairs, times = np.unique(text[fits] * n + stem[word[fits]], return_counts=True)
            which, times, of = pairs % max(n, 1), np.minimum(times, 3), label[pairs // max(n, 1)]
            parts.append(([f"{s}*" for s in stems], np.bincount(which, times, n), np.bincount(which, times * of, n), np.bincount(which, of, n), most))
        return cls([x for p in parts for x in p[0]], *(np.concatenate([p[i] for p in parts]) for i in range(1, 5)))


def first_copies(texts: list[str], sketch: int = 32, shared: int = 6) -> list[int]:
    """Positions of texts that are no near copy of an earlier one.

    Two texts are copies if ``shared`` of the ``sketch`` least hashes of their
    five-word shingles agree.  Copies would count as evidence many times.
    """
    kept, holders = [], {}
    for at, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        hashes = sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))})[:sketch]
        met = Counter(h for x in hashes for h in holders.get(x, ()))
        if met and met.most_common(1)[0][1] >= min(shared, len(hashes)):
            continue
        kept.append(at)
        for x in hashes:
            holders.setdefault(x, []).append(at)
    return kept


def choose_families(texts: list[str], labels: np.ndarray) -> list[str]:
    """Families that go with label 1 more often than chance allows, purest first.

    Hits are texts with a word, or different words with a stem.  A family is a
    candidate if two fifths of its hits have the label and, by chance, less
    than half a family among all that occur often enough would do as well.
    The least likely by chance are taken first; a stem that is little
    more than one word is left to that word, and a family inside one that is
    taken is left out.
    """
    rate = float(labels.mean()) if len(labels) else 0.0
    if not 0 < rate < 1:
        return []
    found = Families.of(texts, labels)
    bar = math.log(0.5 / max(1, int((found.seen > 3).sum())))
    candidates = np.flatnonzero((found.hits > 3) & (found.labelled > 1) & (found.hits >= 0.4 * found.seen))
    chance = {int(i): _log_tail(int(found.hits[i]), int(found.seen[i]), rate) for i in candidates}
    chosen: dict[str, float] = {}
    for i in sorted((i for i, c in chance.items() if c < bar), key=lambda i: (chance[i], len(found.names[i]), found.names[i])):
        name = found.names[i]
        word = name.rstrip("*")
        inside = any(f"{word[:k]}*" in chosen for k in STEMS if k < len(word) or (k == len(word) and name == word))
        if not inside and not (name != word and found.most[i] >= 0.8 * found.hits[i]):
            chosen[name] = found.hits[i] / found.seen[i]
        if len(chosen) == FAMILIES:
            break
    return sorted(chosen, key=lambda f: (-chosen[f], f))


def _log_tail(hits: int, n: int, rate: float) -> float:
    """Chernoff's bound on the log of the chance of ``hits`` or more of n."""
    share = hits / n
    other = (1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0
    return -n * (share * math.log(share / rate) + other) if share > rate else 0.0


@dataclass(frozen=True)
class Voters:
    """Families, purest first, dealt to lexicon voters in turn of purity, beside the pattern voters."""

    chosen: tuple[str, ...]

    @property
    def size(self) -> int:
        return min(LEXICONS, len(self.chosen)) + len(_PATTERNS)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """For each text: damped hits of each voter, all lexicon hits, share of hits, whether two families hit."""
        machine, lexicons = _machine(self.chosen), min(LEXICONS, len(self.chosen))
        voter = np.arange(len(self.chosen)) * lexicons // max(1, len(self.chosen))
        out = np.zeros((len(texts), self.size + 3))
        for row, text in zip(out, texts, strict=True):
            text = text or ""
            low = text.lower()
            if lexicons:
                kinds = set()
                for end, (family, length, stem) in machine.iter(low):
                    start = end - length + 1
                    before = start > 0 and low[start - 1].isalpha()
                    after = end + 1 < len(low) and low[end + 1].isalpha()
                    if not before and (stem or not after):
                        row[voter[family]] += 1
                        kinds.add(family)
                hits = row[:lexicons].sum()
                row[self.size :] = math.log1p(hits), 100 * hits / (20 + text.count(" ")), len(kinds) > 1
            for i, pattern in enumerate(_PATTERNS.values()):
                row[lexicons + i] = sum(1 for _ in pattern.finditer(text)) / (1 + len(text) / 1000)
            row[: self.size] = np.log1p(row[: self.size])
        return out

    def votes(self, features: np.ndarray) -> np.ndarray:
        return (features[:, : self.size] > 0).astype(np.int8)


@lru_cache(maxsize=4)
def _machine(chosen: tuple[str, ...]):
    machine = ahocorasick.Automaton()
    for i, family in enumerate(chosen):
        word = family.rstrip("*")
        machine.add_word(word, (i, len(word), family.endswith("*")))
    if chosen:
        machine.make_automaton()
    return machine


class LabelModel:
    """p(votes, label) with tree-shaped correlations between voters, fitted by EM."""

    def __init__(self, prior: float, rounds: int = 25, strongest: int = 12):
        self.prior, self.rounds, self.strongest = prior, rounds, strongest

    def _parents(self, votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A forest over the voter pairs with the most mutual information given the label."""
        pairs = []
        for k in range(votes.shape[1]):
            for j in range(k):
                gain = 0.0
                for w in (weight, 1 - weight):
                    total = w.sum()
                    if total <= 0:
                        continue
                    for a in (0, 1):
                        for b in (0, 1):
                            both = w[(votes[:, j] == a) & (votes[:, k] == b)].sum() / total
                            one, two = w[votes[:, j] == a].sum() / total, w[votes[:, k] == b].sum() / total
                            if both > 0:
                                gain += total / len(votes) * both * math.log(both / (one * two))
                pairs.append((gain, j, k))
        group, edges = list(range(votes.shape[1])), []
        for gain, j, k in sorted(pairs, reverse=True):
            if len(edges) == self.strongest or gain < 1e-3:
                break
            if group[j] != group[k]:
                old = group[k]
                group = [group[j] if g == old else g for g in group]
                edges.append((j, k))
        parent, todo, linked = np.full(votes.shape[1], -1), [], set()
        for root in range(votes.shape[1]):
            if root in linked:
                continue
            todo, linked = [root], linked | {root}
            while todo:
                at = todo.pop()
                for j, k in edges:
                    other = k if j == at else j if k == at else None
                    if other is not None and other not in linked:
                        parent[other] = at
                        linked.add(other)
                        todo.append(other)
        return parent

    def _cells(self, votes: np.ndarray) -> np.ndarray:
        above = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0)
        return above * 2 + votes

    def fit(self, votes: np.ndarray, start: np.ndarray) -> LabelModel:
        """``start``: a first guess of each row's label probability."""
        posterior = start.copy()
        self.parent = self._parents(votes, posterior)
        cells = self._cells(votes)
        for _ in range(self.rounds):
            self.tables = np.zeros((2, votes.shape[1], 4))
            for y, w in enumerate((1 - posterior, posterior)):
                for cell in range(4):
                    self.tables[y, :, cell] = (w[:, None] * (cells == cell)).sum(axis=0) + 0.5
                for low in (0, 2):
                    self.tables[y, :, low : low + 2] /= self.tables[y, :, low : low + 2].sum(axis=1, keepdims=True)
            posterior = self.posterior(votes)
        return self

    def accuracies(self) -> np.ndarray:
        """Share of right votes of each voter when its parent says no."""
        return self.prior * self.tables[1, :, 1] + (1 - self.prior) * self.tables[0, :, 0]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        cells, columns = self._cells(votes), np.arange(votes.shape[1])
        log = [np.log(self.tables[y, columns, cells]).sum(axis=1) for y in (0, 1)]
        odds = log[1] - log[0] + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass(frozen=True)
class Model:
    """What a worker needs to score: voters and a linear model; without weights, one score for all."""

    voters: Voters
    weights: tuple[float, ...]
    shift: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.shift)
        odds = self.voters.features(texts) @ np.array(self.weights) + self.shift
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * len(x))
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Voters, label model and classifier from labelled rows, near copies counted once; one class or none: a constant score."""
    kept = first_copies(texts)
    texts, labels = [texts[i] for i in kept], labels[kept]
    rate = float(labels.mean()) if len(labels) else 0.0
    voters = Voters(tuple(choose_families(texts, labels)))
    if not 0 < rate < 1:
        return Model(voters, (), rate)
    features = voters.features(texts)
    votes = voters.votes(features)
    given = np.hstack([votes, labels[:, None].astype(np.int8)])
    start = np.where(labels > 0, 0.95, 0.02)
    posterior = LabelModel(rate).fit(given, start).posterior(given)
    weights, shift = _logistic(features, posterior)
    return Model(voters, tuple(weights), shift)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; fold 2 is held out, null ids have no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows outside fold 2 (those with the least hash of their id).

    Of labels that differ for one id the toxic one counts.  Without labels every score is 0.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").alias("x")).join(F.broadcast(sample), "doc_id").where("x is not null").orderBy("doc_id", F.xxhash64("x")).limit(max_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
        model = fit(texts, np.array([float(t > 0) for t in toxic]))
        yield pa.RecordBatch.from_pylist([{"chosen": list(model.voters.chosen), "weights": [float(w) for w in model.weights], "shift": float(model.shift)}], _FITTED)

    # the bounded sample is one partition in order; it is fitted there, and only the model comes to the driver
    found = rows.select("x", "toxic").mapInArrow(work, "chosen array<string>, weights array<double>, shift double").first()
    return Model(Voters(tuple(found["chosen"])), tuple(found["weights"]), found["shift"]) if found else fit([], np.array([]))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 for every row; null texts score as empty ones."""
    columns = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text_col)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(part.column(at).to_pylist()))], names=[*columns, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(work, schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, max_rows))
    held_out = F.coalesce(fold() == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    return score(docs, train(docs, labels, max_rows), name="__pw_score").where(F.col("__pw_score") < threshold).drop("__pw_score")
