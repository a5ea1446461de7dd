"""Languages of documents and of the stretches of mixed ones, by hierarchical discrimination.

A linear support vector machine for each language family decides the family of a sentence; within the family, one linear
machine for each pair of languages decides between close relatives. Features are the mean counts of hashed character
n-grams of words, so a sentence's scores are the mean of its words' scores, and each word is scored once for a worker.

The machines are fitted on a bounded sample of labelled documents (SAMPLE_DOCUMENTS for each label, chosen by hash), in
rounds: sentences that the machines of one round assign to another language than the label are left out of the next,
which removes wrong labels and the foreign parts of mixed texts. Decisions are taken in order: the families of a
document's sentences are the most likely path under a cost for changing family, and within each run of one family the
languages are the most likely path among its members only, so that single foreign terms and very short sentences change
nothing. The confidence of a language is P(family) times P(language in the family).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The languages known, by family.
FAMILIES = {"germanic": ("en", "de", "nl"), "romance": ("fr", "es", "pt", "it"), "slavic": ("pl",)}
#: Labels that say nothing.
NO_LABEL = ("", "und")
SAMPLE_DOCUMENTS = 100
BUCKETS, GRAMS = 1 << 15, (1, 2, 3, 4)
ROUNDS, EPOCHS, REGULARISATION = 2, 4, 1e-5
#: Cost, in nats, of a change of language between two sentences.
CHANGE = 4.0
#: Margin by which another family, or another language of the family, must win for a label to be left out of a round.
DOUBT = 0.2
MOST_CACHED_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\s*\n\s*")


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence of text, in lower case; sentences without words are left out."""
    return [w for s in _SENTENCE.split(text) if s and (w := _WORD.findall(s.lower()))]


def _grams(word: str) -> list[int]:
    marked = f"<{word}>"
    return [zlib.crc32(marked[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)] + [zlib.crc32(b"=" + word.encode()) % BUCKETS]


@dataclass
class Machines:
    """Weights of all machines, one column each: first the families, then the pairs of languages within each family."""

    families: dict[str, tuple[str, ...]]
    weights: np.ndarray
    #: Of the probabilities of families, and of languages within one.
    steepness: tuple[float, float] = (1.0, 1.0)

    def __post_init__(self):
        self.languages = [x for f in self.families.values() for x in f]
        self.pairs = [p for f in self.families.values() for p in combinations(f, 2)]
        self.members = [np.array([self.languages.index(x) for x in f]) for f in self.families.values()]
        self.family_of = np.array([i for i, f in enumerate(self.families.values()) for _ in f])
        # from the margins of the pairs to the mean margin of each language; a family of one needs no machine
        votes = np.zeros((len(self.pairs), len(self.languages)), np.float32)
        for j, x in enumerate(self.languages):
            within = [(i, p) for i, p in enumerate(self.pairs) if x in p]
            for i, p in within:
                votes[i, j] = (1.0 if p[0] == x else -1.0) / len(within)
        self.votes = votes
        self._cache: dict[str, int] = {}
        self._rows = np.zeros((1024, self.weights.shape[1] + 1), np.float32)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """For each word the sum of its n-grams' weights, and their number."""
        cache = self._cache
        if len(cache) > MOST_CACHED_WORDS:
            cache.clear()
        for w in set(words) - cache.keys():
            n = cache[w] = len(cache)
            if n >= len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
            grams = _grams(w)
            self._rows[n, :-1] = self.weights[grams].sum(axis=0)
            self._rows[n, -1] = len(grams)
        return self._rows[[cache[w] for w in words]]

    def scores(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each sentence the margins of the families, and of each language against the others of its family."""
        if not sentences:
            return np.zeros((0, len(self.families)), np.float32), np.zeros((0, len(self.languages)), np.float32)
        starts = np.cumsum([0, *map(len, sentences)])[:-1]
        sums = np.add.reduceat(self.word_rows([w for s in sentences for w in s]), starts, axis=0)
        machine = sums[:, :-1] / sums[:, -1:]
        k = len(self.families)
        return machine[:, :k], machine[:, k:] @ self.votes

    def predict(self, scores: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The language of each sentence by itself: the best family, then the best of its languages."""
        families, languages = scores
        best = families.argmax(axis=1)
        return np.array([self.members[f][languages[i, self.members[f]].argmax()] for i, f in enumerate(best)], np.int64)

    def log_probabilities(self, scores: tuple[np.ndarray, np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P of each family, and of each language in its own family, for each sentence by itself; short sentences say little."""
        weight = np.minimum((lengths[:, None] / 8.0) ** 2, 1.0)
        within = np.zeros_like(scores[1], np.float64)
        for m in self.members:
            within[:, m] = _log_softmax(scores[1][:, m] * (self.steepness[1] * weight))
        return _log_softmax(scores[0] * (self.steepness[0] * weight)), within

    def path(self, families: np.ndarray, within: np.ndarray) -> list[int]:
        """The language of each sentence of one document: the likeliest path of families, then of languages in each run of one family."""
        out: list[int] = []
        chosen = likeliest_path(families)
        start = 0
        for i in range(1, len(chosen) + 1):
            if i == len(chosen) or chosen[i] != chosen[start]:
                m = self.members[chosen[start]]
                out += m[likeliest_path(within[start:i][:, m])].tolist()
                start = i
        return out


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=1, keepdims=True)
    return np.maximum(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)), -30.0)


def likeliest_path(logp: np.ndarray) -> list[int]:
    """The most likely column for each row, at a cost of CHANGE for each change (Viterbi)."""
    top = logp.argmax(axis=1)
    if (top == top[0]).all():
        return top.tolist()
    total, back = logp[0], []
    for row in logp[1:]:
        stay, leave = total, total.max() - CHANGE
        back.append(np.where(stay >= leave, np.arange(len(total)), total.argmax()))
        total = np.maximum(stay, leave) + row
    at = [int(total.argmax())]
    for step in reversed(back):
        at.append(int(step[at[-1]]))
    return at[::-1]


def _targets(machines: Machines, labels: np.ndarray) -> np.ndarray:
    """+1, -1 or 0 (no part in it) of each sentence for each machine."""
    y = np.zeros((len(labels), machines.weights.shape[1]), np.float32)
    names = np.array(machines.languages)[labels]
    for i, members in enumerate(machines.families.values()):
        y[:, i] = np.where(np.isin(names, members), 1, -1)
    for i, (a, b) in enumerate(machines.pairs):
        y[:, len(machines.families) + i] = (names == a).astype(np.float32) - (names == b)
    return y


def fit(sentences: list[list[str]], labels: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> Machines:
    """Machines fitted to labelled sentences by stochastic subgradient descent on the hinge loss, with averaged weights."""
    columns = len(families) + sum(len(f) * (len(f) - 1) // 2 for f in families.values())
    machines = Machines(families, np.zeros((BUCKETS, columns), np.float32))
    place = {x: i for i, x in enumerate(machines.languages)}
    data = []
    for words, label in zip(sentences, labels):
        grams, n = np.unique([g for w in words for g in _grams(w)], return_counts=True)
        data.append((grams, (n / n.sum()).astype(np.float32), place[label]))
    if not data:
        return machines
    y_all = np.array([d[2] for d in data])
    keep, scale = np.ones(len(data), bool), 40.0
    for _ in range(ROUNDS):
        rng, weights, average, step = np.random.default_rng(7), np.zeros((BUCKETS, columns), np.float32), np.zeros((BUCKETS, columns), np.float64), 0
        y = _targets(machines, y_all)
        share = np.bincount(y_all[keep], minlength=len(machines.languages)) / max(1, keep.sum())
        for epoch in range(EPOCHS):
            for i in rng.permutation(np.flatnonzero(keep)):
                grams, n, label = data[i]
                x = n * scale
                margin = y[i] * (x @ weights[grams])
                push = np.where((margin < 1) & (y[i] != 0), y[i], 0)
                if push.any():
                    rate = 0.02 / (1 + epoch) * min(4.0, (1 / len(machines.languages)) / max(share[label], 1e-9)) ** 0.5
                    weights[grams] += rate * np.outer(x, push) - REGULARISATION * weights[grams]
                step += 1
            average += weights
        machines = Machines(families, (average / EPOCHS * scale).astype(np.float32))
        scores = machines.scores(sentences)
        row, family = np.arange(len(y_all)), machines.family_of[y_all]
        off_family = scores[0].max(axis=1) - scores[0][row, family] > DOUBT
        own = np.where(machines.family_of[None, :] == family[:, None], scores[1], -np.inf)
        keep = ~(off_family | (own.max(axis=1) - own[row, y_all] > DOUBT))
    # steepness of the probabilities: the likeliest on the kept sentences, tempered
    steepness = []
    for logits, gold in ((scores[0][keep], family[keep]), (own[keep], y_all[keep])):
        fits = {a: float(_log_softmax(a * logits)[np.arange(len(gold)), gold].mean()) for a in (0.5, 1, 2, 4, 8)} if len(gold) else {1: 0.0}
        steepness.append(float(min(max(fits, key=fits.get), 6.0)))
    machines.steepness = (steepness[0], steepness[1])
    return machines


def fit_on_sample(documents: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES, sample_documents: int = SAMPLE_DOCUMENTS) -> Machines:
    """Machines fitted to about sample_documents documents of each label; documents: (doc_id, text, lang)."""
    languages = [x for f in families.values() for x in f]
    label = F.lower(F.trim("lang"))
    known = documents.select("text", label.alias("lang"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)).alias("h")).filter(F.col("lang").isin(languages) & (F.length("text") > 0))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(1_000_003 * min(1.0, sample_documents / n)) + 1))]) if counts else None
    rows = known.filter(F.col("h") < share[F.col("lang")]).select("text", "lang").collect() if counts else []
    pairs = [(s, r.lang) for r in sorted(rows) for s in sentences_of(r.text) if len(s) >= 4]
    return fit([s for s, _ in pairs], [x for _, x in pairs], families)


def _labeller(machines: Machines):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = machines.languages
        for batch in batches:
            out = []
            parts = [sentences_of(t) if t else [] for t in batch["text"]]
            flat = [s for p in parts for s in p]
            lengths = np.array([len(s) for s in flat], np.float64)
            families, within = machines.log_probabilities(machines.scores(flat), lengths)
            at = 0
            for doc_id, sentences in zip(batch["doc_id"], parts):
                end = at + len(sentences)
                if end == at:
                    continue
                path = machines.path(families[at:end], within[at:end])
                start, seg = 0, 0
                for i in range(1, len(path) + 1):
                    if i == len(path) or path[i] != path[start]:
                        seg += 1
                        weight, lang = lengths[at + start : at + i], path[start]
                        p = np.exp(families[at + start : at + i, machines.family_of[lang]] + within[at + start : at + i, lang])
                        out.append((doc_id, seg, names[lang], float((p * weight).sum() / weight.sum()), i - start, int(weight.sum())))
                        start = i
                at = end
            yield pd.DataFrame(out, columns=["doc_id", "seg_no", "lang", "confidence", "n_sentences", "n_words"])

    return run


def language_segments(documents: DataFrame, machines: Machines | None = None) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, n_sentences, n_words): the longest stretches of whole sentences in one language.

    documents: (doc_id, text, lang); without machines they are fitted on a sample of it. A text that is null, empty or
    without letters has no row. Without any usable label every text gets the first language, with even confidence.
    Repeated documents each come out. One pass, no shuffle.
    """
    machines = machines or fit_on_sample(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInPandas(_labeller(machines), f"doc_id {kind}, seg_no int, lang string, confidence double, n_sentences int, n_words int")
