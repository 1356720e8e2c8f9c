"""Toxicity scores from a learned lexicon, misspellings included, weighed by context.

1. A lexicon of words and word stems is learned from labelled rows: terms that are far more frequent
   in toxic rows (a likelihood-ratio test). Near copies among the labelled rows count once.
2. Text words are matched by intersecting the Levenshtein automaton of the word with the trie of the
   lexicon, so misspelled terms are found without listing variants.
3. Each hit is weighed by a window of words around it: inside quotation marks or after a word of
   reporting it counts as quotation, next to a word of address as abuse.
   Words that clean labelled rows use as well are no misspellings.
4. A logistic model over the sums of hits gives the score. Its features come from lexicons of the
   other half of the labelled rows, so terms that are frequent by chance earn no trust.

Fitting reads at most ``fit_rows`` labelled rows, the first by a hash of the id.

Defined results: a null or empty text has no hits and the score of such texts; repeated rows are
scored each; a null id is scored and not held out. Labels that are null are not used; an id with
several labels is toxic if any is. Without usable labels every score is 0.1. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, WordHashes, arrow_rows, shingle_hashes

#: Bound of the fit: labelled rows read. It bounds the terms and exceptions of the lexicon as well.
FIT_ROWS = 20_000
#: A term must be this much more frequent in toxic rows, and this unlikely to be so by chance.
MIN_LIFT, MIN_EVIDENCE, MIN_ROWS = 12.0, 20.0, 3
#: Longer words are compared with stems only: the automaton is for misspelled words.
LONGEST_INEXACT = 40
WINDOW = 6
THRESHOLD = 0.3

# Words of reporting, words of address, quotation marks.
REPORTING = frozenset("said says wrote called calls quote quoted reported slur term word dit disait écrit sagte schrieb nannte dijo escribió llamó".split())
ADDRESS = frozenset("you your yours du dich dir dein tu toi te vous tú ti usted eres".split())
MARKS = frozenset("\"“”„«»‚‘‹›")

_WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6)


def allowed_errors(length: int) -> int:
    return 0 if length < 5 else 1 if length < 10 else 2


class Trie:
    """Lexicon terms; a term that ends in ``*`` is a stem and matches any word that begins with it."""

    def __init__(self, terms: dict[str, float]):
        self.root: dict = {}
        self.weight = terms
        self.starts, self.ends, self.inner = set(), set(), set()
        for term in terms:
            stem = term.endswith("*")
            plain = term[:-1] if stem else term
            node = self.root
            for letter in plain:
                node = node.setdefault(letter, {})
            node.setdefault("", []).append(term)
            # With one error a half of the term stays as it is, with two a third does.
            self.starts.add(plain[:3] if stem or len(plain) != 5 else plain[:2])
            if not stem:
                self.ends.add(plain[-3:])
                if allowed_errors(len(plain)) > 1:
                    self.inner.update(plain[k:k + 3] for k in range(len(plain) - 2))

    def possible(self, word: str) -> bool:
        """A quick test that every word with a match passes."""
        if word[:3] in self.starts or word[:2] in self.starts or word[-3:] in self.ends:
            return True
        return len(word) > 7 and bool(self.inner) and any(word[k:k + 3] in self.inner for k in range(len(word) - 2))

    def stem_of(self, word: str) -> tuple[str, int] | None:
        """The heaviest stem that begins ``word``."""
        node, best = self.root, None
        for letter in word:
            node = node.get(letter)
            if node is None:
                break
            for term in node.get("", ()):
                if term.endswith("*") and (best is None or (-self.weight[term], term) < best):
                    best = (-self.weight[term], term)
        return (best[1], 0) if best else None

    def match(self, word: str) -> tuple[str, int] | None:
        """The term nearest to ``word`` within its allowed errors, and their number.

        The automaton's states are bit sets: bit i of the set for j errors says that the letters
        of the trie read so far can be the first i letters of the word with j errors.
        """
        if not self.possible(word):
            return None
        places: dict[str, int] = {}
        for k, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << k
        size = len(word)
        full, accept = (1 << size + 1) - 1, 1 << size
        best: tuple | None = None
        pending = [(self.root, 1, 3 & full, 7 & full if size > 7 else 0, 0)]
        while pending:
            node, none, one, two, depth = pending.pop()
            for letter, child in node.items():
                if letter == "":
                    errors = 0 if none & accept else 1 if one & accept else 2 if two & accept else 9
                    for term in child:
                        if term.endswith("*"):
                            found = (0, 1, -self.weight[term], term) if none else None
                        else:
                            found = (errors, 0, -self.weight[term], term) if errors <= allowed_errors(depth) else None
                        if found and (best is None or found < best):
                            best = found
                    continue
                at = places.get(letter, 0)
                none_next = (none & at) << 1
                one_next = ((one & at) << 1 | none | none << 1 | none_next << 1) & full
                two_next = ((two & at) << 1 | one | one << 1 | one_next << 1) & full if size > 7 else 0
                if none_next or one_next or two_next:
                    pending.append((child, none_next, one_next, two_next, depth + 1))
        return (best[3], best[0]) if best else None


@dataclass
class Scorer:
    """A lexicon with the words seen so far, and the weights of the features."""

    terms: dict[str, float]
    weights: list[float] = field(default_factory=list)
    exceptions: frozenset = frozenset()

    def __post_init__(self) -> None:
        self.trie = Trie(self.terms)
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def __reduce__(self):
        return Scorer, (self.terms, self.weights, self.exceptions)

    def found_in(self, words: list[str]) -> bool:
        if not self.terms:
            return False
        if len(self.hits) > 200_000:
            self.hits.clear()
        unknown = set(words) - self.clean
        if not unknown:
            return False
        if len(self.clean) > 1_000_000:
            self.clean.clear()
        hit = False
        for word in unknown:
            if word in self.hits:
                hit = True
            elif (match := self.matched(word)) is None:
                self.clean.add(word)
            else:
                self.hits[word] = match
                hit = True
        return hit

    def matched(self, word: str) -> tuple[str, int] | None:
        if word in self.terms:
            return word, 0
        if word in self.exceptions:
            return None
        return self.trie.match(word) if len(word) <= LONGEST_INEXACT else self.trie.stem_of(word)

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        words = _WORD.findall(text)
        if not self.found_in(words):
            return [0.0] * 6
        spans = [m.span() for m in _WORD.finditer(text)]
        exact = stems = misspelled = quoted = 0.0
        seen: Counter = Counter()
        for k, word in enumerate(words):
            if (match := self.hits.get(word)) is None:
                continue
            term, errors = match
            weight = self.terms[term]
            low, high = max(0, k - WINDOW), min(len(words), k + WINDOW + 1)
            before, after = text[spans[low][0]:spans[k][0]], text[spans[k][1]:spans[high - 1][1] + 1]
            around = words[low:k] + words[k + 1:high]
            is_quoted = (any(c in MARKS for c in before) and any(c in MARKS for c in after)) or not REPORTING.isdisjoint(words[low:k])
            if is_quoted:
                quoted += weight * 0.7 ** errors
                continue
            if not ADDRESS.isdisjoint(around):
                weight *= 1.3
            seen[term] += 1
            if errors:
                misspelled += weight * 0.7 ** errors
            elif term.endswith("*"):
                stems += weight
            else:
                exact += weight
        return [math.log1p(exact), math.log1p(stems), math.log1p(misspelled), math.log1p(quoted), math.log1p(len(seen)), 10 * sum(seen.values()) / (len(words) + 20)]

    def score(self, text: str | None) -> float:
        total = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def _sample(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int, held_out: int, steps: Steps) -> DataFrame:
    """(toxic, half, text) of at most ``fit_rows`` labelled rows, one of each family of near copies."""
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold_of(F.col("doc_id")) != held_out))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    # At most ``fit_rows`` rows of two numbers: a bounded side.
    chosen = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        cache = WordHashes()
        for doc_id, toxic, text in stream:
            shingles = shingle_hashes(cache.of((text or "").lower().encode("utf-8", "surrogatepass").split()), 4)
            family = int(shingles.min()) >> 1 if shingles.size else 0
            yield doc_id, toxic, family, text

    families = arrow_rows(chosen, ["doc_id", "toxic", "text"], run, "doc_id long, toxic int, family long, text string")
    one = families.groupBy("family", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    return steps.save(one.select("toxic", F.pmod(F.xxhash64("family"), F.lit(2)).cast("int").alias("half"), F.col("first.text").alias("text")), "sample")


def _term_counts(sample: DataFrame) -> DataFrame:
    """Rows of each half and label that hold a word, or a stem of one."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        counts: dict[str, list[int]] = {}
        for toxic, half, text in stream:
            words = {w for w in _WORD.findall((text or "").lower()) if len(w) >= 3}
            terms = words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
            for term in terms:
                counts.setdefault(term, [0, 0, 0, 0])[2 * half + toxic] += 1
            if len(counts) > 300_000:
                yield from ((term, *c) for term, c in counts.items())
                counts = {}
        yield from ((term, *c) for term, c in counts.items())

    partial = arrow_rows(sample, ["toxic", "half", "text"], run, "term string, n00 long, n01 long, n10 long, n11 long")
    return partial.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11")))


def _lexicon(counts: DataFrame, toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> dict[str, float]:
    if not n_toxic or not n_clean:
        return {}
    base = n_toxic / (n_toxic + n_clean)
    rows = counts.select("term", toxic.alias("p"), clean.alias("n")).where(F.col("p") >= MIN_ROWS)
    both = F.col("p") + F.col("n")
    rate = F.col("p") / both
    evidence = 2 * (F.col("p") * F.log(rate / base) + F.when(F.col("n") > 0, F.col("n") * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    lift = F.log((F.col("p") + 0.5) / (n_toxic + 1)) - F.log((F.col("n") + 0.5) / (n_clean + 1))
    best = rows.where((evidence >= MIN_EVIDENCE) & (lift > math.log(MIN_LIFT)))
    return {r.term: float(r.lift) for r in best.select("term", lift.alias("lift"), evidence.alias("evidence")).orderBy(F.desc("evidence"), "term").collect()}


def _exceptions(counts: DataFrame, lexicon: dict[str, float], toxic: Column, clean: Column) -> frozenset:
    """Words that match a term inexactly but stand in clean rows as often as in toxic ones."""
    trie = Trie(lexicon)

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        for term, n in stream:
            if not term.endswith("*") and term not in trie.weight and trie.match(term):
                yield term, n

    common = counts.select("term", toxic.alias("p"), clean.alias("n")).where((F.col("n") > 0) & (F.col("n") >= F.col("p")))
    near = arrow_rows(common, ["term", "n"], run, "term string, n long")
    return frozenset(r.term for r in near.select("term").collect())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic model by Newton steps; the first weight is the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    weights = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - penalty @ weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        weights += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS, held_out: int = 2) -> Scorer:
    steps = Steps(docs.sparkSession, "toxicity")
    sample = _sample(docs, labels, label, fit_rows, held_out, steps)
    sizes = {(r.half, r.toxic): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    n = {(h, t): sizes.get((h, t), 0) for h in (0, 1) for t in (0, 1)}
    if not (n[0, 1] + n[1, 1]) or not (n[0, 0] + n[1, 0]):
        steps.drop(sample)
        return Scorer({}, [math.log(0.1 / 0.9)] + [0.0] * 6)
    all_counts = steps.save(_term_counts(sample).where(F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11") > 1), "terms")
    counts = all_counts.where(F.col("n01") + F.col("n11") >= MIN_ROWS)
    c = F.col
    full = _lexicon(counts, c("n01") + c("n11"), c("n00") + c("n10"), n[0, 1] + n[1, 1], n[0, 0] + n[1, 0])
    halves = []
    for h in (0, 1):
        lexicon = _lexicon(counts, c(f"n{h}1"), c(f"n{h}0"), n[h, 1], n[h, 0])
        halves.append(Scorer(lexicon, [], _exceptions(all_counts, lexicon, c(f"n{h}1"), c(f"n{h}0"))))

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        for toxic, half, text in stream:
            yield toxic, halves[1 - half].features(text)

    rows = arrow_rows(sample, ["toxic", "half", "text"], run, "toxic int, x array<double>").collect()
    weights = _logistic(np.array([r.x for r in rows]), np.array([float(r.toxic) for r in rows]))
    # More of a hit never makes a text less toxic.
    if (weights[1:] < 0).any():
        used = np.flatnonzero(weights[1:] >= 0)
        partial = _logistic(np.array([r.x for r in rows])[:, used], np.array([float(r.toxic) for r in rows]))
        weights = np.zeros(7)
        weights[0], weights[1 + used] = partial[0], np.maximum(partial[1:], 0)
    exceptions = _exceptions(all_counts, full, c("n01") + c("n11"), c("n00") + c("n10"))
    steps.drop(sample, all_counts)
    return Scorer(full, [float(w) for w in weights], exceptions)


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document of (doc_id, text)."""

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        for doc_id, text in stream:
            yield doc_id, scorer.score(text)

    scored = arrow_rows(docs, ["doc_id", "text"], run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_of(scorer: Scorer):  # noqa: ANN201
    """A column function: the score of a text."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("double")
    def toxicity(text):  # noqa: ANN001, ANN202
        return text.map(scorer.score, na_action=None).astype("float64")

    return toxicity
