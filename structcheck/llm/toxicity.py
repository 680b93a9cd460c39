"""Toxicity of texts disguised by leetspeak, spacing and repetition.

Three steps. A character trigram model is counted over all documents. A Viterbi search restores each disguised word:
its lattice has, for each character, the character itself and the letters it may stand for, for a run of a letter one
or two of it or all, for marks and gaps within a word their deletion; each edge has a channel cost, and the path of the
best channel and trigram score is the restored word. A sign that stands for a letter takes part wherever it is in the
word; marks around a word that stand for none do not, nor do brackets that are closed later in the text. The restored text is then scored: word beginnings that mark toxic
texts are found by an Aho-Corasick automaton, and a logistic regression weighs their counts.

Words without a disguise (letters only, none twice running) have a lattice of one path and are left as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, lean

#: Classes of characters: 0 a gap, 1-26 a-z, 27-58 the small letters of Latin-1, then digit, mark, other letter.
DIGIT, MARK, OTHER, CLASSES = 59, 60, 61, 64
#: What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = frozenset(" .-_*~'^`,/\\#")
#: Log-probabilities of the channel.
SAME, STANDS_FOR, MARK_SAME, DELETED, GAP, COLLAPSED, HALVED = (float(np.log(p)) for p in (0.9, 0.05, 0.2, 0.1, 0.3, 0.3, 0.02))
#: Takes the place of a bracket that is closed later.
OPENED = "\ue000"
#: Marks around a word that stand for no letter.
EDGES = OPENED + ".,;:?\"')[]{}<>«»“”„…#%&*-_~"
SIGNS = "".join(c for c in LEET if not c.isdigit())
LETTER = rf"(?:[^\W_]|[{re.escape(SIGNS)}])"
SPACED = re.compile(rf"(?<!\S)([\"'(\[{{<«“„*#~]*)((?:{LETTER}[ .\-_*]{{1,3}}){{2,}}{LETTER})(?=[.,;:?!\"')\]}}>»”…*~]*(?!\S))")
BRACKETED = re.compile(r"(?<!\S)([\"'\[{<«“„*#~]*)\((?=[^()]*\))")
RUN = re.compile(r"([^\W\d_])\1")


def class_of(c: str) -> int:
    n = ord(c)
    if 97 <= n <= 122:
        return n - 96
    if 0xDF <= n <= 0xFE and n != 0xF7:
        return 27 + n - 0xDF
    if c.isspace():
        return 0
    return DIGIT if c.isdigit() else OTHER if c.isalpha() else MARK


TABLE = np.array([class_of(chr(i)) for i in range(0x250)], dtype=np.int32)
CELLS = CLASSES**3


def trigrams(text: str) -> np.ndarray:
    """The trigrams of a text's classes, as cell numbers; the text has a gap at each end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.empty(len(codes) + 3, dtype=np.int32)
    c[0] = c[1] = c[-1] = 0
    c[2:-1] = np.where(codes < len(TABLE), TABLE[np.minimum(codes, len(TABLE) - 1)], OTHER)
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all trigrams of all texts. The result has CELLS numbers, whatever the size of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            held: list[str] = []
            size = 0
            for x in b.column(0):
                t = x.as_py()
                if t:
                    held.append(t)
                    size += len(t)
                if size > 500_000:
                    total += np.bincount(trigrams(" ".join(held)), minlength=CELLS)
                    held, size = [], 0
            if held:
                total += np.bincount(trigrams(" ".join(held)), minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    rows = docs.select(F.col(text_col)).mapInArrow(lean(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS)
    counts[rows["cell"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    return counts


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of a class after two others: trigram counts, smoothed by bigrams and these by single classes."""
    c = counts.reshape(CLASSES, CLASSES, CLASSES)
    uni = c.sum((0, 1)) + 1.0
    uni /= uni.sum()
    bi = c.sum(0) + 20.0 * uni
    bi /= bi.sum(1, keepdims=True)
    tri = c + 20.0 * bi
    tri /= tri.sum(2, keepdims=True)
    return np.log(tri).astype(np.float32)


class Restorer:
    """Restores words and texts. Holds at most `limit` restored words."""

    def __init__(self, model: np.ndarray, limit: int = 200_000):
        self.model, self.limit = model.tolist(), limit
        self.known: dict[str, str] = {}

    def decode(self, seen: str) -> str:
        """The best path through the lattice of one word; gaps in `seen` may be kept or deleted."""
        model = self.model
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        i, n = 0, len(seen)
        while i < n:
            c = seen[i]
            run = 1
            while i + run < n and seen[i + run] == c:
                run += 1
            edges: list[tuple[str, float]]
            if c.isalpha():
                if run == 2:
                    edges = [(c * 2, SAME * 2), (c, HALVED)]
                elif run >= 3:
                    edges = [(c, COLLAPSED), (c * 2, COLLAPSED - 1.0), (c * run, SAME * run)]
                else:
                    run, edges = 1, [(c, SAME)]
            else:
                run = 1
                edges = [(c, GAP if c == " " else MARK_SAME)]
                edges += [(x, STANDS_FOR) for x in LEET.get(c, "")]
                if c in SEPARATORS and 0 < i < n - 1:
                    edges.append(("", DELETED if c != " " else GAP))
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in best.items():
                for out, cost in edges:
                    x, y, s = a, b, score + cost
                    for o in out:
                        k = class_of(o)
                        s += model[x][y][k]
                        x, y = y, k
                    held = after.get((x, y))
                    if held is None or s > held[0]:
                        after[x, y] = (s, (path, out))
            best = after
            i += run
        score, path = max((s + model[x][y][0], p) for (x, y), (s, p) in best.items())
        parts: list[str] = []
        while path:
            path, out = path
            parts.append(out)
        return "".join(reversed(parts))

    def word(self, w: str) -> str:
        known = self.known.get(w)
        if known is not None:
            return known
        core = w.strip(EDGES)
        out = w
        if core and not (core.isalpha() and not RUN.search(core)) and any(c.isalpha() for c in core):
            out = w.replace(core, self.decode(core), 1)
        if len(self.known) >= self.limit:
            self.known.clear()
        self.known[w] = out
        return out

    def joined(self, m: re.Match) -> str:
        """A spaced word restored; signs alone, as of a sum, are left as they are."""
        seen = m[2]
        if not any(c.isalpha() for c in seen) and any(c in SIGNS for c in seen):
            return m[0]
        return m[1] + self.decode(re.sub(r"[ .\-_*]+", " ", seen))

    def text(self, text: str) -> str:
        """The text in small letters with each word restored and one space between words."""
        lowered = text.lower()
        if "(" in lowered:
            lowered = BRACKETED.sub(rf"\1{OPENED}", lowered)
        word = self.word
        return " ".join([word(w) for w in SPACED.sub(self.joined, lowered).split()]).replace(OPENED, "(")


class Model(NamedTuple):
    """What scoring needs: the language model, the features, their weights (bias, sum of hits, then each)."""

    language: np.ndarray
    features: list[str]
    weights: np.ndarray


class Scorer:
    def __init__(self, model: Model):
        import ahocorasick

        self.restorer, self.weights, self.n = Restorer(model.language), model.weights, len(model.features)
        self.automaton = ahocorasick.Automaton()
        for i, f in enumerate(model.features):
            self.automaton.add_word(f, i)
        if model.features:
            self.automaton.make_automaton()

    def row(self, restored: str) -> np.ndarray:
        """1, the logarithm of the count of marked word places, and for each feature its count up to four."""
        x = np.zeros(self.n + 2)
        x[0] = 1.0
        if self.n:
            places: set[int] = set()
            padded = f" {strip_marks(restored)} "
            for end, i in self.automaton.iter(padded):
                x[i + 2] = min(4.0, x[i + 2] + 1)
                places.add(padded.rfind(" ", 0, end))
            x[1] = np.log1p(len(places))
        return x

    def __call__(self, text: str | None) -> tuple[str, float]:
        restored = self.restorer.text(text or "")
        return restored, float(1 / (1 + np.exp(-np.clip(self.row(restored) @ self.weights, -35, 35))))


def strip_marks(restored: str) -> str:
    """Spaces for the marks before words, so that a word's beginning follows a space."""
    return restored.translate(OPENERS)


OPENERS = str.maketrans({c: " " for c in "\"'([{<«“„*#_~|"})


def choose(texts: list[str], labels: list[int], most: int = 300, least: int = 5) -> list[str]:
    """Word beginnings of 3 to 8 letters that far more toxic texts have than others, at most `most` of them."""
    pos: Counter = Counter()
    neg: Counter = Counter()
    for t, y in zip(texts, labels):
        starts = {f" {w[:n]}" for w in set(strip_marks(t).split()) for n in range(3, min(8, len(w)) + 1)}
        (pos if y else neg).update(starts)
    n_pos, n_neg = sum(labels), len(labels) - sum(labels)
    scored = []
    for f, k in pos.items():
        odds = np.log((k + 0.5) / (n_pos + 1)) - np.log((neg[f] + 0.5) / (n_neg + 1))
        if k >= least and odds > 1.5:
            scored.append((-(k * odds), f))
    return [f for _, f in sorted(scored)[:most]]


def fit(language: np.ndarray, texts: list[str], labels: list[int], ridge: float = 0.3) -> Model:
    """Features and weights from labelled texts; with labels of one kind only, every text scores near that label's rate."""
    restorer = Restorer(language)
    restored = [restorer.text(t) for t in texts]
    both = 0 < sum(labels) < len(labels)
    features = choose(restored, labels) if both else []
    weights = np.zeros(len(features) + 2)
    rate = (sum(labels) + 0.5) / (len(labels) + 1)
    weights[0] = np.log(rate / (1 - rate))
    if both:
        scorer = Scorer(Model(language, features, weights))
        x = np.array([scorer.row(t) for t in restored])
        y = np.array(labels, dtype=float)
        penalty = np.full(x.shape[1], ridge)
        penalty[:2] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -35, 35)))
            grad = x.T @ (p - y) + penalty * weights
            hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
            step = np.linalg.solve(hess, grad)
            weights -= step
            if np.abs(step).max() < 1e-6:
                break
    return Model(language, features, weights)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 4000, longest: int = 65_536) -> Model:
    """Counts the language model over all of `docs` and fits the classifier on at most `sample` labelled rows.

    The sample is the labelled ids of least hash, of texts up to `longest` bytes: a bound on what the driver holds.
    Rows with a null id or label are no examples; an id labelled twice has its greatest label.
    """
    spark = docs.sparkSession
    language = language_model(count_trigrams(docs, text_col))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()
    if not picked:
        return fit(language, [], [])
    chosen = F.broadcast(spark.createDataFrame(picked, known.schema))  # at most `sample` rows
    rows = docs.select(F.col(id_col), F.col(text_col).alias("t")).filter(F.octet_length("t") <= longest).join(chosen, id_col).orderBy(F.xxhash64(id_col, "t")).limit(sample)
    found = rows.select("t", "y").toPandas()
    return fit(language, found["t"].tolist(), found["y"].astype(int).tolist())


def score(docs: DataFrame, model: Model, text_col: str = "text", restored_col: str | None = None, score_col: str = "score") -> DataFrame:
    """`docs` with the score of each text, and the restored text if `restored_col` names a column for it.

    Columns of those names, in small or capital letters, are replaced. A null text scores as an empty one; an empty table
    stays empty. One pass, nothing is shuffled.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(model))  # trigram cells and at most 300 features
    added = [*([restored_col] if restored_col else []), score_col]
    kept = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    at = next((i for i, c in enumerate(kept) if c.lower() == text_col.lower()), len(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for whole in batches:
            for first in range(0, len(whole), 500):
                b = whole.slice(first, 500)
                out = [scorer(x.as_py()) for x in b.column(at)]
                extra = [*([pa.array([r for r, _ in out], pa.string())] if restored_col else []), pa.array([s for _, s in out], pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *extra], [*b.schema.names[: len(kept)], *added])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    if restored_col:
        schema = schema.add(restored_col, "string")
    text = [F.col(f"`{text_col}`").alias(free_name(docs, "text"))] if at == len(kept) else []
    given = docs.select(*[F.col(f"`{c}`") for c in kept], *text)
    return given.mapInArrow(lean(run), schema.add(score_col, "double"))
