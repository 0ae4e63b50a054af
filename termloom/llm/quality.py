"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a fixed set of numbers (shares of character classes, repetition of words, lines and shingles, lengths,
word statistics). Each number falls into one of at most 32 quantile bins. Shallow trees are boosted in cycles: every
round visits the features in turn, fits one small tree of that feature to the gradient of the logistic loss and adds its
leaves, times a learning rate, to the feature's lookup table. Then the pairs whose binned residuals promise the greatest
gain get two-dimensional tables, boosted the same way by trees that split on both. Early stopping uses a part of the
learning rows. A score is a constant plus one lookup a feature and one a pair: vectorised additions of bins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import labelled_sample

#: Labelled rows of the sample at most.
SAMPLE_ROWS = 16_000
THRESHOLD = 0.3
BINS = 32
PAIR_BINS = 8
PAIRS = 10

FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "distinct_words", "commonest_word", "repeated_next",
    "distinct_trigrams", "lines", "line_length", "distinct_lines", "repeated_line_chars", "upper", "digits", "blanks",
    "punctuation", "symbols", "exclamations", "non_ascii", "upper_words", "symbol_words", "long_words", "short_words",
    "sentence_ends", "capital_sentences", "end_mark", "commonest_lines", "links", "brackets", "entropy",
)

_CLASSES = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = 6 if _b >= 128 else 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 4 if _c.isspace() or _b < 32 else 5
_LINKS = re.compile(r"https?://|www\.|@")
_SENTENCE = re.compile(r"[.!?]\s+(\S)")


def features_of(text: str) -> list[float]:
    """The numbers of one whole text; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASSES, weights=by_byte, minlength=7) / len(raw)
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    ids: dict[str, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    commonest = np.bincount(seq).max() / n if words else 0.0
    next_same = float((seq[1:] == seq[:-1]).mean()) if len(seq) > 1 else 0.0
    if len(seq) > 2:
        keys = (seq[2:] * 1_000_003 + seq[1:-1]) * 1_000_003 + seq[:-2]
        trigrams = len(np.unique(keys)) / len(keys)
    else:
        trigrams = 1.0
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for x in lines:
        counts[x] = counts.get(x, 0) + 1
    chars = max(1, sum(map(len, lines)))
    repeated = sum(len(x) * (c - 1) for x, c in counts.items()) / chars
    starts = _SENTENCE.findall(text)
    share = by_byte[by_byte > 0] / len(raw)
    symbols = sum(int(by_byte[ord(c)]) for c in "#$%&*@^_|~<>=+\\/") / len(raw)
    distinct = [w for w in ids if not w.isalnum()]
    odd = sum(1 for w in distinct if sum(not c.isalnum() for c in w) >= 2)
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), len(ids) / n, commonest, next_same,
        trigrams, np.log1p(len(lines)), np.log1p(chars / max(1, len(lines))), len(counts) / max(1, len(lines)), repeated, kinds[1], kinds[3], kinds[4],
        kinds[5], symbols, by_byte[33] / len(raw), kinds[6], sum(1 for w in ids if w.isupper() and len(w) > 1) / max(1, len(ids)), odd / max(1, len(ids)),
        float((lengths > 15).mean()), float((lengths < 3).mean()), 100 * (by_byte[46] + by_byte[33] + by_byte[63]) / n / 100, sum(map(str.isupper, starts)) / max(1, len(starts)),
        float(text.rstrip()[-1:] in ".!?\"'"), max(counts.values(), default=0) / max(1, len(lines)), len(_LINKS.findall(text)) / n, (by_byte[91] + by_byte[123] + by_byte[40] + by_byte[60]) / n,
        float(-(share * np.log2(share)).sum()),
    ]


def feature_matrix(texts: list[str]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)  # per feature, ascending cut points
    tables: list[np.ndarray] = field(default_factory=list)  # per feature, a value for each bin
    pair_edges: list[np.ndarray] = field(default_factory=list)  # coarser cuts for pairs
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[coarse[a], coarse[b]]
        return _sigmoid(z)


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < least) | (hr < least)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, ridge: float = 1.0, least: float = 0.5) -> np.ndarray:
    """A tree on one binned feature from its gradients and curvatures by bin; returns the step for each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b], ridge, least), i) for i, (a, b) in enumerate(parts)]
        gain, at, i = max(cuts, key=lambda c: c[0])
        if gain <= 1e-9:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0, least: float = 0.5) -> tuple[float, np.ndarray]:
    """A cut of one feature, then one of the other on either side, in the better order; gain and step for each cell."""
    best, step = 0.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            total, out = -g.sum() ** 2 / (h.sum() + ridge), np.zeros_like(gg)
            for rows in (slice(0, cut), slice(cut, None)):
                gs, hs = gg[rows].sum(0), hh[rows].sum(0)
                gain, at = _best_cut(gs, hs, ridge, least)
                total += max(gain, 0.0) + gs.sum() ** 2 / (hs.sum() + ridge)
                for cols in (slice(0, at), slice(at, None)) if gain > 1e-9 else (slice(None),):
                    out[rows, cols] = -gs[cols].sum() / (hs[cols].sum() + ridge)
            if total > best:
                best, step = total, out.T if flip else out
    return best, step


def fit_model(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1, patience: int = 12) -> Model:
    """Boost the features' tables, then the pairs'. Every fifth row stops the rounds early and isn't fitted to."""
    if not len(y) or y.min() == y.max():
        return Model(intercept=30.0 if len(y) and y[0] == 1 else -30.0)
    watch = np.arange(len(y)) % 5 == 4
    if not (y[~watch].min() < y[~watch].max()):
        watch[:] = False
    learn = ~watch
    m = Model(intercept=float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    m.edges = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    m.pair_edges = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(m.edges[j], x[:, j], side="right") for j in range(x.shape[1])]
    coarse = [np.searchsorted(m.pair_edges[j], x[:, j], side="right") for j in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    z = np.full(len(y), m.intercept)

    def loss() -> float:
        rows = watch if watch.any() else learn
        return float(np.logaddexp(0, z[rows]).mean() - (y[rows] * z[rows]).mean())

    def boosted(tables: list[np.ndarray], places: list[np.ndarray], tree, turns: int) -> None:
        nonlocal z
        best, kept, since = loss(), [t.copy() for t in tables], 0
        for _ in range(turns):
            for table, place in zip(tables, places, strict=True):  # in cycles, each feature or pair in turn
                p = _sigmoid(z[learn])
                g = np.bincount(place[learn], weights=p - y[learn], minlength=table.size).reshape(table.shape)
                h = np.bincount(place[learn], weights=p * (1 - p), minlength=table.size).reshape(table.shape)
                step = rate * tree(g, h)
                table += step
                z += step.ravel()[place]
            if (now := loss()) < best - 1e-6:
                best, kept, since = now, [t.copy() for t in tables], 0
            elif (since := since + 1) >= patience:
                break
        for table, old, place in zip(tables, kept, places, strict=True):
            z += (old - table).ravel()[place]
            table[...] = old

    boosted(m.tables, bins, shallow_tree, rounds)
    p = _sigmoid(z[learn])
    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            shape = len(m.pair_edges[a]) + 1, len(m.pair_edges[b]) + 1
            if 1 in shape:
                continue
            place = coarse[a][learn] * shape[1] + coarse[b][learn]
            g = np.bincount(place, weights=p - y[learn], minlength=shape[0] * shape[1]).reshape(shape)
            h = np.bincount(place, weights=p * (1 - p), minlength=shape[0] * shape[1]).reshape(shape)
            gains.append((pair_tree(g, h)[0], -a, -b))
    m.pairs = [(-a, -b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    m.pair_tables = [np.zeros((len(m.pair_edges[a]) + 1, len(m.pair_edges[b]) + 1)) for a, b in m.pairs]
    places = [coarse[a] * (len(m.pair_edges[b]) + 1) + coarse[b] for a, b in m.pairs]
    boosted(m.pair_tables, places, lambda g, h: pair_tree(g, h)[1], pair_rounds)
    return m


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``labels`` (doc_id, the label column), all of which may be learned from.

    The driver gets the numbers of at most ``rows`` sampled texts (some 4 MB), never the texts. Without labels of both
    classes the model gives every text the only class, 0 if there is none.
    """
    common.prepare(docs.sparkSession)

    def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            x = feature_matrix(common.texts_of(batch))
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = labelled_sample(docs, labels, column, rows).mapInArrow(_numbers, "label int, x binary").collect()
    got.sort(key=lambda g: (bytes(g.x), g.label))
    got = [got[i] for i in np.random.default_rng(7).permutation(len(got))]
    x = np.array([np.frombuffer(g.x) for g in got], dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit_model(x, np.array([g.label for g in got], dtype=np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row; a null text counts as empty. Extra columns of ``docs`` are ignored."""
    common.prepare(docs.sparkSession)

    def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            found = model.score(feature_matrix(common.texts_of(batch)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(found, pa.float64())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score, "doc_id long, score double")


def predict(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; learned from labels outside the held-out fold.

    An id that is labelled more than once has its greatest label. Repeated rows give repeated rows, an empty table none.
    """
    model = fit(docs, labels.filter(common.fold(folds) != held))
    return score(docs, model).select("doc_id", (common.fold(folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
