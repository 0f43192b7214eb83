"""Quality by Bradley-Terry pairwise ranking.

Every text gets a few shape features (length, case, symbols, repetition, lines). The preferences of
every labelled good text before every labelled bad one train a linear score by logistic loss on the
difference of the two texts' features; so the score is the log of a Bradley-Terry strength. The
threshold is a quantile of the labelled rows' scores, the share of bad ones among them. Scores are
given from 0 to 1, so that `cut` stands for that threshold.

All labelled rows and all their pairs count, and no row reaches the driver. A pair's loss depends on
the difference of its two scores only, so sums over pairs follow from sums over rows by class and
place on a grid of scores, a row parted between the two places around its score (by this the loss's
slope is wrong by 1e-4 at most). Each Newton step is one pass over the labelled rows' features; the
quantile is selected exactly, by 16 bits of the scores a pass. All sums are of whole numbers, so a
model depends on no order, batch or partition.

Edge cases: a null or empty text has zero features and a score like any other; labels that are null
or of unknown ids count for nothing; a text labelled more than once takes its lowest label; without
labels of both kinds all scores are `cut` (no evidence against a text); repeated rows get equal
results, and each of them counts; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnspan.session import cut as checkpointed

from .batches import add_columns, counted
from .textnum import SOLID, Words, column_bytes, slices, windows

CUT = 0.3
GRID = 16  # places a unit of score
PART_ROWS = 100_000  # labelled rows' features in a partition
_ONE = 2.0**24  # what stands for 1 in sums
FEATURES = (
    "log_words", "word_bytes", "capitals", "digits", "symbols", "bangs", "points", "letterless_words",
    "repeated_neighbours", "repeated_words", "repeated_triples", "repeated_lines", "lines_per_word", "long_words",
)

_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[0x41:0x5B] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[0x30:0x3A] = 1
_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = 1
_LETTER[0x80:] = 1
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>=~^_\\{}[]@+/"]] = 1


@dataclass(frozen=True)
class RankModel:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float
    spread: float
    cut: float


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _repeats(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many values of each text equal an earlier one of it."""
    if not len(h):
        return np.zeros(n, np.int64)
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][1:][same], minlength=n)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, FEATURES); fractions go through a square root, which spreads small ones."""
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    for i, j in slices(offs, 3_000_000):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        if not len(d):
            continue
        w = Words(d, o, SOLID)
        h, m = w.hashes(), j - i
        counts = np.diff(w.off)
        text = np.repeat(np.arange(m), counts)
        words, size = np.maximum(counts, 1), np.maximum(np.diff(o), 1)
        letters = np.maximum(_sums(_LETTER[d], o), 1)
        solid = np.maximum(_sums(w.end - w.start, w.off), 1)
        lettered = np.concatenate([[0], np.cumsum(_LETTER[d])])
        neighbours = np.zeros(len(h), bool)
        neighbours[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        triple, begin = windows(h, w.off, 3)
        lines = Words(d, o, _NOT_NEWLINE)
        n_lines = np.diff(lines.off)
        line_text = np.repeat(np.arange(m), n_lines)
        f = np.stack(
            [
                np.log1p(counts),
                solid / words,
                _sums(_UPPER[d], o) / letters,
                _sums(_DIGIT[d], o) / size,
                _sums(_SYMBOL[d], o) / words,
                _sums(d == 0x21, o) / words,
                _sums((d == 0x2E) | (d == 0x2C), o) / words,
                _sums(lettered[w.end] == lettered[w.start], w.off) / words,
                _sums(neighbours, w.off) / words,
                _repeats(h, text, m) / words,
                _repeats(triple, text[begin], m) / words,
                _repeats(lines.hashes(), line_text, m) / np.maximum(n_lines, 1),
                n_lines / words,
                _sums(w.end - w.start > 24, w.off) / words,
            ],
            axis=1,
        )
        f[:, 2:] = np.sqrt(f[:, 2:])
        out[i:j] = f
    return out


_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[0x0A] = False


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


Kernel = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Sums = Callable[[Callable[[], Kernel]], tuple[np.ndarray, np.ndarray]]


def _strengths(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (np.clip((x - mean) / scale, -6, 6) * weights).sum(axis=1)  # not by @, whose last bits depend on the batch


def _rows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels from the bytes of rows of (label, features)."""
    rows = np.frombuffer(data.tobytes(), dtype=np.float64).reshape(-1, 1 + len(FEATURES))
    return rows[:, 1:], rows[:, 0]


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of whole values by key."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))[: len(keys)]
    return keys[order][first], np.add.reduceat(values[order], first, axis=0) if len(first) else values


def _whole(values: np.ndarray) -> np.ndarray:
    return np.rint(values * _ONE).astype(np.int64)


def _moments(read: Callable[[np.ndarray], np.ndarray]) -> Callable[[], Kernel]:
    """Sums of what read() makes of a batch (a column for each value) and of its squares; each in two
    parts, as a square of up to 2^62 must fit beside a millionth."""

    def kernel(data: np.ndarray, offs: np.ndarray):
        v = read(data)
        v = np.concatenate([v, v * v], axis=1)
        high = np.floor(v / 2**20)
        sums = np.concatenate([high.astype(np.int64).sum(axis=0), _whole(v - high * 2**20).sum(axis=0), [len(v)]])
        return np.arange(len(sums)), sums

    return lambda: kernel


def _mean_and_std(sums: Sums, read: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[int, np.ndarray, np.ndarray]:
    total = np.zeros(4 * width + 1)
    keys, n = sums(_moments(read))
    total[keys] = n
    rows = int(total[-1])
    if not rows:
        return 0, np.zeros(width), np.ones(width)
    first, second = ((total[: 2 * width] * 2**20 + total[2 * width : -1] / _ONE) / rows).reshape(2, width)
    return rows, first, np.sqrt(np.maximum(second - first * first, 0))


def _placed(mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> Callable[[], Kernel]:
    """By place of the grid and class, whole sums of: the rows' shares, their features times these, and
    products of two features (a row's at its lower place). A key is (place, class, which sum)."""
    upper = np.triu_indices(len(FEATURES))
    width = 1 + len(FEATURES) + len(upper[0])

    def kernel(data: np.ndarray, offs: np.ndarray):
        x, y = _rows(data)
        x, y = x[(y == 0) | (y == 1)], y[(y == 0) | (y == 1)].astype(np.int64)
        if not len(y):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        z = np.clip((x - mean) / scale, -6, 6)
        at = _strengths(x, mean, scale, weights) * GRID
        low = np.floor(at)
        keys, values = [], []
        for place, share, products in ((low, 1 - (at - low), 1), (low + 1, at - low, 0)):
            v = _whole(np.concatenate([share[:, None], share[:, None] * z, products * z[:, upper[0]] * z[:, upper[1]]], axis=1))
            k, v = _grouped(place.astype(np.int64) * 2 + y, v)
            keys.append((k[:, None] * width + np.arange(width)).ravel())
            values.append(v.ravel())
        keys, values = np.concatenate(keys), np.concatenate(values)
        return keys[values != 0], values[values != 0]

    return lambda: kernel


def _newton(keys: np.ndarray, sums: np.ndarray, pairs: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean gradient and Hessian of all pairs' log likelihood, from the sums of _placed."""
    f = len(FEATURES)
    upper = np.triu_indices(f)
    width = 1 + f + len(upper[0])
    least = int(keys.min()) // (2 * width)
    table = np.zeros((int(keys.max()) // (2 * width) - least + 1, 2, width))
    table.reshape(-1)[keys - least * 2 * width] = sums / _ONE
    bad, good = table[:, 0], table[:, 1]
    gradient, cross = np.zeros(f), np.zeros((f, f))
    own = np.zeros((2, len(upper[0])))
    k = len(table)
    # Whether a bad text wins against a good one, by the difference of their places.
    lost = _logistic(np.arange(k - 1, -k, -1) / GRID)
    for i in range(0, k, 512):
        p = lost[(np.arange(i, min(i + 512, k))[:, None] - np.arange(k)) + k - 1]
        g = good[i : i + 512]
        gradient += g[:, 1 : 1 + f].T @ (p @ bad[:, 0]) - (g[:, 0] @ p) @ bad[:, 1 : 1 + f]
        h = p * (1 - p)
        cross += g[:, 1 : 1 + f].T @ (h @ bad[:, 1 : 1 + f])
        own[1] += (h @ bad[:, 0]) @ g[:, 1 + f :]
        own[0] += (g[:, 0] @ h) @ bad[:, 1 + f :]
    hessian = np.zeros((f, f))
    hessian[upper] = own.sum(axis=0)
    hessian = hessian + np.triu(hessian, 1).T - cross - cross.T
    return gradient / pairs, hessian / pairs


def _order_statistics(sums: Sums, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, ranks: list[int]) -> list[float]:
    """The strengths of these ranks, from 0, among all rows."""
    found = [(0, rank) for rank in ranks]  # the leading bits, and the rank among the rows that have them
    for shift in (48, 32, 16, 0):
        known = np.unique([bits for bits, _ in found])

        def kernel(data: np.ndarray, offs: np.ndarray):
            bits = _strengths(_rows(data)[0], mean, scale, weights).view(np.int64)
            code = np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)  # in the order of the numbers
            code = code[np.isin(code >> np.uint64(shift + 16), known.astype(np.uint64))] if shift < 48 else code
            keys, n = np.unique(code >> np.uint64(shift), return_counts=True)
            return keys.view(np.int64), n

        keys, n = sums(lambda: kernel)
        keys = keys.astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        for i, (bits, rank) in enumerate(found):
            here = (keys >> np.uint64(16)) == np.uint64(bits) if shift < 48 else np.ones(len(keys), bool)
            ends = np.cumsum(n[here])
            j = int(np.searchsorted(ends, rank, side="right"))
            found[i] = (int(keys[here][j]), rank - int(ends[j] - n[here][j]))
    codes = np.array([bits for bits, _ in found], dtype=np.uint64).view(np.int64)
    return np.where(codes < 0, codes ^ np.int64(-(2**63)), ~codes).view(np.float64).tolist()


def _learn(sums: Sums, penalty: float = 1e-2, cut: float = CUT) -> RankModel:
    """Fits the strengths by Newton steps. sums() gives the sums by key of what a kernel makes of all rows."""
    f = len(FEATURES)

    def features_and_classes(data: np.ndarray) -> np.ndarray:
        x, y = _rows(data)
        return np.concatenate([x, (y == 0)[:, None], (y == 1)[:, None]], axis=1)

    rows, mean, std = _mean_and_std(sums, features_and_classes, f + 2)
    bad, good = (int(round(share * rows)) for share in mean[f:])
    mean, scale = mean[:f], std[:f] + 1e-6 if rows else std[:f]
    if not good or not bad:
        return RankModel(np.zeros(f), mean, scale, 0.0, 1.0, cut)
    w = np.zeros(f)
    for _ in range(25):
        gradient, hessian = _newton(*sums(_placed(mean, scale, w)), float(good) * bad)
        step = np.linalg.solve(hessian + penalty * np.eye(f), gradient - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    at = min(max(bad, 1), rows - 1)
    threshold = sum(_order_statistics(sums, mean, scale, w, [at - 1, at])) / 2
    _, _, std = _mean_and_std(sums, lambda data: np.abs(_strengths(_rows(data)[0], mean, scale, w) + 6 * np.abs(w).sum())[:, None], 1)
    return RankModel(w, mean, scale, threshold, float(max(std[0] / 2, 1e-6)), cut)


def learn(x: np.ndarray, y: np.ndarray, **options) -> RankModel:
    """The model of these features and labels (0 or 1)."""
    data = np.concatenate([np.asarray(y, np.float64).reshape(-1, 1), np.asarray(x, np.float64).reshape(-1, len(FEATURES))], axis=1)
    return _learn(lambda make: _grouped(*make()(data.reshape(-1).view(np.uint8), np.arange(len(data) + 1))), **options)


def described(docs: DataFrame, text_col: str = "text", name: str = "x", keep: list[str] | None = None) -> DataFrame:
    """`docs` with the bytes of each text's features, for fit() and score()."""
    return add_columns(docs, text_col, _make_features, [T.StructField(name, T.BinaryType())], keep)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", x_col: str | None = None, **options) -> RankModel:
    """Learns from all rows of `docs` that `labels` (id, 0 or 1) names; pass only training rows.
    x_col: a column that described() has made, in the place of the text."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).filter("id is not null and label is not null")
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    if x_col is None:
        x_col = "x"
        docs = described(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), name="x", keep=["id"]).withColumnRenamed("id", id_col)
    joined = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{x_col}`").alias("x")).join(known, "id").select("label", "x")
    rows = checkpointed(joined.mapInArrow(_labelled, "x binary"))
    rows = rows.coalesce(rows.count() // PART_ROWS + 1)

    def sums(make: Callable[[], Kernel]) -> tuple[np.ndarray, np.ndarray]:
        got = counted(rows, "x", make).toArrow()
        return got.column("k").to_numpy(), got.column("n").to_numpy()

    return _learn(sums, **options)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, x) to the bytes of both."""
    for batch in batches:
        x = np.frombuffer(column_bytes(batch.column(1))[0].tobytes(), dtype=np.float64).reshape(-1, len(FEATURES))
        rows = np.concatenate([batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)[:, None], x], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["x"])


def _make_features():
    return lambda data, offs: [[v.tobytes() for v in features(data, offs)]]


def score(docs: DataFrame, model: RankModel, text_col: str = "text", prefix: str = "", keep: list[str] | None = None, x_col: str | None = None) -> DataFrame:
    """`docs` with {prefix}score (0 to 1, higher: better) and {prefix}strength (the raw score).
    x_col: a column that described() has made, in the place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m: RankModel = shared.value
        offset = np.log(m.cut / (1 - m.cut))

        def scores(data: np.ndarray, offs: np.ndarray):
            x = features(data, offs) if x_col is None else np.frombuffer(data.tobytes(), dtype=np.float64).reshape(-1, len(FEATURES))
            raw = _strengths(x, m.mean, m.scale, m.weights)
            return [_logistic((raw - m.threshold) / m.spread + offset), raw]

        return scores

    return add_columns(docs, x_col or text_col, make, [T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}strength", T.DoubleType())], keep)
