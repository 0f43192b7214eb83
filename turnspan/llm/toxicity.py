"""Toxicity by the nearest labelled examples.

A text is a TF-IDF vector over its lower-cased words. Every word of the labelled examples is indexed,
and document frequencies of these come from all documents; any other word of a text adds to the text's
norm, as one of a single document. Words that lean to the toxic side weigh more, by the root of their
chi-square; none is left out.

The index holds the most common words as dense blocks of examples, each with its largest weights (block
maxima), and the others as postings. A text's products with the postings are exact; with the maxima
they bound what any example of a block can reach, and a block is opened only where that is not below
the `neighbours`-th best product so far. What is found is computed again in double precision, so the
cosines are exact. The neighbours vote with weights that fall with their distance, and the nearest
examples are the evidence. A logistic curve makes the vote a score; it is fitted on labelled texts that
are held apart: they are not in the index and have no part in its words and weights.

The labelled texts are a bounded sample, `examples` of them for the index and `calibration` for the
curve, half of either from the rarer class if it has so many; the curve weighs them back to the
classes' true shares. Everything else covers all data.

Edge cases: a null or empty text, or one without any word of the examples, is no neighbour of any
example: its vote is the share of toxic examples; labels that are null or of unknown ids count for
nothing; a text labelled more than once takes its highest label; without labels all scores are 0; ties
among neighbours go to the earlier example; repeated rows get equal results; other columns are kept,
whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnspan.session import cut

from .batches import add_columns, free, sampled, small_batches
from .textnum import ALNUM, Words, column_bytes, slices

EXAMPLES = 10_000  # labelled texts in the index
CALIBRATION = 2_500  # other labelled texts, which fit the logistic curve
NEIGHBOURS = 15
BLOCK = 64
SLICE = 1_000_000  # bytes of texts whose words are counted at once
PACK = 512  # examples packed together
DENSE = 1024  # words held as dense blocks; the others are postings
QUERIES = 64  # texts searched together
OPENED = 8  # blocks opened together
ROUNDING = 1e-5  # more than single precision loses in a product
LEANING = 1.0  # how much the root of chi-square adds to the weight of a word
EVIDENCE = 3


def word_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, words, counts) of each text's distinct words, sorted by text and word."""
    w = Words(data, offs, ALNUM, fold=True)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(w.off))
    own, word = np.unique(w.hashes(), return_inverse=True)
    text, word, count = _grouped(text, word, np.ones(len(word), np.int64))
    return text, own[word], count


def _grouped(t: np.ndarray, f: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (t, f), sorted, and the sums of their c; t and f are small numbers."""
    if not len(f):
        return t, f, c
    key = t * (int(f.max()) + 1) + f
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return t[order[first]], f[order[first]], np.add.reduceat(c[order], first)


def find(vocabulary: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The indexes of words in the sorted vocabulary; -1: not there."""
    if not len(vocabulary):
        return np.full(len(features), -1)
    own, back = np.unique(features, return_inverse=True)
    at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
    return np.where(vocabulary[at] == own, at, -1)[back]


def _spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of all spans, one span after the other."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


@dataclass
class BlockMaxIndex:
    """Normalised sparse example vectors in blocks of `BLOCK` examples.

    They are kept and sent as packed terms and counts (see pack); the vectors, and what a search needs
    besides, are made at the first search.
    """

    ids: list
    labels: np.ndarray
    off: np.ndarray
    term: np.ndarray | None = None
    weight: np.ndarray | None = None
    packs: list[tuple[bytes, bytes]] = field(default_factory=list)
    scale: np.ndarray | None = None
    made: dict = field(default_factory=dict)

    @classmethod
    def build(cls, ids: list, labels: np.ndarray, example: np.ndarray, term: np.ndarray, weight: np.ndarray) -> BlockMaxIndex:
        order = np.lexsort((term, example))
        return cls(ids, labels, np.searchsorted(example[order], np.arange(len(ids) + 1)), term[order].astype(np.int32), weight[order].astype(np.float32))

    @classmethod
    def pack(cls, ids: list, labels: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], scale: np.ndarray) -> BlockMaxIndex:
        """The index of examples by their sorted terms and these' counts (int32).
        Steps between terms are written byte by byte of their four, which packs them well."""
        packs, off = [], np.cumsum([0, *[len(t) for t in terms]])
        for a in range(0, len(ids), PACK):
            step = np.diff(np.concatenate(terms[a : a + PACK]), prepend=np.int32(0))
            planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T)
            packs.append((zlib.compress(planes.tobytes(), 1), zlib.compress(np.concatenate(counts[a : a + PACK]).tobytes(), 1)))
        return cls(ids, labels, off, packs=packs, scale=scale)

    def open(self) -> BlockMaxIndex:
        """Makes the vectors, where they are packed."""
        if self.term is None:
            self.term, self.weight = np.zeros(self.off[-1], np.int32), np.zeros(self.off[-1], np.float32)
            for k, (t, c) in enumerate(self.packs):
                off = self.off[k * PACK : (k + 1) * PACK + 1]
                step = np.ascontiguousarray(np.frombuffer(zlib.decompress(t), np.uint8).reshape(4, -1).T).view(np.int32)
                term = np.cumsum(step, dtype=np.int32)
                count = np.frombuffer(zlib.decompress(c), np.int32)
                self.term[off[0] : off[-1]] = term
                self.weight[off[0] : off[-1]] = weigh(np.repeat(np.arange(len(off) - 1), np.diff(off)), term, count, self.scale, 0.0, len(off) - 1)
        return self

    def sent(self, spark: SparkSession):
        """The index as a broadcast, made once."""
        if "sent" not in self.made:
            self.made["sent"] = spark.sparkContext.broadcast(self)
        return self.made["sent"]

    def __getstate__(self):
        packed = {"term": None, "weight": None} if self.packs else {}
        return {**self.__dict__, **packed, "made": {}}

    def _make(self) -> dict:
        if "query" not in self.made:
            self.open()
            n, size = len(self.ids), int(self.term.max()) + 1 if len(self.term) else 0
            count = np.bincount(self.term, minlength=size)
            column = np.full(size, -1, np.int32)
            common = np.argsort(-count, kind="stable")[:DENSE]
            column[common] = np.arange(len(common))
            blocks = (n + BLOCK - 1) // BLOCK
            dense = np.zeros((blocks * BLOCK, len(common)), np.float32)
            length = np.where(column >= 0, 0, count)
            begin = np.append(0, np.cumsum(length))
            free = begin[:-1].copy()
            example, value = np.zeros(begin[-1], np.int32), np.zeros(begin[-1], np.float32)
            for a in range(0, n, PACK):
                b = min(n, a + PACK)
                t, w = self.term[self.off[a] : self.off[b]], self.weight[self.off[a] : self.off[b]]
                e = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(self.off[a : b + 1]))
                c = column[t]
                dense[e[c >= 0], c[c >= 0]] = w[c >= 0]
                order = np.flatnonzero(c < 0)
                order = order[np.argsort(t[order], kind="stable")]
                own, many = np.unique(t[order], return_counts=True)
                at = _spans(free[own], many)
                example[at], value[at] = e[order], w[order]
                free[own] += many
            if n:
                made = {"begin": begin, "length": length, "example": example, "value": value}
                dense = dense.reshape(blocks, BLOCK, len(common))
                self.made |= {**made, "column": column, "dense": dense, "maxima": dense.max(axis=1), "query": np.zeros(size)}
        return self.made

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosines (above 0) and these, largest first; exact."""
        return self.top_many(np.array([0, len(terms)]), terms, weights, k)[0]

    def top_many(self, off: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """top() of many queries, each the terms and weights from off to the next off."""
        out = []
        if not len(self.ids) or not self.off[-1]:
            return [(np.zeros(0, int), np.zeros(0))] * (len(off) - 1)
        for a in range(0, len(off) - 1, QUERIES):
            o = off[a : a + QUERIES + 1]
            out += self._top(o - o[0], terms[o[0] : o[-1]], weights[o[0] : o[-1]], k)
        return out

    def _top(self, off: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        m, n, nq = self._make(), len(self.ids), len(off) - 1
        query = np.repeat(np.arange(nq), np.diff(off))
        known = np.flatnonzero(terms < len(m["column"]))
        column = m["column"][terms[known]]
        blocks, _, width = m["dense"].shape
        wide = blocks * BLOCK
        q = np.zeros((nq, width), np.float32)
        common = column >= 0
        q[query[known[common]], column[common]] = weights[known[common]]
        rare = known[~common]
        length = m["length"][terms[rare]]
        at = _spans(m["begin"][terms[rare]], length)
        cell = np.repeat(query[rare] * wide, length) + m["example"][at]
        score = np.bincount(cell, m["value"][at] * np.repeat(weights[rare], length), minlength=nq * wide).astype(np.float32).reshape(nq, wide)
        # The k-th best of what the postings alone give, and of what is opened: no best one is below either.
        least = np.partition(score, wide - min(k, wide), axis=1)[:, wide - min(k, wide)]
        best = np.zeros((nq, k), np.float32)
        bound = q @ m["maxima"].T + score.reshape(nq, blocks, BLOCK).max(axis=2)
        opened = np.zeros(bound.shape, bool)
        order = np.argsort(-bound.max(axis=0), kind="stable")
        for i in range(0, blocks, OPENED):
            some = order[i : i + OPENED]
            rows = np.flatnonzero(((bound[:, some] > 0) & (bound[:, some] + ROUNDING >= least[:, None])).any(axis=1))
            if not len(rows):
                continue
            opened[rows[:, None], some] = True
            cells = (some[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
            now = score[rows[:, None], cells] + q[rows] @ m["dense"][some].reshape(len(cells), width).T
            score[rows[:, None], cells] = now
            better = now.max(axis=1) > least[rows]
            rows = rows[better]
            best[rows] = np.partition(np.concatenate([best[rows], now[better]], axis=1), len(cells), axis=1)[:, len(cells) :]
            least[rows] = np.maximum(least[rows], best[rows].min(axis=1))
        score[~np.repeat(opened, BLOCK, axis=1)] = 0
        out = []
        floor = np.maximum(least - 2 * ROUNDING, 0)
        for i in range(nq):
            hit = np.flatnonzero(score[i, :n] > floor[i])
            t, w = terms[off[i] : off[i + 1]], weights[off[i] : off[i + 1]]
            t, w = t[t < len(m["query"])], w[t < len(m["query"])]
            m["query"][t] = w
            length = self.off[hit + 1] - self.off[hit]
            at = _spans(self.off[hit], length)
            product = m["query"][self.term[at]] * self.weight[at]
            m["query"][t] = 0
            c = np.minimum(np.add.reduceat(product, np.cumsum(length) - length), 1.0) if len(hit) else np.zeros(0)
            order = np.lexsort((hit, -c))[:k]
            out.append((hit[order], c[order]))
        return out


@dataclass(frozen=True)
class ToxicModel:
    vocabulary: np.ndarray  # every word of the examples, sorted
    scale: np.ndarray  # each word's factor: its idf and how far it leans to the toxic side
    strange: float  # the factor of a word that no example has
    index: BlockMaxIndex
    prior: float  # the share of toxic examples
    slope: float
    offset: float
    neighbours: int


def weigh(text: np.ndarray, term: np.ndarray, count: np.ndarray, scale: np.ndarray, strange: float, n: int) -> np.ndarray:
    """(1 + ln tf) * scale, normalised by text; terms of -1 are those that no example has."""
    factor = np.full(len(term), strange)
    factor[term >= 0] = scale[term[term >= 0]]
    w = (1 + np.log(count)) * factor
    norm = np.sqrt(np.bincount(text, w * w, minlength=n))
    return w / norm[text] if len(text) else w


def vote(labels: np.ndarray, cosine: np.ndarray, prior: float) -> float:
    """The weighted share of toxic neighbours, each by 1 / (distance + 0.05), with one vote of the prior at distance 1."""
    w = 1 / (1.05 - cosine)
    return float(((w * labels).sum() + prior / 1.05) / (w.sum() + 1 / 1.05))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _calibrate(votes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """A logistic curve on the votes' logits, by Newton steps with a small penalty."""
    x = np.stack([_logit(votes), np.ones(len(votes))], axis=1)
    b, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - 1.0 * (b - start)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2), g)
        b = b + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    examples: int = EXAMPLES,
    calibration: int = CALIBRATION,
    neighbours: int = NEIGHBOURS,
) -> ToxicModel:
    """Learns from the rows of `docs` that `labels` (id, 0 or 1) names; pass only training rows as
    `labels`. Document frequencies are of all `docs`."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).filter("id is not null and label is not null")
    known = known.groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Half of the sample from either class; what one class can't fill goes to the other.
    most = examples + calibration
    rarer = min(most // 2, min(sizes.get(0, 0), sizes.get(1, 0)))
    parts = [sampled(known.filter(F.col("label") == x), rarer if n <= min(sizes.values()) and len(sizes) > 1 else most - rarer, n, F.col("id")) for x, n in sorted(sizes.items())]
    if not parts:
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(0), 1.0, BlockMaxIndex([], np.zeros(0), np.zeros(1, int)), 0.0, 1.0, 0.0, neighbours)
    some = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    some = some.withColumn("apart", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(most)) < calibration)
    picked = cut(texts.join(F.broadcast(some), "id").select("id", "label", "apart", "text"))  # the sample's size is fixed
    picked = sampled(picked, 2 * most, picked.count(), F.col("id"), F.col("text")).coalesce(16)  # ids that repeat in docs could bring more
    indexed, apart = picked.filter("not apart"), picked.filter("apart")
    vocabulary = _vocabulary(indexed)
    n_docs, df = _document_frequencies(texts, vocabulary)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    strange = float(np.log((1 + n_docs) / 2) + 1)

    shared = spark.sparkContext.broadcast(vocabulary)
    fields = [T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())]
    keys, terms, counts = [], [], []
    for r in add_columns(indexed, "text", lambda: _vectors(shared), fields, keep=["id", "label"]).toLocalIterator():  # the driver holds one partition's rows at a time
        t, c = np.frombuffer(r.terms, np.int32), np.frombuffer(r.counts, np.int32)
        keys.append((r.id, r.label, hashlib.blake2b(r.terms + r.counts, digest_size=8).digest()))
        terms.append(t)
        counts.append(c)
    y = np.array([float(k[1]) for k in keys])
    scale = idf * _leaning(terms, y, len(vocabulary))
    # Examples with the same common words stand together, so that block maxima tell blocks apart.
    place = _placed(terms, len(vocabulary), sorted(range(len(keys)), key=lambda i: (str(keys[i][0]), *keys[i][1:])))
    ids = [keys[i][0] for i in place]
    index = BlockMaxIndex.pack(ids, y[place], [terms[i] for i in place], [counts[i] for i in place], scale)
    del terms, counts
    model = ToxicModel(vocabulary, scale, strange, index, float(y.mean()) if len(y) else 0.0, 1.0, 0.0, neighbours)
    tried = _votes(apart, model, "text", ["label"], "v").select("label", "vvote").toArrow()  # of the sample's fixed size
    labelled = tried["label"].to_numpy()
    if not len(ids) or not 0 < labelled.sum() < len(labelled):
        return model
    share = np.array([sizes.get(0, 0), sizes.get(1, 0)]) / sum(sizes.values())
    back = share / np.maximum(np.bincount(labelled, minlength=2) / len(labelled), 1e-12)
    slope, offset = _calibrate(tried["vvote"].to_numpy(), labelled, back[labelled])
    return replace(model, slope=slope, offset=offset)


def _vocabulary(examples: DataFrame) -> np.ndarray:
    """All words of the examples, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            data, offs = column_bytes(batch.column(0))
            for i, j in slices(offs, SLICE):
                own = np.union1d(own, word_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[1])
        for a in range(0, len(own), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(own[a : a + 10_000].view(np.int64))], names=["h"])

    rows = small_batches(examples).select("text").mapInArrow(run, "h long").distinct().toArrow()
    return np.sort(rows["h"].to_numpy().view(np.uint64))


def _vectors(shared):
    def vectors(data: np.ndarray, offs: np.ndarray):
        terms: list[bytes] = []
        counts: list[bytes] = []
        for i, j in slices(offs, SLICE):
            t, h, count = word_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            term = find(shared.value, h)
            order = np.lexsort((term, t))
            term, count = term[order].astype(np.int32), count[order].astype(np.int32)
            ends = np.searchsorted(t, np.arange(j - i + 1))
            terms += [term[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            counts += [count[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        return [terms, counts]

    return vectors


def _leaning(terms: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Each word's factor: 1, or more by the root of its chi-square where its share among toxic examples is larger."""
    a, c = np.zeros(size), np.zeros(size)  # with the word: toxic, other
    for t, bad in zip(terms, y):
        (a if bad else c)[t] += 1
    bad, n = y.sum(), len(y)
    if not 0 < bad < n:
        return np.ones(size)
    b, d = bad - a, n - bad - c
    both = (a + c) * (b + d)
    chi2 = n * (a * d - b * c) ** 2 / np.maximum(both, 1) / (bad * (n - bad))
    return np.where((a * (n - bad) > c * bad) & (both > 0), 1 + LEANING * np.sqrt(chi2), 1.0)


def _placed(terms: list[np.ndarray], size: int, order: list[int]) -> np.ndarray:
    """An order of the examples in which neighbours share common words: halves, and halves of
    these down to a block, parted along the direction in which they differ most."""
    held = np.zeros(size, np.int64)
    for t in terms:
        held[t] += 1
    common = np.argsort(-held, kind="stable")[:256]
    column = np.full(size, -1)
    column[common] = np.arange(len(common))
    x = np.zeros((len(order), len(common)), np.float32)
    for r, i in enumerate(order):
        at = column[terms[i]]
        x[r, at[at >= 0]] = 1
    out, left = [], [np.arange(len(order))]
    while left:
        part = left.pop()
        if len(part) <= BLOCK:
            out.append(part)
            continue
        z = x[part] - x[part].mean(axis=0)
        v = np.linspace(1, 2, z.shape[1], dtype=np.float32)
        for _ in range(8):
            v = z.T @ (z @ v)
            v /= max(float(np.linalg.norm(v)), 1e-12)
        part = part[np.argsort(z @ v, kind="stable")]
        half = (len(part) // BLOCK + 1) // 2 * BLOCK
        left += [part[half:], part[:half]]
    return np.array(order)[np.concatenate(out)] if out else np.zeros(0, int)


def _document_frequencies(texts: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    size = len(vocabulary)
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            data, offs = column_bytes(batch.column(0))
            df[size] += len(offs) - 1
            for i, j in slices(offs, SLICE):
                _, h, _ = word_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                at = find(shared.value, h)
                df[:size] += np.bincount(at[at >= 0], minlength=size)
        some = np.flatnonzero(df)
        for a in range(0, len(some), 10_000):
            k = some[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(df[k])], names=["k", "n"])

    parts = small_batches(texts).select("text").mapInArrow(run, "k long, n long")
    rows = parts.groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # a row for each word of the vocabulary
    out = np.zeros(size + 1)
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return int(out[size]), out[:size]


def _votes(docs: DataFrame, model: ToxicModel, text_col: str, keep: list[str] | None, prefix: str) -> DataFrame:
    """`docs` with {prefix}vote and {prefix}evidence (the nearest examples: id, toxic, cosine)."""
    index, rest = model.index.sent(docs.sparkSession), docs.sparkSession.sparkContext.broadcast(replace(model, index=None))
    evidence = T.ArrayType(T.StructType([T.StructField("example", T.StringType()), T.StructField("toxic", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))

    def make():
        m: ToxicModel = replace(rest.value, index=index.value)
        held: dict[bytes, tuple[float, list]] = {}

        def judged(e: np.ndarray, c: np.ndarray) -> tuple[float, list]:
            near = [{"example": str(m.index.ids[i]), "toxic": int(m.index.labels[i]), "cosine": float(x)} for i, x in zip(e[:EVIDENCE], c[:EVIDENCE])]
            return vote(m.index.labels[e], c, m.prior), near

        def votes(data: np.ndarray, offs: np.ndarray):
            out, why = np.full(len(offs) - 1, m.prior), [[] for _ in range(len(offs) - 1)]
            for i, j in slices(offs, SLICE):
                text, h, count = word_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                term = find(m.vocabulary, h)
                weight = weigh(text, term, count, m.scale, m.strange, j - i)
                ends = np.searchsorted(text, np.arange(j - i + 1))
                if len(held) > 50_000:
                    held.clear()
                keys, new = {}, {}  # equal texts are searched for once
                for d in np.flatnonzero(np.diff(ends)).tolist():
                    a, b = ends[d], ends[d + 1]
                    keys[d] = hashlib.blake2b(h[a:b].tobytes() + count[a:b].tobytes(), digest_size=16).digest()
                    if keys[d] not in held and keys[d] not in new:
                        new[keys[d]] = np.arange(a, b)[term[a:b] >= 0]
                if new:
                    at = np.concatenate(list(new.values()))
                    off = np.cumsum([0, *[len(x) for x in new.values()]])
                    for key, (e, c) in zip(new, m.index.top_many(off, term[at], weight[at], m.neighbours)):
                        held[key] = judged(e, c)
                for d, key in keys.items():
                    out[i + d], why[i + d] = held[key]
            return [out, why]

        return votes

    return add_columns(docs, text_col, make, [T.StructField(f"{prefix}vote", T.DoubleType()), T.StructField(f"{prefix}evidence", evidence)], keep)


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text", prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """`docs` with {prefix}score (0 to 1) and {prefix}evidence (the nearest examples: id, toxic, cosine)."""
    free(docs if keep is None else docs.select(*[F.col(f"`{c}`") for c in keep]), f"{prefix}score")
    voted = _votes(docs, model, text_col, keep, prefix)
    p = F.least(F.greatest(F.col(f"{prefix}vote"), F.lit(1e-4)), F.lit(1 - 1e-4))
    found = 1 / (1 + F.exp(-(model.slope * F.log(p / (1 - p)) + model.offset))) if model.index.ids else F.lit(0.0)
    return voted.withColumn(f"{prefix}score", found).drop(f"{prefix}vote")
