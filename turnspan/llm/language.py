"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's letters are lower-cased (A-Z) and everything else becomes white space; byte n-grams of one
to three bytes are hashed into `dims` buckets. A vector is (1 + ln tf) * idf, normalised. Each
language has several centroids, found by spherical k-means on a bounded sample; a text goes to the
language of the centroid with the largest cosine, and is rejected where that cosine is below a
share of the smallest cosines seen within that language.

Document frequencies come from all training texts; about `sample` training texts, twice
that at most, are clustered as vectors of a fixed size in one task. Only the model reaches the driver.

Edge cases: a null or empty text, or one without any letter, gets `und` with score 0 and is
rejected; with no training text at all everything is `und`; ties go to the language that sorts
first; repeated rows get equal results; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import add_columns, counted
from .textnum import FOLD, slices

DIMS = 4096
CENTROIDS = 3
SAMPLE = 2400
REJECT_SHARE = 0.5
MOST_LANGUAGES = 1000  # bounds the model that is sent to the tasks
UNKNOWN = "und"
SHARPNESS = 25.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_CLEAN = np.where(_LETTER, FOLD, 0x20).astype(np.uint8)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    owner: np.ndarray  # of each centroid: its language
    centroids: np.ndarray  # (centroids, dims)
    idf: np.ndarray
    reject_below: np.ndarray  # by language
    dims: int


def gram_counts(data: np.ndarray, offs: np.ndarray, dims: int) -> np.ndarray:
    """(texts, dims) counts of hashed 1- to 3-grams; grams do not cross texts."""
    n = len(offs) - 1
    if not len(data):
        return np.zeros((n, dims), dtype=np.float32)
    clean = np.take(_CLEAN, data).astype(np.uint32)
    text = np.repeat(np.arange(n, dtype=np.int64) * dims, np.diff(offs))
    total = None
    for k in (1, 2, 3):
        size = len(clean) - k + 1
        if size <= 0:
            break
        code = clean[:size].copy()
        for j in range(1, k):
            code |= clean[j : j + size] << np.uint32(8 * j)
        if k < 3:
            useful = clean[:size] != 0x20
        else:
            useful = clean[1 : 1 + size] != 0x20
        if k > 1:
            useful &= text[:size] == text[k - 1 :]
        code = ((code + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(15)
        part = np.bincount(text[:size][useful] + (code[useful] % np.uint32(dims)), minlength=n * dims)
        total = part if total is None else total + part
    return total.reshape(n, dims).astype(np.float32)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 0x80))])
    out = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
    other = np.concatenate([[0], np.cumsum(data >= 0x80)])
    for i in np.flatnonzero(~out & (other[offs[1:]] > other[offs[:-1]])):
        out[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means; centres start far apart (by cosine) and come back normalised."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = [points[rng.integers(len(points))]]
    while len(centres) < k:
        away = np.clip(1 - np.max(points @ np.array(centres).T, axis=1), 0, None)
        total = away.sum()
        centres.append(points[rng.choice(len(points), p=away / total) if total > 0 else rng.integers(len(points))])
    c = np.array(centres)
    for _ in range(rounds):
        nearest = np.argmax(points @ c.T, axis=1)
        c = np.array([points[nearest == i].mean(axis=0) if (nearest == i).any() else c[i] for i in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = DIMS, centroids: int = CENTROIDS, sample: int = SAMPLE, reject_share: float = REJECT_SHARE) -> LanguageModel:
    """Learns from the rows of `train` that have a text and a language."""
    train = train.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter("text is not null and lang is not null")

    def document_frequencies() -> Callable:
        def count(data: np.ndarray, offs: np.ndarray):
            df = np.zeros(dims + 1, dtype=np.int64)
            for i, j in slices(offs, 1_000_000, 256):
                df[:dims] += (gram_counts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], dims) > 0).sum(axis=0)
            df[dims] = len(offs) - 1
            return np.arange(dims + 1), df

        return count

    df = np.zeros(dims + 1)
    for row in counted(train, "text", document_frequencies).collect():  # dims + 1 rows
        df[row.k] = row.n
    idf = np.log((1 + df[dims]) / (1 + df[:dims])) + 1
    idf = idf.astype(np.float32)

    by_lang = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(by_lang) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values in {lang_col}: these are no languages")
    languages = tuple(sorted(by_lang))
    if not languages:
        return LanguageModel((), np.zeros(0, int), np.zeros((0, dims), np.float32), idf, np.zeros(0), dims)
    each = max(1, sample // len(languages))
    share = F.shiftrightunsigned(F.xxhash64(F.lit(5), "id"), 11) * F.lit(2.0**-53)
    chance = F.coalesce(*[F.when(F.col("lang") == x, F.lit(each / by_lang[x])) for x in languages])
    held = _vectors_of(train.filter(share < chance), dims, idf)
    held = held.orderBy("v", "lang").limit(2 * sample)  # ids that repeat could bring more
    found = {r.at: r for r in _clustered(held, languages, dims, centroids, reject_share).collect()}
    owner, centres, floor = [], [], [0.0] * len(languages)
    for i in sorted(found):
        c = np.frombuffer(found[i].centres, dtype=np.float32).reshape(-1, dims)
        owner += [i] * len(c)
        centres.append(c)
        floor[i] = found[i].floor
    return LanguageModel(languages, np.array(owner, int), np.concatenate(centres) if centres else np.zeros((0, dims), np.float32), idf, np.array(floor), dims)


def _vectors_of(rows: DataFrame, dims: int, idf: np.ndarray) -> DataFrame:
    def make():
        def vector(data: np.ndarray, offs: np.ndarray):
            out = []
            for i, j in slices(offs, 1_000_000, 256):
                out += [v.tobytes() for v in vectors(gram_counts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], dims), idf).astype(np.float16)]
            return [out]

        return vector

    return add_columns(rows, "text", make, [T.StructField("v", T.BinaryType())], keep=["lang"])


def _clustered(held: DataFrame, languages: tuple[str, ...], dims: int, centroids: int, reject_share: float) -> DataFrame:
    """(at, centres, floor) for each language that has texts with grams in `held` (v, lang: a bounded
    sample): its place in `languages`, its centroids as float32 and its rejection floor."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: list[list[bytes]] = [[] for _ in languages]
        for batch in batches:
            for v, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of[place[lang]].append(v)
        for i, rows in enumerate(of):
            p = np.frombuffer(b"".join(sorted(rows)), dtype=np.float16).astype(np.float32).reshape(-1, dims)
            p = p[np.linalg.norm(p, axis=1) > 0.5]
            if len(p):
                c = kmeans(p, centroids)
                floor = reject_share * float(np.quantile((p @ c.T).max(axis=1), 0.005))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([c.astype(np.float32).tobytes()], pa.binary()), pa.array([floor])], names=["at", "centres", "floor"])

    return held.select("v", "lang").coalesce(1).mapInArrow(run, "at int, centres binary, floor double")


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """`docs` with {prefix}lang_pred (the nearest language, or `und` without letters),
    {prefix}score (0 to 1) and {prefix}rejected (too far from every centroid)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m: LanguageModel = shared.value
        known = len(m.centroids) > 0

        def predict(data: np.ndarray, offs: np.ndarray):
            n = len(offs) - 1
            letters = _has_letter(data, offs) if len(data) else np.zeros(n, bool)
            best, score, cosine = np.zeros(n, int), np.zeros(n), np.zeros(n)
            for i, j in slices(offs, 1_000_000, 256):
                if not known:
                    break
                v = vectors(gram_counts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], m.dims), m.idf)
                near = v @ m.centroids.T
                by_lang = np.full((j - i, len(m.languages)), -1.0)
                for c, lang in enumerate(m.owner):
                    by_lang[:, lang] = np.maximum(by_lang[:, lang], near[:, c])
                best[i:j] = by_lang.argmax(axis=1)
                cosine[i:j] = by_lang.max(axis=1)
                e = np.exp(SHARPNESS * (by_lang - by_lang.max(axis=1, keepdims=True)))
                score[i:j] = 1 / e.sum(axis=1)
            ok = letters & known
            names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, ok)]
            rejected = ~ok
            if known:
                rejected = rejected | (cosine < m.reject_below[best])
            return [names, np.where(ok, score, 0.0), rejected]

        return predict

    fields = [T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}rejected", T.BooleanType())]
    return add_columns(docs, text_col, make, fields, keep)
