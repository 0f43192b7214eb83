"""Near duplicates by BagMinHash signatures of word shingles, banded and verified.

A text is the multiset of its five-word shingles. Words are runs of ASCII letters and digits and of
characters beyond ASCII, with A-Z in lower case; a text of none has what white space parts as words.
A signature has 128 components that agree between two texts with the probability of their weighted
Jaccard similarity (see `similarity`). Each shingle's weight axis is cut into dyadic intervals (0, 1],
(1, 2], (2, 4], ..., and each interval has a Poisson process of its own, seeded by shingle and
interval; a point's place in its interval decides whether it lies below the shingle's count, and a
random component takes the earliest of its points. Points are made only up to a time by which all
components of a text are taken (about M ln M points in all, however long the text), and further for
the few texts where one is still open, so a signature costs one random number for most shingles.

Stages, each of them distributed:
1. equal texts become one node (a partial aggregation by their MD5), as do equal signatures;
2. signatures fall into 25 bands of 5 components; in each bucket of two or more, signatures that
   agree in 65 % are candidates (0.8 minus more than four standard deviations);
3. the candidates' connected components bring the texts that must meet together, each text once;
4. there, pairs are verified by their exact multiset overlap, those of one class already excepted;
5. classes are the connected components of the verified links.

A bucket or component too large for a task is cut into blocks, whose members are linked inside; one
representative of each class of a block goes on to the next round, again in blocks, as long as that
joins classes. So a large group of copies ends as one class after as many comparisons as it has
members, times a constant. Only members of different classes are then still to be compared: blocks
of all but the largest class meet all blocks, two by two, in tasks of their own, so memory is bounded
and no pair is left out. A pair at the threshold is missed with a probability of 5e-5 (no common
band); above 0.85, 1e-6.

Edge cases: a text of fewer than five words is one shingle; a null or empty text, or one of white
space only, is in a class of its own; ids may be of any type that has an order, and may repeat: each
row has the class of its own text, named by the least id in it (two classes of one least id have one
name, but remain two for `deduplicate`); a row without an id has no class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnspan.session import cut

from .batches import add_columns
from .components import components, parts_of
from .textnum import ALNUM, SOLID, U64, Words, column_bytes, mix, slices, windows

WORDS = 5
COMPONENTS = 128
BANDS, BAND_ROWS = 25, 5
LEAST_EQUAL = 83  # of 128 components: a similarity of 0.65
BLOCK_ROWS = 1024  # rows of a bucket that meet in one task
BLOCK_TEXTS, BLOCK_BYTES = 512, 8_000_000  # texts of a component that meet in one task
BROADCAST_ROWS = 200_000  # of (id, content, node)
# What a worker handles at once: only its memory depends on these.
SLICE_BYTES, SLICE_TEXTS = 1_000_000, 8192  # texts
PIECE_ROWS = 2048  # rows of whole groups
PIECE_PAIRS = 50_000  # pairs of rows
_LOW48 = U64((1 << 48) - 1)


def similarity(equal: np.ndarray) -> np.ndarray:
    """The unbiased estimate of the weighted Jaccard similarity from the number of equal components:
    a component is one byte, and unequal ones meet in one of 256."""
    return (equal / COMPONENTS - 1 / 256) / (1 - 1 / 256)


def words_of(data: np.ndarray, offs: np.ndarray) -> Words:
    return Words(data, offs, ALNUM, fold=True, other=SOLID)


def shingle_keys(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted (text << 48 | hash) of all shingles of at most 65,536 texts."""
    w = words_of(data, offs)
    h, begin = windows(w.hashes(), w.off, WORDS, short=True)
    text = np.searchsorted(w.off, begin, side="right") - 1
    return np.sort((text.astype(np.uint64) << U64(48)) | (h & _LOW48))


def bag_minhash(data: np.ndarray, offs: np.ndarray, m: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(texts, m) signatures of one byte a component, and the number of shingles of each text."""
    n = len(offs) - 1
    keys = shingle_keys(data, offs)
    size = np.bincount((keys >> U64(48)).astype(np.int64), minlength=n)
    signature = np.zeros((n, m), dtype=np.uint8)
    if not len(keys):
        return signature, size
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.diff(np.append(first, len(keys)))
    text, shingle = (keys[first] >> U64(48)).astype(np.int64), mix(keys[first] & _LOW48)
    # A row for each shingle and dyadic interval of its weight: 0 is (0, 1], j is (2^(j-1), 2^j].
    levels = 1 + np.ceil(np.log2(count)).astype(np.int64)
    at = np.repeat(np.arange(len(count)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    base = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.where(level > 0, base, 1.0)
    with np.errstate(over="ignore"):
        seed = mix(shingle[at] + level.astype(np.uint64) * U64(0xD1342543DE82EF95))
    owner, weight = text[at], count[at]
    horizon = m * (np.log(m) + 2.5) / np.maximum(size, 1)
    open_texts = size > 0
    while True:
        rows = np.flatnonzero(open_texts[owner])
        best = np.full(n * m, np.inf)
        mark = np.zeros(n * m, dtype=np.uint8)
        time, s, step = np.zeros(len(rows)), seed[rows], 0
        while len(rows):
            step += 1
            with np.errstate(over="ignore"):
                r1 = mix(s + U64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log1p(-((r1 >> U64(11)).astype(np.float64) * 2.0**-53)) / rate[rows]
            live = time <= horizon[owner[rows]]
            rows, time, s, r1 = rows[live], time[live], s[live], r1[live]
            if not len(rows):
                break
            r2 = mix(r1 ^ U64(0xA0761D6478BD642F))
            place = base[rows] + rate[rows] * ((r2 >> U64(40)).astype(np.float64) * 2.0**-24)
            inside = np.flatnonzero(place < weight[rows])
            cell = owner[rows[inside]] * m + (r2[inside] & U64(0xFFFF)).astype(np.int64) % m
            np.minimum.at(best, cell, time[inside])
            won = best[cell] == time[inside]
            mark[cell[won]] = ((r2[inside][won] >> U64(16)) & U64(0xFF)).astype(np.uint8)
        best = best.reshape(n, m)
        ready = np.isfinite(best).all(axis=1) & open_texts
        signature[ready] = mark.reshape(n, m)[ready]
        open_texts &= ~ready
        if not open_texts.any():
            return signature, size
        horizon = np.where(open_texts, horizon * 1.6, horizon)


def _signatures():
    def make(data: np.ndarray, offs: np.ndarray):
        rows: list[bytes | None] = []
        for i, j in slices(offs, SLICE_BYTES, SLICE_TEXTS):
            signature, size = bag_minhash(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            rows += [s.tobytes() if k else None for s, k in zip(signature, size)]
        return [rows]

    return make


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (equal g, neighbours in the input): of PIECE_ROWS rows at most, or one larger group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(g, g[-1])) if (g[1:] >= g[:-1]).all() else int(np.flatnonzero(np.append(True, g[1:] != g[:-1]))[-1])
        if last == 0 and held and held[-1].column(0)[held[-1].num_rows - 1].as_py() == g[-1]:
            held.append(batch)
            continue
        held.append(batch.slice(0, last))
        yield from _pieces(pa.Table.from_batches(held))
        held = [batch.slice(last)]
    if held:
        yield from _pieces(pa.Table.from_batches(held))


def _pieces(table: pa.Table) -> Iterator[pa.Table]:
    g = table.column(0).to_numpy()
    ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
    i = 0
    while i < len(g):
        j = int(ends[max(np.searchsorted(ends, i + PIECE_ROWS, side="right") - 1, np.searchsorted(ends, i, side="right"))])
        yield table.slice(i, j - i)
        i = j


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows 0..n-1 joined by links a-b, the least row of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _alike(sig: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (neighbours) whose signatures agree enough, and in how many components;
    at most PIECE_PAIRS at once, as a group of copies has as many as all its pairs."""
    n = len(group)
    k, rows = 1, np.arange(n - 1)
    while True:
        rows = rows[rows + k < n]
        rows = rows[group[rows] == group[rows + k]]
        if not len(rows):
            return
        for part in np.array_split(rows, len(rows) // PIECE_PAIRS + 1):
            same = (sig[part] == sig[part + k]).sum(axis=1)
            hit = same >= LEAST_EQUAL
            if hit.any():
                yield part[hit].astype(np.int32), (part[hit] + k).astype(np.int32), same[hit].astype(np.uint8)
        k += 1


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, COMPONENTS)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, node, kin, sig) in groups to (u, v): a star for each component of candidates in a group."""
    for t in _groups(batches):
        g, node = t.column(0).to_numpy(), t.column(1).to_numpy()
        order = np.lexsort((node, g))  # the least row of a component is its least node
        g, node = g[order], node[order]
        label = np.arange(len(g))
        for a, b, _ in _alike(_matrix(t.column(3))[order], g):
            new = label[a] != label[b]
            if new.any():  # those who are joined already need no further pair
                label = _least_labels(len(g), np.append(a[new], np.arange(len(g))), np.append(b[new], label))
        hung = np.flatnonzero(label != np.arange(len(g)))
        yield pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(node[label[hung]])], names=["u", "v"])


def bag_of(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Each text's shingle occurrences as a sorted set: equal shingles are told apart by their rank."""
    w = words_of(data, offs)
    h, begin = windows(w.hashes(), w.off, WORDS, short=True)
    text = np.searchsorted(w.off, begin, side="right") - 1
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[: len(h)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, int)
    with np.errstate(over="ignore"):
        h = mix(h + (np.arange(len(h)) - first).astype(np.uint64) * U64(0x9FB21C651E98DF25))
    order = np.lexsort((h, text))
    ends = np.searchsorted(text, np.arange(len(offs)))
    h = h[order]
    return [h[a:b] for a, b in zip(ends[:-1], ends[1:])]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two bags' weighted Jaccard similarity is 0.8 or more."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 5 * len(a) < 4 * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, node, kin, sig, text) in groups to (u, v): a star for each class of verified links in a
    group. Rows of one kin are known to be of one class."""
    for t in _groups(batches):
        g, node, kin = (t.column(i).to_numpy() for i in range(3))
        order = np.lexsort((node, g))
        g, node, kin = g[order], node[order], kin[order]
        data, offs = column_bytes(t.column(4).combine_chunks())
        bags: list[np.ndarray] = []
        for i, j in slices(offs, SLICE_BYTES):
            bags += bag_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        found = list(_alike(_matrix(t.column(3))[order], g))
        a, b, equal = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        root = list(range(len(g)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        first: dict[tuple[int, int], int] = {}
        for x, key in enumerate(zip(g.tolist(), kin.tolist())):
            root[x] = first.setdefault(key, x)
        best = np.argsort(COMPONENTS - equal, kind="stable")
        for part in np.array_split(best, len(best) // PIECE_PAIRS + 1):
            for x, y in zip(a[part].tolist(), b[part].tolist()):
                p, q = find(x), find(y)
                if p != q and similar(bags[order[x]], bags[order[y]]):
                    root[max(p, q)] = min(p, q)
        label = np.array([find(x) for x in range(len(g))], dtype=np.int64)
        hung = np.flatnonzero(label != np.arange(len(g)))
        yield pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(node[label[hung]])], names=["u", "v"])


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _blocks(df: DataFrame, tasks: str, level: int) -> DataFrame:
    """Adds g: the block of its key that a row is in."""
    return df.withColumn("g", F.expr(f"xxhash64(key, {level}, pmod(xxhash64(node, {level}), cast(ceil({tasks}) as bigint)))"))


def _linked(rows: DataFrame, attach: Callable[[DataFrame], DataFrame], kernel: Kernel, most_rows: int, most_bytes: int) -> DataFrame:
    """(u, v): links that join all rows (node, key, bytes) which the kernel joins, directly or through
    others, in the groups of one key. attach() adds the columns that the kernel compares to (g, node, kin)."""

    def met(df: DataFrame) -> DataFrame:
        dealt = attach(df.select("g", "node", "kin")).repartition(F.col("g")).sortWithinPartitions("g")
        return dealt.mapInArrow(kernel, "u long, v long")

    tasks = F.greatest(F.count(F.lit(1)) / most_rows, F.sum("bytes") / most_bytes).alias("tasks")
    parts = parts_of(rows.count())  # tables of ids are kept in few partitions; a group has fewer links than rows
    sizes = cut(rows.groupBy("key").agg(tasks).coalesce(parts))
    rows = rows.join(sizes, "key")
    links = cut(met(_blocks(rows.withColumn("kin", F.col("node")), "tasks", 0)).repartition(parts))
    if sizes.filter("tasks > 1").isEmpty():
        return links
    large, last, level = cut(rows.filter("tasks > 1").select("node", "key", "bytes").coalesce(parts)), None, 0
    parts = parts_of(large.count())
    large = large.coalesce(parts)
    while True:
        roots = components(links, links.count())
        placed = cut(large.join(roots, "node", "left").select("node", "key", "bytes", F.coalesce("root", "node").alias("kin")).coalesce(parts))
        classes_ = cut(placed.groupBy("key", "kin").agg(F.min("node").alias("node"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all_bytes")).coalesce(parts))
        several = cut(classes_.groupBy("key").agg(tasks, F.count(F.lit(1)).alias("classes")).filter("classes > 1").coalesce(parts))
        now = several.agg(F.sum("classes")).first()[0] or 0
        if now == 0:
            return links
        if last is not None and 2 * now > last:
            break
        last, level = now, level + 1
        links = cut(links.unionByName(met(_blocks(classes_.join(several, "key"), "tasks", level)).repartition(parts)))
    # What is left: rows of different classes. Blocks of the largest class don't meet each other.
    main = classes_.join(several.select("key"), "key").groupBy("key").agg(
        F.max(F.struct("n", "kin", "all_bytes")).alias("main"), F.sum("n").alias("n"), F.sum("all_bytes").alias("all_bytes")
    )
    per = lambda n, b: F.ceil(F.greatest(n / most_rows, b / most_bytes)).cast("long")
    main = main.select("key", F.col("main.kin").alias("main"), per(F.col("main.n"), F.col("main.all_bytes")).alias("p"), per(F.col("n") - F.col("main.n"), F.col("all_bytes") - F.col("main.all_bytes")).alias("q"), F.col("main.n").alias("n_main"), "n")
    main = cut(main.coalesce(parts))
    copies = main.agg(F.sum(F.expr("n_main * q + (n - n_main) * (p + q)"))).first()[0]
    tiled = placed.join(main.select("key", "main", "p", "q"), "key").withColumn("own", F.expr("if(kin = main, pmod(xxhash64(node), p), p + pmod(xxhash64(node), q))"))
    tiled = tiled.withColumn("other", F.expr("explode(sequence(if(kin = main, p, 0L), p + q - 1))"))
    return cut(links.unionByName(met(tiled.withColumn("g", F.expr("xxhash64(key, least(own, other), greatest(own, other))"))).repartition(parts_of(copies))))


def content_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, content, sig; a row for each row of `docs`), and for the contents of rows that are
    not alone in their class: (content, class_id, of), of: the content that the least id stands for."""
    text = F.col(f"`{text_col}`")
    ids = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), content_of(text).alias("content"), F.octet_length(text).cast("long").alias("bytes"))
    base = cut(add_columns(ids, "text", _signatures, [T.StructField("sig", T.BinaryType())], keep=["id", "content", "bytes"]))

    # 1. One node for equal texts, then one for equal signatures.
    contents = base.filter("sig is not null and id is not null").groupBy("content", "sig").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
    contents = cut(contents.coalesce(parts_of(4 * base.count())).withColumn("node", F.monotonically_increasing_id()))  # 4: rows with a signature are longer
    n = contents.count()
    sigs = cut(contents.groupBy("sig").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")).coalesce(parts_of(4 * n)))

    # 2. Buckets of two or more, and candidates in them.
    band = f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sig, b * {BAND_ROWS} + 1, {BAND_ROWS})))"
    members = sigs.select("node", F.explode(F.expr(band)).alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = cut(members.join(shared, "key").select("node", "key", F.lit(COMPONENTS).cast("long").alias("bytes")).coalesce(parts_of(BANDS * n)))
    pairs = _linked(members, lambda df: df.join(sigs.select("node", "sig"), "node").select("g", "node", "kin", "sig"), _candidates, BLOCK_ROWS, BLOCK_BYTES)
    same_sig = contents.join(sigs.filter("n > 1").select("sig", F.col("node").alias("v")), "sig").filter("node <> v").select(F.col("node").alias("u"), "v")

    # 3. What must meet.
    parts = components(pairs.unionByName(same_sig), pairs.count() + n)
    parts = cut(contents.select("node", "id", "content", "sig", "bytes").join(parts, "node").withColumnRenamed("root", "key").coalesce(parts_of(4 * n)))

    # 4. Verified links. The text of a node is that of its least id, by a join of texts and nodes.
    named = parts.select("id", "content", "node")
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    texts = ids.select("id", "content", "text").join(named, ["id", "content"]).select("node", "text").dropDuplicates(["node"])
    compared = lambda df: df.join(parts.select("node", "sig"), "node").join(texts, "node").select("g", "node", "kin", "sig", "text")
    links = _linked(parts.select("node", "key", "bytes"), compared, _verified, BLOCK_TEXTS, BLOCK_BYTES)

    # 5. Classes of texts.
    grouped = cut(contents.join(components(links, links.count()), "node").select("content", "id", "root").coalesce(parts_of(n)))
    least = cut(grouped.groupBy("root").agg(F.min(F.struct("id", "content")).alias("least")).coalesce(parts_of(n)))
    moved = grouped.join(least, "root").select("content", F.col("least.id").alias("class_id"), F.col("least.content").alias("of"))
    copied = contents.filter("n > 1").join(grouped.select("content"), "content", "left_anti")
    moved = moved.unionByName(copied.select("content", F.col("id").alias("class_id"), F.col("content").alias("of")))
    return base, cut(moved.coalesce(parts_of(n)))  # written, so that the joins with hot texts can be split


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id), a row for each row of `docs`: class_id is the least id of the class."""
    base, moved = _found(docs, id_col, text_col)
    placed = base.select("id", "content").join(moved, "content", "left")
    return placed.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each class, that of its least id, and all rows that have no id or no
    word; same columns."""
    base, moved = _found(docs, id_col, text_col)
    rows, parts = base.filter("id is not null and sig is not null").select("id", "content"), parts_of(base.count())
    gone = rows.join(moved, "content").filter("content <> of or id <> class_id").select("id", "content").distinct().coalesce(parts)
    again = rows.groupBy("id", "content").count().filter("count > 1").select("id", "content").coalesce(parts)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("id"), content_of(F.col(f"`{text_col}`")).alias("content"))
    kept = packed.join(cut(gone), ["id", "content"], "left_anti")
    again = cut(again)
    if again.isEmpty():
        return kept.select("doc.*")
    single = kept.join(again, ["id", "content"], "left_anti")
    return single.unionByName(kept.join(again, ["id", "content"], "left_semi").dropDuplicates(["id", "content"])).select("doc.*")
