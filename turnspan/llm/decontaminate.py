"""Benchmark decontamination with training suffix arrays.

Each task sorts the word suffixes of its documents (a shard) by prefix doubling. Every suffix of
every test item is then binary-searched in that shard, one word deeper at a time, until its range
of equal prefixes is empty: that depth is its longest verbatim match there. Every place of each
range is credited with the range's depth, so a text's longest match does not depend on the texts
that share its shard. A range at the depth of a whole window gives all occurrences of that window.

The test set is the stated query set: it goes to the tasks in blocks of at most `block_words`
words, `PASS_BLOCKS` of them in a pass, so what a task holds has a fixed bound however large the
test set is. Each pass is one narrow scan of the documents that builds each shard's suffix array
once; a checkpoint parts the passes, where there is more than one.

Words are compared by 64-bit hashes. Two different words of one comparison collide with a
probability of 2^-64; a window of ten needs ten such collisions.

Edge cases: a null or empty text, or one without words, has no hits; a null item text has no
windows; a null item id is matched but adds no id; repeated rows are each reported; empty tables
give no hits; other columns of `docs` are left as they are in `flag` and `decontaminate`.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnspan.session import cut

from .batches import small_batches
from .textnum import ALNUM, Words, column_bytes, slices

WINDOW = 10
BLOCK_WORDS = 2_000_000
SHARD_BYTES = 6_000_000
PASS_BLOCKS = 4


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `tokens` sorted by their next `depth` tokens (at least). Prefix doubling:
    only groups of still equal prefixes are sorted again."""
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    ranked = tokens[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order], rank[n] = group, -1
    done = 1
    while done < depth:
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        key = group[slots] * (n + 2) + rank[np.minimum(at + done, n)] + 1
        by = np.argsort(key, kind="stable")
        order[slots], key = at[by], key[by]
        new[slots[1:]] |= key[1:] != key[:-1]
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[slots]] = group[slots]
        done *= 2
    return order


def narrow(tokens: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [lo, hi) of suffixes equal in `depth` tokens, the part whose next token is `want`."""
    padded_n = len(tokens)

    def bound(right: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            at = order[mid] + depth
            has = at < padded_n
            value = np.where(has, tokens[np.minimum(at, padded_n - 1)], 0)
            below = np.where(has, (value <= want[live]) if right else (value < want[live]), True)
            a[live] = np.where(below, mid + 1, a[live])
            b[live] = np.where(below, b[live], mid)
            live = live[a[live] < b[live]]
        return a

    return bound(False), bound(True)


class TestSet:
    """Hashed words of a block of test items."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        data, offs = column_bytes(pa.array(texts, pa.string()))
        words = Words(data, offs, ALNUM, fold=True)
        self.ids, self.off = ids, words.off
        self.tokens = np.maximum(words.hashes(), 1)  # 0 separates documents
        counts = np.diff(words.off)
        self.item = np.repeat(np.arange(len(ids)), counts)
        self.left = np.repeat(words.off[1:], counts) - np.arange(len(self.tokens))  # words to the item's end
        whole = np.repeat(counts, counts)
        first = np.arange(len(self.tokens)) == np.repeat(words.off[:-1], counts)
        self.need = np.where(self.left >= window, window, np.where(first & (whole < window), whole, 0))  # 0: no window begins here
        self.longest = int(counts.max()) if len(counts) else 0


def search(tokens: np.ndarray, order: np.ndarray, test: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Longest match of each test suffix; for each place of the shard the longest match that begins
    there and the first test suffix that has it (-1: none); and for windows (test position, its
    occurrences' places, lengths). `order` is sorted by at least the longest item's words."""
    n, m = len(tokens), len(test.tokens)
    best, hits = np.zeros(m, np.int64), []
    reach, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if not n or not m:
        return best, reach, source, hits
    ranked = tokens[order]
    live = np.arange(m)
    lo, hi = np.searchsorted(ranked, test.tokens, "left"), np.searchsorted(ranked, test.tokens, "right")
    depth = 1
    while len(live):
        keep = lo < hi
        live, lo, hi = live[keep], lo[keep], hi[keep]
        if not len(live):
            break
        best[live] = depth
        _, once = np.unique(lo, return_index=True)  # ranges of one depth are equal or apart
        at = order[spread(lo[once], hi[once])]
        reach[at], source[at] = depth, np.repeat(live[once], (hi - lo)[once])
        full = np.flatnonzero(test.need[live] == depth)
        if len(full):
            at = order[spread(lo[full], hi[full])]
            hits.append((np.repeat(live[full], (hi - lo)[full]), at, np.full(len(at), depth)))
        keep = test.left[live] > depth
        live, lo, hi = live[keep], lo[keep], hi[keep]
        if len(live):
            lo, hi = narrow(tokens, order, lo, hi, depth, test.tokens[live + depth])
        depth += 1
    return best, reach, source, hits


def spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All slots of the ranges [lo, hi), one range after another."""
    count = hi - lo
    return np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())


def longest_places(reach: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text (its first place is in `begin`, a separator is its last) the longest match and the first place that has it."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = np.maximum.reduceat(reach, begin)
    size = np.diff(np.append(begin, len(reach)))
    at = np.flatnonzero(reach == np.repeat(most, size))
    return most, at[np.searchsorted(at, begin)]


def shard_tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes with a 0 after each text, and the text of each place."""
    counts = np.diff(words.off)
    doc = np.repeat(np.arange(len(counts)), counts + 1)
    tokens = np.zeros(len(doc), dtype=np.uint64)
    ends = np.cumsum(counts + 1) - 1
    mask = np.ones(len(doc), dtype=bool)
    mask[ends] = False
    tokens[mask] = np.maximum(words.hashes(), 1)
    return tokens, doc


def test_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[TestSet]:
    """Blocks of the test set, streamed through the driver one bounded block at a time."""
    ids: list[str | None] = []
    texts: list[str | None] = []
    held = 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = len(row.t) // 2 + 1 if row.t else 0  # an upper bound
        if ids and held + words > block_words:
            yield TestSet(ids, texts, window)
            ids, texts, held = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        held += words
    yield TestSet(ids, texts, window)


def flag(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    prefix: str = "dc_",
) -> DataFrame:
    """`docs` with, per row: {prefix}words long, {prefix}hit long (words inside an occurrence of a
    window), {prefix}items long, {prefix}items_sha256 string, {prefix}longest long (the longest
    verbatim run of any test suffix, in words, whole windows or not), {prefix}longest_item string
    (an item that has that run), {prefix}longest_at long (the first word of the first such run in
    the document; null: no word is shared)."""
    spark = small_batches(docs).sparkSession
    names = [f"{prefix}{x}" for x in ("words", "hit", "items", "items_sha256", "longest", "longest_item", "longest_at")]
    clash = {x.lower() for x in docs.columns} & {x.lower() for x in [*names, f"{prefix}spans", f"{prefix}found"]}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the way; choose another prefix")
    state = T.StructType(
        [
            T.StructField(names[0], T.LongType()),
            T.StructField(f"{prefix}spans", T.ArrayType(T.IntegerType())),
            T.StructField(f"{prefix}found", T.ArrayType(T.StringType())),
            T.StructField(names[4], T.LongType()),
            T.StructField(names[5], T.StringType()),
            T.StructField(names[6], T.LongType()),
        ]
    )
    out, first = docs, True
    for tests in passes(test_blocks(benchmark, item_id_col, item_text_col, window, block_words)):
        shared = [spark.sparkContext.broadcast(test) for test in tests]
        held = out if first else cut(out)  # what a stage holds does not grow with the test set
        out = held.mapInArrow(_pass(shared, text_col, state.fieldNames(), first), T.StructType(docs.schema.fields + state.fields))
        first = False
    finish = T.StructType(docs.schema.fields + [T.StructField(n, T.StringType() if n.endswith(("sha256", "longest_item")) else T.LongType()) for n in names])
    return out.mapInArrow(_finish(state.fieldNames(), names), finish)


def passes(blocks: Iterator[TestSet]) -> Iterator[list[TestSet]]:
    """The blocks, PASS_BLOCKS at a time."""
    while some := list(itertools.islice(blocks, PASS_BLOCKS)):
        yield some


def _pass(shared, text_col: str, state: list[str], first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: list[TestSet] = [x.value for x in shared]
        depth = max(x.longest for x in tests)
        for batch in batches:
            keep = [n for n in batch.schema.names if first or n not in state]
            data, offs = column_bytes(batch.column(batch.schema.get_field_index(text_col)))
            n = len(offs) - 1
            total = np.zeros(n, np.int64)
            if first:
                spans: list[list[int]] = [[] for _ in range(n)]
                found: list[list[str]] = [[] for _ in range(n)]
                longest, item, at = np.zeros(n, np.int64), [None] * n, np.full(n, -1, np.int64)
            else:
                held = {name: batch.column(batch.schema.get_field_index(name)).to_pylist() for name in state}
                spans, found = [x or [] for x in held[state[1]]], [x or [] for x in held[state[2]]]
                longest, item, at = np.array(held[state[3]], np.int64), held[state[4]], np.array([-1 if x is None else x for x in held[state[5]]], np.int64)
            for i, j in slices(offs, SHARD_BYTES):
                words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ALNUM, fold=True)
                total[i:j] = np.diff(words.off)
                tokens, doc = shard_tokens(words)
                begin = np.cumsum(np.diff(words.off) + 1) - np.diff(words.off) - 1  # of each text in tokens
                order = suffix_array(tokens, depth)
                for test in tests:
                    _, reach, source, hits = search(tokens, order, test)
                    most, place = longest_places(reach, begin)
                    first_word, old = place - begin, longest[i:j]
                    for d in np.flatnonzero((most > old) | ((most == old) & (most > 0) & (first_word < at[i:j]))).tolist():
                        longest[i + d], item[i + d], at[i + d] = most[d], test.ids[test.item[source[place[d]]]], first_word[d]
                    if not hits:
                        continue
                    q, p, length = (np.concatenate(x) for x in zip(*hits))
                    d = doc[p]
                    # one row for each place (several items may share a window), one for each text and item
                    key = np.unique(np.stack([d, p - begin[d], length]), axis=1)
                    for a, b, c in key.T.tolist():
                        spans[i + a] += [b, c]
                    pairs = np.unique(np.stack([d, test.item[q]]), axis=1)
                    for a, b in pairs.T.tolist():
                        if test.ids[b] is not None:
                            found[i + a].append(test.ids[b])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(x)) for x in keep),
                    pa.array(total),
                    pa.array(spans, pa.list_(pa.int32())),
                    pa.array(found, pa.list_(pa.string())),
                    pa.array(longest),
                    pa.array(item, pa.string()),
                    pa.array([None if x < 0 else int(x) for x in at], pa.int64()),
                ],
                names=[*keep, *state],
            )

    return run


def _finish(state: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            col = {x: batch.column(batch.schema.get_field_index(x)) for x in batch.schema.names}
            hit, count, digest = [], [], []
            for spans, found in zip(col[state[1]].to_pylist(), col[state[2]].to_pylist()):
                reach = covered = 0
                for b, c in sorted(zip(spans[::2], spans[1::2])) if spans else ():
                    covered += max(0, b + c - max(b, reach))
                    reach = max(reach, b + c)
                hit.append(covered)
                ids = sorted(set(found or ()))
                count.append(len(ids))
                digest.append(hashlib.sha256(",".join(ids).encode()).hexdigest() if ids else empty)
            keep = [x for x in batch.schema.names if x not in state]
            yield pa.RecordBatch.from_arrays(
                [*(col[x] for x in keep), col[state[0]], pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), col[state[3]], col[state[4]], col[state[5]]],
                names=[*keep, *names],
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` of which no word lies inside an occurrence of a test window; same columns."""
    prefix = options.get("prefix", "dc_")
    flagged = flag(docs, benchmark, **options)
    return flagged.filter(F.col(f"{prefix}hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
