"""The methods against brute force, exact round trips and held-out accuracy."""

import io
import os
import random
import tracemalloc
import zipfile
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnspan.llm import components, decontaminate, html_text, language, mixing, neardup, quality_rank, textnum, token_counts, toxicity, warc
from turnspan.llm.registry import QUERIES, table
from turnspan.session import cut, shared_dir
import turnspan.llm.queries  # noqa: F401, I001

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def packed(texts):
    return textnum.column_bytes(pa.array(texts, pa.string()))


# ---- words ----------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["The  cat\tsat", None, "", "über Ärger, ok-2", "the averyveryverylongwordindeed averyveryverylongwordinDeed"]
    data, offs = packed(texts)
    w = textnum.Words(data, offs, textnum.ALNUM, fold=True)
    got = [[bytes(w.bytes[a:b]).decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.off[:-1], w.off[1:])]
    assert got[0] == ["the", "cat", "sat"] and got[1] == got[2] == [] and got[3] == ["über", "Ärger", "ok", "2"]
    h = w.hashes()
    assert h[0] == h[w.off[4]] and h[w.off[4] + 1] == h[w.off[4] + 2] and len(set(h.tolist())) == len({x for t in got for x in t})
    g, begin = textnum.windows(h, w.off, 2)
    assert begin.tolist() == [0, 1, 3, 4, 5, 7, 8]


# ---- decontamination ------------------------------------------------------------------------


def test_suffix_array():
    rng = np.random.default_rng(0)
    for depth in (1, 4, 64):
        t = rng.integers(1, 4, 300).astype(np.uint64)
        order = decontaminate.suffix_array(t, depth).tolist()
        key = [tuple(t[i : i + depth].tolist()) for i in order]
        assert sorted(order) == list(range(300)) and key == sorted(key)


def test_longest_of_each_text_by_brute_force(spark):
    """A text's longest match is its own, whatever texts lie beside it and however the rows and the items are cut."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    texts += texts[:20] + ["q r s t u v w x", "zz q r s t u v w"]  # repeated rows share every match
    items = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 16))) for _ in range(9)] + ["q r s t u v w y", None, ""]

    def longest(text):
        words, runs = text.split(), {0}
        for item in items:
            w = (item or "").split()
            for i in range(len(words)):
                for k in range(len(w)):
                    n = 0
                    while i + n < len(words) and k + n < len(w) and words[i + n] == w[k + n]:
                        n += 1
                    runs.add(n)
        return max(runs)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(str(i), x) for i, x in enumerate(items)], "item_id string, text string")
    want = {i: longest(x) for i, x in enumerate(texts)}
    rest = None
    for parts, block in ((1, 10**6), (5, 10**6), (3, 1)):  # the last: a block for each item, so several passes
        rows = decontaminate.flag(docs.repartition(parts), bench.coalesce(1), block_words=block).collect()
        assert {r.doc_id: r.dc_longest for r in rows} == want
        for r in rows:
            at, n = r.dc_longest_at, r.dc_longest
            assert (at is None) == (n == 0)
            if n:
                run = " ".join(texts[r.doc_id].split()[at : at + n])
                assert f" {run} " in f" {items[int(r.dc_longest_item)]} "
        whole = sorted((r.doc_id, r.dc_hit, r.dc_items, r.dc_items_sha256, r.dc_longest_at) for r in rows)
        assert rest in (None, whole)
        rest = whole


def test_longest_matches():
    rng = random.Random(4)
    docs = [" ".join(rng.choice("abc") for _ in range(40)) for _ in range(20)]
    items = [" ".join(rng.choice("abc") for _ in range(12)) for _ in range(5)]
    test = decontaminate.TestSet([str(i) for i in range(5)], items, 10)
    data, offs = packed(docs)
    tokens, _ = decontaminate.shard_tokens(textnum.Words(data, offs, textnum.ALNUM, fold=True))
    best, _, _, hits = decontaminate.search(tokens, decontaminate.suffix_array(tokens, test.longest), test)
    for q, b in enumerate(best.tolist()):
        words = items[q // 12].split()[q % 12 :]
        longest = max(n for n in range(len(words) + 1) if n == 0 or any(f" {' '.join(words[:n])} " in f" {d} " for d in docs))
        assert b == longest


# ---- mixing ---------------------------------------------------------------------------------


def test_targets_fill_like_repeated_resharing(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 50), (None, 400), ("d", 0), ("e", 3)]
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, source_size long, n_rows long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    order = ["a", "b", "c", "d", "e", None]
    weight, size = dict(zip(order, [1, 2, 3, 1, 2, 3])), dict(sizes)
    held: set = set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in held)
        level = left / sum(weight[s] for s in order if s not in held)
        new = {s for s in order if s not in held and level * weight[s] > 3 * size[s]}
        if not new:
            break
        held |= new
    for s in order:
        assert abs(got[s] - (3 * size[s] if s in held else level * weight[s])) < 1e-9
    assert abs(sum(got.values()) - sum(size.values())) < 1e-6


def test_splitting_tree_keeps_quotas(spark):
    quota = {0: 40, 1: 7, 2: 0, 3: 301}
    df = spark.createDataFrame(list(quota.items()), "src int, quota long")
    ends = {r.src: r.ends for r in mixing.splitting_tree(df, 8, 5).collect()}
    assert {s: e[-1] for s, e in ends.items()} == quota
    counts = np.array([np.diff([0, *ends[s]]) for s in sorted(ends)])
    assert (counts >= 0).all() and counts.sum(axis=0).max() - counts.sum(axis=0).min() <= 1


def test_hypergeometric_draws(spark):
    n = 4000
    u = "(id + 0.5D) / 4000"
    got = [r.x for r in spark.range(n).selectExpr(f"{mixing._hypergeometric('100L', '30L', '20L', u)} as x").collect()]
    from math import comb

    want = [comb(30, k) * comb(70, 20 - k) / comb(100, 20) for k in range(21)]
    have = np.bincount(got, minlength=21) / n
    assert np.abs(have - want).max() < 2 / n + 1e-9


def test_shards_and_reruns(spark):
    """Draws of each source and shard are the tree's; any partitioning, and docs of a range, give the same."""
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "concat('s', cast(least(id % 7, 2) as string)) as source")
    options = {"block_words": 500, "shards": 4}
    one = {r.doc_id: (r.taken, sorted(d.shard for d in r.draws)) for r in mixing.taken(docs, **options).collect()}
    two = {r.doc_id: (r.taken, sorted(d.shard for d in r.draws)) for r in mixing.taken(docs.repartition(7), **options).collect()}
    assert one == two
    _, sources, blocks = mixing.plan(docs, **options)
    drawn = np.zeros(4, int)
    for r in blocks.collect():
        for d in r.draws:
            drawn[d.shard] += 1
    assert drawn.max() - drawn.min() <= 3  # halves, and halves of these
    wanted = {r.source: r.target for r in sources.collect()}
    total: Counter = Counter()
    for r in docs.collect():
        total[r.source] += one[r.doc_id][0]
        assert one[r.doc_id][0] <= 3 * len(r.text.split())
    assert all(abs(total[x] - wanted[x]) <= 1 for x in wanted)


def test_the_splitting_tree_is_planned_once(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "concat('s', cast(id % 3 as string)) as source")
    plans = []
    monkeypatch.setattr(mixing, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    _, sources, blocks = mixing.plan(docs, block_words=500, shards=4)
    plans += [df._jdf.queryExecution().optimizedPlan().toString() for df in (sources, blocks)]
    assert sum("zip_with" in p for p in plans) == 1


def test_short_tables_of_the_mix_are_few_files(spark, monkeypatch):
    """A file for each shuffle partition, most of them empty, means a process for each on a cluster without Hadoop's native library."""
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "concat('s', cast(id % 3 as string)) as source").coalesce(2)
    options = {"block_words": 500, "shards": 4}
    want = sorted(map(str, mixing.taken(docs, **options).collect()))
    made = []
    monkeypatch.setattr(mixing, "cut", lambda df: made.append(cut(df)) or made[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(str, mixing.taken(docs, **options).collect())) == want
        assert made and max(df.rdd.getNumPartitions() for df in made) <= 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@needs_tables
def test_mix_comes_near_targets(spark):
    got = QUERIES["op1_mixing"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.expr("taken / greatest(size, 1)")).alias("most")).collect():
        assert abs(r.taken - r.target) < 0.03 * r.target and r.most <= 3


# ---- near duplicates ------------------------------------------------------------------------


def bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def weighted_jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_signatures_are_unbiased():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    errors = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(8, 200))] * rng.choice([1, 1, 3])
        other = base[:]
        for _ in range(rng.randint(0, 6)):
            other[rng.randrange(len(other))] = rng.choice(words)
        a, b = " ".join(base), " ".join(other)
        sig, size = neardup.bag_minhash(*packed([a, b]))
        assert size.tolist() == [sum(bag(a).values()), sum(bag(b).values())]
        equal = (sig[0] == sig[1]).mean()
        errors.append((equal - 1 / 256) / (1 - 1 / 256) - weighted_jaccard(bag(a), bag(b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_counts_weigh():
    a, b = "a b c d e " * 20, "a b c d e " * 40
    sig, _ = neardup.bag_minhash(*packed([a, b]))
    assert abs((sig[0] == sig[1]).mean() - weighted_jaccard(bag(a), bag(b))) < 0.15


def test_classes_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if weighted_jaccard(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == {i: find(i) for i in range(len(texts))}


def test_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(300)}" for _ in range(100)]
    rows = []
    for i in range(60):
        copy = base[:]
        copy[i] = f"x{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 7)
    assert {r.class_id for r in neardup.classes(df).collect()} == {0}
    # A chain, whose ends are far apart, and texts that share a passage but are no copies.
    chain, rows = base[:], []
    for i in range(40):
        chain = chain[:]
        chain[(i * 7) % 100] = f"y{i}"
        rows.append((i, " ".join(chain)))
    rows += [(100 + i, " ".join([f"z{rng.randrange(10**6)}" for _ in range(70)] + base[:30])) for i in range(40)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 100 else i for i, _ in rows}


def test_rows_of_one_id(spark):
    a, b, c = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    rows = [("1", a), ("5", a), ("5", b), ("5", c), ("7", c), ("7", c), (None, c), ("8", None), ("9", "!!! ???"), ("10", "!!! ???"), ("8", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = sorted((r.doc_id or "", r.text or "") for r in neardup.deduplicate(df).collect())
    assert got == sorted([("1", a), ("5", b), ("5", c), ("", c), ("8", ""), ("8", ""), ("10", "!!! ???")])
    assert sorted((r.doc_id, r.class_id) for r in neardup.classes(df).collect() if r.doc_id) == sorted([("1", "1"), ("5", "1"), ("5", "5"), ("5", "5"), ("7", "5"), ("7", "5"), ("8", "8"), ("9", "10"), ("10", "10"), ("8", "8")])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (200, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 105: 100}


# ---- archives -------------------------------------------------------------------------------


@pytest.mark.parametrize("zip64", [False, True])
def test_archive_round_trip(zip64):
    payloads = [b"", b"<p>PK\x05\x06</p>" * 3, "é".encode() * 1000]
    records = [(i, "http://x", warc.write_record(i, "http://x", p, warc.digest_of(p), None)) for i, p in enumerate(payloads)]
    records.append((9, "u", warc.write_record(9, "u", payloads[2], warc.digest_of(payloads[2]), 2)))
    data = warc.pack(records, zip64)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    for ranges in (warc.BytesRanges(data), warc.FileRanges(io.BytesIO(data))):
        got = [r for *_, r in warc.read_archive(ranges)]
        assert [r["payload"] for r in got] == [*payloads, None] and got[3]["refers_to"] == 2 and got[3]["payload_bytes"] == 2000


def test_zip64_end_record():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(70_000):  # more entries than a plain end record can count
            z.writestr(f"m{i}", b"x" if i != 69_999 else b"last")
    ranges = warc.BytesRanges(out.getvalue())
    members = warc.read_directory(ranges)
    assert len(members) == 70_000 and ranges.read(*warc.stored(ranges, members, "m69999")) == b"last"


def test_archives_that_can_not_be_read():
    with pytest.raises(ValueError):
        warc.read_directory(warc.BytesRanges(b"no archive"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA, b"x" * 1000)
    ranges = warc.BytesRanges(out.getvalue())
    with pytest.raises(ValueError):
        warc.stored(ranges, warc.read_directory(ranges), warc.DATA)
    with pytest.raises(ValueError):
        warc.stored(ranges, {}, warc.DATA)


# ---- token counts ---------------------------------------------------------------------------


def test_rollup_of_deltas(spark, tmp_path):
    rows = [("s", "en", "v1", 10), ("s", "en", "v1", 5), ("q", None, "v1", 3)]
    counts = spark.createDataFrame(rows, "source string, lang string, tokenizer string, n_tokens long")
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    r.commit("a", token_counts.inserts(counts))
    r.commit("b", token_counts.revisions(counts.withColumn("new_tokens", F.col("n_tokens") * 2)))
    r.commit("c", token_counts.deletes(spark.createDataFrame([("q", None, "v1", 6)], counts.schema)))
    want = [("s", "en", "v1", 2, 30)]
    assert [tuple(x) for x in r.totals().collect()] == want
    os.remove(tmp_path / "r" / "batches" / "c" / "_SUCCESS")  # as if the writer had died
    assert len(r.totals().collect()) == 2
    assert r.commit("c", token_counts.deletes(spark.createDataFrame([("q", None, "v1", 6)], counts.schema)))
    r.compact()
    assert [tuple(x) for x in r.totals().collect()] == want
    assert not r.commit("a", token_counts.inserts(counts))
    r.clean()
    assert [tuple(x) for x in r.totals().collect()] == want and not r.commit("a", token_counts.inserts(counts)) and r.batches() == ["a", "b", "c"]


@needs_tables
@pytest.mark.skipif(not os.path.isdir(token_counts.TOKENIZERS), reason="no vocabularies")
def test_token_counts_equal_plain_encoding(spark):
    import tiktoken

    rows = table(spark, SF, "documents").select("source", "lang", "text").collect()
    want: Counter = Counter()
    for version in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        e = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_ranks(f"{token_counts.TOKENIZERS}/{version}.tiktoken"), special_tokens={})
        for r in rows:
            want[r.source, r.lang, version, "docs"] += 1
            want[r.source, r.lang, version, "tokens"] += len(e.encode_ordinary(r.text or ""))
    got = {}
    for r in QUERIES["op5_token_counts"](spark, SF).collect():
        got |= {(r.source, r.lang, r.tokenizer, "docs"): r.n_docs, (r.source, r.lang, r.tokenizer, "tokens"): r.n_tokens}
    assert got == dict(want)
    text = "a bc " * 60_000
    assert sum(len(e.encode_ordinary(p)) for p in token_counts.pieces(text)) == len(e.encode_ordinary(text))


def test_bases_never_share_a_name(spark, tmp_path):
    counts = spark.createDataFrame([("s", "en", "v", 4)], "source string, lang string, tokenizer string, n_tokens long")
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    names = []
    for i in range(3):
        r.commit(f"b{i}", token_counts.inserts(counts))
        r.compact()
        names += r._names("bases")[-1:]
        r.clean()
    assert len(set(names)) == 3 and [tuple(x) for x in r.totals().collect()] == [("s", "en", "v", 3, 12)]


# ---- classifiers ----------------------------------------------------------------------------


def test_block_max_index_is_exact():
    rng = np.random.default_rng(3)
    n, terms = 700, 40
    dense = np.where(rng.random((n, terms)) < 0.08, rng.random((n, terms)), 0)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    e, t = np.nonzero(dense)
    index = toxicity.BlockMaxIndex.build(list(range(n)), np.zeros(n), e, t, dense[e, t])
    for _ in range(50):
        q = np.where(rng.random(terms) < 0.2, rng.random(terms), 0)
        q /= max(np.linalg.norm(q), 1e-12)
        got_e, got_c = index.top(np.flatnonzero(q), q[np.flatnonzero(q)], 15)
        cosine = dense @ q
        want = np.lexsort((np.arange(n), -cosine))[:15]
        want = want[cosine[want] > 0]
        assert np.allclose(got_c, cosine[want]) and np.allclose(np.sort(cosine[got_e]), np.sort(cosine[want]))


def test_near_duplicate_tables_are_few_files(spark):
    """A checkpoint has a file for each partition, and each file is a process that Hadoop starts."""
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('one two three four five six seven eight nine ten ', repeat('on and on ', cast(id % 50 AS int)), id % 100) AS text")
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    files = lambda: sum(1 for _ in Path(shared_dir(spark).removeprefix("file:")).rglob("part-*"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        had = files()
        got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files() - had < 200
    assert len(got) == 300 and all(got[i] == got[i % 100] for i in range(300))


def test_near_duplicate_kernels_hold_few_pairs():
    n, groups = 6000, 6
    sig = np.random.default_rng(0).integers(0, 256, neardup.COMPONENTS).astype(np.uint8).tobytes()
    node = np.arange(n)
    batch = pa.RecordBatch.from_arrays([pa.array(node * groups // n), pa.array(node), pa.array(node), pa.array([sig] * n), pa.array(["a b c d e f"] * n)], names=["g", "node", "kin", "sig", "text"])
    for kernel, columns in ((neardup._candidates, 4), (neardup._verified, 5)):
        tracemalloc.start()
        links = {u: v for t in kernel(iter([batch.select(range(columns))])) for u, v in zip(t.column(0).to_pylist(), t.column(1).to_pylist())}
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert links == {x: x // 1000 * 1000 for x in range(n) if x % 1000}
        assert peak < 50, peak


def test_pairwise_ranking_learns_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(quality_rank.FEATURES)))
    y = (x[:, 0] - 2 * x[:, 3] + 0.3 * rng.normal(size=600) > -1).astype(int)
    m = quality_rank.learn(x, y)
    raw = np.clip((x - m.mean) / m.scale, -6, 6) @ m.weights
    assert ((raw >= m.threshold) == (y == 1)).mean() > 0.93
    assert abs((raw < m.threshold).mean() - (y == 0).mean()) < 0.01


def test_quality_learns_from_every_pair():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(quality_rank.FEATURES)))
    y = (x[:, 0] - 2 * x[:, 3] + rng.normal(size=300) > -1).astype(int)
    m = quality_rank.learn(x, y)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -6, 6)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(20):
        p = 1 / (1 + np.exp(diff @ w))
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, diff.T @ p / len(diff) - 1e-2 * w)
    assert np.abs(m.weights - w).max() < 1e-3
    raw = np.sort(np.clip((x - m.mean) / m.scale, -6, 6) @ m.weights)
    n = int((y == 0).sum())
    assert abs(m.threshold - (raw[n - 1] + raw[n]) / 2) < 1e-9 and abs(m.spread - raw.std() / 2) < 1e-6


def test_quality_learns_from_every_labelled_row(spark):
    n = 24_000
    text = "CASE WHEN id % 3 = 0 THEN repeat('ab ', cast(id % 40 AS int)) ELSE concat('word ', id, ' and more, of ', id * 7, '.') END"
    docs = spark.range(n).selectExpr("id AS doc_id", f"{text} AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "cast(id % 3 > 0 AS int) AS quality")
    m = quality_rank.fit(docs, labels)
    rows = docs.orderBy("doc_id").collect()
    data = np.frombuffer("".join(r.text for r in rows).encode(), np.uint8)
    x = quality_rank.features(data, np.cumsum([0] + [len(r.text) for r in rows]))
    assert np.abs(m.mean - x.mean(axis=0)).max() < 1e-7
    want = quality_rank.learn(x, np.arange(n) % 3 > 0)
    other = quality_rank.fit(docs.repartition(7), labels.repartition(3))
    for a in (m, other):  # the same to the last bit, whatever the partitions
        assert (a.weights == want.weights).all() and (a.threshold, a.spread) == (want.threshold, want.spread)


def held_out(spark, name, column):
    got = QUERIES[name](spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    return [(getattr(r, column), r.predicted, r.score) for r in got]


@needs_tables
def test_quality_held_out(spark):
    rows = held_out(spark, "op7_quality_rank", "quality")
    assert sum(a == b for a, b, _ in rows) / len(rows) > 0.97


@needs_tables
def test_toxicity_held_out(spark):
    rows = held_out(spark, "op8_toxicity", "toxic")
    assert sum(a == b for a, b, _ in rows) / len(rows) > 0.9
    known = table(spark, SF, "documents").filter(F.col("text").rlike("(?i)\\b(scum|moron|worthless)\\b")).select("doc_id")
    assert QUERIES["op8_toxicity"](spark, SF).join(known, "doc_id").filter("predicted = 0").count() <= 0.05 * known.count() + 1


@needs_tables
def test_language_held_out(spark):
    got = QUERIES["op9_language_id"](spark, SF).filter("held_out").join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_language_model_without_a_sample_on_the_driver(spark, monkeypatch):
    """The model is that of k-means on all vectors here, though the driver gets centroids only."""
    rng = np.random.default_rng(4)
    texts = {x: ["".join(rng.choice(list(letters), 60)) for _ in range(120)] for x, letters in (("aa", "abcde fg"), ("bb", "ghijkl mno"))}
    texts["zz"] = ["12 34", "", "!"]  # no letters: a language without centroids
    rows = [(t, x) for x, some in texts.items() for t in some] + [(None, "aa"), ("abc", None)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    sent, collect = [], type(docs).collect

    def counted(df):
        got = collect(df)
        sent.extend(len(x) for r in got for x in r if isinstance(x, (bytes, bytearray)))
        return got

    monkeypatch.setattr(type(docs), "collect", counted)
    model = language.fit(docs)
    assert sum(sent) <= model.centroids.nbytes
    assert model.languages == ("aa", "bb", "zz") and model.owner.tolist() == [0, 0, 0, 1, 1, 1] and model.reject_below[2] == 0
    for i, x in enumerate(("aa", "bb")):
        v = language.vectors(language.gram_counts(*packed(texts[x]), model.dims), model.idf).astype(np.float16)
        p = np.array(sorted(v, key=lambda row: row.tobytes())).astype(np.float32)
        c = language.kmeans(p, 3)
        assert np.allclose(model.centroids[model.owner == i], c, atol=1e-6)
        assert model.reject_below[i] == pytest.approx(0.5 * np.quantile((p @ c.T).max(axis=1), 0.005), abs=1e-6)


# ---- pages ----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Home</a> Site name</header>
<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="post-%d content"><h1>Title &amp; more</h1><p>First   paragraph &eacute; of the text,<br>with a <b>bold</b> word.<p>Second one, which is longer than the first one.
<div class="ad">Buy it</div><ul><li>Point one</li><li>Point two</li></ul></div><aside>Side</aside>
<section class="comments"><p>A reader's comment that is quite long, longer than all of the text of the page and so on and on and on.</p></section></div>
<form><input name=q> Search</form><footer>&copy; all</footer><script>var x = "</p>";</script></body></html>"""
TEXT = "Title & more\nFirst paragraph é of the text, with a bold word.\nSecond one, which is longer than the first one.\nPoint one\nPoint two"


def test_pages_and_consensus(spark):
    blocks = html_text.blocks_of(PAGE % 1)
    assert "\n".join(t for t, _ in blocks) == TEXT and html_text.text_under(blocks, html_text.best_container(html_text.container_scores(blocks)).key) == TEXT
    odd = PAGE.replace("%d", "9").replace("First   paragraph &eacute; of the text,<br>with a <b>bold</b> word.<p>Second one, which is longer than the first one.", "Short.")
    rows = [(i, f"http://h.example/{i}", PAGE % i) for i in range(6)] + [(7, "http://h.example/7", odd)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == TEXT and got[1].n_chars == len(TEXT)
    assert got[7].text == "Title & more\nShort.\nPoint one\nPoint two" and got[7].path == got[1].path


def test_odd_pages():
    def text(page):
        return "\n".join(t for t, _ in html_text.blocks_of(page))

    assert text("""<p title="a"b">one<p title='it's'>two<p data-x="a > b">three < 4<p x=">">5""") == "one\ntwo\nthree < 4\n5"
    sections = "".join(f"<section class={c}><p>Of {c}.</p></section>" for c in ("discussion", "legal", "search", "tags", "related", "alert"))
    assert text(f"<article><p>First.</p>{sections}<div class=related><a href=/>All links</a></div></article>").count("\n") == 6
    assert text("<div class=legal><p>No.</p></div><p>Yes.</p><a ") == "Yes."


@pytest.mark.parametrize("odd", ["<a ", "<div class=abc>", "<button>", "</section>", "<p x='", "<!-", "<div></section>", "&lt;", "<a b=\""])
def test_long_odd_pages_take_linear_time(odd):
    import time

    page = odd * (1_000_000 // len(odd))
    began = time.perf_counter()
    blocks = html_text.blocks_of(page)
    html_text.container_scores(blocks), html_text.keys_of(blocks)
    assert time.perf_counter() - began < 15


@needs_tables
def test_pages_of_the_tables(spark):
    import html
    import re

    got = {r.page_id: r.text for r in QUERIES["op10_html_text"](spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inside))
        assert got[r.page_id] == "\n".join(p for p in parts if p)
