"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source's rows fall into blocks by a hash of their id, about `block_words` words each and at
   most `max_blocks` a source, so the block table stays small at any input size.
2. A source's target is reached by whole passes over its blocks and one partial pass: its blocks in
   a permuted order until the rest is used up, the last one only up to a cut in its rows' order.
   The cut is found by sums over slots of that order; only one slot's rows are ever sorted.
3. The draws of blocks are an exact quota for each source. A binary tree over the output shards
   splits that vector of quotas: each node draws its left half from a multivariate hypergeometric
   distribution (source by source, inverse of the cumulative distribution, seeded by node and
   source), down to exact quotas for each shard and source.
4. The shards then take disjoint runs of each source's permuted draws, and `place` orders the rows
   inside a shard.

Everything is DataFrame and SQL functions. Texts are not shuffled: rows meet the block table, whose
size is checked, by broadcast (or, beyond the bound, by a join on source and block).

Edge cases: a null source is a source of its own (last); a null or empty text has size 0 and is
never needed, but goes along with its block; empty tables give empty results; rows with one and the
same id stand or fall together; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnspan.session import cut

from .components import parts_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK_WORDS = 1 << 16
BLOCK_ROWS = 1 << 10
MAX_BLOCKS = 1 << 14
SLOT_BITS = 12  # of the turn of a row in its block
SHARDS = 16
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds src (0, 1, ...), weight and target to one row for each source (source, source_size).

    Shares go by weight; a source above `most` times its size is held there and the excess is
    shared out among the rest again. Sorted by the size a unit of weight allows, the held ones
    come first, so one running sum finds them all.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("src", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(cycle, (F.col("src") % len(weights) + 1).cast("int")))
    t = t.withColumn("most", F.col("source_size") * most).withColumn("room", F.col("most") / F.col("weight"))
    order = Window.orderBy("room", "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level).withColumn("held", F.col("level") > F.col("room"))
    final = F.min(F.when(~F.col("held"), F.struct(F.col("room"), F.col("src"), F.col("level")))).over(every)["level"]
    target = F.when(F.col("held"), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), final * F.col("weight")))
    return t.withColumn("target", target).select("source", "source_size", "n_rows", "src", "weight", "target")


def _uniform(*parts: str) -> str:
    return f"(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) * {2.0**-53!r}D)"


def _hypergeometric(pop: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of `marked` among `drawn` of `pop`: the inverse of the cumulative
    distribution by the ratio of neighbouring terms, over twelve deviations each way."""
    lo, hi = f"greatest(0L, {drawn} - ({pop} - {marked}))", f"least({marked}, {drawn})"
    mean = f"({drawn} * ({marked} / {pop}))"
    dev = f"sqrt({drawn} * ({marked} / {pop}) * (1 - {marked} / {pop}) * ({pop} - {drawn}) / greatest(1L, {pop} - 1))"
    a = f"greatest({lo}, cast(floor({mean} - 12 * {dev} - 12) as bigint))"
    b = f"least({hi}, cast(ceil({mean} + 12 * {dev} + 12) as bigint))"
    ratio = f"((({marked} - k + 1D) * ({drawn} - k + 1D)) / (k * ({pop} - {marked} - {drawn} + k + 0D)))"
    steps = f"if({b} > {a}, sequence({a} + 1, {b}), cast(array() as array<bigint>))"
    total = f"aggregate({steps}, named_struct('w', 1D, 's', 1D), (z, k) -> named_struct('w', z.w * {ratio}, 's', z.s + z.w * {ratio}), z -> z.s)"
    return (
        f"transform(array({u} * {total}), goal -> aggregate({steps}, named_struct('w', 1D, 's', 1D, 'x', {a}), "
        f"(z, k) -> if(z.s > goal, z, named_struct('w', z.w * {ratio}, 's', z.s + z.w * {ratio}, 'x', k)), z -> z.x))[0]"
    )


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(src, quota) to (src, ends): for each source the running sums of its quotas by shard.

    `shards` is a power of two. One row holds a node's vector of quotas, an entry a source.
    """
    depth = shards.bit_length() - 1
    if shards != 1 << depth:
        raise ValueError("shards must be a power of two")
    tree = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("src").cast("long").alias("src"), F.col("quota").cast("long").alias("n")))).alias("v"))
    tree = tree.select(F.lit(1).cast("long").alias("node"), "v")
    for _ in range(depth):
        u = _uniform(f"{seed}L", "node", "e.src")
        draw = f"if(e.n = 0 or acc.cap = 0, 0L, {_hypergeometric('acc.pop', 'e.n', 'acc.cap', u)})"
        step = f"transform(array({draw}), x -> named_struct('pop', acc.pop - e.n, 'cap', acc.cap - x, 'out', concat(acc.out, array(x))))[0]"
        total = "aggregate(v, 0L, (a, e) -> a + e.n)"
        left = f"aggregate(v, named_struct('pop', {total}, 'cap', {total} div 2, 'out', cast(array() as array<bigint>)), (acc, e) -> {step}, acc -> acc.out)"
        tree = tree.selectExpr("node", "v", f"{left} as l").selectExpr(
            "inline(array(named_struct('node', node * 2, 'v', zip_with(v, l, (e, x) -> named_struct('src', e.src, 'n', x))),"
            " named_struct('node', node * 2 + 1, 'v', zip_with(v, l, (e, x) -> named_struct('src', e.src, 'n', e.n - x)))))"
        )
    leaves = tree.selectExpr(f"node - {shards} as shard", "inline(v)")
    ends = "aggregate(array_sort(q), cast(array() as array<bigint>), (a, x) -> concat(a, array(x.n + if(size(a) = 0, 0L, element_at(a, -1)))))"
    return leaves.groupBy("src").agg(F.collect_list(F.struct("shard", "n")).alias("q")).selectExpr("cast(src as int) as src", f"{ends} as ends")


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    shards: int = SHARDS,
    seed: int = 17,
    block_words: int = BLOCK_WORDS,
    max_blocks: int = MAX_BLOCKS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, blocks): sizes of all rows; targets; and for each drawn block its draws
    (pass, shard) and, for the partial draw, the cut in its rows' order."""
    key = F.col(f"`{id_col}`")
    rows = cut(
        docs.select(
            key.alias("id"),
            F.col(f"`{source_col}`").alias("source"),
            word_count(F.col(f"`{text_col}`")).alias("size"),
        )
    )
    hashed = rows.withColumn("at", F.xxhash64(F.lit(seed), "id")).withColumn("turn", F.xxhash64(F.lit(seed + 1), "id"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    wanted = F.greatest(F.ceil(F.col("source_size") / block_words), F.ceil(F.col("n_rows") / BLOCK_ROWS), F.lit(1))
    sources = targets(sizes, weights, most).withColumn("n_blocks", F.least(wanted, F.lit(max_blocks)).cast("int"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    sources = sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    sources = cut(sources)
    n_sources = sources.count()
    few = n_sources <= BROADCAST_ROWS
    # Short tables are kept in few partitions, each a file. What sums up all rows is dealt anew only after that.
    files = parts_of(sources.agg(F.sum("n_blocks")).first()[0] or 0)
    slot_files = parts_of(n_sources << SLOT_BITS)  # a source has one block with a partial draw

    placed = with_source(hashed, sources, "source", few).withColumn("block", F.pmod("at", "n_blocks").cast("int"))
    blocks = placed.groupBy("src", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    blocks = cut(blocks.repartition(files))
    turn = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 2), "src", "block"), "block")
    run = F.sum("words").over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.withColumn("before", run - F.col("words")).withColumn("partial", F.col("before") < F.col("rest"))
    blocks = blocks.withColumn("left", F.when(F.col("partial") & (F.col("before") + F.col("words") > F.col("rest")), F.col("rest") - F.col("before")))

    drawn = blocks.withColumn("pass", F.explode(F.expr("filter(sequence(0, passes), p -> p < passes or partial)")))
    drawn = cut(drawn.select("src", "block", "pass", F.when(F.col("pass") == F.col("passes"), F.col("left")).alias("left")).coalesce(files))
    # The tree is long to plan and its result short, a row each source: it is cut, so that no other query plans it again.
    ends = cut(splitting_tree(drawn.groupBy("src").agg(F.count(F.lit(1)).alias("quota")), shards, seed + 3).coalesce(1))
    rank = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 4), "src", "block", "pass"), "block", "pass")
    ranked = drawn.withColumn("r", F.row_number().over(rank))
    sharded = ranked.join(F.broadcast(ends) if few else ends, "src").withColumn("shard", F.expr("size(filter(ends, x -> x < r))"))
    table = cut(sharded.groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"), F.max("left").alias("left")).coalesce(files))

    # The partial draw of a block: its rows by their turn as far as they fit, and the one row of the
    # others that comes nearest to the words still missing. Turns fall into slots, whose sums tell the
    # one slot that fits in part; only its rows are put in order.
    split = cut(table.filter("left is not null").selectExpr("src as s_src", "block as s_block", "left"))
    split = F.broadcast(split) if few else split
    inside = placed.join(split, (F.col("src") == F.col("s_src")) & (F.col("block") == F.col("s_block")))
    inside = inside.select("src", "block", "left", "turn", "size", F.shiftright("turn", 64 - SLOT_BITS).alias("slot"))
    own = Window.partitionBy("src", "block").orderBy("slot")
    slots = inside.groupBy("src", "block", "left", "slot").agg(F.sum("size").alias("words"))
    slots = slots.withColumn("upto", F.sum("words").over(own))
    edge = slots.groupBy("src", "block", "left").agg(
        F.max(F.when(F.col("upto") <= F.col("left"), F.struct("slot", "upto"))).alias("full"), F.min(F.when(F.col("upto") > F.col("left"), F.col("slot"))).alias("slot")
    )
    before = F.coalesce("full.upto", F.lit(0)).alias("before")
    edge = cut(edge.select(F.col("src").alias("e_src"), F.col("block").alias("e_block"), F.col("slot").alias("e_slot"), before, F.col("full.slot").alias("full_slot")).coalesce(slot_files))
    edge = F.broadcast(edge) if few else edge
    inside = inside.join(edge, (F.col("src") == F.col("e_src")) & (F.col("block") == F.col("e_block")))
    by_turn = Window.partitionBy("src", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    parts = inside.filter("slot = e_slot").groupBy("src", "block", "left", "before", "turn").agg(F.sum("size").alias("size"))
    parts = parts.withColumn("upto", F.col("before") + F.sum("size").over(by_turn)).filter(F.col("upto") <= F.col("left"))
    parts = parts.groupBy("src", "block").agg(F.max(F.struct("turn", "upto")).alias("last"))
    last_of = F.expr(f"if(full_slot is null, null, shiftleft(full_slot, {64 - SLOT_BITS}) + {(1 << (64 - SLOT_BITS)) - 1}L)")  # the last turn of a slot
    ends = edge.join(parts, (F.col("e_src") == F.col("src")) & (F.col("e_block") == F.col("block")), "left")
    ends = cut(ends.select("e_src", "e_block", F.coalesce("last.turn", last_of).alias("cut"), F.coalesce("last.upto", "before").alias("got")).coalesce(slot_files))
    rest = inside.drop("e_src", "e_block").join(F.broadcast(ends) if few else ends, (F.col("src") == F.col("e_src")) & (F.col("block") == F.col("e_block")))
    rest = rest.filter("cut is null or turn > cut").groupBy("src", "block", "turn", "left", "got").agg(F.sum("size").alias("own"))
    rest = rest.withColumn("off", F.abs(F.col("left") - F.col("got") - F.col("own"))).filter("off < left - got")
    extra = rest.groupBy("src", "block").agg(F.min(F.struct("off", "turn"))["turn"].alias("extra"))
    cuts = ends.selectExpr("e_src as src", "e_block as block", "cut").join(extra, ["src", "block"], "left")
    lowest = F.lit(-(1 << 63)).cast("long")
    table = table.join(cuts, ["src", "block"], "left").select(
        "src", "block", "draws", F.when(F.col("left").isNotNull(), F.coalesce("cut", lowest)).alias("cut"), "extra"
    )
    return rows, sources, cut(table.coalesce(files))


def with_source(rows: DataFrame, sources: DataFrame, source_col: str, few: bool) -> DataFrame:
    """Joins the (checked, small) table of sources, nulls included."""
    right = sources.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(right) if few else right, F.col(f"`{source_col}`").eqNullSafe(F.col("__source"))).drop("__source")


def _draws(rows: DataFrame, blocks: DataFrame, seed: int, fits: bool) -> DataFrame:
    """Adds the rows' own draws: those of their block, the last one only up to the cut."""
    taken = "if(cut is null, draws, if(turn <= cut or turn <=> extra, draws, slice(draws, 1, size(draws) - 1)))"
    joined = rows.join(F.broadcast(blocks) if fits else blocks, ["src", "block"], "left")
    return joined.withColumn("draws", F.coalesce(F.expr(taken), F.expr("cast(array() as array<struct<pass:int,shard:int>>)")))


def taken(docs: DataFrame, id_col: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """One row for each row of `docs`: id, size, source_size, target, taken (words the mix takes,
    repeats counted) and draws (pass, shard)."""
    rows, sources, blocks = plan(docs, id_col=id_col, seed=seed, **options)
    few, fits = sources.count() <= BROADCAST_ROWS, blocks.count() <= BROADCAST_ROWS
    rows = with_source(rows, sources, "source", few)
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), "n_blocks").cast("int")).withColumn("turn", F.xxhash64(F.lit(seed + 1), "id"))
    out = _draws(rows, blocks, seed, fits)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, copies: str = "copies", **options) -> DataFrame:
    """The rows of `docs` that the mix takes, with `copies`: an array of (pass, shard, place), one
    entry for each time the row is taken. Explode it and order by shard and place to lay out shards."""
    if copies.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"a column {copies} is in the way; choose another name")
    _, sources, blocks = plan(docs, id_col=id_col, source_col=source_col, seed=seed, **options)
    few, fits = sources.count() <= BROADCAST_ROWS, blocks.count() <= BROADCAST_ROWS
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"))
    rows = with_source(packed, sources.select("source", "src", "n_blocks"), "source", few)
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), "n_blocks").cast("int")).withColumn("turn", F.xxhash64(F.lit(seed + 1), "id"))
    out = _draws(rows, blocks, seed, fits).filter(F.size("draws") > 0)
    place = F.expr(f"transform(draws, d -> named_struct('pass', d.pass, 'shard', d.shard, 'place', xxhash64({seed + 5}, id, d.pass, d.shard)))")
    return out.select("doc.*", place.alias(copies))
