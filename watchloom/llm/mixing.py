"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame and SQL functions. The steps:

1. A source's target is its share by weight of ``total`` times all words, at
   most ``most`` times its own words; what a full source cannot take goes to the
   others by weight.
2. Documents are cut into blocks of words. A source's blocks stand in a fixed
   random order (by hash). A target takes the whole order as often as it fits,
   then its first blocks up to the rest, to half a block near.
3. The number of blocks taken from each source is known exactly. A binary tree
   over the output shards splits these numbers: at each node, what the left half
   gets of each source is drawn from the multivariate hypergeometric
   distribution, one source after the other, by inversion.
4. A shard's number for a source is a run of the source's order, so shards are
   disjoint. Within a shard, ``position_key`` gives the order of a local shuffle.

A source may hold any share of the rows: its order is made from bins of bounded
size, and only totals per bin and per source come together.

Given rows: a null text has no words and no block; a null source is a source of
its own, after all others; rows that repeat are told apart, and which of them
gives a block does not show in the result; an empty table gives no rows. Reruns
agree, also over other file layouts, since order comes from ids and text hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
WORD_SQL = WORD.replace("\\", "\\\\")
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 128
BIN_BLOCKS = 4096
LEVELS = 4  # of the tree: 16 shards


def sized(documents: DataFrame, seed: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Written once: a row number, id, source, words, a hash to order by, and columns ``carried`` along."""
    spark = documents.sparkSession
    path = scratch_path(spark, "sized")
    documents.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("order"),
        *(F.col(c).alias(f"given_{c}") for c in carried),
    ).write.parquet(path)
    return spark.read.parquet(path)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0,
            block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: number, words, blocks and target.

    With sources ordered by cap over weight, the level at which the rest share
    is known for each prefix of full sources; the first prefix whose next source
    stays below its cap is the right one.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum(F.ceil(F.col("size") / block_words)).cast("long").alias("blocks"),
    )
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = per.withColumn("source_no", number).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    all_rows = Window.partitionBy(F.lit(1))
    goal = total * F.sum("source_size").over(all_rows)
    full_before = F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap")
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (goal - full_before) / weight_left)
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(all_rows)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return per.withColumn("target", target).select("source", "source_no", "source_size", "blocks", "target")


def _fold(items: str, way: str, found: bool) -> str:
    """Sum of the weights on one side of the mode, or where ``p.left`` runs out on that side.

    The weight at the mode is 1, the others follow by the ratio of neighbours.
    """
    if way == "up":
        ratio = "(double(p.k - x) * (p.n - x)) / (double(x + 1) * (p.rest - p.n + x + 1))"
        there = "x + 1"
    else:
        ratio = "(double(x) * (p.rest - p.n + x)) / (double(p.k - x + 1) * (p.n - x + 1))"
        there = "x - 1"
    if not found:
        return f"""aggregate({items}, named_struct('w', 1D, 'sum', 0D),
          (t, x) -> named_struct('w', t.w * {ratio}, 'sum', t.sum + t.w * {ratio}), t -> t.sum)"""
    return f"""aggregate({items}, named_struct('w', 1D, 'left', p.left, 'at', p.mode),
      (t, x) -> if(t.left < 0, t, named_struct('w', t.w * {ratio}, 'left', t.left - t.w * {ratio},
        'at', {there})), t -> t.at)"""


def hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for how many of ``drawn`` out of ``total`` are marked, by inversion from the mode outwards.

    Values beyond ten standard deviations of the mode are left out of the sum.
    """
    up = "if(p.hi > p.mode, sequence(p.mode, p.hi - 1), cast(array() as array<bigint>))"
    down = "if(p.lo < p.mode, sequence(p.mode, p.lo + 1, -1), cast(array() as array<bigint>))"
    return f"""
    transform(transform(transform(transform(array(named_struct(
        'k', {marked}, 'n', {drawn}, 'rest', {total} - {marked}, 'u', {uniform})),
      p -> named_struct('k', p.k, 'n', p.n, 'rest', p.rest, 'u', p.u,
        'mode', greatest(p.n - p.rest, 0L, least(p.k, p.n,
           cast(floor((p.n + 1D) * (p.k + 1D) / (p.k + p.rest + 2D)) as bigint))),
        'wide', 10L + cast(10 * sqrt(p.n * (p.k / greatest(p.k + p.rest, 1D))
           * (p.rest / greatest(p.k + p.rest, 1D))) as bigint))),
      p -> named_struct('k', p.k, 'n', p.n, 'rest', p.rest, 'u', p.u, 'mode', p.mode,
        'lo', greatest(0L, p.n - p.rest, p.mode - p.wide), 'hi', least(p.k, p.n, p.mode + p.wide))),
      p -> named_struct('k', p.k, 'n', p.n, 'rest', p.rest, 'u', p.u, 'mode', p.mode, 'lo', p.lo, 'hi', p.hi,
        'up', {_fold(up, "up", False)}, 'down', {_fold(down, "down", False)})),
      p -> transform(array(named_struct('k', p.k, 'n', p.n, 'rest', p.rest, 'mode', p.mode, 'lo', p.lo, 'hi', p.hi,
          'up', p.up, 'v', p.u * (1 + p.up + p.down) - 1)),
        o -> if(o.v < 0, o.mode, transform(array(named_struct('k', o.k, 'n', o.n, 'rest', o.rest, 'mode', o.mode,
            'lo', o.lo, 'hi', o.hi, 'up', o.v < o.up, 'left', if(o.v < o.up, o.v, o.v - o.up))),
          p -> if(p.up, {_fold(up, "up", True)}, {_fold(down, "down", True)}))[0]))[0])[0]"""


def split(quotas: DataFrame, seed: int, levels: int = LEVELS) -> DataFrame:
    """(shard, source_no, quota) from (source_no, quota): exact for each source, shards of equal size.

    A node's two halves differ by one block at most.
    """
    one = F.array_sort(F.collect_list(F.struct("source_no", "quota")))
    nodes = quotas.agg(one.alias("sources")).select(
        F.lit(0).cast("long").alias("node"), F.transform("sources", lambda s: s["source_no"]).alias("numbers"),
        F.transform("sources", lambda s: s["quota"]).alias("q"),
    )
    for level in range(levels):
        uniform = f"(xxhash64({seed}, {level}, node, i) / 18446744073709551616D + 0.5D)"
        draw = hypergeometric("s.total", "q[i]", "s.draw", uniform)
        nodes = nodes.withColumn("left", F.expr(f"""
            if(size(q) = 0, q, aggregate(sequence(0, size(q) - 1),
              named_struct('total', aggregate(q, 0L, (a, b) -> a + b),
                           'draw', aggregate(q, 0L, (a, b) -> a + b) div 2,
                           'out', cast(array() as array<bigint>)),
              (s, i) -> transform(array({draw}), d -> named_struct(
                'total', s.total - q[i], 'draw', s.draw - d, 'out', concat(s.out, array(d))))[0],
              s -> s.out))"""))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"),
                     F.expr("zip_with(q, left, (a, b) -> a - b)").alias("q")),
        )
        nodes = nodes.select("numbers", F.explode(halves).alias("h")).select("numbers", "h.node", "h.q")
    return nodes.select("node", F.explode(F.arrays_zip("numbers", "q")).alias("x")).select(
        F.col("node").alias("shard"), F.col("x.numbers").alias("source_no"), F.col("x.q").alias("quota")
    )


def mix(sizes: DataFrame, sources: DataFrame, seed: int, block_words: int = BLOCK_WORDS,
        levels: int = LEVELS) -> DataFrame:
    """One row per block and use: row, doc_id, source_no, block, words, use, shard, position_key.

    ``sizes`` and ``sources`` come from ``sized`` and ``targets``.
    """
    spark = sizes.sparkSession
    plan = sources.select(
        "source", "source_no", "blocks",
        F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long").alias("passes"),
        "target", "source_size",
    ).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    numbered = sizes.where("size > 0").join(
        plan.select(F.col("source").alias("s"), "source_no", "blocks"), F.col("source").eqNullSafe(F.col("s"))
    )
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block_words).cast("long") - 1))
    blocks = numbered.select("row", "doc_id", "source_no", "blocks", "size", "order", block.alias("block")).select(
        "row", "doc_id", "source_no", "block",
        F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words).alias("words"),
        F.xxhash64(F.lit(seed), "order", "block").alias("key"), "blocks",
    )
    bins = F.ceil(F.col("blocks") / BIN_BLOCKS)
    # The bin grows with the key, so bins and the keys inside give one order per source.
    bin_no = F.least(bins - 1, F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * bins)).cast("long")
    blocks = blocks.withColumn("bin", bin_no).drop("blocks")
    bin_sums = blocks.groupBy("source_no", "bin").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    along = Window.partitionBy("source_no").orderBy("bin")
    offsets = bin_sums.select(
        "source_no", "bin", (F.sum("n").over(along) - F.col("n")).alias("n_before"),
        (F.sum("w").over(along) - F.col("w")).alias("w_before"),
    )
    inner = Window.partitionBy("source_no", "bin").orderBy("key", "row", "block")
    path = scratch_path(spark, "ranked")
    blocks.withColumn("rank", F.row_number().over(inner) - 1).withColumn(
        "before", F.sum("words").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    ).join(offsets, ["source_no", "bin"]).select(
        "row", "doc_id", "source_no", "block", "words", (F.col("rank") + F.col("n_before")).alias("rank"),
        (F.col("before") + F.col("w_before")).alias("before"),
    ).write.parquet(path)
    ranked = spark.read.parquet(path).join(plan.select("source_no", "blocks", "passes", "rest"), "source_no")
    uses = F.col("passes") + F.when(F.col("before") + F.col("words") / 2 <= F.col("rest"), 1).otherwise(0)
    ranked = ranked.withColumn("uses", uses).where("uses > 0")
    quotas = ranked.groupBy("source_no").agg(F.sum("uses").alias("quota"))
    shares = split(quotas, seed, levels)
    bounds = shares.groupBy("source_no").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("shares"))
    ends = bounds.select("source_no", F.expr("""
        aggregate(shares, named_struct('sum', 0L, 'out', cast(array() as array<bigint>)),
          (a, x) -> named_struct('sum', a.sum + x.quota, 'out', concat(a.out, array(a.sum + x.quota))), a -> a.out)
        """).alias("ends"))
    used = ranked.join(ends, "source_no").select(
        "row", "doc_id", "source_no", "block", "words", "ends", "blocks", "rank",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)).alias("use"),
    )
    place = F.col("use") * F.col("blocks") + F.col("rank")
    used = used.withColumn("place", place)
    shard = F.expr("cast(size(filter(ends, e -> e <= place)) as bigint)")
    return used.select(
        "row", "doc_id", "source_no", "block", "words", "use", shard.alias("shard"),
        F.xxhash64(F.lit(seed), "source_no", "place").alias("position_key"),
    )


def laid_out(mixed: DataFrame) -> DataFrame:
    """The mix in output order: a shard's rows together, shuffled among themselves."""
    return mixed.repartition("shard").sortWithinPartitions("shard", "position_key")


def _planned(documents: DataFrame, seed: int, weights: tuple[float, ...], total: float, most: float, block_words: int,
             levels: int, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = sized(documents, seed, carried)
    spark = sizes.sparkSession
    path = scratch_path(spark, "sources")
    targets(sizes, weights, total, most, block_words).coalesce(1).write.parquet(path)
    sources = spark.read.parquet(path)
    narrow = sizes.select("row", "doc_id", "source", "size", "order")
    return sizes, sources, mix(narrow, sources, seed, block_words, levels)


def taken(documents: DataFrame, seed: int = 11, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5,
          most: float = 2.0, block_words: int = BLOCK_WORDS, levels: int = LEVELS) -> DataFrame:
    """One row per document: words the mix takes of it, beside its source's size and target."""
    sizes, sources, mixed = _planned(documents, seed, weights, total, most, block_words, levels)
    per_row = mixed.groupBy("row").agg(F.sum("words").alias("taken"), F.collect_set("shard").alias("shards"))
    named = sources.select(F.col("source").alias("s"), "source_size", "target")
    return (
        sizes.join(named, F.col("source").eqNullSafe(F.col("s"))).join(per_row, "row", "left")
        .select("row", "doc_id", "source", "size", "source_size", "target",
                F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
                F.coalesce(F.array_sort("shards"), F.array().cast("array<bigint>")).alias("shards"))
    )


def mixed_texts(documents: DataFrame, seed: int = 11, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5,
                most: float = 2.0, block_words: int = BLOCK_WORDS, levels: int = LEVELS) -> DataFrame:
    """The mix as documents, in the columns of the input: one row per document and use.

    A use that takes all blocks has the text as it is; else the text holds the
    words of the blocks taken, in order. Rows are shuffled among themselves.
    """
    columns = documents.columns
    sizes, _, mixed = _planned(documents, seed, weights, total, most, block_words, levels, tuple(columns))
    uses = mixed.groupBy("row", "use").agg(
        F.sort_array(F.collect_set("block")).alias("blocks"), F.sum("words").alias("words"),
        F.min("shard").alias("shard"), F.min("position_key").alias("position_key"))
    joined = sizes.join(uses, "row")
    cut = F.expr(f"""array_join(flatten(transform(array(regexp_extract_all(given_text, '{WORD_SQL}', 0)),
      w -> flatten(transform(blocks, b -> slice(w, int(b * {block_words} + 1), {block_words}))))), ' ')""")
    text = F.when(F.col("words") == F.col("size"), F.col("given_text")).otherwise(cut)
    return joined.sortWithinPartitions("shard", "position_key").select(
        *(text.alias(c) if c == "text" else F.col(f"given_{c}").alias(c) for c in columns))
