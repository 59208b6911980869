"""Mixing sources to target weights, with DataFrame functions only.

Every source is one stream of words, its documents in a pseudorandom order, packed into blocks of `block_words`. A target
of words gives each source a number of draws. The counts of a source over the output shards are one multinomial draw of
that total, made by a hash of each draw; so shards differ as by chance, but every source comes to its target. The counts
of the shards before give the first slot of a source in a shard; slot k takes block p(k mod blocks), p being a
swap-or-not permutation of the source's block numbers with a key for each pass, and stands at a permuted place of its
shard. Blocks are joined to documents by their index. Nothing is sorted or gathered by source, no block is taken more
than once a pass, and no source has more than two passes, so no document gives more than twice its words.

Nulls: a null text has size 0; a null source is a source of its own, the last; null doc_ids are like any others. Rows of
size 0 take no words. Each row is a document of its own, repeated or not, and every row is in the result. A very long
text reaches into many blocks, one piece each. A table without words has targets of 0, an empty table gives no rows.
Columns of the input other than those named are left out by `taken` and kept by `mixed_documents`, whatever their names;
names that begin with `_mix_` are not to be used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, written

WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 32
SHARD_DRAWS = 65536
ROUNDS = 8
#: Words of a source's stream that are ordered together, so that no task orders a whole source.
PART_WORDS = 1 << 20
SEQUENCE = 4096


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(docs: DataFrame) -> DataFrame:
    """_mix_row, doc_id, source and size of each row, kept in a checkpoint so that the numbers stay."""
    return checkpointed(docs.select(F.monotonically_increasing_id().alias("_mix_row"), "doc_id", "source", words_in("text").alias("size")))


def targets(sized: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, source_ix, source_size, target, blocks, draws): weights poured out until each source is at its limit.

    A source at its limit lets the level of the others rise; ordered by limit over weight, the level is known in closed
    form. The windows run over one row per source.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = rows.withColumn("source_ix", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_ix") % len(WEIGHTS) + 1).cast("int")).cast("double")
    limit = (MOST * F.col("source_size")).cast("double")
    r = ranked.withColumn("weight", weight).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
    by = Window.orderBy("ratio", "source_ix")
    past, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum(SHARE * F.col("source_size")).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("limit").over(past), F.lit(0.0))) / F.sum("weight").over(rest)
    r = r.withColumn("level", level)
    final = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "source_ix", "level"))).over(Window.partitionBy())["level"]
    r = r.withColumn("target", F.least("limit", F.coalesce(final, F.lit(0.0)) * F.col("weight")))
    r = r.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    draws = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), MOST * F.col("blocks"))).otherwise(0)
    return r.select("source", "source_ix", "source_size", "target", "blocks", draws.cast("long").alias("draws"))


def pack(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source_ix and `start`, the place of the document's first word in its source's stream."""
    here = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_ix", "s.source_size", "s.target")
    parts = F.floor(F.col("source_size") / PART_WORDS).cast("long") + 1
    here = here.withColumn("part", F.pmod(F.xxhash64(F.lit("order"), "doc_id", "_mix_row"), parts))
    totals = here.groupBy("source_ix", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source_ix").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_ix", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("source_ix", "part").orderBy("doc_id", "_mix_row").rowsBetween(Window.unboundedPreceding, -1)
    inside = here.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inside.join(totals, ["source_ix", "part"]).withColumn("start", F.col("part_start") + F.col("inside")).drop("part", "part_start", "inside")


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..size-1: each round swaps a number with its mirror about a pivot, or doesn't."""
    def swap(i: Column, r: Column) -> Column:
        mirror = F.pmod(F.xxhash64(F.lit("pivot"), r, *key) - i, size)
        return F.when(F.xxhash64(r, *key, F.greatest(i, mirror)) % 2 == 0, i).otherwise(mirror)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that are about to be exploded, dealt by a key over as many tasks as shuffles have."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def counts(sources: DataFrame, seed: int = 0) -> DataFrame:
    """(source_ix, blocks, shard, n): how many slots of each shard a source has; a shard has about SHARD_DRAWS."""
    run = sources.withColumn("shards", F.ceil(F.sum("draws").over(Window.partitionBy()) / SHARD_DRAWS).cast("long")).where("draws > 0")
    run = run.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1, F.lit(SEQUENCE).cast("long"))))
    each = spread(run, "source_ix", "lo").withColumn("k", F.explode(F.sequence("lo", F.least(F.col("lo") + SEQUENCE, F.col("draws")) - 1)))
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.lit(seed), "source_ix", "k"), F.col("shards"))
    return each.groupBy("source_ix", "blocks", shard.alias("shard")).agg(F.count("*").alias("n"))


def draw(sources: DataFrame, seed: int = 0) -> DataFrame:
    """(source_ix, pass, block, shard, place): one row per slot of the output; places of a shard are 0, 1, 2, ..."""
    by_source = Window.partitionBy("source_ix").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by_shard = Window.partitionBy("shard").orderBy("source_ix").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    drawn = counts(sources, seed).withColumn("first", F.coalesce(F.sum("n").over(by_source), zero))
    drawn = drawn.withColumn("above", F.coalesce(F.sum("n").over(by_shard), zero)).withColumn("slots", F.sum("n").over(Window.partitionBy("shard")))
    slot = spread(drawn, "source_ix", "shard").withColumn("r", F.explode(F.sequence(zero, F.col("n") - 1)))
    slot = slot.withColumn("k", F.col("first") + F.col("r")).withColumn("seed", F.lit(seed)).withColumn("pass", F.floor(F.col("k") / F.col("blocks")).cast("long"))
    block = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("seed"), F.col("source_ix"), F.col("pass"))
    place = permuted(F.col("above") + F.col("r"), F.col("slots"), F.lit("place"), F.col("seed"), F.col("shard"))
    return slot.select("source_ix", "pass", block.alias("block"), "shard", place.alias("place"))


def pieces(packed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each block that a document reaches into: `lo` and `hi`, words of the document in that block."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    block = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words).cast("long"), last))
    cut = packed.withColumn("block", F.explode_outer(block))
    lo = F.greatest(F.lit(0).cast("long"), F.col("block") * block_words - F.col("start"))
    hi = F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start"))
    return cut.withColumn("lo", lo).withColumn("hi", hi)


def plan(sized: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Of numbered documents: their pieces in blocks, and the slots that take blocks."""
    sources = checkpointed(targets(sized, block_words))
    return pieces(pack(sized, sources), block_words), draw(sources, seed)


def mix(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(shard, place, source_ix, block, pass, doc_id, lo, hi): the mix, each slot as the words of documents in its block."""
    cut, drawn = plan(numbered(docs), seed, block_words)
    piece = cut.where("block IS NOT NULL").select("source_ix", "block", "doc_id", "lo", "hi")
    return drawn.join(piece.hint("merge"), ["source_ix", "block"]).select("shard", "place", "source_ix", "block", "pass", "doc_id", "lo", "hi")


def taken(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source_ix): one row for each row of docs."""
    cut, drawn = plan(numbered(docs), seed, block_words)
    uses = drawn.groupBy("source_ix", "block").agg(F.count("*").alias("uses"))
    each = cut.join(uses.hint("merge"), ["source_ix", "block"], "left")
    words = F.coalesce(F.sum((F.col("hi") - F.col("lo")) * F.col("uses")), F.lit(0)).cast("long")
    whole = each.groupBy("_mix_row", "doc_id", "size", "source_ix", "source_size", "target").agg(words.alias("taken"))
    return whole.select("doc_id", "size", "source_size", "target", "taken", "source_ix")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Documents as the mix takes them: for each pass a document gives the words of its blocks drawn in that pass.

    A document that a pass takes whole keeps its text as it was; one that no pass takes goes, but one without a word
    stays as it is. Columns stay; n_chars is counted anew where it exists. The numbered rows are written to the shared
    folder, so that words are cut from the rows that the plan was made of.
    """
    names = docs.columns
    rows = written(docs.withColumn("_mix_row", F.monotonically_increasing_id()))
    size = words_in("text")
    cut, drawn = plan(rows.select("_mix_row", "doc_id", "source", size.alias("size")), seed)
    spans = cut.where("block IS NOT NULL").join(drawn.select("source_ix", "block", "pass").hint("merge"), ["source_ix", "block"])
    runs = spans.groupBy("_mix_row", "pass", F.col("size").alias("_mix_size")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_mix_runs")).drop("pass")
    both = rows.join(runs.hint("merge"), "_mix_row", "left").where((size == 0) | F.col("_mix_runs").isNotNull())
    words = F.regexp_extract_all("text", F.lit(f"({GAP}{WORD}{GAP})"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("_mix_runs", lambda r: F.slice(F.col("_mix_words"), (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), "")
    whole = F.aggregate("_mix_runs", F.lit(0).cast("long"), lambda a, r: a + r["hi"] - r["lo"]) == F.col("_mix_size")
    same = F.col("_mix_runs").isNull() | whole
    out = both.withColumn("_mix_words", F.when(~same, words)).withColumn("text", F.when(same, F.col("text")).otherwise(part))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return out.select(*names)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
