"""Mixing sources to target weights by hash-threshold histograms, in DataFrame expressions only.

Every document has a hash of its id. A source's budget is met by whole copies of the source plus the documents whose
hash is below a threshold. The threshold is found without sorting: words are summed by source and hash bucket, the
bucket in which the running sum crosses the budget is refined alone, and so on down to single hash values.

Defined results: null text has size 0; null source is a source of its own and comes last; rows with equal hash (repeated
ids) are taken or left together; a source of size 0 has target 0; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Bits of a hash, and bits of a bucket: 3 nested histograms of 4096 buckets each.
HASH_BITS, LEVEL_BITS = 36, 12
#: Above so many sources, the thresholds are joined by a salted shuffle and not broadcast.
BROADCAST_SOURCES = 20_000
SALTS = 32


def order_hash(doc_id: Column) -> Column:
    """36 bits of the md5 of the id: the same in every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """``sizes``: one row a source (source, source_size). Adds target, copies and budget.

    The sources share ``share[0]/share[1]`` of all words by their weights (dealt in code point order, null last); none
    gets more than ``most`` times its size. Sources fill up in the order of size to weight, so with running sums in
    that order the first source that doesn't fill fixes the level of all that follow. Integers until the last division.
    """
    up, down = share
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (rank % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")), F.asc_nulls_last("source"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    x = sizes.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    x = x.withColumn("full", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))).withColumn("left", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the level is num / den words a unit of weight, if this source and those after it are open
    x = x.withColumn("num", F.col("total") * up - F.col("full") * down).withColumn("den", F.col("left") * down)
    is_open = F.col("num") * F.col("weight") < F.col("source_size") * most * F.col("den")
    x = x.withColumn("level", F.max(F.when(is_open, F.struct("left", "num", "den"))).over(everything))
    x = x.withColumn("filled", F.col("level").isNull() | (F.col("left") > F.col("level.left")))
    x = x.withColumn("whole", F.expr("(level.num * weight) div level.den")).withColumn("times", F.expr("coalesce(whole div nullif(source_size, 0), 0)"))
    return x.select(
        "source", "source_size",
        F.when(F.col("filled"), (F.col("source_size") * most).cast("double")).otherwise((F.col("level.num") * F.col("weight")).cast("double") / F.col("level.den").cast("double")).alias("target"),
        F.when(F.col("filled"), F.lit(most).cast("bigint")).otherwise(F.col("times")).alias("copies"),
        F.when(F.col("filled"), F.lit(0).cast("bigint")).otherwise(F.col("whole") - F.col("times") * F.col("source_size")).alias("budget"),
    )


def _with_source(rows: DataFrame, table: DataFrame, n_sources: int) -> DataFrame:
    """Joins a table of one row per source to rows; no task gets all rows of a source."""
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), "key")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def source_key() -> Column:
    """The source as a key that is never null."""
    return F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))


def sized(docs: DataFrame) -> DataFrame:
    """Ids, sources, sizes and hashes: written once, so the passes after that read only these few numbers."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", source_key().alias("key"), size.alias("size"), order_hash(F.col("doc_id")).alias("h"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``docs``: doc_id, source, text. Returns doc_id, source, size, source_size, target,
    times_taken (copies of the document in the mix) and taken (words)."""
    with Scratch(docs.sparkSession) as own:
        slim = own.keep(sized(docs), "mixing-sizes")
        plan, n_sources = mixing_plan(slim, weights, share, most, own)
    times = F.col("copies") + (F.col("h") < F.col("threshold")).cast("bigint")
    return _with_source(slim, plan, n_sources).select("doc_id", "source", "size", "source_size", "target", times.alias("times_taken"), (F.col("size") * times).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as many times as it is taken, with its own columns. Texts aren't shuffled
    unless there are more than BROADCAST_SOURCES sources."""
    with Scratch(docs.sparkSession) as own:
        plan, n_sources = mixing_plan(own.table(sized(docs), "mixing-sizes"), weights, share, most, own)
    rows = docs.select(F.struct(*docs.columns).alias("row"), source_key().alias("key"), order_hash(F.col("doc_id")).alias("h"))
    times = F.col("copies") + (F.col("h") < F.col("threshold")).cast("bigint")
    taken = _with_source(rows, plan.select("key", "copies", "threshold"), n_sources).withColumn("times", times).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select("row.*")


def mixing_plan(slim: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int, own: Scratch) -> tuple[DataFrame, int]:
    """Of each source (key): source_size, target, copies, and the threshold below which a hash is taken once more."""
    key = source_key()
    shift = HASH_BITS - LEVEL_BITS
    histogram = own.table(_histogram(slim, shift), "mixing-histogram")
    sizes = histogram.groupBy("key").agg(F.sum("words").alias("source_size")).select(F.when(~F.col("key.missing"), F.col("key.name")).alias("source"), "source_size")
    targets = own.table(source_targets(sizes, weights, share, most).withColumn("key", key), "mixing-targets")
    n_sources = targets.count()

    state, settled = targets.select("key", "budget", F.lit(0).cast("bigint").alias("prefix")), []
    while True:
        step = _cross(histogram, state)
        none_crossed = F.coalesce(F.shiftleft(F.col("full") + 1, shift), F.shiftleft(F.col("prefix"), shift + LEVEL_BITS))
        if shift == 0:
            nearest = F.when(F.col("cross.words") <= 2 * F.col("cross.rest"), F.col("cross.bucket") + 1).otherwise(F.col("cross.bucket"))
            settled.append(step.select("key", F.coalesce(nearest, none_crossed).alias("threshold")))
            break
        step = own.table(step, "mixing-state")
        settled.append(step.where(F.col("cross").isNull()).select("key", none_crossed.alias("threshold")))
        state = step.where(F.col("cross").isNotNull()).select("key", F.col("cross.rest").alias("budget"), F.col("cross.bucket").alias("prefix"))
        boundary = _with_source(slim, state.select("key", "prefix"), n_sources).where(F.shiftright("h", shift) == F.col("prefix"))
        shift -= LEVEL_BITS
        histogram = own.table(_histogram(boundary, shift), "mixing-histogram")

    thresholds = settled[0].unionByName(settled[1]).unionByName(settled[2])
    return own.keep(targets.drop("source").join(thresholds, "key"), "mixing-plan"), n_sources


def _histogram(slim: DataFrame, shift: int) -> DataFrame:
    return slim.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))


def _cross(histogram: DataFrame, state: DataFrame) -> DataFrame:
    """For each source in ``state`` (key, budget, prefix): the last bucket that its budget covers and the one that it ends in.

    A window holds the buckets of one level of one source, 4096 at most.
    """
    running = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
    upto = histogram.withColumn("upto", running).withColumn("before", F.col("upto") - F.col("words")).join(state.select("key", "budget"), "key")
    crossing = F.when((F.col("before") < F.col("budget")) & (F.col("upto") > F.col("budget")), F.struct("bucket", (F.col("budget") - F.col("before")).alias("rest"), "words"))
    found = upto.groupBy("key").agg(F.max(F.when(F.col("upto") <= F.col("budget"), F.col("bucket"))).alias("full"), F.max(crossing).alias("cross"))
    return state.join(found, "key", "left")
