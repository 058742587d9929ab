"""Mixing sources to target weights, with DataFrame operations only.

1. Every document's words join its source's stream, which is cut into blocks of fixed
   length. A source is packed in buckets of some thousand documents by hash of the id, so
   no task sorts a whole source; buckets are numbered one after the other.
2. The output is shards of slots, a slot taking one block. A shard's slots per source are
   a multinomial draw with the targets as probabilities: the whole part of each expected
   count is taken outright and only the rest is drawn (residual draw), which has the same
   mean and a spread of a slot or so per shard.
3. A source's slots are numbered; slot j is in pass ``j div n`` over the source's n blocks
   and takes block ``perm(j mod n)``, where ``perm`` is a pseudorandom permutation of the
   indices that depends on seed, source and pass. It is a swap-or-not shuffle: a few
   rounds of arithmetic and hashing for any n, no table and no sort.
4. Slots and blocks join by (source, index).

Targets: sources in order of code points, null last, weigh 1, 2, 3 and so on in turn and
share the corpus's words; a target stops at ``cap`` times its source's words and the rest
is shared again by weight, which has a closed form over the sources in order of
``cap * words / weight``. Slots past the ``cap``-th pass stay empty, so no document is
taken more than ``cap`` times.

Everything follows from the rows and the seed, so reruns agree. Rows: one per document;
null and empty texts have size 0 and nothing taken; whole texts count; equal rows are
packed one after the other; rows without an id are packed together in one place; other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import stage_table

BLOCK = 32  # words in a block
SLOTS = 65_536  # slots in an output shard, about
CAP = 3
DOCS_PER_BUCKET = 4_000
ROUNDS = 12
SEED = 97
WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Mix:
    """The parts of a mix. ``sources``: one row per source; ``packed``: documents with their place in
    the source's stream; ``slots``: (sid, shard, slot, block)."""

    sources: DataFrame
    packed: DataFrame
    slots: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """Documents cut at block edges: (sid, block) with the first word in the document and the words."""
        b = self.block
        end = F.col("offset") + F.col("size")
        cut = self.packed.where("size > 0").withColumn(
            "local", F.explode(F.sequence(F.floor(F.col("offset") / b), F.floor((end - 1) / b)))
        )
        start = F.greatest("offset", F.col("local") * b)
        return cut.select(
            "sid", (F.col("first_block") + F.col("local")).alias("block"), "doc_id", "size", "bucket", "offset",
            (start - F.col("offset")).alias("word"), (F.least(end, (F.col("local") + 1) * b) - start).alias("words"),
        )

    def contents(self) -> DataFrame:
        """The mixed corpus by reference: per shard and slot, the word ranges of the documents that fill it."""
        return self.slots.join(self.pieces(), ["sid", "block"]).select("shard", "slot", "sid", "block", "doc_id", "word", "words")

    def taken(self) -> DataFrame:
        """Per document: size, its source's size and target, and the words that the mix takes."""
        uses = self.slots.groupBy("sid", "block").agg(F.count("*").alias("uses"))
        taken = F.sum(F.coalesce("uses", F.lit(0)) * F.col("words"))
        whole = self.pieces().join(uses, ["sid", "block"], "left").groupBy("sid", "bucket", "offset", "doc_id", "size").agg(taken.alias("taken"))
        empty = self.packed.where("size = 0").select("sid", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
        rows = whole.select("sid", "doc_id", "size", "taken").unionByName(empty)
        return rows.join(self.sources.select("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", "taken")


def targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """``(source, source_size, docs, sid, weight, target)`` of the rows ``(source, size)``; one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # Windows over all sources: they see one row per source.
    everything = Window.partitionBy(F.lit(0))
    named = per.withColumn("sid", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("weight", (F.col("sid") % 3 + 1).cast("double")).withColumn("most", cap * F.col("source_size"))
    # Sources are full in order of most / weight. Were just those before this one full, the level would be:
    order = everything.orderBy((F.col("most") / F.col("weight")).asc(), "sid")
    full_before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = named.withColumn("level", (F.sum("source_size").over(everything) - full_before) / open_weight)
    # The first source whose room lies above its level sets the level of all.
    fits = F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct((F.col("most") / F.col("weight")).alias("r"), "sid", "level"))
    level = F.coalesce(F.min(fits).over(everything)["level"], F.lit(float("inf")))
    return levelled.withColumn("target", F.least("most", level * F.col("weight"))).select("source", "source_size", "docs", "sid", "weight", "target")


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0..n-1: a swap-or-not shuffle keyed by ``key``."""

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.xxhash64(*key, r) - x, n)
        return F.when(F.pmod(F.xxhash64(*key, -r, F.greatest(x, mirror)), F.lit(2)) == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def build_mix(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, cap: int = CAP, seed: int = SEED) -> Mix:
    """Plan the mix of ``docs`` (doc_id, source, text)."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = stage_table(docs.select("doc_id", "source", size.alias("size")), "mix-sizes")
    sources = stage_table(targets(sized, cap), "mix-sources")

    # Packing: sums per bucket, the buckets' first blocks, then places within a bucket.
    buckets = F.ceil(F.col("docs") / DOCS_PER_BUCKET)
    known = sources.select(F.col("source").alias("_s"), "sid", buckets.alias("buckets"))
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("_s"))).select(
        "sid", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("buckets")).alias("bucket"), "doc_id", "size"
    )
    sums = placed.groupBy("sid", "bucket").agg(F.ceil(F.sum("size") / block).alias("blocks"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("sid", "bucket", "blocks", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("first_block"))
    firsts = stage_table(firsts, "mix-buckets")
    ahead = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(ahead), F.lit(0))
    packed = stage_table(placed.withColumn("offset", offset).join(firsts.drop("blocks"), ["sid", "bucket"]), "mix-packed")

    # Slots: how many each source should fill, per shard the whole part and a share of the drawn rest.
    counts = sources.join(firsts.groupBy("sid").agg(F.sum("blocks").alias("n")), "sid").where("n > 0 and target > 0")
    counts = counts.select("sid", "n", (F.col("n") * F.col("target") / F.col("source_size")).alias("wanted"))
    total = counts.agg(F.sum("wanted")).first()[0] or 0.0
    shards = max(1, round(total / slots))
    per_shard = round(total / shards)
    all_sources = Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    expected = F.col("wanted") * (per_shard / total if total else 0.0)
    counts = counts.withColumn("whole", F.floor(expected)).withColumn("part", expected - F.col("whole")).withColumn("high", F.sum("part").over(all_sources))
    counts = stage_table(counts, "mix-counts")
    drawn = per_shard - (counts.agg(F.sum("whole")).first()[0] or 0)

    # A draw is a number in [0, drawn); sources hold intervals of it, met by their whole numbers.
    u = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("draw")), F.lit(1 << 52)) / float(1 << 52) * float(max(drawn, 0))
    draws = spark.range(shards * max(drawn, 0)).select(F.floor(F.col("id") / max(drawn, 1)).alias("shard"), u.alias("u")).withColumn("cell", F.floor("u"))
    low = F.col("high") - F.col("part")
    holds = counts.where("part > 0").select("sid", low.alias("low"), "high", F.explode(F.sequence(F.floor(low), F.floor("high"))).alias("cell"))
    rest = draws.join(holds, "cell").where("u >= low and u < high").select("sid", "shard", F.lit(1).cast("long").alias("k"))
    sure = counts.where("whole > 0").select("sid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("whole").alias("k"))
    per = sure.unionByName(rest).groupBy("sid", "shard").agg(F.sum("k").alias("k"))
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("start", F.coalesce(F.sum("k").over(earlier), F.lit(0)))
    # A row here is up to a shard of slots: spread them over all tasks before they are written out.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = per.join(counts.select("sid", "n"), "sid").repartition(parts, "sid", "shard")
    each = per.select("sid", "shard", "n", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("k") - 1)).alias("j"))
    lap = F.floor(F.col("j") / F.col("n"))
    each = each.where(lap < cap)
    block_of = permuted(F.col("j") % F.col("n"), F.col("n"), F.lit(seed), F.col("sid"), lap)
    return Mix(sources, packed, each.select("sid", "shard", F.col("j").alias("slot"), block_of.alias("block")), block)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``(doc_id, size, source_size, target, taken)``."""
    return build_mix(docs, **options).taken()
