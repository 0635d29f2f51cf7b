"""Operator 9: mixing sources to target weights, with DataFrame functions only.

Method.

1. The tokens (here: words) of each source, its documents in pseudorandom order, are packed into blocks of ``block_words``.
2. Output shards hold ``shard_slots`` blocks each. ``draws`` gives the number of blocks that each shard takes from each source:
   multinomial counts conditioned on every source's total, which is drawing without replacement from an urn with all
   slots of the mix. Targets are therefore met to the word, and no block goes round more often than its source needs.
3. The draws of a source are numbered through its shards. Its k-th draw takes the block at place k of a pseudorandom
   permutation of its block indices, a new one for each pass over the source, and an own permutation gives its place
   in the shard (``slots``).
4. Blocks are joined by (source, index) with the pieces of documents that they hold (``mixed_blocks``); the words that the
   mix takes of a document are the sum over its pieces (``mix``).

Permutations are swap-or-not shuffles (Hoang, Morris and Rogaway 2012) keyed by ``xxhash64``: exact permutations of
[0, n) for any n, without sorting and without cycle walking.

Skew. No window or group spans the documents or shards of a source: the n documents (draws) of a source are dealt to
about sqrt(n) buckets; prefix sums run inside buckets and over bucket totals. A block occurs once in each pass, so its join
key is never hot. Only the targets and the list of sources, one row a source, are ranked in a single task.

Defined results. Null text or text without words: size 0, taken 0. Null source: a source of its own, last in order.
Repeated rows are separate documents. Texts of any length are counted and packed whole. Empty input: empty output. Extra
columns are ignored. Equal rows may swap their results, the rows returned stay the same as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.words import word_count
from knotwork.runtime import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
BLOCK_WORDS = 512
SHARD_SLOTS = 1024
ROUNDS = 24
#: Slots made by one row of a generator; bounds its array.
SLOT_CHUNK = 4096


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The place of ``index`` under a keyed pseudorandom permutation of [0, n)."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r, F.lit("round key")), n) - x, n)
        swap = F.pmod(F.xxhash64(*key, r, F.greatest(x, partner)), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index, step)).otherwise(index)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of each document, evaluated once."""
    return cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row a source: src (its rank by code point, null last), source, n_docs, source_size, target.

    Shares go by weight until a source reaches ``max_repeat`` times its size; what lies above is shared again by
    weight among the rest. With sources in order of cap over weight, the capped ones are a prefix, so running sums
    give the fixed point without iteration. The windows without partitions see one row a source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    per = per.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("src", F.lit(len(weights))) + 1).cast("double"))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("cap", cap)
    per = per.withColumn(
        "level",
        (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    level = F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(everything)
    return per.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("src", "source", "n_docs", "source_size", "target")


def planned(per_source: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row for each source with slots: its full and all blocks, words of its last pass, slots, and all slots of the mix.

    A source's slots hold floor(target) words exactly: whole passes over its blocks, then part of one more, whose
    last slot takes only the leading words of its block.
    """
    size, want = F.col("source_size"), F.floor("target")
    s = per_source.where(want > 0).withColumn("n_full", F.floor(size / block_words)).withColumn("n_blocks", F.ceil(size / block_words))
    s = s.withColumn("rem", want % size).withColumn("n_slots", F.floor(want / size) * F.col("n_blocks") + F.ceil(F.col("rem") / block_words))
    s = s.withColumn("first", F.sum("n_slots").over(Window.orderBy("src")) - F.col("n_slots"))
    s = s.withColumn("all_slots", F.sum("n_slots").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.withColumn("groups", F.ceil(F.sqrt(F.col("all_slots") / shard_slots)))


def draws(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 42) -> DataFrame:
    """(shard, src, n): how many blocks each shard takes from each source, with ``groups`` of the plan.

    The urn holds each slot of the plan once; a pseudorandom permutation deals its slots to the shards.
    """
    chunks = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(SLOT_CHUNK).cast("long"))).alias("lo"))
    # a fixed number, since few rows that become many would be put together again at run time
    chunks = chunks.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "lo")
    drawn = chunks.select("*", F.explode(F.sequence("lo", F.least(F.col("lo") + SLOT_CHUNK, "n_slots") - 1)).alias("k"))
    at = permuted(F.col("first") + F.col("k"), F.col("all_slots"), F.lit(seed), F.lit("shards"))
    drawn = drawn.select("src", "groups", F.floor(at / shard_slots).alias("shard"))
    return drawn.groupBy("shard", "src").agg(F.count("*").alias("n"), F.first("groups").alias("groups"))


def slots(per_source: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 42) -> DataFrame:
    """One row a slot of the mix: shard, place (in the shard), src, block (index in the source), words (its leading ones)."""
    plan = cut(planned(per_source, block_words, shard_slots))
    drawn = cut(draws(plan, shard_slots, seed)).withColumn("group", F.floor(F.col("shard") / F.col("groups")))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    totals = drawn.groupBy("src", "group").agg(F.sum("n").alias("base"))
    totals = totals.withColumn("base", F.sum("base").over(up_to(Window.partitionBy("src").orderBy("group"))) - F.col("base"))
    inner = F.sum("n").over(up_to(Window.partitionBy("src", "group").orderBy("shard"))) - F.col("n")
    drawn = drawn.withColumn("inner", inner).join(totals, ["src", "group"]).join(plan.drop("groups"), "src")
    # a fixed number again, for the same reason
    drawn, shard = drawn.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard"), Window.partitionBy("shard")
    drawn = drawn.withColumn("lead", F.sum("n").over(up_to(shard.orderBy("src"))) - F.col("n")).withColumn("shard_size", F.sum("n").over(shard))
    # the draws of a shard and source are shard_slots at most
    x = drawn.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j")).withColumn("k", F.col("base") + F.col("inner") + F.col("j"))
    x = x.withColumn("pass", F.floor(F.col("k") / F.col("n_blocks"))).withColumn("i", F.col("k") % F.col("n_blocks"))
    full, size = F.col("i") < F.col("n_full"), F.col("source_size")
    block = F.when(full, permuted(F.col("i"), F.col("n_full"), F.lit(seed), F.col("src"), F.col("pass"))).otherwise(F.col("i"))
    length = F.when(full, F.lit(block_words).cast("long")).otherwise(size - F.col("n_full") * block_words)
    last = (F.col("k") == F.col("n_slots") - 1) & (F.col("rem") % block_words > 0)
    return x.select(
        "shard",
        permuted(F.col("lead") + F.col("j"), F.col("shard_size"), F.lit(seed), F.col("shard"), F.lit("places")).alias("place"),
        "src",
        block.cast("long").alias("block"),
        F.when(last, F.least(F.col("rem") % block_words, length)).otherwise(length).alias("words"),
    )


def _located(sizes: DataFrame, per_source: DataFrame, seed: int) -> DataFrame:
    """Each document with the offset of its first word in its source, in pseudorandom order."""
    x = sizes.alias("d").join(per_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    x = x.select("d.doc_id", "d.size", "s.src", "s.source_size", "s.target", "s.n_docs", F.xxhash64(F.lit(seed), "d.doc_id", "d.size").alias("h"))
    x = x.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit("bucket")), F.ceil(F.sqrt("n_docs"))))
    inside = Window.partitionBy("src", "bucket").orderBy("h", "doc_id")
    x = x.withColumn("nth", F.row_number().over(inside)).withColumn("inner", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = x.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    totals = totals.withColumn("base", F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    return x.join(totals.select("src", "bucket", "base"), ["src", "bucket"]).withColumn("start", F.col("base") + F.col("inner"))


def pieces(sizes: DataFrame, per_source: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 42) -> DataFrame:
    """Documents by the blocks they are packed into: block, and [lo, hi) of the block's words; null where a document has no words."""
    L = F.lit(block_words).cast("long")
    blocks = F.sequence(F.floor(F.col("start") / L), F.floor((F.col("start") + F.col("size") - 1) / L))
    x = _located(sizes, per_source, seed).withColumn("block", F.explode_outer(F.when(F.col("size") > 0, blocks)))
    lo = F.greatest(F.col("start") - F.col("block") * L, F.lit(0).cast("long"))
    return x.withColumn("lo", lo).withColumn("hi", F.least(F.col("start") + F.col("size") - F.col("block") * L, L))


def _joined(docs: DataFrame, block_words: int, shard_slots: int, seed: int, how: str, **shares) -> DataFrame:
    """Pieces of documents joined by block with the slots that take them; ``got`` is the number of words taken."""
    sizes = measured(docs)
    per = cut(targets(sizes, **shares))
    got = F.when(F.col("words").isNotNull(), F.greatest(F.least("hi", "words") - F.col("lo"), F.lit(0).cast("long")))
    # a merge join by name: after explode, estimates take the slots for a few rows and would broadcast them
    return pieces(sizes, per, block_words, seed).join(slots(per, block_words, shard_slots, seed).hint("merge"), ["src", "block"], how).withColumn("got", got)


def mixed_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 42, **shares) -> DataFrame:
    """The mix by output shard: shard, place, at (in the block), source rank src, block, doc_id, from_word and n_words of the document."""
    x = _joined(docs, block_words, shard_slots, seed, "inner", **shares).where("got > 0")
    from_word = F.col("block") * block_words + F.col("lo") - F.col("start")
    return x.select("shard", "place", F.col("lo").alias("at"), "src", "block", "doc_id", from_word.alias("from_word"), F.col("got").alias("n_words"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 42, **shares) -> DataFrame:
    """One row a document: doc_id, size, source_size, target (of its source), taken (its words in the mix)."""
    keys = ["src", "bucket", "nth", "doc_id", "size", "source_size", "target"]
    x = _joined(docs, block_words, shard_slots, seed, "left", **shares).groupBy(*keys).agg(F.coalesce(F.sum("got"), F.lit(0)).cast("long").alias("taken"))
    return x.select("doc_id", "size", "source_size", "target", "taken")


def expected_copies(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, copies): how often the mix repeats each document as a whole, 0 up to the largest repeat.

    The fraction of the document's words taken is rounded up or down by a draw from its id, so that the expected
    number of words stays. Rows that share a doc_id get the mean of their shares.
    """
    x = mix(docs, **options).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    u = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1_000_000)) / 1e6
    return x.select("doc_id", F.when(F.col("s") > 0, F.floor(F.col("t") / F.col("s") + u)).otherwise(0).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row of ``docs`` repeated as its copies say (0: it goes), columns unchanged."""
    n = expected_copies(docs, **options).where("copies > 0").withColumnsRenamed({"doc_id": "__id", "copies": "__n"})
    x = docs.join(n, docs["doc_id"].eqNullSafe(n["__id"]))
    return reduce(lambda d, c: d.drop(c), ("__id", "__n", "__i"), x.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))))
