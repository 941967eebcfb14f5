"""Mixing sources to target weights, in DataFrame operations only.

Each source's words, its documents one after another, are packed into blocks of a fixed
number of words.  The mix is a sequence of output shards of a fixed number of slots, a
slot takes one block:

1. ``targets``: the words each source should give.
2. ``draws``: how many slots of each shard a source gets.  The count is a multinomial draw
   with its whole part fixed: a source gets the integer part of its expected slots, and the
   shard's remaining slots are drawn one by one in proportion to the fractions left.
3. ``slots``: the draws numbered through per source.  The j-th slot of a source takes block
   p(j mod n), p a pseudorandom permutation of the source's n blocks, so every block is
   taken once before any is taken twice.  Slots past two rounds stay void.
4. ``mixed_spans``: blocks joined by index give the document spans of every slot.

Nothing here sorts or holds a whole source in one task: running sums go by hash buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.shared import materialised

#: A word; words of a block; slots of an output shard; buckets that a source's running sums go by.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLOCK, SHARD, BUCKETS = 64, 4096, 1024
#: Weights in turn, share of all words the mix has, and how often a source may be used.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2
SEED = 20240607
#: Multipliers of the permutations.
PRIMES = (1048583, 1299709, 1600033, 1750009, 1900009, 2000003)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null; blanks at the ends make no word."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{GAP}|{GAP}$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, GAP))).cast("bigint")


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *key), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def sizes_by_source(sized: DataFrame) -> DataFrame:
    """source, rank by code point (null last) and source_size: a row a source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target of every source.

    Targets are in proportion to the weights, and none is above ``most`` times its source's
    words.  A source is at its bound when its words per weight are among the smallest; with
    sources in that order, the level every other one shares is what the bounded ones leave,
    divided by the weights that remain, and the first source whose bound exceeds its part
    of the level ends the bounded ones.  Sources without words get none.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = sizes_by_source(sized).withColumn("weight", F.when(F.col("source_size") > 0, weight).otherwise(0.0))
    order = Window.orderBy(F.when(F.col("weight") > 0, F.col("source_size") / F.col("weight")), "rank")
    whole = Window.partitionBy()
    rows = (
        rows.withColumn("bound", F.lit(float(most)) * F.col("source_size"))
        .withColumn("before", F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all", F.lit(share) * F.sum("source_size").over(whole))
        .withColumn("level", F.when(F.col("weight") > 0, (F.col("all") - F.col("before")) / F.col("left")))
        .withColumn("free", (F.col("weight") > 0) & (F.col("bound") > F.col("level") * F.col("weight")))
        .withColumn("common", F.min_by("level", F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), "rank"))).over(whole))
        .withColumn("common", F.when(F.max("free").over(whole), F.col("common")))
    )
    target = F.when(F.col("common").isNull(), F.col("bound")).otherwise(F.least("bound", F.col("weight") * F.col("common")))
    return rows.select("source", "source_size", "rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def placed(sized: DataFrame) -> DataFrame:
    """The documents with ``start``: the words of their source before them.

    The order within a source is by hash bucket, then doc_id, size and the text's hash, so
    a source with a third of all rows is spread over BUCKETS windows.
    """
    rows = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("source").alias("base_source"), F.col("bucket").alias("base_bucket"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(bases, F.col("source").eqNullSafe(F.col("base_source")) & (F.col("bucket") == F.col("base_bucket")))
        .withColumn("start", F.col("base") + F.col("inside"))
        .drop("bucket", "base", "base_source", "base_bucket", "inside")
    )


def draws(plan: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """shard, rank, blocks and count: the slots each source gets of each output shard.

    ``plan`` has a row a source: rank, source_size, target.  A row per shard is made only
    for sources that expect a whole slot of it, and one row for each drawn slot.
    """
    whole = Window.partitionBy()
    per_source = (
        plan.filter("target > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("bigint"))
        .withColumn("slots", F.col("target") * F.col("blocks") / F.col("source_size"))
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(whole) / F.lit(shard))).cast("bigint"))
        .withColumn("expected", F.col("slots") / F.col("shards"))
        .withColumn("fixed", F.floor("expected").cast("bigint"))
        .withColumn("fraction", F.col("expected") - F.col("fixed"))
        .withColumn("drawn", F.round(F.sum("fraction").over(whole)).cast("bigint"))
        .withColumn("upper", F.sum("fraction").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("fraction").over(whole))
    )
    fixed = per_source.filter("fixed > 0").select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"), "rank", "blocks", F.col("fixed").alias("count")
    )
    # The drawn slots' uniform numbers against the running fractions: an as-of match, the
    # first source whose upper bound lies above the number, in cells of equal width.
    cells = F.lit(1024)
    steps = per_source.filter("fraction > 0").withColumn("lower", F.coalesce(F.lag("upper").over(Window.orderBy("rank")), F.lit(0.0)))
    marks = steps.select(
        F.explode(F.sequence(F.floor(F.col("lower") * cells), F.least(F.floor(F.col("upper") * cells), cells - 1))).alias("cell"),
        F.col("lower").alias("at"), F.lit(0).alias("kind"), "rank", "blocks", F.lit(None).cast("bigint").alias("shard"),
    )
    one = per_source.groupBy().agg(F.max("shards").alias("shards"), F.max("drawn").alias("drawn")).filter("drawn > 0")
    numbers = (
        one.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"), "drawn")
        .select("shard", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("drawn"))).alias("k"))
        .withColumn("at", uniform(F.lit("draw"), F.col("shard"), F.col("k")))
        .select(
            F.floor(F.col("at") * cells).alias("cell"), "at", F.lit(1).alias("kind"),
            F.lit(None).cast("int").alias("rank"), F.lit(None).cast("bigint").alias("blocks"), "shard",
        )
    )
    upto = Window.partitionBy("cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = (
        marks.unionByName(numbers)
        .withColumn("found", F.last(F.when(F.col("kind") == 0, F.struct("rank", "blocks")), True).over(upto))
        .filter("kind = 1")
        .groupBy("shard", F.col("found.rank").alias("rank"), F.col("found.blocks").alias("blocks"))
        .agg(F.count("*").alias("count"))
    )
    return fixed.unionByName(matched).groupBy("shard", "rank", "blocks").agg(F.sum("count").alias("count"))


def slots(drawn: DataFrame, most: int = MOST) -> DataFrame:
    """shard, slot, rank, round and block of every slot that takes one."""
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        drawn.withColumn("first", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .withColumn("place", F.coalesce(F.sum("count").over(within), F.lit(0)))
        # Primes that do not divide the number of blocks: at least three of six, as any four exceed 64 bits.
        .withColumn("multipliers", F.filter(F.array(*[F.lit(p).cast("bigint") for p in PRIMES]), lambda p: F.col("blocks") % p != 0))
        .select("shard", "rank", "blocks", "multipliers", "first", "place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)).alias("k"))
        .withColumn("slot", F.col("place") + F.col("k"))
        .withColumn("j", F.col("first") + F.col("k"))
        .filter(F.col("j") < F.lit(most) * F.col("blocks"))
        .withColumn("round", F.floor(F.col("j") / F.col("blocks")).cast("int"))
    )
    # Each turn is a bijection of the block numbers: a multiplication and a shift, then a
    # swap-or-not step, which pairs x with a keyed reflection of it and moves both or neither.
    n = F.col("blocks")

    def turned(x: Column, turn: Column) -> Column:
        key = F.xxhash64(F.lit(SEED), turn, "rank", "round")
        x = F.pmod(x * F.element_at("multipliers", turn) + F.pmod(key, n), n)
        mirror = F.pmod(F.pmod(F.xxhash64(key), n) - x, n)
        return F.when(F.xxhash64(key, F.greatest(x, mirror)) % 2 == 0, mirror).otherwise(x)

    numbered = numbered.withColumn("block", F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), F.col("j") % n, turned))
    return numbered.select("shard", "slot", "rank", "round", "block")


def sized_documents(documents: DataFrame) -> DataFrame:
    """doc_id, source, size and text_hash, written down once: every step reads these, none the texts."""
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )
    return materialised(rows, "sized-documents")


def _pieces(located: DataFrame, block: int) -> DataFrame:
    """A row for each block a document reaches into: which of its words are there."""
    begin = F.col("start")
    end = F.col("start") + F.col("size")
    first = F.floor(begin / F.lit(block))
    last = F.floor((end - 1) / F.lit(block))
    return (
        located.filter("size > 0")
        .withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn("from", F.greatest(begin, F.col("block") * block) - begin)
        .withColumn("words", F.least(end, (F.col("block") + 1) * block) - begin - F.col("from"))
    )


def mixed_spans(documents: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix: shard, slot, source, round, doc_id, text_hash, from and words.

    A slot of a shard takes ``words`` words of a document from its word ``from`` on; rows
    of one slot are the pieces of its block.  The same input gives the same mix.
    """
    sized = sized_documents(documents)
    plan = targets(sized)
    located = placed(sized).join(plan.select(F.col("source").alias("plan_source"), "rank"), F.col("source").eqNullSafe(F.col("plan_source")))
    taken = slots(draws(plan, block, shard)).hint("merge")
    return _pieces(located, block).join(taken, ["rank", "block"]).select("shard", "slot", "source", "round", "doc_id", "text_hash", "from", "words")


def taken_words(documents: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """doc_id, size, source_size, target and taken: a row a document.

    Slots are first counted by block, so a document's words meet one row for each of its
    blocks.  Null text has size 0 and is never taken; a null source is a source, the last;
    null doc_ids and repeated rows are documents of their own; an empty table gives no
    rows; other columns are not read.  No document is taken more than twice its size.
    """
    sized = sized_documents(documents)
    plan = targets(sized)
    source = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "rank")
    located = placed(sized).join(source, F.col("source").eqNullSafe(F.col("plan_source")))
    # Merged, not broadcast: slots are made after the last exchange whose size is known.
    times = slots(draws(plan, block, shard)).groupBy("rank", "block").agg(F.count("*").alias("times")).hint("merge")
    pieces = _pieces(located, block).join(times, ["rank", "block"], "left")
    with_words = pieces.groupBy("rank", "start", "doc_id", "size", "source_size", "target").agg(
        F.sum(F.coalesce(F.col("times"), F.lit(0)) * F.col("words")).alias("taken")
    )
    names = ["doc_id", "size", "source_size", "target", "taken"]
    return with_words.select(*names).unionByName(located.filter("size = 0").withColumn("taken", F.lit(0).cast("bigint")).select(*names))


def mix(documents: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The documents as the mix takes them: a row a document and round, with the columns of ``documents``.

    A round that takes all of a document has its whole text; one that takes some of its
    blocks has those words, joined by blanks.  Other columns are as they were, but for
    n_chars, which is the new text's length.
    """
    names = documents.columns
    spans = mixed_spans(documents, block, shard).groupBy("source", "doc_id", "text_hash", "round").agg(
        F.sort_array(F.collect_set(F.struct("from", "words"))).alias("spans"), F.sum("words").alias("words")
    )
    # Rows alike in source, doc_id and text are one another's copies: they share the spans drawn for any of them.
    own = spans.select(*[F.col(c).alias(f"__{c}") for c in ("source", "doc_id", "text_hash", "spans", "words")])
    matched = documents.join(
        own,
        F.col("source").cast("string").eqNullSafe(F.col("__source")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__doc_id")) & (F.xxhash64("text") == F.col("__text_hash")),
    )
    words = F.split(F.regexp_replace("text", rf"^{GAP}", ""), GAP)

    def taken(own: Column) -> Column:
        return F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(own, (s["from"] + 1).cast("int"), s["words"].cast("int")))), " ")

    # The words are an element that the outer transform binds, so a text is split once, not once a span.
    part = F.element_at(F.transform(F.array(words), taken), 1)
    text = F.when(F.col("__words") >= word_count(F.col("text")), F.col("text")).otherwise(part)
    rows = matched.withColumn("__text", text)
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("bigint")}
    return rows.select(*[new.get(n, F.col(f"`{n}`")).alias(n) for n in names])
