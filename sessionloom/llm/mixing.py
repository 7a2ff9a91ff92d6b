"""Mixing sources to target weights, in DataFrame operations only.

Each source is one stream of words, packed into blocks of ``block_words`` (the last may be short). A mix is a list of output
shards, each of ``shard_slots`` slots (the last may have fewer); every slot takes one block.

Draw: each slot draws a source from a seeded hash by the targets' shares, so a shard's source counts are multinomial. The counts are then
corrected to meet the targets: the shards of a source take numbers one after the other, in a pseudorandom order of its own; those that number
beyond what the source owes give their slots to the sources that were drawn too seldom.
Index: number k of a source is epoch k div blocks and place k mod blocks; the block is where a pseudorandom permutation of the
epoch and source puts that place. Blocks are then joined by (source, index), and documents by the blocks that hold their words; no
text takes part in any of this.

Permutations are four Feistel rounds over a grid of rows x columns that is just larger than the domain,
walking on while the value falls outside. Running sums are made in two levels (about sqrt(rows) chunks), so a source that
holds a third of all rows is never one task. Sources are taken to be few, thousands at most: their targets are one window and one array.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Slots that one task makes.
TASK_SLOTS = 1 << 20
SEGMENTS = "shard long, source_rank int, first long, number long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_rank, source_size, target) from (source, source_size): weights repeat over the sources in code point order, null last.

    Targets share ``share`` times all sizes by weight; none exceeds ``most`` times its source, the excess is shared anew.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    whole = Window.partitionBy()
    ranked = sizes.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("source_rank") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    above = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(above), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(above), F.lit(0.0)))
    # sources in order of cap / weight: the first that its share does not fill sets the level for all after it
    levels = ranked.withColumn("level", level).withColumn("open", F.col("cap") / F.col("weight") >= F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "source_rank", "level"))).over(whole)["level"]
    return levels.withColumn("final", final).select("source", "source_rank", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("final"))).alias("target"))


def _round(left: Column, right: Column, rows: Column, columns: Column, key: Sequence[Column]) -> tuple[Column, Column]:
    for r in range(2):
        left = (left + F.pmod(F.xxhash64(right, F.lit(2 * r), *key), rows)) % rows
        right = (right + F.pmod(F.xxhash64(left, F.lit(2 * r + 1), *key), columns)) % columns
    return left, right


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 (longs), another for each key.

    Fewer than sqrt(n) + 1 grid cells lie outside, so for n up to 256 walking ends within 24 steps for certain; for larger n the chance of more steps is
    below 16 ** -24 a value, and then the job fails instead of losing a block.
    """
    rows = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    columns = F.greatest(F.ceil(n / rows), F.lit(1)).cast("long")

    def once(v: Column) -> Column:
        left, right = _round(v % rows, F.floor(v / rows), rows, columns, key)
        return (right * rows + left).cast("long")

    first = once(x)  # nearly always inside
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(24)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)), lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("no end of a permutation's walk")).cast("long")))
    return F.when(first < n, first).otherwise(walked)


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, chunk: Column, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over all rows of the group before each. Chunks must follow the order, or rows may come in any order."""
    chunked = df.withColumn("chunk", chunk)
    sums = chunked.groupBy(*group, "chunk").agg(F.sum(value).alias("chunk_sum"))
    bases = sums.withColumn("base", F.coalesce(F.sum("chunk_sum").over(Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bases = bases.select(*(F.col(c).alias(f"of_{c}") for c in (*group, "chunk")), "base")
    inside = Window.partitionBy(*group, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumn("local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.lit(True)
    for c in (*group, "chunk"):
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return local.join(bases, same).withColumn(name, F.col("base") + F.col("local")).drop("base", "local", "chunk", *(f"of_{c}" for c in (*group, "chunk")))


def owed(targets: DataFrame, block_words: int) -> DataFrame:
    """Per source with words: source_rank, source_size, blocks, last_words (of the last block), wanted words, and the slots that they fill."""
    size, b = F.col("source_size"), F.lit(block_words).cast("long")
    t = targets.filter("source_size > 0").withColumn("wanted", F.floor("target").cast("long"))
    t = t.withColumn("blocks", F.ceil(size / b).cast("long")).withColumn("last_words", size - (F.col("blocks") - 1) * b)
    slots = F.floor(F.col("wanted") / size) * F.col("blocks") + F.ceil(F.col("wanted") % size / b)
    return t.select(F.col("source_rank").cast("int").alias("source_rank"), "source_size", "blocks", "last_words", "wanted", slots.cast("long").alias("slots"))


def drawn_counts(debts: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """The multinomial draw: (shard, source_rank, drawn). debts: source_rank and slots, a row a source."""
    spark = debts.sparkSession
    total = debts.agg(F.sum("slots")).first()[0] or 0
    ranked = F.array_sort(F.collect_list(F.struct("source_rank", "slots")))
    sources = debts.filter("slots > 0").agg(ranked.alias("sources"))
    # how many of the slots come before the end of each source: the distribution function
    ends = F.transform("sources", lambda x, i: F.struct(x["source_rank"].alias("source_rank"), F.aggregate(F.slice("sources", 1, i + 1), F.lit(0).cast("long"), lambda acc, y: acc + y["slots"]).alias("end")))
    shards = spark.range(0, -(-total // shard_slots), 1, int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumnRenamed("id", "shard")
    slots = shards.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(shard_slots), F.lit(total) - F.col("shard") * shard_slots) - 1)))
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "shard", "slot"), F.lit(max(total, 1)))
    drawn = slots.crossJoin(F.broadcast(sources.select(ends.alias("ends")))).withColumn("u", u)
    # one row of bounds
    rank = F.element_at("ends", F.size(F.filter("ends", lambda x: x["end"] <= F.col("u"))) + 1)["source_rank"]
    return drawn.select("shard", rank.alias("source_rank")).groupBy("shard", "source_rank").agg(F.count(F.lit(1)).alias("drawn"))


def shard_segments(debts: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """SEGMENTS: which numbers of which source each shard takes (``number`` of them from ``first`` on): the drawn counts, corrected to the slots that each source owes."""
    counts = written(drawn_counts(debts, shard_slots, seed), "counts")
    shards = F.lit(counts.agg(F.max("shard")).first()[0] or 0).cast("long") + 1
    # a source's shards take their numbers in an order of its own, so that none is favoured
    turned = counts.withColumn("turn", permuted(F.col("shard"), shards, F.col("source_rank"), F.lit(seed), F.lit("turn")))
    begun = running(turned, ["source_rank"], ["turn"], "drawn", F.floor(F.col("turn") / F.ceil(F.sqrt(shards.cast("double")))), "first")
    totals = counts.groupBy("source_rank").agg(F.sum("drawn").alias("all_drawn")).withColumnRenamed("source_rank", "of_rank")
    each = debts.join(totals, F.col("source_rank") == F.col("of_rank"), "left").withColumn("all_drawn", F.coalesce("all_drawn", F.lit(0)))
    each = each.select("source_rank", "slots", "all_drawn", F.greatest(F.lit(0), F.col("all_drawn") - F.col("slots")).alias("over"), F.greatest(F.lit(0), F.col("slots") - F.col("all_drawn")).alias("under"))
    before = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"over_before": F.coalesce(F.sum("over").over(before), F.lit(0)), "under_before": F.coalesce(F.sum("under").over(before), F.lit(0))})
    each = written(each, "corrections")
    named = begun.join(F.broadcast(each.withColumnRenamed("source_rank", "of_rank")), F.col("source_rank") == F.col("of_rank"))  # a row a source
    own = named.withColumn("number", F.least("drawn", F.greatest(F.lit(0), F.col("slots") - F.col("first")))).filter("number > 0")
    given = named.withColumn("give", F.col("drawn") - F.least("drawn", F.greatest(F.lit(0), F.col("slots") - F.col("first")))).filter("give > 0")
    given = given.select("shard", (F.col("over_before") + F.greatest("first", "slots") - F.col("slots")).alias("a"), "give").withColumn("b", F.col("a") + F.col("give"))
    takers = each.filter("under > 0").agg(F.collect_list(F.struct("source_rank", F.col("all_drawn").alias("from"), F.col("under_before").alias("a"), (F.col("under_before") + F.col("under")).alias("b"))).alias("takers"))
    met = given.crossJoin(F.broadcast(takers)).select("shard", "a", "b", F.explode(F.filter("takers", lambda x: (x["a"] < F.col("b")) & (F.col("a") < x["b"]))).alias("x"))
    begin, end = F.greatest("a", "x.a"), F.least("b", "x.b")
    taken = met.select("shard", "x.source_rank", (F.col("x.from") + begin - F.col("x.a")).alias("first"), (end - begin).alias("number"))
    return own.select("shard", "source_rank", "first", "number").union(taken)


def mix_slots(targets: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """The mix: (shard, slot, source_rank, epoch, block, words), one row a slot; ``words`` is what it takes from the block's front."""
    b = F.lit(block_words).cast("long")
    debts = written(owed(targets, block_words), "debts")
    segments = written(shard_segments(debts, shard_slots, seed), "segments")
    # segments are few and small, but many slots come of each: they are dealt by how many, not by their bytes
    tasks = max(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), (debts.agg(F.sum("slots")).first()[0] or 0) // TASK_SLOTS)
    segments = segments.repartition(tasks, "shard")
    inside = Window.partitionBy("shard")
    placed = segments.withColumn("before", F.coalesce(F.sum("number").over(inside.orderBy("source_rank", "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("in_shard", F.sum("number").over(inside))
    s = placed.join(F.broadcast(debts.withColumnRenamed("source_rank", "of_rank").drop("slots")), F.col("source_rank") == F.col("of_rank"))  # a row a source
    s = s.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("number") - 1))).withColumn("k", F.col("first") + F.col("nth"))
    s = s.withColumn("slot", permuted(F.col("before") + F.col("nth"), F.col("in_shard"), F.col("shard"), F.lit(seed), F.lit("slot")))
    s = s.withColumn("epoch", F.floor(F.col("k") / F.col("blocks"))).withColumn("x", F.col("k") % F.col("blocks")).withColumn("rest", F.col("wanted") % F.col("source_size"))
    # the short block comes last in every epoch, so that a cut epoch holds exactly the words that it should
    s = s.withColumn("block", F.when(F.col("x") == F.col("blocks") - 1, F.col("x")).otherwise(permuted(F.col("x"), F.col("blocks") - 1, F.col("source_rank"), F.col("epoch"), F.lit(seed))))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("last_words")).otherwise(b)
    cut = (F.col("epoch") == F.floor(F.col("wanted") / F.col("source_size"))) & ((F.col("x") + 1) * b > F.col("rest"))
    s = s.withColumn("words", F.when(cut, F.least(length, F.col("rest") - F.col("x") * b)).otherwise(length))
    return s.select("shard", "slot", "source_rank", "epoch", "block", "words")


def placed_documents(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """The rows with source_rank, source_size, target and the place ``start`` of their first word in their source's stream; and the targets.

    sized: doc_id, source, size and key_a, key_b, hashes of the row, which together say where a row comes. The keys stay.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    totals = written(totals, "sources")
    rows = totals.agg(F.sum("source_rows")).first()[0] or 0
    chunks = max(1, int(rows**0.5))
    targets = written(source_targets(totals.select("source", "source_size"), weights, share, most), "targets")
    started = running(sized, ["source"], ["doc_id", "size", "key_a", "key_b"], "size", F.pmod("key_a", F.lit(chunks)), "start")
    named = targets.select(F.col("source").alias("in_source"), "source_rank", "source_size", "target")
    placed = started.join(named, F.col("source").eqNullSafe(F.col("in_source")))
    return placed.drop("in_source"), targets


def block_parts(placed: DataFrame, block_words: int) -> DataFrame:
    """Which words of which block each non-empty document is: (source_rank, start, block, block_from, part_words, doc_from)."""
    b = F.lit(block_words).cast("long")
    p = placed.filter("size > 0").select("source_rank", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"))
    begin, end = F.greatest("start", F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    return p.select("source_rank", "start", "block", (begin - F.col("block") * b).alias("block_from"), (end - begin).alias("part_words"), (begin - F.col("start")).alias("doc_from"))


def shard_parts(placed: DataFrame, targets: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """The mix by documents: (in_rank, in_start, shard, slot, epoch, doc_from, got), a row for each slot and document that gives words to it.

    (in_rank, in_start) is where the document lies among ``placed``; it gives ``got`` words from its word ``doc_from`` on.
    """
    slots = mix_slots(targets, block_words, shard_slots, seed)
    slots = slots.withColumnsRenamed({"source_rank": "slot_rank", "block": "slot_block"})
    # slots come of a table of a few sources, whose size says nothing about theirs: never broadcast
    hit = block_parts(placed, block_words).hint("shuffle_merge").join(slots.hint("shuffle_merge"), (F.col("source_rank") == F.col("slot_rank")) & (F.col("block") == F.col("slot_block")))
    got = F.greatest(F.lit(0), F.least("part_words", F.col("words") - F.col("block_from")))
    return hit.withColumn("got", got).filter("got > 0").select(F.col("source_rank").alias("in_rank"), F.col("start").alias("in_start"), "shard", "slot", "epoch", "doc_from", "got")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 64, shard_slots: int = 4096, seed: int = 17, with_text: bool = False) -> DataFrame:
    """Mix all rows to their sources' target weights: per row doc_id, source, size, source_size, target, taken, first_shard, last_shard.

    Takes doc_id, text, source; a null text has no words, a null source is a source of its own that comes last, an empty
    table gives no rows. Rows that repeat a doc_id, or repeat whole, are documents of their own. The shards are the least and the greatest that
    hold words of the row, null where ``taken`` is 0. With ``with_text``, the column ``taken_text`` has the words taken (epoch by epoch, in
    document order; the unchanged text where one epoch takes it whole) and all other columns of the input stay too.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "source")] if with_text else []
    base = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), *([F.struct(*extra).alias("others")] if extra else []))
    base = base.withColumns({f"key_{k}": F.xxhash64(F.lit(k), "doc_id", "text", F.coalesce("source", F.lit("")), F.col("source").isNull()) for k in "ab"})
    # texts are read once for their sizes, and nothing but sizes goes on
    sized = written(base.select("doc_id", "source", word_count(F.col("text")).alias("size"), "key_a", "key_b"), "sizes")
    placed, targets = placed_documents(sized, weights, share, most)
    placed = written(placed, "placed")
    parts = shard_parts(placed, targets, block_words, shard_slots, seed)
    pieces = [F.collect_list(F.struct("epoch", "doc_from", "got")).alias("pieces")] if with_text else []
    taken = parts.groupBy("in_rank", "in_start").agg(F.sum("got").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"), *pieces)
    joined = placed.join(taken.hint("shuffle_merge"), (F.col("source_rank") == F.col("in_rank")) & (F.col("start") == F.col("in_start")) & (F.col("size") > 0), "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    names = ["doc_id", "source", "size", "source_size", "target", "taken", "first_shard", "last_shard"]
    return _with_texts(joined, base, sized, names) if with_text else joined.select(*names)


def _with_texts(joined: DataFrame, base: DataFrame, sized: DataFrame, names: list[str]) -> DataFrame:
    """What was taken joined with the texts, each moved once, by the keys of the rows; rows that repeat whole are told apart by number."""
    keys = ["key_a", "key_b"]
    what = joined.select(*names, "start", "pieces", F.col("key_a").alias("of_a"), F.col("key_b").alias("of_b"))
    texts = base.drop("doc_id", "source")
    same = (F.col("key_a") == F.col("of_a")) & (F.col("key_b") == F.col("of_b"))
    repeats = written(sized.groupBy(*keys).count().filter("count > 1").select(F.col("key_a").alias("again_a"), F.col("key_b").alias("again_b")), "repeats")
    if repeats.isEmpty():
        rows = texts.join(what.hint("shuffle_merge"), same)
    else:
        again = lambda a, b: (F.col(a) == F.col("again_a")) & (F.col(b) == F.col("again_b"))
        what = written(what, "taken")
        once = texts.join(repeats, again(*keys), "left_anti").join(what.join(repeats, again("of_a", "of_b"), "left_anti").hint("shuffle_merge"), same)
        nth = lambda a, b, order: F.row_number().over(Window.partitionBy(a, b).orderBy(order))
        left = texts.join(repeats, again(*keys), "left_semi").withColumn("nth", nth(*keys, F.lit(1)))
        right = what.join(repeats, again("of_a", "of_b"), "left_semi").withColumn("of_nth", nth("of_a", "of_b", "start"))
        rows = once.unionByName(left.join(right.hint("shuffle_merge"), same & (F.col("nth") == F.col("of_nth"))).drop("nth", "of_nth"))
    # one epoch of all words is the text as it was
    whole = F.coalesce((F.col("taken") == F.col("size")) & F.forall("pieces", lambda p: p["epoch"] == F.element_at("pieces", 1)["epoch"]), F.lit(False))

    def built(words: Column) -> Column:
        return F.array_join(F.flatten(F.transform(F.array_sort("pieces"), lambda p: F.slice(words, (p["doc_from"] + 1).cast("int"), p["got"].cast("int")))), " ")

    # the words are the argument of a lambda, so that they are found once a text, not once a piece
    cut = F.element_at(F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), built), 1)
    rows = rows.withColumn("taken_text", F.when(F.col("taken") == 0, F.lit("")).when(whole, F.col("text")).otherwise(cut))
    return rows.select(*names, "text", "taken_text", *(["others"] if "others" in base.columns else []))
