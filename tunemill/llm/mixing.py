"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix is the golden-ratio point u_i = frac(i * phi); the cumulative target shares map it to a
source, so every stretch of the schedule holds each source in proportion, with an error of a few slots.
Each source's documents, in a keyed random order, are cut into blocks of equally many words. The r-th slot
of a source takes its block r, starting over after the last block; slots and blocks meet in a join. A source
whose target holds few blocks of the common size gets smaller ones, a share of the points in proportion to
its number of slots, and exactly as many slots as its target asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunemill.functions.prefix import prefix_sums
from tunemill.llm.names import fresh
from tunemill.session import small, written

# What counts as a word, and the weights that sources get in turn.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: frac(i * phi) in units of 2**-31: the odd number next to 2**31 / phi.
GOLDEN, UNIT_BITS = 1327217885, 31
#: Cells of the unit interval by which points find their source.
CELLS = 4096
#: The mean number of slots of a source, from which the block size follows, and the largest block.
SLOTS_PER_SOURCE, MOST_WORDS = 4096, 4096
#: A source with fewer slots than this of the common block size gets blocks of its own size, so that it has as many, or one a word.
FEWEST_SLOTS = 256
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sizes (key, source, source_size) with weight, target, lo, hi. One row per source, ordered in one task."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    table = written(sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")), "mix-sources")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n * share
    most, level, before = F.col("source_size") * F.lit(cap), 0.0, None
    while level != before:  # what the full sources leave is shared again by weight
        full = F.col("weight") * F.lit(level) >= most
        got = table.agg(F.sum(F.when(full, most)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        before, level = level, (total - (got.full or 0.0)) / got.open if got.open else level
    table = table.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return written(table.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("target")), "mix-targets")


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int | None = None,
    seed: int = 7,
) -> dict[str, DataFrame]:
    """The mix: `schedule` (slot, source, pass, block), `blocks` (source, block, doc_id, words) and `taken`.

    taken has one row per row of docs: doc_id, source, size, source_size, weight, target, taken. A text that
    is null or has no word has size 0 and is never taken. Sources sort by code point, null last, and get the
    weights in turn; null is a source of its own. The targets share `share` of all words and stop at `cap`
    times a source's words. The last block of a source is short. `block_words` sets one block size for all sources. Rows with equal ids are told apart by size.
    The order within a source is a hash of (seed, id), so reruns agree. An empty table gives empty results.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    point = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), key.alias("key"), word_count(F.col(text_col)).alias("size"), point.cast("long").alias("point")
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    sources = _targets(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    got = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("words")).first()
    n_rows = rows.count()
    block = block_words or max(1, min(MOST_WORDS, int(got.words) // (SLOTS_PER_SOURCE * max(1, got.n))))
    own = F.lit(block) if block_words else F.expr(f"cast(greatest(1, least({block}, floor(target / {FEWEST_SLOTS}))) as long)")
    order = Window.orderBy(F.col("source").isNull(), "source")
    sized = sources.filter("target > 0").withColumn("block_words", own).withColumn("points", F.expr(f"target * ({block}D / block_words)"))
    sized = sized.withColumn("to", F.sum("points").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("to") - F.col("points"))
    sized = sized.withColumn("n_blocks", F.expr("cast(ceil(source_size / block_words) as long)"))
    sized = written(sized.withColumn("wanted", F.expr(f"if(block_words < {block}, cast(round(target / block_words) as long), null)")), "mix-sized")
    width = sized.agg(F.coalesce(F.sum("points"), F.lit(0.0)).alias("points")).first().points
    n_slots = -int(-width // block)
    spread = sized.select(
        "key", "from", "to", "n_blocks", "wanted",
        F.explode(F.expr(f"sequence(cast(floor(from / {width or 1.0!r}D * {CELLS}) as int), least({CELLS - 1}, cast(floor(to / {width or 1.0!r}D * {CELLS}) as int)))")).alias("cell"),
    )
    slots = docs.sparkSession.range(n_slots).withColumnRenamed("id", "slot")
    slots = slots.withColumn("u", F.expr(f"((slot % {1 << UNIT_BITS}L) * {GOLDEN}L) % {1 << UNIT_BITS}L / {float(1 << UNIT_BITS)!r}D"))
    slots = slots.withColumn("cell", F.expr(f"cast(floor(u * {CELLS}) as int)")).withColumn("at", F.col("u") * F.lit(width))
    slots = slots.join(small(written(spread, "mix-cells")), "cell").filter("at >= from AND at < to").select("slot", "key", "n_blocks", "wanted", F.lit(1).cast("long").alias("one"))
    slots = written(slots, "mix-slots")
    ranked = prefix_sums(slots, ["key"], "slot", max(1, n_slots.bit_length()), n_slots // 256, [], "one", "rank").filter("wanted is null OR rank < wanted")
    # The points give a source of small blocks a slot or two more or less than it wants: what is missing follows at the end.
    met = slots.groupBy("key").agg(F.count(F.lit(1)).alias("met"))
    late = sized.filter("wanted is not null").join(met, "key", "left").withColumn("met", F.coalesce("met", F.lit(0).cast("long"))).filter("met < wanted")
    late = late.select("key", "n_blocks", F.explode(F.expr("sequence(met, wanted - 1)")).alias("rank"))
    late = late.withColumn("slot", F.row_number().over(Window.orderBy("rank", "key")) + F.lit(n_slots - 1))
    columns = ("slot", "key", "n_blocks", "rank")
    ranked = ranked.select(*columns).unionByName(late.select(*columns))
    schedule = ranked.withColumn("pass", F.expr("rank div n_blocks")).withColumn("block", F.expr("rank % n_blocks")).filter(F.col("pass") < F.lit(int(cap)))
    uses = schedule.groupBy("key", "block").agg(F.count(F.lit(1)).alias("uses"))

    placed = prefix_sums(rows, ["key"], "point", HASH_BITS, n_rows // 64, ["doc_id", "size", "row"], "size", "start")
    placed = placed.filter("size > 0").join(small(sized.select("key", "block_words")), "key")
    cut = placed.withColumn("block", F.explode(F.expr("sequence(start div block_words, (start + size - 1) div block_words)")))
    blocks = cut.withColumn("words", F.expr("least(start + size, (block + 1) * block_words) - greatest(start, block * block_words)"))
    got_words = blocks.join(uses, ["key", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    taken = rows.join(got_words, "row", "left").join(small(sources.select("key", "source_size", "weight", "target")), "key")
    return {
        "schedule": schedule.select("slot", F.expr("if(key = 'n', null, substring(key, 2))").alias("source"), "pass", "block"),
        "blocks": blocks.select("source", "block", "doc_id", "words"),
        "taken": taken.select("doc_id", "source", "size", "source_size", "weight", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")),
    }


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """docs as often as the mix takes them: not at all, once, or up to `cap` times; columns stay as they are.

    A document that the mix takes in part is there whole. Of rows with equal id and source, each comes as
    often as the one that is taken most.
    """
    taken = mix_plan(docs, id_col, text_col, source_col, **params)["taken"]
    times = F.expr("cast(ceil(taken / size) as int)")
    key, source, n, turn = fresh(docs, "_id", "_source", "_times", "_turn")
    wanted = taken.filter("taken > 0").groupBy(F.col("doc_id").alias(key), F.col("source").alias(source)).agg(F.max(times).alias(n))
    wanted = small(written(wanted, "mix-wanted"))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(source))
    out = docs.join(wanted, same).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(n))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
