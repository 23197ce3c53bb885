"""A mix of sources at target weights, dealt over shards; DataFrame functions only.

The size of a document is its number of maximal runs of anything but blank, tab, line feed, vertical tab, form feed
and carriage return. Sources, in order of code point and null last, weigh ``WEIGHTS``, repeating. Targets share
the size of the whole corpus by weight, are capped at ``MAX_REPEAT`` times the size of their source, and what is
cut off is shared by weight among the others until none is above its cap.

* A document's place in its source is a hash of its id and text. The places of a source are cut into blocks of
  about equal size; a source takes every block ``target // size`` times and then its first places until the rest
  of the target would be passed. That cut is refined twice by ``CELLS``, so it falls on a group of documents with
  the same 24 bits of hash: one document, or a sixteen-millionth of a large source. The one document behind the
  cut whose size is nearest to what is still lacking is taken as well, if that helps.
* The blocks a source takes are its quota. A binary tree splits the quotas among ``shards``: at each node the
  blocks are put in random order and half of them go left, which draws the left quotas from the multivariate
  hypergeometric distribution and keeps every total exact. A shard's quota of a source then is the next
  range of the source's blocks in permuted order, so shards hold disjoint blocks.
* Rows go to their shard: ``mixed_documents`` gives each shard partitions of its own, one for each ``PART_WORDS`` words,
  where rows lie in random order by ``place``, a hash of id, text and copy. Documents that the quotas leave out go nowhere.

Draws are hashes of ids and seeds: reruns, retries and other cluster sizes give the same mix. Documents are taken
whole, so the words taken from a source differ from its target by less than the document at the cut has.
Null or blank texts have size 0 and are taken as their block is. Equal rows (same id and text) are taken alike.
A table whose texts are all blank has targets 0, and takes nothing. Null sources form one source.
The plan shuffles only per-source and per-block totals, which have at most CELLS rows for a source. Texts are shuffled
once, to their shards; the partitions of a shard are dealt by ``place``, so only rows with equal id and text meet in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.runtime import column as named
from flowlens.runtime import materialise

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
CELLS = 4096
SHARDS = 16
#: Blocks of average size that a shard gets.
BLOCKS_PER_SHARD = 64
#: Words of a partition of a shard, about 40 MB of text.
PART_WORDS = 8_000_000
#: Rows of the block table that are broadcast to the documents; beyond, both sides are shuffled.
BROADCAST_ROWS = 100_000


def _broadcast(df: DataFrame) -> DataFrame:
    """A broadcast side if the table has at most BROADCAST_ROWS rows, else the table as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources sorted by cap over weight reach their caps in that order, so running sums over one row per
    source give the level at which the others share.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(order) - 1
    listed = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", rank)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    listed = listed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = listed.withColumn("level", level).withColumn("free", F.col("cap") >= F.col("weight") * F.col("level"))
    # past the first free source the level no longer changes, so that one's level holds for all free ones
    levelled = levelled.withColumn("turn", F.row_number().over(up))
    first = F.min(F.when(F.col("free"), F.struct("turn", "level"))).over(everything)
    target = F.when(F.col("turn") >= F.col("first.turn"), F.col("weight") * F.col("first.level")).otherwise(F.col("cap").cast("double"))
    return levelled.withColumn("first", first).select("source", "source_size", target.alias("target"), "rank")


def _cut(cells: DataFrame, cell: str, keys: list[str]) -> DataFrame:
    """Adds the words ``before`` each cell of its source and ``upto`` its end."""
    w = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("upto", F.sum("words").over(w))
    return run.withColumn("before", F.col("upto") - F.col("words"))


def mix_plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, shards: int = SHARDS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sizes: a small row per document, blocks: what is taken of each block of each source)."""
    keyed = materialise(_keyed(docs, id_col, text_col, source_col, seed).select("id", "source", "size", "cell", "fine"), "sizes")
    cells = materialise(keyed.groupBy("source", "cell").agg(F.sum("size").alias("words")), "cells")
    targets = source_targets(cells.select("source", F.col("words").alias("size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = targets.withColumn("passes", whole).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    total = Window.partitionBy()
    block_words = F.greatest(F.sum("source_size").over(total) / F.lit(shards * BLOCKS_PER_SHARD), F.lit(1.0))
    n_blocks = F.least(F.greatest(F.round(F.col("source_size") / block_words), F.lit(1.0)), F.lit(float(CELLS))).cast("int")
    targets = materialise(targets.withColumn("n_blocks", n_blocks), "targets")

    same = F.col("c.source").eqNullSafe(F.col("t.source"))
    known = cells.alias("c").join(_broadcast(targets).alias("t"), same).select(
        "t.*", "c.cell", "c.words"
    )
    run = _cut(known, "cell", ["source"])
    edge = run.where("before < rest AND upto >= rest").select("source", "cell", (F.col("rest") - F.col("before")).alias("left"))
    here = F.col("k.source").eqNullSafe(F.col("e.source")) & (F.col("k.cell") == F.col("e.cell"))
    inner = keyed.alias("k").join(_broadcast(edge).alias("e"), here)
    inner = inner.groupBy("e.source", "e.cell", "k.fine", "e.left").agg(F.sum("k.size").alias("words"))
    fine = _cut(inner, "fine", ["source"]).where("upto <= left")
    fine = fine.groupBy("source").agg(F.max("fine").alias("fine"), F.max("upto").alias("got"))
    edge = edge.alias("e").join(fine.alias("f"), F.col("e.source").eqNullSafe(F.col("f.source")), "left").select(
        F.col("e.source").alias("source"),
        F.col("e.cell").alias("cut_cell"),
        F.coalesce("f.fine", F.lit(-1)).alias("cut_fine"),
        (F.col("e.left") - F.coalesce("f.got", F.lit(0))).alias("lacks"),
    )
    # a source whose rest is not reached by any cell has none left to take
    marked = targets.alias("t").join(edge.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
    none = F.lit(-1)
    marked = marked.select("t.*", *[F.coalesce(f"e.{c}", none).alias(c) for c in ("cut_cell", "cut_fine", "lacks")])
    marked = materialise(marked, "cut")
    extra = _fillers(keyed, marked).alias("x")
    marked = marked.alias("m").join(extra, F.col("m.source").eqNullSafe(F.col("x.source")), "left")
    marked = marked.select("m.*", *[F.coalesce(f"x.pick.{c}", none).alias(f"extra_{c}") for c in ("cell", "fine", "size")])
    marked = materialise(marked, "marked")

    blocks = marked.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    first_cell = F.ceil(F.col("block") * F.lit(CELLS) / F.col("n_blocks")).cast("int")
    reached = (first_cell < F.col("cut_cell")) | ((first_cell == F.col("cut_cell")) & (F.col("cut_fine") >= 0))
    reached = reached | ((F.col("extra_cell") >= 0) & (_block("extra_cell") == F.col("block")))
    blocks = blocks.withColumn("uses", F.col("passes") + reached.cast("int"))
    slots = blocks.where("uses > 0").select("source", "block", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("copy"))
    dealt = _dealt(materialise(slots, "slots"), shards, seed)
    dealt = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))
    b, d = blocks.alias("b"), dealt.alias("d")
    joined = b.join(d, F.col("b.source").eqNullSafe(F.col("d.source")) & (F.col("b.block") == F.col("d.block")), "left")
    joined = joined.select("b.*", F.coalesce(F.col("d.dealt.shard"), F.array().cast("array<int>")).alias("shards"))
    return keyed, materialise(joined, "blocks")


def _block(cell: str) -> Column:
    return F.floor(F.col(cell) * F.col("n_blocks") / F.lit(CELLS)).cast("int")


def _inside(cell: str = "cell", fine: str = "fine") -> Column:
    """Whether a document lies before its source's cut."""
    return (F.col(cell) < F.col("cut_cell")) | ((F.col(cell) == F.col("cut_cell")) & (F.col(fine) <= F.col("cut_fine")))


def _fillers(keyed: DataFrame, marked: DataFrame) -> DataFrame:
    """Per source the document behind the cut whose size is nearest to what the source still lacks, if it helps."""
    m = _broadcast(marked.where("lacks > 0").select("source", "cut_cell", "cut_fine", "lacks")).alias("m")
    rest = keyed.alias("k").join(m, F.col("k.source").eqNullSafe(F.col("m.source")))
    off = F.abs(F.col("k.size") - F.col("m.lacks"))
    rest = rest.where(~_inside("k.cell", "k.fine") & (off < F.col("m.lacks")))
    rest = rest.select("k.source", F.struct(off.alias("off"), "k.cell", "k.fine", "k.size").alias("pick"))
    return rest.groupBy("source").agg(F.min("pick").alias("pick"))


def _dealt(slots: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, block, copy, shard): the splitting tree over source quotas, then blocks in permuted order."""
    levels = max(0, (shards - 1).bit_length())
    if 1 << levels != shards:
        raise ValueError("the number of shards is a power of two")
    quotas = slots.groupBy("source").agg(F.count("*").cast("int").alias("quota")).withColumn("node", F.lit(0))
    for level in range(levels):
        units = quotas.select("node", "source", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("unit"))
        draw = F.xxhash64(F.lit(seed), F.lit(level), "node", F.coalesce(F.col("source").cast("string"), F.lit("\0")), "unit")
        order = Window.partitionBy("node").orderBy(draw, "source", "unit")
        half = F.count("*").over(Window.partitionBy("node"))
        units = units.withColumn("right", (F.row_number().over(order) * 2 > half + F.col("node") % 2).cast("int"))
        quotas = units.groupBy("source", (F.col("node") * 2 + F.col("right")).alias("node")).agg(F.count("*").cast("int").alias("quota"))
    upto = Window.partitionBy("source").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    ranges = quotas.withColumn("upto", F.sum("quota").over(upto))
    ranges = ranges.select(
        "source", F.col("node").cast("int").alias("shard"), F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("turn")
    )
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), F.lit("blocks"), "block", "copy"), "block", "copy")
    turned = slots.withColumn("turn", F.row_number().over(permuted).cast("bigint")).alias("s")
    r = ranges.alias("r")
    return turned.join(r, F.col("s.source").eqNullSafe(F.col("r.source")) & (F.col("s.turn") == F.col("r.turn"))).select(
        "s.source", "s.block", "s.copy", "r.shard"
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Adds id, source, size and the two parts of the place in the source's order."""
    place = F.xxhash64(F.lit(seed), named(id_col), named(text_col))
    return docs.select(
        named(id_col).alias("id"),
        named(source_col).alias("source"),
        word_count(named(text_col)).alias("size"),
        F.shiftrightunsigned(place, 52).cast("int").alias("cell"),
        F.shiftrightunsigned(place, 40).bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("fine"),
        F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("doc"),
    )


def _applied(keyed: DataFrame, blocks: DataFrame) -> DataFrame:
    """``keyed`` with its source's size and target and the shards of its copies."""
    k, b = keyed.alias("k"), _broadcast(blocks).alias("b")
    per_source = ["n_blocks", "passes", "cut_cell", "cut_fine", "extra_cell", "extra_fine", "extra_size", "source_size", "target"]
    s = _broadcast(blocks.select("source", *per_source).distinct()).alias("s")
    placed = k.join(s, F.col("k.source").eqNullSafe(F.col("s.source"))).select("k.*", *[f"s.{c}" for c in per_source])
    placed = placed.withColumn("block", _block("cell")).alias("p")
    same = F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.block") == F.col("b.block"))
    joined = placed.join(b, same).select("p.*", "b.shards")
    filler = (F.col("cell") == F.col("extra_cell")) & (F.col("fine") == F.col("extra_fine")) & (F.col("size") == F.col("extra_size"))
    return joined.withColumn("shards", F.slice("shards", F.lit(1), F.col("passes") + (_inside() | filler).cast("int")))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(id, size, source_size, target, taken, shards) for every row; ``shards`` has one entry for each copy."""
    keyed, blocks = mix_plan(docs, id_col, text_col, source_col, shards, seed)
    taken = (F.col("size") * F.size("shards")).alias("taken")
    return _applied(keyed, blocks).select(F.col("id").alias(id_col), "size", "source_size", "target", taken, "shards")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The mix: every row as often as it is taken, with ``shard``, ``copy`` and ``place``, in its shard and shuffled there.

    The partitions of shard ``s`` are ``s * k`` to ``s * k + k - 1``, where ``k`` follows from the words of the corpus. Columns of
    ``docs`` with the added names are replaced.
    """
    docs = docs.drop("shard", "copy", "place")
    _, blocks = mix_plan(docs, id_col, text_col, source_col, shards, seed)
    chosen = _applied(_keyed(docs, id_col, text_col, source_col, seed), blocks)
    words = blocks.select("source", "source_size").distinct().agg(F.sum("source_size")).first()[0] or 0
    parts = max(1, -(-words // (shards * PART_WORDS)))
    copies = chosen.select("doc", "id", "cell", "fine", F.posexplode("shards").alias("copy", "shard"))
    place = F.xxhash64(F.lit(seed), F.lit("place"), "id", "cell", "fine", "copy")
    placed = copies.select("doc.*", "shard", "copy", place.alias("place"))
    own = F.col("shard") * F.lit(parts) + F.pmod("place", F.lit(parts)).cast("int")
    return placed.repartitionById(shards * parts, own).sortWithinPartitions("shard", "place")
