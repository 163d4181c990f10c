"""Mixing sources to target weights by blocks of words."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import WORD, load, part_of, row_hash, running_start
from strophe.session import cut_lineage

BLOCK = 256
SHARD = 65_536
BUCKETS = 1024
SEED = 20_260


@dataclass(frozen=True)
class Plan:
    """What is taken of one source: ``taken`` words in ``slots`` blocks.

    Every pass over the source takes each of its ``blocks`` once; the last pass stops when the
    words are reached.
    """

    source: str | None
    size: int
    target: float
    taken: int
    blocks: int
    slots: int


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Add ``target`` to a table (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all
    sizes; a target stops at ``cap`` times its source's size and the excess is shared again by
    weight. That is min(cap, level * weight) for one level: the largest of the levels that follow
    when the sources with the smallest cap per weight are taken as full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    weighed = sources.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    ).withColumn("most", F.col("size") * float(cap))
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source"))
    level = (
        F.sum("size").over(Window.partitionBy()) * float(share)
        - F.coalesce(F.sum("most").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(before.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        weighed.withColumn("level", level)
        .withColumn("level", F.max("level").over(Window.partitionBy()))
        .select("source", "size", F.least("most", F.col("level") * F.col("weight")).alias("target"))
    )


def _plans(sized: DataFrame, weights, share, cap, block) -> list[Plan]:
    """One row per source comes to the driver: the list of sources is the setting of a mix."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"))
    plans = []
    for row in targets(totals, weights, share, cap).collect():
        size, taken = row["size"], round(row["target"])
        blocks = math.ceil(size / block)
        passes, rest = divmod(taken, size) if size else (0, 0)
        slots = passes * blocks + math.ceil(rest / block)
        plans.append(Plan(row["source"], size, row["target"], taken, blocks, slots))
    return sorted(plans, key=lambda p: (p.source is None, p.source or ""))


def _plan_table(spark: SparkSession, plans: list[Plan]) -> DataFrame:
    rows = [(i, *vars(p).values()) for i, p in enumerate(plans)]
    return spark.createDataFrame(
        rows,
        "src int, source string, source_size long, target double, words long, blocks long, "
        "slots long",
    )


def draw_slots(spark: SparkSession, plans: list[Plan], shard: int, seed: int) -> DataFrame:
    """Rows (shard, slot, src, j): the source of every output slot and its running index there.

    The slots of a shard draw their sources independently, which makes the counts of a shard
    multinomial. Over all shards the draws miss the wanted totals by about their square root;
    exactly that surplus is dealt to the sources that fell short.
    """
    total = sum(p.slots for p in plans)
    if not total:
        return spark.createDataFrame([], "shard long, slot long, src int, j long")
    ends, at = [], 0
    for p in plans:
        at += p.slots
        ends.append(at)
    drawn = spark.range(total).select(
        F.floor(F.col("id") / shard).alias("shard"),
        F.col("id").alias("slot"),
        F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("u"),
    )
    drawn = drawn.select("shard", "slot", part_of(F.col("u"), ends).cast("int").alias("src"))
    numbered = running_start(
        drawn.withColumn("one", F.lit(1)), ["src"], "shard", ["slot"], "one", "j"
    ).drop("one")
    got = {r["src"]: r["n"] for r in numbered.groupBy("src").agg(F.count("*").alias("n")).collect()}
    over, short, into = [], [], []
    extra = lack = 0
    for i, p in enumerate(plans):
        over.append(extra - p.slots)
        n = got.get(i, 0)
        extra += max(0, n - p.slots)
        if n < p.slots:
            short.append(lack)
            into.append((i, n - lack))
            lack += p.slots - n
    limit = F.array(*[F.lit(p.slots) for p in plans])
    surplus = F.col("j") + F.get(F.array(*map(F.lit, over)), F.col("src"))
    if not short:
        return numbered
    which = part_of(surplus, short) - 1
    moved = F.get(
        F.array(*[F.struct(F.lit(i).alias("src"), F.lit(n).cast("long").alias("n")) for i, n in into]),
        which,
    )
    kept = F.col("j") < F.get(limit, F.col("src"))
    return numbered.select(
        "shard",
        "slot",
        F.when(kept, F.col("src")).otherwise(moved["src"]).alias("src"),
        F.when(kept, F.col("j")).otherwise(surplus + moved["n"]).alias("j"),
    )


@dataclass(frozen=True)
class Mix:
    rows: DataFrame  # doc_id, source, tie, size, src, source_size, target, o (start in source)
    pieces: DataFrame  # shard, slot, pass, src, o, doc_id, start (word in document), length


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = SEED,
) -> Mix:
    """Mix the sources of ``docs`` (doc_id, text, source) to target word counts.

    The words of a source form one stream, documents in hash order, cut into blocks of ``block``.
    Every output slot takes one block: its source is drawn, its running index is mapped through a
    pseudorandom permutation of the source's blocks, and the block is joined by that index. The
    last, shorter block of a source stays last in each pass, and the last slot takes only the
    words that are wanted, so each source gives its target, rounded. ``cap`` at most 2 keeps every
    document within twice its size.

    Null text has no words; documents without words are in ``rows`` only. A null source is a
    source. Null and repeated doc_ids are rows like others. An empty table gives empty results.
    Equal runs on equal rows agree: all order comes from hashes of the content.
    """
    spark = docs.sparkSession
    sized = cut_lineage(
        docs.select(
            "doc_id",
            "source",
            F.xxhash64("text").alias("tie"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    plans = _plans(sized, weights, share, cap, block)
    table = _plan_table(spark, plans)
    bucketed = sized.withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie"), F.lit(BUCKETS))
    )
    placed = running_start(
        bucketed, ["source"], "bucket", ["doc_id", "tie", "size"], "size", "o"
    ).drop("bucket")
    known = table.withColumnRenamed("source", "__source")
    rows = cut_lineage(
        placed.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("__source"))).drop(
            "__source"
        ),
        "placed",
    )

    spans = rows.where("size > 0").select(
        "src", "doc_id", "o", "size", "source_size", "blocks", "words",
        F.explode(
            F.sequence(
                F.floor(F.col("o") / block), F.floor((F.col("o") + F.col("size") - 1) / block)
            )
        ).alias("block"),
    )
    first = F.greatest(F.col("o"), F.col("block") * block)
    spans = spans.withColumn("at", first - F.col("block") * block).withColumn(
        "end", F.least(F.col("o") + F.col("size") - F.col("block") * block, F.lit(block))
    )
    # a block has exactly one piece that holds its first word
    tail = (F.col("block") == F.col("blocks") - 1) & (F.col("source_size") % block != 0)
    blocks = spans.where("at = 0").select(
        "src",
        "block",
        tail.alias("tail"),
        "blocks",
        F.xxhash64(F.lit(seed + 1), "src", "block").alias("key"),
        F.lit(1).alias("one"),
    )
    shuffled = running_start(
        blocks.where("NOT tail").withColumn("bucket", F.pmod("key", F.lit(BUCKETS))),
        ["src"],
        "bucket",
        ["key", "block"],
        "one",
        "k",
    ).select("src", "block", "k")
    order = shuffled.unionByName(
        blocks.where("tail").select("src", "block", (F.col("blocks") - 1).alias("k"))
    )
    slots = draw_slots(spark, plans, shard, seed).join(
        F.broadcast(table.select("src", "blocks", "words", "source_size")), "src"
    )
    passes = F.floor(F.col("j") / F.col("blocks"))
    slots = slots.select(
        "shard",
        "slot",
        "src",
        passes.alias("pass"),
        (F.col("j") - passes * F.col("blocks")).alias("k"),
        F.least(
            F.lit(block),
            F.col("words") - passes * F.col("source_size")
            - (F.col("j") - passes * F.col("blocks")) * block,
        ).alias("room"),
    )
    chosen = slots.join(order, ["src", "k"])
    pieces = (
        chosen.join(spans.select("src", "block", "doc_id", "o", "at", "end"), ["src", "block"])
        .where("at < room")
        .select(
            "shard", "slot", "pass", "src", "o", "doc_id",
            (F.col("block") * block + F.col("at") - F.col("o")).alias("start"),
            (F.least("end", "room") - F.col("at")).alias("length"),
        )
    )
    return Mix(rows, pieces)


def taken_words(mixed: Mix) -> DataFrame:
    """One row per document: size, source_size, target of its source, words taken."""
    taken = mixed.pieces.groupBy("src", "o").agg(F.sum("length").alias("taken"))
    full = mixed.rows.where("size > 0").join(taken, ["src", "o"], "left")
    columns = ["doc_id", "size", "source_size", "target"]
    return full.select(*columns, F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(
        mixed.rows.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix takes them, with all columns: a row per pass over a document.

    A pass that takes all words of a document keeps its text; one that takes some keeps the
    taken words, one space between, and n_chars follows. Documents of which nothing is taken, as
    those without words, go. Rows that agree in doc_id, text and source are told apart by a hash of
    their other columns, which may have any type.
    """
    mixed = mix(docs.select("doc_id", "text", "source"), **settings)
    runs = mixed.pieces.groupBy("src", "o", "pass").agg(
        F.sum("length").alias("taken"),
        F.array_sort(F.collect_list(F.struct("start", "length"))).alias("runs"),
    )
    same = Window.partitionBy("__id", "__tie", "__source").orderBy("o")
    rows = mixed.rows.where("size > 0").select(
        F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"),
        F.col("source").alias("__source"), "src", "o", "size",
    )
    taken = rows.withColumn("__nth", F.row_number().over(same)).join(runs, ["src", "o"])
    taken = taken.select(
        "__id", "__tie", "__source", "__nth", F.col("size").alias("__size"),
        F.col("taken").alias("__taken"), F.col("runs").alias("__runs"),
    )
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    named = docs.withColumn("__own", F.xxhash64("text")).withColumn(
        "__dup",
        F.row_number().over(
            Window.partitionBy("doc_id", "__own", "source").orderBy(row_hash(others))
        ),
    )
    joined = named.join(
        taken,
        named["doc_id"].eqNullSafe(taken["__id"])
        & named["source"].eqNullSafe(taken["__source"])
        & (named["__own"] == taken["__tie"])
        & (named["__dup"] == taken["__nth"]),
    )
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(
        F.flatten(
            F.transform(
                "__runs",
                lambda r: F.slice("__words", (r["start"] + 1).cast("int"), r["length"].cast("int")),
            )
        ),
        " ",
    )
    whole = F.col("__size") == F.col("__taken")
    out = joined.withColumn("__words", F.when(~whole, words)).withColumn(
        "__text", F.when(whole, F.col("text")).otherwise(cut)
    )
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__text").alias("text"))
        elif c == "n_chars":
            columns.append(
                F.when(whole, F.col("n_chars"))
                .otherwise(F.length("__text").cast(docs.schema["n_chars"].dataType))
                .alias("n_chars")
            )
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix(load(spark, sf_dir, "documents", "doc_id", "text", "source")))
