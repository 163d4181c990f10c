"""Ordered label sequences: boundaries, runs, transitions, repeats, introductory labels.

A sequence has the columns ``subject, song_id, song_at, chunk, ord, label``. ``ord`` orders the rows
of one song. ``chunk`` is a monotone, coarser function of ``ord`` (an hour, a block of positions):
windows run inside one chunk and only a one-row summary of every chunk is ordered per song, so a
song that holds a large share of all rows never has to be sorted by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.scalars import plogp
from strophe.params import END, NOISE, START
from strophe.session import cut_lineage

SONG = ["subject", "song_id"]
CHUNK = ["subject", "song_id", "chunk"]


def sequence(
    df: DataFrame,
    *,
    subject: Column,
    song: Column,
    order: Sequence[Column],
    label: Column,
    chunk: Column,
    song_at: Column | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Bind any table of ordered labelled events to the sequence columns."""
    song = song.cast("string")
    return df.select(
        subject.alias("subject"),
        song.alias("song_id"),
        (song if song_at is None else song_at).alias("song_at"),
        chunk.alias("chunk"),
        F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("ord"),
        label.cast("string").alias("label"),
        *extra,
    ).where(F.col("label").isNotNull())


def chunk_of_position(position: Column, size: int = 100_000) -> Column:
    """Chunk key for a dense integer position."""
    return F.floor(position / size)


def build_sequence(
    segs: DataFrame, labels: DataFrame | None = None, source: str = "manual", noise: str = "keep"
) -> DataFrame:
    """Label segments by hand or by a label set; segments the set does not know become noise."""
    if source == "manual":
        return segs.where(F.col("label").isNotNull())
    if labels is None:
        raise ValueError("source='auto' needs a label set")
    auto = labels.select("segment_id", F.col("label").cast("string").alias("auto_label"))
    out = segs.drop("label").join(auto, "segment_id", "left")
    out = out.withColumn("label", F.coalesce("auto_label", F.lit(NOISE))).drop("auto_label")
    return out if noise == "keep" else out.where(F.col("label") != NOISE)


def merge_songs(seq: DataFrame, boundary: str) -> DataFrame:
    """``boundary='subject'`` joins the songs of a subject, in time order, into one."""
    if boundary == "song":
        return seq
    if boundary != "subject":
        raise ValueError("boundary is 'song' or 'subject'")
    return seq.withColumns(
        {
            "chunk": F.struct("song_at", "song_id", "chunk"),
            "ord": F.struct("song_at", "song_id", "ord"),
            "song_id": F.lit("*"),
        }
    )


def with_boundaries(seq: DataFrame, boundary: str = "song") -> DataFrame:
    """Add one start and one end token to every song; ``part`` puts them first and last."""
    seq = merge_songs(seq, boundary)
    edges = seq.groupBy(*SONG).agg(
        F.min_by("chunk", "ord").alias("c0"),
        F.min("ord").alias("o0"),
        F.max_by("chunk", "ord").alias("c1"),
        F.max("ord").alias("o1"),
    )
    tokens = edges.select(
        *SONG,
        F.explode(
            F.array(
                F.struct(
                    F.col("c0").alias("chunk"),
                    F.col("o0").alias("ord"),
                    F.lit(START).alias("label"),
                    F.lit(0).alias("part"),
                ),
                F.struct(
                    F.col("c1").alias("chunk"),
                    F.col("o1").alias("ord"),
                    F.lit(END).alias("label"),
                    F.lit(2).alias("part"),
                ),
            )
        ).alias("t"),
    ).select(*SONG, "t.*")
    body = seq.select(*SONG, "chunk", "ord", "label", F.lit(1).alias("part"))
    return body.unionByName(tokens)


def split_songs(tokens: DataFrame) -> DataFrame:
    """Rows of complete start-to-end spans only, numbered by the start that opened them.

    Expects ``subject, chunk, ord, label`` with start and end tokens inside the stream. A span is
    complete if the first token after its start is an end. Tokens are ordered inside chunks; one row
    per chunk tells which token comes before and after it.
    """
    part = ["subject", "chunk"]
    is_token = F.col("label").isin(START, END)
    token_rows = tokens.where(is_token)
    by_chunk = W.partitionBy("subject").orderBy("chunk")
    earlier = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    later = by_chunk.rowsBetween(1, W.unboundedFollowing)
    chunks = (
        tokens.groupBy(*part)
        .agg(
            F.max(F.when(is_token, F.col("ord"))).alias("last_token"),
            F.min(F.when(is_token, F.struct("ord", "label"))).alias("first_token"),
        )
        .select(
            *part,
            F.max("last_token").over(earlier).alias("token_before"),
            F.first("first_token", ignorenulls=True).over(later).alias("token_after"),
        )
    )
    in_chunk = W.partitionBy(*part).orderBy("ord")
    starts = (
        token_rows.withColumn("next_token", F.lead("label").over(in_chunk))
        .join(chunks, part)
        .where(
            (F.col("label") == START)
            & (F.coalesce("next_token", "token_after.label") == END)
        )
        .select(*part, F.col("ord").alias("since"))
    )
    count = starts.groupBy(*part).agg(F.count("*").alias("n"))
    done = count.select(*part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("done"))
    spans = (
        starts.join(done, part)
        .withColumn(
            "song_no",
            F.col("done") + F.row_number().over(W.partitionBy(*part).orderBy("since")),
        )
        .select("subject", "since", "song_no")
    )
    upto = in_chunk.rowsBetween(W.unboundedPreceding, 0)
    since = F.coalesce(F.max(F.when(is_token, F.col("ord"))).over(upto), F.col("token_before"))
    return (
        tokens.join(chunks.select(*part, "token_before"), part)
        .withColumn("since", since)
        .where(~is_token)
        .join(spans, ["subject", "since"])
        .select("subject", "song_no", "ord", "label")
    )


def with_positions(seq: DataFrame) -> DataFrame:
    """Dense 0-based position inside the song, from chunk offsets and in-chunk row numbers."""
    sizes = seq.groupBy(*CHUNK).agg(F.count("*").alias("size"))
    before = W.partitionBy(*SONG).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *CHUNK, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_start")
    )
    local = F.row_number().over(W.partitionBy(*CHUNK).orderBy("ord")) - 1
    return (
        seq.withColumn("_local", local)
        .join(offsets, CHUNK)
        .withColumn("pos", F.col("_start") + F.col("_local"))
        .drop("_start", "_local")
    )


def label_counts(seq: DataFrame) -> DataFrame:
    """Rows per subject and label; a run table contributes its lengths."""
    amount = F.sum("length") if "length" in seq.columns else F.count("*")
    return seq.groupBy("subject", "label").agg(amount.alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """Share of every label in its subject."""
    total = F.sum("n").over(W.partitionBy("subject"))
    return counts.withColumn("proportion", F.col("n") / total)


def repertoire(vocab: DataFrame, rare_share: float = 0.02) -> DataFrame:
    """Labels that are distinct, and labels above the rare share."""
    return vocab.groupBy("subject").agg(
        F.count("*").alias("n_labels"),
        F.sum((F.col("proportion") > rare_share).cast("long")).alias("repertoire_size"),
    )


def sizes(seq: DataFrame) -> DataFrame:
    """Songs and segments per subject, counted song by song."""
    amount = F.sum("length") if "length" in seq.columns else F.count("*")
    return (
        seq.groupBy(*SONG)
        .agg(amount.alias("n"))
        .groupBy("subject")
        .agg(F.count("*").alias("n_songs"), F.sum("n").alias("n_segments"))
    )


def local_runs(seq: DataFrame) -> DataFrame:
    """Runs inside one chunk, with the label before and after each in its chunk.

    A run that goes on in the next chunk is still in two parts.
    """
    w = W.partitionBy(*CHUNK).orderBy("ord")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = seq.select(
        *CHUNK, "ord", "label",
        F.lag("label").over(w).alias("before"),
        F.row_number().over(w).alias("_at"),
        F.count("*").over(whole).alias("_size"),
    )
    # runs keep the order of their first rows, so the chunk is sorted once
    starts = rows.where((F.col("_at") == 1) | (F.col("before") != F.col("label")))
    end = F.coalesce(F.lead("_at").over(w).cast("long"), F.col("_size") + 1)
    return starts.withColumns(
        {"after": F.lead("label").over(w), "length": end - F.col("_at")}
    ).drop("_at", "_size")


def with_neighbours(runs: DataFrame) -> DataFrame:
    """Label before and after every run in its chunk; null marks the ends of the chunk."""
    w = W.partitionBy(*CHUNK).orderBy("ord")
    return runs.withColumns({"before": F.lag("label").over(w), "after": F.lead("label").over(w)})


def _edges(runs: DataFrame) -> DataFrame:
    """First and last run of every chunk, in song order.

    ``group`` numbers the maximal runs they belong to; ``song_before`` and ``song_after`` are the
    labels beyond the chunk, null at the ends of the song.
    """
    w = W.partitionBy(*SONG).orderBy("chunk", "ord")
    other_chunk = F.lag("chunk").over(w) != F.col("chunk")
    goes_on = other_chunk & (F.lag("label").over(w) == F.col("label"))
    return (
        runs.where(F.col("before").isNull() | F.col("after").isNull())
        .withColumns(
            {
                "fresh": (~F.coalesce(goes_on, F.lit(False))).cast("int"),
                "song_before": F.lag("label").over(w),
                "song_after": F.lead("label").over(w),
            }
        )
        .withColumn("group", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    )


def run_lengths(seq: DataFrame) -> DataFrame:
    """Maximal runs of one label: ``subject, song_id, chunk, ord, label, length``."""
    runs = local_runs(seq)
    inner = runs.where(F.col("before").isNotNull() & F.col("after").isNotNull())
    joined = (
        _edges(runs)
        .groupBy(*SONG, "group")
        .agg(
            F.min("chunk").alias("chunk"),
            F.min("ord").alias("ord"),
            F.min("label").alias("label"),
            F.sum("length").alias("length"),
        )
    )
    columns = [*CHUNK, "ord", "label", "length"]
    return inner.select(*columns).unionByName(joined.select(*columns))


def repeat_position(seq: DataFrame, noise: Sequence[str] = (NOISE,)) -> DataFrame:
    """1-based position of every row in its run; null for noise labels."""
    w = W.partitionBy(*CHUNK).orderBy("ord")
    change = F.when(F.lag("label").over(w) != F.col("label"), 1).otherwise(0)
    rows = seq.withColumn("change", change).withColumn(
        "island", F.sum("change").over(w.rowsBetween(W.unboundedPreceding, 0))
    )
    upto = W.partitionBy(*SONG, "group").orderBy("chunk", "ord")
    carry = (
        _edges(local_runs(seq))
        .withColumn("carry", F.sum("length").over(upto.rowsBetween(W.unboundedPreceding, 0))
                    - F.col("length"))
        .where(F.col("before").isNull() & (F.col("carry") > 0))
        .select(*CHUNK, F.lit(0).cast("long").alias("island"), "carry")
    )
    in_run = F.row_number().over(W.partitionBy(*CHUNK, "island").orderBy("ord"))
    return (
        rows.withColumn("in_run", in_run)
        .join(carry, [*CHUNK, "island"], "left")
        .withColumn(
            "repeat_pos",
            F.when(
                ~F.col("label").isin(*noise), F.col("in_run") + F.coalesce("carry", F.lit(0))
            ),
        )
        .drop("change", "island", "in_run", "carry")
    )


def _fact(kind: str, a: Column, b: Column, length: Column, n: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        a.alias("a"),
        b.cast("string").alias("b"),
        length.cast("long").alias("length"),
        n.cast("long").alias("n"),
    )


def sequence_facts(
    runs: DataFrame, pairs_only: bool = False, stitch: bool = True
) -> DataFrame:
    """Counts that every sequence measure is made of: ``subject, kind, a, b, length, n``.

    ``pair`` rows are transitions from ``a`` to ``b``, ``run`` rows maximal runs of ``a``. Expects
    runs that are maximal inside their chunk; with ``stitch=False`` runs are counted as they are.
    The size is bounded by the vocabulary.
    """
    if "after" not in runs.columns:
        runs = with_neighbours(runs)
    own, after, size = F.col("label"), F.col("after"), F.col("length")
    nothing, one = F.lit(None), F.lit(1)
    whole = F.lit(True) if not stitch else F.col("before").isNotNull() & after.isNotNull()
    inner = F.array(
        F.when(size > 1, _fact("pair", own, own, nothing, size - 1)),
        F.when(after.isNotNull(), _fact("pair", own, after, nothing, one)),
        F.when(
            F.lit(not pairs_only) & whole,
            _fact("run", own, nothing, size, one),
        ),
    )
    edges = _edges(runs)
    outer = F.array(
        F.when(F.col("song_before").isNull(), _fact("pair", F.lit(START), own, nothing, one)),
        F.when(
            after.isNull(),
            _fact("pair", own, F.coalesce("song_after", F.lit(END)), nothing, one),
        ),
    )
    parts = runs.select("subject", F.explode(F.array_compact(inner)).alias("f")).unionByName(
        edges.select("subject", F.explode(F.array_compact(outer)).alias("f"))
    )
    if stitch and not pairs_only:
        joined = edges.groupBy(*SONG, "group").agg(
            F.min("label").alias("label"), F.sum("length").alias("length")
        )
        parts = parts.unionByName(
            joined.select("subject", _fact("run", own, nothing, size, one).alias("f"))
        )
    return (
        parts.select("subject", "f.*")
        .groupBy("subject", "kind", "a", "b", "length")
        .agg(F.sum("n").alias("n"))
    )


def transitions(
    seq: DataFrame, boundary: str = "song", ignored: Sequence[str] = ("\r",)
) -> DataFrame:
    """Bigram counts per subject, start and end tokens included.

    Takes a sequence or a run table. Neighbours inside a chunk come from one window; neighbours
    across chunks from the first and last run of each.
    """
    if "song_at" in seq.columns:
        merged = merge_songs(seq, boundary)
        # the chunk of a merged song names the song, so the order inside it needn't
        seq = merged if boundary == "song" else merged.withColumn("ord", F.col("ord.ord"))
    # written: no task holds the sorted rows of a chunk and those between chunks at once
    runs = seq if "length" in seq.columns else cut_lineage(local_runs(seq), "runs")
    counts = sequence_facts(runs, pairs_only=True).select(
        "subject", F.col("a").alias("from"), F.col("b").alias("to"), "n"
    )
    if ignored:
        counts = counts.where(~F.col("from").isin(*ignored) & ~F.col("to").isin(*ignored))
    return counts


def transition_probabilities(counts: DataFrame, denominator: str = "in") -> DataFrame:
    """Observed transitions with probability ``p``.

    ``'in'`` divides a row by how often its label was entered (the start row is then 0),
    ``'out'`` by how often it was left. Rows of one subject are label pairs, not events.
    """
    if denominator == "in":
        degree = (
            counts.groupBy("subject", F.col("to").alias("from")).agg(F.sum("n").alias("degree"))
        )
        joined = counts.join(degree, ["subject", "from"], "left")
        return joined.withColumn(
            "p", F.coalesce(F.col("n") / F.col("degree"), F.lit(0.0))
        ).drop("degree")
    total = F.sum("n").over(W.partitionBy("subject", "from"))
    return counts.withColumn("p", F.col("n") / total)


def transition_power(probs: DataFrame, power: int) -> DataFrame:
    """Sparse matrix power: ``subject, from, to, p`` of the non-zero cells."""
    base = probs.where(F.col("p") > 0).select("subject", "from", "to", "p")
    result = base
    for _ in range(power - 1):
        step = base.select("subject", F.col("from").alias("via"), "to", F.col("p").alias("q"))
        result = (
            result.withColumnRenamed("to", "via")
            .join(step, ["subject", "via"])
            .groupBy("subject", "from", "to")
            .agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        )
    return result


def transition_matrix(
    counts: DataFrame, denominator: str = "in", order: DataFrame | None = None
) -> DataFrame:
    """Dense cells ``n, p1, p2, p3`` over start, labels and end.

    Labels follow ``order`` (``subject, label, label_rank``) where it is given, else the alphabet.
    The label set of a subject is a vocabulary, so its square is the size of the matrix asked for.
    """
    probs = transition_probabilities(counts, denominator)
    labels = counts.select("subject", F.explode(F.array("from", "to")).alias("label")).where(
        ~F.col("label").isin(START, END)
    )
    labels = labels.distinct()
    if order is None:
        labels = labels.withColumn("label_rank", F.lit(None).cast("long"))
    else:
        labels = labels.join(order, ["subject", "label"], "left")
    ordered = labels.groupBy("subject").agg(
        F.concat(
            F.array(F.lit(START)),
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct(
                            F.coalesce("label_rank", F.lit(2**31)).alias("r"),
                            F.col("label").alias("l"),
                        )
                    )
                ),
                lambda s: s["l"],
            ),
            F.array(F.lit(END)),
        ).alias("axis")
    )
    cells = ordered.select("subject", "axis", F.posexplode("axis").alias("row", "from")).select(
        "subject", "row", "from", F.posexplode("axis").alias("col", "to")
    )
    key = ["subject", "from", "to"]
    out = cells.join(probs.withColumnRenamed("p", "p1"), key, "left")
    for power in (2, 3):
        out = out.join(
            transition_power(probs, power).withColumnRenamed("p", f"p{power}"), key, "left"
        )
    zeros = {"n": F.coalesce("n", F.lit(0))}
    zeros |= {c: F.coalesce(c, F.lit(0.0)) for c in ("p1", "p2", "p3")}
    return out.withColumns(zeros)


def order_labels(positions: DataFrame | None, vocab: DataFrame, by: str = "position") -> DataFrame:
    """Rank of every label: mean position in song, unknown last, or the alphabet."""
    if by == "alphabet" or positions is None:
        w = W.partitionBy("subject").orderBy("label")
        return vocab.select("subject", "label", F.row_number().over(w).cast("long").alias("label_rank"))
    means = positions.groupBy("subject", "label").agg(F.avg("pos").alias("mean_pos"))
    joined = vocab.select("subject", "label").join(means, ["subject", "label"], "left")
    w = W.partitionBy("subject").orderBy(F.col("mean_pos").asc_nulls_last(), "label")
    return joined.withColumn("label_rank", F.row_number().over(w).cast("long"))


def entropy(probs: DataFrame) -> DataFrame:
    """Sum of -p ln p over cells between labels, not averaged over states."""
    core = ~F.col("from").isin(START, END) & ~F.col("to").isin(START, END)
    return probs.groupBy("subject").agg(
        F.sum(F.when(core, plogp(F.col("p"))).otherwise(0.0)).alias("entropy")
    )


def entropy_scaled(probs: DataFrame, vocab: DataFrame) -> DataFrame:
    """The same sum with every row weighted by the share of its label."""
    core = ~F.col("from").isin(START, END) & ~F.col("to").isin(START, END)
    weight = vocab.select("subject", F.col("label").alias("from"), "proportion")
    return (
        probs.join(weight, ["subject", "from"], "left")
        .groupBy("subject")
        .agg(
            F.sum(
                F.when(core, F.coalesce("proportion", F.lit(0.0)) * plogp(F.col("p"))).otherwise(
                    0.0
                )
            ).alias("entropy_scaled")
        )
    )


def window_histogram(hist: Column, min_len: int = 2, max_len: int = 19) -> Column:
    """Histogram of runs as counted by windows of at most ``max_len``.

    Every window of equal labels is counted, then, from the longest length down, the windows that
    a longer one holds are taken away, never below zero. Equals the histogram of maximal runs
    unless a run is longer than ``max_len``.
    """
    lengths = F.sequence(F.lit(min_len).cast("long"), F.lit(max_len).cast("long"))
    slots = F.transform(
        lengths,
        lambda size: F.aggregate(
            hist,
            F.lit(0).cast("long"),
            lambda acc, h: acc
            + h["n"] * F.greatest(h["length"] - size + 1, F.lit(0).cast("long")),
        ),
    )

    def take_away(left: Column, longer: Column) -> Column:
        held = F.element_at(left, (longer - (min_len - 1)).cast("int"))
        return F.transform(
            left,
            lambda count, i: F.when(
                i + min_len < longer,
                F.greatest(F.lit(0).cast("long"), count - held * (longer - i - (min_len - 1))),
            ).otherwise(count),
        )

    down = F.sequence(F.lit(max_len), F.lit(min_len + 1), F.lit(-1))
    kept = F.zip_with(
        lengths,
        F.aggregate(down, slots, take_away),
        lambda size, n: F.struct(size.alias("length"), n.alias("n")),
    )
    return F.filter(kept, lambda h: h["n"] > 0)


def repeat_histogram(
    runs: DataFrame, min_len: int = 2, max_len: int = 19, cap: str = "exact"
) -> DataFrame:
    """Runs per subject, label and length.

    ``'exact'`` counts maximal runs of every length from ``min_len`` on, ``'reference'`` counts
    as :func:`window_histogram` does.
    """
    hist = (
        runs.where(F.col("length") >= min_len)
        .groupBy("subject", "label", "length")
        .agg(F.count("*").alias("n"))
    )
    if cap == "exact":
        return hist
    slots = hist.groupBy("subject", "label").agg(
        F.collect_list(F.struct("length", "n")).alias("hist")
    )
    return slots.select(
        "subject",
        "label",
        F.inline(window_histogram(F.col("hist"), min_len, max_len)),
    )


def significant_repeats(
    hist: DataFrame, vocab: DataFrame, significance: float = 0.4, adaptive: float = 0.25
) -> DataFrame:
    """Histogram rows of labels that are frequent enough and repeat enough."""
    n_labels = F.count("*").over(W.partitionBy("subject"))
    stats = vocab.select(
        "subject",
        "label",
        F.col("n").alias("label_n"),
        "proportion",
        n_labels.alias("n_labels"),
    )
    share = (
        hist.groupBy("subject", "label")
        .agg(F.sum(F.col("length") * F.col("n")).alias("repeated"))
        .join(stats, ["subject", "label"])
        .withColumn("repeat_share", F.col("repeated") / F.col("label_n"))
        .where(F.col("proportion") >= F.lit(adaptive) / F.col("n_labels"))
        .where(F.col("repeat_share") >= significance)
        .select("subject", "label", "repeat_share")
    )
    return hist.join(share, ["subject", "label"])


def repeat_stats(hist: DataFrame, dyad_share: float = 0.95) -> DataFrame:
    """Dyad labels and weighted moments of the pooled repeat lengths, from the histogram."""
    of_label = W.partitionBy("subject", "label")
    is_pair = F.col("length") == 2
    share = F.sum(F.when(is_pair, F.col("n")).otherwise(0)).over(of_label) / F.sum("n").over(
        of_label
    )
    marked = hist.withColumn("dyad", share > dyad_share)
    per_label = (
        marked.groupBy("subject", "label")
        .agg(F.max("dyad").alias("dyad"))
        .groupBy("subject")
        .agg(
            F.count("*").alias("n_repeat_labels"),
            F.sum(F.col("dyad").cast("long")).alias("num_dyad"),
        )
    )
    pooled = (
        marked.where(~(F.col("dyad") & is_pair))
        .groupBy("subject", "length")
        .agg(F.sum("n").alias("n"))
    )
    whole = W.partitionBy("subject")
    upto = whole.orderBy("length").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("n").over(whole)
    x = F.col("length") - F.col("mu")
    moments = (
        pooled.withColumns(
            {
                "total": total,
                "mu": F.sum(F.col("length") * F.col("n")).over(whole) / total,
                "upto": F.sum("n").over(upto),
            }
        )
        .groupBy("subject")
        .agg(
            F.max("mu").alias("mean_repeat"),
            (
                (
                    F.min(
                        F.when(F.col("upto") >= F.floor((F.col("total") + 1) / 2), F.col("length"))
                    )
                    + F.min(
                        F.when(F.col("upto") >= F.ceil((F.col("total") + 1) / 2), F.col("length"))
                    )
                )
                / 2
            ).alias("median_repeat"),
            (F.sum(F.col("n") * x * x) / F.max("total")).alias("var_repeat"),
            (F.sum(F.col("n") * x * x * x) / F.max("total")).alias("m3"),
            (F.sum(F.col("n") * x * x * x * x) / F.max("total")).alias("m4"),
        )
    )
    spread = F.col("var_repeat")
    return (
        per_label.join(moments, "subject", "left")
        .withColumns(
            {
                "repeat_bool": F.lit(True),
                "dyad_bool": F.col("num_dyad") > 0,
                "num_longer": F.col("n_repeat_labels") - F.col("num_dyad"),
                "skew_repeat": F.when(F.col("mean_repeat").isNull(), 0.0).otherwise(
                    F.when(spread > 0, F.col("m3") / F.pow(spread, 1.5))
                ),
                "kurt_repeat": F.when(F.col("mean_repeat").isNull(), 0.0).otherwise(
                    F.when(spread > 0, F.col("m4") / (spread * spread) - 3)
                ),
                "mean_repeat": F.coalesce("mean_repeat", F.lit(0.0)),
                "median_repeat": F.coalesce("median_repeat", F.lit(0.0)),
                "var_repeat": F.coalesce("var_repeat", F.lit(0.0)),
            }
        )
        .drop("m3", "m4", "n_repeat_labels")
    )


def intro_labels(seq: DataFrame, share: float = 0.5) -> DataFrame:
    """Labels that open at least ``share`` of the songs of a subject."""
    firsts = seq.groupBy(*SONG).agg(F.min_by("label", "ord").alias("label"))
    led = firsts.groupBy("subject", "label").agg(F.count("*").alias("n_led"))
    songs = F.sum("n_led").over(W.partitionBy("subject"))
    return led.withColumn("share_led", F.col("n_led") / songs).where(F.col("share_led") >= share)


def intro_songs(runs: DataFrame, intro: DataFrame) -> DataFrame:
    """Per song: introductory rows, and length of the opening stretch made only of them.

    Songs of subjects without introductory labels are left out.
    """
    flags = intro.select("subject", "label", F.lit(True).alias("is_intro"))
    marked = runs.join(flags.select("subject").distinct(), "subject", "left_semi").join(
        flags, ["subject", "label"], "left"
    )
    is_intro = F.col("is_intro").isNotNull()
    songs = marked.groupBy(*SONG).agg(
        F.sum(F.when(is_intro, F.col("length")).otherwise(0)).alias("n_intro"),
        F.min(F.when(~is_intro, F.col("ord"))).alias("other_at"),
    )
    leading = (
        marked.where(is_intro)
        .join(songs.select(*SONG, "other_at"), SONG)
        .where(F.col("other_at").isNull() | (F.col("ord") < F.col("other_at")))
        .groupBy(*SONG)
        .agg(F.sum("length").alias("leading"))
    )
    return songs.join(leading, SONG, "left").select(
        *SONG, "n_intro", F.coalesce("leading", F.lit(0)).alias("leading")
    )


def intro_stats(runs: DataFrame, intro: DataFrame, counts: DataFrame) -> DataFrame:
    """Per subject with introductory labels: the labels, their spread and leading-run histogram."""
    per_song = intro_songs(runs, intro)
    histogram = (
        per_song.groupBy("subject", "leading")
        .agg(F.count("*").alias("n"))
        .groupBy("subject")
        .agg(
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("leading", "n")))
            ).alias("intro_runs")
        )
    )
    spread = per_song.groupBy("subject").agg(
        F.avg("n_intro").alias("mean_intro"), F.stddev_pop("n_intro").alias("std_intro")
    )
    labels = (
        intro.join(counts, ["subject", "label"])
        .groupBy("subject")
        .agg(
            F.array_sort(F.collect_list("label")).alias("intro_labels"),
            F.max(F.col("n") > F.col("n_led")).alias("intro_recurs"),
        )
    )
    return labels.join(spread, "subject").join(histogram, "subject")


def without_intro(seq: DataFrame, intro: DataFrame) -> DataFrame:
    """The sequence with introductory labels taken out and the gaps closed."""
    return seq.join(intro.select("subject", "label"), ["subject", "label"], "left_anti")


def outgoing(probs: DataFrame, above: float = 0.01) -> DataFrame:
    """Transitions of a label that are more likely than ``above``."""
    return probs.where((F.col("p") > above) & (F.col("from") != START))


def identity_tags(vocab: DataFrame, intro: DataFrame, hist: DataFrame,
                  dyad_share: float = 0.95) -> DataFrame:
    """Intro, dyad and repeats tags per label, with its share."""
    is_pair = F.when(F.col("length") == 2, F.col("n")).otherwise(0)
    repeats = hist.groupBy("subject", "label").agg(
        (F.sum(is_pair) / F.sum("n") > dyad_share).alias("dyad")
    )
    opening = intro.select("subject", "label", F.lit(True).alias("intro"))
    return (
        vocab.join(opening, ["subject", "label"], "left")
        .join(repeats, ["subject", "label"], "left")
        .select(
            "subject",
            "label",
            "n",
            "proportion",
            F.concat_ws(
                ",",
                F.when(F.col("intro"), "intro"),
                F.when(F.col("dyad"), "dyad"),
                F.when(~F.col("dyad"), "repeats"),
            ).alias("tags"),
        )
    )
