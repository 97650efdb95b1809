"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source has a target of words. The rates of its documents are those nearest in entropy to taking each once that meet the target:
rate = min(MOST, exp(theta * size)), the tilt theta being where the convex dual of the token constraint is flat. All duals are solved
together by Newton steps, each one aggregation over (source, size) classes, kept inside brackets. Rates then become whole copies:
expected copies, added up in order of size, are rounded as running totals, which leaves less than one document's words; a few
rounds of single copies remove what is left of that.

Sums that steer a decision are of integers (rates count in millionths of a millionth), so the order of additions does not show: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.shared import integer_divided, salted, staged, table
from barloom.operators.scan import bucketed_scan

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # all targets together, times all sizes
MOST = 2  # copies of a document
FINE = 10**12  # a rate counts in so many parts
STEPS = 80
BLOCK_BITS = 12  # documents of a class that one key of the last join has
BUCKET = 256  # sizes of one bucket of a running total
LONG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(sizes: DataFrame) -> DataFrame:
    """Rows (known, source, size, mark, doc_id) in this order, each with a place that grows along it.

    The sort is over ranges, so a source or a class of equal sizes may span tasks. It reads its input twice.
    """
    order = [F.col("known").desc(), F.col("source"), F.col("size"), F.col("mark"), F.col("doc_id")]
    return staged(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "numbered")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(known, source, docs, source_size) to the same with weight, full (the target is all that the source can give) and target.

    Weights go round in order of code points, null last. The share above MOST times a source's size is dealt again by weight
    until no source is above. Each round is one aggregation; the driver sees two sums.
    """
    order = [F.col("known").desc(), F.col("source")]
    rows = staged(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33).alias("part")
    counts = rows.groupBy(part).agg(F.count("*").alias("many"))  # one row for each partition of the sort
    starts = counts.select("part", (F.sum("many").over(Window.orderBy("part")) - F.col("many")).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("long")
    rows = staged(rows.withColumn("part", part).join(starts, "part").withColumn("weight", weight).select("known", "source", "docs", "source_size", "weight"), "weights")
    (up, down), whole = SHARE, F.col("source_size").cast(LONG)
    total = rows.agg(F.sum(whole)).first()[0] or 0
    full, seen = F.lit(False), None
    while True:  # what is left, over weights left, in halves: (up * total - down * MOST * taken) / (down * weights)
        taken, open_weights = rows.agg(F.sum(F.when(full, whole).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        left = up * int(total) - down * MOST * int(taken or 0)
        if (left, open_weights) == seen or not open_weights:
            break
        seen = (left, open_weights)
        above = F.col("weight").cast(LONG) * F.lit(str(left)).cast(LONG) >= whole * F.lit(str(down * MOST * int(open_weights))).cast(LONG)
        full = above
    level = F.lit(float(left)) / F.lit(float(down * open_weights)) if open_weights else F.lit(0.0)
    return rows.withColumn("full", full).withColumn("target", F.when(F.col("full"), (F.col("source_size") * MOST).cast("double")).otherwise(F.col("weight") * level))


def tilts(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """(known, source, theta) of the sources that are not full, from their (source, size, n) classes and targets.

    theta counts in units of the source's mean size. A step is Newton's on the derivative of the dual, words at the present rates less the
    target; where it would leave the bracket of tilts known to be too low or too high, the bracket is halved instead.
    """
    key = ["known", "source"]
    unknown = F.lit(None).cast("double")
    state = sources.where(~F.col("full")).select(*key, "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("theta"), unknown.alias("low"), unknown.alias("high"), F.lit(False).alias("done"))
    state = staged(state, "tilts")
    for _ in range(STEPS):
        rows = salted(classes, state.where(~F.col("done")).select(*key, "theta", "mean"), key, F.col("size"))
        rows = rows.withColumn("rate", rate(F.col("theta") * (F.col("size") / F.col("mean"))))
        words = F.col("n").cast(LONG) * F.col("size").cast(LONG) * F.col("rate").cast("decimal(19,0)")
        slope = F.when(F.col("rate") < MOST * FINE, words * F.col("size").cast("decimal(19,0)")).otherwise(F.lit(0).cast(LONG))
        sums = rows.groupBy(*key).agg(F.sum(words.cast(LONG)).alias("words"), F.sum(slope.cast(LONG)).alias("slope"))
        here = state.join(sums, key, "left").withColumns({"words": F.col("words").cast("double") / FINE, "slope": F.col("slope").cast("double") / FINE / F.col("mean")})
        gap = F.col("words") - F.col("target")
        met = F.col("done") | F.coalesce(F.abs(gap) <= F.greatest(F.lit(0.5), F.col("target") * 1e-6), F.lit(False))
        low, high = (F.when(~met & side, F.col("theta")).otherwise(F.col(name)) for name, side in (("low", gap < 0), ("high", gap > 0)))
        here = here.withColumns({"low": low, "high": high, "done": met})
        newton = F.when(F.col("slope") > 0, F.col("theta") - gap / F.col("slope"))
        outward = F.when(gap < 0, F.greatest(F.col("theta"), F.lit(0.0)) * 2 + 1).otherwise(F.least(F.col("theta"), F.lit(0.0)) * 2 - 1)
        inside = newton.isNotNull() & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high"))) & (F.abs(newton - F.col("theta")) <= F.abs(F.col("theta")) + 1)
        halved = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2).otherwise(outward)
        moved = F.when(F.col("done"), F.col("theta")).when(inside, newton).otherwise(halved)
        state = staged(here.select(*key, "target", "mean", moved.alias("theta"), "low", "high", "done"), "tilts")
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select(*key, "theta", "mean")


def rate(tilt: Column) -> Column:
    """min(MOST, exp(tilt)), in parts of FINE."""
    return F.floor(F.least(F.exp(F.least(tilt, F.lit(2.0))), F.lit(float(MOST))) * FINE).cast("long")


def class_copies(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """(known, source, size, n) with the copies that all n documents of the class have together."""
    key = ["known", "source"]
    known = sources.join(tilts(classes, sources), key, "left").select(*key, "full", "target", "theta", "mean")
    rows = salted(classes, staged(known, "tilted"), key, F.col("size"))
    fine = F.when(F.col("full"), F.lit(MOST * FINE)).otherwise(rate(F.col("theta") * (F.col("size") / F.col("mean"))))
    rows = rows.withColumns({"expected": F.col("n").cast(LONG) * fine.cast("decimal(19,0)"), "down": -F.col("size"), "bucket": F.floor(-F.col("size") / BUCKET)})
    rows = staged(rows.withColumn("expected", F.col("expected").cast(LONG)).select(*key, "size", "n", "expected", "down", "bucket", "target"), "expected")
    rows = bucketed_scan(rows, key, ["down"], "bucket", sums={"upto": F.col("expected")})
    nearest = lambda c: integer_divided(c + F.lit(FINE // 2), F.lit(FINE))
    copies = nearest(F.col("upto")) - nearest(F.col("upto") - F.col("expected"))
    rows = staged(rows.select(*key, "size", "n", "target", copies.cast("long").alias("copies")), "copies")
    while True:  # what a source is off its target, and the class whose copies come nearest to that
        gaps = rows.groupBy(*key).agg((F.round(F.max("target")).cast("long") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
        gaps = staged(gaps.where("gap <> 0"), "gaps")
        apart = F.abs(F.col("gap"))
        room = F.when(F.col("gap") > 0, F.col("n") * MOST - F.col("copies")).otherwise(F.col("copies"))
        near = salted(rows.where("size > 0"), gaps, key, F.col("size")).withColumn("room", room).where((F.col("room") > 0) & (F.col("size") < 2 * apart))
        near = near.withColumn("more", F.least("room", F.greatest(F.lit(1), integer_divided(apart, F.col("size"))))).withColumn("left", F.abs(apart - F.col("size") * F.col("more")))
        best = near.groupBy(*key).agg(F.min(F.struct("left", "size", (F.col("more") * F.signum("gap")).cast("long").alias("more"))).alias("best"))
        best = staged(best.select(*key, "best.size", "best.more"), "changes")
        if best.isEmpty():
            return rows.select(*key, "size", "n", "copies")
        rows = staged(rows.join(best, [*key, "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Rows with doc_id, source and text to (doc_id, source, size, source_size, target, copies, taken).

    size: the words of the text, none for null. Sources in order of code points, null last, have the weights in turn. Each
    document is taken 0 to MOST times; of equal sizes in a source the order of a hash says who has one more. Repeated rows are documents
    of their own; rows without words are taken 0 words. An empty table gives no rows. Other columns are not read.
    """
    key = ["known", "source"]
    source = F.col("source").cast("string")
    sizes = docs.select("doc_id", source.isNotNull().alias("known"), F.coalesce(source, F.lit("")).alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("mark"))
    rows = numbered(staged(sizes, "sizes")).withColumn("block", F.shiftright("place", BLOCK_BITS))
    pieces = staged(rows.groupBy(*key, "size", "block").agg(F.count("*").alias("many"), F.min("place").alias("first")), "pieces")
    classes = staged(pieces.groupBy(*key, "size").agg(F.sum("many").alias("n")), "classes")
    sums = classes.groupBy(*key).agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = staged(source_targets(sums, weights), "targets")
    copies = salted(class_copies(classes, sources), sources.select(*key, "source_size", "target"), key, F.col("size"))
    earlier = Window.partitionBy(*key, "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("before", F.coalesce(F.sum("many").over(earlier), F.lit(0))).join(copies, [*key, "size"])
    whole = rows.join(placed, [*key, "size", "block"])
    rank = F.col("before") + F.col("place") - F.col("first")
    taken = integer_divided(F.col("copies"), F.col("n")) + (rank < F.pmod(F.col("copies"), F.col("n"))).cast("long")
    whole = whole.withColumn("_copies", taken)
    return whole.select("doc_id", F.when(F.col("known"), F.col("source")).alias("source"), "size", "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("size")).alias("taken"))


def op13_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
