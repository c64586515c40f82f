"""Mixing sources to target weights by entropy balancing.

The rates of the documents are the ones closest in entropy to taking every
document once that meet one token constraint for each source: the solution
of the convex dual tilts the odds of a document exponentially in its size,
``rate = cap / (1 + (cap - 1) exp(-lambda size / mean size))``, which stays
between 0 and ``cap`` copies.  Newton iterations solve the dual: every
iteration is a Spark aggregation, over the histogram of sizes by source, of
the constraint gap and its slope in whole numbers, so that reruns agree to
the last bit; a bracket around each multiplier guards the steps.

Rates are rounded into copies by running totals over each source in order of
size, so that rounding errors of neighbours cancel; a last step moves the
single copies that close most of a source's remaining gap.  Running totals go over
a bounded number of size bins of a source, over the salts of a bin, and over
the rows of one salt, whose number follows the row count: no source and no
size meets in one task.  What is collected or broadcast is a row for each
source (the multipliers of the dual).

Defined results: a null text has size 0; a null source is a source of its
own, after the others; repeated rows are documents of their own, told apart
by a running number; a document without words is taken once and counts nothing; an empty table gives no
rows; extra columns are ignored by :func:`mix` and carried by
:func:`mixed_documents`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import clear_prefix, durable, split_words, text_or_empty

CAP = 3
CYCLE = (1, 2, 3)
MAX_ITERATIONS = 80
TOLERANCE = 1e-7
# Rates and gaps are summed as whole numbers of these units.
UNIT = 1 << 20
# Rows of one source, size bin and salt are numbered in one task; about so many documents share a salt.
ROWS_PER_SALT = 50_000
MIN_SALTS = 16
# Repeated rows are numbered in chunks, which spread over tasks.
CHUNK = 4_096
# Size bins to an octave.
BINS = 8
FIXES = 2
MAX_TILT = 60.0


def targets(sizes: list[tuple[str | None, int]], cap: int = CAP, cycle: tuple[int, ...] = CYCLE) -> dict[str | None, float]:
    """Token targets: sources by code point (null last) weigh ``cycle`` in turn
    and share all tokens; a target stops at ``cap`` times its source, the
    excess is shared again by weight."""
    names = sorted(s for s, _ in sizes if s is not None) + [s for s, _ in sizes if s is None]
    size = dict(sizes)
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, open_, out = float(sum(size.values())), list(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > cap * size[s]]
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            out[s] = float(cap * size[s])
            left -= out[s]
            open_.remove(s)
    return out


def _rate(tilt, size, mean):
    x = F.least(F.greatest(tilt * size / mean, F.lit(-700.0)), F.lit(700.0))
    return F.lit(float(CAP)) / (F.lit(1.0) + F.lit(float(CAP - 1)) * F.exp(-x))


def solve(cells: DataFrame, goal: dict[str | None, float]) -> dict[str | None, float]:
    """Multiplier of every source.  ``cells``: source, size, n (documents of that size)."""
    spark = cells.sparkSession
    total = {r["source"]: (r["t"], r["n"]) for r in cells.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    mean = {s: t / n if t else 1.0 for s, (t, n) in total.items()}
    tilt, low, high = {}, {}, {}
    for s, (t, _) in total.items():
        if goal[s] >= CAP * t:
            tilt[s] = math.inf
        elif goal[s] <= 0:
            tilt[s] = -math.inf
        else:
            tilt[s], low[s], high[s] = 0.0, -math.inf, math.inf
    live = [s for s in tilt if math.isfinite(tilt[s])]
    for _ in range(MAX_ITERATIONS):
        if not live:
            break
        state = F.broadcast(spark.createDataFrame([(s, tilt[s], mean[s]) for s in live], "s string, tilt double, mean double"))
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"))
        gain = rate * (1 - rate / CAP) * F.col("size") / F.col("mean")
        whole = lambda c: F.sum(F.round(c * F.col("size") * UNIT).cast("decimal(20,0)") * F.col("n"))
        found = {r["source"]: r for r in cells.join(state, F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(
            whole(rate).alias("value"), whole(gain).alias("slope")).collect()}
        for s in list(live):
            gap = int(found[s]["value"]) / UNIT - goal[s]
            if abs(gap) <= TOLERANCE * max(1.0, goal[s]):
                live.remove(s)
                continue
            if gap > 0:
                high[s] = tilt[s]
            else:
                low[s] = tilt[s]
            slope = int(found[s]["slope"]) / UNIT
            step = tilt[s] - gap / slope if slope > 0 else math.nan
            step = min(max(step, tilt[s] - 4.0), tilt[s] + 4.0) if step == step else tilt[s] - math.copysign(4.0, gap)
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2
            if abs(step) > MAX_TILT or step == tilt[s]:
                live.remove(s)
            tilt[s] = min(max(step, -MAX_TILT), MAX_TILT)
    return {s: min(max(t, -MAX_TILT * 1e3), MAX_TILT * 1e3) if math.isfinite(t) else t for s, t in tilt.items()}


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of ``docs``."""
    return _copies(durable(_sized(docs))).drop("hash", "nr")


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, hash, size, nr: a row for each row of ``docs``; ``nr`` counts rows that repeat id, source and text from 0."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text_or_empty()).alias("hash"),
                       F.size(split_words(text_or_empty())).cast("long").alias("size"))
    key = ["doc_id", "source", "hash", "size"]
    n = F.col("n")
    upto = lambda last: F.sequence(F.lit(0).cast("long"), last)
    chunks = rows.groupBy(*key).agg(F.count("*").alias("n")) \
        .select(*key, "n", F.explode(upto(F.floor((n - 1) / CHUNK))).alias("chunk")).repartition("doc_id", "hash", "chunk")
    last = F.least(F.lit(CHUNK).cast("long"), n - F.col("chunk") * CHUNK) - 1
    return chunks.select(*key, F.explode(upto(last)).alias("at"), "chunk") \
        .select(*key, (F.col("chunk") * CHUNK + F.col("at")).alias("nr"))


def _same(*pairs: tuple[str, str]):
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _copies(sized: DataFrame) -> DataFrame:
    """``sized``: doc_id, source, hash, size, nr."""
    spark = sized.sparkSession
    cells = durable(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    by_source = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()
    goal = targets([(r["source"], r["t"]) for r in by_source])
    tilt = solve(cells, goal)
    plan = F.broadcast(spark.createDataFrame(
        [(r["source"], r["t"], goal[r["source"]], tilt[r["source"]], r["t"] / r["n"] if r["t"] else 1.0) for r in by_source],
        "s string, source_size long, target double, tilt double, mean double"))

    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("tilt") == F.lit(math.inf), F.lit(float(CAP))) \
        .when(F.col("tilt") == F.lit(-math.inf), F.lit(0.0)).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean")))
    salts = max(MIN_SALTS, sum(r["n"] for r in by_source) // ROWS_PER_SALT)
    rated = sized.join(plan, _same(("source", "s"))).drop("s") \
        .withColumn("rate", F.round(rate * UNIT).cast("long")) \
        .withColumn("bin", F.floor(F.log2(F.col("size") + 1) * BINS).cast("int")) \
        .withColumn("salt", F.pmod(F.pmod(F.xxhash64("doc_id", "hash"), F.lit(salts)) + F.col("nr"), F.lit(salts)).cast("int")).drop("tilt", "mean")

    def running(key: list[str], order, value: str):
        return F.sum(value).over(Window.partitionBy(*key).orderBy(order)) - F.col(value)

    by_salt = rated.groupBy("source", "bin", "salt").agg(F.sum("rate").alias("mass"))
    by_bin = by_salt.groupBy("source", "bin").agg(F.sum("mass").alias("bin_mass"))
    bins = by_bin.select(F.col("source").alias("_s"), F.col("bin").alias("_b"),
                         running(["source"], F.desc("bin"), "bin_mass").alias("bin_before"))
    salted = by_salt.select("source", "bin", "salt", running(["source", "bin"], F.asc("salt"), "mass").alias("salt_before"))
    starts = salted.join(bins, _same(("source", "_s")) & (F.col("bin") == F.col("_b"))).select(
        F.col("source").alias("_s"), F.col("bin").alias("_b"), F.col("salt").alias("_k"),
        (F.col("bin_before") + F.col("salt_before")).alias("before"))
    inside = Window.partitionBy("source", "bin", "salt").orderBy(F.desc("size"), "doc_id", "hash", "nr") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rated.withColumn("upto", F.sum("rate").over(inside))
    joined = numbered.join(starts, _same(("source", "_s")) & (F.col("bin") == F.col("_b")) & (F.col("salt") == F.col("_k")))
    upto = F.col("before") + F.col("upto") + UNIT // 2
    copies = F.floor(upto / UNIT) - F.floor((upto - F.col("rate")) / UNIT)
    out = joined.select("doc_id", "source", "hash", "nr", "size", "source_size", "target", copies.cast("long").alias("copies"))
    for _ in range(FIXES):
        out = _close_gap(durable(out))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def _close_gap(mixed: DataFrame) -> DataFrame:
    """One copy more, or less, of the document whose size is nearest to the gap of its source."""
    gaps = mixed.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    gap = F.broadcast(gaps.select(F.col("source").alias("_s"), "gap"))
    able = F.when(F.col("gap") > 0, F.col("copies") < CAP).otherwise(F.col("copies") > 0)
    miss = F.abs(F.abs("gap") - F.col("size"))
    near = mixed.join(gap, _same(("source", "_s"))).where(able & (miss < F.abs("gap")))
    pick = near.groupBy("source").agg(F.min_by(
        F.struct("doc_id", "hash", "nr", F.signum("gap").cast("long").alias("move")),
        F.struct(miss, F.col("doc_id").isNull(), "doc_id", "hash", "nr")).alias("p")) \
        .select(F.col("source").alias("_s"), F.col("p.doc_id").alias("_d"), F.col("p.hash").alias("_h"), F.col("p.nr").alias("_n"), "p.move")
    moved = mixed.join(F.broadcast(pick), _same(("source", "_s"), ("doc_id", "_d"), ("hash", "_h"), ("nr", "_n")), "left")
    return moved.withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("_s", "_d", "_h", "_n", "move")


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as many times as it has copies, columns
    as in ``docs``.  Equal rows (id, source, text) that differ in copies are numbered as in the plan."""
    p = clear_prefix(docs, "_tm")
    key = ["doc_id", "source", "hash"]
    copied = durable(_copies(durable(_sized(docs))))
    groups = durable(copied.groupBy(*key).agg(F.min("copies").cast("int").alias("times"), F.max("copies").cast("int").alias("most")))
    named = lambda df, *extra: df.select(*[F.col(c).alias(f"{p}_{c}") for c in (*key, *extra)])
    same = _same(("doc_id", f"{p}_doc_id"), (f"{p}_s", f"{p}_source"), (f"{p}_h", f"{p}_hash"))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns({f"{p}_s": F.col("source").cast("string"), f"{p}_h": F.xxhash64(text_or_empty())})

    def repeated(taken: DataFrame) -> DataFrame:
        return taken.select(*cols, F.explode(F.array_repeat(F.lit(0), F.col(f"{p}_times"))).alias(f"{p}_n")).select(*cols)

    out = repeated(keyed.join(named(groups.where((F.col("times") == F.col("most")) & (F.col("times") > 0)), "times"), same))
    mixed = groups.where(F.col("times") < F.col("most")).select(*key)
    if mixed.isEmpty():
        return out
    # A row's number: its place in its partition, after the rows of the partitions before it.
    part, place = F.col(f"{p}_part"), Window.partitionBy("doc_id", f"{p}_s", f"{p}_h", f"{p}_part").orderBy(f"{p}_part")
    rows = durable(keyed.join(named(mixed), same, "left_semi").withColumn(f"{p}_part", F.spark_partition_id()))
    counted = rows.groupBy("doc_id", f"{p}_s", f"{p}_h", f"{p}_part").agg(F.count("*").alias("n"))
    before = counted.select(F.col("doc_id").alias(f"{p}_doc_id"), F.col(f"{p}_s").alias(f"{p}_source"), F.col(f"{p}_h").alias(f"{p}_hash"),
                            part.alias(f"{p}_p"), (F.sum("n").over(Window.partitionBy("doc_id", f"{p}_s", f"{p}_h").orderBy(f"{p}_part"))
                                                   - F.col("n")).alias(f"{p}_before"))
    numbered = rows.withColumn(f"{p}_at", F.row_number().over(place) - 1) \
        .join(before, same & (part == F.col(f"{p}_p"))) \
        .select(*cols, f"{p}_s", f"{p}_h", (F.col(f"{p}_before") + F.col(f"{p}_at")).alias(f"{p}_number"))
    uneven = named(copied.join(mixed.select(*[F.col(c).alias(f"{p}_{c}") for c in key]), _same(*[(c, f"{p}_{c}") for c in key]), "left_semi")
                   .where(F.col("copies") > 0).withColumn("times", F.col("copies").cast("int")), "nr", "times")
    return out.unionByName(repeated(numbered.join(uneven, same & (F.col(f"{p}_number") == F.col(f"{p}_nr")))))
