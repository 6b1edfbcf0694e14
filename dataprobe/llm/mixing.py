"""Mixing sources to target weights by Pfair scheduling, with built-in functions only.

Documents of a source are put in a fixed, mixed order and cut into blocks.  A source of weight w gets block k
(from 0) the window [floor(k / w), ceil((k + 1) / w)): its release time and its deadline.  Each time slot takes the
released block with the earliest deadline (ties: the smaller source name).  One block is processed at a time and
weights add up to one, so earliest-deadline-first meets every deadline, and at any time every source is less than one
block away from its share.

A weight is a whole number over the sum of all, and windows are whole-number arithmetic on it, so no rounding adds up
over a long stream.  Default weights are powers of sizes in units of 1 / ``UNIT``.

Time is cut into segments that are scheduled apart from each other.  A segment is longer than the longest window, so a
block's window meets at most one border.  Which of the blocks that straddle a border T come before it is decided from
the border alone, earliest deadline first, as long as for every s < T the blocks that must run in [s, T) still fit in
T - s slots.  Some choice leaves every later block in time (the endless schedule makes one), what fits before the
border is a laminar matroid, and a greedy choice of a matroid has the most members among the first deadlines of any
length: so it leaves every later block in time, too.  All windows are then met inside each segment.

When a source runs out, its slots go to no one unless a released block can use them: no document is left out or
repeated.  A null source is a source of its own, named by null.  Null ids, null texts and repeated rows are documents
like others (rows that share id and text have an arbitrary order among them).  An empty table gives an empty result.
A segment's list grows with the ratio of the total to the smallest weight, a border's with the number of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.functions.draws import seeded_uniform
from dataprobe.llm.base import masked
from dataprobe.session import written

UNIT = 1 << 30
# slots of a segment; more where the smallest weight's windows are longer
SEGMENT = 4096
# blocks that one row lists before they become rows
_RUN = 4096
BLOCK_DOCS = 16
# a bucket of a source holds about this many documents
BUCKET_DOCS = 1024
SEED = 17


def _source_counts(docs: DataFrame, source: str) -> DataFrame:
    return docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("n"))


def _power_weights(counts: DataFrame, power: float) -> DataFrame:
    return counts.select("source", F.greatest(F.round(F.pow(F.col("n").cast("double"), F.lit(power)) * UNIT), F.lit(1.0)).cast("bigint").alias("slots"))


def size_weights(docs: DataFrame, source: str = "source", power: float = 0.5) -> DataFrame:
    """(source, slots): weights proportional to a power of the source's documents, as whole numbers."""
    return _power_weights(_source_counts(docs, source), power)


def _whole(x: Column) -> Column:
    return x.cast("decimal(18,0)")


def _release(k: Column, q: Column, p: Column) -> Column:
    """floor(k p / q)."""
    return F.call_function("div", k.cast("decimal(20,0)") * _whole(p), _whole(q))


def _deadline(k: Column, q: Column, p: Column) -> Column:
    """ceil((k + 1) p / q)."""
    return F.call_function("div", (k + 1).cast("decimal(20,0)") * _whole(p) + _whole(q) - F.lit(1), _whole(q))


def _borders(sources: DataFrame, segment: int, last: int) -> DataFrame:
    """(border, name, none): the sources whose straddling block comes before the border ``segment * border``."""
    listed = sources.agg(F.collect_list(F.struct("q", "name", "none")).alias("s"), F.max("p").alias("p"))
    t, p = F.col("t"), F.col("p")
    at = sources.sparkSession.range(1, last).select(F.col("id").alias("border"), (F.col("id") * segment).alias("t")).crossJoin(F.broadcast(listed))
    # blocks that are due at t, and those that a source has begun to be owed
    low = lambda q, when: F.call_function("div", _whole(q) * when.cast("decimal(20,0)"), _whole(p))
    high = lambda q, when: F.call_function("div", _whole(q) * when.cast("decimal(20,0)") + _whole(p) - F.lit(1), _whole(p))
    due = at.withColumn("due", F.transform("s", lambda x: F.struct(x["q"].alias("q"), low(x["q"], t).alias("low"), high(x["q"], t).alias("high"), x["name"].alias("name"), x["none"].alias("none"))))
    open_ = F.transform(
        F.filter("due", lambda x: x["low"] < x["high"]),
        lambda x: F.struct(_deadline(x["low"], x["q"], p).alias("deadline"), x["name"].alias("name"), x["none"].alias("none"), _release(x["low"], x["q"], p).alias("release")),
    )
    total = lambda array, of: F.aggregate(array, F.lit(0).cast("bigint"), lambda acc, x: acc + of(x))
    known = due.select("border", "t", "p", "due", F.array_sort(open_).alias("open"), (t - total("due", lambda x: x["low"])).alias("left"))
    rooms = F.transform(
        F.array_distinct(F.transform("open", lambda x: x["release"])),
        lambda s: F.struct(s.alias("s"), (t - s - total("due", lambda x: F.greatest(F.lit(0).cast("bigint"), x["low"] - high(x["q"], s)))).alias("room")),
    )
    state = F.struct(F.col("rooms"), F.col("left"), F.array().cast("array<struct<name:string,none:boolean>>").alias("picked"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["left"] > 0) & ~F.exists(acc["rooms"], lambda r: (r["s"] <= x["release"]) & (r["room"] <= 0))
        taken = F.struct(
            F.transform(acc["rooms"], lambda r: F.struct(r["s"].alias("s"), F.when(r["s"] <= x["release"], r["room"] - 1).otherwise(r["room"]).alias("room"))).alias("rooms"),
            (acc["left"] - 1).alias("left"),
            F.concat(acc["picked"], F.array(F.struct(x["name"].alias("name"), x["none"].alias("none")))).alias("picked"),
        )
        return F.when(fits, taken).otherwise(acc)

    chosen = known.withColumn("rooms", rooms).select("border", F.explode(F.aggregate("open", state, step, lambda acc: acc["picked"])).alias("x"))
    return chosen.select("border", "x.name", "x.none")


def block_schedule(blocks: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(source, turn, slot, release, deadline): the slot of every block, for ``blocks(source, slots, blocks)`` with one
    row per source, its whole-number weight and how many blocks it has."""
    live = blocks.filter("slots > 0")
    named = live.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"), F.col("source").isNull().alias("none"), F.col("slots").cast("bigint").alias("q"), F.col("blocks").cast("bigint").alias("blocks"))
    whole = F.broadcast(named.agg(F.coalesce(_whole(F.sum(F.col("q").cast("decimal(18,0)"))), F.lit(0).cast("decimal(18,0)")).alias("p")))
    sources = written(named.crossJoin(whole), "sources")  # one row of totals
    # driver: one row
    longest, end = sources.agg(F.max(_deadline(F.lit(0), F.col("q"), F.col("p"))), F.max(_deadline(F.col("blocks") - 1, F.col("q"), F.col("p")))).first()
    segment = max(segment, (longest or 0) + 2)
    last = -(-(end or 0) // segment)
    q, p, k = F.col("q"), F.col("p"), F.col("turn")
    runs = sources.filter("blocks > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1, F.lit(_RUN).cast("bigint"))).alias("from")).repartition("name", "none", "from")
    jobs = runs.select("name", "none", "q", "p", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + _RUN, F.col("blocks")) - 1)).alias("turn"))
    jobs = jobs.select("name", "none", "turn", _release(k, q, p).alias("release"), _deadline(k, q, p).alias("deadline"))
    jobs = jobs.withColumn("first", F.call_function("div", F.col("release"), F.lit(segment))).withColumn("border", F.call_function("div", F.col("deadline") - 1, F.lit(segment)))
    if last > 1:
        chosen = _borders(sources, segment, last).withColumn("before", F.lit(True))
        jobs = jobs.join(chosen, ["border", "name", "none"], "left")
    else:
        jobs = jobs.withColumn("before", F.lit(None).cast("boolean"))
    jobs = jobs.withColumn("part", F.when((F.col("first") < F.col("border")) & F.col("before"), F.col("first")).otherwise(F.col("border")))
    start = F.col("part") * segment
    clipped = jobs.select(
        "part", F.greatest("release", start).alias("from"),
        F.struct(F.least("deadline", start + segment).alias("by"), "name", "none", "turn", "release", "deadline").alias("job"),
    )
    # released together, then in order of release: until the next release, the earliest deadlines run
    waves = clipped.groupBy("part", "from").agg(F.collect_list("job").alias("jobs")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("from", "jobs"))).alias("w"))
    waves = waves.select("part", F.transform("w", lambda x, i: F.struct(x["from"].alias("from"), F.coalesce(F.get("w", i + 1)["from"], (F.col("part") + 1) * segment).alias("to"), x["jobs"].alias("jobs"))).alias("w"))
    job = "struct<by:bigint,name:string,none:boolean,turn:bigint,release:bigint,deadline:bigint>"
    zero = F.struct(F.array().cast(f"array<{job}>").alias("ready"), F.array().cast(f"array<struct<slot:bigint,job:{job}>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ready = F.array_sort(F.concat(acc["ready"], x["jobs"]))
        room = (x["to"] - x["from"]).cast("int")
        run = F.transform(F.slice(ready, F.lit(1), room), lambda j, i: F.struct((x["from"] + i).alias("slot"), j.alias("job")))
        return F.struct(F.slice(ready, room + 1, F.size(ready) + 1).alias("ready"), F.concat(acc["out"], run).alias("out"))

    ran = waves.select(F.explode(F.aggregate("w", zero, step, lambda acc: acc["out"])).alias("x"))
    return ran.select(F.when(~F.col("x.job.none"), F.col("x.job.name")).alias("source"), "x.job.turn", "x.slot", "x.job.release", "x.job.deadline")


def period_schedule(weights: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``block_schedule`` of as many blocks as each source's slots: a period, after which whole-number shares repeat."""
    return block_schedule(weights.select("source", "slots", F.col("slots").alias("blocks")), segment)


def source_ranks(docs: DataFrame, source: str, id_col: str, text: str, seed: int = SEED) -> DataFrame:
    """``docs`` with ``_rank``, the place of a row in its source's mixed order, from 0.

    Order: a keyed draw, then the id.  The range of draws is cut into buckets; counts of (source, bucket) give each
    bucket its offset, rows are ranked inside a bucket only, and the number of buckets follows the number of rows.
    """
    total = docs.count()
    buckets = max(1, total // BUCKET_DOCS)
    # rows without an id draw by their text
    named = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text:"), F.col(f"`{text}`").cast("string")))
    drawn = docs.withColumn("_draw", seeded_uniform(seed, named)).withColumn("_bucket", F.floor(F.col("_draw") * buckets))
    counts = drawn.groupBy(F.col(f"`{source}`").alias("_s"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_s", "_b", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy(F.col(f"`{source}`"), "_bucket").orderBy("_draw", F.col(f"`{id_col}`"))
    placed = drawn.withColumn("_in", F.row_number().over(inside) - 1)
    on = F.col(f"`{source}`").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))
    return placed.join(offsets, on).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_draw", "_bucket", "_s", "_b", "_before", "_in")


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", id_col: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, keep: list[str] | None = None, segment: int = SEGMENT) -> DataFrame:
    """``keep`` columns of every document with its block and time: (mix_block, mix_slot, mix_release, mix_deadline,
    mix_place).  Sorting by (mix_slot, mix_place) gives the mixed stream; ``mix_place`` counts within the block.

    Without ``weights(source, slots)`` they follow the square root of the sources' sizes.  A source that the weights
    do not name, or name with no slot, is left out of the mixture: that is what its weight says.
    """
    added = ["mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_place"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    docs, own = masked(docs)
    source, id_col, text, keep = own[source], own[id_col], own[text], {own[c]: c for c in keep}
    counts = written(_source_counts(docs, source), "sizes")
    weights = _power_weights(counts, 0.5) if weights is None else weights.select("source", "slots")
    there = counts.withColumnRenamed("source", "_there")
    # weights of sources without documents still take their share of the time
    sized = weights.join(there, F.col("source").eqNullSafe(F.col("_there")), "left").select("source", "slots", F.ceil(F.coalesce(F.col("n"), F.lit(0)) / F.lit(block_docs)).alias("blocks"))
    clock = written(block_schedule(sized, segment), "schedule")
    need = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, source, id_col, text])])
    # texts take part in the draw by their hash alone and are not carried through the ranking unless asked for
    slim = need.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, source, id_col])], F.xxhash64(F.col(f"`{text}`")).alias("_key"))
    ranked = source_ranks(slim, source, id_col, "_key")
    block = F.call_function("div", F.col("_rank"), F.lit(block_docs))
    timed = ranked.withColumn("mix_block", block).withColumn("mix_place", (F.col("_rank") - F.col("mix_block") * block_docs).cast("int"))
    c = clock.select(*[F.col(n).alias(f"_{n}") for n in ("source", "turn", "slot", "release", "deadline")])
    # written, so its size is known to the planner; many rows meet it by (source, block), over which a hot source spreads
    out = timed.join(c, F.col(f"`{source}`").eqNullSafe(F.col("_source")) & (F.col("mix_block") == F.col("_turn")))
    return out.select(
        *[F.col(k).alias(c) for k, c in keep.items()], "mix_block", F.col("_slot").alias("mix_slot"), F.col("_release").alias("mix_release"),
        F.col("_deadline").alias("mix_deadline"), "mix_place",
    )
