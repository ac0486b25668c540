"""Aggregations, pages and windows over a selection of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.folds import newest

SECOND_US = 1_000_000
GROUPABLE = ["event_type", "category", "actor_id", "target_id", "severity", "source", "outcome", "parser"]


def bounds(events: DataFrame) -> DataFrame:
    return events.agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def group_counts(events: DataFrame, field: str, limit: int = 50) -> DataFrame:
    if field not in GROUPABLE:
        raise ValueError(f"cannot group by {field}; one of {GROUPABLE}")
    counted = events.groupBy(F.col(field).alias("key")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.asc("key")).limit(limit)


def histogram(events: DataFrame, buckets: int = 60) -> DataFrame:
    """Counts in equal-width buckets; empty buckets are present, a boundary event falls into the later one.

    The width needs the bounds of the selection: they are a one-row scalar subquery, so the events are aggregated
    per bucket without a shuffle of rows.
    """
    b = events.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(SECOND_US))
    width = F.greatest(F.ceil(span / F.lit(max(buckets, 1))).cast("long"), F.lit(SECOND_US))
    plan = b.where("lo IS NOT NULL").select("lo", width.alias("width"), span.alias("span"))
    filled = plan.select(
        "lo", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("span div width"))).alias("bucket")
    )
    lo, w = plan.select("lo").scalar(), plan.select("width").scalar()
    counted = (
        events.select("us").withColumn("lo", lo).withColumn("width", w)
        .select(F.expr("(us - lo) div width").alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("n"))
    )
    return filled.join(counted, "bucket", "left").select(
        "bucket", (F.col("lo") + F.col("bucket") * F.col("width")).alias("start_us"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def object_counts(involvement: DataFrame, selected_ids: DataFrame | None = None, limit: int | None = 2000) -> DataFrame:
    eo = involvement if selected_ids is None else involvement.join(selected_ids, "event_id", "left_semi")
    # one row per (object, event) first: the distinct combines map-side and its key never gets hot
    per = eo.select("object_id", "event_id").distinct().groupBy("object_id").agg(F.count("*").alias("n"))
    return per if limit is None else per.orderBy(F.desc("n"), "object_id").limit(limit)


def object_activity(involvement: DataFrame) -> DataFrame:
    per_event = involvement.groupBy("object_id", "event_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return per_event.groupBy("object_id").agg(
        F.min("a").alias("first_us"), F.max("b").alias("last_us"), F.count("*").alias("n")
    )


def page(
    events: DataFrame, limit: int = 100, cursor: tuple[int, str] | None = None, descending: bool = False
) -> DataFrame:
    """One keyset page in (time, id) order plus ``more`` on every row; plans as TakeOrderedAndProject."""
    out = events
    if cursor is not None:
        us, ident = cursor
        c = F.col
        beyond = (
            (c("us") < us) | ((c("us") == us) & (c("id") < ident))
            if descending
            else (c("us") > us) | ((c("us") == us) & (c("id") > ident))
        )
        out = out.where(beyond)
    order = [F.desc("us"), F.desc("id")] if descending else [F.asc("us"), F.asc("id")]
    taken = out.orderBy(*order).limit(limit + 1)
    # at most limit+1 rows remain, so the global row number is bounded by the page size
    n = F.row_number().over(Window.orderBy(*order))
    total = F.count("*").over(Window.partitionBy(F.lit(1)))
    return (
        taken.withColumn("position", n).withColumn("more", total > limit).where(F.col("position") <= limit)
    )


def max_window(events: DataFrame, keys: list[str], window_us: int, id_col: str = "id") -> DataFrame:
    """Per key the largest number of events inside any sliding window, earliest window first.

    A window that ends at t looks back ``window_us``. Time is cut into blocks of that length. An instant adds its events from its time on; in the
    next block they count from the start and leave just after their window has passed. So the number inside a window is a running sum of one block:
    no frame is ever computed anew, and a busy key is spread over its blocks. First and last events are looked up for the best window only.
    """
    at = F.col("us")
    own = F.expr(f"(us - pmod(us, {window_us}L)) div {window_us}L")
    steps = F.array(
        F.struct(own.alias("block"), at.alias("us"), F.lit(1).alias("step"), F.lit(1).alias("own")),
        F.struct((own + 1).alias("block"), ((own + 1) * window_us).alias("us"), F.lit(1).alias("step"), F.lit(0).alias("own")),
        F.struct((own + 1).alias("block"), (at + window_us + 1).alias("us"), F.lit(-1).alias("step"), F.lit(0).alias("own")),
    )
    counted = (
        events.where(at.isNotNull()).select(*keys, F.explode(steps).alias("s")).select(*keys, "s.*").where(F.col("us") < (F.col("block") + 1) * window_us)
        .groupBy(*keys, "block", "us").agg(F.sum("step").alias("step"), F.max("own").alias("own"))
    )
    running = Window.partitionBy(*keys, "block").orderBy("us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counted.withColumn("n", F.sum("step").over(running)).where("own = 1")
    best = ends.groupBy(*keys).agg(F.max_by(F.struct("n", F.col("us").alias("end_us")), F.struct(F.col("n"), -F.col("us"))).alias("b")).select(*keys, "b.*")
    best = best.select(*(F.col(k).alias(f"best_{k}") for k in keys), "n", "end_us")
    same = [F.col(k).eqNullSafe(F.col(f"best_{k}")) for k in keys]
    rows = events.select(*keys, "us", F.col(id_col).alias("id"))
    inside = rows.join(best, [*same, F.col("us").between(F.col("end_us") - window_us, F.col("end_us"))])
    return inside.groupBy(*keys, "n", "end_us").agg(
        F.min("us").alias("start_us"), F.min(F.struct("us", "id"))["id"].alias("first_id"), F.max(F.when(F.col("us") == F.col("end_us"), F.col("id"))).alias("last_id"),
    ).select(*keys, "n", "start_us", "end_us", "first_id", "last_id")


def latest_before(rows: DataFrame, facts: DataFrame, keys: list[str], value: list[str], within_us: int) -> DataFrame:
    """``rows`` (keys, us, ...) with a struct ``latest`` (us and ``value``) of the newest fact of the same keys at most ``within_us`` before; others are left out.

    Both sides are read once and go into blocks of time together. A block starts from the newest fact of the block before, so no row meets more than the
    one fact that is carried along, and a busy key is spread over its blocks. Of facts at one instant the greatest value counts.
    """
    block = F.expr(f"(us - pmod(us, {within_us}L)) div {within_us}L").alias("block")
    fact = facts.select(*keys, block, "us", F.struct("us", *value).alias("fact"))
    carried = fact.groupBy(*keys, (F.col("block") + 1).alias("block")).agg(F.max("fact").alias("fact")).withColumn("us", F.col("block") * within_us)
    own = rows.select(*keys, block, "us", F.lit(1).alias("side"), F.struct(*rows.columns).alias("own"))
    side = F.lit(0).alias("side")
    both = fact.select(*keys, "block", "us", side, "fact").unionByName(carried.select(*keys, "block", "us", side, "fact")).unionByName(own, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "block").orderBy("us", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("latest", F.max("fact").over(so_far)).where(f"side = 1 AND latest.us >= us - {within_us}")
    return found.select("own.*", "latest")


def bucket_median_with_zeros(events: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """Median number of events per bucket between the first and last bucket of a key, empty buckets counted as 0."""
    b = F.expr(f"us div {width_us}")
    counts = events.groupBy(*keys, b.alias("b")).agg(F.count("*").alias("c"))
    # how many buckets have each count: a small distribution per key instead of its buckets
    dist = counts.groupBy(*keys, "c").agg(F.count("*").alias("f"))
    span = counts.groupBy(*keys).agg((F.max("b") - F.min("b") + 1 - F.count("*")).alias("f")).where("f > 0")
    both = dist.unionByName(span.withColumn("c", F.lit(0).cast("long")))
    return both.groupBy(*keys).agg(F.percentile("c", 0.5, F.col("f")).alias("median"))


def order_statistic(values: DataFrame, keys: list[str], column: str, fraction: float) -> DataFrame:
    """``sorted(values)[min(n-1, int(fraction*n))]`` per key.

    Rows are counted per value, then per range of values; only the range that holds the index is opened, so no
    task sorts a whole key.
    """
    per_value = values.groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("f"))
    # power-of-two ranges: at most 64 per key
    per_value = per_value.withColumn("r", F.when(F.col("v") > 0, F.floor(F.log2(F.col("v").cast("double")))).otherwise(-1))
    ranges = per_value.groupBy(*keys, "r").agg(F.sum("f").alias("rf"))
    wr = Window.partitionBy(*keys)
    cum = wr.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = (
        ranges.withColumn("total", F.sum("rf").over(wr)).withColumn("upto", F.sum("rf").over(cum))
        .withColumn("ix", F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(fraction)).cast("long")))
        .where("upto > ix AND upto - rf <= ix").select(*keys, "r", (F.col("upto") - F.col("rf")).alias("below"), "ix")
    )
    # inside the range: split again into 256 equal steps, then the exact values of one step
    opened = per_value.join(located, [*keys, "r"])
    lo, step = F.pow(F.lit(2.0), F.col("r")), F.greatest(F.pow(F.lit(2.0), F.col("r")) / 256, F.lit(1.0))
    opened = opened.withColumn("s", F.when(F.col("r") < 0, F.lit(0)).otherwise(F.floor((F.col("v") - lo) / step)))
    steps = opened.groupBy(*keys, "r", "s", "below", "ix").agg(F.sum("f").alias("sf"))
    cum_s = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step_hit = (
        steps.withColumn("upto", F.col("below") + F.sum("sf").over(cum_s))
        .where("upto > ix AND upto - sf <= ix").select(*keys, "s", (F.col("upto") - F.col("sf")).alias("base"))
    )
    inner = opened.join(step_hit, [*keys, "s"])
    cum_v = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        inner.withColumn("upto", F.col("base") + F.sum("f").over(cum_v))
        .where("upto > ix AND upto - f <= ix").select(*keys, F.col("v").alias(column))
    )


def latest_state(events: DataFrame, keys: list[str], state: list[str], at_us: int | None = None) -> DataFrame:
    """The last event of each key at an instant decides its state."""
    seen = events if at_us is None else events.where(F.col("us") <= at_us)
    last = newest(F.struct(*state), F.col("us"), F.col("id"))
    return seen.groupBy(*keys).agg(last.alias("s")).select(*keys, "s.*")


def collapse_runs(
    steps: DataFrame, keys: list[str], same: list[str], block_us: int = 3_600_000_000
) -> DataFrame:
    """Consecutive steps of a key with equal ``same`` columns become one row with a count.

    Runs are found inside time blocks first. Only the first and the last run of a block can touch another block,
    so the second pass orders at most two rows per block of a key; everything between is already final.
    """
    w = Window.partitionBy(*keys, "block").orderBy("us", "id")
    inner = (
        steps.withColumn("block", F.expr(f"us div {block_us}")).withColumn("v", F.struct(*same))
        .withColumn("new", F.coalesce((F.lag("v").over(w) != F.col("v")).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("new").over(w))
        .groupBy(*keys, "block", "run")
        .agg(F.any_value("v").alias("v"), F.count("*").alias("c"), F.min("us").alias("a"), F.max("us").alias("b"))
        .withColumn("last_run", F.max("run").over(Window.partitionBy(*keys, "block")))
    )
    middle = inner.where("run > 1 AND run < last_run").select(*keys, "v", "c", "a", "b")
    wk = Window.partitionBy(*keys).orderBy("block", "run")
    edge = inner.where("run = 1 OR run = last_run")
    touches = (F.lag("block").over(wk) != F.col("block")) & (F.lag("v").over(wk) == F.col("v"))
    joined = (
        edge.withColumn("new", F.when(touches, 0).otherwise(1))
        .withColumn("island", F.sum("new").over(wk))
        .groupBy(*keys, "island")
        .agg(F.any_value("v").alias("v"), F.sum("c").alias("c"), F.min("a").alias("a"), F.max("b").alias("b"))
        .drop("island")
    )
    return middle.unionByName(joined).select(
        *keys, *[F.col("v")[s].alias(s) for s in same], F.col("c").alias("n"), F.col("a").alias("start_us"),
        F.col("b").alias("end_us"),
    )


def first_n_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; plans as WindowGroupLimit, which cuts before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def first_seen_source(
    signins: DataFrame, key: str = "actor_id", source: str = "src_ip", min_earlier: int = 3
) -> DataFrame:
    """First use of a source by a key that had at least ``min_earlier`` events before it.

    Only the first event per (key, source) can qualify. How many events came before is a sum of per-block counts
    plus the count inside the event's own block, so the events of a hot key are never ordered in one task.
    """
    day_us = 86_400_000_000
    block = F.expr(f"us div {day_us}")
    firsts = (
        signins.groupBy(key, source).agg(F.min(F.struct("us", "id")).alias("f"))
        .select(key, source, F.col("f.us").alias("us"), F.col("f.id").alias("id")).withColumn("block", block)
    )
    per_block = signins.groupBy(key, block.alias("block")).agg(F.count("*").alias("c"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.withColumn("earlier_blocks", F.coalesce(F.sum("c").over(before), F.lit(0)))
    ranked = signins.select(key, "us", "id", block.alias("block")).withColumn(
        "rank_in_block", F.row_number().over(Window.partitionBy(key, "block").orderBy("us", "id"))
    )
    return (
        firsts.join(ranked.drop("us"), [key, "block", "id"]).join(per_block.drop("c"), [key, "block"])
        .withColumn("earlier", F.col("earlier_blocks") + F.col("rank_in_block") - 1)
        .where(F.col("earlier") >= min_earlier)
        .select(key, source, "id", "us", F.col("earlier").cast("long").alias("earlier"))
    )


def with_involvement(events: DataFrame, involvement: DataFrame, incidents: DataFrame) -> DataFrame:
    """Attach the involved objects (by role, id) and incidents to each event of a page.

    Meant for pages: the events side is small and a semi join cuts both bridges before they are grouped.
    """
    ids = events.select(F.col("id").alias("event_id"))
    objects = (
        involvement.join(ids, "event_id", "left_semi").groupBy("event_id")
        .agg(F.array_sort(F.collect_set(F.struct("role", "object_id"))).alias("objects"))
    )
    member = (
        incidents.join(ids, "event_id", "left_semi").groupBy("event_id")
        .agg(F.array_sort(F.collect_set("incident_id")).alias("incidents"))
    )
    return (
        events.join(objects.withColumnRenamed("event_id", "id"), "id", "left")
        .join(member.withColumnRenamed("event_id", "id"), "id", "left")
    )


def timeline(events: DataFrame, involvement: DataFrame, incidents: DataFrame, limit: int = 100,
             cursor: tuple[int, str] | None = None, group_by: str = "event_type", buckets: int = 60) -> dict[str, DataFrame]:
    """The parts of a timeline answer over one selection; each is lazy and shares the same scan predicates."""
    return {
        "page": with_involvement(page(events, limit, cursor), involvement, incidents),
        "total": events.agg(F.count("*").alias("n")),
        "bounds": bounds(events),
        "groups": group_counts(events, group_by),
        "histogram": histogram(events, buckets),
    }
