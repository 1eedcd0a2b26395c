"""Mixing sources to target weights under a curriculum that varies over training time.

1. A document's size is its number of words. Sizes are summed by source.
2. Targets: every source's weight share of the demand, capped at ``repeat_cap`` times what the source
   has; the excess of capped sources is reshared by weight among the rest (water filling, solved in
   closed form by sorting sources by cap/weight).
3. Each source is a queue in the order of a hash of the document. A source with target T and size S
   is read T // S times in whole, then up to T modulo S words: a document's ``taken`` follows from its
   cumulative size alone, so rounding loses less than one word in a source.
4. Each source has a schedule: a piecewise linear weight over training time from 0 to 1. Its integral
   is the cumulative demand; inverting it at the words that a source has given before a use of a document gives
   that use's training position, so a source that is read twice gives its second round in the rest of its time and
   reaches time 1 with its last word. Sorting by range of position lays the uses out in training order.

Cumulative sizes are exact and distributed: queues are cut into hash buckets, sums of buckets (not of
rows) are accumulated by source, and distinct documents only within their bucket. A source that holds a third of all
rows is spread over all its buckets. Rows that repeat one document stand one after the other, so each needs but its number among them, whatever their
count; which row gets which number does not show.

Everything is built-in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import WORD, lookup_join, spool, told_join

#: Weights by rank of the source (repeating), demand over all sizes, cap over a source's size.
WEIGHTS, DEMAND, REPEAT_CAP = (3.0, 1.0, 2.0), 1.5, 2.0
#: Schedules by rank of the source (repeating): knots (time, relative weight). The first leads early,
#: the second is even, the third comes in late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))
#: Hex digits of the queue hash that name a bucket, 3 are 4,096 buckets for each source; digits of a position.
BUCKET_DIGITS, DIGITS = 3, 6
#: Sources up to which windows over all sources run in one task; more are dealt out by range.
ONE_TASK = 200_000


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, ``mark`` (hash of the text), ``same`` (equal for repeated rows), ``nr`` and the columns ``carry``; the only pass over the texts.
    Written once, so that rows keep their numbers."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("nr"), *carry)
    return spool(rows.withColumn("same", F.xxhash64("doc_id", "source", "mark", "size")), "sizes")


def queued(rows: DataFrame) -> DataFrame:
    """A row for each distinct document of ``rows``: same, copies, source, the bucket of its queue, and ``earlier``, the words that stand before it there."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.md5(F.concat_ws("|", id_text, F.when(F.col("doc_id").isNull(), F.col("mark").cast("string"))).cast("binary"))
    groups = rows.groupBy("source", "doc_id", "size", "mark", "same").agg(F.count("*").alias("copies")).withColumn("h", h).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    before = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    held = F.col("size") * F.col("copies")
    return spool(groups.select("same", "copies", "source", "bucket", held.alias("held"), F.coalesce(F.sum(held).over(before), F.lit(0)).alias("earlier")), "queues")


def numbered(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``earlier`` and ``bucket`` of their documents and ``turn``, a number from 0 among the rows of one document. Rows of a document that
    has more than common.HUB are numbered inside their input partitions, after those of earlier ones."""
    found = told_join(rows, groups.select("same", "bucket", "earlier", "copies", F.col("copies").alias("n")), "same", "n")
    own = Window.partitionBy("same").orderBy("nr")
    out = found.where(F.col("copies") <= common.HUB).withColumn("turn", (F.row_number().over(own) - 1).cast("long"))
    if groups.where(F.col("copies") > common.HUB).isEmpty():
        return out
    many = found.where(F.col("copies") > common.HUB).withColumn("part", F.shiftright("nr", 33)).withColumn("at", F.xxhash64("same", "part"))
    before = Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = many.groupBy("same", "part", "at").agg(F.count("*").alias("k"))
    starts = spool(counts.select("at", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start")), "starts")
    inside = Window.partitionBy("same", "part").orderBy("nr")
    many = lookup_join(many.withColumn("in_part", F.row_number().over(inside) - 1), starts, "at", "inner")
    return out.unionByName(many.withColumn("turn", F.col("start") + F.col("in_part")).drop("part", "at", "start", "in_part"))


def ranked(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df``, a spooled table, with ``nr`` (from 0, in this order) and for each entry of ``sums`` (new name: column) the sum of that column over
    all earlier rows. A large table is dealt out by range; only sums of parts are then accumulated in one task."""
    whole = Window.orderBy(*order)
    if df.count() <= ONE_TASK:
        before = whole.rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", (F.row_number().over(whole) - 1).cast("long").alias("nr"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for name, c in sums.items()])
    dealt = spool(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    parts = spool(parts.select("__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ["__n", *[f"__{name}" for name in sums]]]), "parts")
    inside = Window.partitionBy("__part").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = lookup_join(dealt, parts, "__part", "inner")
    return out.select(*df.columns, (F.col("__n") + F.row_number().over(inside) - 1).alias("nr"), *[(F.col(f"__{name}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(name) for name, c in sums.items()])


def source_targets(sums: DataFrame, weights: tuple[float, ...] = WEIGHTS, demand: float = DEMAND, repeat_cap: float = REPEAT_CAP) -> DataFrame:
    """(source, source_size) -> with rank, weight and target; a row for each source."""
    by_name = ranked(spool(sums, "sources"), [F.col("source").asc_nulls_last()], {}).withColumnRenamed("nr", "rank")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    by_name = by_name.withColumn("weight", w).withColumn("cap", repeat_cap * F.col("source_size"))
    filled = spool(ranked(spool(by_name.withColumn("ratio", F.col("cap") / F.col("weight")), "weighted"), [F.col("ratio"), F.col("rank")], {"caps": "cap", "weights": "weight"}), "filled")
    total, weight = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (F.lit(demand * total) - F.col("caps")) / (F.lit(weight) - F.col("weights"))
    # The first source, in this order, that its share does not fill sets the level for all after it.
    first = filled.withColumn("level", level).where("level <= ratio").agg(F.min(F.struct("nr", "level"))).first()[0]
    target = F.col("cap") if first is None else F.least("cap", F.lit(first["level"]) * F.col("weight"))
    return filled.select("source", "source_size", "rank", "weight", target.alias("target"))


def segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(start time, weight there, slope, integral so far, integral at its end) for each piece, integrals scaled to 1."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots):
        raise ValueError("a schedule's times rise from 0 to 1 and its weights are not negative")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, so_far, out = sum(areas), 0.0, []
    if total <= 0:
        raise ValueError("a schedule needs weight somewhere")
    for (a, b), area in zip(zip(knots, knots[1:]), areas):
        out.append((a[0], a[1] / total, (b[1] - a[1]) / (b[0] - a[0]) / total, so_far, so_far + area / total))
        so_far += area / total
    return out


def position_of(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source's cumulative demand reaches ``share`` (0 to 1) of its target."""
    position = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        pieces = segments(knots)
        at = F.lit(None).cast("double")
        for n, (t, w, slope, start, end) in reversed(list(enumerate(pieces))):
            y = F.greatest(share - F.lit(start), F.lit(0.0))
            root = F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * y, F.lit(0.0)))
            here = F.lit(t) + F.when(root > 0, F.lit(2.0) * y / root).otherwise(F.lit(0.0))
            at = here if n == len(pieces) - 1 else F.when(share <= F.lit(end), here).otherwise(at)
        position = F.when(rank % len(schedules) == k, at).otherwise(position)
    return F.round(F.least(position, F.lit(1.0)), DIGITS)


def mix(docs: DataFrame, weights=WEIGHTS, demand: float = DEMAND, repeat_cap: float = REPEAT_CAP, schedules=SCHEDULES, in_order: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Plan the mix of ``docs(doc_id, source, text)``: doc_id, source, size, source_size, target, taken, positions.

    ``taken`` is the number of words the mix takes of the document, repeats counted: a whole multiple
    of its size, and a prefix of one document in each source. ``positions`` are the training times (0 to
    1) of its uses, the cut one included; empty where nothing is taken. ``in_order`` lays rows out by the first of them.

    Null text has size 0 and null source is a source, ranked last. Documents without words take 0.
    Repeated rows are separate documents; which of two equal rows is read first does not show. Order
    depends on ids, sizes and texts alone, so reruns agree, however the input is dealt. An empty table gives an empty result; if nothing
    has words, all targets are 0. Columns named in ``carry`` come along, the others are ignored.
    """
    rows = sized(docs, carry)
    groups = queued(rows)
    buckets = spool(groups.groupBy("source", "bucket").agg(F.sum("held").alias("held")), "buckets")
    sums = buckets.groupBy("source").agg(F.sum("held").alias("source_size"))
    targets = source_targets(sums, weights, demand, repeat_cap)
    queue = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("before", F.coalesce(F.sum("held").over(queue), F.lit(0)))
    plan = starts.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "held")
    plan = plan.select(F.col("source").alias("of"), F.col("bucket").alias("in"), "before", "source_size", "rank", "target")

    placed = numbered(rows, groups).withColumn("earlier", F.col("earlier") + F.col("turn") * F.col("size"))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    placed = placed.withColumn("at", F.col("before") + F.col("earlier")).withColumn("goal", F.floor("target"))
    placed = placed.withColumn("rounds", F.floor(F.col("goal") / F.greatest("source_size", F.lit(1))).cast("long"))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("rounds") * F.col("source_size") - F.col("at")))
    placed = placed.withColumn("taken", (F.col("rounds") * F.col("size") + cut).cast("long")).withColumn("uses", F.when(F.col("size") > 0, F.col("rounds") + (cut > 0).cast("int")).otherwise(0))
    share = lambda turn: (turn * F.col("source_size") + F.col("at")) / F.greatest(F.col("target"), F.lit(1.0))
    positions = F.when(F.col("uses") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1), lambda turn: position_of(share(turn), F.col("rank"), schedules)))
    out = placed.select("doc_id", "source", "size", "source_size", "target", "taken", F.coalesce(positions, F.array().cast("array<double>")).alias("positions"), *carry)
    if in_order:
        first = F.try_element_at("positions", F.lit(1)).asc_nulls_last()
        out = out.repartitionByRange(first, F.col("doc_id")).sortWithinPartitions(first, "doc_id")
    return out


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs`` in training order, each as often as the plan takes it (``taken``
    over ``size``, rounded, so only the one document of a source that the plan cuts differs) and each time at that use's own position. Documents
    without words stay once, at the end. Columns are those of ``docs``. Rows are numbered and written
    first, so that each is repeated by its own plan, whatever ids they share or lack."""
    numbered = spool(docs.withColumn("__sm_row", F.monotonically_increasing_id()), "numbered")
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    at = F.when(F.col("size") > 0, F.slice("positions", F.lit(1), times)).otherwise(F.array(F.lit(None).cast("double")))
    plan = spool(mix(numbered, in_order=False, carry=("__sm_row",), **how).where(times > 0).select("__sm_row", at.alias("__sm_at")), "plan")
    copies = lookup_join(numbered, plan, "__sm_row", "inner").withColumn("__sm_at", F.explode("__sm_at"))
    place = [F.col("__sm_at").asc_nulls_last(), F.col("doc_id"), F.col("__sm_row")]
    return copies.repartitionByRange(*place).sortWithinPartitions(*place).select(*docs.columns)


def oracle() -> str:
    """The plan in DuckDB SQL: one cumulative sum by source in place of buckets, and positions by bisection of each schedule's
    integral, which knows nothing of its inverse."""
    weights = "[" + ", ".join(f"{w!r}::double" for w in WEIGHTS) + "]"
    areas = []
    for k, knots in enumerate(SCHEDULES):
        total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        # The area under the polygon up to t, piece by piece.
        pieces = " + ".join(
            f"(least(greatest(t, {a[0]}), {b[0]}) - {a[0]}) * ({2 * a[1]} + {(b[1] - a[1]) / (b[0] - a[0])} * (least(greatest(t, {a[0]}), {b[0]}) - {a[0]})) / 2" for a, b in zip(knots, knots[1:])
        )
        areas.append(f"when {k} then ({pieces}) / {total!r}::double")
    return f"""
    with recursive d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from documents),
    s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
    w as (select *, {weights}[rank % {len(WEIGHTS)} + 1] as weight, {REPEAT_CAP!r}::double * source_size as cap from s),
    l as (select *, ({DEMAND!r}::double * sum(source_size) over () - coalesce(sum(cap) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level
          from w window b as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
    f as (select arg_min(level, struct_pack(r := cap / weight, k := rank)) as level from l where level <= cap / weight),
    t as (select source, source_size, rank, least(cap, coalesce((select level from f) * weight, cap)) as target from l),
    c as (select d.*, coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as queued from d),
    p as (select c.*, t.source_size, t.rank, t.target, floor(t.target)::bigint as goal, row_number() over () as row from c join t on c.source is not distinct from t.source),
    turns as (select *, unnest(range(3)) as turn from p),
    used as (select *, least(size, goal - turn * source_size - queued) as words, (turn * source_size + queued) / greatest(target, 1.0::double) as share from turns where size > 0 and turn * source_size + queued < goal),
    halved(row, turn, rank, share, k, lo, hi) as (
      select row, turn, rank, share, 0, 0.0::double, 1.0::double from used
      union all
      select row, turn, rank, share, k + 1, case when low then t else lo end, case when low then hi else t end
      from (select *, case rank % {len(SCHEDULES)} {" ".join(areas)} end < share as low from (select *, (lo + hi) / 2 as t from halved where k < 50))),
    placed as (select row, turn, round(hi, {DIGITS}) as position from halved where k = 50),
    uses as (select row, sum(words)::bigint as taken, count(*) as uses, min_by(position, turn) as position, max_by(position, turn) as last_position from used join placed using (row, turn) group by row)
    select doc_id, source, size, source_size, target, coalesce(taken, 0)::bigint as taken, coalesce(uses, 0)::int as uses, position, last_position from p left join uses using (row)
    """
