"""All-pairs distances between signatures: intersections by an equi-join on cores, unions by inclusion and exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .signature import SET, VECTOR, checked_mode, sizes


def jaccard_similarity(inter: Column, union: Column) -> Column:
    return F.try_divide(inter.cast("double"), union.cast("double"))


def dice_similarity(inter: Column, n_a: Column, n_b: Column) -> Column:
    return F.try_divide(2.0 * inter.cast("double"), (n_a + n_b).cast("double"))


def hamming_estimate(jaccard: Column, mean_length: Column) -> Column:
    """The share of changed bases that leaves so many cores of that mean length alike."""
    return F.when(mean_length > 0, 1.0 - F.pow(jaccard, 1.0 / mean_length))


def jukes_cantor(hamming: Column) -> Column:
    """Substitutions a site; null where the estimate is saturated (three quarters or more changed)."""
    inside = 1.0 - hamming * F.lit(4.0) / F.lit(3.0)
    return F.when(inside > 0, -0.75 * F.log(F.when(inside > 0, inside)) + 0.0)


#: Genomes of a core, or of a matrix, that are paired in one group; more are cut into blocks, each of which meets each other one.
BLOCK = 256


def shared(sig: DataFrame, element: tuple[str, ...] = ("label", "len"), genome: str = "genome_idx", value: str = "cnt", n_genomes: int | None = None, block: int | None = None) -> DataFrame:
    """(i, j, *element, ca, cb): each core that two genomes i < j share, with both their ``value`` columns.

    An equi-join on the core, so both sides shuffle once by core. A core that more than ``block`` (BLOCK) genomes have is cut into blocks of genomes. With at
    most that many of ``n_genomes`` there is none to look for.
    """
    keys, most = list(element), block or BLOCK
    a = sig.select(F.col(genome).alias("i"), *element, F.col(value).alias("ca"))
    b = sig.select(F.col(genome).alias("j"), *element, F.col(value).alias("cb"))
    if n_genomes is None or n_genomes > most:
        hot = stored(sig.groupBy(*element).count().where(F.col("count") > most).select(*element, F.ceil(F.col("count") / most).cast("int").alias("blocks")), "hot")
        if hot.isEmpty():
            return shared(sig, element, genome, value, most, most)
        blocks = F.coalesce("blocks", F.lit(1))
        mine = lambda g: F.pmod(F.xxhash64(g), blocks).cast("int")
        every = F.explode(F.sequence(F.lit(0), blocks - 1))
        a = a.join(hot, keys, "left").select("i", *element, "ca", mine("i").alias("bi"), every.alias("bj"))
        b = b.join(hot, keys, "left").select("j", *element, "cb", mine("j").alias("bj"), every.alias("bi"))
        keys = [*keys, "bi", "bj"]
    return a.join(b, keys).where("i < j").select("i", "j", *element, "ca", "cb")


def intersections(sig: DataFrame, element: tuple[str, ...] = ("label", "len"), genome: str = "genome_idx", mode: str = SET, n_genomes: int | None = None, block: int | None = None) -> DataFrame:
    """(i, j, inter) for i < j of the genomes that share a core: SET counts cores, VECTOR sums least counts; sums are partial before the
    shuffle by pair (see ``shared``)."""
    both = F.least("ca", "cb") if checked_mode(mode) == VECTOR else F.lit(1)
    return shared(sig, element, genome, "cnt", n_genomes, block).groupBy("i", "j").agg(F.sum(both).cast("long").alias("inter"))


def intersections_by_genome(sig: DataFrame, element: tuple[str, ...] = ("label", "len"), genome: str = "genome_idx", mode: str = SET, parts: int | None = None) -> DataFrame:
    """What ``intersections`` gives, for many genomes, where sums before a shuffle would save little. Pairs are not shuffled one by one: each of a core's genomes gets the list of those after it,
    and counts them where its lists meet, in ``parts`` partitions by i. Cores that more than BLOCK genomes have are paired in blocks."""
    vec = checked_mode(mode) == VECTOR
    known = F.col(genome).isNotNull()
    for c in element:
        known = known & F.col(c).isNotNull()
    known_sig = sig.where(known)
    hot = stored(known_sig.groupBy(*element).count().where(F.col("count") > BLOCK).select(*element), "hot")
    held = lambda g, n: F.struct(F.col(g).alias("g"), F.col(n).alias("n")) if vec else F.col(g)
    few = known_sig if hot.isEmpty() else known_sig.join(hot, list(element), "left_anti")
    lists = few.repartition(*element).groupBy(*element).agg(F.array_sort(F.collect_list(held(genome, "cnt"))).alias("gs"))
    met = lists.select("gs", F.posexplode("gs").alias("at", "a")).where(F.col("at") + 1 < F.size("gs")).select("a", F.slice("gs", F.col("at") + 2, F.size("gs")).alias("after"))
    if not hot.isEmpty():
        many = shared(known_sig.join(hot, list(element), "left_semi"), element, genome)
        met = met.unionByName(many.select(held("i", "ca").alias("a"), F.array(held("j", "cb")).alias("after")))
    met = met.withColumn("i", F.col("a")["g"] if vec else F.col("a"))
    met = (met.repartition(parts, "i") if parts else met.repartition("i")).select("i", "a", F.explode("after").alias("b"))
    both = F.least(F.col("a")["n"], F.col("b")["n"]) if vec else F.lit(1)
    return met.select("i", (F.col("b")["g"] if vec else F.col("b")).alias("j"), both.alias("both")).groupBy("i", "j").agg(F.sum("both").cast("long").alias("inter"))


def all_pairs(per: DataFrame, n: int, block: int | None = None) -> DataFrame:
    """(i, na, ta, j, nb, tb) for every i < j of ``per(genome, n, total_len)``, an equi-join of blocks of genomes, so that a
    matrix of any size is dealt over tasks."""
    blocks = max(1, -(-n // (block or BLOCK)))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a, b = per.toDF("i", "na", "ta"), per.toDF("j", "nb", "tb")
    a = a.select("*", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("bi"), every.alias("bj"))
    b = b.select("*", F.pmod(F.xxhash64("j"), F.lit(blocks)).cast("int").alias("bj"), every.alias("bi"))
    return a.join(b, ["bi", "bj"]).where("i < j").drop("bi", "bj")


#: Pairs of a partition, about, and genomes up to which all are told to every task, where a matrix is made row by row.
PAIRS, FEW = 1 << 19, 200_000


def _pairs(sig: DataFrame, per: DataFrame, element: tuple[str, ...], genome: str, mode: str) -> DataFrame:
    """all_pairs with ``inter``. Of more than BLOCK genomes, rows of the matrix lie where their intersections are counted, so pairs are neither shuffled nor sorted."""
    n = per.count()
    if n <= BLOCK or n > FEW:
        return all_pairs(per, n).join(intersections(sig, element, genome, mode, n), ["i", "j"], "left").na.fill({"inter": 0})
    parts = max(int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * n // (2 * PAIRS)))
    per = stored(per, "sizes")
    pairs = per.toDF("i", "na", "ta").repartition(parts, "i").join(F.broadcast(per.toDF("j", "nb", "tb")), F.expr("i < j")).select("i", "j", "na", "ta", "nb", "tb", F.lit(0).cast("long").alias("inter"))
    none = [F.lit(None).cast("long").alias(c) for c in ("na", "ta", "nb", "tb")]
    met = intersections_by_genome(sig, element, genome, mode, parts).select("i", "j", *none, "inter")
    # Both lie by i alike, so the sum finds a pair's rows in one task.
    return pairs.unionByName(met).groupBy("i", "j").agg(*[F.max(c).alias(c) for c in ("na", "ta", "nb", "tb")], F.sum("inter").alias("inter"))


def _measured(pairs: DataFrame) -> DataFrame:
    pairs = pairs.withColumn("uni", F.col("na") + F.col("nb") - F.col("inter"))
    jaccard = jaccard_similarity(F.col("inter"), F.col("uni"))
    mean = F.try_divide((F.col("ta") + F.col("tb")).cast("double"), (F.col("na") + F.col("nb")).cast("double"))
    return pairs.select(
        "i", "j", "inter", "uni",
        (1.0 - dice_similarity(F.col("inter"), F.col("na"), F.col("nb"))).alias("dice"),
        (1.0 - jaccard).alias("jaccard"),
        jukes_cantor(hamming_estimate(jaccard, mean)).alias("jc"),
    )


def distances(sig: DataFrame, element: tuple[str, ...] = ("label", "len"), genome: str = "genome_idx", mode: str = SET, length: str | None = "len", genomes: DataFrame | None = None) -> DataFrame:
    """(i, j, inter, uni, dice, jaccard, jc) for every i < j, also of genomes that share nothing.

    ``genomes`` lists genomes that may have an empty signature. Pairs of two empty ones have null distances;
    jc is null too where it is saturated or where cores have no length. ``sig`` is read for the genomes' sizes and for both sides
    of the join: it should be stored or persisted.
    """
    per = sizes(sig, mode, genome, length)
    if genomes is not None:
        per = genomes.select(genome).distinct().join(per, genome, "left").na.fill({"n": 0, "total_len": 0})
    return _measured(_pairs(sig, per, element, genome, mode))


def square(dist: DataFrame, genomes: DataFrame, genome: str = "genome_idx") -> DataFrame:
    """The full matrix in long form: both directions, and a zero diagonal."""
    metrics = ("dice", "jaccard", "jc")
    upper = dist.select("i", "j", *metrics)
    same = genomes.select(F.col(genome).alias("i"), F.col(genome).alias("j"), *[F.lit(0.0).alias(m) for m in metrics])
    return upper.union(upper.select("j", "i", *metrics)).union(same)


def nearest(dist: DataFrame, k: int = 1, by: str = "jaccard") -> DataFrame:
    """Each genome's k nearest others: (i, rank, j, distance); ties go to the smaller genome."""
    both = dist.select("i", "j", by).union(dist.select("j", "i", by)).where(F.col(by).isNotNull())
    order = Window.partitionBy("i").orderBy(by, "j")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "rank", "j", F.col(by).alias("distance"))


def nearest_of(sig: DataFrame, k: int = 1, element: tuple[str, ...] = ("label", "len"), genome: str = "genome_idx", by: str = "jaccard") -> DataFrame:
    """``nearest`` of ``distances(sig)`` by ``dice`` or ``jaccard``, from the pairs that share a core alone: of those that share nothing, at distance 1 all, the
    smallest genomes fill up what is missing. ``sig`` has a row for each genome and core and should be stored or persisted."""
    if by not in ("dice", "jaccard"):
        raise ValueError("other distances may be null for pairs that share a core")
    per = stored(sizes(sig, SET, genome, None), "sizes")
    n = per.count()
    inter = intersections(sig, element, genome, SET, n) if n <= BLOCK else intersections_by_genome(sig, element, genome)
    met = _measured(inter.join(per.toDF("i", "na", "ta"), "i").join(per.toDF("j", "nb", "tb"), "j"))
    way = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(by).alias("d"))
    order = Window.partitionBy("i").orderBy("d", "j")
    first = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near = stored(first(met.select(F.explode(F.array(way("i", "j"), way("j", "i"))).alias("w")).select("w.*")).drop("rank"), "near")
    # A genome that misses some has fewer than k partners, all in ``near``: with itself no more than k of the 2k smallest are not to be had.
    short = per.select(F.col(genome).alias("i")).join(near.groupBy("i").count(), "i", "left").where(F.coalesce("count", F.lit(0)) < k).select("i")
    small = per.select(F.col(genome).alias("j")).where("j is not null").orderBy("j").limit(2 * k)
    fill = short.crossJoin(F.broadcast(small)).where("i <> j").join(near.select("i", "j"), ["i", "j"], "left_anti").withColumn("d", F.lit(1.0))
    return first(near.unionByName(fill)).select("i", "rank", "j", F.col("d").alias("distance"))
