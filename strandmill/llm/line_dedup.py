"""Removal of lines that spread over many sites.

A line's spread is the number of distinct sites it stands on. HyperLogLog sketches of sites, one for
each line hash, merge by aggregation; they decide every line whose estimate lies clear of the
threshold. Lines near it get exact distinct counts. A line that reaches the threshold is boilerplate:
all its occurrences go, but for the first one (smallest document id, then place), so that a text
which copies of a page share is still there once.

Sketches are only kept for lines that occur often enough to reach the threshold at all; counting
occurrences is one hash aggregation, with partial sums before the shuffle. What is known of the most common lines is told to their
rows where they lie, in every join, so that they do not meet in one task. Texts are shuffled once, in the join that takes removed places out of them.

Everything is built-in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spool, told_join

#: Distinct sites from which a line is boilerplate, and the sketch's size (2**12 registers). A line on two sites may be one page and
#: its copy; on three nobody wrote it for one of them. A share of all sites would let a table of few sites keep whatever repeats.
MIN_SITES, LG_K = 3, 12
#: Estimates within this share of the threshold, and two sites at least, are counted exactly; over six
#: standard errors of the sketch (1.04 / sqrt(2**12) = 1.6 %).
NEAR, NEAR_LEAST = 0.125, 2


def normal(line: Column) -> Column:
    """The form in which lines are compared: without white space at either end."""
    return F.trim(F.translate(line, "\t\r\f\v", "    "))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text, which tells rows with one id apart), place, hash and site of each line that is not blank."""
    hashes = F.transform(F.split("text", "\n", -1), lambda x: F.when(normal(x) != "", F.xxhash64(normal(x))))
    base = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce("source", F.lit("\0")).alias("site"), F.posexplode(hashes).alias("place", "line"))
    return base.where("line is not null")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, spread, exact, n) of the line hashes on at least ``min_sites`` sites; ``spread`` is rounded from the sketch unless ``exact``; n counts
    the line's rows."""
    often = spool(lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites), "often")
    heard = spool(told_join(lines.select("line", "site"), often, "line", "n"), "heard")
    spread = heard.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("spread"))
    band = max(NEAR_LEAST, NEAR * min_sites)
    near = F.abs(F.col("spread") - min_sites) <= band
    sure = spread.where(~near & (F.col("spread") >= min_sites)).select("line", "spread", F.lit(False).alias("exact"))
    unsure = spread.where(near).select("line")
    # Counted before the join, in partial sums, so that the many sites of a common line do not meet in one task.
    counted = heard.distinct().groupBy("line").agg(F.count("*").alias("spread")).join(unsure, "line")
    return sure.union(counted.where(F.col("spread") >= min_sites).select("line", "spread", F.lit(True).alias("exact"))).join(often, "line")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines (lines before) and n_removed added.

    A line is compared by its text without white space at the ends; blank lines have no spread and
    stay. Null text stays null, with 0 lines. Null source counts as one more site. Rows with the same
    id and text lose the same lines; of rows with the same id and different texts each has its own. An
    empty table gives an empty result; further columns pass
    through, but for n_lines and n_removed, which are replaced.
    """
    lines = spool(lines_of(docs), "lines")  # hashes of lines, read three times; texts are split once
    bad = spool(boilerplate(lines, min_sites).select("line", "n"), "boilerplate")
    hits = spool(told_join(lines.select("doc_id", "mark", "place", "line"), bad, "line", "n"), "hits")
    at = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.col("place"), F.col("mark"))
    first = hits.groupBy("line").agg(F.min(at).alias("first")).select(F.col("first.*"), F.lit(True).alias("keep"))
    first = first.toDF("_d", "place", "mark", "keep").distinct()
    gone = hits.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).join(first, ["_d", "place", "mark"], "left_anti")
    gone = gone.groupBy(F.col("doc_id").alias("__sm_id"), F.col("mark").alias("__sm_mark")).agg(F.collect_set("place").alias("__sm_gone"))
    joined = docs.withColumn("__sm_m", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("__sm_id")) & (F.col("__sm_m") == F.col("__sm_mark")), "left")
    joined = joined.withColumn("__sm_lines", F.split("text", "\n", -1))
    n = F.coalesce(F.when(F.col("text").isNotNull(), F.size("__sm_lines")), F.lit(0)).cast("long")
    # What is left of the places, by a hash set, so a text's lines are walked once however many of them go.
    places = F.array_except(F.sequence(F.lit(0), F.size("__sm_lines") - 1), F.transform("__sm_gone", lambda k: k.cast("int")))
    kept = F.transform(places, lambda k: F.get("__sm_lines", k))
    text = F.when(F.col("__sm_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.when(F.col("__sm_gone").isNotNull(), F.size("__sm_gone")), F.lit(0)).cast("long")
    names = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*names, n.alias("n_lines"), removed.alias("n_removed"))


def oracle() -> str:
    """Exact distinct counts of sites by line text, in DuckDB SQL."""
    return f"""
    with l as (select doc_id, coalesce(source, chr(0)) as site, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from documents),
    n as (select *, trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    ')) as norm from l),
    bad as (select norm, min(struct_pack(d := coalesce(doc_id, 9223372036854775807), p := place)) as first from n where norm <> '' group by norm having count(distinct site) >= {MIN_SITES}),
    k as (select n.*, bad.norm is not null and (coalesce(n.doc_id, 9223372036854775807) <> bad.first.d or n.place <> bad.first.p) as gone from n left join bad on n.norm = bad.norm),
    g as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(line, chr(10) order by place) filter (not gone), '') as text from k group by doc_id)
    select d.doc_id, case when d.text is null then null else g.text end as text, coalesce(g.n_lines, 0)::bigint as n_lines, coalesce(g.n_removed, 0)::bigint as n_removed
    from documents d left join g on d.doc_id is not distinct from g.doc_id
    """
