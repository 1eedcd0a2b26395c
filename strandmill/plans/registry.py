"""Queries of the genome comparison engine over the driver's tables, and the SQL that each is held against.

Sequences are the ACGT letters of texts, a stand-in for DNA that both engines can make; genomes are languages,
roles, suppliers and the like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chunked import cores_of_pieces, pieces_of, windows_of
from ..functions.lcp import EQUAL, both_strands, cores, cores_by_window, decode_label, decode_length, encode_core
from ..operators import distance, sketch, tree, tree_table
from ..operators.signature import SET, VECTOR, signature, sizes
from ..session import stored, table, work_folder
from ..sources import bgzf, core_table, fasta_ranges, phylip, sequences
from ..sources.manifest import lines, manifest
from . import compare

DIGITS = 9
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


# --- sequences and cores -----------------------------------------------------------------------


def dna(docs: DataFrame, genome: str, record: str) -> DataFrame:
    """(genome_idx, record, seq): the ACGT letters of a text."""
    return docs.select(F.col(genome).alias("genome_idx"), F.col(record).alias("record"), F.regexp_replace(F.upper("text"), "[^ACGT]+", "").alias("seq"))


def sql_level(k: int) -> str:
    """CTEs from the tokens of a level, ``tokens{k}(g, rec, pos, s, tok, begun, upto)``, to its cores ``cores{k}(g, rec, start, end_, label, len)``."""
    by = "partition by rec order by pos"
    return f"""
    ids{k} as materialized (select rec * 16777216 + pos as id, tok, begun, upto from tokens{k}),
    edges{k} as (select *, lag(s) over ({by}) as before, count(*) over (partition by rec) as n from tokens{k}),
    runs{k} as (select g, rec, pos, s, n, coalesce(lead(pos) over ({by}), n) - pos as size, lag(s) over ({by}) as l1, lag(s, 2) over ({by}) as l2,
             lead(s) over ({by}) as r1, lead(s, 2) over ({by}) as r2 from edges{k} where before is null or before <> s),
    sided{k} as (select *, lag(size) over ({by}) as lsize, lead(size) over ({by}) as rsize from runs{k}),
    found{k} as (select g, rec, pos - 1 as first, pos + size as last from sided{k} where l1 is not null and r1 is not null and
              (size >= 2 or (l1 > s and s < r1) or (l1 < s and s > r1 and (lsize >= 2 or l2 < l1) and (rsize >= 2 or r2 < r1)))),
    spans{k} as (select * from found{k} union all
              select g, rec, gs, ge from (select g, rec, lag(last) over (partition by rec order by first) as gs, first as ge from found{k}) where gs + 1 < ge),
    cores{k} as (select c.g, c.rec, x.begun::bigint as start, z.upto::bigint as end_, ('0x' || substr(md5(concat_ws('|', x.tok, y.tok, c.last - c.first + 1, z.tok)), 1, 15))::bigint as label, (z.upto - x.begun)::int as len
              from spans{k} c join ids{k} x on x.id = c.rec * 16777216 + c.first join ids{k} y on y.id = c.rec * 16777216 + c.first + 1 join ids{k} z on z.id = c.rec * 16777216 + c.last)"""


def sql_cores(source: str, level: int = 1) -> str:
    """CTEs up to ``cores(g, rec, start, end_, label, len)`` of a level from a query with columns g, rec, seq. Above level 1 a core's symbol is made from the lowest bit in
    which its label differs from that of the core before it; the first core of a record has none before it and drops."""
    first = f"""
    src as ({source}),
    letters as (select g, rec, unnest(string_split(seq, '')) as letter, generate_subscripts(string_split(seq, ''), 1) - 1 as pos from src where seq <> ''),
    tokens1 as materialized (select g, rec, pos, instr('ACGT', letter) - 1 as s, instr('ACGT', letter) - 1 as tok, pos as begun, pos + 1 as upto from letters),"""
    out = [first, sql_level(1)]
    for k in range(2, level + 1):
        by = "partition by rec order by start"
        out.append(f"""
    paired{k} as (select *, row_number() over ({by}) - 2 as pos, lag(label) over ({by}) as left_ from cores{k - 1}),
    bits{k} as (select *, length(bin(xor(left_, label) & -xor(left_, label))) - 1 as bit from paired{k} where left_ is not null),
    tokens{k} as materialized (select g, rec, pos, case when left_ = label then {EQUAL} else 2 * bit + ((label >> bit) & 1) end::bigint as s, label as tok, start as begun, end_ as upto from bits{k}),""")
        out.append(sql_level(k))
    return "".join(x if x.endswith(",") else x + "," for x in out) + f" cores as (select * from cores{level})"


DNA = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"
BY_LANGUAGE = f"select lang as g, doc_id as rec, {DNA} as seq from documents"
ROLES = f"select role as g, conv_id * 1000 + turn as rec, {DNA} as seq from conversations"


def language_cores(spark: SparkSession, sf_dir: str, level: int = 1) -> DataFrame:
    return cores(dna(table(spark, sf_dir, "documents"), "lang", "doc_id"), level)


def role_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return cores(dna(turns, "role", "id"))


PLACE = ("genome_idx", "record", "start", "end", "label", "len")
CORES_SQL = 'select g as genome_idx, rec as record, start, end_ as "end", label, len from cores'


def core_digest(found: DataFrame) -> DataFrame:
    """One row for each record: its cores' number, lengths and ends, and a print of all starts, ends and labels."""
    mark = F.col("label").bitwiseXOR(F.col("start") * 2654435761 + F.col("end"))
    return found.groupBy("genome_idx", "record").agg(F.count("*").alias("n"), F.sum(F.col("len").cast("long")).alias("total_len"), F.min("start").alias("first"), F.max("end").alias("last"), F.bit_xor(mark).alias("mark"))


CORE_DIGEST = "select g as genome_idx, rec as record, count(*) as n, sum(len)::bigint as total_len, min(start) as first, max(end_) as last, bit_xor(xor(label, start * 2654435761 + end_)) as mark from cores group by all"
for _level in (1, 2, 3, 4):
    _register(f"cores_level{_level}", lambda s, d, level=_level: core_digest(language_cores(s, d, level)), f"with {sql_cores(BY_LANGUAGE, _level)} {CORE_DIGEST}")
_register(
    "cores_level4_chunked",
    lambda s, d: core_digest(cores_of_pieces(pieces_of(dna(table(s, d, "documents"), "lang", "doc_id"), 256), 4, 256, 512)),
    ORACLES["cores_level4"],
)
_register("cores_level1_reads", lambda s, d: role_cores(s, d).select(*PLACE), f"with {sql_cores(ROLES)} {CORES_SQL}")
_register(
    "cores_level1_window",
    lambda s, d: cores_by_window(dna(table(s, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "role", "id").select("record", "seq"), "record"),
    f'with {sql_cores(ROLES)} select rec as record, start, end_ as "end", label, len from cores',
)
STRANDS = f"""select g, rec * 2 + k as rec, case k when 0 then seq else reverse(translate(seq, 'ACGT', 'TGCA')) end as seq
              from (select role as g, conv_id * 1000 + turn as rec, {DNA} as seq from conversations), (values (0), (1)) t(k)"""
_register(
    "cores_both_strands",
    lambda s, d: cores(both_strands(dna(table(s, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "role", "id"))).groupBy("genome_idx", "strand").agg(F.count("*").alias("n"), F.sum("len").alias("total_len")),
    f"with {sql_cores(STRANDS)} select g as genome_idx, case rec % 2 when 0 then '+' else '-' end as strand, count(*) as n, sum(len)::bigint as total_len from cores group by all",
)
_register(
    "core_codes",
    lambda s, d: language_cores(s, d).groupBy("len").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.bit_xor(F.col("label").bitwiseAND(4294967295) * 256 + F.col("len")).alias("packed")),
    f"with {sql_cores(BY_LANGUAGE)} select len, count(*) as n, count(distinct label) as labels, bit_xor((label & 4294967295) * 256 + len) as packed from cores group by len",
)

# --- signatures --------------------------------------------------------------------------------

SIG = "sig as (select g, label, len, count(*) as cnt from cores group by all)"


def language_signature(spark: SparkSession, sf_dir: str, band: tuple[int, int] | None = None) -> DataFrame:
    return signature(language_cores(spark, sf_dir), band=band)


_register("signature", language_signature, f"with {sql_cores(BY_LANGUAGE)}, {SIG} select g as genome_idx, label, len, cnt from sig")
_register(
    "signature_band",
    lambda s, d: language_signature(s, d, (15, 256)),
    f"with {sql_cores(BY_LANGUAGE)}, {SIG} select g as genome_idx, label, len, cnt from sig where cnt between 15 and 256",
)


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("de", 5, 256), ("en", 6, 436), ("es", 10, None)], "genome_idx string, min_cc long, max_cc long")


BANDS = "bands(k, lo, hi) as (values ('de', 5, 256), ('en', 6, 436), ('es', 10, null))"
_register(
    "signature_bands",
    lambda s, d: signature(language_cores(s, d), bands=bands(s)),
    f"with {sql_cores(BY_LANGUAGE)}, {SIG}, {BANDS} select g as genome_idx, label, len, cnt from sig left join bands on g = k where cnt between coalesce(lo, 0) and coalesce(hi, 4294967295)",
)
for _mode, _n, _t in ((SET, "count(*)", "sum(len)"), (VECTOR, "sum(cnt)", "sum(len * cnt)")):
    _register(
        f"sizes_{_mode}",
        lambda s, d, mode=_mode: sizes(language_signature(s, d), mode),
        f"with {sql_cores(BY_LANGUAGE)}, {SIG} select g as genome_idx, {_n}::bigint as n, {_t}::bigint as total_len from sig group by g",
    )

# --- distances ---------------------------------------------------------------------------------


def sql_distances(mode: str, element: str, length: str | None) -> str:
    """CTE ``dist`` over ``sig(g, <element>, cnt)``."""
    vec = mode == VECTOR
    n, total = ("sum(cnt)", f"sum({length} * cnt)") if vec else ("count(*)", f"sum({length})")
    total = total if length else "null"
    h = "(1 - pow(inter / uni, 1 / ((ta + tb) / (na + nb))))"
    return f"""
    per as (select g, ({n})::double as n, ({total})::double as t from sig group by g),
    met as (select a.g as i, b.g as j, sum({'least(a.cnt, b.cnt)' if vec else '1'})::bigint as inter from sig a join sig b using ({element}) where a.g < b.g group by all),
    pairs as (select a.g as i, b.g as j, a.n as na, b.n as nb, a.t as ta, b.t as tb, coalesce(inter, 0) as inter, a.n + b.n - coalesce(inter, 0) as uni
              from per a join per b on a.g < b.g left join met on met.i = a.g and met.j = b.g),
    dist as (select i, j, inter::bigint as inter, uni::bigint as uni, 1 - 2 * inter / (na + nb) as dice, 1 - inter / uni as jaccard,
             case when ta is not null and ta + tb > 0 and 1 - {h} * 4 / 3 > 0 then -0.75 * ln(1 - {h} * 4 / 3) + 0.0 end as jc from pairs)"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


ROUNDED = f"select i, j, inter, uni, round(dice, {DIGITS}) as dice, round(jaccard, {DIGITS}) as jaccard, round(jc, {DIGITS}) as jc from dist"
for _mode in (SET, VECTOR):
    _register(
        f"distances_{_mode}",
        lambda s, d, mode=_mode: rounded(distance.distances(stored(language_signature(s, d), "signature"), mode=mode)),
        f"with {sql_cores(BY_LANGUAGE)}, {SIG}, {sql_distances(_mode, 'label, len', 'len')} {ROUNDED}",
    )
_register(
    "distances_band_vec",
    lambda s, d: rounded(distance.distances(stored(language_signature(s, d, (2, 64)), "signature"), mode=VECTOR)),
    f"with {sql_cores(BY_LANGUAGE)}, all_sig as (select g, label, len, count(*) as cnt from cores group by all), sig as (select * from all_sig where cnt between 2 and 64), {sql_distances(VECTOR, 'label, len', 'len')} {ROUNDED}",
)
_register(
    "distances_level4",
    lambda s, d: rounded(distance.distances(stored(signature(language_cores(s, d, 4)), "signature"))),
    f"with {sql_cores(BY_LANGUAGE, 4)}, {SIG}, {sql_distances(SET, 'label, len', 'len')} {ROUNDED}",
)

#: (name, table, genome, element) of signatures over other tables, where elements have no length.
ITEMS = (
    ("suppliers", "lineitem", "l_suppkey", "l_partkey"),
    ("return_flags", "lineitem", "l_returnflag", "l_partkey"),
    ("event_types", "events", "event_type", "user_id"),
    ("priorities", "orders", "o_orderpriority", "o_custkey"),
)


def item_signature(spark: SparkSession, sf_dir: str, name: str, genome: str, item: str) -> DataFrame:
    return stored(signature(table(spark, sf_dir, name).select(F.col(genome).alias("genome_idx"), F.col(item).alias("item")), ("item",)), "signature")


for _name, _table, _genome, _item in ITEMS:
    for _mode in (SET, VECTOR):
        _register(
            f"items_{_name}_{_mode}",
            lambda s, d, t=_table, g=_genome, x=_item, mode=_mode: rounded(distance.distances(item_signature(s, d, t, g, x), ("item",), mode=mode, length=None)),
            f"with sig as (select {_genome} as g, {_item} as item, count(*) as cnt from {_table} group by all), {sql_distances(_mode, 'item', None)} {ROUNDED.replace('jc from', 'jc from').replace('round(jc, 9)', 'jc::double')}",
        )

# --- matrices ----------------------------------------------------------------------------------

LANGUAGES = f"{sql_cores(BY_LANGUAGE)}, {SIG}, {sql_distances(SET, 'label, len', 'len')}"
SQUARE = """square as (select i, j, dice, jaccard, jc from dist union all select j, i, dice, jaccard, jc from dist
            union all select distinct g, g, 0.0::double, 0.0::double, 0.0::double from sig)"""


def language_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = stored(language_signature(spark, sf_dir), "signature")
    return distance.square(distance.distances(sig), sig.select("genome_idx").distinct())


def numbered_names(square: DataFrame) -> DataFrame:
    """(genome_idx, short_name): genomes in order, as a matrix file numbers them."""
    return square.select(F.col("i").alias("short_name")).distinct().withColumn("genome_idx", F.row_number().over(Window.orderBy("short_name")) - 1)


def matrix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = stored(language_square(spark, sf_dir), "square")
    names = numbered_names(square)
    number = names.select(F.col("genome_idx").alias("k"), F.col("short_name").alias("s"))
    digits = square.withColumn("jaccard", F.round("jaccard", DIGITS))
    by_number = digits.join(number.toDF("ki", "i"), "i").join(number.toDF("kj", "j"), "j").select(F.col("ki").alias("i"), F.col("kj").alias("j"), "jaccard")
    return phylip.matrix_lines(by_number, names, "jaccard")


def lower_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower triangle over the largest distance, which one aggregation finds."""
    lower = stored(language_square(spark, sf_dir).where("j <= i"), "square")
    return rounded(lower.select("i", "j", (F.col("dice") / F.lit(lower.agg(F.max("dice")).first()[0])).alias("d")))


_register(
    "matrix_square",
    lambda s, d: rounded(language_square(s, d)),
    f"with {LANGUAGES}, {SQUARE} select i, j, round(dice, {DIGITS}) as dice, round(jaccard, {DIGITS}) as jaccard, round(jc, {DIGITS}) as jc from square",
)
_register(
    "matrix_phylip",
    matrix_text,
    f"""with {LANGUAGES}, {SQUARE}, t as (select i, printf('%10s', i) || string_agg(printf(' %.15f', round(jaccard, {DIGITS})), '' order by j) as line from square group by i)
    select 0::bigint as nr, (select count(*)::varchar from t) as line union all select row_number() over (order by i), line from t""",
)
_register(
    "matrix_lower_normalised",
    lower_normalised,
    f"with {LANGUAGES}, {SQUARE} select i, j, round(dice / max(dice) over (), {DIGITS}) as d from square where j <= i",
)
_register(
    "nearest",
    lambda s, d: rounded(distance.nearest_of(item_signature(s, d, "lineitem", "l_suppkey", "l_partkey"), 3, ("item",))),
    f"""with sig as (select l_suppkey as g, l_partkey as item, count(*) as cnt from lineitem group by all), {sql_distances(SET, 'item', None)},
    two as (select i, j, jaccard from dist union all select j, i, jaccard from dist), r as (select *, row_number() over (partition by i order by jaccard, j)::int as rank from two)
    select i, rank, j, round(jaccard, {DIGITS}) as distance from r where rank <= 3""",
)
_register(
    "nj_criterion",
    lambda s, d: rounded(tree.q_matrix(language_square(s, d), "dice")),
    f"""with {LANGUAGES}, {SQUARE}, r as (select i, sum(dice) as r, count(*) as n from square group by i)
    select q.i, q.j, round((a.n - 2) * dice - a.r - b.r, {DIGITS}) as q from square q join r a on a.i = q.i join r b on b.i = q.j where q.i < q.j""",
)
SHORT = "short as (select n_nationkey as k, n_name as name, substr(n_name, 1, 10) as short from nation)"
_register(
    "short_names",
    lambda s, d: table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.substring("n_name", 1, 10).alias("short"), F.format_string("%10s", F.substring("n_name", 1, 10)).alias("padded")),
    f"with {SHORT} select k, short, printf('%10s', short) as padded from short",
)

# --- trees and files ---------------------------------------------------------------------------


def language_tree(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    square = stored(language_square(spark, sf_dir), "square")
    number = numbered_names(square).select(F.col("genome_idx").alias("k"), F.col("short_name").alias("s"))
    lower = square.join(number.toDF("ki", "i"), "i").join(number.toDF("kj", "j"), "j").where("kj <= ki")
    root = tree.tree(lower.select(F.col("ki").alias("i"), F.col("kj").alias("j"), F.col("i").alias("name_i"), F.col("j").alias("name_j"), F.col("dice").alias("d")), method)
    return rounded(tree.edges(spark, root)).withColumn("newick", F.lit(tree.to_newick(root)))


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write each language's sequences as FASTA, wrapped at 60, and read them back."""
    path = work_folder(spark, "fasta")
    docs = dna(table(spark, sf_dir, "documents"), "lang", "doc_id").where("seq <> ''")
    docs.select("genome_idx", F.concat(F.lit(">"), F.col("record").cast("string"), F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value")).write.partitionBy("genome_idx").text(path)
    files = spark.read.text(path).select(F.input_file_name().alias("in_path"), "genome_idx").distinct()
    return sequences.read_fasta(spark, files).groupBy("genome_idx", "seq").agg(F.count("*").alias("n"))


def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write each role's turns as gzipped FASTQ and read them back."""
    path = work_folder(spark, "fastq")
    turns = dna(table(spark, sf_dir, "conversations"), "role", "conv_id").where("seq <> ''")
    read = F.concat(F.lit("@"), F.col("record").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.regexp_replace("seq", ".", "I"))
    turns.select("genome_idx", read.alias("value")).write.partitionBy("genome_idx").option("compression", "gzip").text(path)
    files = spark.read.text(path).select(F.input_file_name().alias("in_path"), "genome_idx").distinct()
    return sequences.read_fastq(spark, files).groupBy("genome_idx", "seq").agg(F.count("*").alias("n"))


def core_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store level-1 cores, read them back and sign them."""
    path = work_folder(spark, "cores")
    sequences.write_cores(language_cores(spark, sf_dir).withColumn("level", F.lit(1)), path)
    return signature(sequences.read_cores(spark, path, 1))


def long_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(in_path, genome_idx) of one FASTA file for each language, a record for each document, wrapped at 60."""
    path = work_folder(spark, "genomes")
    # Told from the text, as a filter on seq would make it twice.
    docs = dna(table(spark, sf_dir, "documents").where(F.upper("text").rlike("[ACGT]")), "lang", "doc_id")
    lines = docs.select("genome_idx", F.concat(F.lit(">"), F.col("record").cast("string"), F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value"))
    lines.repartition("genome_idx").write.partitionBy("genome_idx").text(path)
    return stored(spark.read.text(path).select(F.input_file_name().alias("in_path"), "genome_idx").distinct(), "list")


def ranges_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read each language's file by ranges of 8 KB, which cut records anywhere, and cut the records into hundreds of bases again."""
    pieces = fasta_ranges.read_fasta_ranges(spark, long_fasta(spark, sf_dir), split=8192)
    return windows_of(pieces, 100, 0).groupBy("genome_idx", "window", "bases", "length").agg(F.count("*").alias("n"))


def ranges_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-4 cores of files read by ranges and parsed by windows of 4,096 bases, signed: no task holds a file or needs a record."""
    pieces = fasta_ranges.read_fasta_ranges(spark, long_fasta(spark, sf_dir), split=65536)
    return signature(cores_of_pieces(pieces, 4, 4096, 2048))


_register(
    "fasta_ranges",
    ranges_round_trip,
    f"""with src as ({BY_LANGUAGE}), cut as (select g, seq, unnest(range(0, (length(seq) + 99) // 100)) as w from src where seq <> '')
    select g as genome_idx, w::bigint as "window", substr(seq, w * 100 + 1, 100) as bases, length(seq)::bigint as length, count(*) as n from cut group by all""",
)
_register("signature_ranges_level4", ranges_signature, f"with {sql_cores(BY_LANGUAGE, 4)}, {SIG} select g as genome_idx, label, len, cnt from sig")
_register("fasta_scan", fasta_round_trip, f"with src as ({BY_LANGUAGE}) select g as genome_idx, seq, count(*) as n from src where seq <> '' group by all")
_register("fastq_scan", fastq_round_trip, f"with src as ({ROLES}) select g as genome_idx, seq, count(*) as n from src where seq <> '' group by all")
_register("core_store", core_store_round_trip, ORACLES["signature"])


# --- lists, packed cores, the gate, matrix files ------------------------------------------------


def listed(spark: SparkSession, rows: DataFrame, order: str, line: str) -> str:
    """A list file of as many lines as there are genomes, in order; returns its path."""
    path = work_folder(spark, "list")
    rows.orderBy(order).select(F.col(line).cast("string").alias("value")).coalesce(1).write.text(path)
    return path


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of inputs, names, thresholds and outputs, one line for each nation, read as a run reads them."""
    n = table(spark, sf_dir, "nation").select(
        "n_nationkey",
        F.concat(F.lit("in/"), "n_name", F.lit(".fa")).alias("path"),
        "n_name",
        (F.col("n_nationkey") * 3).alias("low"),
        (4294967295 - F.col("n_regionkey")).alias("high"),
        F.concat(F.lit("out/"), F.col("n_nationkey").cast("string")).alias("out"),
    )
    lists = {c: listed(spark, n, "n_nationkey", c) for c in ("path", "n_name", "low", "high", "out")}
    return manifest(spark, lists["path"], lists["n_name"], lists["low"], lists["high"], lists["out"])


_register(
    "manifest_scan",
    manifest_scan,
    """select (row_number() over (order by n_nationkey) - 1)::int as genome_idx, 'in/' || n_name || '.fa' as in_path, substr(n_name, 1, 10) as short_name,
    (n_nationkey * 3)::bigint as min_cc, 4294967295 - n_regionkey as max_cc, 'out/' || n_nationkey as out_path from nation""",
)
_register(
    "manifest_lines",
    lambda s, d: lines(s, listed(s, table(s, d, "nation"), "n_nationkey", "n_name"), "in_path").groupBy(F.length("in_path").alias("n")).agg(F.count("*").alias("lines"), F.min("genome_idx").alias("first")),
    "select length(n_name) as n, count(*) as lines, min(k)::int as first from (select n_name, row_number() over (order by n_nationkey) - 1 as k from nation) group by 1",
)


def packed_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores in their packed form, and what decoding gives back."""
    packed = role_cores(spark, sf_dir).select("genome_idx", encode_core(F.col("label"), F.col("len")).alias("packed"))
    return packed.groupBy("genome_idx", "packed").agg(F.count("*").alias("cnt")).select("*", decode_label(F.col("packed")).alias("label32"), decode_length(F.col("packed")).alias("len"))


_register(
    "core_packed",
    packed_cores,
    f"""with {sql_cores(ROLES)}, low as (select g, label & 4294967295 as label32, len::bigint as len from cores)
    select g as genome_idx, (case when label32 >= 2147483648 then label32 - 4294967296 else label32 end) * 4294967296 + len as packed, count(*) as cnt, label32, len from low group by all""",
)


def sequence_files(spark: SparkSession, sf_dir: str, reads: bool) -> tuple[str, str]:
    """Conversation turns of each role as one FASTA or FASTQ file; returns the lists of files and of roles."""
    path = work_folder(spark, "reads" if reads else "genomes")
    turns = dna(table(spark, sf_dir, "conversations"), "role", "conv_id").where("seq <> ''")
    head, tail = (F.lit("@r\n"), F.concat(F.lit("\n+\n"), F.regexp_replace("seq", ".", "I"))) if reads else (F.lit(">r\n"), F.lit(""))
    turns.select("genome_idx", F.concat(head, F.col("seq"), tail).alias("value")).repartition("genome_idx").write.partitionBy("genome_idx").text(path)
    files = spark.read.text(path).select(F.input_file_name().alias("in_path"), F.col("genome_idx").alias("role")).distinct()
    return listed(spark, files, "role", "in_path"), listed(spark, files, "role", "role")


def filter_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which runs filter by frequency: genomes only if a threshold is given, reads always."""
    genomes, reads = sequence_files(spark, sf_dir, False), sequence_files(spark, sf_dir, True)
    runs = [("fa", compare.from_fasta(spark, compare.Run(*genomes, level=1))), ("fa min", compare.from_fasta(spark, compare.Run(*genomes, level=1, min_cc=20))), ("fq", compare.from_fastq(spark, compare.Run(*reads, level=1)))]
    out = [r.signature.join(r.genomes, "genome_idx").groupBy("short_name").agg(F.count("*").alias("n"), F.sum("cnt").alias("total")).select(F.lit(name).alias("run"), "short_name", "n", "total") for name, r in runs]
    return out[0].union(out[1]).union(out[2])


_register(
    "filter_gate",
    filter_gate,
    f"""with one as (with {sql_cores(ROLES)} select g, label, len, count(*) as cnt from cores group by all), two as (with {sql_cores(STRANDS)} select g, label, len, count(*) as cnt from cores group by all),
    runs as (select 'fa' as run, * from one union all select 'fa min', * from one where cnt >= 20 union all select 'fq', * from two where cnt between 15 and 256)
    select run, g as short_name, count(*) as n, sum(cnt)::bigint as total from runs group by all""",
)


def matrix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language matrix written as PHYLIP files and read back, normalised: its lower triangle."""
    square = stored(language_square(spark, sf_dir), "square")
    names = numbered_names(square)
    number = names.select(F.col("genome_idx").alias("k"), F.col("short_name").alias("s"))
    by_number = square.join(number.toDF("ki", "i"), "i").join(number.toDF("kj", "j"), "j").select(F.col("ki").alias("i"), F.col("kj").alias("j"), *phylip.METRICS)
    paths = phylip.write_matrices(by_number, names, work_folder(spark, "gc"), SET, 1)
    return rounded(phylip.read_matrix(spark, paths[1], normalize=True).select("name_i", "name_j", "d"))


_register(
    "matrix_files",
    matrix_files,
    f"with {LANGUAGES}, {SQUARE} select i as name_i, j as name_j, round(round(jaccard, 15) / max(round(jaccard, 15)) over (), {DIGITS}) as d from square where j <= i",
)


# --- blocked gzip, bucketed stores, sketches --------------------------------------------------------


def blocked_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write each role's turns as one file of blocked gzip and read the files by ranges of 4 KB."""
    turns = dna(table(spark, sf_dir, "conversations"), "role", "conv_id").where("seq <> ''")
    read = F.concat(F.lit("@"), F.col("record").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.regexp_replace("seq", ".", "I"))
    files = stored(bgzf.write_blocked(turns.select("genome_idx", read.alias("value")), work_folder(spark, "blocked"), "genome_idx"), "files")
    found = sequences.read_fastq(spark, files.select(F.col("path").alias("in_path"), F.col("key").alias("genome_idx")), split=4096)
    return found.groupBy("genome_idx", "seq").agg(F.count("*").alias("n"))


def bucketed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language signatures in a bucketed store, added by two writes, and the distances between them."""
    path, sig = work_folder(spark, "bucketed"), stored(language_signature(spark, sf_dir), "signature")
    for half in (F.col("genome_idx") < "en", F.col("genome_idx") >= "en"):
        core_table.write_signatures(sig.where(half), path, 16)
    return rounded(distance.distances(core_table.read_signatures(spark, path)))


_register("fastq_blocked", blocked_round_trip, f"with src as ({ROLES}) select g as genome_idx, seq, count(*) as n from src where seq <> '' group by all")
_register("core_store_bucketed", bucketed_distances, ORACLES["distances_set"])


def genome_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stores each role's cores in a folder of its own, and the signatures of a run from those folders."""
    paths, names = sequence_files(spark, sf_dir, False)
    base = work_folder(spark, "own")
    outputs = listed(spark, lines(spark, names, "role").select("genome_idx", F.concat(F.lit(f"{base}/"), "role").alias("out")), "genome_idx", "out")
    compare.from_fasta(spark, compare.Run(paths, names=names, level=1, outputs=outputs))
    again = compare.from_cores(spark, compare.Run(outputs, names=names, level=1))
    return again.signature.join(again.genomes, "genome_idx").select("short_name", "label", "len", "cnt")


_register("core_files", genome_files, f"with {sql_cores(ROLES)}, {SIG} select substr(g, 1, 10) as short_name, label, len, cnt from sig")

DRAWN = 256
_register(
    "sketch_jaccard",
    lambda s, d: rounded(sketch.estimates(sketch.sketches(stored(language_signature(s, d), "signature"), DRAWN), DRAWN)),
    f"""with {sql_cores(BY_LANGUAGE)}, {SIG}, least as (select g, list((label, len) order by label, len)[:{DRAWN}] as e from sig group by g),
    pairs as (select a.g as i, b.g as j, a.e as a, b.e as b, list_sort(list_distinct(a.e || b.e))[:{DRAWN}] as u from least a join least b on a.g < b.g),
    n as (select i, j, len(list_filter(u, lambda x: list_contains(a, x) and list_contains(b, x)))::bigint as shared, len(u)::bigint as drawn from pairs)
    select *, round(1 - shared / drawn, {DIGITS}) as jaccard from n""",
)
_register(
    "sketch_whole",
    lambda s, d: rounded(sketch.estimates(sketch.least(item_signature(s, d, "orders", "o_orderpriority", "o_custkey"), 1 << 30, ("item",)), 1 << 30).select("i", "j", "jaccard")),
    f"with sig as (select o_orderpriority as g, o_custkey as item, count(*) as cnt from orders group by all), {sql_distances(SET, 'item', None)} select i, j, round(jaccard, {DIGITS}) as jaccard from dist",
)


# --- trees as tables ------------------------------------------------------------------------------


def customer_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges of a tree for each region: its nations, their market segments, and customers as leaves; lengths are made from keys and names."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    own = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    inner = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 40)) + F.lit(1 << 40)
    at = lambda node, parent, length, name: F.struct(node.cast("long").alias("node"), parent.cast("long").alias("parent"), length.cast("double").alias("branch_length"), name.cast("string").alias("name"))
    key, segment, none = F.col("n_nationkey"), F.col("c_mktsegment"), F.lit(None)
    rows = F.array(
        at(F.lit(0), none, none, none),
        at(key + 1, F.lit(0), key / 2, none),
        at(inner(key, segment), key + 1, F.length(segment) / 4, none),
        at(F.lit(1 << 42) + F.col("c_custkey"), inner(key, segment), (F.col("c_custkey") % 64 + 1) / 8, F.col("c_name")),
    )
    return own.select(F.col("n_regionkey").cast("int").alias("tree"), F.explode(rows).alias("e")).select("tree", "e.*").distinct()


LEAVES = "leaf as (select n_regionkey::int as tree, n_nationkey as n, c_mktsegment as s, c_name as name, (c_custkey % 64 + 1) / 8.0::double as a, length(c_mktsegment) / 4.0::double as b, n_nationkey / 2.0::double as c from customer join nation on c_nationkey = n_nationkey)"
_register(
    "newick_lines",
    lambda s, d: tree_table.newick_lines(customer_forest(s, d)),
    f"""with {LEAVES}, seg as (select tree, n, c, min(name) as least, '(' || string_agg(name || printf(':%.5f', a), ',' order by name) || ')' || printf(':%.5f', any_value(b)) as t from leaf group by tree, n, c, s),
    nat as (select tree, min(least) as least, '(' || string_agg(t, ',' order by least) || ')' || printf(':%.5f', any_value(c)) as t from seg group by tree, n)
    select tree, '(' || string_agg(t, ',' order by least) || ');' as line from nat group by tree""",
)


def newick_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the forest as Newick, a tree a line, scan it, and tell every leaf's length and those of the two nodes above."""
    path = work_folder(spark, "newick")
    tree_table.newick_lines(customer_forest(spark, sf_dir)).select("line").write.text(path)
    nodes = stored(tree_table.newick_nodes(spark.read.text(path).select(F.xxhash64("value").alias("tree"), F.col("value").alias("line"))), "nodes")
    upper = lambda k: nodes.select("tree", F.col("node").alias(f"p{k}"), F.col("parent").alias(f"p{k + 1}"), F.col("branch_length").alias(f"length{k}"))
    leaves = nodes.where("name is not null").withColumnRenamed("parent", "p1")
    return leaves.join(upper(1), ["tree", "p1"]).join(upper(2), ["tree", "p2"]).select("name", "branch_length", "length1", "length2")


_register("newick_scan", newick_scan, f"with {LEAVES} select name, a as branch_length, b as length1, c as length2 from leaf")

APART = f"""{LEAVES}, path as (select x.tree, x.name as x, y.name as y, case when x.name = y.name then 0.0 else x.a + y.a + case when x.n = y.n and x.s = y.s then 0.0 else x.b + y.b + case when x.n = y.n then 0.0 else x.c + y.c end end end as d
            from leaf x join leaf y on x.tree = y.tree)"""


def leaf_depths(edges: DataFrame) -> DataFrame:
    return tree_table.root_distances(edges).where("leaf").select("tree", "name", F.round("depth", DIGITS).alias("depth"))


_register(
    "tree_midpoint",
    lambda s, d: leaf_depths(tree_table.root_at_midpoint(customer_forest(s, d))),
    f"""with {APART}, ends as (select tree, arg_max(x, (d, y, x)) as p, arg_max(y, (d, y, x)) as q, max(d) as whole from path group by tree),
    legs as (select path.tree, path.x as name, e.whole, path.d as dp, z.d as dq from ends e join path on path.tree = e.tree and path.y = e.p join path z on z.tree = e.tree and z.x = path.x and z.y = e.q)
    select tree, name, round(abs((dp + whole - dq) / 2 - whole / 2) + dp - (dp + whole - dq) / 2, {DIGITS}) as depth from legs""",
)


def rooted_at_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest, each tree rooted at its leaf of least name."""
    edges = customer_forest(spark, sf_dir)
    return tree_table.root_at_outgroup(edges, edges.where("name is not null").groupBy("tree").agg(F.min("name").alias("name")))


_register(
    "tree_outgroup",
    lambda s, d: leaf_depths(rooted_at_first(s, d)),
    f"with {APART}, first as (select tree, min(name) as name from leaf group by tree) select path.tree, x as name, round(d, {DIGITS}) as depth from path join first on path.tree = first.tree and y = first.name",
)


def priority_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = item_signature(spark, sf_dir, "orders", "o_orderpriority", "o_custkey")
    return distance.square(distance.distances(sig, ("item",), length=None), sig.select("genome_idx").distinct())


def triangle(square: DataFrame) -> DataFrame:
    """The lower triangle (i, j, name_i, name_j, d) of Dice distances, genomes numbered by name."""
    number = numbered_names(square).select(F.col("genome_idx").alias("k"), F.col("short_name").alias("s"))
    lower = square.join(number.toDF("ki", "i"), "i").join(number.toDF("kj", "j"), "j").where("kj <= ki")
    return lower.select(F.col("ki").alias("i"), F.col("kj").alias("j"), F.col("i").alias("name_i"), F.col("j").alias("name_j"), F.round("dice", 15).alias("d"))


def upgma_clades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clade of the priorities' tree by average linkage, as its leaves' names, and its branch length."""
    cells, names = tree.cells_of(triangle(stored(priority_square(spark, sf_dir), "square")))
    edges = tree_table.linked_edges(tree_table.linkage(cells), spark.createDataFrame(list(names.items()), "i int, name string"))
    below = tree_table.leaves_below(edges).groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("leaf")), "+").alias("clade"), F.first("branch_length").alias("branch_length"))
    return below.select("clade", F.round("branch_length", DIGITS).alias("branch_length"))


def nj_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between priorities along their neighbour-joining tree."""
    root = tree.tree(triangle(stored(priority_square(spark, sf_dir), "square")), "nj")
    edges = tree.edges(spark, root).select(F.lit(0).alias("tree"), F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "branch_length", "name")
    return rounded(tree_table.path_lengths(edges).drop("tree"))


PRIORITIES, FIVE = f"sig as (select o_orderpriority as g, o_custkey as item, count(*) as cnt from orders group by all), {sql_distances(SET, 'item', None)}, {SQUARE}", 5
START = """c0 as materialized (select i, j, round(dice, 15)::decimal(24,15) as d from square where i <> j), k0 as (select i as r, [i] as clade, 0.0::double as h from square where i = j)"""
TURNED = "case when {0} = b{1}.i then b{1}.j else {0} end"


def sql_linkage_steps(n: int) -> str:
    """CTEs that join n clusters one pair at a time, and e(clade, branch_length) of all clades."""
    out, ends = [START], ["select clade, 0.0::double as branch_length from k%d" % (n - 1)]
    for t in range(n - 1):
        out.append(f"b{t} as materialized (select i, j, d from c{t} where i > j order by d, i desc, j desc limit 1)")
        out.append(f"c{t + 1} as materialized (select i, j, (sum(d) / count(*))::decimal(24,15) as d from (select {TURNED.format('c.i', t)} as i, {TURNED.format('c.j', t)} as j, c.d from c{t} c, b{t}) where i <> j group by all)")
        out.append(f"k{t + 1} as materialized (select k.r, k.clade, k.h from k{t} k, b{t} where k.r not in (b{t}.i, b{t}.j) union all select any_value(b{t}.j), list_sort(flatten(list(k.clade))), any_value(b{t}.d)::double / 2 from k{t} k, b{t} where k.r in (b{t}.i, b{t}.j))")
        ends.append(f"select k.clade, b{t}.d::double / 2 - k.h from k{t} k, b{t} where k.r in (b{t}.i, b{t}.j)")
    return ", ".join(out) + ", e as (" + " union all ".join(ends) + ")"


def sql_joining_steps(n: int) -> str:
    """CTEs that join n neighbours one pair at a time, and e(clade, branch_length) of the unrooted tree's edges, each by the leaves on one side."""
    out, ends = [START], []
    for t in range(n - 2):
        m = n - t - 2
        out.append(f"r{t} as (select i, sum(d) as r from c{t} group by i)")
        out.append(f"b{t} as materialized (select c.i, c.j, c.d, x.r as ri, y.r as rj from c{t} c join r{t} x on x.i = c.i join r{t} y on y.i = c.j where c.i > c.j order by {m} * c.d - x.r - y.r, c.i, c.j limit 1)")
        turned = f"select {TURNED.format('c.i', t)} as i, {TURNED.format('c.j', t)} as j, c.d, c.i in (b{t}.i, b{t}.j) or c.j in (b{t}.i, b{t}.j) as new, b{t}.d as less from c{t} c, b{t}"
        out.append(f"c{t + 1} as materialized (select i, j, case when any_value(new) then ((sum(d) - any_value(less)) / 2)::decimal(24,15) else any_value(d) end as d from ({turned}) where i <> j group by i, j)")
        out.append(f"k{t + 1} as materialized (select k.r, k.clade, k.h from k{t} k, b{t} where k.r not in (b{t}.i, b{t}.j) union all select any_value(b{t}.j), flatten(list(k.clade)), 0.0 from k{t} k, b{t} where k.r in (b{t}.i, b{t}.j))")
        length = f"(b{t}.d::double + (b{t}.ri - b{t}.rj)::double / {m}) / 2"
        ends.append(f"select k.clade, case when k.r = b{t}.i then {length} else b{t}.d::double - {length} end as branch_length from k{t} k, b{t} where k.r in (b{t}.i, b{t}.j)")
    ends.append(f"select k.clade, c.d::double from k{n - 2} k join c{n - 2} c on c.i = k.r where c.i > c.j")
    return ", ".join(out) + ", e as (" + " union all ".join(ends) + ")"


_register("upgma_clades", upgma_clades, f"with {PRIORITIES}, {sql_linkage_steps(FIVE)} select array_to_string(clade, '+') as clade, round(branch_length, {DIGITS}) as branch_length from e")
_register(
    "nj_paths",
    nj_paths,
    f"with {PRIORITIES}, {sql_joining_steps(FIVE)}, g as (select distinct i as g from square) select x.g as a, y.g as b, round(sum(case when list_contains(clade, x.g) <> list_contains(clade, y.g) then branch_length else 0 end), {DIGITS}) as d from g x join g y on x.g < y.g, e group by all",
)

#: CTEs from the unrooted edges e(clade, branch_length) to f(clade, branch_length): the clades below the middle of the longest path between leaves. ``a`` is the side of an edge
#: that holds the path's first leaf, ``way`` the length from that leaf to the edge; the edge with the middle on it gives a clade on either side.
SQL_MIDPOINT = """g as (select distinct i as g from square), leaves as (select list(g order by g) as every from g),
    sides as (select list_sort(clade) as s, list_filter(every, lambda x: not list_contains(clade, x)) as o, branch_length as w from e, leaves),
    far as (select x.g as p, y.g as q, sum(w) as whole from g x join g y on x.g < y.g join sides on list_contains(s, x.g) <> list_contains(s, y.g) group by all order by whole desc limit 1),
    turned as (select case when list_contains(s, p) then s else o end as a, case when list_contains(s, p) then o else s end as b, w, list_contains(s, q) <> list_contains(s, p) as between_, whole / 2 as half from sides, far),
    placed as (select x.a, x.b, any_value(x.w) as w, any_value(x.between_) as between_, any_value(x.half) as half, coalesce(sum(y.w), 0) as way
               from turned x left join turned y on y.between_ and list_has_all(x.a, y.a) and len(y.a) < len(x.a) group by x.a, x.b),
    f as (select b as clade, w as branch_length from placed where not between_ or way >= half union all select a, w from placed where between_ and way + w < half
          union all select unnest([a, b]), unnest([half - way, way + w - half]) from placed where between_ and way < half and way + w >= half)"""


def sql_tree(n: int) -> str:
    """From the clades f(clade, branch_length) of a rooted tree of n leaves its nodes in preorder and its Newick line; clades are sorted lists of names. A node's place is the list of the least
    leaves of the clades around it."""
    out = ["""nodes as (select clade, branch_length from f union all select list(i order by i), null from (select distinct i from square)),
    around as (select x.clade, any_value(x.branch_length) as branch_length, list(y.clade[1] order by len(y.clade) desc) as place, arg_min(y.clade, len(y.clade)) filter (len(y.clade) > len(x.clade)) as up
               from nodes x join nodes y on list_has_all(y.clade, x.clade) group by x.clade),
    numbered as (select *, (row_number() over (order by place) - 1)::int as node from around),
    text1 as materialized (select clade, clade[1] as text from nodes where len(clade) = 1)"""]
    for k in range(2, n + 1):
        out.append(f"""text{k} as materialized (select * from text{k - 1} union all
               select c.up, '(' || string_agg(t.text || printf(':%.5f', c.branch_length), ',' order by c.clade[1]) || ')' from around c join text{k - 1} t on t.clade = c.clade where len(c.up) = {k} group by c.up)""")
    return ", ".join(out) + f""" select x.node, y.node as parent, round(x.branch_length, {DIGITS}) as branch_length, case when len(x.clade) = 1 then x.clade[1] end as name, t.text || ';' as newick
    from numbered x left join numbered y on y.clade = x.up join text{n} t on len(t.clade) = {n}"""


FOUR = 4
_register("tree_nj", lambda s, d: language_tree(s, d, "nj"), f"with {LANGUAGES}, {SQUARE}, {sql_joining_steps(FOUR)}, {SQL_MIDPOINT}, {sql_tree(FOUR)}")
_register("tree_upgma", lambda s, d: language_tree(s, d, "upgma"), f"with {LANGUAGES}, {SQUARE}, {sql_linkage_steps(FOUR)}, f as (select * from e where len(clade) < {FOUR}), {sql_tree(FOUR)}")
