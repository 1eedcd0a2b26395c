"""URL filtering with redirect equivalence.

Rules judge a url by host and path. Pages that no rule fits take part in their aliases' fate:
redirects (``<meta http-equiv=refresh>``) and canonical links (``<link rel=canonical>``) are edges
between url keys, connected components over them are classes of aliases, and a class that a block
rule reaches is blocked, unless an explicit allow rule reaches it too: allow goes before block.
A page's own rule always goes before what it gets from its class.

Everything is built-in DataFrame functions. The rules are a literal list, bounded by MAX_RULES.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, lookup_join, spool
from .components import connected_components

MAX_RULES = 1000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the contract.
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]

LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
META_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
#: Names of characters that stand in urls.
NAMED = {"amp": "&", "colon": ":", "sol": "/", "period": ".", "quest": "?", "equals": "=", "num": "#", "lowbar": "_", "percnt": "%", "commat": "@", "plus": "+", "comma": ",", "semi": ";"}
REFERENCE = r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|" + "|".join(NAMED) + ");"
GOES_TO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def part(url: Column, pattern: str) -> Column:
    """The first group of ``pattern`` right after the first ``://``; empty for null or without it."""
    return F.coalesce(F.regexp_extract(url, rf"(?s)^.*?://{pattern}", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(part(url, r"([^/?#]*)"))


def path_of(url: Column) -> Column:
    return part(url, r"[^/?#]*([^?#]*)")


def key_of(url: Column) -> Column:
    """The name of a url among its aliases: host, path and query; scheme and fragment don't count. Empty without a host."""
    host = host_of(url)
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, part(url, r"[^/?#]*([^#]*)")))


def best_rule(host: Column, path: Column, rules: list[Rule] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Of equally long ones an allow
    goes first, then the greater text."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; rules are a literal in the plan and end at {MAX_RULES}")
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(
                F.lit(len(r.host + r.path)).alias("n"),
                F.lit(int(r.verdict == "allow")).alias("first"),
                F.lit(r.host + r.path).alias("rule"),
                F.lit(r.verdict).alias("verdict"),
            ),
        )
        for r in rules
    ]
    if not fits:
        return F.lit(None).cast("struct<n:int,first:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def decoded(text: Column) -> Column:
    """``text`` with its character references replaced in one pass: decimal, hexadecimal, and the names that stand in urls."""
    refs = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    number = lambda r: F.when(r.rlike("^&#[xX]"), F.conv(F.regexp_extract(r, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(r, "^&#([0-9]+)", 1)).try_cast("int")
    named = F.create_map(*[F.lit(x) for k, v in NAMED.items() for x in (f"&{k};", v)])
    sound = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    char = lambda r: F.coalesce(F.try_element_at(named, r), F.when(sound(number(r)), F.decode(F.unhex(F.lpad(F.hex(number(r)), 8, "0")), "UTF-32")), F.lit("\ufffd"))
    parts = F.zip_with(F.split(text, REFERENCE, -1), F.transform(refs, char), lambda piece, c: F.concat(piece, F.coalesce(c, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments, as links are resolved (RFC 3986)."""
    ended = F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/")
    steps = F.slice(F.split(ended, "/", -1), 2, 1 << 30)
    none = F.array().cast("array<string>")
    walked = F.aggregate(steps, none, lambda held, s: F.when(s == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(s == ".", held).otherwise(F.concat(held, F.array(s))))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(path)


def resolve(target: Column, url: Column) -> Column:
    """An absolute url for a link's target as written on the page ``url``."""
    page = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(part(url, r"[^/?#]*([^?#]*/)"), F.lit("")), F.lit("/"))
    whole = (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("any:"), target))
        .when(target.startswith("/"), F.concat(page, target))
        .when(target.startswith("?"), F.concat(page, path_of(url), target))
        .when(target.startswith("#"), url)
        .otherwise(F.concat(page, folder, target))
    )
    return F.concat(F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1), without_dots(path_of(whole)), F.regexp_extract(whole, r"(?s)^.*?://[^?#]*(.*)$", 1))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): url keys that the redirects and canonical links of ``pages(url, html)`` tie together: all of a page's, but those in comments, with their character references
    decoded and relative ones resolved."""
    html = F.regexp_replace("html", COMMENT, "")
    of = lambda tag, place: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, place, 1))
    links = pages.where("html is not null").select("url", F.explode(F.array_distinct(F.concat(of(LINK_TAG, HREF), of(META_TAG, GOES_TO)))).alias("to")).where("to <> ''")
    links = links.select("url", resolve(decoded(F.col("to")), F.col("url")).alias("to"))
    return links.select(key_of(F.col("url")).alias("a"), key_of(F.col("to")).alias("b")).where("a <> '' and b <> ''")


def filter_urls(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Judge every row of ``pages(page_id, url, html)``: page_id, host, path, rule, verdict, via.

    ``via`` says what decided: ``rule``, ``alias`` (the class of aliases) or ``default`` (allow).
    A null url, or one without ``://``, has an empty host and path and is allowed by default. Null
    html has no links. Repeated rows are judged alike, one result each; other columns are ignored.
    An empty table gives an empty result.
    """
    classes = spool(connected_components(alias_edges(pages)), "classes")
    ruled = classes.withColumn("r", best_rule(F.regexp_extract("node", r"^[^/?]*", 0), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1), rules))
    fate = ruled.groupBy("component").agg(F.bool_or(F.col("r.verdict") == "allow").alias("freed"), F.bool_or(F.col("r.verdict") == "block").alias("hit"))
    blocked = fate.where("hit and not coalesce(freed, false)").select("component")
    # Classes that are blocked, and the pages that name them, by sizes checked: a class or a url may have any number of rows.
    aliases = lookup_join(classes, spool(blocked, "blocked"), "component", "inner").select(F.col("node").alias("key"), F.lit(True).alias("hit"))
    aliases = spool(aliases, "aliases")

    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.nullif(key_of(url), F.lit("")).alias("key"))
    judged = lookup_join(judged, aliases, "key").withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"),
        F.when(F.col("r").isNotNull(), "rule").when(F.col("hit"), "alias").otherwise("default").alias("via"),
    )


def oracle(rules: list[Rule] = RULES) -> str:
    """The same judgement in DuckDB SQL, with a recursive closure for the classes. It reads the first canonical link and the first redirect of a page, without dot
    segments, comments and character references but for ``&amp;``; those are held against plain Python."""
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.host + r.path}')" for r in rules)
    link, href, meta, goes = (x.replace("'", "''") for x in (LINK_TAG, HREF, META_TAG, GOES_TO))
    lower = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "case when position('://' in coalesce({0}, '')) > 0 then substr({0}, position('://' in {0}) + 3) else '' end"
    key = f"case when {lower} = '' then '' else {lower} || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) end"
    folder = "regexp_extract(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '^(.*/)', 1)"
    fit = "(n.host = r.host or ends_with(n.host, '.' || r.host)) and starts_with(n.path, r.path)"
    best = f"(select struct_pack(rule := r.rule, verdict := r.verdict) from rules r where {fit} order by length(r.rule) desc, r.verdict, r.rule desc limit 1)"
    return f"""
    with recursive rules(verdict, host, path, rule) as (values {values}),
    p as (select page_id, url, html, {rest.format("url")} as rest from pages),
    judged as (select page_id, url, html, rest, {lower} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, {key} as key from p),
    targets as (
      select *, unnest([regexp_extract(regexp_extract(coalesce(html, ''), '{link}'), '{href}', 1),
                        regexp_extract(regexp_extract(coalesce(html, ''), '{meta}'), '{goes}', 1)]) as t from judged),
    links as (
      select key as a, replace(t, '&amp;', '&') as t, regexp_extract(url, '^(.*?)://', 1) as scheme,
             regexp_extract(rest, '^[^/?#]*') as h, {folder} as folder from targets where t <> ''),
    resolved as (
      select a, case when contains(t, '://') then t when starts_with(t, '//') then 'any:' || t
                     when starts_with(t, '/') then scheme || '://' || h || t
                     else scheme || '://' || h || case when folder = '' then '/' else folder end || t end as u from links),
    ends as (select a, {rest.format("u")} as rest from resolved),
    edges as (select a, {key} as b from ends where a <> ''),
    tied as (select * from edges where b <> '' and a <> b),
    both_ways as (select a, b from tied union select b, a from tied),
    reach(a, b) as (select a, a from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
    nodes as (select distinct a as node, regexp_extract(a, '^[^/?]*') as host, regexp_extract(a, '^[^/?]*([^?]*)', 1) as path from both_ways),
    ruled as (select node, {best}.verdict as v from nodes n),
    hits as (select reach.a as key from reach join ruled on reach.b = ruled.node group by reach.a
             having bool_or(coalesce(v = 'block', false)) and not bool_or(coalesce(v = 'allow', false)))
    select page_id, host, path, b.rule as rule,
           coalesce(b.verdict, case when hit then 'block' else 'allow' end) as verdict,
           case when b.rule is not null then 'rule' when hit then 'alias' else 'default' end as via
    from (select n.page_id, n.host, n.path, n.key in (select key from hits) as hit, {best} as b from judged n)
    """
