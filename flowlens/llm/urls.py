"""URL filter: per host a tree of path templates, judged by the labelled pages below them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path of a URL: behind the first ``://``, up to the query or fragment.
PARTS = r"://([^/?#]*)([^?#]*)"
#: Tokens that vary by their form alone: numbers and long hexadecimal names.
TOKEN = r"(?i)\b(?=[a-f]*[0-9])[0-9a-f]{8,}\b|[0-9]+"
#: Chi-square values that one in twenty equal pairs exceeds, for one to six degrees of freedom.
CRITICAL = (3.841, 5.991, 7.815, 9.488, 11.070, 12.592)
#: Copies of a rejected template, among which the pages of a frequent one are dealt.
SALTS = 16


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(rules: list[tuple[str, str]], name: Column, below: Column) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, NULL without one; ``rules`` is a short list, compiled into one CASE."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one is asked first
        domain, _, start = rule.partition("/")
        fits = ((name == domain) | name.endswith(f".{domain}")) & below.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _spread(counts: Column) -> Column:
    """Sum of n ln n less the total's: the part of a G statistic that one row of a table gives."""
    log = lambda n: F.when(n > 0, n * F.ln(n)).otherwise(0.0)
    total = F.aggregate(counts, F.lit(0.0), lambda a, n: a + n)
    return F.aggregate(counts, F.lit(0.0), lambda a, n: a + log(n)) - log(total)


def _same(a: Column, b: Column) -> Column:
    """Two rows of counts do not differ significantly (G test on the kinds that occur)."""
    both = F.zip_with(a, b, lambda x, y: x + y)
    kinds = F.size(F.filter(both, lambda n: n > 0))
    limit = F.element_at(F.array(F.lit(0.0), *(F.lit(c) for c in CRITICAL)), F.greatest(kinds, F.lit(1)))
    return (kinds <= 1) | (2 * (_spread(a) + _spread(b) - _spread(both)) <= limit)


def _merged(branches: Column) -> Column:
    """Groups of branches, heaviest first: each joins the first group that it does not differ from, else it opens one."""
    start = F.array().cast("array<struct<names:array<string>,marks:array<double>,next:array<double>>>")

    def place(groups, x):
        fitting = F.transform(groups, lambda g: _same(g["marks"], x["marks"]) & _same(g["next"], x["next"]))
        at = F.array_position(fitting, F.lit(True))
        grown = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.struct(
            F.concat(g["names"], F.array(x["name"])).alias("names"), F.zip_with(g["marks"], x["marks"], lambda m, n: m + n).alias("marks"),
            F.zip_with(g["next"], x["next"], lambda m, n: m + n).alias("next"))).otherwise(g))
        alone = F.concat(groups, F.array(F.struct(F.array(x["name"]).alias("names"), x["marks"].alias("marks"), x["next"].alias("next"))))
        return F.when(at > 0, grown).otherwise(alone)

    return F.aggregate(branches, start, place)


def _grown(state: DataFrame, level: int, least: int, width: int) -> DataFrame:
    """Templates one segment longer: a frequent segment or its merged group stays, any other becomes ``*``."""
    name = F.get("segments", F.lit(level))
    after = F.get("segments", F.lit(level + 1))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("double")
    number = after.contains("#")
    children = state.where(name.isNotNull()).groupBy("host", "node", name.alias("name")).agg(
        F.sum("n").alias("n"),
        F.array(F.sum("bad").cast("double"), F.sum("good").cast("double"), F.sum(F.col("n") - F.col("bad") - F.col("good")).cast("double")).alias("marks"),
        F.array(count(after.isNull()), count(after == ""), count(number), count((after != "") & ~number)).alias("next"))
    totals = children.groupBy("host", "node").agg(F.sum("n").alias("total"))
    kept = children.where(F.col("n") >= least).join(totals, ["host", "node"]).where(F.col("n") * width >= F.col("total"))
    groups = kept.groupBy("host", "node").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "name", "marks", "next"))).alias("all"))
    label = F.when(F.size("names") == 1, F.col("names")[0]).otherwise(F.concat(F.lit("{"), F.array_join(F.array_sort("names"), "|"), F.lit("}")))
    names = groups.select("host", "node", F.explode(_merged(F.col("all"))["names"]).alias("names")) \
        .select("host", "node", label.alias("label"), F.explode("names").alias("name"))
    grown = F.when(name.isNull(), F.col("node")).otherwise(F.concat_ws("/", "node", F.coalesce("label", F.lit("*"))))
    return state.withColumn("name", name).join(names, ["host", "node", "name"], "left").withColumn("node", grown).drop("name", "label")


def templates(pages: DataFrame, depth: int = 8, least: int = 3, width: int = 32) -> DataFrame:
    """(host, form, node, n, bad, good) for pages (host, path, bad, good): the template ``node`` of every form of path.

    1. Numbers and long hexadecimal names in a path become ``#``; paths of one
       form are counted together, so a host's pages shrink before any shuffle.
    2. The tree grows a segment at a time. A segment stays as it is if it has
       ``least`` pages and one in ``width`` of its parent's, so a node has at
       most ``width`` such branches; the others are its wildcard.
    3. Branches of a node merge if neither their labels (bad, good, none) nor
       what follows them (end, slash, number, name) differ significantly.

    Segments beyond ``depth`` are the template's ``**``.
    """
    form = F.regexp_replace("path", TOKEN, "#")
    forms = pages.groupBy("host", form.alias("form")).agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    cut = F.split("form", "/", -1)
    state = materialize(forms.withColumn("segments", F.slice(cut, F.lit(2), F.size(cut))).withColumn("node", F.lit("")))
    levels = state.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(min(levels, depth)):
        state = materialize(_grown(state, level, least, width))
    return state.withColumn("node", F.when(F.size("segments") > depth, F.concat("node", F.lit("/**"))).otherwise(F.col("node"))).drop("segments")


def purities(found: DataFrame, smoothing: float = 6.0, prior: float = 0.5) -> DataFrame:
    """(host, node, n, bad, good, purity): share of bad among a template's labelled pages, drawn towards ``prior`` by ``smoothing`` pages."""
    return found.groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "good"))).withColumn(
        "purity", (F.col("bad") + F.lit(smoothing * prior)) / (F.col("bad") + F.col("good") + smoothing))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", bad_col: str | None = None,
          reject: float = 0.75, smoothing: float = 6.0, depth: int = 8, least: int = 3, width: int = 32) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each page.

    ``rules`` are (``allow`` or ``block``, host/path prefix); the longest one
    that fits a page decides it. All other pages are judged by their host's
    path template (`templates`): it is rejected if the smoothed purity of its
    labelled pages (`purities`) reaches ``reject``. Labels are the rules'
    verdicts and, for other pages, the boolean ``bad_col`` where it is not NULL.
    Purity is drawn towards one half, whatever the labels elsewhere, so a
    template without labelled pages is allowed, and six bad pages and no good
    one are needed to reject.

    NULL urls and those without ``://`` have an empty host and path, one
    template for all of them. Repeated rows count as often as they occur and
    stay. Long urls are read whole; ``depth`` is the longest template. Equal
    counts of branches go by name. Empty tables give no rows; other columns,
    the page texts among them, are not read.
    """
    url = F.col("__url")
    mark = F.col(bad_col).cast("boolean") if bad_col else F.lit(None).cast("boolean")
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__url"), mark.alias("__bad")) \
        .select("page_id", host(url).alias("host"), path(url).alias("path"), "__bad")
    ruled = named.withColumn("__rule", longest_rule(rules, F.col("host"), F.col("path")))
    bad = F.coalesce(F.col("__rule.verdict") == "block", F.col("__bad"))
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    found = materialize(templates(ruled.select("host", "path", one(bad).alias("bad"), one(~bad).alias("good")), depth, least, width))
    low = purities(found, smoothing).where(F.col("purity") >= reject).select("host", "node")
    gone = found.join(low, ["host", "node"]).select("host", "form", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("gone"))
    rows = ruled.withColumn("form", F.regexp_replace("path", TOKEN, "#")).withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    same = functools.reduce(lambda a, b: a & b, (rows[c] == gone[c] for c in ("host", "form", "salt")))
    # pages that a rule decides have no key, so they join nothing
    method = F.when(F.col("gone"), "block").otherwise("allow")
    return rows.join(gone, same & rows["__rule"].isNull(), "left").select(
        "page_id", rows["host"], "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), method).alias("verdict"))
