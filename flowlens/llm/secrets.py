"""Secret scan: a trigram inverted index proposes texts for each rule, the rule's pattern verifies them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import text_key
from flowlens.llm.trigrams import trigram_query
from flowlens.session import materialize


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int       #: characters that the group must have
    group: int = 0


#: Order breaks ties between spans with equal starts.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # the runs of [0-9a-f]+ that are long enough
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("hub", r"gh[oprsu]_[A-Za-z0-9]{36,}", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
)


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key) of the given trigrams over (key, text); only trigrams that some rule asks for are posted."""
    low = docs.select("key", F.explode(F.array(F.lower("text"))).alias("low"))  # a generated column is computed once
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, asks: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, kinds): the texts that satisfy a rule's query, by intersecting the postings of each clause."""
    rows = [(kind, n, t, len(clause)) for kind, clauses in asks.items() for n, clause in enumerate(clauses) for t in sorted(clause)]
    clauses = postings.sparkSession.createDataFrame(rows, "kind string, clause int, trigram string, need int")
    return postings.join(F.broadcast(clauses), "trigram").distinct() \
        .groupBy("key", "kind", "clause", "need").count().where("count = need") \
        .groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _matches(text: Column, rule: Rule, wanted: Column) -> Column:
    """Array of (kind order, number, length of the gap before, length, length of the group) of the matches."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    lengths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    groups = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else lengths
    rows = F.transform(F.arrays_zip(lengths.alias("n"), gaps.alias("gap"), groups.alias("g")), lambda x, i: F.struct(
        i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), x["g"].alias("g")))
    return F.when(wanted & F.rlike(text, pattern), F.filter(rows, lambda x: x["n"].isNotNull()))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every row: ``doc_id``, ``found`` = array of (start, place, kind, end), sorted.

    Offsets are code points, ends exclusive; ``place`` is the rule's place in
    the list. Per rule the matches are leftmost and non-overlapping; those
    whose group is shorter than the rule's least length are dropped.

    1. Each rule's pattern gives a Boolean trigram query (`trigram_query`).
       The trigrams of all queries form the index: one pass over the texts
       posts which of them a text holds, as a table in the shared folder.
    2. Postings of a clause are intersected by counting per text; a text of
       any full clause is the rule's candidate.
    3. The pattern runs on candidates alone. Rules whose pattern asks for no
       trigram run on all texts.

    Texts are known by SHA-256, so copies count once in the index and in the
    spans, and a text that a third of all rows share meets one row in each
    join. NULL texts count as empty and hold nothing; a NULL or repeated id is
    returned as it is, one row per input row. Other columns are not read.
    """
    base = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")) \
        .withColumn("key", text_key(F.col("text")))
    asks = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in asks.items() if q}
    trigrams = sorted({t for q in indexed.values() for clause in q for t in clause})
    texts = base.select("key", "text")
    if indexed:
        postings = materialize(index(texts, trigrams))
        texts = texts.join(candidates(postings, indexed), "key", "left")
    wanted = lambda r: F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if asks[r.kind] else F.lit(True)
    each = F.array(*(F.struct(F.lit(n).alias("place"), _matches(F.col("text"), r, wanted(r)).alias("rows")) for n, r in enumerate(rules)))
    hits = texts.select("key", F.explode(each).alias("x")).where("x.rows is not null") \
        .select("key", "x.place", F.explode("x.rows").alias("m")).select("key", "place", "m.*") \
        .dropDuplicates(["key", "place", "i"])
    line = Window.partitionBy("key", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("place") + 1)
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("place") + 1)
    spans = hits.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(line)).where(F.col("g") >= least) \
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct(
            (F.col("end") - F.col("n")).alias("start"), "place", kind.alias("kind"), "end"))).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    return base.select("doc_id", "key").join(spans, "key", "left") \
        .select("doc_id", F.coalesce("found", empty).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Counts and spans of every row: base kinds counted and digested, all kinds listed."""
    found = scan(docs, BASE + tuple(more))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["place"] < len(BASE))
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
