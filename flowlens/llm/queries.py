"""Registered queries of the corpus operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import chat, decontaminate, divergence, lattice, lines, mixing, near, rollup, search, secrets, sharding, toxicity, urls
from flowlens.llm.common import text_key
from flowlens.session import materialize, prepare, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(
            lambda table: prepare(spark).read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op4_sharding")
def op4(table) -> DataFrame:
    return sharding.place(table("documents"))


@query("op7_mixing")
def op7(table) -> DataFrame:
    return mixing.mix(table("documents"))


SECRETS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
%s),
n AS (SELECT doc_id, text, place, kind, least, hits, groups, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
p AS (SELECT doc_id, text, place, kind, length(hits[i]) AS n, length(groups[i]) AS g, least, length(hits[i]) + length(gaps[i]) AS step, i FROM n),
q AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, text, place ORDER BY i) AS stop FROM p),
s AS (SELECT doc_id, text, place, kind, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM q WHERE g >= least),
t AS (SELECT doc_id, text, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM s GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (doc_id, text)"""


def _rule_sql(place: int, pattern: str, group: int, kind: str, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return (f"SELECT doc_id, text, {place} AS place, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, {p}) AS hits, "
            f"regexp_extract_all(text, {p}, {group}) AS groups, regexp_split_to_array(text, {p}) AS gaps FROM d")


@query("op2_secrets", SECRETS_SQL % " UNION ALL ".join(
    _rule_sql(n, "[0-9a-f]+" if r.kind == "hex" else r.pattern, r.group, r.kind, r.least)
    for n, r in enumerate(secrets.BASE + secrets.MORE)))
def op2(table) -> DataFrame:
    return secrets.report(table("documents"))


LINES_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS all_lines FROM documents),
l AS (SELECT doc_id, text, unnest(range(len(all_lines))) AS i, unnest(all_lines) AS line FROM d),
b AS (SELECT doc_id, text, i, trim(line, ' ') AS t, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) - 1 AS k
  FROM l WHERE trim(line, ' ') <> ''),
w AS (SELECT doc_id, text, k, t || chr(10) || lead(t, 1) OVER z || chr(10) || lead(t, 2) OVER z AS h FROM b WINDOW z AS (PARTITION BY doc_id, text ORDER BY k)),
o AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST, k) AS nth, count(*) OVER (PARTITION BY h) AS times
  FROM w WHERE h IS NOT NULL),
c AS (SELECT doc_id, text, k + j AS k, bool_or(nth = 1) AS kept FROM o, (VALUES (0), (1), (2)) v(j) WHERE times > 1 GROUP BY ALL),
g AS (SELECT b.doc_id, b.text, b.i FROM b JOIN c USING (doc_id, text, k) WHERE NOT kept),
r AS (SELECT l.doc_id, l.text, string_agg(line, chr(10) ORDER BY l.i) AS clean FROM l LEFT JOIN g USING (doc_id, text, i) WHERE g.i IS NULL GROUP BY 1, 2),
x AS (SELECT doc_id, text, count(*) AS gone FROM g GROUP BY 1, 2)
SELECT d.doc_id, coalesce(len(all_lines), 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(clean, '') END) AS clean_sha256
FROM d LEFT JOIN r USING (doc_id, text) LEFT JOIN x USING (doc_id, text)"""


@query("op5_lines", LINES_SQL)
def op5(table) -> DataFrame:
    return lines.dedup_lines(table("documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("clean_sha256"))


@query("op10_near")
def op10(table) -> DataFrame:
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return near.near_duplicates(table("documents"), shingle=3, percent=85).withColumn("kept", kept)


@query("op9_toxicity")
def op9(table) -> DataFrame:
    return toxicity.score(table("documents"), toxicity.learn(table("documents"), table("labels")))


@query("op3_tokens")
def op3(table) -> DataFrame:
    """Three batches and a repeated one: all documents in, later copies out, English recounted with an end mark."""
    docs = table("documents")
    counted = materialize(docs.select("doc_id", "source", "lang", text_key(F.col("text")).alias("key"),
                                      rollup.counter()("text").alias("tokens")))
    first = counted.groupBy("key").agg(F.min("doc_id").alias("first"))
    copies = counted.join(first, "key").where("doc_id <> first").select("source", "lang", "tokens")
    english = counted.join(first, "key").where("doc_id = first and lang = 'en'").select("source", "lang", "tokens")
    totals = rollup.Rollup(docs.sparkSession, f"{work_dir(docs.sparkSession)}/rollup/{uuid.uuid4().hex}")
    version = lambda df, name, sign: df.withColumn("version", F.lit(name)).withColumn("sign", F.lit(sign))
    totals.commit("load", version(counted.select("source", "lang", "tokens"), "byte_bpe_50k", 1))
    totals.commit("copies", version(copies, "byte_bpe_50k", -1))
    totals.commit("recount", version(english, "byte_bpe_50k", -1).unionByName(
        version(english.withColumn("tokens", F.col("tokens") + 1), "byte_bpe_50k+end", 1)))
    totals.commit("copies", version(copies, "byte_bpe_50k", -1))
    return totals.totals()


@query("op8_vectors")
def op8(table) -> DataFrame:
    return lattice.near_vectors(table("embeddings"))


BENCHMARK_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
b AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS run FROM i WHERE len(w) > 0),
s AS (SELECT item_id, w AS words, n, run, a AS place, array_to_string(w[a + 1:a + run], ' ') AS h FROM (SELECT *, unnest(range(n - run + 1)) AS a FROM b)),
total AS (SELECT count(DISTINCT words) AS t FROM s),
f AS (SELECT run, h, round(1000 * ln(1 + (SELECT t FROM total) / count(DISTINCT words)))::BIGINT AS weight FROM s GROUP BY run, h),
d AS (SELECT DISTINCT text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT DISTINCT run FROM s),
p AS (SELECT text, len(w) AS long, run, pos, array_to_string(w[pos + 1:pos + run], ' ') AS h
  FROM (SELECT text, w, run, unnest(range(len(w) - run + 1)) AS pos FROM d, r)),
o AS (SELECT DISTINCT text, p.run, n, greatest(least(pos - place, long - n), 0) AS start FROM p JOIN s USING (run, h)),
c AS (SELECT DISTINCT o.text, o.run, o.n, o.start, p.h FROM o JOIN p ON o.text = p.text AND o.run = p.run
  AND p.pos BETWEEN o.start AND o.start + o.n - o.run),
cw AS (SELECT c.*, coalesce(weight, round(1000 * ln(1 + (SELECT t FROM total)))::BIGINT) AS weight FROM c LEFT JOIN f USING (run, h)),
ct AS (SELECT text, run, n, start, sum(weight) AS total FROM cw GROUP BY ALL),
one AS (SELECT DISTINCT item_id, n, run, h FROM s),
st AS (SELECT item_id, n, run, sum(weight) AS total FROM one JOIN f USING (run, h) GROUP BY ALL),
x AS (SELECT cw.text, cw.run, cw.n, cw.start, item_id, sum(weight) AS both_weight FROM cw JOIN one USING (n, run, h) GROUP BY ALL),
y AS (SELECT x.*, ct.total + st.total - both_weight AS either FROM x JOIN ct USING (text, run, n, start) JOIN st USING (item_id, n, run)),
z AS (SELECT *, row_number() OVER (PARTITION BY text, item_id ORDER BY round(both_weight / either, 9) DESC, start) AS nth
  FROM y WHERE both_weight * 100 >= either * 80)
SELECT doc_id, item_id, start, n AS n_words, round(both_weight / either, 9) AS similarity FROM documents JOIN z USING (text) WHERE nth = 1"""


@query("op6_benchmark", BENCHMARK_SQL)
def op6(table) -> DataFrame:
    return decontaminate.find_benchmark(table("documents"), table("benchmark")).drop("distance")


CHAT_SQL = r"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, text, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS words,
  CASE WHEN turn >= 2 THEN turn // 2 END AS after FROM m WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS asked, turn, text FROM m WHERE role = 'assistant'),
l(conv_id, turn, level) AS (SELECT c.conv_id, c.turn, 0 FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.after WHERE p.turn IS NULL
  UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.after = l.turn),
x AS (SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.turn, a.asked) AS called, c.turn AS call_turn, a.turn AS result_turn, l.level,
  c.text AS query, words, c.after, a.text AS answer,
  CASE WHEN words > 60 THEN 'words: too large' END AS big,
  CASE WHEN c.after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.after)
    THEN c.conv_id || ':' || c.after || ': no such call' END AS lost
  FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.turn = a.asked LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn),
y AS (SELECT *, concat_ws(',', big, lost) AS errors, CASE WHEN call_turn IS NULL THEN 'orphan' WHEN big IS NOT NULL OR lost IS NOT NULL THEN 'invalid'
  WHEN result_turn IS NULL THEN 'open' ELSE 'ok' END AS status FROM x)
SELECT conv_id AS conv, conv_id || ':' || called AS id, level, call_turn, result_turn, status, errors,
  '{"arguments":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE '{' || CASE WHEN after IS NULL THEN '' ELSE '"after":"${' || conv_id || ':' || after || '}",' END
    || '"query":' || to_json(query) || ',"words":' || words || '}' END
  || ',"conversation":' || conv_id || ',"id":"' || conv_id || ':' || called || '","level":' || coalesce(level::VARCHAR, 'null')
  || ',"name":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE '"answer"' END || ',"result":' || coalesce(to_json(answer), 'null')
  || ',"status":"' || status || '"}' AS json FROM y"""


@query("op1_chat", CHAT_SQL)
def op1(table) -> DataFrame:
    return chat.link(*chat.from_dialogue(table("conversations")), chat.DIALOGUE)


AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT g.lang, g.source, k.term, k.n AS everywhere, count(w.doc) AS n FROM g JOIN k USING (lang) LEFT JOIN w USING (lang, source, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT lang, source, term, c.n, 1 + (1000000000::HUGEINT * (c.n + 1)) // (t.n + v.v)::HUGEINT AS p,
  1 + (1000000000::HUGEINT * (everywhere + 1)) // (v.n + v.v)::HUGEINT AS q FROM c JOIN t USING (lang, source) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
y AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM x UNION ALL SELECT * FROM y)
QUALIFY part = 'pair' OR rank <= 200"""


@query("op11_divergence", AUDIT_SQL)
def op11(table) -> DataFrame:
    return divergence.audit(table("documents"))


SEARCH_SQL = r"""
WITH i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS docs, sum(len(terms)) AS words FROM d WHERE len(terms) > 0),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term, docs),
x AS (SELECT item_id, doc_id, row, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * len(terms) * docs) // words)::BIGINT))))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN f USING (term) JOIN d USING (row), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10"""


@query("op12_search", SEARCH_SQL)
def op12(table) -> DataFrame:
    return search.search(table("documents"), table("benchmark"))


#: The rules of the page filter.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op13_urls")
def op13(table) -> DataFrame:
    return urls.judge(table("pages"), URL_RULES)
