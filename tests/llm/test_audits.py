"""Divergence audit, reversed search and URL filter against plain Python and their SQL twins."""

import math
import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connect  # noqa: E402

FOLDER = os.environ.get("FLOWLENS_TABLES", "/root/testdata/sf0.001")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LETTERS, WORDS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string, host string, n long, Term string, rank int, score long"
EXTRA = ("h", 1, "t", 2, 3)
rng = np.random.default_rng(3)
WIDE = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(90)]
TEXTS = [None, "", " .,- ", "One two TWO", "x" * 5000, "ab, " * 40000, *(" ".join(rng.choice(WIDE, 30)) for _ in range(40)), "only here", "ÄÖ äö Ä9b"]
ROWS = [(None if i == 5 else i, t, [None, "en", "en", "de", ""][i % 5], [None, "", "a", "b", "c", "d"][i % 6], *EXTRA) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[8], ROWS[8], ROWS[9], (None, None, None, None, *EXTRA), (90, "alone alone", "xx", "z", *EXTRA), (91, None, "xx", "y", *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", ["op11_divergence", "op12_search"])
def test_sql_twins(spark, name):
    from flowlens.llm.queries import ORACLES, QUERIES
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == ""


def audited(rows, ranks=200):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(LETTERS, (text or "").translate(LOW))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        sources = [s for x, s in groups if x == lang]

        def shares(of, kept=kept):
            total = sum(of[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (of[t] + 1) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t])**2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t])**2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, r) for r, (v, item) in enumerate(found, 1) if part == "pair" or r <= ranks}
    return out


def test_audit(spark, docs, nothing, monkeypatch):
    from flowlens.llm import divergence
    got = [tuple(r) for r in divergence.audit(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(ROWS)
    assert {r for r in got if r[0] == "xx"} == {("xx", "z", "pair", "y", 0, 1), ("xx", "y", "pair", "z", 0, 1)}  # nothing kept
    assert set(map(tuple, divergence.audit(docs, ranks=2).collect())) == audited(ROWS, 2)
    assert divergence.audit(nothing).collect() == []


def test_audit_of_many_blocks(spark, docs, monkeypatch):
    from flowlens.llm import divergence
    monkeypatch.setattr(divergence, "BLOCK_BITS", 2)
    assert set(map(tuple, divergence.audit(docs.repartition(5)).collect())) == audited(ROWS)


def test_tasks_hand_on_when_full(monkeypatch):
    import pyarrow as pa
    from flowlens.llm import divergence
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "ROWS", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(["e", "e", "f"]), pa.array(["s", "s", "s"]), pa.array([b"a b c a", b"d a", b"z"])], names=["l", "s", "t"])
    total = Counter()
    for out in divergence._counted([batch]):
        assert out.num_rows <= 2
        for r in out.to_pylist():
            total[r["lang"], r["term"], "n"] += r["n"]
            total[r["lang"], r["term"], "df"] += r["df"]
    assert total["e", "a", "n"] == 3 and total["e", "a", "df"] == 2 and total["f", "z", "n"] == 1 and total["e", "d", "df"] == 1


def test_galloping_and_prices():
    from flowlens.llm import divergence
    for sizes in ((0, 5), (3, 3), (5, 2000), (900, 4000), (1000, 1000)):
        a, b = (np.sort(rng.choice(5000, n, replace=False)).astype(np.int64) for n in sizes)
        at_a, at_b = divergence.meeting(a, b)
        assert list(a[at_a]) == sorted(set(a.tolist()) & set(b.tolist())) and (a[at_a] == b[at_b]).all()
        na, nb = rng.integers(1, 50, len(a)), rng.integers(1, 50, len(b))
        ta, tb = int(na.sum()) + 5000, int(nb.sum()) + 5000
        ca, cb = dict(zip(a.tolist(), na.tolist())), dict(zip(b.tolist(), nb.tolist()))
        p = [1 + 10**9 * (ca.get(t, 0) + 1) // ta for t in range(5000)]
        q = [1 + 10**9 * (cb.get(t, 0) + 1) // tb for t in range(5000)]
        want = sum((x - y)**2 // y for x, y in zip(p, q)), sum((x - y)**2 // x for x, y in zip(p, q))
        assert divergence.priced(a, na, ta, b, nb, tb, 5000) == want
    big = np.array([10**13], np.int64)
    assert divergence.share(big, 4 * 10**13 + 7)[0] == 1 + 10**9 * (10**13 + 1) // (4 * 10**13 + 7)


def searched(rows, items, top=10):
    texts = [(d, Counter(re.findall(WORDS, (t or "").translate(LOW)))) for d, t, *_ in rows]
    texts = [(d, c) for d, c in texts if c]
    n_docs, words = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    wanted, out = defaultdict(set), []
    for item, text in items:
        wanted[item] |= set(re.findall(WORDS, (text or "").translate(LOW)))
    for item, terms in wanted.items():
        best = []
        for d, c in texts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                best.append((-score, math.inf if d is None else d))
        out += [(item, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(best)[:top], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "One two"), (2, None), (3, ""), (4, "nowhere"), (5, " ".join(WIDE)), (6, "AB ab, Ä9B"), (7, " ".join(WIDE[:3])), (7, WIDE[5]), (None, "here two")]


@pytest.mark.parametrize("limit", [16 << 20, 8])
def test_search(spark, docs, nothing, monkeypatch, limit):
    from flowlens.llm import search
    monkeypatch.setattr(search, "INDEX_BYTES", limit)  # 8: an index for each item
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for top in (10, 3) if limit > 8 else (10,):
        got = sorted((tuple(r) for r in search.search(docs.repartition(4), items, top).collect()), key=str)
        assert got == searched(ROWS, ITEMS, top)
    assert search.search(nothing, items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
CRITICAL = (3.841, 5.991, 7.815, 9.488, 11.070, 12.592)


def judged(rows, rules=RULES, reject=0.75, smoothing=6.0, depth=8, least=3, width=32):
    """The same rule, page by page and branch by branch."""
    def spread(v):
        return sum(x * math.log(x) for x in v if x) - (sum(v) * math.log(sum(v)) if sum(v) else 0)

    def same(a, b):
        both = [x + y for x, y in zip(a, b)]
        kinds = sum(x > 0 for x in both)
        return kinds <= 1 or 2 * (spread(a) + spread(b) - spread(both)) <= CRITICAL[kinds - 2]

    pages = []
    for page, url, *bad in rows:
        _, found, rest = (url or "").partition("://")
        host = re.split(r"[/?#]", rest)[0] if found else ""
        path = re.split(r"[?#]", rest[len(host):])[0] if found else ""
        host = host.translate(LOW)
        fits = [(len(r), r, v) for v, r in rules for d, _, p in [r.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        mark = verdict == "block" if rule else (bad[0] if bad else None)
        form = re.sub(r"(?i)\b(?=[a-f]*[0-9])[0-9a-f]{8,}\b|[0-9]+", "#", path)
        pages.append([page, host, path, rule, verdict, mark, form.split("/")[1:], ""])
    for level in range(min(depth, max((len(p[6]) for p in pages), default=0))):
        nodes = defaultdict(lambda: defaultdict(list))
        for p in pages:
            if len(p[6]) > level:
                nodes[p[1], p[7]][p[6][level]].append(p)
        for (_, node), branches in nodes.items():
            total, groups = sum(map(len, branches.values())), []
            for name, held in sorted(branches.items(), key=lambda x: (-len(x[1]), x[0])):
                if len(held) < least or len(held) * width < total:
                    for p in held:
                        p[7] = f"{node}/*"
                    continue
                marks = [sum(p[5] is True for p in held), sum(p[5] is False for p in held), sum(p[5] is None for p in held)]
                after = [p[6][level + 1] if len(p[6]) > level + 1 else None for p in held]
                kinds = [sum(a is None for a in after), sum(a == "" for a in after), sum(bool(a) and "#" in a for a in after),
                         sum(bool(a) and "#" not in a for a in after)]
                for g in groups:
                    if same(g[1], marks) and same(g[2], kinds):
                        g[0].append(name)
                        g[1], g[2] = [x + y for x, y in zip(g[1], marks)], [x + y for x, y in zip(g[2], kinds)]
                        break
                else:
                    groups.append([[name], marks, kinds])
            for names, *_ in groups:
                label = names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}"
                for name in names:
                    for p in branches[name]:
                        p[7] = f"{node}/{label}"
    held = defaultdict(list)
    for p in pages:
        p[7] += "/**" if len(p[6]) > depth else ""
        held[p[1], p[7]] += [p[5]] if p[5] is not None else []
    low = {k for k, v in held.items() if (sum(v) + smoothing * 0.5) / (len(v) + smoothing) >= reject}
    return sorted(((p[0], p[1], p[2], p[3], p[4] or ("block" if (p[1], p[7]) in low else "allow")) for p in pages), key=str)


def planted_urls():
    urls = [None, "", "no scheme/x", "http://", "http://HOST.Example.COM", "x://a://b/c", "http://a.net/es/", "http://net/fr/1?x=1", "http://NET",
            "https://example.com/en/", "http://www.example.com/en/1", "http://m.www.example.com/en/é#f", "http://badexample.com/en/",
            "http://deep.org/" + "/".join("abcdefghijklm"), "http://deep.org/" + "z/" * 3000, "http://s.org/a/*/{b|c}", "http://s.org//", "http://q.net?x=/es/"]
    urls += [f"http://shop.org/item/{i}" for i in range(40)] + [f"http://shop.org/user/n{i}x/{k}" for i in range(25) for k in ("posts", "likes")]
    urls += [f"https://mix.net/{'en de es fr'.split()[i % 4]}/{i}{'.html' if i % 3 else '/'}" for i in range(200)]
    urls += [f"https://few.net/{'en es'.split()[i % 2]}/{i}" for i in range(4)] + [f"https://hex.org/f/{i:08x}a" for i in range(9)]
    return urls


def test_urls(spark):
    from flowlens.llm import urls
    schema = "page_id long, url string, host string, verdict string, bad boolean"
    plain = [(i if i != 30 else None, u) for i, u in enumerate(planted_urls())] + [(3, "http://shop.org/item/1"), (3, "http://shop.org/item/1")]
    pages = spark.createDataFrame([(*r, "x", "y", None) for r in plain], schema)
    assert sorted(map(tuple, urls.judge(pages, RULES).collect()), key=str) == judged(plain)
    # labelled pages: one branch of a host is bad, and what is said of its labelled pages holds for the others
    marked = [(i, f"http://club.org/{a}/{i}", (a == "spam") if i % 2 else None) for i in range(120) for a in ("spam", "news", "blog")]
    marked += [(i, u, None) for i, u in plain]
    got = sorted(map(tuple, urls.judge(spark.createDataFrame([(i, u, "x", "y", m) for i, u, m in marked], schema), RULES, bad_col="bad").collect()), key=str)
    assert got == judged(marked)
    club = [r for r in got if r[1] == "club.org"]
    assert {r[4] for r in club if "/spam/" in r[2]} == {"block"} and {r[4] for r in club if "/spam/" not in r[2]} == {"allow"}
    for options in ({"depth": 1}, {"width": 2, "least": 1}, {"reject": 0.3, "smoothing": 1.0}):
        assert sorted(map(tuple, urls.judge(pages, RULES, **options).collect()), key=str) == judged(plain, **options)
    assert urls.judge(pages.limit(0), RULES).collect() == [] and urls.judge(pages, []).where("verdict <> 'allow'").collect() == []


def test_templates(spark):
    from flowlens.llm import urls
    marked = [(f"/{a}/{i}", int(a == "spam"), int(a != "spam")) for i in range(50) for a in ("spam", "news", "blog")] + [(f"/u{'x' * i}", 0, 0) for i in range(60)]
    found = urls.templates(spark.createDataFrame([("h", *m) for m in marked], "host string, path string, bad int, good int"))
    assert {r["node"]: r["n"] for r in found.groupBy("node").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()} == \
        {"/spam/#": 50, "/{blog|news}/#": 100, "/*": 60}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_urls_of_the_table(spark):
    from flowlens.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()]
    assert sorted(map(tuple, QUERIES["op13_urls"](spark, FOLDER).collect()), key=str) == judged(rows)
    plan = QUERIES["op13_urls"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
