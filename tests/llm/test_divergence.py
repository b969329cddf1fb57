"""The audit of sources against DuckDB and against plain counting."""

import re
from collections import Counter, defaultdict

import duckdb

from tests.llm.test_llm import SF, odd  # noqa: F401
from tidemark.llm import divergence


def brute(rows, least=10, top=10):
    """From (text, lang, source) rows, term by term."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in rows):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang, source))
        n[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, d in docs[lang].items() if d >= least]
        sources = [s for g, s in groups if g == lang]
        total = lambda counts: sum(counts[t] for t in kept) + 2 * len(kept)
        whole = sum((n[lang, s] for s in sources), Counter())
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 2) // total(n[lang, s]) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (whole[t] + 2) // total(whole) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(sum(f(p[source][t], p[s][t]) for t in kept), s) for s in sources if s != source]
        terms = [(f(p[source][t], q[t]), t) for t in kept if n[lang, source][t] and p[source][t] > q[t]]
        order = lambda x: (-x[0], x[1].encode())
        for part, found in (("pair", sorted(pairs, key=order)), ("term", sorted(terms, key=order)[:top])):
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def test_audit_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(divergence.ORACLE_SQL).fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, divergence.audit_sources(docs).collect()))
    assert got == want and len(got) > 500
    assert got == brute([(r.text, r.lang, r.source) for r in docs.collect()])


def test_audit_of_odd_rows(spark, odd):  # noqa: F811
    """Nulls, repeated rows, groups without terms, a language that keeps nothing, extra columns, an empty table."""
    for least in (1, 2, 10):
        got = sorted(map(tuple, divergence.audit_sources(odd, min_documents=least).collect()))
        assert got == brute([(r.text, r.lang, r.source) for r in odd.collect()], least)
    assert divergence.audit_sources(odd.limit(0)).count() == 0


def test_counts_beyond_64_bits(spark):
    """A share is exact where a thousand million times the count has no 64-bit number."""
    n, total = 4 * 10**17 + 7, 9 * 10**17 + 11
    df = spark.createDataFrame([(n, total, 1000)], "n long, total long, terms long")
    assert df.select(divergence.share(df.n, df.total, df.terms)).first()[0] == 1 + 10**9 * (n + 2) // (total + 2000)


def test_joint_histogram_counts_every_term_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = divergence.kept_terms(divergence.term_counts(docs)).cache()
    groups = divergence.group_sizes(docs, kept)
    cells = divergence.joint_histograms(kept, groups).groupBy("lang", "a", "b").sum("times").collect()
    terms = {r.lang: r.terms for r in groups.collect()}
    assert cells and all(r[3] == terms[r.lang] for r in cells)


def test_tasks_send_counts_on_when_they_hold_many(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    want = sorted(map(tuple, divergence.term_counts(docs).collect()))
    monkeypatch.setattr(divergence, "HELD_TERMS", 100)
    assert sorted(map(tuple, divergence.term_counts(docs).collect())) == want
