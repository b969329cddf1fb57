"""Cases that once went wrong: vectors of any size, clashing columns, fields and texts of any length."""

import itertools
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import SF
from tidemark.llm import mixing, pii, quality, simhash, urls, vector_dedup


def test_vectors_of_any_size_link_by_their_direction(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [1e-200, 0.0]), (4, [2e-200, 1e-205]), (5, [1.0, 0.0]), (6, [0.0, 1e200]), (7, [0.0, 3e-310]), (8, [1e308, 1e308]), (9, [1.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.dedup_vectors(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i] for i in range(1, 6)] == [(4, 1)] * 5 and got[6] == got[7] == (1, 6) and got[8] == got[9] == (1, 8)


CLASHING = ("keep_id", "keep_fp", "__fp", "__rank", "copies", "component", "none", "least", "__key", "__copy", "__KEY", "size", "row", "taken", "finish", "target")


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").unionByName(spark.createDataFrame([(None, "none", "en", "s", 4), (3, "again", None, None, 5), (3, "again", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    return docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHING])


def test_columns_of_the_callers_stay_theirs(spark, clashing):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        for stage in (simhash.keep_one, mixing.mixed_documents):
            out = stage(clashing)
            assert out.columns == clashing.columns
            rows = out.collect()
            assert rows and all(r[c] == f"mine {c}" for r in rows for c in CLASHING)
            plain = stage(clashing.select("doc_id", "text", "lang", "source", "n_chars"))
            assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(r.doc_id), str(r.text)) for r in plain.collect())
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_repeats_of_many_addresses_take_one_pass():
    text = " ".join(f"user.{i}@mail{i}.example.com" for i in range(20_000)) + " and user.7 or user.19999. but not user.7x, xuser.7 or user.20000"
    began = time.process_time()
    found = [text[n["start"] : n["end"]] for n in pii.mentions(text, pii.base_spans(text)) if n["features"][1:2] == ["mail_local"]]
    # Each address also begins with its own local part, which the base span covers.
    assert sorted(x for x in found[20_000:]) == ["user.19999", "user.7"] or found[-2:] == ["user.7", "user.19999"]
    assert time.process_time() - began < 20


def test_repeats_are_those_of_the_alternation():
    """Against one pattern of all local parts, longest first."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        words = ["".join(rng.choice(list("ab1._-@ %"), size=rng.integers(1, 7))) for _ in range(30)]
        text = " ".join([*words, "a.1@x.io", "b_1@x.io", "1.a.b@x.io", "a-b@y.io."])
        base = pii.base_spans(text)
        seen = {text[a:b].partition("@")[0].lower() for k, a, b in base if k == "email"}
        seen = {x for x in seen if any(c.isdigit() or c in "._-" for c in x) and any(c.isalnum() for c in x)}
        pattern = re.compile(r"(?<![\w.%+@-])(?:" + "|".join(map(re.escape, sorted(seen, key=lambda x: (-len(x), x)))) + r")(?![\w%+@-])")
        want = {m.span() for m in pattern.finditer(text)} if seen else set()
        got = {(n["start"], n["end"]) for n in pii.mentions(text, base) if "mail_local" in n["features"]}
        mails = {(a, b) for k, a, b in base}
        assert got == want - mails, text


def test_beliefs_of_fields_without_loops_are_exact():
    """Sum-product against the sum over all labellings."""
    rng = np.random.default_rng(2)
    k = len(pii.LABELS)
    for n in (1, 2, 3, 4):
        for _ in range(5):
            weights = rng.normal(0, 1, (len(pii.FEATURES), k))
            nodes = [{"start": 10 * i, "end": 10 * i + 5, "clamp": None, "features": [pii.FEATURES[j] for j in rng.integers(0, len(pii.FEATURES), 2)], "keys": []} for i in range(n)]
            own = np.array([weights[[pii.FEATURES.index(f) for f in x["features"]]].sum(axis=0) for x in nodes])
            unary = np.clip(own - own[:, :1], *pii.UNARY_RANGE)
            exact = np.zeros((n, k))
            for labels in itertools.product(range(k), repeat=n):
                agree = sum(pii.CHAIN_WEIGHT for a, b in itertools.pairwise(labels) if a == b and a)
                p = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + agree)
                for i, y in enumerate(labels):
                    exact[i, y] += p
            exact /= exact.sum(axis=1, keepdims=True)
            assert np.abs(pii.infer(nodes, weights, rounds=200) - exact).max() < 1e-3


def test_quality_is_a_quadratic_discriminant_of_its_own_moments():
    """Scores against the densities of two normal laws, written plainly."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    y = (rng.random(400) < 0.3).astype(int)
    x[y == 1] = x[y == 1] * 1.7 + 0.5
    n, sums = np.bincount(y).astype(float), np.stack([x[y == c].sum(axis=0) for c in (0, 1)])
    model = quality.fit(n, sums, np.stack([x[y == c].T @ x[y == c] for c in (0, 1)]))
    pooled, odds = np.cov(x.T, bias=True), []
    for c in (0, 1):
        cov = (1 - quality.POOLED_SHARE) * np.cov(x[y == c].T, bias=True) + quality.POOLED_SHARE * pooled
        cov = (1 - quality.DIAGONAL_SHARE) * cov + quality.DIAGONAL_SHARE * np.diag(np.diag(cov))
        cov += (quality.RIDGE + 0.01 * np.trace(cov) / 4) * np.eye(4)
        d = x - x[y == c].mean(axis=0)
        odds.append(np.log((n[c] + 1) / 402) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(odds[0] - odds[1])), atol=1e-9)


def test_the_held_out_fold_teaches_nothing(spark):
    """Labels of that fold turned around change no score."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda given: sorted((r.doc_id, round(r.score, 9)) for r in quality.score_documents(docs, given).collect())
    assert labels.where(held).count() > 20 and score(labels) == score(turned)


def test_the_built_in_table_is_made_by_rule():
    """As many sites a topic, and every qualifier on both sides alike."""
    table = urls.labelled_urls()
    assert len(table) == 2 * len(urls.QUALIFIERS) * (len(urls.UNWANTED_TOPICS) + len(urls.ORDINARY_TOPICS)) == len(set(table))
    for q in urls.QUALIFIERS:
        share = [sum(q in re.split(r"[.-]", u) for u, y in table if y == label) / sum(y == label for _, y in table) for label in (0, 1)]
        assert abs(share[0] - share[1]) < 1e-9
