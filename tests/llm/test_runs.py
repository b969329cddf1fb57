"""Runs of words against the definition, tried period by period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.test_llm import ODD, SF, odd  # noqa: F401
from tidemark.llm import runs


def brute(words, min_length=24, min_exponent=3):
    found, n = [], len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if j > i and len(part) >= max(min_length, min_exponent * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((i, len(part), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    """The contract's row, written plainly."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def made(rng, letters, n):
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 10:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 3 + 1)
            for i in range(a, rng.randrange(a, n + 1)):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize(("length", "exponent"), [(24, 3), (10, 2), (6, 3), (9, 2), (2, 2)])
def test_runs_are_those_of_the_definition(length, exponent):
    rng, total = random.Random(length), 0
    for _ in range(500):
        words = made(rng, rng.choice([1, 2, 3, 50]), rng.randrange(120))
        want = brute(words, length, exponent)
        assert runs.word_runs(np.array(words, np.int64), length, exponent) == want
        total += len(want)
    assert total > 100


def test_runs_of_long_sequences():
    """Periods near a third of the text, nested powers, one word over and over, and the Fibonacci word."""
    assert runs.word_runs(np.arange(60_000) % 20_000) == [(0, 60_000, 20_000)]
    assert runs.word_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert runs.word_runs(np.arange(59_999) % 20_000) == []
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    assert runs.word_runs(np.array(b)) == brute(b)


def test_refinement_takes_the_smaller_parts():
    """No more positions part others, over all levels, than n times the logarithm of n."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2, 1 << 14)
    names = runs.factor_names(words, 8)
    classes, steps = runs.Classes(names, 8, len(words) // 3), 0
    while classes.of and classes.level < classes.last:
        classes.refine()
        steps += sum(map(len, classes.parting)) + 1
    assert steps < len(words) * 14


def test_digest_of_all_documents_and_odd_rows(spark, odd):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Short documents in full; the planted ones among them have runs.
    short = docs.where("length(text) < 3000")
    rows = [tuple(r) for r in runs.run_digest(short).collect()]
    want = [digest(r.doc_id, r.text) for r in short.collect()]
    assert sorted(rows) == sorted(want) and sum(r[1] for r in rows) > 5
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, runs.run_digest(odd).collect()), key=key) == sorted((digest(r.doc_id, r.text) for r in odd.collect()), key=key)
    assert runs.run_digest(odd.limit(0)).count() == 0 and len(ODD) > 5


def test_collapsed_text_keeps_one_period(spark):
    text = "start " + "one two three " * 9 + "end"
    got = runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(1, 27, 3)] and got.collapsed == "start one two three end"
