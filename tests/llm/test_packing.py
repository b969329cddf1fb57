"""Packing: ids against the library's own, the plan against its definition, the whole query against both."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_llm import ODD, SF, odd  # noqa: F401
from tidemark.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)
STRANGE = [
    "x\x1cy \x0b\x0cz", "<|endoftext|>x<|startoftext|> y<|endoftext|>", "İstanbul ΣΑΣ ΑΣ", "é é ñ ñ", "日本語 ünïcode 🦙🦙 ½ ², ª º µ × ÷", "don't I'LL WE'RE 'S's",
    "Ǆ ǅ ß ẞ ſ ŉ ŀ ΐ", "a\u0085b c", "﻿x", "1234 12.5 $$$###", "x ́y", "\x00\x01 a\x00b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, packing.END]


def test_ids_are_the_librarys(spark, library):
    rng, letters = random.Random(3), "aAzZ'sé Éß'\t\n1.$<|> ́\x1cΣİ"
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD + STRANGE
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    own = packing.WordEncoder(PATH, held=500)
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids_of(library, t)[:-1], t[:80]


def sequences(plan, histogram):
    """The items of each sequence, by offset."""
    places, out = defaultdict(list), defaultdict(list)
    for n, *rest in plan.places:
        places[n].append(rest)
    for n, count in histogram.items():
        rows = sorted(places[n])
        for (first, sequence, offset, each), end in zip(rows, [*[r[0] for r in rows[1:]], count], strict=True):
            for i in range(first, end):
                out[sequence + (i - first) // each].append((offset + (i - first) % each * n, n))
    return {k: sorted(v) for k, v in out.items()}


def most_pairs(large, capacity):
    """Of all ways to pair the items, the most pairs that fit."""
    if len(large) < 2:
        return 0
    first, rest = large[0], large[1:]
    return max([most_pairs(rest, capacity), *(1 + most_pairs(rest[:i] + rest[i + 1 :], capacity) for i in range(len(rest)) if first + rest[i] <= capacity)])


def test_plan_places_all_items_without_gaps():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([1, 10, 30, 100, 4096])
        lengths = [min(capacity, 1 + int(rng.paretovariate(rng.choice([0.5, 1, 2])) * rng.choice([1, capacity / 10, capacity / 3]))) for _ in range(rng.randrange(1, 300))]
        plan = packing.Plan(Counter(lengths), capacity)
        found = sequences(plan, Counter(lengths))
        assert sorted(n for s in found.values() for _, n in s) == sorted(lengths) and set(found) == set(range(plan.sequences))
        for s in found.values():
            assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= capacity
        # Best-fit by decreasing length, one item at a time, takes no fewer.
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                rooms.append(capacity - n)
            else:
                rooms[rooms.index(fit)] -= n
        assert plan.sequences <= len(rooms)


def test_large_items_are_matched_as_often_as_can_be():
    rng = random.Random(2)
    for _ in range(200):
        large = [rng.randrange(11, 31) for _ in range(rng.randrange(1, 10))]
        plan = packing.Plan(Counter(large), 30)
        assert len(large) - plan.sequences == most_pairs(large, 30)


def test_plan_follows_lengths_not_items():
    few, many = (packing.Plan({n: 1 + (n * 7919) % 10**k for n in range(1, 4097)}, 4096) for k in (3, 9))
    assert len(many.places) < 3 * len(few.places) < 60_000
    total = sum(n * (1 + (n * 7919) % 10**9) for n in range(1, 4097))
    assert many.sequences < 1.001 * max(-(-total // 4096), sum(1 + (n * 7919) % 10**9 for n in range(2049, 4097)))


def test_query_against_the_contract(spark, library, odd):  # noqa: F811
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        got = packing.pack_documents(docs).collect()
        want = Counter()
        for r in docs.collect():
            ids = ids_of(library, r.text)
            for piece, at in enumerate(range(0, len(ids), 4096)):
                part = ids[at : at + 4096]
                want[r.doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter(tuple(r)[:5] for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 4096
        assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_a_hot_length_is_dealt_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 100)
    items = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, 7, 20) AS length", "id AS bucket", "id AS nth", "id AS place")
    got = packing.pack(items, capacity=48).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) == 5000
    assert len({r.sequence_id for r in got}) == 1667 and all(r.id == r.bucket == r.nth == r.place for r in got)


def test_items_without_a_place(spark):
    items = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 11), (5, 5)], "id long, length long")
    got = {r.id: (r.sequence_id, r.offset) for r in packing.pack(items, capacity=10).collect()}
    assert got[2] == got[3] == got[4] == (None, None) and {got[1], got[5]} == {(0, 0), (0, 5)}


def test_sequences_hold_the_ids(spark, library):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, None)], "doc_id long, text string")
    got = packing.packed_sequences(docs).collect()
    want = {i: ids_of(library, t) for i, t in ((1, "one two three"), (2, "four"), (3, None))}
    assert len(got) == 1 and got[0].ids == [x for i in got[0].doc_ids for x in want[i]]
