"""The similarity join of token sets against all pairs."""

import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.operators import setjoin


def brute(records, threshold, top):
    out = []
    sets = {k: {t for t in tokens or [] if t is not None} for k, tokens in records}
    for k, x in sets.items():
        found = [(Fraction(len(x & y), len(x | y)), o) for o, y in sets.items() if o != k and x and y]
        found = sorted((f for f in found if f[0] >= threshold), key=lambda f: (-f[0], f[1]))[:top]
        out += [(k, o, float(s), i + 1) for i, (s, o) in enumerate(found)]
    return sorted(out)


def made(rng, n, letters):
    records = []
    for i in range(n):
        tokens = [f"w{min(rng.randrange(letters), rng.randrange(letters))}" for _ in range(rng.choice([0, 1, 2, 5, 12]))] if rng.random() < 0.5 or not records else [t for t in rng.choice(records)[1] or [] if rng.random() < 0.9]
        records.append((i, tokens))
    return [*records, (n, None), (n + 1, [None, "w1"])]


def test_join_equals_all_pairs(spark):
    rng = random.Random(4)
    for letters, threshold, top in ((6, Fraction(3, 5), 8), (40, Fraction(3, 5), 3), (40, Fraction(4, 5), 8), (200, Fraction(1, 2), 100)):
        records = made(rng, 200, letters)
        got = setjoin.similar_records(spark.createDataFrame(records, "id long, w array<string>"), "id", "w", float(threshold), top)
        assert sorted(map(tuple, got.collect())) == brute(records, threshold, top)
    assert setjoin.similar_records(spark.createDataFrame([], "id long, w array<string>"), "id", "w").count() == 0


def test_common_words_are_no_keys_of_the_join(spark):
    """A word that all records have is behind every prefix, and equal records meet once."""
    records = [(i, ["the", "of", *[f"own{i}-{j}" for j in range(8)]]) for i in range(300)] + [(1000 + i, ["same", "words", "here"]) for i in range(300)]
    _, sets = setjoin.token_sets(spark.createDataFrame(records, "id long, w array<string>"), "id", "w")
    rows = sets.collect()
    assert len(rows) == 301
    keys = defaultdict(int)
    for r in rows:
        need = -(-r.size * 3 // 5)
        for t in r.tokens[: r.size - need + 1]:
            keys[t] += 1
    assert max(keys.values()) == 1
    assert setjoin.similar_pairs(sets).count() == 0


def test_rows_that_meet_hold_no_tokens(spark, monkeypatch):
    """Long texts with common rare words that are not alike: nothing is compared token by token."""
    rng = random.Random(7)
    records = [(i, [f"w{rng.randrange(3000)}" for _ in range(300)]) for i in range(120)]
    _, sets = setjoin.token_sets(spark.createDataFrame(records, "id long, w array<string>"), "id", "w")
    compared = []
    keep = setjoin.F.array_intersect
    monkeypatch.setattr(setjoin.F, "array_intersect", lambda a, b: compared.append((a, b)) or keep(a, b))
    pairs = setjoin.similar_pairs(sets)
    assert compared == [("tokens_a", "tokens_b")] and pairs.count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    sc = spark.sparkContext
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_exchanges_grow_with_the_tokens(spark):
    """Sets that meet by many rare words and are not alike cross no exchange in pairs, nor with each of their words."""
    rng = random.Random(3)
    records = [(i, [f"w{t}" for t in rng.sample(range(1500), 60)]) for i in range(1500)]
    _, sets = setjoin.token_sets(spark.createDataFrame(records, "id long, w array<string>"), "id", "w")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        assert setjoin.similar_pairs(sets).count() == 0
        got = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert got < 8 * sum(len(w) for _, w in records)


def test_pairs_of_many_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 40)
    monkeypatch.setattr(setjoin, "MOST", 40)
    rng = random.Random(6)
    for letters, threshold in ((12, Fraction(3, 5)), (60, Fraction(1, 4))):
        records = made(rng, 200, letters)
        _, sets = setjoin.token_sets(spark.createDataFrame(records, "id long, w array<string>"), "id", "w")
        *_, n = setjoin._deal(sets, setjoin.F.col("size"))
        assert n > 5
        held = {r.set: set(r.tokens) for r in sets.collect()}
        want = sorted((a, b) for a in held for b in held if a < b and Fraction(len(held[a] & held[b]), len(held[a] | held[b])) >= threshold)
        got = setjoin.similar_pairs(sets, float(threshold))
        assert sorted((r.a, r.b) for r in got.collect()) == want and want


def test_blocks_meet_in_steps(monkeypatch):
    """Every pair alike is found once, however few pairs a task looks at in one go and however long the texts."""
    monkeypatch.setattr(setjoin, "CHUNK", 16)
    rng, threshold = random.Random(8), 0.6
    texts = []
    for i in range(120):
        some = rng.choice(texts) if texts and i % 3 else set()
        texts.append({t for t in some if rng.random() < 0.85} | {rng.getrandbits(64) - (1 << 63) for _ in range(rng.choice([1, 20, 400]))})
    # Any one order of the tokens serves.
    lists = pa.array([sorted(x) for x in texts], pa.list_(pa.int64()))
    words = pa.array([[f"{t:x}" for t in sorted(x)] for x in texts], pa.list_(pa.string()))
    shapes = pa.RecordBatch.from_arrays([pa.array([7 * i % 120 for i in range(120)], pa.int64()), pa.array([0] * 120, pa.int32()), lists, words], ["set", "alone", "hashes", "tokens"])
    sizes = np.array(sorted({len(x) for x in texts}))
    blocks = pa.Table.from_batches(setjoin._shapes(threshold, sizes, np.arange(len(sizes)) // 9, np.ones(len(sizes), int))([shapes]))
    packed = [setjoin._pack(blocks.filter(pc.equal(blocks["block"], b))).combine_chunks() for b in sorted(set(blocks["block"].to_pylist()))]
    found, met = [], set()
    for i, a in enumerate(packed):
        for b in packed[i:]:
            row = pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for t in (a, b) for c in t.columns], [f"{n}_{s}" for s in "ab" for n in a.column_names])
            met |= {x for out in setjoin._meets(threshold)([row]) for x in out.column(0).to_pylist()}
            found += [(x["a"], x["b"], len(set(x["tokens_a"]) & set(x["tokens_b"])), len(x["tokens_a"])) for out in setjoin._meets(threshold, True)([row]) for x in out.to_pylist()]
    text = {7 * i % 120: x for i, x in enumerate(texts)}
    want = {(a, b) for a in text for b in text if a < b and len(text[a] & text[b]) >= threshold * len(text[a] | text[b])}
    pairs = [f[:2] for f in found]
    assert len(pairs) == len(set(pairs)) and want and want <= set(pairs) and len(pairs) < 2 * len(want) + 50
    assert met == {x for p in pairs for x in p}
    assert all(both == len(text[a] & text[b]) and n == len(text[a]) for a, b, both, n in found)
