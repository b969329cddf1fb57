"""The table scans select: few candidates are left to score, none of the nearest is lost, over several real blocks."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


def table(spark, tmp_path, x):
    path = f"{tmp_path}/x.parquet"
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(x.tolist())}), path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("n", "copies"), [(3000, 0), (12_000, 0), (20_000, 0), (12_000, 3)])
def test_few_candidates_are_left_and_none_is_lost(spark, tmp_path, n, copies):
    rng = np.random.default_rng(n + copies)
    x = rng.standard_normal((n, 32))
    if copies:
        x[::copies] = x[0] + 1e-3 * rng.standard_normal((len(x[::copies]), 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = table(spark, tmp_path, x)
    queries = vectors.where("vec_id % 200 = 0").select("vec_id", F.xxhash64("embedding").alias("vector"), F.size("embedding").alias("dim"), "embedding")
    assert n < 9000 or ann.CANDIDATE_BLOCK < n  # several blocks as they are in use
    left = ann.candidates(vectors, queries, ann.NEAREST).groupBy("query_id").agg(F.collect_list("vec_id").alias("found")).collect()
    assert len(left) == n // 200
    own_copies = n // copies if copies else 0
    shares = []
    for r in left:
        s = x @ x[r.query_id]
        s[r.query_id] = -np.inf
        assert set(np.argsort(-s)[: ann.NEAREST].tolist()) <= set(r.found)
        shares.append(len(r.found) / n)
        if copies and r.query_id % copies:
            assert len(r.found) < 0.05 * n + own_copies
    assert np.mean(shares) <= 0.05 or copies


def test_codes_alone_cross_the_exchange(spark, tmp_path):
    rng = np.random.default_rng(1)
    indexed, books = ann.build_index(table(spark, tmp_path, rng.standard_normal((500, 32))))
    assert indexed.columns == ["vec_id", "vector", "dim", "code", "measures"] and set(books) == {32}
    row = indexed.first()
    assert len(row.code) == ann.LEVELS * 8 and len(books[32].centres) == ann.LEVELS


def test_sums_are_within_their_bounds():
    rng = np.random.default_rng(2)
    for scale in (1e-3, 1.0, 1e3):
        x = scale * rng.standard_normal((2000, 20)) * rng.random((2000, 1))
        book = ann.train(x)
        codes, measures = book.encode(x)
        q = rng.standard_normal((50, 20))
        size = np.linalg.norm(q, axis=1)
        total = np.zeros((50, 2000))
        for level in range(ann.LEVELS):
            tables = book.tables(q, level)
            for j in range(codes.shape[2]):
                total += tables[:, j][:, codes[:, level, j]]
            gain, rest, c, rounding = measures[:, level].T
            along = np.maximum(np.abs(total) - size[:, None] * rounding, 0) / c
            bound = np.sqrt(np.maximum(size[:, None] ** 2 - along**2, 0)) * rest + np.abs(gain) * size[:, None] * rounding
            assert (np.abs(q @ x.T - gain * total) <= bound + 1e-12 * np.abs(total)).all()


def test_sums_of_any_size_select(spark, tmp_path):
    """Products far below the range of float32 tell as much as any."""
    rng = np.random.default_rng(5)
    x = 1e-25 * rng.standard_normal((3000, 32))
    vectors = table(spark, tmp_path, x)
    queries = vectors.where("vec_id % 300 = 0").select("vec_id", F.xxhash64("embedding").alias("vector"), F.size("embedding").alias("dim"), "embedding")
    for r in ann.candidates(vectors, queries, ann.NEAREST).groupBy("query_id").agg(F.collect_list("vec_id").alias("found")).collect():
        s = x @ x[r.query_id]
        s[r.query_id] = -np.inf
        assert set(np.argsort(-s)[: ann.NEAREST].tolist()) <= set(r.found) and len(r.found) < 300


def test_chunks_of_a_block_carry_what_is_reached():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20_000, 16))
    book = ann.train(x[:2000])
    codes, measures = book.encode(x)
    n, none = 40, pa.nulls
    columns = lambda q, ids, e, c, m: pa.table({"dim": pa.array([16] * len(ids)), "is_query": pa.array([q] * len(ids)), "vec_id": ids, "vector": ids, "embedding": e, "code": c, "measures": m})
    ids = pa.array(np.arange(20_000))
    asked = columns(True, ids[:n], pa.array(x[:n].tolist()), none(n, pa.binary()), none(n, pa.binary()))
    held = columns(False, ids, none(20_000, pa.list_(pa.float64())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([m[-1:].tobytes() for m in measures], pa.binary()))
    got = ann.scan_block(pa.concat_tables([asked, held]), {16: book}, 20).to_pandas()
    s = x[:n] @ x.T
    s[np.arange(n), np.arange(n)] = -np.inf
    for i, found in got.groupby("query_id"):
        assert set(np.argsort(-s[i])[:20].tolist()) <= set(found.vec_id) and len(found) < 100
        true = s[i][found.vec_id.to_numpy()] / np.linalg.norm(x[i])
        assert (found.least <= true).all() and (true <= found.most).all()
