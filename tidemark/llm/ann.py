"""Approximate maximum inner product search with anisotropic four-bit quantisation.

Vectors are cut into subspaces of two coordinates, each with sixteen centres, so a code takes
four bits and two codes a byte. Training and encoding weigh the part of the residual that is
parallel to the vector more than the rest, since that part changes the large inner products:
loss = |r|^2 + (eta - 1) (r . x/|x|)^2. Codes are chosen by coordinate descent over the
subspaces and centres by the weighted least squares of their members.

What a code leaves over is quantised again, ``LEVELS`` times in all. A row keeps, for each
level, how far its approximation c stands along the row: with q.x = gain q.c + q.rest and the
rest orthogonal to c, an inner product is within sqrt(|q|^2 - (q.c)^2 / |c|^2) |rest| of
gain q.c. Each level is some three times as sharp as the one before.

A search needs, for each candidate, the sum of the entries of a query's tables of partial
products that its codes name. That sum is the query's product with what the codes stand for, so
the sums of a block are one matrix product of its queries with its decoded codes, in float32
and in units of the query's length. The k-th best least score that the sums allow tells which
candidates can be among the k nearest; it is carried on from chunk to chunk of a block. Blocks
hold codes alone: every query block meets every candidate block. What is left of all blocks,
once more held against the best least scores of the whole, is joined with its vectors and
scored exactly. No count cuts candidates off, so the result is exact, however many share a
code; on random vectors a few of a thousand are scored exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectors import matrix, takes_part
from tidemark.session import materialize

WIDTH = 2
CENTRES = 16
#: Vectors that the codebook of one length is fitted on, about, by hashed id; every row is indexed.
SAMPLE_ROWS = 20_000
#: Lengths with a codebook, the most frequent first. Vectors of any other length are all scored exactly.
MAX_BOOKS = 1000
#: Codes a row, each of what the one before leaves over.
LEVELS = 4
PARALLEL_THRESHOLD = 0.2
NEAREST = 20
QUERY_BLOCK = 2048
#: Candidates that a query block meets at once, and how many such chunks one task takes, one after the other, from ``SPREAD`` of them on.
CANDIDATE_BLOCK = 8192
CHUNKS, SPREAD = 8, 12
_SLICE = 512


@dataclass(frozen=True)
class Codebook:
    """Centres of each level (levels x subspaces x 16 x 2) of vectors padded to an even number of bytes' worth of subspaces."""

    centres: np.ndarray
    eta: float

    def pad(self, x: np.ndarray) -> np.ndarray:
        full = self.centres.shape[1] * WIDTH
        return np.pad(x, ((0, 0), (0, full - x.shape[1]))) if x.shape[1] < full else x

    def encode(self, x: np.ndarray, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x levels x subspaces/2), two a byte, and measures (rows x levels x 4): gain, |rest|, |c|, rounding.

        Rounding is how far, a unit of query length, a sum of float32 entries can be from q.c.
        """
        x = self.pad(x)
        so_far, codes, measures = np.zeros_like(x), [], []
        with np.errstate(all="ignore"):
            length = np.linalg.norm(x, axis=1)
            for level, centres in enumerate(self.centres):
                code = _assign(x - so_far, centres, self.eta if level == 0 else 1.0, None, sweeps if level == 0 else 0)
                so_far = so_far + centres[np.arange(len(centres))[None, :], code].reshape(len(x), -1)
                c = np.linalg.norm(so_far, axis=1)
                gain = np.where(c > 0, (x * so_far).sum(axis=1) / np.maximum(c, 1e-300) ** 2, 1.0)
                rest = np.linalg.norm(x - gain[:, None] * so_far, axis=1) * (1 + 1e-9)
                codes.append((code[:, 0::2] | (code[:, 1::2] << 4)).astype(np.uint8))
                measures.append(np.stack([gain, rest, c, (level + 1) * (codes[0].shape[1] + 6) * 2.0**-23 * (c + length)], axis=1))
        return np.stack(codes, axis=1), np.stack(measures, axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """What codes (rows x levels x bytes) stand for, all levels together."""
        out = np.zeros((len(codes), self.centres.shape[1], WIDTH))
        for level, centres in enumerate(self.centres):
            code = np.empty((len(codes), len(centres)), np.uint8)
            code[:, 0::2], code[:, 1::2] = codes[:, level] & 15, codes[:, level] >> 4
            out += centres[np.arange(len(centres))[None, :], code]
        return out.reshape(len(codes), -1)

    def tables(self, queries: np.ndarray, level: int) -> np.ndarray:
        """queries x bytes x 256: the inner product with what each byte of the level stands for."""
        q = self.pad(queries).reshape(len(queries), -1, WIDTH)
        each = np.einsum("qsw,skw->qsk", q, self.centres[level])
        low, high = each[:, 0::2], each[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), -1, CENTRES * CENTRES).astype(np.float32)


def _assign(x: np.ndarray, centres: np.ndarray, eta: float, codes: np.ndarray | None, sweeps: int) -> np.ndarray:
    s = centres.shape[0]
    parts = x.reshape(len(x), s, WIDTH)
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).reshape(len(x), s, WIDTH)
    if codes is None:
        codes = np.stack([((parts[:, k, None, :] - centres[k][None]) ** 2).sum(-1).argmin(1) for k in range(s)], axis=1)
    residual = parts - centres[np.arange(s)[None, :], codes]
    along = (residual * unit).sum(-1)
    total = along.sum(1)
    for _ in range(sweeps):
        for k in range(s):
            difference = parts[:, k, None, :] - centres[k][None]
            parallel = (difference * unit[:, k, None, :]).sum(-1)
            rest = total - along[:, k]
            best = ((difference**2).sum(-1) + (eta - 1.0) * (rest[:, None] + parallel) ** 2).argmin(1)
            codes[:, k] = best
            along[:, k] = parallel[np.arange(len(x)), best]
            total = rest + along[:, k]
    return codes


def train(x: np.ndarray, rounds: int = 8, seed: int = 3, levels: int = LEVELS) -> Codebook:
    """Codebooks for vectors of one length; fewer vectors than centres repeat as centres."""
    first, eta = _train_level(x, rounds, seed, True)
    centres, rest = [first], np.pad(x, ((0, 0), (0, first.shape[0] * WIDTH - x.shape[1])))
    for level in range(1, levels):
        code = _assign(rest, centres[-1], eta if level == 1 else 1.0, None, 1 if level == 1 else 0)
        rest = rest - centres[-1][np.arange(len(first))[None, :], code].reshape(len(rest), -1)
        centres.append(_train_level(rest, rounds, seed + level, False)[0])
    return Codebook(np.stack(centres), eta)


def _train_level(x: np.ndarray, rounds: int, seed: int, anisotropic: bool) -> tuple[np.ndarray, float]:
    dim = x.shape[1]
    s = -(-dim // (2 * WIDTH)) * 2
    t2 = PARALLEL_THRESHOLD**2
    eta = max(1.0, (dim - 1) * t2 / (1 - t2))
    x = np.pad(x, ((0, 0), (0, s * WIDTH - dim)))
    picks = np.random.default_rng(seed).integers(0, len(x), size=(s, CENTRES))
    centres = np.stack([x[picks[k], k * WIDTH : (k + 1) * WIDTH] for k in range(s)])
    parts = x.reshape(len(x), s, WIDTH)
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).reshape(len(x), s, WIDTH)
    codes = None
    for r in range(rounds):
        weight = 1.0 if not anisotropic or r < rounds // 2 else eta  # plain residuals first, then anisotropic
        codes = _assign(x, centres, weight, None if weight == 1.0 else codes, 0 if weight == 1.0 else 1)
        along = ((parts - centres[np.arange(s)[None, :], codes]) * unit).sum(-1)
        for k in range(s):
            rest = along.sum(1) - along[:, k]
            u, member = unit[:, k], codes[:, k]
            a = np.eye(WIDTH)[None] + (weight - 1.0) * u[:, :, None] * u[:, None, :]
            b = np.einsum("nij,nj->ni", a, parts[:, k]) + (weight - 1.0) * rest[:, None] * u
            lhs = np.zeros((CENTRES, WIDTH, WIDTH))
            rhs = np.zeros((CENTRES, WIDTH))
            np.add.at(lhs, member, a)
            np.add.at(rhs, member, b)
            used = np.bincount(member, minlength=CENTRES) > 0
            centres[k][used] = np.linalg.solve(lhs[used], rhs[used][:, :, None])[:, :, 0]
            along[:, k] = ((parts[:, k] - centres[k][member]) * u).sum(-1)
    return centres, eta


def build_index(entries: DataFrame, sample_rows: int = SAMPLE_ROWS, max_books: int = MAX_BOOKS) -> tuple[DataFrame, dict[int, Codebook]]:
    """(vec_id, vector, dim, code, measures) for every entry, and the codebook of each vector length.

    ``measures`` are those of the last level. ``vector`` is a hash that parts vectors of one id. The codebooks are fitted on samples, one
    length a task, all in one job; the driver gets their centres.
    """
    sized = entries.withColumn("dim", F.size("embedding"))
    counts = sized.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(max_books)
    share = F.ceil(F.col("n") / F.lit(sample_rows))  # one row of so many is looked at
    # Of a length whose rows the hash all leaves out, the first few are taken.
    nth = F.row_number().over(Window.partitionBy("dim").orderBy((F.pmod(F.xxhash64("vec_id"), share) != 0).cast("int"), F.xxhash64("vec_id"), F.xxhash64("embedding")))
    sample = sized.join(F.broadcast(counts), "dim").withColumn("nth", nth).where(F.col("nth") <= F.greatest(F.ceil(F.col("n") / share), F.lit(1))).where((F.pmod(F.xxhash64("vec_id"), share) == 0) | (F.col("nth") <= CENTRES))

    def fit(table: pa.Table) -> pa.Table:
        book = train(matrix(table.column("embedding")))
        return pa.table({"dim": table.column("dim")[:1], "levels": [len(book.centres)], "eta": [book.eta], "centres": pa.array([book.centres.ravel()], pa.list_(pa.float64()))})

    fitted = sample.select("dim", "embedding").groupBy("dim").applyInArrow(fit, "dim int, levels long, eta double, centres array<double>").collect()
    books = {r["dim"]: Codebook(np.array(r["centres"]).reshape(r["levels"], -1, CENTRES, WIDTH), r["eta"]) for r in fitted}

    def run(batches):
        for batch in batches:
            dims = np.array(batch.column(2).to_pylist())
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column(3))
                book = books.get(dim)
                codes, measures = book.encode(x) if book else (np.zeros((len(x), 0), np.uint8), np.zeros((len(x), 0)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([m[-1:].tobytes() for m in measures], pa.binary())], ["vec_id", "vector", "dim", "code", "measures"])

    rows = entries.select("vec_id", F.xxhash64("embedding").alias("vector"), F.size("embedding").alias("dim"), "embedding")
    return rows.mapInArrow(run, "vec_id long, vector long, dim int, code binary, measures binary"), books


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; no square leaves the range of doubles."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 5e-324)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scan_block(table: pa.Table, books: dict[int, Codebook], k: int) -> pa.Table:
    """The candidates of one block that can be among the k nearest of each query of one block, with the least and most they can score a unit of query length."""
    is_query = table.column("is_query").to_numpy()
    queries, candidates = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
    names = ("query_id", "query", "vec_id", "vector")
    if not queries.num_rows or not candidates.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in names} | {c: pa.array([], pa.float64()) for c in ("least", "most")})
    book = books.get(table.column("dim")[0].as_py())
    candidates = candidates.sort_by("vec_id")
    ids, vectors = candidates.column("vec_id").to_numpy(), candidates.column("vector").to_numpy()
    q_ids, q_hash = queries.column("vec_id").to_numpy(), queries.column("vector").to_numpy()
    if book:
        codes = np.frombuffer(b"".join(candidates.column("code").to_pylist()), np.uint8).reshape(len(ids), len(book.centres), -1)
        gain, rest, c, _ = np.frombuffer(b"".join(candidates.column("measures").to_pylist()), np.float64).reshape(len(ids), -1).T
        q = book.pad(_units(matrix(queries.column("embedding")))).astype(np.float32)
        with np.errstate(all="ignore"):
            along = np.abs(gain) * c
            good = np.isfinite(along) & np.isfinite(rest) & np.isfinite(along + rest)
            scale = max((along + rest)[good].max(initial=0.0), 1e-300)
            # What a sum can be off: the rest, and the rounding of a product of so many components.
            off = np.where(good, rest / scale + along / scale * (q.shape[1] + 16) * 2.0**-24 + 1e-37, np.inf)
            off = np.nextafter(off.astype(np.float32), np.float32(np.inf))
            x = np.where(good[:, None], book.decode(codes) * np.where(good, gain / scale, 0.0)[:, None], 0.0).astype(np.float32)
    else:  # nothing is known of any
        scale, off = 1.0, np.full(len(ids), np.inf, np.float32)
    own = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    out = []
    for at in range(0, len(q_ids), _SLICE):
        n = min(_SLICE, len(q_ids) - at)
        best, picked = np.full((n, k), -np.inf, np.float32), []
        for first in range(0, len(ids), CANDIDATE_BLOCK):
            here = slice(first, min(first + CANDIDATE_BLOCK, len(ids)))
            sums = q[at : at + n] @ x[here].T if book else np.zeros((n, here.stop - first), np.float32)
            low = sums - off[here]
            sums += off[here]
            for i, (a, b) in enumerate(zip(own[0][at : at + n] - first, own[1][at : at + n] - first, strict=True)):
                if b > a and b > 0 and a < low.shape[1]:  # a query's own row is no candidate
                    low[i, max(a, 0) : b] = -np.inf
                    sums[i, max(a, 0) : b] = np.nan
            top = np.partition(low, low.shape[1] - k, axis=1)[:, -k:] if low.shape[1] > k else low
            both = np.concatenate([best, top], axis=1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            rows, picks = np.nonzero(sums >= best.min(axis=1)[:, None])
            picked.append((rows, first + picks, low[rows, picks], sums[rows, picks]))
        rows, picks, least, most = (np.concatenate(p) for p in zip(*picked, strict=True))
        stay = most >= best.min(axis=1)[rows]
        rows, picks = rows[stay], picks[stay]
        out.append((q_ids[at + rows], q_hash[at + rows], ids[picks], vectors[picks], least[stay] * np.float64(scale), most[stay] * np.float64(scale)))
    return pa.table(dict(zip((*names, "least", "most"), (pa.array(np.concatenate(c)) for c in zip(*out, strict=True)), strict=True)))


def candidates(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, query, vec_id, vector) of all pairs that can be among the k nearest, by codes alone.

    ``entries`` has (vec_id, embedding), ``queries`` (vec_id, vector, dim, embedding).
    """
    indexed, books = build_index(entries)
    sizes = queries.agg(F.count("*")).first()[0], entries.count()
    n_query, chunks = max(1, -(-sizes[0] // QUERY_BLOCK)), max(1, -(-sizes[1] // CANDIDATE_BLOCK))
    n_candidate = max(min(chunks, SPREAD), -(-chunks // CHUNKS))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None)
    left = queries.withColumn("qb", block(n_query)).withColumn("cb", every_block(n_candidate)).select("dim", "qb", "cb", F.lit(True).alias("is_query"), "vec_id", "vector", "embedding", none.cast("binary").alias("code"), none.cast("binary").alias("measures"))
    right = indexed.withColumn("cb", block(n_candidate)).withColumn("qb", every_block(n_query)).select("dim", "qb", "cb", F.lit(False).alias("is_query"), "vec_id", "vector", none.cast(queries.schema["embedding"].dataType).alias("embedding"), "code", "measures")

    def run(table: pa.Table) -> pa.Table:
        return scan_block(table, books, k)

    found, _ = materialize(left.unionByName(right).groupBy("dim", "qb", "cb").applyInArrow(run, "query_id long, query long, vec_id long, vector long, least double, most double"), "candidates")
    # The k-th best least score of all blocks is at least that of any one.
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("least"), "vec_id", "vector")
    reached = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select("query_id", "query", F.col("least").alias("reached"))
    return found.join(reached, ["query_id", "query"], "left").where("reached IS NULL OR most >= reached").select("query_id", "query", "vec_id", "vector")


def nearest_vectors(vectors: DataFrame, k: int = NEAREST, every: int = 20) -> DataFrame:
    """The op10 digest: query_id, rank, vec_id, score.

    Rows without a vec_id, and vectors that are null, zero or not finite, take no part; vectors
    of different length are not compared. Rows alike in id and vector are one. Of vectors alike
    in all components only the k + 1 smallest ids can be among a query's k nearest, since ties
    go to the smaller id, so no more of them are searched. Extra columns
    are not read, and an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    entries, _ = materialize(rows.withColumn("nth", F.dense_rank().over(alike)).where(F.col("nth") <= k + 1).drop("nth").dropDuplicates(["embedding", "vec_id"]), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("embedding").alias("vector"), F.size("embedding").alias("dim"), "embedding").dropDuplicates(["vec_id", "embedding"])
    # Only now do the vectors of what is left come in.
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.col("embedding").alias("q"))
    held = entries.select("vec_id", F.xxhash64("embedding").alias("vector"), F.col("embedding").alias("x"))
    pairs = candidates(entries, queries, k).join(asked, ["query_id", "query"]).join(held, ["vec_id", "vector"])
    score = F.aggregate(F.zip_with("q", "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    scored = pairs.select("query_id", "query", "vec_id", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
