"""Records whose token sets are alike: a similarity join that never joins on common tokens.

Two sets with a Jaccard similarity of at least t share a token among the first
|x| - ceil(t |x|) + 1 of each, in any one order of all tokens. In order of rarity those are
the rare ones, so sets meet by rare tokens, and common ones are only compared where a pair has
met. Sets alike in all tokens are one row of the join, however many records have them.

No exchange holds pairs that have only met, whose number grows with the square of the sets: sets
are packed into blocks by size, and each two blocks whose sizes allow it meet in one task, which
reads them where they lie. A block has a set's rare tokens as numbers and its parities; a pair
that meets is held against what its places leave and against both parities. Sets of which a pair
remains are packed again with all their tokens, so that it is compared where it meets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import drop_path, materialize

#: From where on two records are alike, and how many of them a record names.
THRESHOLD = 0.6
TOP = 8
_ROUNDING = 1e-9
#: Counts that tokens are ordered by: a token's is that of its hash among so many.
COUNTS = 1 << 20
#: Parities a token of a set has at least: bit i is how many of the tokens hash to i, modulo 2.
PARITIES = 2
#: Rare tokens a block holds at least and at most, and how many blocks there are between.
BLOCK, MOST, BLOCKS = 1 << 16, 1 << 20, 24
#: Sets a block holds at most where they are compared: each two may be alike.
MANY = 1024
#: Pairs, and words of their parities, that a task looks at in one go.
CHUNK = 1 << 18
#: Sets a task orders or shapes in one go.
STEP = 1000
#: Up to so many numbers of sets are broadcast.
BROADCAST = 1 << 20
SHAPE = "block int, set long, size int, alone int, rare binary, bits binary"
PACKED = "block int, least int, most int, sets binary, sizes binary, alone binary, counts binary, rare binary, bits binary"
MET, COMPARED = "set long", "a long, b long, tokens_a array<int>, tokens_b array<int>"


def least_overlap(size: Column, threshold: float) -> Column:
    """How many tokens a set of this size shares at least with any set it is alike to."""
    return F.ceil(size * threshold - F.lit(_ROUNDING)).cast("int")


def token_sets(records: DataFrame, key: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """(members, sets): each record's set, and each distinct set with its tokens from rare to common.

    ``members`` has (key, set); ``sets`` (set, tokens, size, alone): how many of its tokens, the
    first ones, surely no other set has. Null tokens are dropped, and
    records without any are in neither: they are alike to nothing.
    """
    members, sets, _ = _token_sets(records, key, tokens)
    return members, sets


def _token_sets(records: DataFrame, key: str, tokens: str) -> tuple[DataFrame, DataFrame, str]:
    """The tables of ``token_sets`` and the path of the second."""
    given = records.select(F.col(key).alias("key"), F.sort_array(F.array_distinct(F.filter(tokens, lambda x: x.isNotNull()))).alias("tokens"))
    # Equal sets have equal sorted arrays, whose digest stands for them; a set has the number of its first record.
    digest = F.unhex(F.sha2(F.to_json(F.struct("tokens")), 256)).alias("digest")
    given, path = materialize(given.select("key", F.monotonically_increasing_id().alias("row"), digest, "tokens"), "token-sets", "zstd")
    given = given.where(F.size("tokens") > 0)  # before it is stored, this would work out the tokens twice
    first = given.groupBy("digest").agg(F.min("row").alias("set"))
    named, _ = materialize(given.select("key", "row", "digest").join(first, "digest").select("key", "row", "set"), "set-members")
    # Any order of tokens serves; counts by hash come close to that of rarity and are bounded.
    hashes = F.transform("tokens", lambda x: F.xxhash64(x))
    counted = given.select(F.explode(hashes).alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(COUNTS - 1)).cast("int").alias("at")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(COUNTS, np.int64)
    counts[counted["at"].to_numpy()] = counted["n"].to_numpy()
    distinct = given.select(F.col("row").alias("set"), "tokens").join(_few(named.where("row <> set").select(F.col("row").alias("set"))), "set", "left_anti")
    ranked = distinct.select("set", "tokens", hashes.alias("hashes")).mapInArrow(_ranks(counts), "set long, tokens array<string>, size int, alone int")
    sets, ranked_path = materialize(ranked, "ranked-sets", "zstd")
    drop_path(records.sparkSession, path)
    return named.select("key", "set"), sets, ranked_path


def _few(numbers: DataFrame) -> DataFrame:
    """``numbers``, broadcast if they are few: what they are joined with has the tokens and then stays where it is."""
    return F.broadcast(numbers) if numbers.limit(BROADCAST + 1).count() <= BROADCAST else numbers


def _steps(batches):
    for batch in batches:
        yield from (batch.slice(at, STEP) for at in range(0, batch.num_rows, STEP))


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(where each list begins and the last ends, all their values)."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten()


def _ranks(counts: np.ndarray):
    def ranks(batches):
        for batch in _steps(batches):
            starts, tokens = _lists(batch.column("tokens"))
            hashes = _lists(batch.column("hashes"))[1].to_numpy()
            sizes = np.diff(starts)
            of, n = np.repeat(np.arange(len(sizes)), sizes), counts[hashes & (COUNTS - 1)]
            order = np.lexsort((hashes, n, of))
            alone = np.bincount(of, weights=n == 1, minlength=len(sizes))
            ordered = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), tokens.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([batch.column("set"), ordered, pa.array(sizes, pa.int32()), pa.array(alone.astype(np.int32))], ["set", "tokens", "size", "alone"])

    return ranks


def _words(sizes: np.ndarray) -> np.ndarray:
    """Words of 64 parities a set of these sizes has, a power of two."""
    return 1 << np.ceil(np.log2(np.maximum(sizes * PARITIES / 64, 1))).astype(np.int64)


def _needs(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How many tokens two sets with so many in sum share at least if they are alike."""
    return np.ceil(sizes * (threshold / (1 + threshold)) - _ROUNDING)


def _deal(sets: DataFrame, weight: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sizes of sets, the first block of each, in how many blocks it is, how many blocks there are): blocks go by size and hold as much of ``weight``."""
    # Sets of n sizes have n * n / 2 tokens at least, so sizes are few.
    rows = sorted(tuple(r) for r in sets.groupBy("size").agg(F.sum(F.greatest(weight, F.lit(0)).cast("long"))).collect())
    wide = min(max(sum(n for _, n in rows) // BLOCKS, BLOCK), MOST)
    first, parts, block, held = [], [], 0, 0
    for _, n in rows:
        if held and held + n > wide:
            block, held = block + 1, 0
        first.append(block)
        parts.append(-(-n // wide) or 1)
        held += n
        if parts[-1] > 1:
            block, held = block + parts[-1], 0
    return np.array([s for s, _ in rows], np.int64), np.array(first, np.int64), np.array(parts, np.int64), block + 1


def _shapes(threshold: float, sizes: np.ndarray, first: np.ndarray, parts: np.ndarray):
    """Sets with their block, their rare tokens as numbers and their parities; sets whose rare tokens no other has meet nothing."""

    def shapes(batches):
        for batch in _steps(batches):
            starts, hashes = _lists(batch.column("hashes"))
            hashes, starts, n = hashes.to_numpy().view(np.uint64), starts.astype(np.int64), np.diff(starts).astype(np.int64)
            number, alone = batch.column("set").to_numpy(), batch.column("alone").to_numpy().astype(np.int64)
            until = n - np.ceil(n * threshold - _ROUNDING).astype(np.int64) + 1
            bits = _words(n) * 64
            ends = np.cumsum(bits)
            at = np.repeat(ends - bits, n) + (hashes & np.repeat((bits - 1).astype(np.uint64), n)).astype(np.int64)
            parity = np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8), bitorder="little")
            rare, kind = (hashes >> np.uint64(32)).astype(np.uint32), np.searchsorted(sizes, n)
            block = first[kind] + (number * 0x9E3779B1 >> 16) % parts[kind]
            some = np.flatnonzero(until > alone)
            shaped = {
                "block": pa.array(block[some].astype(np.int32)), "set": pa.array(number[some]), "size": pa.array(n[some].astype(np.int32)), "alone": pa.array(alone[some].astype(np.int32)),
                "rare": pa.array([rare[starts[i] + alone[i] : starts[i] + until[i]].tobytes() for i in some], pa.binary()),
                "bits": pa.array([parity[(ends[i] - bits[i]) // 8 : ends[i] // 8].tobytes() for i in some], pa.binary()),
            }
            if "tokens" in batch.schema.names:
                shaped["tokens"] = batch.column("tokens").take(pa.array(some))
            yield pa.RecordBatch.from_arrays(list(shaped.values()), list(shaped))

    return shapes


def _pack(table: pa.Table) -> pa.Table:
    """A block as one row, its sets by size."""
    table = table.sort_by([("size", "ascending"), ("set", "ascending")])
    column = lambda c: table.column(c).to_numpy()
    sizes, rare, bits = column("size"), table.column("rare").to_pylist(), table.column("bits").to_pylist()
    held = [column("set").astype(np.int64), sizes.astype(np.int32), column("alone").astype(np.int32), np.array([len(r) // 4 for r in rare], np.int32)]
    values = [*[x.tobytes() for x in held], b"".join(rare), b"".join(bits)]
    names = ["block", "least", "most", "sets", "sizes", "alone", "counts", "rare", "bits"]
    if "tokens" in table.column_names:
        tokens = pc.list_flatten(table.column("tokens").combine_chunks()).cast(pa.large_string())
        tokens = pa.concat_arrays([tokens])  # what it is a part of stays behind
        _, ends, text = tokens.buffers()
        values += [np.frombuffer(ends, np.int64, len(tokens) + 1, tokens.offset * 8).tobytes(), (text or pa.py_buffer(b"")).to_pybytes()]
        names += ["ends", "text"]
    row = [pa.array([int(x)], pa.int32()) for x in (table.column("block")[0].as_py(), sizes[0], sizes[-1])]
    return pa.table([*row, *[pa.array([v], pa.binary()) for v in values]], names)


class _Block:
    """A packed block: sets by size, and a row for each of their rare tokens."""

    def __init__(self, row: pa.RecordBatch, side: str, threshold: float):
        get = lambda name, kind: np.frombuffer(row.column(f"{name}_{side}")[0].as_buffer(), kind)
        self.sets, self.sizes = get("sets", np.int64), get("sizes", np.int32).astype(np.int64)
        counts = get("counts", np.int32)
        self.of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        before = np.cumsum(counts, dtype=np.int32) - counts
        self.token, size = get("rare", np.uint32), self.sizes.astype(np.int32)
        # What can be shared from a place on, and with sets of up to which size that is enough.
        self.rest = np.repeat(size - get("alone", np.int32) + before, counts) - np.arange(len(self.of), dtype=np.int32)
        self.reach = np.minimum((self.rest + 1e-6) * ((1 + threshold) / threshold) - size[self.of], np.iinfo(np.int32).max).astype(np.int32)
        self.words, self.bits = _words(self.sizes), get("bits", np.uint64)
        self.bit_starts = np.cumsum(self.words) - self.words
        self.folded = {}
        if f"text_{side}" in row.schema.names:
            ends = row.column(f"ends_{side}")[0].as_buffer()
            self.tokens = pa.LargeStringArray.from_buffers(len(ends) // 8 - 1, ends, row.column(f"text_{side}")[0].as_buffer())
            self.starts = np.cumsum(self.sizes) - self.sizes

    def parities(self, words: int, of: int) -> tuple[np.ndarray, int]:
        """(parities of its sets with ``of`` words as ``words`` words, the first of these sets)."""
        if (words, of) not in self.folded:
            lo, hi = np.searchsorted(self.words, [of, of + 1])
            held = self.bits[self.bit_starts[lo] : self.bit_starts[lo] + (hi - lo) * of].reshape(-1, of // words, words)
            self.folded[words, of] = np.bitwise_xor.reduce(held, axis=1), lo
        return self.folded[words, of]


def _meet(a: _Block, b: _Block, same: bool, threshold: float):
    """Pairs of places of sets in ``a`` and in ``b``, whose sets are no smaller, as arrays; some come more than once."""
    low = np.ceil(b.sizes * threshold - _ROUNDING)
    mine = np.flatnonzero(a.reach >= max(b.sizes[0], 1))
    mine = mine[a.reach[mine] >= a.sizes[a.of[mine]]]
    keys = (a.token[mine].astype(np.uint64) << np.uint64(32)) | a.of[mine].astype(np.uint64)
    order = np.argsort(keys)
    keys, mine = keys[order], mine[order]
    theirs = np.flatnonzero(b.reach >= np.maximum(low[b.of], a.sizes[0]))
    theirs = theirs[np.argsort(b.token[theirs])]
    begin = np.searchsorted(a.sizes, low)[b.of[theirs]]
    end = np.searchsorted(a.sizes, np.minimum(b.sizes[b.of[theirs]], b.reach[theirs]), "right")
    if same:  # each pair once, and none of a set with itself
        end = np.minimum(end, b.of[theirs])
    token = b.token[theirs].astype(np.uint64) << np.uint64(32)
    begin, end = (np.searchsorted(keys, token | x.astype(np.uint64)) for x in (begin, end))
    some = np.flatnonzero(end > begin)
    theirs, begin, until = theirs[some], begin[some], np.cumsum(end[some] - begin[some])
    at = 0
    while at < len(theirs):
        before = until[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(until, before + CHUNK, "right")))
        n = np.diff(until[at:to], prepend=before)
        i, j = mine[_ranges(begin[at:to], n)], np.repeat(theirs[at:to], n)
        ok = a.reach[i] >= b.sizes[b.of[j]]
        i, j = i[ok], j[ok]
        need = _needs(a.sizes[a.of[i]] + b.sizes[b.of[j]], threshold)
        ok = (a.rest[i] >= need) & (b.rest[j] >= need)
        yield from _apart(a, b, a.of[i[ok]], b.of[j[ok]], threshold)
        at = to


def _apart(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray, threshold: float):
    """Of pairs of places those whose parities leave enough: each that differs is a token that one of them has alone."""
    both = a.sizes[i] + b.sizes[j]
    room = both - 2 * _needs(both, threshold)
    for words, of in sorted(set(zip(a.words[i].tolist(), b.words[j].tolist(), strict=True))):
        least = min(words, of)
        left, first = a.parities(least, words)
        right, start = b.parities(least, of)
        these = np.flatnonzero((a.words[i] == words) & (b.words[j] == of))
        step = max(CHUNK // least, 1)
        for k in range(0, len(these), step):
            some = these[k : k + step]
            apart = np.bitwise_count(left[i[some] - first] ^ right[j[some] - start]).sum(axis=1, dtype=np.int64)
            some = some[apart <= room[some]]
            yield i[some], j[some]


def _meets(threshold: float, compared: bool = False):
    """For rows of two blocks the sets that have a pair left, or, ``compared``, the pairs with their tokens as numbers."""

    def meets(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                a, b = (_Block(row, side, threshold) for side in "ab")
                same = row.column("block_a")[0] == row.column("block_b")[0]
                found = np.zeros(0, np.int64)
                waiting, n = [], 0
                for i, j in _meet(a, b, same, threshold):
                    waiting.append(i.astype(np.int64) << 32 | j)
                    n += len(i)
                    if n > 8 * CHUNK:
                        found, waiting, n = np.unique(np.concatenate([found, *waiting])), [], 0
                found = np.unique(np.concatenate([found, *waiting]))
                i, j = found >> 32, found & 0xFFFFFFFF
                if compared:
                    yield from _compared(a, b, i, j)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([a.sets[np.unique(i)], b.sets[np.unique(j)]])))], ["set"])

    return meets


def _compared(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray):
    """Pairs of sets with the tokens of both, as numbers that are equal where the tokens are."""
    if not len(i):
        return
    # Both blocks' sets that have a pair, one after the other.
    (left, i), (right, j) = (np.unique(x, return_inverse=True) for x in (i, j))
    sizes = np.concatenate([a.sizes[left], b.sizes[right]])
    ends = np.cumsum(sizes)
    tokens = [x.tokens.take(pa.array(_ranges(x.starts[some], x.sizes[some]))) for x, some in ((a, left), (b, right))]
    tokens = pa.concat_arrays(tokens).dictionary_encode().indices.to_numpy()
    numbers = np.concatenate([a.sets[left], b.sets[right]])
    j = j + len(left)
    low, high = np.where(numbers[i] < numbers[j], i, j), np.where(numbers[i] < numbers[j], j, i)
    until = np.cumsum(sizes[i] + sizes[j])
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + 4 * CHUNK, "right")))
        sides = [x[at:to] for x in (low, high)]
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[x])]), pa.int32()), pa.array(tokens[_ranges(ends[x] - sizes[x], sizes[x])])) for x in sides]
        yield pa.RecordBatch.from_arrays([*[pa.array(numbers[x]) for x in sides], *lists], ["a", "b", "tokens_a", "tokens_b"])
        at = to


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of so many each."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _met(sets: DataFrame, threshold: float, dealt: tuple, schema: str, *more: str) -> tuple[DataFrame, str]:
    """What every two blocks of ``sets`` that may be alike have in ``_meets``, not computed yet, and the path of the blocks."""
    *dealt, n = dealt
    hashed = sets.select("set", "alone", F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes"), *more)
    shaped = hashed.mapInArrow(_shapes(threshold, *dealt), SHAPE + (", tokens array<string>" if more else ""))
    packed = shaped.repartition(n, "block").groupBy("block").applyInArrow(_pack, PACKED + (", ends binary, text binary" if more else ""))
    blocks, path = materialize(packed, "blocks", "zstd")
    left, right = (blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns]) for s in "ab")
    if more:  # Few sets are left; blocks of alike sizes, where copies are, go to different tasks.
        right = right.repartition(min(n, BLOCKS), "block_b")
    # Every two blocks are read by a task where they lie, so none is written again for each other.
    near = left.join(right.hint("shuffle_replicate_nl"), (F.col("block_a") <= F.col("block_b")) & (F.col("most_a") >= F.col("least_b") * threshold - _ROUNDING))
    return near.mapInArrow(_meets(threshold, bool(more)), schema), path


def similar_pairs(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of distinct sets a < b with a Jaccard similarity of ``threshold`` or more."""
    rare = F.col("size") - least_overlap(F.col("size"), threshold) + 1 - F.col("alone")
    met, path = _met(sets, threshold, _deal(sets, rare), MET)
    met, met_path = materialize(met, "met-sets")
    drop_path(sets.sparkSession, path)
    some = sets.join(_few(met.distinct()), "set", "left_semi")
    pairs, path = _met(some, threshold, _deal(some, F.greatest(F.col("size"), F.lit(MOST // MANY))), COMPARED, "tokens")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    ratio = both / (F.size("tokens_a") + F.size("tokens_b") - both)
    alike, _ = materialize(pairs.select("a", "b", ratio.alias("similarity")).where(F.col("similarity") >= threshold - _ROUNDING), "similar-sets")
    for done in (path, met_path):
        drop_path(sets.sparkSession, done)
    return alike


def similar_records(records: DataFrame, key: str, tokens: str, threshold: float = THRESHOLD, top: int = TOP) -> DataFrame:
    """(key, other, similarity, rank): each record's ``top`` most similar others at ``threshold`` or more, ties to the smaller key.

    Keys are of a type that can be ordered and each record's own; a record without tokens has no
    row. Of a set's records only the ``top`` + 1 smallest keys can be among anyone's ``top``,
    so no more of them meet others.
    """
    members, sets, path = _token_sets(records, key, tokens)
    nth = F.row_number().over(Window.partitionBy("set").orderBy("key"))
    named = members.withColumn("nth", nth).where(F.col("nth") <= top + 1).select("set", F.col("key").alias("other"))
    pairs = similar_pairs(sets, threshold)
    drop_path(records.sparkSession, path)
    both_ways = pairs.union(pairs.select("b", "a", "similarity")).union(members.select("set", "set", F.lit(1.0)).distinct())
    # A set's best others first, then its records: those of one set have one answer but for themselves.
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), "other")
    answers = both_ways.join(named.withColumnRenamed("set", "b"), "b").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top + 1).select(F.col("a").alias("set"), "other", "similarity")
    found = members.join(answers, "set").where("key <> other")
    mine = Window.partitionBy("key").orderBy(F.desc("similarity"), "other")
    return found.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= top).select(F.col("key").alias(key), "other", "similarity", "rank")
