"""Packing documents into sequences: large items are matched, small ones fill the gaps best-fit.

Lengths are whole numbers up to the capacity, so the plan needs their histogram alone: at most
``capacity`` rows, whatever the number of documents. Items above a third of the capacity stand
at most two to a sequence; the largest one is matched with the largest that fits beside it,
over and over, which gives as many pairs as there can be. Smaller ones, longest first, go where
the least room that suffices is left. All sequences with equal room are one entry of the plan.

The plan says which places in which sequences the items of each length get, in order. An item
finds its own by its number among those of its length, which is counted in two levels, so no
length is one task however many items have it.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
BUCKET_ROWS = 1 << 12
#: Parts of words whose ids a task keeps at hand: twice as many at most.
HELD_WORDS = 500_000


class Recent:
    """A table of answers that keeps the ones asked for lately, up to twice ``most``."""

    def __init__(self, answer: Callable, most: int) -> None:
        self.answer, self.most = answer, most
        self.now: dict = {}
        self.before: dict = {}

    def all_of(self, keys: list) -> list:
        found = list(map(self.now.get, keys))
        at, missing = 0, found.count(None)
        for _ in range(missing):
            at = found.index(None, at)
            found[at] = self._one(keys[at])
        return found

    def _one(self, key):
        found = self.now.get(key)
        if found is None:
            found = self.before.get(key)
            if found is None:
                found = self.answer(key)
            if len(self.now) >= self.most:
                self.before, self.now = self.now, {}
            self.now[key] = found
        return found


class WordEncoder:
    """Token ids of whole texts, part by part: nothing in this vocabulary spans two parts of a text.

    Texts of ASCII and Latin letters are lower-cased and parted here, where that is plain, and
    each part goes to the library's merge model once. Of other texts every word goes to the
    library whole, as nothing spans white space; so does all that holds a special token.
    """

    # İ lower-cases to two characters and is not plain.
    _PLAIN = re.compile("[\t-\r -~À-įı-ɏ]*")
    _PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]|[!-/:-@\[-`{-~×÷]+")
    _SPACES = "\t\n\v\f\r"

    def __init__(self, path: str, held: int = HELD_WORDS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)").search
        self.as_id = [struct.pack("<I", i) for i in range(self.library.get_vocab_size())]
        byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = str.maketrans({c: "".join(p for p, _ in byte.pre_tokenize_str(c)) for c in map(chr, range(0xC0, 0x250))})
        self.words, self.parts = Recent(self._word, held // 4), Recent(self._part, held)

    def _part(self, part: str) -> bytes:
        return b"".join([self.as_id[t.id] for t in self.model.tokenize(part if part.isascii() else part.translate(self.as_bytes))])

    def _word(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as unsigned little-endian 32-bit numbers."""
        text = text or ""
        if self._PLAIN.fullmatch(text) and not self.special(text):
            return b"".join(self.parts.all_of(self._PARTS.findall(text.lower())))
        for space in self._SPACES:
            text = text.replace(space, " ")
        return b"".join(self.words.all_of(text.split(" ")))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def vocabulary_path(vocabulary: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def token_pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token ids of each document and an end id, cut at the capacity.

    ``vocabulary`` is the name of an installed vocabulary or the path of one; ``ids`` adds the
    ids themselves. A null or empty text is the end id alone.
    """
    kind = docs.schema[key].dataType.simpleString()
    more = ["ids"] if ids else []

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary if "/" in vocabulary else vocabulary_path(vocabulary))
        for batch in batches:
            rows, pieces, starts, lengths, sums, held = [], [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                data = own.encode(t) + struct.pack("<I", END)
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if ids:
                        held.append(np.frombuffer(part, "<u4").astype("int32"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, pa.list_(pa.int32()))] if ids else []), ["doc_id", "piece", "start", "length", "ids_crc32", *more])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class Plan:
    """Places for the items of each length: rows of (length, first item, first sequence, offset, items a sequence)."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = {n: count for n, count in histogram.items() if count > 0}
        self.given = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.places: list[tuple[int, int, int, int, int]] = []
        self.with_room: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        self._match_large()
        self._fill_gaps()

    def _place(self, length: int, sequences: tuple[int, int], offset: int, each: int = 1) -> None:
        """``each`` items one after the other from ``offset`` on, in each of the (first, count) sequences."""
        self.places.append((length, self.given[length], sequences[0], offset, each))
        self.given[length] += sequences[1] * each
        self.left[length] -= sequences[1] * each

    def _open(self, count: int) -> tuple[int, int]:
        self.sequences += count
        return self.sequences - count, count

    def _keep(self, sequences: tuple[int, int], room: int) -> None:
        if room and sequences[1]:
            if room not in self.with_room:
                self.with_room[room] = []
                insort(self.rooms, room)
            self.with_room[room].append(sequences)

    def _match_large(self) -> None:
        large = sorted(n for n in self.left if 3 * n > self.capacity)
        while large:
            n = large[-1]
            at = bisect_right(large, self.capacity - n) - 1
            if at >= 0 and large[at] == n and self.left[n] == 1:
                at -= 1
            if at < 0:
                alone = self._open(self.left[n])
                self._place(n, alone, 0)
                self._keep(alone, self.capacity - n)
            elif large[at] == n:
                pairs = self._open(self.left[n] // 2)
                self._place(n, pairs, 0, 2)
                self._keep(pairs, self.capacity - 2 * n)
            else:
                other = large[at]
                pairs = self._open(min(self.left[n], self.left[other]))
                self._place(n, pairs, 0)
                self._place(other, pairs, n)
                self._keep(pairs, self.capacity - n - other)
                if not self.left[other]:
                    del large[at]
            if not self.left[n]:
                large.pop()

    def _fill_gaps(self) -> None:
        for n in sorted((n for n, count in self.left.items() if count), reverse=True):
            while self.left[n]:
                at = bisect_left(self.rooms, n)
                if at == len(self.rooms):
                    each = self.capacity // n
                    self._keep(self._open(max(1, self.left[n] // each)), self.capacity)
                    continue
                room = self.rooms[at]
                first, count = self.with_room[room].pop()
                if not self.with_room[room]:
                    del self.with_room[room], self.rooms[at]
                # One that has taken an item still has the least room that suffices, so it takes all it can.
                each = min(room // n, self.left[n])
                filled = min(count, self.left[n] // each)
                self._place(n, (first, filled), self.capacity - room, each)
                self._keep((first, filled), room - each * n)
                self._keep((first + filled, count - filled), room)


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``items``: as few sequences of ``capacity`` as can be, without gaps.

    Items longer than the capacity, of length null or below one, have no place: both are null.
    Rows equal in all columns are interchangeable; all columns must be of types that can be
    ordered. An empty table gives an empty result. Columns of the two names are replaced, other columns stay.
    """
    items = items.drop("sequence_id", "offset")
    columns = items.columns
    name = lambda x: next(c for c in (x + "_" * i for i in range(len(columns) + 1)) if c not in columns)
    bucket, before, nth = name("bucket"), name("before"), name("nth")
    items, _ = materialize(items, "pack-items")
    fits = F.col(length).between(1, capacity)
    # The driver gets a row for each length that occurs: as many as the capacity at most.
    histogram = {r[0]: r[1] for r in items.where(fits).groupBy(F.col(length).cast("long")).count().collect()}
    plan = Plan(histogram, capacity)
    several = {n: -(-count // BUCKET_ROWS) for n, count in histogram.items() if count > BUCKET_ROWS}
    buckets = F.create_map(*[F.lit(x) for pair in sorted(several.items()) for x in pair])[F.col(length).cast("long")] if several else F.lit(1)
    dealt = items.where(fits).withColumn(bucket, F.pmod(F.xxhash64(*columns), F.coalesce(buckets, F.lit(1))))
    starts = (
        dealt.groupBy(F.col(length), F.col(bucket)).count()
        .withColumn(before, F.sum("count").over(Window.partitionBy(length).orderBy(bucket)) - F.col("count"))
        .drop("count")
    )
    numbered = dealt.withColumn(nth, F.row_number().over(Window.partitionBy(length, bucket).orderBy(*columns))).join(starts, [length, bucket])
    places = np.array(sorted(plan.places), np.int64).reshape(-1, 5)
    keys = places[:, 0] << 48 | places[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        n, i = length.to_numpy(np.int64), nth.to_numpy(np.int64)
        _, first, sequence, offset, each = places[np.searchsorted(keys, n << 48 | i, side="right") - 1].T
        return pd.DataFrame({"sequence_id": sequence + (i - first) // each, "offset": offset + (i - first) % each * n})

    placed = name("place")
    found = numbered.withColumn(placed, place(F.col(length).cast("long"), F.col(nth) + F.col(before) - 1))
    packed = found.select(*columns, F.col(placed)["sequence_id"].alias("sequence_id"), F.col(placed)["offset"].alias("offset"))
    none = F.lit(None).cast("long")
    return packed.union(items.where(~F.coalesce(fits, F.lit(False))).select(*columns, none, none))


def pack_documents(docs: DataFrame) -> DataFrame:
    """The op13 result: a row per piece of each document row and its place.

    Null and empty texts are the end id alone; only documents over the capacity are cut; a
    null id is an id like any other. Repeated rows are packed as often as they stand there,
    extra columns are not read, and an empty table gives an empty result.
    """
    return pack(token_pieces(docs))


def packed_sequences(docs: DataFrame, **options) -> DataFrame:
    """(sequence_id, ids, doc_ids): the sequences themselves, of at most the capacity of ids each."""
    pieces = pack(token_pieces(docs, ids=True, **options), capacity=options.get("capacity", CAPACITY))
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
