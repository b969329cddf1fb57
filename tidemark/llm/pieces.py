"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words, a run of word marks with the characters up to the next one, and
words into units wherever two characters meet that stand side by side in no piece. No merge
can cross such a cut, so units are encoded one by one and their ids are those of the whole
text. Each distinct unit of the corpus is encoded once:

* its substrings of up to the longest piece's length are exploded and equi-joined to the piece
  table, whose size is the vocabulary's;
* the edges that remain are grouped by unit into its lattice;
* a higher-order ``aggregate`` folds the lattice. For a unigram model the fold is Viterbi over
  the end positions. For a BPE model the best sum of scores is not the encoding (its scores
  are merge ranks), so the fold merges: each step joins the adjacent pair of lattice nodes
  whose joint edge has the best rank.

The documents are read once. Each task packs them in chunks of bounded text: documents as
numbers of words, words as numbers of units. Chunks are dealt by name; their distinct units go
by unit to the lattices, and the symbols come back by chunk, so no word is shuffled one by
one. A symbol is an id, or a character in no edge, which the chunk's task resolves. Units of
one character need no lattice, and a unit longer than ``MAX_FOLD`` characters takes the same
merges from a heap there, since the fold's work grows with the square of a unit's length.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MAX_FOLD = 256
#: Characters of a chunk, and of the part of a chunk that is cut into words at once.
CHUNK_CHARS = 16_000_000
PART_CHARS = 1_500_000
#: Answers that a task packs at once.
ANSWER_ROWS = 1 << 19
#: Vocabularies of more pieces are joined without a broadcast.
BROADCAST_PIECES = 1 << 18
UNKNOWN_PENALTY = 10.0
_SPAN_BITS, _ID_BITS = 9, 22
_SPAN, _ID = (1 << _SPAN_BITS), (1 << _ID_BITS)


@dataclass(frozen=True)
class Vocabulary:
    """Ordinary pieces with ids and scores, the 256 byte pieces (or none), and the unknown id."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    unknown: int
    kind: str

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    def cutter(self) -> Cutter:
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word mark after a character: texts can't be cut at marks")
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        known = sorted({c for p in pairs for c in p})
        at = {c: i + 1 for i, c in enumerate(known)}
        joins = np.zeros((len(known) + 1, len(known) + 1), bool)
        for p in pairs:
            joins[at[p[0]], at[p[1]]] = True
        number = np.zeros(max(map(ord, known), default=0) + 1, np.int32)
        number[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        return Cutter(number, joins)

    def piece_bytes(self) -> dict[int, bytes]:
        """What each id stands for; a mark is a space."""
        out = {i: p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p, i in self.ids.items()}
        out.update({i: bytes([b]) for b, i in enumerate(self.byte_ids)})
        return out


@dataclass(frozen=True)
class Cutter:
    """Cuts strings between characters that stand side by side in no piece: no merge crosses there.

    ``number`` has the place of a character among those of longer pieces (0: in none), and
    ``joins`` the pairs that some piece holds.
    """

    number: np.ndarray
    joins: np.ndarray

    def __call__(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of all words, one after another, and how many each word has. The parts lie in the words' own bytes."""
        bounds = _bounds(words).astype(np.int64)
        data = words.buffers()[2]
        data = data.slice(bounds[0], bounds[-1] - bounds[0]) if data is not None else pa.py_buffer(b"")
        points = np.frombuffer(data.to_pybytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate(([0], np.cumsum(widths)))  # the byte where each character starts
        firsts, lasts = np.searchsorted(at, bounds[:-1] - bounds[0]), np.searchsorted(at, bounds[1:] - bounds[0])
        places = np.where(points < len(self.number), self.number[np.minimum(points, len(self.number) - 1)], 0)
        cut = np.ones(len(points), bool)  # whether a part starts at each character
        cut[1:] = ~self.joins[places[:-1], places[1:]]
        cut[firsts[lasts > firsts]] = True
        starts = np.concatenate((at[:-1][cut], at[-1:]))
        parts = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), data)
        before = np.concatenate(([0], np.cumsum(cut)))
        return parts, before[lasts] - before[firsts]


def load(path: str = MODEL, kind: str = "bpe") -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    plain = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
    return Vocabulary(
        {model.id_to_piece(i): i for i in plain},
        {model.id_to_piece(i): float(model.get_score(i)) for i in plain},
        tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else (),
        model.unk_id(),
        kind,
    )


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(piece, id, score, rank): rank 0 is the best score, equal scores share a rank."""
    rank = {x: i for i, x in enumerate(sorted(set(vocabulary.scores.values()), reverse=True))}
    rows = [(p, i, vocabulary.scores[p], rank[vocabulary.scores[p]]) for p, i in vocabulary.ids.items()]
    return spark.createDataFrame(rows, "piece string, id int, score double, rank int")


def lattices(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, n, edges) and the other columns of ``units``: the lattice of each distinct unit.

    Merges need no edges of one character. For Viterbi each character has one, without an id
    if it is unknown. A unit without edges has no row.
    """
    bpe = vocabulary.kind == "bpe"
    n, a, b, shortest = F.col("n"), F.col("a"), F.col("b"), 2 if bpe else 1
    pieces = piece_table(units.sparkSession, vocabulary)
    if len(vocabulary.ids) <= BROADCAST_PIECES:
        pieces = F.broadcast(pieces)
    more = [c for c in units.columns if c != "unit"]
    sized = units.withColumn("n", F.length("unit"))
    starts = sized.withColumn("a", F.explode(F.when(n >= shortest, F.sequence(F.lit(0), n - shortest))))
    ends = starts.withColumn("b", F.explode(F.sequence(a + shortest, F.least(a + vocabulary.longest, n))))
    spelled = ends.where(b - a >= shortest).withColumn("piece", F.substring("unit", a + 1, b - a))
    if bpe:
        edges, edge = spelled.join(pieces, "piece"), _packed(a, b)
    else:
        edges, edge = spelled.join(pieces, "piece", "left").where("id is not null or b = a + 1"), F.struct("a", "b", "id", "score")
    return edges.groupBy("unit").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in more], F.collect_list(edge).alias("edges"))


def _packed(a: Column, b: Column) -> Column:
    """An edge of a BPE lattice in one number: both ends (9 bits each), rank (22), id (22)."""
    return F.shiftleft((a * _SPAN + b).cast("long"), 2 * _ID_BITS) + F.shiftleft(F.col("rank").cast("long"), _ID_BITS) + F.col("id")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merge_fold(spans: Column, n: Column) -> Column:
    """Bounds of the merged symbols. Of equal ranks the leftmost pair merges first.

    The state has a number per bound: the rank of the edge that would take its place, then the
    bound. The least of all is the best rank, then the leftmost; once it is gone, only the
    ranks of the two bounds beside it are looked up again.
    """
    none = F.lit(1 << 40)
    bound_of = lambda x: x.bitwiseAND(F.lit(_SPAN - 1))

    def ranked(a: Column, bound: Column, b: Column) -> Column:
        return F.coalesce(F.shiftright(F.element_at(spans, (a * _SPAN + b).cast("int")), _ID_BITS), none) * _SPAN + bound

    def renewed(rest: Column, i: Column) -> Column:
        x = F.get(rest, i)
        inner = (i > 0) & (i < F.size(rest) - 1)
        return F.when(inner, ranked(bound_of(F.get(rest, i - 1)), bound_of(x), bound_of(F.get(rest, i + 1)))).otherwise(x)

    def without(state: Column, best: Column) -> Column:
        def beside(rest: Column, at: Column) -> Column:
            return F.concat(F.slice(rest, F.lit(1), at - 2), F.array(renewed(rest, at - 2), renewed(rest, at - 1)), F.slice(rest, at + 1, F.size(rest)))

        return _let(F.array_remove(state, best), lambda rest: _let(F.array_position(state, best).cast("int"), lambda at: beside(rest, at)))

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state), lambda best: F.when(best >= none * _SPAN, state).otherwise(without(state, best)))

    bounds = F.sequence(F.lit(0), n)
    start = F.transform(bounds, lambda i: F.when((i > 0) & (i < n), ranked(i - 1, i, i + 1)).otherwise(none * _SPAN + i))
    return F.aggregate(F.sequence(F.lit(2), n), start, step, lambda state: F.transform(state, lambda x: bound_of(x).cast("int")))


def viterbi_fold(edges: Column, n: Column, unknown_score: float) -> Column:
    """Bounds of the best path; of equal scores the longest last piece wins."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("a")))

    def step(best: Column, end: Column) -> Column:
        arrivals = F.transform(
            F.filter(edges, lambda e: e["b"] == end),
            lambda e: F.struct((F.get(best, e["a"])["score"] + F.coalesce(e["score"], F.lit(unknown_score))).alias("score"), (-e["a"]).alias("a")),
        )
        return _let(F.array_max(arrivals), lambda m: F.concat(best, F.array(F.struct(m["score"].alias("score"), (-m["a"]).alias("a")))))

    best = F.aggregate(F.sequence(F.lit(1), n), start, step)
    back = F.aggregate(
        F.sequence(F.lit(1), n),
        F.array(n),
        lambda path, _: F.when(F.element_at(path, 1) > 0, F.concat(F.array(F.get(best, F.element_at(path, 1))["a"]), path)).otherwise(path),
    )
    return back


def encode_units(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, symbols) and the other columns of ``units``, for distinct units of at most ``MAX_FOLD`` characters: an id, or minus one minus the code point of a character in no edge.

    Units that no piece has two characters of have no row: they are their characters.
    """
    n = F.col("n")
    found = lattices(units, vocabulary)
    if vocabulary.kind == "bpe":
        spans = F.map_from_arrays(F.transform("edges", lambda e: F.shiftright(e, 2 * _ID_BITS).cast("int")), F.transform("edges", lambda e: e.bitwiseAND(F.lit((1 << 2 * _ID_BITS) - 1))))
        bounds = merge_fold(F.col("spans"), n)
        id_of = lambda edge: edge.bitwiseAND(F.lit(_ID - 1)).cast("int")
    else:
        spans = F.map_from_entries(F.transform("edges", lambda e: F.struct(e["a"] * _SPAN + e["b"], e["id"])))
        bounds = viterbi_fold(F.col("edges"), n, min(vocabulary.scores.values(), default=0.0) - UNKNOWN_PENALTY)
        id_of = lambda edge: edge
    character = lambda a: -1 - F.ascii(F.substring(F.col("unit"), a + 1, F.lit(1)))
    symbols = F.transform(
        F.sequence(F.lit(0), F.size("bounds") - 2),
        lambda p: _let(F.get("bounds", p), lambda a: F.coalesce(id_of(F.element_at(F.col("spans"), a * _SPAN + F.get("bounds", p + 1))), character(a))),
    )
    return found.withColumn("spans", spans).withColumn("bounds", bounds).select(*units.columns, symbols.alias("symbols"))


def encode_long(unit: str, vocabulary: Vocabulary) -> list[int]:
    """The ids of one long unit: merges from a heap for BPE, Viterbi position by position for unigram."""
    if vocabulary.kind != "bpe":
        return _viterbi_long(unit, vocabulary)
    n, longest = len(unit), vocabulary.longest
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    scores = vocabulary.scores
    heap = [(-scores[unit[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if unit[i : i + 2] in scores]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if not (alive[a] and end[a] == b and b < n and alive[b] and end[b] == c):
            continue
        end[a], alive[b] = c, False
        if c < n:
            before[c] = a
            piece = unit[a : end[c]] if end[c] - a <= longest else ""
            if piece in scores:
                heapq.heappush(heap, (-scores[piece], a, c, end[c]))
        p = before[a]
        if p >= 0:
            piece = unit[p:c] if c - p <= longest else ""
            if piece in scores:
                heapq.heappush(heap, (-scores[piece], p, a, c))
    out, at = [], 0
    while at < n:
        out += _ids_of(unit[at : end[at]], vocabulary)
        at = end[at]
    return out


def _ids_of(piece: str, vocabulary: Vocabulary) -> list[int]:
    if piece in vocabulary.ids:
        return [vocabulary.ids[piece]]
    return [vocabulary.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if vocabulary.byte_ids else [vocabulary.unknown]


def _viterbi_long(unit: str, vocabulary: Vocabulary) -> list[int]:
    unknown = min(vocabulary.scores.values(), default=0.0) - UNKNOWN_PENALTY
    best, back = [0.0], [0]
    for e in range(1, len(unit) + 1):
        arrivals = [(best[a] + vocabulary.scores[unit[a:e]], -a) for a in range(max(0, e - vocabulary.longest), e) if unit[a:e] in vocabulary.scores]
        if unit[e - 1] not in vocabulary.scores:
            arrivals.append((best[e - 1] + unknown, 1 - e))
        score, a = max(arrivals)
        best.append(score)
        back.append(-a)
    bounds = [len(unit)]
    while bounds[-1]:
        bounds.append(back[bounds[-1]])
    bounds.reverse()
    return [i for a, b in zip(bounds, bounds[1:], strict=False) for i in _ids_of(unit[a:b], vocabulary)]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each text has. A mark is still a space here.

    A word starts at each space that no space precedes; a text starts after a mark, an empty
    one has no word.
    """
    marks = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" "), texts, "")).cast(pa.string())
    bounds = _bounds(marks).astype(np.int64)
    data = marks.buffers()[2]
    data = data.slice(bounds[0], bounds[-1] - bounds[0]) if data is not None else pa.py_buffer(b"")
    bounds = bounds - bounds[0]
    space = np.frombuffer(data, np.uint8) == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    starts = np.flatnonzero(first)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(space)).astype(np.int32)), data)
    return words, np.diff(np.searchsorted(starts, bounds))


class _Packer:
    """Packs the documents of a task in chunks: (chunk, packed).

    A chunk's name holds its task and place, so chunks of equal content are dealt apart, and a
    digest of its content, so that a task that was repeated with other documents is found out.
    """

    def __init__(self, cutter: Cutter, chunk_chars: int) -> None:
        self.cutter, self.chunk_chars, self.part_chars = cutter, chunk_chars, min(chunk_chars, PART_CHARS)

    def __call__(self, batches):
        task, place = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        parts, size = [], 0
        for part, chars in self.slices(batches):
            parts.append(self.part(part))
            size += chars
            if size >= self.chunk_chars:
                yield self.finish(parts, f"{task}-{place}")
                parts, size, place = [], 0, place + 1
                pa.default_memory_pool().release_unused()
        if parts:
            yield self.finish(parts, f"{task}-{place}")

    def slices(self, batches):
        """Runs of documents of about ``part_chars`` characters; no run spans two batches."""
        for batch in batches:
            lengths = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = before = 0
            while start < batch.num_rows:
                end = min(int(np.searchsorted(lengths, before + self.part_chars)) + 1, batch.num_rows)
                yield batch.slice(start, end - start), int(lengths[end - 1]) - before
                start, before = end, int(lengths[end - 1])

    def part(self, batch: pa.RecordBatch):
        texts = pc.fill_null(batch.column(1), "")
        digests = pa.array([hashlib.md5(t.as_buffer()).digest() for t in texts], pa.binary())
        words, n = _words(texts)
        encoded = pc.dictionary_encode(words)
        docs = pa.table({"doc_id": batch.column(0), "digest": digests, "words": pa.array(n, pa.int32())})
        return docs, encoded.indices.to_numpy().astype(np.int32), encoded.dictionary

    def finish(self, parts, name: str) -> pa.RecordBatch:
        docs = pa.concat_tables([d for d, _, _ in parts]).combine_chunks()
        digest = hashlib.md5(b"".join(docs.column("digest").to_pylist())).hexdigest()
        every = pc.dictionary_encode(pa.concat_arrays([w for _, _, w in parts]))
        renamed = np.split(every.indices.to_numpy(), np.cumsum([len(w) for _, _, w in parts])[:-1])
        numbers = np.concatenate([new[picks] for new, (_, picks, _) in zip(renamed, parts, strict=True)])
        cuts = [self.cutter(pc.replace_substring(every.dictionary.slice(k, 1 << 17), " ", MARK)) for k in range(0, len(every.dictionary), 1 << 17)]
        units = pc.dictionary_encode(pa.concat_arrays([u for u, _ in cuts])) if cuts else pa.array([], pa.string()).dictionary_encode()
        n = np.concatenate([n for _, n in cuts]) if cuts else np.zeros(0, np.int64)
        packed = _pack(docs, units.dictionary, _new_as_zero(numbers), n, _new_as_zero(units.indices.to_numpy()))
        chunk = int.from_bytes(hashlib.md5(f"{name}-{digest}".encode()).digest()[:8], "little", signed=True)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([packed], pa.binary())], ["chunk", "packed"])


def _bounds(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]


def _new_as_zero(numbers: np.ndarray) -> np.ndarray:
    """Numbers given in order of first appearance, with 0 for a new one and one more for a known one."""
    before = np.concatenate(([-1], np.maximum.accumulate(numbers)[:-1])) if len(numbers) else numbers
    return np.where(numbers > before, 0, numbers + 1)


def _zero_as_new(numbers: np.ndarray) -> np.ndarray:
    new = numbers == 0
    return np.where(new, np.cumsum(new, dtype=np.int32) - 1, numbers - 1)


def _pack(docs: pa.Table, units: pa.Array, *arrays: np.ndarray) -> bytes:
    """Units first, then documents, then arrays of small numbers, compressed; bytes of one weight stand together."""
    sink = io.BytesIO()
    for table in (pa.table({"unit": units}), docs):
        block = io.BytesIO()
        with pa.ipc.new_stream(block, table.schema) as writer:
            writer.write_table(table)
        sink.write(block.tell().to_bytes(8, "little") + block.getvalue())
    sink.write(_planes(*arrays))
    return zstandard.compress(sink.getvalue(), 6)


def _planes(*arrays: np.ndarray) -> bytes:
    planes = [np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays]
    return b"".join(len(x).to_bytes(8, "little") + x for x in planes)


def _blocks(packed: bytes):
    blob = memoryview(zstandard.decompress(packed))
    at = 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        yield blob[at + 8 : at + 8 + n]
        at += 8 + n


def _table(block) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(block)) as reader:
        return reader.read_all().combine_chunks()


def _numbers(block) -> np.ndarray:
    return np.frombuffer(block, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def _units_of(packed: bytes) -> tuple[pa.Array, np.ndarray]:
    """The units of a chunk and which of them have a lattice."""
    column = _table(next(_blocks(packed))).column("unit")
    units = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    n = pc.utf8_length(units).to_numpy(zero_copy_only=False)
    return units, (n >= 2) & (n <= MAX_FOLD)


def chunk_units(chunks: DataFrame) -> DataFrame:
    """(unit, chunk, at): the distinct units of each chunk that need a lattice, numbered in order."""

    def run(batches):
        for batch in batches:
            for name, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units, wanted = _units_of(packed)
                at, units = np.flatnonzero(wanted).astype(np.int32), units.filter(pa.array(wanted))
                for k in range(0, len(at), 1 << 15):
                    part = units.slice(k, 1 << 15)
                    yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(part), name, np.int64)), pa.array(at[k : k + (1 << 15)])], ["unit", "chunk", "at"])

    return chunks.mapInArrow(run, "unit string, chunk long, at int")


def _ragged(lists) -> tuple[np.ndarray, np.ndarray]:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)


def _gather(values: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows ``picks`` of (values, offsets), one after another, and their lengths."""
    lengths = (offsets[1:] - offsets[:-1])[picks]
    total = int(lengths.sum())
    starts = offsets[:-1][picks]
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return values[np.arange(total) + shift], lengths


def packed_answers(answers: DataFrame) -> DataFrame:
    """(chunk, packed) from (chunk, at, symbols): the answers of a task for each chunk, compressed. A unit without symbols has length -1."""

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks().sort_by([("chunk", "ascending"), ("at", "ascending")])
        chunk, at, symbols = table.column("chunk").to_numpy(), table.column("at").to_numpy(), table.column("symbols").combine_chunks()
        lengths = pc.fill_null(symbols.value_lengths(), -1).to_numpy(zero_copy_only=False)
        values, ends = symbols.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))))
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        blobs = [zstandard.compress(_planes(np.diff(at[a:b], prepend=0), lengths[a:b], values[ends[a] : ends[b]]), 1) for a, b in itertools.pairwise(cuts)]
        return pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]]), pa.array(blobs, pa.binary())], ["chunk", "packed"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ANSWER_ROWS:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return answers.select("chunk", "at", "symbols").mapInArrow(run, "chunk long, packed binary")


def _unit_ids(units: pa.Array, wanted: np.ndarray, answers: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a chunk's units, ragged: from their lattices, from the heap, or of their characters alone."""
    columns = [[_numbers(x) for x in _blocks(a)] for a in answers]
    at, lengths, values = (np.concatenate([np.zeros(0, np.int32), *c]) for c in ((np.cumsum(x[0]) for x in columns), (x[1] for x in columns), (x[2] for x in columns)))
    if not np.array_equal(np.sort(at), np.flatnonzero(wanted)):
        raise ValueError("the documents came in other chunks the second time; write them as a table first")
    found = np.zeros(len(units), bool)
    found[at[lengths >= 0]] = True
    rest = [encode_long(u, vocabulary) if len(u) > MAX_FOLD else [-1 - ord(c) for c in u] for u in units.filter(pa.array(~found)).to_pylist()]
    values = np.concatenate((values, np.fromiter(itertools.chain.from_iterable(rest), np.int32)))
    offsets = np.concatenate(([0], np.cumsum(np.concatenate((lengths[lengths >= 0], np.array([len(x) for x in rest], np.int64)))))).astype(np.int64)
    order = np.empty(len(units), np.int64)
    order[np.concatenate((at[lengths >= 0], np.flatnonzero(~found)))] = np.arange(len(units))
    values, lengths = _gather(values, offsets, order)
    # Each symbol stands for one id, or for the bytes of an unknown character.
    known, picks = np.unique(values, return_inverse=True)
    spelled = [[v] if v >= 0 else _ids_of(chr(-1 - v), vocabulary) for v in known.tolist()]
    n = np.array([len(x) for x in spelled], np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    ids, each = _gather(np.array(list(itertools.chain.from_iterable(spelled)), np.int32), np.concatenate(([0], np.cumsum(n))), picks)
    return ids, np.concatenate(([0], np.cumsum(each)))[ends]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, ids, round_trip) per document row; ``round_trip`` says that the ids decode to the text.

    Null and empty texts have no ids; very long ones are chunks of their own. Repeated rows
    keep their own output rows, null ids are ids like others, extra columns are not read, and
    an empty table gives an empty result. A literal word mark in a text decodes to a space, as
    the model has it.
    """
    vocabulary = vocabulary or load()
    kind = docs.schema["doc_id"].dataType.simpleString()
    deal = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One exchange serves the units and the documents; its count keeps it from being merged by size, as a row is seconds of work.
    chunks = docs.select("doc_id", "text").mapInArrow(_Packer(vocabulary.cutter(), chunk_chars), "chunk long, packed binary").repartition(deal, "chunk")
    # One exchange serves both sides of the join as well: the bounds, which always hold, keep all columns in use on both.
    held = chunk_units(chunks).where("unit is not null").repartition("unit")
    distinct = held.groupBy("unit").agg(F.max("chunk").alias("last_chunk"), F.max("at").alias("last_at"))
    encoded = encode_units(distinct, vocabulary).withColumnRenamed("unit", "found")
    bounds = (F.col("chunk") <= F.col("last_chunk")) & (F.col("at") <= F.col("last_at"))
    answers = packed_answers(held.join(encoded, (F.col("unit") == F.col("found")) & bounds, "left"))
    piece_bytes = vocabulary.piece_bytes()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for packed in left.column("packed").to_pylist():
            _, doc_block, *blocks = _blocks(packed)
            docs, words, n, parts = _table(doc_block), *map(_numbers, blocks)
            values, offsets = _unit_ids(*_units_of(packed), right.column("packed").to_pylist(), vocabulary)
            values, lengths = _gather(values, offsets, _zero_as_new(parts))
            offsets = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(n))).astype(np.int64)]  # now of words
            spelled = [b"".join([piece_bytes.get(i, b"\xef\xbf\xbd") for i in values[a:b].tolist()]) for a, b in itertools.pairwise(offsets.tolist())]
            out += _parts(docs, _zero_as_new(words), values, offsets, spelled)
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, f"doc_id {kind}, ids array<int>, round_trip boolean")


def _parts(docs: pa.Table, picks: np.ndarray, values: np.ndarray, offsets: np.ndarray, spelled: list[bytes]):
    """The output rows of a chunk, some documents at a time."""
    ends = np.concatenate(([0], np.cumsum(docs.column("words").to_numpy()))).astype(np.int64)
    start = 0
    while start < docs.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + (1 << 18), "right")) - 1)
        own = picks[ends[start] : ends[end]]
        ids, lengths = _gather(values, offsets, own)
        cuts = ends[start : end + 1] - ends[start]
        texts = list(map(spelled.__getitem__, own.tolist()))
        same = [hashlib.md5(b"".join(texts[a:b])[1:]).digest() == d for (a, b), d in zip(itertools.pairwise(cuts.tolist()), docs.column("digest").slice(start, end - start).to_pylist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths)))[cuts], pa.int32()), pa.array(ids, pa.int32()))
        yield pa.table({"doc_id": docs.column("doc_id").slice(start, end - start), "ids": lists, "round_trip": pa.array(same, pa.bool_())})
        start = end


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): pieces joined, marks as spaces, the leading one left out."""
    vocabulary = vocabulary or load()
    spelled = vocabulary.piece_bytes()
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else b"".join([spelled.get(i, b"\xef\xbf\xbd") for i in ids])[1:].decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encoded_digest(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """What the query returns: doc_id, n_tokens, a hash of the ids, and the round trip."""
    return encode_documents(docs, vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip")
