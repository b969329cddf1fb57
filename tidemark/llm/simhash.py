"""Near-duplicate documents by 64-bit SimHash and BK-trees.

A fingerprint sets a bit where more than half of the document's 3-word shingle hashes set
it. Two fingerprints link when at most ``radius`` bits differ. The bits are cut into
``radius + 3`` blocks; such a pair agrees on at least three of them, so each choice of three
blocks and their value is a shard: 20 shards a fingerprint, by keys of some 32 bits. A shard's
distinct fingerprints become BK-trees (children keyed by their integer Hamming distance to the
parent) and a probe follows only the edges within the radius.

A driver broadcast of the trees would carry the fingerprints of all documents through the
driver. Each shard's trees go instead to the probes of that shard alone, by key. A shard of
more than ``tree_size`` fingerprints is several trees of bounded size, and every tree is
sent to each bounded block of the shard's probes, so no task holds a whole hot shard.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.graph import connected_components
from tidemark.session import free_names, materialize

KEY_BLOCKS = 3
TREE_SIZE = 2048
_BIT_SUMS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text; a text without words gives zero.

    Only A-Z are lower-cased and only the six ASCII white-space characters separate words,
    which is what ``bytes.lower`` and ``bytes.split`` do.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    sums = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            sums[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BIT_SUMS
    bits = np.nonzero(2 * sums > len(hashes))[0]
    return int(sum(1 << int(b) for b in bits))


def with_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): one row per document row; ``fp`` is the fingerprint as a signed long."""
    kind = docs.schema[key].dataType

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, fp long"
    )


class BKTree:
    """A BK-tree over integers; each node keeps its children by distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        if not new:
            return
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                return
            at = self.children[at][d]

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of the values at distance ``radius`` or less; only edges d-radius to d+radius are followed."""
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            low, high = d - radius, d + radius
            stack += [child for edge, child in children[at].items() if low <= edge <= high]
        return found


def _forest(fps: list[int], tree_side: list[bool], probe_side: list[bool], radius: int) -> list[tuple[int, int]]:
    """Links of one tree with one block of probes, as positions, thinned to a forest: components need no more."""
    tree, placed = BKTree(), []
    for i, fp in enumerate(fps):
        if tree_side[i]:
            tree.add(fp)
            placed.append(i)
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, fp in enumerate(fps):
        if probe_side[i]:
            for hit in tree.within(fp, radius):
                a, b = root(i), root(placed[hit])
                if a != b:
                    parent[a] = b
                    links.append((i, placed[hit]))
    return links


def _probe_sorted(batches, radius: int):
    """The links of every group in batches that come sorted by (band, part, i, j); a group may span batches."""
    held = None

    def links_of(rows: list[np.ndarray]) -> pa.RecordBatch:
        keys, fps, in_tree, in_probe = rows
        change = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
        src, dst = [], []
        for a, b in itertools.pairwise([0, *change.tolist(), len(fps)]):
            group = fps[a:b]
            for x, y in _forest(group.view(np.uint64).tolist(), in_tree[a:b].tolist(), in_probe[a:b].tolist(), radius):
                src.append(group[x])
                dst.append(group[y])
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = [np.stack(columns[:4], axis=1).astype(np.int64), np.ascontiguousarray(columns[4]), columns[5], columns[6]]
        if held is not None:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
        if not len(rows[1]):
            continue
        last = np.nonzero((rows[0] != rows[0][-1]).any(axis=1))[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links_of([r[:cut] for r in rows])
        held = [r[cut:] for r in rows]
    if held is not None:
        yield links_of(held)


def link_fingerprints(fps: DataFrame, radius: int = 3, tree_size: int = TREE_SIZE) -> DataFrame:
    """(src, dst) links between distinct fingerprints that suffice for the components.

    Shards of one fingerprint link nothing and are left out before any Python runs. Groups are
    small and many, so a task reads them sorted, one after another.
    """
    cuts = [round(64 * i / (radius + KEY_BLOCKS)) for i in range(radius + KEY_BLOCKS + 1)]
    blocks = [sum(1 << bit for bit in range(lo, hi)) for lo, hi in itertools.pairwise(cuts)]
    masks = [int(np.uint64(sum(chosen)).view(np.int64)) for chosen in itertools.combinations(blocks, KEY_BLOCKS)]
    pieces = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])
    cells = fps.select("fp").distinct().select("fp", F.explode(pieces).alias("c")).select("fp", "c.band", "c.part")
    sizes = cells.groupBy("band", "part").agg(F.count("*").alias("n")).where("n > 1")
    shards = cells.join(sizes, ["band", "part"]).withColumn("k", F.ceil(F.col("n") / tree_size).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    # The unordered pairs (i <= j) of a shard's blocks, of which this fingerprint is in one.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")),
    )
    dealt = (
        shards.withColumn("own", own)
        .select("band", "part", "fp", "own", F.explode(pairs).alias("p"))
        .select("band", "part", "p.i", "p.j", "fp", (F.col("own") == F.col("p.i")).alias("in_tree"), (F.col("own") == F.col("p.j")).alias("in_probe"))
    )

    def run(batches):
        return _probe_sorted(batches, radius)

    keys = ["band", "part", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "src long, dst long")


def _in_components(docs: DataFrame, radius: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id, component) per document row; ``component`` is the smallest fingerprint of the component."""
    prints, _ = materialize(with_fingerprints(docs, text, key), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    components = connected_components(link_fingerprints(groups, radius))
    named = groups.join(components, groups["fp"] == components["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(smallest, "component").select("fp", "component_id", "component")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id", "component")


def simhash_components(docs: DataFrame, radius: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) per document row.

    Null and word-less texts share fingerprint zero and link like others; repeated rows keep
    their own output rows; a null doc_id never names a component unless its whole component
    has none. Extra columns of ``docs`` are not read.
    """
    return _in_components(docs, radius, text, key).drop("component")


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The digest the query returns: doc_id, fingerprint (16 hex digits), component_id."""
    return simhash_components(docs, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One document of each component of fingerprints: that of the smallest doc_id, null after all others.

    Ids neither need to be there nor to differ: components whose rows share an id, or have none,
    keep a row each. Rows alike in id come down to the first by fingerprint and text.
    """
    found = _in_components(docs, radius)
    # Names that no column of the documents has.
    keep_id, keep_fp, fp, rank = free_names(docs.columns, "keep_id", "keep_fp", "__fp", "__rank")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("least")
    chosen = found.groupBy("component").agg(least).select(F.col("least.doc_id").alias(keep_id), F.col("least.fp").alias(keep_fp))
    copies = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("copies"))
    chosen, _ = materialize(chosen.join(copies, chosen[keep_id] == copies["doc_id"], "left").select(keep_id, keep_fp, "copies"), "kept")
    # The kept ids grow with the corpus, so they are joined by key at every size.
    single = docs.join(chosen.where("copies = 1").select(keep_id).hint("merge"), F.col("doc_id") == F.col(keep_id), "left_semi")
    # Only rows of a repeated id or of none are looked at again: those kept have the fingerprint chosen.
    schema = StructType([*docs.schema.fields, StructField(fp, LongType())])
    at = docs.columns.index("text")

    def again(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], [*batch.schema.names, fp])

    repeated = docs.join(chosen.where("copies > 1").select(keep_id).distinct(), F.col("doc_id") == F.col(keep_id), "left_semi")
    doubtful = repeated.unionByName(docs.where("doc_id is null")).mapInArrow(again, schema)
    # First one row of each id and fingerprint, so that no key of the join has many.
    order = [F.xxhash64("text"), *[F.col(f"`{c}`") for c in docs.columns]]
    first = doubtful.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", fp).orderBy(*order))).where(F.col(rank) == 1)
    wanted = chosen.where("copies is null or copies > 1").select(keep_id, keep_fp)
    several = first.join(wanted, (F.col(fp) == F.col(keep_fp)) & F.col("doc_id").eqNullSafe(F.col(keep_id)), "left_semi")
    return single.unionByName(several.select(*[F.col(f"`{c}`") for c in docs.columns]))


def hamming(a: int, b: int) -> int:
    return ((a ^ b) & (2**64 - 1)).bit_count()


__all__ = ["BKTree", "fingerprint", "hamming", "keep_one", "link_fingerprints", "near_duplicates", "simhash_components"]
