"""Runs of repeated words: Crochemore's refinement of the classes of equal factors.

Positions are in one class at level l if the l words from them are equal. Level l + 1 follows
from level l: a class is parted by the classes of its members' next positions. Of the parts
of a class only the smaller ones part others at the next level, so a document of n words takes
O(n log n) steps. Neighbours of a class at distance l start a square of period l whose root is
no power, and squares at consecutive places are one run.

A run has at least ``min_exponent`` periods and ``min_length`` words, so any run repeats
factors of ``min_length // min_exponent`` words: the classes of that level are named at once,
by doubling, and positions alone in their class are left out from there on. Neighbours of that
first level at a smaller distance give the shorter periods, and no level past a third of the
document (in general, n // min_exponent) can give a run.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MIN_LENGTH = 24
MIN_EXPONENT = 3
_WORDS = re.compile(WORD)


def factor_names(words: np.ndarray, length: int) -> np.ndarray:
    """A number for the ``length`` words from each position, equal where they are."""
    names, known = np.unique(words, return_inverse=True)[1], 1
    while known < length:
        step = min(known, length - known)
        pairs = names[: len(names) - step] * (names.max() + 1) + names[step:]
        names, known = np.unique(pairs, return_inverse=True)[1], known + step
    return names


class Classes:
    """The classes of two and more members at one level, each a linked list in text order."""

    def __init__(self, names: np.ndarray, level: int, last: int) -> None:
        self.level, self.last, self.n_names = level, last, len(names)
        self.of: dict[int, int] = {}
        self.next: dict[int, int] = {}
        self.previous: dict[int, int] = {}
        self.head: list[int] = []
        self.size: list[int] = []
        self.at_gap: dict[int, list[int]] = {}
        order = np.argsort(names, kind="stable")
        cuts = np.flatnonzero(np.diff(names[order])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(order)]))
        several = ends - starts > 1
        self.parting: list[list[int]] = []
        for a, b in zip(starts[several], ends[several], strict=True):
            members = order[a:b].tolist()
            self._add(members)
            self.parting.append(members)
        # What stands after a member but is alone in its class parts too.
        self.parting += [[p + 1] for p in self.of if p + 1 < self.n_names and p + 1 not in self.of]

    def _add(self, members: list[int]) -> None:
        c = len(self.size)
        self.size.append(len(members))
        self.head.append(members[0])
        before = None
        for p in members:
            self.of[p] = c
            self._link(before, p)
            before = p
        self._link(before, None)

    def _link(self, a: int | None, b: int | None) -> None:
        if a is not None:
            self.next[a] = b
            if b is not None and self.level <= b - a <= self.last:
                self.at_gap.setdefault(b - a, []).append(a)
        if b is not None:
            self.previous[b] = a

    def _take(self, c: int, members: list[int]) -> None:
        """The members leave the list of their class."""
        for p in members:
            a, b = self.previous[p], self.next[p]
            if a is None:
                self.head[c] = b
            self._link(a, b)
        self.size[c] -= len(members)

    def refine(self) -> None:
        """From the classes of this level to those of the next one."""
        parts: dict[int, list[list[int]]] = {}
        # The factor that reaches the end of the text has no longer one; it parts at every level.
        self.n_names -= 1
        for smaller in [*self.parting, [self.n_names + 1]]:
            of_class: dict[int, list[int]] = {}
            for p in smaller:
                c = self.of.get(p - 1)
                if c is not None:
                    of_class.setdefault(c, []).append(p - 1)
            for c, members in of_class.items():
                parts.setdefault(c, []).append(members)
        self.level += 1
        self.parting = []
        for c, groups in parts.items():
            rest = self.size[c] - sum(map(len, groups))
            if not rest and len(groups) == 1:
                continue
            for members in groups:
                self._take(c, members)
            largest = max(groups, key=len)
            if rest and rest < len(largest):
                p, others = self.head[c], []
                while p is not None:
                    others.append(p)
                    p = self.next[p]
                self.parting.append(others)
            self.parting += [g for g in groups if g[0] != self.n_names and (g is not largest or rest >= len(largest))]
            if rest == 1:
                del self.of[self.head[c]]
            for members in groups:
                if len(members) > 1:
                    self._add(members)
                else:
                    del self.of[members[0]]

    def neighbours(self) -> list[int]:
        """Members, in text order, whose next one in the class is ``level`` words on."""
        return sorted(p for p in set(self.at_gap.pop(self.level, ())) if p in self.of and self.next[p] == p + self.level)


def _stretches(places: list[int]) -> list[tuple[int, int]]:
    """(first, last) of consecutive places."""
    out = []
    for _, same in groupby(enumerate(places), lambda x: x[1] - x[0]):
        found = [p for _, p in same]
        out.append((found[0], found[-1]))
    return out


def word_runs(words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers, by start, then period.

    A run cannot be extended, ``period`` is its smallest one, and it holds at least
    ``min_length`` words and ``min_exponent`` (2 or more) periods.
    """
    level, last = max(1, min_length // min_exponent), len(words) // min_exponent
    if len(words) < max(min_length, 2):
        return []
    out = []

    def report(places: list[int], period: int, reach: int) -> None:
        for a, b in _stretches(places):
            if (length := b - a + period + reach) >= max(min_length, min_exponent * period):
                out.append((a, length, period))

    names = factor_names(words, level)
    order = np.argsort(names, kind="stable")
    gaps = np.where(np.diff(names[order]) == 0, np.diff(order), 0)
    if not gaps.any():
        return []
    for period in np.unique(gaps[(gaps > 0) & (gaps <= level)]):
        report(np.sort(order[:-1][gaps == period]).tolist(), int(period), level)
    classes = Classes(names, level, last)
    while classes.of and classes.level < last:
        classes.refine()
        if found := classes.neighbours():
            report(found, classes.level, classes.level)
    return sorted(out, key=lambda r: (r[0], r[2]))


def split_words(text: str | None) -> tuple[list[str], np.ndarray]:
    """The words of a text, and a number for each."""
    words = _WORDS.findall(text or "")
    known: dict[str, int] = {}
    return words, np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by a space, without those that a run holds after its first period."""
    if not runs:
        return " ".join(words)
    keep = bytearray(b"\x01" * len(words))
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return " ".join(w for w, k in zip(words, keep, strict=True) if k)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, runs, collapsed) per document row: its runs, and its text without their repeats.

    Null and empty texts have no runs and an empty collapsed text; very long ones are taken
    whole, in O(n log n). Documents are independent, so ties and repeated rows need no rule;
    a null id stays null, extra columns are not read, and an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            runs, texts = [], []
            for t in batch.column(1).to_pylist():
                words, numbers = split_words(t)
                found = word_runs(numbers, min_length, min_exponent)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(collapse(words, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, _RUNS), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by the checksum of its id repeats a stretch to its end.

    The words from the a-th on become those of the first p of them, over and over. A null id
    has no checksum, so its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    shaped = chosen.withColumn("a", F.when(F.size("words") > 0, F.col("g") % F.size("words"))).withColumn("p", 1 + F.floor((F.size("words") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.array_join(F.transform("words", lambda w, i: F.get("words", _place(i))), " ")
    return shaped.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(repeated).alias("text"))


def _place(i: Column) -> Column:
    a, p = F.col("a"), F.col("p")
    return F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")


def run_digest(docs: DataFrame) -> DataFrame:
    """The op11 digest per document row, of the texts with planted repeats (``planted``)."""
    found = find_runs(planted(docs))
    # Exponents are compared as fractions: length_x / period_x > length_y / period_y.
    ahead = "x.length * y.period - y.length * x.period"
    best = F.expr(
        f"""reduce(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0), (y, x) -> CASE
            WHEN {ahead} > 0 OR {ahead} = 0 AND (x.start < y.start OR x.start = y.start AND x.period < y.period) THEN x ELSE y END)"""
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return (
        found.withColumn("best", F.when(F.size("runs") > 0, best))
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"),
            F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )
