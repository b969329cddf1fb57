"""URL filters: host-and-path rules, then logistic regression on hashed character n-grams.

The rules decide where one fits; the longest wins. Any other URL is judged by a logistic
regression over the character 3- to 5-grams of host and path, hashed into a fixed number of
slots and trained from a small labelled URL table: a DataFrame of (url, unwanted) given by the
caller, or the one made by rule from the topics below. ``held_out`` measures it on hosts
that the training has not seen.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 1 << 16
GRAMS = (3, 4, 5)
#: Share of unwanted URLs that training weighs the labels to.
PRIOR = 0.3
#: Rows that a labelled table may have.
MAX_LABELLED = 100_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


RULES = (
    Rule("block", "com", "en/"),
    Rule("allow", "example.com", "en/7"),
    Rule("allow", "net", "de/"),
    Rule("block", "example.net", "de/8"),
    Rule("block", "org", "es/"),
)

# The labelled table is made by rule from these words. A site is named by a topic
# and a common qualifier, in either order, so that only topics tell the kinds apart; each is
# labelled in URL shapes in turn, so that the shape tells nothing.
UNWANTED_TOPICS = (
    "adult", "ads", "banner", "bets", "bingo", "cams", "casino", "clicks", "crack", "dating", "escort", "gambling", "jackpot", "keygen", "loans", "lottery", "malware",
    "meds", "payday", "phishing", "pills", "poker", "popup", "porn", "replica", "roulette", "scam", "slots", "spam", "torrent", "tracker", "viagra", "warez", "xxx",
)
ORDINARY_TOPICS = (
    "archive", "art", "astronomy", "bakery", "books", "chess", "cinema", "climate", "council", "cycling", "docs", "economics", "farming", "forum", "furniture", "gallery", "garden", "geology",
    "health", "hiking", "history", "hospital", "kitchen", "language", "library", "maps", "mathematics", "medicine", "museum", "music", "news", "opera", "parliament", "philosophy", "photos",
    "physics", "poetry", "radio", "railway", "recipes", "restaurant", "sailing", "school", "science", "software", "sports", "theatre", "travel", "university", "village", "weather", "wiki",
)
QUALIFIERS = ("online", "best", "live", "daily", "world", "top", "club", "local", "city", "my", "our", "first")
SHAPES = ("{}.example.com/en/12", "www.{}.example.org/de/345.html", "blog.{}.example.net/fr/6/", "m.{}.example.com/es/78", "{}.example.net/en/901")


def labelled_urls() -> list[tuple[str, int]]:
    """(host and path, 1 if unwanted); bounded by the topics and qualifiers."""
    out = []
    for topics, y in ((UNWANTED_TOPICS, 1), (ORDINARY_TOPICS, 0)):
        sites = [site for t in topics for q in QUALIFIERS for site in (f"{t}-{q}", f"{q}-{t}")]
        out += [(SHAPES[i % len(SHAPES)].format(site), y) for i, site in enumerate(sites)]
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """The built-in labelled table as (url, unwanted)."""
    return spark.createDataFrame([(f"https://{u}", y) for u, y in labelled_urls()], "url string, unwanted int")


def read_labelled(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> list[tuple[str, int]]:
    """(host and path, 1 if unwanted) of a labelled table of (url, unwanted).

    Rows without a label are left out; the table may have ``max_rows`` rows, since the model is
    fitted on the driver. Repeated rows weigh what they are.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = labelled.where("unwanted is not null").select(F.concat(host_of(url), path_of(url)).alias("u"), F.col("unwanted").cast("int").alias("y")).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"the labelled table may have {max_rows} rows")
    return sorted((r.u, r.y) for r in rows)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def hashed(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every n-gram of every string, bounded by "^" and "$".

    The grams of a batch are hashed together over its bytes; grams across two strings are left out.
    """
    parts = [f"^{s}$".encode("utf-8", "surrogatepass") for s in strings]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    rows = np.repeat(np.arange(len(parts)), lengths)
    slots, owners = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            m = len(raw) - n + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint64(1469598103934665603 + n), np.uint64)
            for k in range(n):
                h = (h ^ raw[k : k + m]) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
            inside = rows[:m] == rows[n - 1 : n - 1 + m]
            slots.append((h % np.uint64(SLOTS)).astype(np.int64)[inside])
            owners.append(rows[:m][inside])
    if not slots:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(slots), np.concatenate(owners)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, strings: list[str]) -> np.ndarray:
        """Probability that a URL is unwanted; the grams' weights are averaged by the root of their number."""
        if not strings:
            return np.zeros(0)
        slots, rows = hashed(strings)
        n = np.bincount(rows, minlength=len(strings))
        total = np.bincount(rows, weights=self.weights[slots], minlength=len(strings))
        # A string without grams says nothing, so it has the share that training took for granted.
        return np.where(n > 0, 1.0 / (1.0 + np.exp(-np.clip(self.bias + total / np.sqrt(np.maximum(n, 1)), -50, 50))), PRIOR)


def train(table: list[tuple[str, int]] | None = None, steps: int = 600, rate: float = 20.0, l2: float = 1e-4) -> UrlModel:
    """Full-batch gradient descent on a labelled table, unwanted URLs weighing ``PRIOR`` of all."""
    table = labelled_urls() if table is None else table
    strings, y = [u for u, _ in table], np.array([float(v) for _, v in table])
    if not strings:
        return UrlModel(np.zeros(SLOTS), 0.0)
    slots, rows = hashed(strings)
    scale = 1.0 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    w, b = np.zeros(SLOTS), 0.0
    balance = np.where(y > 0, PRIOR / max(y.mean(), 1e-9), (1 - PRIOR) / max(1 - y.mean(), 1e-9))
    for _ in range(steps):
        z = b + scale * np.bincount(rows, weights=w[slots], minlength=len(y))
        error = balance * (1.0 / (1.0 + np.exp(-z)) - y) / len(y)
        w -= rate * (np.bincount(slots, weights=(error * scale)[rows], minlength=SLOTS) + l2 * w)
        b -= rate * error.sum()
    return UrlModel(w, float(b))


def site_of(string: str) -> str:
    """What hosts have in common: the label of the host that tells most, its longest but for the common domain."""
    return max((x for x in string.partition("/")[0].split(".") if x != "example"), key=len)


def held_out(table: list[tuple[str, int]] | None = None, folds: int = 8) -> dict[int, tuple[int, int]]:
    """For each label, how many URLs are judged right and how many there are, over folds by site: no site is in both parts."""
    table = labelled_urls() if table is None else table
    sites = sorted({site_of(u) for u, _ in table}, key=lambda w: hashlib.md5(w.encode()).hexdigest())
    fold = {w: i % folds for i, w in enumerate(sites)}
    out = {0: (0, 0), 1: (0, 0)}
    for f in range(folds):
        model = train([(u, y) for u, y in table if fold[site_of(u)] != f])
        tried = [(u, y) for u, y in table if fold[site_of(u)] == f]
        for (_, y), p in zip(tried, model.score([u for u, _ in tried]), strict=True):
            right, n = out[y]
            out[y] = (right + int((p >= 0.5) == bool(y)), n + 1)
    return out


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The text of the longest rule that fits, or null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(f"/{r.path}")
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, model: UrlModel | None = None, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """The op2 digest per page row: page_id, host, path, rule, verdict, and the model's probability.

    The model is ``model``, or is trained on ``labelled`` (url, unwanted), or on the built-in
    table. A null URL or one without ``://`` has an empty host and path, and the model judges
    that. Rows are judged one by one and whole, however long, so repeated rows and ties need no
    rule; extra columns are not read, and an empty table gives an empty result.
    """
    model = model or train(read_labelled(labelled) if labelled is not None else None)
    kind = pages.schema["page_id"].dataType.simpleString()
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))

    def run(batches):
        for batch in batches:
            strings = [h + p for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(strings))], ["page_id", "host", "path", "unwanted"])

    judged = parts.mapInArrow(run, f"page_id {kind}, host string, path string, unwanted double")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    verdicts = F.lit(None).cast("string")
    for r in rules:
        verdicts = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(verdicts)
    by_model = F.when(F.col("unwanted") >= 0.5, "block").otherwise("allow")
    return judged.withColumn("rule", rule).select("page_id", "host", "path", "rule", F.coalesce(verdicts, by_model).alias("verdict"), F.round("unwanted", 6).alias("unwanted"))
