"""Personal data by fixed patterns and a skip-chain conditional random field per document.

The fixed patterns give the base spans. A looser grammar proposes mentions: phone-, card-,
address- and mail-shaped strings, and bare repeats of a mail's local part that has a digit,
dot, underscore or hyphen, since others are plain words. Each mention is a
node of the document's field; its labels are "none" and the four kinds.

* Node potentials: a softmax regression on shape and context features. It is trained by
  distant supervision on all documents: a mention that a base span covers has that span's
  kind, any other has none. The table of (features, label) counts is the sufficient
  statistic, and its size is bounded by the number of feature combinations.
* Chain potentials join neighbouring mentions, weakly.
* Skip potentials join distant mentions whose keys agree: the same digits, the same last
  seven or ten digits, the same mail address or local part. Mentions of one key are joined
  along a chain and to the first of them, never in all pairs.

Loopy sum-product passes messages until they settle. Base spans are clamped and always stay;
a free mention becomes a span if one kind's belief reaches ``min_belief`` and no base span
overlaps it.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.secrets import joined, merge
from tidemark.session import materialize

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}
# The patterns of the contract, the mail pattern in its two parts.
_LOCAL_CHARS = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# The looser grammar of mentions.
_PHONE_PLUS = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
_PHONE_LOCAL = r"(?:(?<![0-9])1[ .-])?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
_SEVEN = r"(?<![0-9.-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"
_FOUR = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"
_CARDS = r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])"
_BARE = r"(?<![0-9A-Za-z])[0-9]{7,15}(?![0-9A-Za-z])"
_MENTION = re.compile(
    f"(?P<phone_plus>{_PHONE_PLUS})|(?P<four>{_FOUR})|(?P<cards>{_CARDS})|(?P<phone_local>{_PHONE_LOCAL})|(?P<seven>{_SEVEN})|(?P<bare>{_BARE})"
)
_REGION = re.compile(r"[+(]?[0-9][0-9 ().+-]{5,}")
_OBFUSCATED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}+)+", re.IGNORECASE | re.ASCII
)
_AT = re.compile(r"at[)\]}]", re.IGNORECASE | re.ASCII)
_RUN = re.compile(r"[\w.%+@-]+")
#: A-Z alone, so that offsets never move.
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: An obfuscated address has at most 64 characters before its "at" and 63 in each label, as mail addresses do.
# Context words, lower case, by the kind they speak for.
_CONTEXT = {
    "cue_mail": ("mail", "contact", "write"),
    "cue_ip": ("ip", "host", "server", "addr"),
    "cue_card": ("card", "visa", "credit"),
    "cue_phone": ("phone", "tel", "call", "fax", "mobile"),
}
FEATURES = (
    "bias", "mail", "mail_obfuscated", "mail_local", "phone_plus", "phone_local", "seven", "four", "four_valid",
    "cards", "luhn", "bare", "bare_ten", *_CONTEXT,
)
LABELS = ("none", *KINDS)
SKIP_WEIGHT = 7.0
CHAIN_WEIGHT = 0.1
MIN_BELIEF = 0.9
#: A free mention's own log-odds for a kind stay in this range, so that agreement can outweigh shape.
UNARY_RANGE = (-4.0, 6.0)


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: from each ``@``, as far back and forth as its parts reach.

    A regular expression that starts at the local part would try each of its characters.
    """
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 40:
                digits = _digits(m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]]))


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """The nodes of the document's field, in order: start, end, clamp, taught, features, keys."""
    nodes: dict[tuple[int, int], dict] = {}

    def node(start: int, end: int, clamp: str | None, features: list[str], keys: list[str]) -> None:
        before = text[max(0, start - 24) : start].lower()
        cues = [c for c, words in _CONTEXT.items() if any(w in before for w in words)]
        nodes.setdefault((start, end), {"start": start, "end": end, "clamp": clamp, "features": ["bias", *features, *cues], "keys": keys})

    locals_seen = set()
    for kind, a, b in base:
        piece = text[a:b]
        if kind == "email":
            local = piece.partition("@")[0].lower()
            node(a, b, kind, ["mail"], [f"mail:{piece.lower()}", f"local:{local}"])
            if any(c.isdigit() or c in "._-" for c in local) and any(c.isalnum() for c in local):
                locals_seen.add(local)
        else:
            node(a, b, kind, _number_features(piece, kind), _number_keys(piece, kind))
    if _DIGIT.search(text):
        for region in _REGION.finditer(text):
            for m in _MENTION.finditer(text, region.start(), region.end()):
                shape = m.lastgroup
                node(m.start(), m.end(), None, _number_features(m.group(), shape), _number_keys(m.group(), shape))
    if _AT.search(text):
        for m in _OBFUSCATED.finditer(text):
            plain = re.sub(r" ?(?:[(\[{]dot[)\]}]| dot ) ?", ".", re.sub(r" ?[(\[{]at[)\]}] ?", "@", m.group().lower()))
            node(m.start(), m.end(), None, ["mail", "mail_obfuscated"], [f"mail:{plain}", f"local:{plain.partition('@')[0]}"])
    if locals_seen:
        lowered = text.translate(_LOWER)
        # A repeat starts where a run of address characters does, and ends with it or before a dot of it.
        for m in _RUN.finditer(lowered):
            run, end = m.group(), m.end() - m.start()
            while end > 0 and run[:end] not in locals_seen:
                end = run.rfind(".", 0, end)
            if end > 0:
                node(m.start(), m.start() + end, None, ["mail_local"], [f"local:{run[:end]}"])
    out = sorted(nodes.values(), key=lambda n: (n["start"], n["end"]))
    starts = [s for _, s, _ in base]
    for n in out:  # what distant supervision says: the kind of a base span that covers the mention
        at = bisect_left(starts, n["start"] + 1)
        n["taught"] = next((k for k, a, b in base[max(0, at - 4) : at] if a <= n["start"] and b >= n["end"]), "none")
    known = {key for n in out if n["clamp"] for key in n["keys"]}
    for n in out:  # a repeat in another form teaches nothing: the patterns can't know it
        if n["taught"] == "none" and known.intersection(n["keys"]):
            n["taught"] = None
    return out


def _number_features(piece: str, shape: str) -> list[str]:
    digits = _digits(piece)
    if shape in ("ip", "four"):
        return ["four", *(["four_valid"] if all(int(p) <= 255 for p in piece.split(".") if p) else [])]
    if shape in ("card", "cards") and 12 <= len(digits) <= 19:
        return ["cards", *(["luhn"] if luhn(digits) else [])]
    if shape == "phone":
        return ["phone_plus"]
    if shape == "bare":
        return ["bare", *(["bare_ten"] if len(digits) in (10, 11) else [])]
    return [shape]


def _number_keys(piece: str, shape: str) -> list[str]:
    digits = _digits(piece)
    if shape in ("ip", "four"):
        return [f"ip:{piece}"]
    if shape in ("card", "cards") or len(digits) > 15:
        return [f"card:{digits}"]
    keys = [f"seven:{digits[-7:]}"] if len(digits) >= 7 else []
    return [*keys, f"ten:{digits[-10:]}"] if len(digits) >= 10 else keys


def skip_edges(nodes: list[dict]) -> list[tuple[int, int]]:
    """Mentions of one key, each joined to the one before it and to the first."""
    seen: dict[str, list[int]] = {}
    edges = set()
    for i, n in enumerate(nodes):
        for key in n["keys"]:
            first_last = seen.setdefault(key, [i, i])
            if first_last[0] != i:
                edges |= {(first_last[0], i), (first_last[1], i)}
                first_last[1] = i
    return sorted(e for e in edges if e[0] != e[1])


def infer(nodes: list[dict], weights: np.ndarray, rounds: int = 30, damping: float = 0.3) -> np.ndarray:
    """Beliefs (nodes x labels) by damped loopy sum-product in the log domain.

    Messages are passed until none changes by 1e-4; fields without loops settle in as many
    rounds as they are wide. Loopy ones need not settle, so ``rounds`` ends them: a field that
    still moves then has the beliefs of its last round.
    """
    at = {f: i for i, f in enumerate(FEATURES)}
    n, k = len(nodes), len(LABELS)
    unary = np.zeros((n, k))
    for i, x in enumerate(nodes):
        if x["clamp"]:
            unary[i] = -30.0
            unary[i, LABELS.index(x["clamp"])] = 0.0
        else:
            own = weights[[at[f] for f in x["features"]]].sum(axis=0)
            unary[i] = np.clip(own - own[0], *UNARY_RANGE)
    skips = skip_edges(nodes)
    edges = skips + [(i, i + 1) for i in range(n - 1)]
    if edges:
        pairs = np.array(edges)
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        strength = np.concatenate([np.full(len(skips), SKIP_WEIGHT), np.full(n - 1, CHAIN_WEIGHT)])
        gain = np.exp(np.concatenate([strength, strength]))[:, None] - 1.0
        # Two mentions of no kind tell little of each other: agreement counts between the kinds.
        bonus = np.ones(k)
        bonus[0] = 0.0
        messages = np.zeros((len(src), k))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, dst, messages)
            out = total[src] - messages[back]
            out -= out.max(axis=1, keepdims=True)
            p = np.exp(out)
            new = np.log(p.sum(axis=1, keepdims=True) + gain * bonus * p)
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - messages).max()
            messages = damping * messages + (1 - damping) * new
            if change < 1e-4:
                break
        np.add.at(unary, dst, messages)
    unary -= unary.max(axis=1, keepdims=True)
    p = np.exp(unary)
    return p / p.sum(axis=1, keepdims=True)


def fit(counts: list[tuple[list[str], str, int]], steps: int = 400, l2: float = 1.0) -> np.ndarray:
    """Softmax regression on (features, label, count) rows, started at and drawn to a weak prior.

    The prior says what a shape alone tells, and what no base span can teach: an obfuscated
    address is a mail. Without any rows the prior alone is the model.
    """
    at = {f: i for i, f in enumerate(FEATURES)}
    prior = np.zeros((len(FEATURES), len(LABELS)))
    prior[at["mail_obfuscated"], LABELS.index("email")] = 4.0
    prior[at["mail_local"], LABELS.index("email")] = 0.5
    for shape, kind in (("mail", "email"), ("four_valid", "ip"), ("luhn", "card"), ("phone_plus", "phone")):
        prior[at[shape], LABELS.index(kind)] = 4.0
    if not counts:
        return prior
    x = np.zeros((len(counts), len(FEATURES)))
    y = np.zeros((len(counts), len(LABELS)))
    weight = np.array([float(n) for _, _, n in counts])
    for i, (features, label, _) in enumerate(counts):
        x[i, [at[f] for f in features]] = 1.0
        y[i, LABELS.index(label)] = 1.0
    w = prior.copy()
    # A bound on the curvature sets the step, so the loss falls at every one.
    step = 1.0 / (0.5 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + l2)
    velocity, previous = w.copy(), w.copy()
    for t in range(steps):
        z = x @ velocity
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        gradient = x.T @ (weight[:, None] * (p - y)) + l2 * (velocity - prior)
        w = velocity - step * gradient
        velocity = w + (t / (t + 3.0)) * (w - previous)
        previous = w
    return w


def added_spans(base: list[tuple[str, int, int]], nodes: list[dict], weights: np.ndarray, min_belief: float = MIN_BELIEF) -> list[tuple[str, int, int]]:
    if all(n["clamp"] for n in nodes):
        return []
    beliefs = infer(nodes, weights)
    covered = merge((a, b) for _, a, b in base)
    wanted = []
    for n, belief in zip(nodes, beliefs, strict=True):
        best = int(belief.argmax())
        if n["clamp"] or not best or belief[best] < min_belief:
            continue
        before = bisect_left(covered, (n["end"], 0)) - 1
        if before < 0 or covered[before][1] <= n["start"]:
            wanted.append((LABELS[best], n["start"], n["end"], float(belief[best])))
    out: list[tuple[str, int, int]] = []
    for kind, a, b, _ in sorted(wanted, key=lambda x: (-x[3], x[1] - x[2], x[1])):
        if all(b <= s or a >= e for _, s, e in out):
            out.append((kind, a, b))
    return out


_NODES = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("clamp", pa.string()), ("taught", pa.string()), ("features", pa.list_(pa.string())), ("keys", pa.list_(pa.string()))])
)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SCANNED = "doc_id {}, base array<struct<kind:string,start:int,end:int>>, nodes array<struct<start:int,end:int,clamp:string,taught:string,features:array<string>,keys:array<string>>>"


def scan_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, base, nodes): one pass over the texts keeps only what the field needs."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bases, nodes = [], []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                nodes.append(mentions(t or "", base))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, _SPANS), pa.array(nodes, _NODES)], ["doc_id", "base", "nodes"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _SCANNED.format(kind))


def train(scanned: DataFrame) -> np.ndarray:
    """Node weights from the counts of (features, taught label) over all documents.

    The driver gets one row per combination of features and label: at most a few hundred.
    """
    rows = (
        scanned.select(F.explode("nodes").alias("n"))
        .where("n.taught is not null")
        .groupBy(F.array_sort("n.features").alias("features"), F.col("n.taught").alias("label"))
        .count()
        .collect()
    )
    return fit(sorted((list(r["features"]), r["label"], r["count"]) for r in rows))


def find_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", min_belief: float = MIN_BELIEF) -> DataFrame:
    """The op1 digest per document row: counts and digest of the base spans, and all spans.

    Null and empty texts have no spans. Rows are labelled one by one, so repeated rows and
    ties need no rule; an empty table trains on nothing and gives an empty result.
    """
    scanned, _ = materialize(scan_documents(docs, text, key), "mentions")
    weights = train(scanned)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            columns = {name: [] for name in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            for base, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = [(s["kind"], s["start"], s["end"]) for s in base]
                every = sorted(spans + added_spans(spans, nodes, weights, min_belief), key=lambda s: (s[1], _ORDER[s[0]])) if nodes else spans
                for k in KINDS:
                    columns[f"n_{k}"].append(sum(s[0] == k for s in spans))
                columns["base_sha256"].append(hashlib.sha256(joined(spans).encode()).hexdigest())
                columns["spans"].append(joined(every))
            arrays = [pa.array(v, pa.string() if name in ("base_sha256", "spans") else pa.int64()) for name, v in columns.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *columns])

    return scanned.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


__all__ = ["base_spans", "find_personal_data", "fit", "infer", "mentions"]
