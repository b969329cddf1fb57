"""Queries whose tables must be whole, against brute force over all rows."""

import hashlib
import json
from collections import defaultdict

import pyarrow.parquet as pq

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def events():
    return [e | {"k": json.loads(e["props"])["k"]} for e in table("events")]


def result(spark, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, SF).collect()]


def test_components_of_all_orders(spark):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    orders = {o["o_orderkey"] for o in table("orders")}
    lines = [x for x in table("lineitem") if x["l_orderkey"] in orders]
    for x in lines:
        a, b = sorted((root((0, x["l_orderkey"])), root((1, x["l_partkey"] % 5000))))
        parent[b] = a
    assert sorted(result(spark, "request_components")) == sorted((o, root((0, o))[1]) for o in {x["l_orderkey"] for x in lines})


def test_bridge_of_all_events(spark):
    rows = [(e["event_id"], e["k"] if e["event_id"] % 3 else None, e["user_id"] % 40 if e["event_id"] % 4 else None) for e in events()]
    owners = defaultdict(set)
    for _, req, session in rows:
        if session is not None and req is not None:
            owners[req].add(session)
    one = {req: next(iter(s)) for req, s in owners.items() if len(s) == 1}
    assert sorted(result(spark, "sessionless_bridge"), key=str) == sorted(((i, s if s is not None else one.get(req)) for i, req, s in rows), key=str)


def test_roots_of_all_pages(spark):
    paths = {p["page_id"]: "/" + p["url"].split("://", 1)[1].split("?")[0].replace(".", "/") for p in table("pages")}
    roots = {"/".join(p.split("/")[:n]).rstrip("/") for p in paths.values() for n in (3, 4)}

    def longest(path):
        parts = path.rstrip("/").split("/")
        return max((r for n in range(1, len(parts) + 1) if (r := "/".join(parts[:n])) in roots), key=len, default=None)

    assert sorted(result(spark, "longest_prefix_root")) == sorted((i, longest(p)) for i, p in paths.items())


def test_unresolved_of_all_events(spark):
    rows = [(e["event_id"], e["user_id"], e["event_type"], e["event_id"] % 5 != 0) for e in events()]
    keyed = defaultdict(set)
    for _, session, channel, has_key in rows:
        if has_key:
            keyed[session].add(channel)
    assert sorted(result(spark, "unresolved_reports")) == sorted((i,) for i, s, c, has_key in rows if not has_key and keyed[s] - {c})


def test_superseded_of_all_events(spark):
    rows = [(e["event_id"], (e["k"], e["user_id"] % 20), e["event_type"], e["user_id"], e["ts"]) for e in events()]
    gone = {((k + 1) % 100, slot) for i, (k, slot), *_ in rows if i % 19 == 0}
    groups = defaultdict(list)
    for r in rows:
        if r[1] not in gone:
            groups[r[1], r[2]].append(r)
    newest = {g: max(rs, key=lambda r: r[4]) for g, rs in groups.items()}
    assert sorted(result(spark, "superseded_requests")) == sorted((r[0],) for g, rs in groups.items() for r in rs if r[4] == newest[g][4] or r[3] == newest[g][3])


def test_watermark_of_all_events(spark):
    sums, counts = defaultdict(int), defaultdict(int)
    for e in events():
        sums[e["event_type"]] += int(hashlib.md5(str(e["event_id"]).encode()).hexdigest()[:15], 16)
        counts[e["event_type"]] += 1
    want = sorted((t, counts[t], hashlib.sha256(str(sums[t]).encode()).hexdigest()) for t in counts)
    assert sum(counts.values()) == len(table("events")) and sorted(result(spark, "origin_mix_watermark")) == want
