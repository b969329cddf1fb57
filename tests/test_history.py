"""Fork points against sets of ancestors, on planted cases and drawn graphs."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import ancestry, history
from tidemark.operators.history import commit_chains, fork_points

DAY = datetime(2025, 1, 1)
COMMITS = "repo string, sha string, parents array<string>"
BRANCHES = "repo string, branch string, sha string, at timestamp"
BASES = "repo string, branch string, ref string, sha string, explicit boolean"
CREATED = "repo string, branch string, sha string, ref string, ref_sha string"
RANK = {"explicit": 0, "reflog": 0, "ancestor-branch": 1, "default": 2}


class Graph:
    def __init__(self, parents):
        self.parents = {c: [p for p in ps if p in parents] for c, ps in parents.items()}
        self.above = {}
        for c in parents:
            self.above[c], todo = set(), [c]
            while todo:
                x = todo.pop()
                if x not in self.above[c]:
                    self.above[c].add(x)
                    todo += self.parents[x]

    def latest(self, some):
        return {x for x in some if not any(y != x and x in self.above[y] for y in some)}

    def bases(self, a, b):
        return self.latest(self.above[a] & self.above[b]) if a in self.above and b in self.above else set()


def plain(g, tips, base, made):
    """(method, ref, fork, distance) a branch, by the definition."""
    out = {}
    for branch, (head, _) in tips.items():
        found = []
        if head not in g.above:
            out[branch] = (None,) * 4
            continue
        ref, sha, explicit = base.get(branch, (None, None, False))
        fallback = g.bases(sha, head)
        found += [("explicit" if explicit else "default", ref, x) for x in fallback]
        if branch not in ("main", "master") and not (explicit and sha in g.above):
            told = []
            if branch in made:
                oldest, frm, frm_sha = made[branch]
                told += [("reflog", frm, oldest)] * (oldest in g.above[head])
                told += [("reflog", frm, x) for x in g.bases(frm_sha, head) if x != head] if frm != "HEAD" else []
            if not told:
                others = {t: s for t, (s, _) in tips.items() if t not in (branch, "main", "master") and s in g.above and head not in g.above[s]}
                common = set().union(*(g.above[s] & g.above[head] for s in others.values()))
                told = [("ancestor-branch", min((t for t in others if x in g.above[others[t]]), key=lambda t: (-tips[t][1].timestamp(), t)), x) for x in g.latest(common)]
            found += told
            if head in fallback:
                line, x = [], sha
                while x is not None:
                    line.append(x)
                    x = next(iter(g.parents[x]), None)
                after = [x for x in line if head in g.above[x] and x != head and len(g.parents[x]) > 1]
                if after:
                    found += [("default", ref, x) for x in g.bases(g.parents[after[-1]][0], head) if x != head]
        late = lambda r: -tips[r][1].timestamp() if r in tips else 0
        best = min(((x == head, len(g.above[head] - g.above[x]), RANK[m], late(r), r, m, x) for m, r, x in found), default=None)
        out[branch] = (best[5], best[4], best[6], best[1]) if best else (None,) * 4
    return out


def run(spark, cases):
    """cases: {repo: (parents, tips, base, made)} with Spark; {repo: {branch: row}}."""
    commits, tips, base, made = [], [], [], []
    for repo, (p, t, b, m) in cases.items():
        commits += [(repo, c, ps) for c, ps in p.items()]
        tips += [(repo, n, s, at) for n, (s, at) in t.items()]
        base += [(repo, n, *x) for n, x in b.items()]
        made += [(repo, n, s, r, x) for n, (s, r, x) in m.items()]
    rows = fork_points(
        spark.createDataFrame(commits, COMMITS), spark.createDataFrame(tips, BRANCHES), spark.createDataFrame(base, BASES), spark.createDataFrame(made, CREATED)
    ).collect()
    out = {repo: {} for repo in cases}
    for r in rows:
        out[r.repo][r.branch] = (r.method, r.ref, r.fork, None if r.distance is None else int(r.distance))
    return out


def line(*shas, after=None):
    return {s: [p] if p else [] for s, p in zip(shas, [after, *shas[:-1]], strict=True)}


def test_planted_forks(spark):
    at = lambda n: DAY + timedelta(days=n)
    stack = line("m1", "m2") | line("a1", "a2", after="m2") | line("b1", "b2", "b3", after="a2")
    tips = {"main": ("m2", at(0)), "a": ("a2", at(1)), "b": ("b3", at(2))}
    base = {"main": ("origin/main", "m2", False), "a": ("main", "m2", False), "b": ("main", "m2", False)}
    merged = stack | {"m3": ["m2", "a2"]} | line("m4", after="m3")
    moved = stack | line("a3", after="a2") | {"b4": ["b3", "a3"]} | line("b5", after="b4")
    got = run(spark, {
        "from a": (stack, tips, base, {"b": ("a2", "a", "a2")}),
        "from head": (stack, tips, base, {"b": ("a2", "HEAD", None)}),
        "expired": (stack, tips, base, {}),
        "merged its parent": (moved, tips | {"a": ("a3", at(1)), "b": ("b5", at(2))}, base, {"b": ("a2", "a", "a3")}),
        "explicit": (stack, tips, base | {"b": ("m1", "m1", True)}, {"b": ("a2", "a", "a2")}),
        "base has it": (merged, tips | {"main": ("m4", at(3))}, {n: ("main", "m4", False) for n in ("a", "b")}, {}),
        "unknown": (stack, {"main": ("m2", at(0)), "x": ("zz", at(1))}, base, {}),
    })
    assert got["from a"]["b"] == ("reflog", "a", "a2", 3)
    assert got["from a"]["a"] == ("default", "main", "m2", 2)
    assert got["from a"]["main"] == ("default", "origin/main", "m2", 0)
    assert got["from head"]["b"] == ("reflog", "HEAD", "a2", 3)
    assert got["expired"]["b"] == ("ancestor-branch", "a", "a2", 3)
    assert got["merged its parent"]["b"] == ("reflog", "a", "a3", 5)
    assert got["explicit"]["b"] == ("explicit", "m1", "m1", 6)
    assert got["base has it"]["a"] == ("default", "main", "m2", 2)
    assert got["base has it"]["b"] == ("ancestor-branch", "a", "a2", 3)
    assert got["unknown"]["x"] == (None, None, None, None)


def drawn(seed, n=40):
    rng = random.Random(seed)
    parents = {}
    names = [f"c{i:02d}" for i in range(n)]
    for i, c in enumerate(names):
        near = names[max(0, i - 6) : i]
        parents[c] = rng.sample(near, min(len(near), rng.choice([1, 1, 1, 2, 3]))) if near and rng.random() > 0.05 else []
        if rng.random() < 0.05:
            parents[c].append("gone")
    tips = {"main": (names[-1], DAY)} | {f"b{i}": (rng.choice(names), DAY + timedelta(days=rng.randrange(3))) for i in range(7)}
    base = {b: ("main", rng.choice(names[-8:]), rng.random() < 0.1) for b in tips if rng.random() < 0.9}
    made = {b: (rng.choice(names), *rng.choice([("HEAD", None), ("b1", tips["b1"][0]), ("lost", None)])) for b in tips if rng.random() < 0.4}
    return parents, tips, base, made


def test_drawn_forks_equal_the_definition(spark):
    cases = {f"r{seed}": drawn(seed) for seed in range(40)}
    got = run(spark, cases)
    for repo, case in cases.items():
        assert got[repo] == plain(Graph(case[0]), *case[1:]), repo


def test_long_lines_take_few_rounds(spark):
    n = 3000
    main = {f"m{i}": [f"m{i - 1}"] if i else [] for i in range(n)}
    side = {f"s{i}": [f"m{i - 2}"] for i in range(2, n, 10)}
    for i in range(4, n, 10):
        main[f"m{i}"].append(f"s{i - 2}")
    got = run(spark, {"r": (main | side | line("x1", "x2", after="m1500"), {"x": ("x2", DAY)}, {"x": ("main", f"m{n - 1}", False)}, {})})
    assert got["r"]["x"] == ("default", "main", "m1500", 2)


def test_odd_commits(spark):
    rows = [("r", "a", ["b"]), ("r", "a", ["b"]), (None, "a", []), ("r", None, []), ("r", "b", None), ("r", "c", ["c", "gone"])]
    places, links = commit_chains(spark.createDataFrame(rows, COMMITS))
    assert sorted((r.sha, r.chain, r.pos) for r in places.collect()) == [("a", "a", 1), ("b", "a", 0), ("c", "c", 0)]
    assert links.count() == 0
    with pytest.raises(ValueError, match="cycle"):
        commit_chains(spark.createDataFrame([("r", "a", ["b"]), ("r", "b", ["a"])], COMMITS))
    none = [spark.createDataFrame([], s) for s in (COMMITS, BRANCHES, BASES, CREATED)]
    assert fork_points(*none).count() == 0


def merged_branches(n):
    """A line that takes a branch of two commits at each step; the branches' tips."""
    parents, tips = {"m000": []}, {}
    for i in range(1, n):
        a, b, m = f"a{i:03d}", f"b{i:03d}", f"m{i:03d}"
        parents |= {a: [f"m{i - 1:03d}"], b: [a], m: [f"m{i - 1:03d}", b]}
        tips[f"t{i:03d}"] = (b, DAY + timedelta(days=i))
    return parents, tips | {"main": (f"m{n - 1:03d}", DAY)}


def test_tables_grow_with_the_history(spark, monkeypatch):
    most = {}
    keep = history._Tables.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        most["n"] = max(most.get("n", 0), out.count())
        return out

    monkeypatch.setattr(history._Tables, "keep", counted)
    sizes = []
    for n in (40, 160):
        parents, tips = merged_branches(n)
        most.clear()
        commits = [("r", c, ps, 3 * int(c[1:]) + "abm".index(c[0])) for c, ps in parents.items()]
        base = [("r", b, "main", f"m{n - 1:03d}", False) for b in tips]
        rows = fork_points(
            spark.createDataFrame(commits, COMMITS + ", clock long"), spark.createDataFrame([("r", b, *x) for b, x in tips.items()], BRANCHES),
            spark.createDataFrame(base, BASES), spark.createDataFrame([], CREATED),
        ).collect()
        assert [(r.method, r.ref, r.fork, r.distance) for r in rows if r.branch == "t020"] == [("default", "main", "m019", 2)]
        sizes.append(most["n"])
    assert sizes[1] < 5 * sizes[0]


def test_walks_beyond_their_stretch_and_any_clock(spark, monkeypatch):
    monkeypatch.setattr(ancestry, "WIDTH", 2)
    rng = random.Random(5)
    cases = {f"r{seed}": drawn(seed, 16) for seed in range(100, 116)}
    commits = [(repo, c, ps, rng.choice([None, rng.randrange(20), *[int(c[1:])] * 8])) for repo, case in cases.items() for c, ps in case[0].items()]
    tips = [(repo, n, s, at) for repo, case in cases.items() for n, (s, at) in case[1].items()]
    base = [(repo, n, *x) for repo, case in cases.items() for n, x in case[2].items()]
    made = [(repo, n, s, r, x) for repo, case in cases.items() for n, (s, r, x) in case[3].items()]
    rows = fork_points(spark.createDataFrame(commits, COMMITS + ", clock long"), spark.createDataFrame(tips, BRANCHES), spark.createDataFrame(base, BASES), spark.createDataFrame(made, CREATED)).collect()
    got = {(r.repo, r.branch): (r.method, r.ref, r.fork, None if r.distance is None else int(r.distance)) for r in rows}
    assert got == {(repo, b): row for repo, case in cases.items() for b, row in plain(Graph(case[0]), *case[1:]).items()}


def test_a_cycle_of_merges_is_an_error(spark):
    rows = [("r", "o", []), ("r", "a", ["o", "b"]), ("r", "b", ["o", "a"])]
    none = [spark.createDataFrame([], s) for s in (BRANCHES, BASES, CREATED)]
    with pytest.raises(ValueError, match="cycle"):
        fork_points(spark.createDataFrame(rows, COMMITS), *none)


def test_lines_of_many_parts_equal_those_of_one(spark, monkeypatch):
    rng = random.Random(11)
    cases = {f"r{seed}": drawn(seed, 30)[0] for seed in range(200, 212)}
    rows = [(repo, c, ps, rng.choice([None, 7, *[int(c[1:])] * 6])) for repo, parents in cases.items() for c, ps in parents.items()]
    commits = spark.createDataFrame(rows, COMMITS + ", clock long")
    places = lambda: sorted((r.repo, r.sha, r.chain, r.pos) for r in commit_chains(commits)[0].collect())
    one = places()
    above = {repo: {} for repo in cases}
    for repo, parents in cases.items():
        for c in reversed(parents):  # children come after their parents
            height, leaf = above[repo].setdefault(c, (0, c))
            if parents[c] and parents[c][0] in parents:
                above[repo][parents[c][0]] = max(above[repo].get(parents[c][0], (0, "")), (height + 1, leaf))
    assert {(repo, sha): chain for repo, sha, chain, _ in one} == {(repo, c): x[1] for repo, some in above.items() for c, x in some.items()}
    for part in (1, 3):
        monkeypatch.setattr(history, "PART", part)
        assert places() == one
    with pytest.raises(ValueError, match="cycle"):
        commit_chains(spark.createDataFrame([("r", f"c{i}", [f"c{(i + 1) % 8}"], i) for i in range(8)], COMMITS + ", clock long"))


def test_only_ends_of_parts_are_doubled(spark, monkeypatch):
    """What is written round after round are the commits at which lines leave a part, not all commits."""
    monkeypatch.setattr(history, "PART", 100, raising=False)
    written = []
    keep = history._Tables.keep
    monkeypatch.setattr(history._Tables, "keep", lambda self, df, name: (out := keep(self, df, name), written.append(out.count()) if name == "chains" else None)[0])
    n = 2000
    places, _ = commit_chains(spark.createDataFrame([("r", f"c{i:04d}", [f"c{i - 1:04d}"] if i else [], i) for i in range(n)], COMMITS + ", clock long"))
    assert {(r.chain, r.pos - int(r.sha[1:])) for r in places.collect()} == {(f"c{n - 1}", 0)}
    assert sum(written) < n
