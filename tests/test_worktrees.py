"""Worktree listings, the paths they hold and the contexts of events."""

from pyspark.sql import functions as F

from tidemark.functions.text import absolute_path, path_prefixes
from tidemark.operators.worktrees import correlate_contexts, locate_paths, resolve_paths, worktree_records

LISTING = """worktree /r/main
HEAD aaa1
branch refs/heads/main

worktree /r/main/trees/two
HEAD bbbb
detached
prunable gitdir file points to non-existent location\r
\r
worktree /r/bare
bare

worktree relative
HEAD cccc
"""


def trees(spark):
    rows = [("/r/main/.git", LISTING), ("/other/.git", "worktree /shared\nHEAD dddd\nbranch refs/heads/x"), ("/third/.git", "worktree /shared\nbranch refs/tags/y"), ("nowhere", LISTING), ("/n/.git", None)]
    return worktree_records(spark.createDataFrame(rows, "repo string, listing string"))


def test_paths_are_cleaned(spark):
    cases = {"/a//b/./c/../d/": "/a/b/d", " /.. ": "/", "c:\\x\\y": "C:/x/y", "a/b": None, "": None, None: None, "D:/..": "D:/", "C:x": None}
    df = spark.createDataFrame([(k,) for k in cases], "path string").withColumn("p", absolute_path(F.col("path")))
    assert {r.path: r.p for r in df.collect()} == cases
    got = spark.createDataFrame([("/",), ("/a/b",), ("C:/x",)], "p string").select("p", path_prefixes(F.col("p")).alias("x"))
    assert {r.p: r.x for r in got.collect()} == {"/": ["/"], "/a/b": ["/", "/a", "/a/b"], "C:/x": ["C:/", "C:/x"]}


def test_listings(spark):
    got = {(r.repo, r.path): (r.branch, r["head"], r.detached, r.bare, r.prunable) for r in trees(spark).collect()}
    assert got == {
        ("/r/main/.git", "/r/main"): ("main", "aaa1", False, False, False),
        ("/r/main/.git", "/r/main/trees/two"): (None, "bbbb", True, False, True),
        ("/r/main/.git", "/r/bare"): (None, None, False, True, False),
        ("/other/.git", "/shared"): ("x", "dddd", False, False, False),
        ("/third/.git", "/shared"): ("refs/tags/y", None, False, False, False),
    }


def test_paths_in_worktrees(spark):
    cases = {
        "/r/main/src/a.py": ("matched", "/r/main", "src/a.py"), "/r/main": ("matched", "/r/main", ""), "/r/main/trees/two/x/../b": ("matched", "/r/main/trees/two", "b"),
        "/r/mainly/a": ("outside", None, None), "/r/main/.git/config": ("outside", None, None), "/r/bare/x": ("outside", None, None), "/shared/a": ("ambiguous", None, None), "a": ("invalid", None, None), None: ("invalid", None, None),
    }
    got = resolve_paths(spark.createDataFrame([(k,) for k in cases] * 2, "path string"), trees(spark)).collect()
    assert len(got) == len(cases)
    assert {r.path: (r.status, r.worktree, r.relative) for r in got} == cases


def test_files_and_lost_folders_are_located(spark):
    paths = ["/r/main/src/a.py", "/r/main/gone/deep/b.py", "/tmp/x.txt", "/tmp/lost", "/tmp", "a", "/r/main/trees/two/new"]
    kinds = spark.createDataFrame([("/r/main/src/a.py", "file"), ("/r/main/src", "directory"), ("/tmp", "directory"), ("/tmp/x.txt", "file")], "path string, kind string")
    got = {r.path: (r.kind, r.worktree, r["head"]) for r in locate_paths(spark.createDataFrame([(p,) for p in paths], "path string"), trees(spark), kinds).collect()}
    assert got == {
        "/r/main/src/a.py": ("repo", "/r/main", "aaa1"), "/r/main/gone/deep/b.py": ("repo", "/r/main", "aaa1"), "/r/main/trees/two/new": ("repo", "/r/main/trees/two", "bbbb"),
        "/tmp/x.txt": ("outside", None, None), "/tmp": ("outside", None, None), "/tmp/lost": ("missing", None, None), "a": ("missing", None, None),
    }
    assumed = {r.path: r.kind for r in locate_paths(spark.createDataFrame([(p,) for p in paths], "path string"), trees(spark)).collect()}
    assert assumed["/tmp/lost"] == "outside" and assumed["/r/main/gone/deep/b.py"] == "repo" and assumed["a"] == "missing"


def test_contexts(spark):
    none = (None,) * 4
    events = [(1, *none), (2, *none), (3, *none), (4, "/elsewhere/.git", None, None, None), (5, "/r/main/.git", "/r/main/", "kept", "ffff"), (6, *none), (7, None, None, "mine", None), (8, *none)]
    seen = [(1, 1, "/r/main/b"), (1, 0, "/r/main/a"), (1, 2, "/tmp"), (2, 0, "/tmp"), (3, 0, "/r/main/a"), (3, 1, "/r/main/trees/two/a"), (4, 0, "/r/main/a"), (5, 0, "/r/main/a"), (6, 0, "/r/main/trees/two/a"), (7, 0, "/r/main/trees/two/a")]
    got = correlate_contexts(spark.createDataFrame(events, "event_id long, repo string, worktree string, branch string, head string"), spark.createDataFrame(seen, "event_id long, nth int, path string"), trees(spark)).collect()
    git, two = "/r/main/.git", "/r/main/trees/two"
    assert {r.event_id: tuple(r)[1:] for r in got} == {
        1: ("assigned", git, "/r/main", "main", "aaa1", ["a", "b"]), 2: ("unassigned", *none, []), 3: ("multi-root", *none, []), 4: ("conflict", "/elsewhere/.git", None, None, None, []),
        5: ("assigned", git, "/r/main", "kept", "ffff", ["a"]), 6: ("detached", git, two, None, "bbbb", ["a"]), 7: ("assigned", git, two, "mine", "bbbb", ["a"]), 8: ("unassigned", *none, []),
    }
