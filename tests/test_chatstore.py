"""Chats and messages planted in a key-value store."""

import json
from datetime import datetime

from tidemark.operators.chatstore import chat_sessions, chat_turns, chat_usage, chat_worktrees, store_chats, store_rows
from tidemark.operators.worktrees import worktree_records


def test_a_planted_store(spark):
    chat = {"createdAt": 1735689600000, "unifiedMode": "agent", "usageData": {"m1": {"costInCents": 12.5, "amount": 3}, "m2": {}}, "trackedGitRepos": [{"path": "/tmp/x"}, {"path": "/r/main/sub"}], "modelConfig": {"modelName": "m1"}}
    rows = [
        ("s", "composerData:a", json.dumps(chat)), ("s", "composerData:bad", "{"), ("s", "composerData:list", "[1]"), ("s", "composerData:none", None), ("s", "other:a", "{}"), ("s", "bubbleId:a", "{}"), (None, "composerData:n", "{}"),
        ("s", "bubbleId:a:1", json.dumps({"type": 1, "createdAt": "2025-01-01T00:00:01Z"})), ("s", "bubbleId:a:2", json.dumps({"type": 2, "tokenCount": {"inputTokens": 0, "outputTokens": 0}})),
        ("s", "bubbleId:a:3", json.dumps({"type": 2, "tokenCount": {"inputTokens": 7}, "toolFormerData": {"name": "edit", "status": "ok"}, "modelInfo": {"modelName": "m1"}})), ("s", "bubbleId:gone:1", "{}"),
    ]
    rows = spark.createDataFrame(rows, "store string, key string, value string")
    heads = [("s", "a", json.dumps({"unifiedMode": "chat", "totalLinesAdded": 4})), ("s", "h", json.dumps({"workspaceIdentifier": {"id": "w", "path": "/r/main"}})), ("s", "torn", "{")]
    chats = store_chats(rows, spark.createDataFrame(heads, "store string, chat string, value string"))
    got = {r.chat: (r.created, r["mode"], r.model, r.lines_added) for r in chat_sessions(chats).where("store is not null").collect()}
    assert got == {"a": (datetime(2025, 1, 1), "agent", "m1", 4), "h": (None, None, None, None), "torn": (None, None, None, None)}
    assert sorted(r.chat for r in store_rows(rows).where("kind = 'unreadable'").collect()) == ["bad", "list", "none"]
    assert [tuple(r)[3:] for r in chat_usage(chats).collect()] == [("m1", 12.5, 3)]
    turns = {(r.chat, r.message): (r.role, r.model, r.tool, r.input, r.output, r.unknown) for r in chat_turns(rows, chats).collect()}
    assert turns == {("a", "1"): ("user", None, None, None, None, "absent"), ("a", "2"): ("assistant", None, None, None, None, "zero"), ("a", "3"): ("assistant", "m1", "edit", 7, None, None)}
    trees = worktree_records(spark.createDataFrame([("/r/main/.git", "worktree /r/main\nbranch refs/heads/main\n")], "repo string, listing string"))
    assert {(r.chat, r.worktree) for r in chat_worktrees(chats, trees).collect()} == {("a", "/r/main"), ("h", "/r/main")}
    assert chat_turns(rows.limit(0), chats.limit(0)).count() == 0
