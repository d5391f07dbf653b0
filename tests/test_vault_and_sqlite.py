"""Typed scans open only the files of their type, hashes are those of the parsed notes; SQLite rows by range, only those after a cursor."""

import hashlib
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from cardloom.sources import adapters, sqlite, vault

FOLDERS = {"person": "People", "finance": "Finance", "email_message": "Email/In"}


@pytest.fixture(scope="module")
def notes(tmp_path_factory):
    root = tmp_path_factory.mktemp("vault dir")
    told = {}
    for i in range(12):
        kind = ("person", "finance", "email_message")[i % 3]
        fields = {"type": kind, "uid": f"{kind}-{i}", "summary": f"Ünï {i}: \"x\"", "n": i, "share": i / 4, "good": i % 2 == 0, "none": None, "tags": ["b", "a"], "nested": {"a": {"deep": [1, {"z": "y"}]}, "day": "2024-01-02"}}
        path = f"{FOLDERS[kind]}/{'sub/' if i > 6 else ''}note {i}.md"
        yaml_text = "\n".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in fields.items() if k != "nested") + "\nnested:\n  a:\n    deep:\n    - 1\n    - z: y\n  day: 2024-01-02\n"
        body = f"# Body {i}\n\ntext"
        text = f"---\n{yaml_text}---\n{body}\n\n<!-- provenance\nsummary: {{\"source\": \"s\", \"date\": \"d\", \"method\": \"m\"}}\nbroken: {{\n-->\n"
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
        told[path] = (fields, body)
    (root / "People" / "plain.md").write_text("no frontmatter")
    (root / "People" / "bad.md").write_text("---\na: [1\n---\nkept")
    (root / "People" / "empty.md").write_text("")
    (root / "People" / "skip.txt").write_text("not a note")
    return str(root), told


def test_notes_are_typed_and_hashed(spark, notes):
    pytest.importorskip("yaml")
    root, told = notes
    got = {r.rel_path: r for r in vault.scan(spark, root).select("*", vault.value(F.col("fields"), "nested.a.deep[1].z").alias("z"), vault.value(F.col("fields"), "n", "int").alias("n"), vault.value(F.col("provenance"), "summary.method").alias("how")).collect()}
    assert set(got) == {*told, "People/plain.md", "People/bad.md"}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for path, (fields, body) in told.items():
        r, whole = got[path], json.dumps(fields, sort_keys=True)
        assert (r.json, r.body, r.content_hash, r.frontmatter_hash) == (whole, body, sha(f"{whole}\n{body}"), sha(whole))
        assert (r.type, r.uid, r.z, r.n, r.how, r.problem) == (fields["type"], fields["uid"], "y", fields["n"], "m", None)
    assert got["People/plain.md"].body == "no frontmatter" and got["People/plain.md"].json == "{}" and got["People/bad.md"].problem and got["People/bad.md"].body == "kept"


def test_a_scan_opens_only_what_it_needs(spark, notes):
    pytest.importorskip("yaml")
    root, told = notes
    opened = lambda df: {f.split("/vault%20dir0/")[-1].split("/vault dir0/")[-1].replace("%20", " ") for f in df.inputFiles()}
    for kind in FOLDERS:
        df = vault.scan(spark, root, FOLDERS, types=(kind,))
        assert {r.rel_path for r in df.collect()} == {p for p, (f, _) in told.items() if f["type"] == kind}
        assert all(p.startswith(FOLDERS[kind]) for p in opened(df))
    df = vault.scan(spark, root, FOLDERS, prefix="Finance/note 1")
    assert {r.rel_path for r in df.collect()} == opened(df) == {p for p in told if p.startswith("Finance/note 1")}
    assert vault.scan(spark, root, FOLDERS, types=("person",), prefix="Finance/").count() == 0 and vault.scan(spark, root, FOLDERS, types=("flight",)).count() == 0
    assert vault.paths_of("/v", FOLDERS, ("person",), "People/a") == ["/v/People/a*"] and vault.paths_of("/v", FOLDERS, ("person", "other")) == ["/v"]


@pytest.fixture(scope="module")
def chats(tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("db") / "chat.db"), random.Random(2)
    db = sqlite3.connect(path)
    db.executescript("""create table message (ROWID integer primary key, guid text, text text, date integer, is_from_me integer, handle_id integer, odd); create table chat (ROWID integer primary key, guid text, display_name text, service_name text);
     create table handle (ROWID integer primary key, id text); create table chat_message_join (chat_id integer, message_id integer); create table chat_handle_join (chat_id integer, handle_id integer);""")
    ids = sorted(rng.sample(range(1, 200_000), 3_000))
    db.executemany("insert into message values (?, ?, ?, ?, ?, ?, ?)", [(i, f"g{i}", None if i % 7 == 0 else f"text {i}", 700_000_000_000_000_000 + i * 10**9, i % 2, i % 5, [None, "x", 3, b"\xff"][i % 4]) for i in ids])
    db.executemany("insert into chat values (?, ?, ?, ?)", [(c, f"chat{c}", f"Chat {c}", "iMessage") for c in range(1, 9)])
    db.executemany("insert into handle values (?, ?)", [(h, f"+1555000{h}") for h in range(5)])
    db.executemany("insert into chat_message_join values (?, ?)", [(1 + i % 8, i) for i in ids])
    db.executemany("insert into chat_handle_join values (?, ?)", [(c, h) for c in range(1, 9) for h in range(1, 1 + c % 4)])
    db.commit(), db.close()
    return path, ids


def test_ranges_and_cursors(spark, chats, monkeypatch):
    path, ids = chats
    monkeypatch.setattr(sqlite, "SPAN", 10_000)
    df = sqlite.read_table(spark, path, "message")
    assert {r.rowid for r in df.collect()} == set(ids)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert {r.rowid for r in sqlite.read_table(spark, path, "message").filter("rowid > 150000 and is_from_me = 1").collect()} == {i for i in ids if i > 150_000 and i % 2}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    after = sqlite.read_table(spark, path, "message", after=150_000)
    assert {r.rowid for r in after.collect()} == {i for i in ids if i > 150_000}
    options = {"path": path, "table": "message", "partitions": "6"}
    reader = sqlite.PushingReader(options, sqlite.SqliteSource(options).schema())
    kept = list(reader.pushFilters([sqlite.GreaterThan(("rowid",), 50_000), sqlite.LessThanOrEqual(("rowid",), 120_000), sqlite.EqualTo(("guid",), "g1")]))
    spans = reader.partitions()
    held = [r for s in spans for b in reader.read(s) for r in b.column(0).to_pylist()]
    assert held == [i for i in ids if 50_000 < i <= 120_000] and len(spans) == 6 and len(kept) == 1
    assert all(a.last + 1 == b.first for a, b in zip(spans, spans[1:]))
    none = sqlite.SqliteReader(options | {"after": "999999"}, sqlite.SqliteSource(options).schema())
    assert [b for s in none.partitions() for b in none.read(s)] == []
    with pytest.raises(Exception, match="no table"):
        sqlite.read_table(spark, path, "absent").count()


def test_messages_of_a_chat_database(spark, chats):
    path, ids = chats
    since = ids[2_000]
    cards = adapters.imessage(**sqlite.imessage_tables(spark, path, since), since=since).collect()
    said = {r.fields["imessage_message_id"]: r for r in cards if r.type == "imessage_message"}
    assert set(said) == {f"g{i}" for i in ids if i > since}
    i = next(i for i in ids if i > since and i % 2 == 0 and i % 7)
    assert said[f"g{i}"].body == f"text {i}" and said[f"g{i}"].fields["imessage_chat_id"] == f"chat{1 + i % 8}" and said[f"g{i}"].fields["sent_at"].startswith("2023-03")
    assert {r.fields["imessage_chat_id"] for r in cards if r.type == "imessage_thread"} == {f"chat{1 + i % 8}" for i in ids if i > since}
