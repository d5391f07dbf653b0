"""Chunks, mail and typed tables against brute force and corner cases."""

import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from cardloom.operators import chunking, emails, matching, projections, vectors


def packed(text, limit):
    """A slow, plain packing of paragraphs."""
    text = (text or "").replace("\0", "").strip()
    if len(text) <= limit:
        return [text] if text else []
    out, joinable = [], False
    for p in filter(None, (x.strip() for x in text.split("\n\n"))):
        if joinable and len(p) <= limit and len(out[-1]) + 2 + len(p) <= limit:
            out[-1] += "\n\n" + p
            continue
        while len(p) > limit:
            at = max((i for i in range(1, limit) if p[i] == " "), default=limit)
            out.append(p[:at].strip())
            p = p[at:].strip()
        out += [p] if p else []
        joinable = True
    return out


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé😀z") for _ in range(rng.choice([1, 3, 8, 8, 50])))
    return [None, "", " \n\n ", "one", "x" * 95, "a\0b"] + [
        rng.choice(["\n\n", "\n\n\n", " \n\n"]).join(" ".join(word() for _ in range(rng.choice([1, 2, 5, 20]))) for _ in range(rng.choice([1, 2, 9]))) for _ in range(60)]


def test_chunks_against_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id long, text string")
    for r in df.select("id", "text", chunking.split_chunks(F.col("text"), 40).alias("c"), chunking.rolling_windows(F.col("text"), 40).alias("w")).collect():
        assert r.c == packed(r.text, 40)
        parts = [x.strip() for x in (r.text or "").replace("\0", "").split("\n\n") if x.strip()]
        runs = ["\n\n".join(parts[i : i + 2]) for i in range(len(parts))]
        # a lone paragraph keeps its repeats
        assert r.w == (list(dict.fromkeys(x for run in runs for x in packed(run, 40))) if len(parts) > 1 else packed("".join(parts), 40))


def test_chunk_rows(spark):
    df = spark.createDataFrame([("u", "é\n\né", "b"), (None, None, None)], "uid string, body string, x string")
    rows = chunking.chunk_rows(df, "uid", {"body": F.col("body"), "summary": F.col("x")}, limit=3).collect()
    assert [(r.chunk_type, r.chunk_index, r.content) for r in rows] == [("body", 0, "é"), ("summary", 0, "b")]
    told = json.dumps({"chunk_schema_version": 5, "chunk_type": "body", "source_fields": ["body"], "content": "é"}, sort_keys=True)
    assert rows[0].content_hash == hashlib.sha256(told.encode()).hexdigest()
    assert rows[0].chunk_key == hashlib.sha256(f"u:body:0:{rows[0].content_hash}".encode()).hexdigest()


def test_sections_and_turns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(chunking.heading_sections(F.lit("pre\n# A\nx\n## B\n\ny"))) == ["# A\nx", "## B\n\ny"]
    assert one(chunking.heading_sections(F.lit("# A\nx"))) == []
    assert one(chunking.pipe_turns(F.lit("# no | x\n Ann | hi | all\n| x\nBob |\n\nCy|ok"))) == ["Ann: hi | all", "Cy: ok"]
    assert one(chunking.colon_turns(F.lit("intro\nAnn: hi\nmore\n\nBob: yes\nhttp://x"))) == ["intro", "Ann: hi\nmore", "Bob: yes\nhttp://x"]
    assert one(chunking.colon_turns(F.lit(None).cast("string"))) == []


def test_hash_embedding(spark):
    got = spark.range(1).select(vectors.hash_embedding(F.lit("é"), 20).alias("x")).first().x
    raw = b"".join(hashlib.sha256("é".encode() + k.to_bytes(4, "big")).digest() for k in range(2))
    assert got == [int.from_bytes(raw[i : i + 2], "big") / 65535.0 * 2.0 - 1.0 for i in range(0, 40, 2)]


def test_routes(spark):
    mail = [("UberEats@uber.com ", None, "your order"), ("x@uber.com", "Trip with UBER  eats", "total"), ("x@uber.com", "Your ride", "You rode 3 miles"),
            ("x@notuber.com", "Your ride", "total"), ("a@amazon.com", "Package shipped", "track it"), ("a@lyft.com", "Your ride promo", "total"), (None, None, None)]
    df = spark.createDataFrame([(i, *m, "old") for i, m in enumerate(mail)], "i long, from_email string, subject string, body string, Extractor string")
    got = [(r.extractor, r.is_receipt) for r in emails.route(df).orderBy("i").collect()]
    assert got == [("uber_eats", True), ("uber_eats", True), ("uber_rides", True), (None, None), ("shipping", True), ("lyft", False), (None, None)]


def test_bodies(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    page = "<html><style>x{}</style><!-- no --><!-- provenance: a --><p>Hi&nbsp;all</p><img width='1' src=x><p>Bye</p></html>"
    assert re.sub(r"\s+", " ", one(emails.clean_body(F.lit(page)))) == "<!-- provenance: a -->Hi all Bye"
    assert one(emails.clean_body(F.lit(" a​b\n\n\n\nc < d "))) == "ab\n\nc < d"
    said = "My own answer " * 8
    assert one(emails.own_words(F.lit(said + "\nOn Monday the first, Ann wrote:\n> x"))) == said.rstrip()
    assert one(emails.own_words(F.lit("short\nOn Monday the first, Ann wrote:\n"))) == "short\nOn Monday the first, Ann wrote:\n"


def test_confidence_and_keys(spark):
    cards = [("flight", {"confirmation_code": "ab12c3", "origin_airport": "AAA"}), ("meal_order", {"restaurant": "Uber Eats", "items": "[x]", "total": "3"}), ("other", {"uid": "u"}), ("ride", None)]
    df = spark.createDataFrame(cards, "type string, fields map<string,string>")
    assert [r.c for r in df.select(emails.confidence(F.col("type"), F.col("fields")).alias("c")).collect()] == [0.67, 0.67, 1.0, 0.0]
    assert [r.k for r in df.select(emails.natural_key(F.col("type"), F.col("fields")).alias("k")).collect()] == [
        ["flight", "AB12C3"], ["meal_order", "uber eats", "3.0", ""], ["other", "u"], ["ride", "", "0.0"]]


def test_typed_tables(spark):
    cards = [("u1", "p", "finance", {"amount": "x", "counterparties": "[a, b]", "created": "2024-01-02"}), ("u2", "p", "finance", {"amount": " 2.5", "currency": "- USD\n- EUR"}), ("u3", "p", "ride", {}), ("u4", "p", None, None)]
    df = spark.createDataFrame(cards, "uid string, rel_path string, type string, fields map<string,string>")
    a, b = projections.project(df, "finance", "*amount:dbl, *currency, counterparties:json").orderBy("card_uid").collect()
    assert (a.amount, a.counterparties_json, a.canonical_ready, a.migration_notes, str(a.activity_at)[:10]) == (0.0, '["a","b"]', False, "currency", "2024-01-02")
    assert (b.amount, b.currency, b.canonical_ready, b.activity_at) == (2.5, "USD", True, None)
    assert all(projections.project(df, k).count() == (2 if k == "finance" else k == "ride") for k in ("finance", "ride", "place"))
    text = projections.search_text(F.col("fields"), F.lit("body"))
    assert df.filter("uid = 'u1'").select(text).first()[0] == "x\na\nb\n2024-01-02\nbody"


def test_settled_matches(spark):
    rows = [("a", 1, 0.9), ("a", 2, 0.9), ("b", 1, 0.9), ("b", 2, 0.7), ("c", 1, 0.5), ("d", 1, None), ("e", 1, 0.6), ("e", 2, 0.05), (None, 1, 0.9)]
    got = {r.s: (r.outcome, r.t) for r in matching.settle(spark.createDataFrame(rows, "s string, t long, v double"), "s", "t", "v").collect()}
    assert got == {"a": ("ambiguous", 1), "b": ("confident", 1), "c": ("none", None), "d": ("none", None), "e": ("confident", 1)}
