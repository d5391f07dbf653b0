"""Linkers, people, chunks by type, receipts and slices against plain Python, and corner cases."""

import difflib
import json
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from cardloom.operators import builders, features, graph, links, people, receipts
from cardloom.sources import stores
from test_extraction import packed

CARD = "uid string, rel_path string, slug string, type string, fields map<string,string>, body string"


def card(kind, n, body="", **fields):
    return (f"{kind}-{n}", f"{kind}/{n}.md", f"{kind}-{n}", kind, {k: str(v) for k, v in fields.items()}, body)


def test_content_hash_is_that_of_sorted_json(spark):
    df = spark.createDataFrame([card("person", 1, "bödy", b="é", a="x"), ("u", "p", "s", None, None, None)], CARD)
    got = {r.uid: r.h for r in df.select("uid", features.content_hash(F.col("fields"), F.col("body")).alias("h")).collect()}
    assert got == {"person-1": features.plain_hash({"b": "é", "a": "x"}, "bödy"), "u": features.plain_hash({}, "")}


@pytest.mark.parametrize("kind,text", [("email_thread", "a\n\nb\n\na\n\nb\n\nc"), ("email_thread", "one " * 90), ("imessage_thread", "a\n\na\n\na"), ("document", "# A\nx\n# B\ny"), ("document", "plain"), ("meeting_transcript", "p\n\nq\n\nr"), ("person", ""), ("flight", "body " * 30)])
def test_chunks_by_type(spark, kind, text):
    df = spark.createDataFrame([card(kind, 1, text, summary="Sum", subject="Sub", title="T"), (None, None, None, None, None, None)], CARD)
    rows = builders.build_chunks(df, limit=40).filter("uid is not null").orderBy("chunk_type", "chunk_index").collect()
    got = {}
    for r in rows:
        got.setdefault(r.chunk_type, []).append((r.chunk_index, r.content))
    paras = [p.strip() for p in text.split("\n\n") if p.strip()]
    numbered = lambda pieces: [(i, p) for i, p in enumerate(pieces) if pieces.index(p) == i]
    runs = lambda n: list(dict.fromkeys(x for i in range(len(paras)) for x in packed("\n\n".join(paras[i : i + n]), 40))) if len(paras) > 1 else packed(text, 40)
    if kind == "email_thread":
        assert got["thread_window"] == numbered(runs(2)) and got["thread_recent_window"] == numbered(packed("\n\n".join(paras[-2:]), 40)) and got["thread_subject"] == [(0, "Sub")]
    elif kind == "imessage_thread":
        assert got["imessage_thread_window"] == numbered(runs(3))
    elif kind == "document":
        assert got.get("document_section", got.get("document_body")) == ([(0, "# A\nx"), (1, "# B\ny")] if "#" in text else [(0, "plain")]) and got["document_title_meta"] == [(0, "title: T; Sum")]
    elif kind == "meeting_transcript":
        assert got["meeting_transcript_summary"] == [(0, "p\n\nq")] and got["meeting_transcript_body"] == [(0, "p\n\nq\n\nr")]
    elif kind == "person":
        assert got == {"person_profile": [(0, "name: Sum")], "person_role": [(0, "title: T")]}  # no other part has a filled field
    else:
        assert got["body"] == numbered(packed(text, 40)) and got["title"] == [(0, "T")]


def test_merchants(spark):
    names = ["SQ *BLUE BOTTLE", "Blue Bottle Coffee", "AMZN Mktp US", "Amazon.com", "Uber", "UBER *EATS", "", None, "Joe's Inc.", "joes", "TST* Bar 12", "bar-12 LLC"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    got = df.select("a", "b", links.merchants_match(links.merchant(F.col("a")), links.merchant(F.col("b"))).alias("m"), links.merchant(F.col("a")).alias("n")).collect()
    clean = {r.a: r.n for r in got}
    for r in got:
        a, b = sorted((clean[r.a], clean[r.b]), key=len)
        assert r.m == (bool(a and b) and (a == b or len(a) >= 4 and a in b or difflib.SequenceMatcher(None, clean[r.a], clean[r.b]).ratio() >= 0.7)), r
    assert clean["SQ *BLUE BOTTLE"] == "blue bottle" and clean["Amazon.com"] == "amazon" and clean["Joe's Inc."] == "joe s"


def test_finance_tiers_by_brute_force(spark):
    rng = random.Random(2)
    day = lambda k: f"2024-{1 + k // 28:02}-{1 + k % 28:02}"
    cards = [card("email_message", k, gmail_thread_id=f"t{k % 3}") for k in range(6)]
    for n in range(120):
        money = rng.choice(["10.00", "10.01", "25.5"])
        mail = rng.choice(["", "", f"[[email_message-{rng.randrange(6)}]]"])
        if n % 2:
            cards.append(card("finance", n, amount=rng.choice(["", "-"]) + money, transaction_type=rng.choice(["refund", "buy"]), counterparty=rng.choice(["Shop", "Other Store", ""]), created=day(rng.randrange(80)), source_email=mail, currency=rng.choice(["", "EUR"])))
        else:
            cards.append(card("purchase", n, total=money, vendor=rng.choice(["SHOP inc", "Else"]), created=day(rng.randrange(80)), source_email=mail, currency=rng.choice(["usd", "EUR"])))
    got = {(r.finance_uid, r.target_uid): r.tier for r in links.finance_candidates(spark.createDataFrame(cards, CARD)).collect()}
    number = lambda d: date.fromisoformat(d).toordinal()
    thread = {f"email_message-{k}": f"t{k % 3}" for k in range(6)}
    same = lambda a, b: bool(a and b) and (a == b or difflib.SequenceMatcher(None, a, b).ratio() >= 0.7)
    plain = {"Shop": "shop", "SHOP inc": "shop", "Other Store": "other store", "Else": "else", "": ""}
    want = {}
    for a in (c for c in cards if c[3] == "finance"):
        for b in (c for c in cards if c[3] == "purchase"):
            f, p = a[4], b[4]
            if (f["currency"] or "USD").upper() != p["currency"].upper():
                continue
            fm, tm = abs(float(f["amount"])), float(p["total"])
            apart, shop, mails = abs(number(f["created"]) - number(p["created"])), same(plain[f["counterparty"]], plain[p["vendor"]]), (f["source_email"].strip("[]"), p["source_email"].strip("[]"))
            wide = float(f["amount"]) < 0 and f["transaction_type"] == "refund"
            signals = (abs(fm - tm) <= 0.01 + 1e-9) + (apart <= 2) + shop
            equal = f"{fm:.2f}" == f"{tm:.2f}"
            if mails[0] and mails[0] == mails[1] and signals:
                want[a[0], b[0]] = "source_email" if signals >= 2 else "source_email_weak"
            elif equal and shop and apart <= (60 if wide else 2):
                want[a[0], b[0]] = "high"
            elif equal and mails[0] and mails[1] and thread[mails[0]] == thread[mails[1]] and apart <= (60 if wide else 5):
                want[a[0], b[0]] = "medium"
            elif equal and apart <= (14 if wide else 3):
                want[a[0], b[0]] = "low"
    assert got == want and len(set(want.values())) == 5


def test_people_scores_and_nicknames(spark):
    rows = [("a", "bob", "lee", "bob lee", [], ["b@x.org"], [], [], ["acme"], []), ("b", "robert", "lee", "robert lee", [], ["b@x.org"], [], [], ["acme"], []), ("c", "rita", "lee", "rita lee", [], [], [], [], [], []), ("d", "", "", "", [], [], [], [], [], []), ("e", "bob", "", "bob", [], [], [], ["github:bl"], [], []), ("f", "x", "y", "x y", [], [], [], ["github:bl"], [], [])]
    schema = "uid string, first_name string, last_name string, name string, aliases array<string>, emails array<string>, phones array<string>, handles array<string>, companies array<string>, titles array<string>"
    p = people.with_canonical(spark.createDataFrame(rows, schema), spark.createDataFrame([("bob", "robert")], "nickname string, canonical string"))
    got = {(r.uid, r.target_uid): r for r in people.scored(people.sides(people.candidate_pairs(p, p).union(spark.createDataFrame([("a", "c")], "uid string, target_uid string")), p, p)).collect()}
    assert got["a", "b"].name_score == 95 and got["a", "b"].is_match and got["a", "b"].confidence == 100 and got["a", "b"].is_plausible
    assert not got["a", "c"].is_plausible and not got["a", "c"].is_match  # another first name's initial
    assert got["e", "f"].social and got["e", "f"].confidence == 95 and ("a", "e") in got and not any("d" in k for k in got)


def test_text_quality_and_bodies(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for t in ("Acme, Inc. & Co", "  ", "a!b?", "Ünï x"):
        s = t.strip()
        want = len(re.findall(r"[A-Za-z0-9]", s)) + 2 * len(s.split()) - len(re.findall(r"[^\w\s&/.,'-]", s)) if s else 0
        assert one(people.text_quality(F.lit(t))) == want
    assert one(people.merged_body(F.lit("a"), F.lit(" "))) == "a" and one(people.merged_body(F.lit(None).cast("string"), F.lit(" b "))) == "b"


def test_receipts_need_their_fields(spark):
    mail = [("1", "a@uber.com", "Your trip", "Pickup: 1 Main St\nTotal $5.00"), ("2", "a@uber.com", "Your trip", "Pickup: 1 Main St\nDropoff: 2 Side St\nTotal $5.00\ntip: $1"), ("3", "x@doordash.com", "Order", "order from Joe's\ntotal 7.5"), ("4", None, None, None), ("5", "a@united.com", "Trip", "confirmation number: NUMBER\nSFO to JFK")]
    df = spark.createDataFrame([(*m, "2024-01-02T00:00:00Z") for m in mail], "uid string, from_email string, subject string, body string, sent_at string")
    got = {r.uid: (r.card_type, r.fields) for r in receipts.extract(df).collect()}
    assert set(got) == {"2", "3"} and got["2"][1]["fare"] == "5.0" and got["2"][1]["tip"] == "1.0" and got["2"][1]["pickup_at"] == "2024-01-02" and got["3"][1]["restaurant"] == "Joe's"
    assert receipts.extract(df.limit(0)).count() == 0


def test_clusters_stop_at_the_cap(spark):
    refs = spark.createDataFrame([(f"h{i}", f"h{i + 1}") for i in range(30)] + [("a", "b"), ("b", "a"), ("b", "c"), ("x", "y")], "source_uid string, target_uid string")
    seeds = spark.createDataFrame([("a",), ("h0",), ("z",)], "uid string")
    got = {(r.seed, r.uid) for r in graph.seed_clusters(refs, seeds, 5).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("z", "z")}
    assert {r.uid for r in graph.with_dangling(seeds.limit(1), refs).collect()} == {"a", "b", "c"}
    assert {(r.uid, r.hop) for r in graph.reached(refs, seeds.filter("uid = 'a'"), None).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_hot_identifiers_stay_linear(spark):
    cards = [card("person", n, summary=f"P{n}", emails="[all@x.org]") for n in range(60)]
    got = links.identity_candidates(spark.createDataFrame(cards, CARD), most_shared=10).collect()
    assert len(got) == 59 and {r.source_uid for r in got} == {"person-0"}


def test_writes_are_checked(spark, tmp_path):
    told = ("s", "d", "deterministic", [])
    rows = [("u1", "a.md", "person", {"summary": "x"}, {"summary": told}), ("u2", "a.txt", "person", {}, {}), (None, "b.md", None, {"a": "1"}, None)]
    schema = "uid string, rel_path string, type string, fields map<string,string>, provenance map<string, struct<source: string, date: string, method: string, prior: array<struct<source: string, date: string, method: string>>>>"
    refused = {r.rel_path: r.reasons for r in stores.write_cards(spark.createDataFrame(rows, schema), str(tmp_path / "c")).collect()}
    assert refused["a.txt"] == ["no note path"] and refused["b.md"][:2] == ["no uid", "no type"] and spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_relationship_maps(spark):
    df = spark.createDataFrame([card("person", 1, people="[[a]]", orgs="[x, y]", number="7", parent_shas="[p, p, q]")], CARD)
    one = df.select(F.to_json(features.external_ids_map(F.col("fields"))).alias("e"), F.to_json(features.relationships_map(F.col("fields"))).alias("r")).first()
    assert json.loads(one.e) == {"github_thread_number": ["7"], "github_commit": ["p", "q"]} and json.loads(one.r) == {"people": ["[[a]]"], "orgs": ["x", "y"]}


def test_far_merchants_need_no_matcher(spark):
    """The matcher is given only pairs that edit distance leaves, and the verdict is the same as with it alone."""
    rng = random.Random(4)
    names = ["".join(rng.choice("abc ") for _ in range(rng.randrange(9))).strip() for _ in range(60)]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").withColumn("m", links.merchants_match(F.col("a"), F.col("b")))
    assert "levenshtein" in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        a, b = sorted((r.a, r.b), key=len)
        assert r.m == (bool(a and b) and (a == b or len(a) >= 4 and a in b or difflib.SequenceMatcher(None, r.a, r.b).ratio() >= 0.7)), r
