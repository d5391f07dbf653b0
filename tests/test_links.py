"""Links of persons and events against all pairs, each once, where many share an address, a day or a title."""

import random

from cardloom.operators import links


def test_dealt_join_is_the_join(spark):
    """A key that many rows of both sides hold is dealt to parts; no row is lost or doubled."""
    rng = random.Random(4)
    side = lambda p, n: spark.createDataFrame([(f"{p}{i}", rng.choice("aaaaab")) for i in range(n)] + [(f"{p}z", None)], "uid string, k string").cache()
    a, b = side("a", 90), side("b", 40).withColumnRenamed("uid", "other")
    got = sorted(tuple(r) for r in links._dealt(a, b, ["k"], many=10, parts=4).select("uid", "other", "k").collect())
    assert got == sorted(tuple(r) for r in a.join(b, "k").select("uid", "other", "k").collect()) and len(got) > 1_000


def test_crowded_counts_persons_once(spark):
    persons = spark.createDataFrame([("p1", "e", "x"), ("p1", "e", "y"), ("p2", "e", "x"), ("p3", "e", "z"), ("p4", "e", "z"), ("p5", "e", "z"), ("p6", "e", "z")], "target_uid string, kind string, value string")
    sought = spark.createDataFrame([("a", "e", "x"), ("a", "e", "y"), ("b", "e", "z"), ("c", "e", "w")], "uid string, kind string, value string")
    of = lambda most: {r.uid for r in links._crowded(sought, persons, most).collect()}
    assert of(1) == {"a", "b"} and of(2) == {"b"} and of(3) == {"b"} and of(4) == set()


def _after_joins(df) -> str:
    """The optimized plan down to the first join."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]


def test_persons_met_are_not_grouped(spark):
    """What a shared address links isn't grouped, sorted or made distinct after the join."""
    cards = spark.createDataFrame([(f"m{i}", "Email/m.md", f"m{i}", "email_message", {"from_email": "a@x.org", "to_emails": "[b@x.org]"}, "") for i in range(4)] + [(f"p{i}", "People/p.md", f"p{i}", "person", {"summary": f"P {i}", "emails": "[a@x.org, b@x.org]"}, "") for i in range(5)], "uid string, rel_path string, slug string, type string, fields map<string, string>, body string")
    met = links._participants(links.sketch(cards), {"email_message": (("from_email",), "exact_email", "message_mentions_person", "communicationLinker")}, cards)
    rows = met.collect()
    assert "Aggregate" not in _after_joins(met) and "Join Inner" in met._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.source_uid, r.target_uid) for r in rows) == [(f"m{i}", f"p{j}") for i in range(4) for j in range(5)] and {r.risk for r in rows} == {0.12}


def test_events_met_once_by_all_pairs(spark):
    """Hints, a day's titles and places against all pairs; a pair that several rules or words name comes once, no pair is grouped after the joins."""
    rng = random.Random(6)
    words = ["plan", "team", "meet", "x", "y"]

    def card(i, kind):
        title = " ".join(rng.sample(words, rng.randrange(1, 4)))
        own = {"event_id": f"e{i}", "ical_uid": f"c{i}"} if kind == "calendar_event" else {"event_id_hint": f"e{rng.randrange(40)}"}
        return f"{kind}{i}", "", "", kind, {"title": title, "start_at": f"2024-01-0{rng.randrange(1, 4)}T10:00:00Z", "location": rng.choice(["", "Room", "Hall"]), **own}, ""

    rows = [card(i, k) for k in ("meeting_transcript", "calendar_event") for i in range(40)]
    s = links.sketch(spark.createDataFrame(rows, "uid string, rel_path string, slug string, type string, fields map<string, string>, body string"))
    met = links.met_events(links._side(s.filter("type = 'meeting_transcript'"), "s", {}), links.event_side(s.filter("type = 'calendar_event'"), {}))
    want = []
    for u, _, _, _, a, _ in rows[:40]:
        for v, _, _, _, b, _ in rows[40:]:
            x, y = set(a["title"].split()), set(b["title"].split())
            day = a["start_at"] == b["start_at"]
            if a["event_id_hint"] == b["event_id"] or day and (round(len(x & y) / len(x | y), 4) >= 0.6 or a["location"] == b["location"] != ""):
                want.append((u, v))
    assert sorted((r.s_uid, r.e_uid) for r in met.collect()) == sorted(want) and len(want) > 100


def test_meetings_by_brute_force(spark):
    """Whole seconds count: 15 minutes and nine tenths apart lie in blocks that 900 seconds don't join; a pair comes once, under its first tier."""
    import datetime
    import random

    from cardloom.operators import matching

    rng, start = random.Random(4), datetime.datetime(2024, 1, 1, 23, 0)
    some = lambda: rng.choice([None, [], [None, "p0"], rng.sample([f"p{i}" for i in range(30)], rng.randrange(1, 25)), rng.sample([f"p{i}" for i in range(30)], 3)])
    rows = lambda n, at: [(f"{at}{i}", rng.choice([None, "", *(f"k{j}" for j in range(40))]), rng.choice([None, "", "talk 0", "talk 1", "talk 2"]), rng.choice([None, *(start + datetime.timedelta(seconds=rng.randrange(9_000)) for _ in range(9))]), some()) for i in range(n)]
    t, e = rows(60, "t"), rows(60, "e")
    t.append(("t-edge", None, "talk 1", datetime.datetime(2024, 1, 2, 0, 14, 59, 900_000), None))
    e.append(("e-edge", None, "talk 1", datetime.datetime(2024, 1, 2, 0, 30, 0, 800_000), None))
    want = {}
    for x in t:
        for y in e:
            apart = int(abs((x[3] - y[3]).total_seconds())) if x[3] and y[3] else None
            if x[1] and x[1] == y[1]:
                want[x[0], y[0]] = "ical_uid"
            elif x[2] and x[2] != "talk 0" and x[2] == y[2] and apart is not None and apart <= 900:
                want[x[0], y[0]] = "title_time"
            elif apart is not None and apart <= 3600 and x[3].date() == y[3].date() and len({*(x[4] or ())} & {*(y[4] or ())} - {None}) >= 2:
                want[x[0], y[0]] = "participant_time"
    schema = "uid string, ical_uid string, title string, start_at timestamp_ntz, participants array<string>"
    got = [(r.transcript_uid, r.event_uid, r.tier) for r in matching.meeting_artifacts(spark.createDataFrame(t, schema), spark.createDataFrame(e, schema), ["talk 0"]).collect()]
    assert ("t-edge", "e-edge", "title_time") in got and {(a, b): n for a, b, n in got} == want and len(got) == len(want) and len({*want.values()}) == 3


def test_persons_of_photos_are_a_row_each(spark):
    """A person's aliases come from the person's own row: nothing is grouped by person; an alias that is told twice links once."""
    cards = spark.createDataFrame([("ph", "", "", "media_asset", {"person_labels": "[Ann Lee, Bo]", "summary": "x", "captured_at": "2024-01-01T10:00:00Z"}, "")]
                                  + [(f"p{i}", f"People/p{i}.md", f"p{i}", "person", {"summary": n, "first_name": "Ann", "aliases": a}, "") for i, (n, a) in enumerate([("Ann Lee", "[ann lee, Bo]"), ("Cy", "[bo]"), ("Di", "")])],
                                  "uid string, rel_path string, slug string, type string, fields map<string, string>, body string")
    made = links.media_candidates(cards)
    assert sorted((r.source_uid, r.target_uid, r.risk) for r in made.collect()) == [("ph", "p0", 0.3), ("ph", "p1", 0.3)]
    assert "collect_set" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_tiers_of_a_common_amount_by_brute_force(spark):
    """One amount for all: the tier, the nearest and smallest charge as by all pairs, without pairs being ranked."""
    import datetime

    from cardloom.operators import linkers

    rng = random.Random(8)
    row = lambda i, days: (i, rng.choice([5.0, 5.0, 7.5]), datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(24 * days)), rng.choice([None, 1, 2, 3]))
    c, t = [row(i, 30) for i in range(60)], [row(i, 45) for i in range(150)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, amount double, at timestamp_ntz, merchant int")
    want = []
    for i, amount, at, m in t:
        met = [(apart > 2 or m is None or n != m, apart, j) for j, b, then, n in c if b == amount and (apart := abs((then.date() - at.date()).days)) <= 3]
        want += [(i, j, "LOW" if low else "HIGH", apart) for low, apart, j in sorted(met)[:1]]
    got = linkers.finance_tiers(frame(c, "charge"), frame(t, "target"))
    assert sorted(tuple(r) for r in got.collect()) == want and {w[2] for w in want} == {"HIGH", "LOW"} and len(want) < len(t)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
