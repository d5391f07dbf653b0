"""Names alike against all pairs; candidates of persons hold every plausible pair, a hot last name stays within them; the sweep loses none."""

import difflib
import random

import duckdb
from pyspark.sql import functions as F

from cardloom.operators import names, people
from cardloom.plans import catalog, persons  # noqa: F401
from compare import SF, connect, rows

PERSON = "uid string, first_name string, last_name string, name string, aliases array<string>, emails array<string>, phones array<string>, handles array<string>, companies array<string>, titles array<string>"


def ratio(a: str, b: str) -> float:
    return 100 * difflib.SequenceMatcher(None, " ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split()))).ratio()


def brute(left, right, least):
    own = lambda xs: {" ".join(sorted((x or "").lower().split())) for x in xs} - {""}
    return {(a, b): round(ratio(a, b), 6) for a in own(left) for b in own(right) if ratio(a, b) >= least}


def test_alike_is_all_pairs(spark):
    rng = random.Random(8)
    base = [" ".join("".join(rng.choice("abeilnorst") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4))) for _ in range(500)] + ["aaaa aaaa aaaa", "aaaaa aaaa aaa", "x", "xy", None, "", "Zoë Ångström"]

    def changed(n):
        n = list(n or "")
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(n) + 1)
            n[at : at + rng.randrange(2)] = rng.choice(["", "q", "a", " "])
        return "".join(n)

    left, right = base, [changed(n) for n in base for _ in range(2)]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    for least in (90, 95):
        got = {(r.a, r.b): round(r.score, 6) for r in names.similar_names(frame(left), frame(right), least).collect()}
        want = brute(left, right, least)
        assert got == want and len(want) > 200
    assert names.similar_names(frame([]), frame(right)).count() == 0


def test_registered_names_are_all_pairs(spark):
    told = [" ".join((t or "").split()[:2]) for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    got = {(r.a, r.b): round(r.score, 6) for r in catalog.QUERIES["similar_names"](spark, SF).collect()}
    assert got == brute(told, [t[:4] + t[5:] for t in told], 90) and len(got) > 50


def crowd(rng, n):
    """Persons, a third of them of one last name, some twice, some without a first or last name."""
    firsts, out = ["bob", "robert", "ann", "anna", "zoe", "rita", "carl", "mia", ""], []
    for i in range(n):
        first = rng.choice(firsts) + rng.choice(["", "", "q", "belle"])
        last = "lee" if i % 3 == 0 else rng.choice(["", "fournier", "fourniere", "o neil", "smith", "smyth", "stonefield"])
        mail = [f"m{rng.randrange(n)}@x.org"] if rng.random() < 0.3 else []
        out.append((f"u{i:04}", first, last, f"{first} {last}".strip(), [], mail, [f"+{rng.randrange(n)}"] if rng.random() < 0.2 else [], [f"github:{rng.randrange(n)}"] if rng.random() < 0.2 else [], ["acme"] if i % 5 == 0 else [], []))
    return out + [(f"t{r[0]}", *r[1:]) for r in out[: n // 6]]


def test_candidates_hold_every_plausible_pair(spark):
    rows = crowd(random.Random(3), 300)
    nick = spark.createDataFrame([("bob", "robert")], "nickname string, canonical string")
    p = people.with_canonical(spark.createDataFrame(rows, PERSON), nick)
    met = {(r.uid, r.target_uid) for r in people.candidate_pairs(p, p).collect()}
    every = p.select("uid").crossJoin(p.select(F.col("uid").alias("target_uid"))).filter("uid <> target_uid")
    plausible = {(r.uid, r.target_uid) for r in people.scored(people.sides(every, p, p)).filter("is_plausible").collect()}
    assert plausible <= met and len(met) < 1.6 * len(plausible) and len(plausible) > 1_000


def test_sweep_by_brute_force(spark):
    rows = crowd(random.Random(5), 90)
    df = spark.createDataFrame(rows, PERSON)
    filled = spark.createDataFrame([(r[0], len(r[3]) % 4) for r in rows], "uid string, n int")
    nick = spark.createDataFrame([("bob", "robert")], "nickname string, canonical string")
    got = {(r.uid, r.target_uid): (r.confidence, r.action) for r in people.dedup_sweep(df, filled, nick).collect()}
    rank = {r[0]: (-(len(r[3]) % 4), r[0]) for r in rows}
    head = {}
    for r in sorted(rows, key=lambda r: rank[r[0]]):
        head.setdefault(repr(r[1:]), r[0])
    p = people.with_canonical(df, nick)
    every = p.select("uid").crossJoin(p.select(F.col("uid").alias("target_uid"))).filter("uid <> target_uid")
    want = {}
    for r in people.scored(people.sides(every, p, p)).filter("is_match and confidence >= 75").collect():
        own, other = (head[repr(next(x for x in rows if x[0] == u)[1:])] for u in (r.uid, r.target_uid))
        if rank[r.target_uid] < rank[r.uid] and (r.uid == own and r.target_uid == other or r.target_uid == own):
            want[r.uid, r.target_uid] = (r.confidence, "merge" if r.confidence >= 90 else "flag")
    assert {k: v for k, v in want.items() if k not in got} == {} and got == want and len(want) > 20


def test_links_of_classes_are_those_of_all_pairs(spark):
    """Every pair with one last name counts, whatever the first names; no pair is made for it."""
    p = people.with_canonical(spark.createDataFrame(crowd(random.Random(7), 200), PERSON), spark.createDataFrame([("bob", "robert")], "nickname string, canonical string"))
    rows = {r.uid: r for r in p.collect()}
    linked = lambda a, b: a.last_name == b.last_name if a.last_name and b.last_name else a.canonical == b.canonical != ""
    got = {r.uid: r for r in people.block_links(p).collect()}
    assert {u: r.n_links for u, r in got.items()} == {u: sum(linked(a, b) for v, b in rows.items() if v != u) for u, a in rows.items()}
    assert all(r.class_uid == min(v for v, o in got.items() if (o.last_name, o.canonical) == (r.last_name, r.canonical)) for r in got.values())


def test_every_pair_of_a_block_is_listed_once(spark):
    p = people.with_canonical(spark.createDataFrame(crowd(random.Random(7), 200), PERSON), spark.createDataFrame([("bob", "robert")], "nickname string, canonical string"))
    rows = p.collect()
    linked = lambda a, b: a.last_name == b.last_name if a.last_name and b.last_name else a.canonical == b.canonical != ""
    want = sorted((a.uid, b.uid) for a in rows for b in rows if a.uid != b.uid and linked(a, b))
    for many in (1_000, 7):
        assert sorted((r.uid, r.target_uid) for r in people.block_pairs(p, many).collect()) == want


def test_the_query_lists_pairs(spark):
    got = catalog.QUERIES["person_blocks"](spark, SF)
    own, want = rows(got.toPandas()), rows(connect().sql(catalog.ORACLE["person_blocks"]).df())
    assert own == want and len(own[1]) > 5_000


def test_shared_identifiers_are_classes_of_all_pairs(spark):
    """Cards and persons of one address, expanded, are the pairs that share it; a row each, however many they are."""
    from cardloom.operators import links

    rng = random.Random(11)
    rows = lambda p, n: spark.createDataFrame([(f"{p}{rng.randrange(n)}", "exact_email", f"m{rng.randrange(9)}") for _ in range(2 * n)] + [(f"{p}x", "exact_email", f"only-{p}")], "uid string, kind string, value string")
    cards, persons = rows("c", 40).cache(), rows("p", 30).cache()
    got = links.identifier_classes(cards, persons).collect()
    of = lambda side: [(r.uid, r.value, r.n_links) for r in got if r.side == side]
    pairs = {(c, p, v) for c, v, _ in of("card") for p, w, _ in of("person") if v == w}
    assert {(c, p) for c, p, _ in pairs} == {(r.uid, r.target_uid) for r in links.person_matches(cards, persons).collect()}
    assert all(n == sum(x[0] == u and x[2] == v for x in pairs) for u, v, n in of("card")) and all(n == sum(x[1] == u and x[2] == v for x in pairs) for u, v, n in of("person"))


def test_repeated_letters_lose_no_pair(spark):
    """A letter taken out before a second "he" numbers it anew; long names meet by pairs of letters, shorter ones by what is left."""
    rng = random.Random(2)
    long = [" ".join("".join(rng.choice("ehnt") for _ in range(rng.randrange(2, 7))) for _ in range(7)) for _ in range(60)]
    changed = [n[:i] + rng.choice(["", "e", "he"]) + n[i + 2 :] for n in long for i in (1, len(n) // 2, len(n) - 3)]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    left, right = ["he the", *long], ["h the", *changed]
    got = {(r.a, r.b): round(r.score, 6) for r in names.similar_names(frame(left), frame(right)).collect()}
    assert got == brute(left, right, 90) and ("he the", "h the") in got and len(got) > 100


def test_numbered_names_meet_only_near_ones(spark):
    """Names that differ by digits alone: who meets is in proportion to who is alike, not all pairs."""
    words = spark.range(2_000).select(F.format_string("%09d customer", F.col("id") * 7).alias("w"), F.array(F.lit(0), F.lit(1)).alias("sides"))
    lengths = spark.createDataFrame([(18, 18, 17)], "la int, lb int, m int")
    met = {(r.a, r.b) for r in names._met_by_rest(words, lengths, 90).collect()}
    told = words.select(F.col("w").alias("name"))
    alike = {(r.a, r.b) for r in names.similar_names(told, told).filter("a <> b").collect()}
    assert alike <= met and 1_000 < len(alike) and len(met) < 1.5 * len(alike)


def test_what_is_left_of_names_is_not_broadcast(spark):
    """A few names leave hundreds of rows each, which Spark doesn't foresee; only the lengths are sent to all."""
    words = spark.range(50).select(F.format_string("%026d customer", F.col("id") * 7).alias("w"), F.array(F.lit(0), F.lit(1)).alias("sides"))
    lengths = spark.createDataFrame([(35, 35, 32)], "la int, lb int, m int")
    for met in (names._met_by_rest(words, lengths, 90), names._met_by_grams(words, lengths, 90)):
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and all("len#" in x or "la#" in x for x in plan.splitlines() if "BroadcastHashJoin" in x)


def test_persons_are_not_broadcast_to_pairs(spark):
    """However small Spark takes the persons for; only nicknames and the like are sent to all."""
    p = people.with_canonical(spark.createDataFrame(crowd(random.Random(5), 20), PERSON), spark.createDataFrame([("bob", "robert")], "nickname string, canonical string"))
    pairs = spark.createDataFrame([("u0000", "u0001")], "uid string, target_uid string")
    told = people.sides(pairs, p, p, most=len(crowd(random.Random(5), 20)) - 1)._jdf.queryExecution().executedPlan().toString()
    assert not any("BroadcastHashJoin" in x and "uid#" in x for x in told.splitlines())
    met = people.candidate_pairs(p, p, fuzzy=False)._jdf.queryExecution().executedPlan().toString()
    assert not any("BroadcastHashJoin" in x and "block#" in x for x in met.splitlines())


def test_ratios_of_a_batch_are_those_of_difflib():
    from cardloom.operators.identity import ratios

    rng = random.Random(13)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    a = [text(rng.choice((0, 1, 7, 18, 40, 127, 128, 210)), rng.choice(("ab", "0123456789", "é漢x😀 "))) for _ in range(1_500)]
    b = ["".join(c for c in x if rng.random() > 0.1) + text(rng.randrange(3), "ab0x") if rng.random() < 0.8 else text(rng.randrange(30), "ab0x") for x in a]
    assert ratios(a, b).tolist() == [100 * difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    assert ratios([], []).tolist() == []


def test_a_filter_by_the_score_compares_no_pair_twice(spark):
    p = people.with_canonical(spark.createDataFrame(crowd(random.Random(5), 20), PERSON), spark.createDataFrame([("bob", "robert")], "nickname string, canonical string"))
    every = p.select("uid").crossJoin(p.select(F.col("uid").alias("target_uid")))
    plan = people.scored(people.sides(every, p, p)).filter("is_match and confidence >= 75")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("token_sort_ratio(a_name") == 1
