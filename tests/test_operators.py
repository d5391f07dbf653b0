"""Operators that SQL can't express, and corner cases, on small rows."""

from pyspark.sql import functions as F

from cardloom.functions import normalize
from cardloom.operators import identity, threads
from cardloom.sources import notes
from cardloom.streaming import maintain


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalisers(spark):
    assert one(spark, normalize.phone(F.lit("+1 (555) 010-2030"))) == "5550102030"
    assert one(spark, normalize.phone(F.lit(None).cast("string"))) == ""
    assert one(spark, normalize.handle(F.lit(" @Ann/ "))) == "ann"
    assert one(spark, normalize.alias(F.lit("Ann  (Lee)"))) == "ann lee"
    assert one(spark, normalize.place_key(F.lit("The 5 Main St."))) == "5 main street"
    assert one(spark, normalize.city(F.lit("1 Road, Springfield, XX"))) == "springfield"
    assert one(spark, normalize.wikilinks(F.lit("[[a]] and [[b|B]]"))) == ["a", "b"]
    assert one(spark, normalize.path_bucket(F.lit("Email/2024-01/x.md"))) == "Email/2024-01"
    assert one(spark, normalize.name_similarity(F.lit("Ann Lee"), F.lit("lee bob"))) == 1 / 3
    assert one(spark, normalize.jaccard(F.array(F.lit("A@x "), F.lit("b@x")), F.array(F.lit("a@x")))) == 0.5
    assert one(spark, normalize.keyword_score(F.array(F.lit("Inv"), F.lit("zz")), F.lit("invoice"))) == 0.5
    assert one(spark, normalize.date_proximity(F.lit("2024-01-01").cast("date"), F.lit("2024-01-16").cast("date"))) == 0.5


def test_person_scores(spark):
    assert round(one(spark, identity.token_sort_ratio(F.lit("Lee Ann"), F.lit("ann lee")))) == 100
    none = F.lit(None)
    fuzzy = one(spark, identity.same_person(F.lit(92.0), none, none, none, none, none, none))
    assert (fuzzy.is_match, fuzzy.confidence, fuzzy.reasons) == (False, 60, ["fuzzy_name"])
    sure = one(spark, identity.same_person(F.lit(92.0), none, F.lit(True), none, none, none, none))
    assert (sure.is_match, sure.confidence) == (True, 100)


def test_provenance_merge_and_check(spark):
    rows = [("o", {"a": ("s1", "d", "m", []), "b": ("s1", "d", "m", None)}, {"a": ("s2", "d", "m", []), "b": ("s1", "d", "m", None)}), ("null", None, {"c": ("s", "d", "m", None)})]
    df = spark.createDataFrame(rows, f"k string, o {identity.PROVENANCE}, n {identity.PROVENANCE}")
    got = {r.k: r.m for r in df.select("k", identity.merge_provenance(F.col("o"), F.col("n")).alias("m")).collect()}
    assert got["o"]["a"].source == "s2" and [p.source for p in got["o"]["a"].prior] == ["s1"]
    assert not got["o"]["b"].prior and set(got["null"]) == {"c"}
    fields = F.create_map(F.lit("a"), F.lit("x"), F.lit("z"), F.lit("x"), F.lit("e"), F.lit(""), F.lit("uid"), F.lit("u"))
    assert df.filter("k = 'o'").select(identity.missing_provenance(fields, F.col("n"), ["uid"])).first()[0] == ["z"]


def test_links_survive_nulls_and_hot_values(spark):
    rows = [(f"u{i:03}", "email", "hot") for i in range(200)] + [(None, "email", "hot"), ("x", "email", None), ("y", "email", ""), ("u000", "email", "hot")]
    found = identity.identifier_links(spark.createDataFrame(rows, "uid string, kind string, value string")).collect()
    assert len(found) == 199 and {r.target_uid for r in found} == {"u000"}


def test_windows_stop_at_the_end(spark):
    df = spark.createDataFrame([("t", i) for i in range(10)] + [("s", 0), (None, 1)], "t string, p long")
    got = threads.windows(df, "t", "p", size=4, overlap=1).groupBy("t", "window").agg(F.min("p").alias("a"), F.max("p").alias("b")).collect()
    assert sorted(map(tuple, got)) == [("s", 0, 0, 0), ("t", 0, 0, 3), ("t", 1, 3, 6), ("t", 2, 6, 9)]


def test_notes(spark, tmp_path):
    (tmp_path / "A").mkdir()
    (tmp_path / "A" / "n.md").write_text("---\nuid: u1\ntype: 'person'\npeople:\n- \"[[ann|Ann]]\"\n- bob\ntags: [x, y]\n---\nHi [[zed]]\n")
    (tmp_path / "bare.md").write_text("no head")
    (tmp_path / "skip.txt").write_text("x")
    got = notes.read_notes(spark, str(tmp_path)).cache()
    assert sorted((r.uid or "", r.type or "", r.body) for r in got.collect()) == [("", "", "no head"), ("u1", "person", "Hi [[zed]]\n")]
    lists = got.filter("uid = 'u1'").select(notes.items(F.col("fields")["people"]).alias("p"), notes.items(F.col("fields")["tags"]).alias("t"), notes.items(F.col("fields")["none"]).alias("n")).first()
    assert (lists.p, lists.t, lists.n) == (["[[ann|Ann]]", "bob"], ["x", "y"], [])
    assert sorted(r.slug for r in notes.link_edges(got).collect()) == ["ann", "zed"]
    assert notes.fingerprint(got).first().n == 2


def test_upkeep_takes_only_what_is_new(spark, tmp_path):
    source, home = str(tmp_path / "in"), str(tmp_path)
    put = lambda rows: spark.createDataFrame(rows, "k string, v long, x string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: maintain.maintain(spark.readStream.schema("k string, v long, x string").parquet(source), f"{home}/t", f"{home}/c", ["k"], ["v"])
    put([("a", 1, "old"), ("a", 1, "older"), ("b", 1, None)])
    run()
    put([("a", 2, "new")])
    run()
    run()
    assert sorted(map(tuple, maintain.current(spark, f"{home}/t", ["k"], ["v"]).collect())) == [("a", 2, "new"), ("b", 1, None)]
    maintain.compact(spark, f"{home}/t", f"{home}/t2", ["k"], ["v"])
    assert maintain.current(spark, f"{home}/t2", ["k"], ["v"]).count() == 2


def test_keys_of_persons_are_dealt_before_they_are_expanded(spark):
    """One task held and sorted the keys of all persons of a file."""
    from cardloom.operators import features

    fields = F.create_map(F.lit("summary"), F.concat(F.lit("Ann  B"), F.col("id").cast("string")), F.lit("emails"), F.concat(F.lit("[A"), F.col("id").cast("string"), F.lit("@x.org, all@x.org]")))
    cards = spark.range(400).coalesce(1).select(F.concat(F.lit("u"), "id").alias("uid"), F.concat(F.lit("P/"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("rel_path"), F.concat(F.lit("s"), "id").alias("slug"), F.lit("person").alias("type"), fields.alias("fields"), F.lit("").alias("body"))
    lookup = features.person_lookup(cards)
    got = {r.key: r.uid for r in lookup.collect()}
    assert len(got) == 3 * 400 + 1 and got["all@x.org"] == "u399" and got["ann-b7"] == got["a7@x.org"] == got["s7"] == "u7"
    plan = lookup._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = lambda what: next(i for i, line in enumerate(plan) if what in line)
    assert at("Aggregate") < at("Generate") < at("RepartitionByExpression")
