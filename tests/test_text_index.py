"""Stems against published pairs; the inverted index against a scan of every text, also after deltas."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cardloom.functions.stems import STOPS, porter2, stem, words
from cardloom.operators import search, textindex
from cardloom.plans import catalog, searching  # noqa: F401
from compare import SF

# From the sample vocabulary that the Snowball project publishes for its English stemmer.
PUBLISHED = dict(pair.split(":") for pair in """
consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist consistent:consist consistently:consist consisting:consist
consists:consist consolation:consol consolations:consol consolatory:consolatori console:consol consoled:consol consoles:consol consolidate:consolid consolidated:consolid consolidating:consolid
consoling:consol consolingly:consol consols:consol consonant:conson consort:consort consorted:consort consorting:consort conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci
conspirator:conspir conspirators:conspir conspire:conspir conspired:conspir conspiring:conspir constable:constabl constables:constabl constance:constanc constancy:constanc constant:constant
knack:knack knackeries:knackeri knacks:knack knag:knag knave:knave knaves:knave knavish:knavish kneaded:knead kneading:knead knee:knee kneel:kneel kneeled:kneel kneeling:kneel kneels:kneel
knees:knee knell:knell knelt:knelt knew:knew knick:knick knif:knif knife:knife knight:knight knightly:knight knights:knight knit:knit knits:knit knitted:knit knitting:knit knives:knive knob:knob
knobs:knob knock:knock knocked:knock knocker:knocker knockers:knocker knocking:knock knocks:knock knopp:knopp knot:knot knots:knot
skies:sky dying:die hopping:hop hoping:hope happiness:happi relational:relat controlling:control generously:generous succeeding:succeed news:news cry:cri say:say""".split())


def test_stems_are_the_published_ones(spark):
    df = spark.createDataFrame([(w,) for w in [*PUBLISHED, "the", None, "7", "größe"]], "word string")
    assert {r.word: r.s for r in df.select("word", stem(F.col("word")).alias("s")).collect()} == PUBLISHED | {"the": None, None: None, "7": "7", "größe": porter2("größe")}


def scan(texts: dict, query: str) -> dict:
    """Covers by definition: shortest stretches that hold every lexeme."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    asked, out = {porter2(w) for w in split(query) if w not in STOPS}, {}
    for key, text in texts.items():
        told = [None if w in STOPS else porter2(w) for w in split(text)]
        hits, covers = [i for i, w in enumerate(told) if w in asked], []
        if not asked or not asked <= set(told):
            continue
        for b in hits:
            if (j := next((j for j in hits if j >= b and asked <= set(told[b : j + 1])), None)) is not None:
                covers.append((b, j))
        least = [c for c in covers if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in covers)]
        out[key] = sum(0.1 / (1 + (j - b) - (sum(b <= h <= j for h in hits) - 1)) for b, j in least)
    return out


def same(index, texts, queries, spark):
    df = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    got = {(r.query_id, r.key): r.rank for r in index.lookup(df).collect()}
    want = {(i, str(k)): v for i, q in enumerate(queries) for k, v in scan(texts, q).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    return len(want)


def test_lookup_is_a_scan_on_all_documents_and_fifty_queries(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    held = [w for t in texts.values() for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    rng = random.Random(2)
    queries = [" ".join(rng.choice(held) for _ in range(1 + k % 3)) for k in range(46)] + ["the of", "", None, "the thing's running things"]
    assert same(searching.document_index(spark, SF), texts, queries, spark) > 200


def test_deltas_replace_and_remove(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("alpha betas gamma delta the größe запрос 7".split()) for _ in range(rng.randrange(40)))
    texts = {f"k{i}": text() for i in range(60)} | {"none": None, "empty": ""}
    frame = lambda t: spark.createDataFrame(list(t.items()), "key string, text string").withColumn("LEXEME", F.lit(1))
    index = textindex.build(frame(texts | {None: "alpha"}).unionByName(spark.createDataFrame([(None, "alpha beta", 1)], "key string, text string, LEXEME int")), buckets=4)
    queries = ["alpha beta", "gamma delta alpha beta", "größe ЗАПРОС", "7", "absent alpha", "alpha alphas"]
    same(index, texts, queries, spark)
    for segment in (1, 2):
        changed, gone = {f"k{i}": text() for i in rng.sample(range(70), 20)}, [f"k{i}" for i in rng.sample(range(60), 8)]
        index = index.updated(segment, frame(changed), spark.createDataFrame([(g,) for g in gone if g not in changed], "key string"))
        texts = {k: v for k, v in texts.items() if k not in gone} | changed
        same(index, texts, queries, spark)
    small = index.compacted()
    same(small, texts, queries, spark)
    told = {r.lexeme: (r.texts, r.places) for r in small.lexicon().collect()}
    lists = {k: [porter2(w) for w in re.split(r"[\W_]+", (t or "").lower()) if w and w not in STOPS] for k, t in texts.items()}
    assert told == {w: (sum(w in x for x in lists.values()), sum(x.count(w) for x in lists.values())) for w in {w for x in lists.values() for w in x}}


def test_a_lookup_reads_its_buckets_only(spark):
    index = textindex.build(spark.createDataFrame([(i, f"w{i} shared") for i in range(200)], "key long, text string"))
    found = index.lookup(spark.createDataFrame([(1, "w7")], "query_id long, text string"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "CartesianProduct" not in plan


@pytest.mark.parametrize("text,want", [("Don't stop_me, Größe 7x", ["don", "t", "stop", "me", "größe", "7x"]), (None, []), ("", [])])
def test_words(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(words(F.col("t"))).first()[0] == want


def test_query_after_an_update(spark):
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    changed = dict(duckdb.sql(f"select page_id, url from '{SF}/pages.parquet' where page_id % 3 = 0").fetchall())
    texts = {k: v for k, v in docs.items() if k % 7} | changed
    want = {}
    for t in texts.values():
        for w in [porter2(w) for w in re.split(r"[\W_]+", (t or "").lower()) if w and w not in STOPS]:
            want[w] = want.get(w, 0) + 1
    assert {r.lexeme: r.places for r in catalog.QUERIES["text_index_update"](spark, SF).collect()} == want


def test_covers_by_brute_force(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice("alpha beta gamma delta the".split()) for _ in range(rng.randrange(40))) for i in range(60)} | {90: None}
    index = textindex.build(spark.createDataFrame(list(texts.items()), "key long, text string"))
    got = {int(r.key): r.rank for r in search.ranked_matches(index, "the alpha gammas").collect()}
    want = scan(texts, "alpha gamma")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)
    assert search.ranked_matches(index, "the of").count() == 0


@pytest.mark.parametrize("query,text,want", [("größe запрос", "Запрос zur Größe", 0.5 + 0.5 * 2 / 3), ("日本 語学", "日本の語学", 0.0), ("日本 語学", "日本 語学", 1.0), ("a é", "a é", 0.0), ("the_that x1", "X1, the_that!", 1.0)])
def test_rerank_score_reads_any_script(spark, query, text, want):
    from cardloom.operators.retrieval import rerank_score

    assert abs(spark.createDataFrame([(query, text)], "q string, t string").select(rerank_score(F.col("q"), F.col("t"))).first()[0] - want) < 1e-5


def test_every_text_has_token_counts(spark):
    """Texts without a word have a row too, and words count by their stems."""
    texts = [("a", "Runs running the walked walks"), ("b", ""), ("c", None), ("d", "the of ..."), ("e", "größe Größe flies")]
    got = {r.key: tuple(r)[1:] for r in textindex.token_counts(spark.createDataFrame(texts, "key string, text string")).collect()}
    assert got == {"a": (4, 4, 4, 3), "b": (0, 0, 0, 0), "c": (0, 0, 0, 0), "d": (0, 0, 0, 0), "e": (3, 2, 5, 3)}


def test_postings_are_made_once_and_dealt_once(spark, tmp_path):
    """A sample for ranges made them twice, and a join with the stems shuffled them once more."""
    texts = spark.createDataFrame([(i, "the running hops of a text " + "hopping " * (i % 3)) for i in range(30)], "key long, text string")
    plan = textindex.tokens(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    held = textindex.tokens(texts).mapInArrow(count, "lexeme string, key string, positions array<int>")
    index = textindex.TextIndex(spark, str(tmp_path / "index"))
    index._write(held, 0)
    rows = index._postings().select("lexeme", "key", "positions").collect()
    assert seen.value == len(rows) == 30 * 3 + 20 and {r.lexeme for r in rows} == {"run", "hop", "text"}
    assert {tuple(r.positions) for r in rows if r.key == "2" and r.lexeme == "hop"} == {(2,), (6, 7)}
