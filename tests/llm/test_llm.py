"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and empty tables."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from cardloom.llm import bpe, components, decontam, licenses, lm, omh, prefix, quality, queries, simhash, toxicity, urlfilter, warc
from compare import SF, connect, rows

DOCS = "doc_id long, text string, label string"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
EDGE = [(1, None, "a"), (2, "", "b"), (3, "One two  three four five six seven eight", "c"), (3, "One two  three four five six seven eight", "c"), (None, "ünï 😀 \n\n x", None)]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_duckdb(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(connect().execute(queries.ORACLE[name]).df())


def test_warc_revisits_nulls_and_pushdown(spark, tmp_path):
    pages = spark.createDataFrame([(5, "http://a/\r\nx", "same"), (2, None, "same"), (7, "http://b/", None), (9, "http://c/", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    assert [got[k].record_type for k in (2, 5, 7, 9)] == ["response", "revisit", "response", "revisit"]
    assert got[5].refers_to == 2 and got[5].payload_bytes == 4 and got[9].payload_bytes == 0
    assert got[5].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    for compress in (True, False):
        path = str(tmp_path / str(compress))
        warc.write_pages(pages, path, compress=compress)
        only = warc.read_warc(spark, path).filter("record_type = 'response' and target_uri like 'http://b%'")
        assert [bytes(r.payload) for r in only.collect()] == [b""]
    assert warc.archive_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(32768, 1024), (40, 12), (20, 3)])
def test_bpe_equals_whole_text_encoding(spark, docs, chunk, overlap):
    texts = [*EDGE, (6, "a  b\n\n\n c'll  don't " * 9 + "x" * 90, "long"), (7, " " * 100, "blank")]
    df = spark.createDataFrame(texts, DOCS)
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN, chunk_chars=chunk, overlap_chars=overlap), PATH).collect()
    assert len(out) == len(texts)
    whole = bpe.encoder(PATH, public_tokenizers.PATTERN)
    for r in out:
        assert r.ids == whole.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_quality_finds_junk(spark):
    good = [(i, f"The plain words number {i} of this text are not odd. They say little but read well enough, and so on.", "") for i in range(60)]
    junk = [(100 + i, "x%%% " * (20 + i), "") for i in range(10)] + [(200 + i, "Go " * (80 + i), "") for i in range(10)]
    df = spark.createDataFrame(good + junk + [(300, None, "")], DOCS)
    kept = {r.doc_id: r.keep for r in quality.score(df, quality.fit(df)).collect()}
    assert all(kept[i] == 1 for i, _, _ in good) and not any(kept[i] for i, _, _ in junk) and kept[300] == 0
    assert quality.score(df.limit(0), quality.fit(df.limit(0))).count() == 0


def test_order_minhash(spark):
    words = " ".join(f"w{i}" for i in range(300))
    rolled = " ".join(f"w{(i + 150) % 300}" for i in range(300))
    df = spark.createDataFrame([(1, words), (2, words), (3, rolled), (4, "b b b b b b"), (5, None), (6, "a b")], "doc_id long, text string")
    sig = {r.doc_id: r.fingerprint for r in omh.fingerprint(df).collect()}
    same = lambda a, b: np.mean([x == y for x, y in zip(sig[a], sig[b])])
    assert sig[1] == sig[2] and 0.2 < same(1, 3) < 0.8 and sig[5] == [] and len(sig[6]) == 64 == len(sig[4])
    out = {r.doc_id: r for r in omh.edited_likeness(df).collect()}
    text = {1: words, 2: words, 3: rolled, 4: "b b b b b b", 5: "", 6: "a b"}
    for i, after in ((6, 5), (5, 4), (4, 3), (3, 2), (2, 1), (1, 6)):
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + text[after][:half]
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[i].n_chars == len(text[i])
    assert out[2].near_next == 1.0 and all(len(r.fingerprint) in (0, 512) for r in out.values())


def test_license_scan_places_and_blocks(spark, docs):
    text = "x " * 37 + "Licensed under CC BY-NC 4.0. " + "y " * 50 + "ALL rights reserved, licensed under the apache license version 2.0"
    df = docs.unionByName(spark.createDataFrame([(9, text, "n")], DOCS))
    out = licenses.scan(df).collect()
    assert len(out) == 6 and "label" in out[0].asDict()
    r = next(r for r in out if r.doc_id == 9)
    words = re.findall(r"[a-z0-9]+", text.lower())
    at = lambda *w: [i for i in range(len(words)) if words[i : i + len(w)] == list(w)]
    assert {p.label: p.starts for p in r.places} == {"cc-by": at("cc", "by"), "gpl": [], "reserved": at("all", "rights", "reserved")}
    assert {m.label for m in r.matches} == {"cc-by-nc", "apache-2.0"}


def test_url_rules(spark):
    urls = ["http://X.example.NET/en/1", "http://example.net/EN/", "http://net", "http://a.net/", "ftp://q.org/fr/x?y", None, "no scheme", "http://ads1.z.com/", "http://z.com/Login?x"]
    got = [(r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), ("net/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "block")]


def test_simhash_covering_misses_no_pair(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for n in range(1, 6):
            fps.add(int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(s, s, s) for s in signed], "fp long, id long, class long")
    got = {(r.x, r.y) for r in simhash.near_pairs(nodes, 4).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    assert got == want


def test_near_duplicates_edges(spark, docs):
    out = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, words=4).collect()}
    assert {(d, c) for d, _, c in out} == {(1, 1), (2, 1), (3, 3), (None, None)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    line = b"one two three four"
    assert simhash.fingerprint("One TWO three four", 4) == xxhash.xxh64_intdigest(line, 42)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 30)] + [(5, 40), (40, 41), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    assert got == {**{i: 10 for i in range(10, 31)}, 5: 5, 40: 5, 41: 5}


def test_similar_documents(spark):
    words = [f"w{i}" for i in range(400)]
    copy = [*words[:200], "changed", *words[201:]]
    other = [f"v{i}" for i in range(400)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(other)), (4, " ".join(words).upper()), (5, None), (6, "")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5}
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {1, 3, 5}


def test_similar_documents_miss_no_pair(spark):
    rng = np.random.default_rng(5)
    texts, fresh_word = [], iter(range(10**6))
    for base in range(12):
        n = int(rng.integers(60, 300))
        text = [f"w{k}" for k in rng.integers(0, 2000, n)]
        texts.append(text)
        for edits in (0.005, 0.015, 0.02, 0.025, 0.03):  # scattered words
            texts.append([f"e{next(fresh_word)}" if rng.random() < edits else w for w in text])
        for part in (0.1, 0.2, 0.24, 0.26):  # an appended passage, a replaced block
            passage = [f"e{next(fresh_word)}" for _ in range(int(n * part))]
            texts.append([*text, *passage])
            texts.append([*passage[: len(passage) // 2], *text[len(passage) // 2 :]])
        texts.append(text * 2)
    texts += [["one", "two", *[f"s{k}"]] for k in range(3)] + [["a", "b"] * k for k in (5, 6, 9)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    pairs = [(x, y) for x in range(len(texts)) for y in range(x) if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) - 1e-9]
    for x, y in pairs:
        a, b = sorted((find(x), find(y)))
        root[b] = a
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == {i: find(i) for i in range(len(texts))}
    # the prefix keys alone meet every pair
    keys = prefix.prefix_keys(df.toDF("id", "text"), simhash.shingles, 5, 0.8).withColumn("class", F.col("id"))
    assert set(pairs) <= {(r.y, r.x) for r in prefix.all_pairs(keys, 0.8).collect()}


def test_rows_without_an_id_of_their_own_are_compared(spark):
    """Rows without an id, and rows of one id with different texts, are documents: copies among them go, others stay."""
    word = lambda p, n=60: " ".join(f"{p}{i}" for i in range(n))
    a, b, c, d, e = (word(p) for p in "abcde")
    rows = [(7, a, 0), (None, a.upper(), 1), (None, b, 2), (None, b + " more", 3), (5, c, 4), (5, a, 5), (5, a, 6), (9, c, 7), (3, d, 8), (3, e, 9), (2, d, 10), (8, e + " more", 11), (None, word("f"), 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    kept = sorted(r.row for r in simhash.keep_one(df).collect())
    assert [k for k in kept if k not in (2, 3)] == [4, 5, 6, 9, 10, 12] and len({2, 3} & set(kept)) == 1


def test_sketches_lose_no_pair_and_drop_unlike_ones(spark):
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 2**63, int(n)).astype(np.uint64)) for n in rng.integers(1, 200, 200)]
    changed = [np.unique(np.concatenate([h[: int(len(h) * rng.random())], rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64), h[-1:]])) for h in sets]
    bits = lambda h: np.unpackbits(prefix.sketch(h).view(np.uint8))
    assert all((bits(x) != bits(y)).sum() <= len(np.setxor1d(x, y)) for x, y in zip(sets, changed))
    # near copies of one text, each with two words of its own: 86 of 96 shingles are the group's, yet two members are hardly alike to 0.7
    base = [f"w{i}" for i in range(100)]
    members = [[f"v{i}" if k in (5 + i, 50 + i * 7 % 40) else w for k, w in enumerate(base)] for i in range(40)]
    keys = prefix.prefix_keys(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(members)], "id long, text string"), simhash.shingles, 5, 0.8).withColumn("class", F.col("id"))
    own = [{tuple(t[k : k + 5]) for k in range(96)} for t in members]
    alike = {(x, y) for y in range(40) for x in range(y) if len(own[x] & own[y]) >= 0.8 * len(own[x] | own[y])}
    met = {(r.x, r.y) for r in prefix.all_pairs(keys, 0.8).collect()}
    assert alike <= met and len(met) < len(alike) + 40


def test_plans_are_described_in_full_again(spark):
    own = spark.conf.get("spark.sql.maxPlanStringLength")
    assert simhash.keep_one(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count() == 1
    assert spark.conf.get("spark.sql.maxPlanStringLength") == own


def test_toxicity_learns(spark):
    rows_ = [(i, f"some words {i * 7919 % 1000} here {'you idiot' if i % 4 == 0 else 'you friend'} and more", "", int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows_, DOCS + ", toxic int")
    model = toxicity.fit(df)
    new = spark.createDataFrame([(1, "what an IDIOT", ""), (2, "a friend", ""), (3, None, "")], DOCS)
    score = {r.doc_id: r.toxicity for r in toxicity.score(new, model).collect()}
    assert score[1] > 0.3 > score[2] and 0 <= score[3] <= 1
    assert toxicity.score(new, toxicity.fit(df.limit(0))).count() == 3


@pytest.mark.parametrize("head", [1 << 19, 1])
def test_language_model_base_and_filter(spark, docs, head):
    fitted = lm.fit(docs, max_head=head)
    got = [r for r in lm.score(docs, fitted).collect()]
    counts = {}
    for _, text, _ in EDGE:
        for w in [*(text or "").encode().lower().split(), "end"]:
            counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*(t or "").encode().lower().split(), "end"]) for _, t, _ in EDGE)
    assert np.allclose(sorted(r.base_score for r in got), want) and all(r.train_tokens == total and r.n_known == r.n_tokens and r.score <= 0 for r in got)


@pytest.mark.parametrize("max_bits,slices", [(29, 1), (13, 8)])
def test_language_model_score_at_any_size(spark, max_bits, slices):
    rng = np.random.default_rng(3)
    texts = [None, "", *(" ".join(f"w{k}" for k in rng.zipf(1.4, 60) % 4000) for _ in range(120))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    fitted = lm.fit(df, bits_per_key=64, max_bits=max_bits)
    assert fitted.model.slices >= slices
    lists = [[*(t or "").split(), "</s>"] for t in texts]
    uni = Counter(w for x in lists for w in x)
    pairs = Counter(p for x in lists for p in zip(["<s>", *x], x))
    level = lambda c: (3 * 2 ** (c.bit_length() - 1) - 1) / 2
    total, distinct = sum(uni.values()), len(uni)
    want = {}
    for i, x in enumerate(lists):
        want[i] = 0.0
        for before, w in zip(["<s>", *x], x):
            context = len(texts) if before == "<s>" else level(uni[before])
            share = min(level(pairs[before, w]), context) / context
            want[i] += np.log10(min(0.7 * share + 0.3 * (level(uni[w]) + 0.5) / (total + 0.5 * (distinct + 1)), 1.0))
    got = {r.doc_id: r.score for r in lm.score(df, fitted).collect()}
    assert np.allclose([got[i] for i in want], list(want.values()))


def test_passes_keep_one_table_at_a_time(spark):
    """A table of levels a pass, written with texts, not tokens; those of earlier passes are deleted."""
    from pathlib import Path

    from cardloom.llm.common import shared_dir

    df = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 4001}" for k in range(60))) for i in range(120)], "doc_id long, text string")
    tables = lambda label: set(Path(shared_dir(spark).removeprefix("file:")).glob(f"{label}-*"))
    old = {label: tables(label) for label in ("levels", "ngrams")}
    fitted = lm.fit(df, bits_per_key=64, max_bits=13)
    assert fitted.model.slices >= 8 and lm.score(df, fitted).count() == 120
    assert len(tables("levels") - old["levels"]) == 1 and tables("ngrams") <= old["ngrams"]


def test_decontamination(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    swapped = item.replace("zeta", "ZZ").replace("xi", "QQ")
    df = docs.unionByName(spark.createDataFrame([(10, "before " + swapped + " after", ""), (11, " ".join(item.split()[:10]), ""), (12, item.upper(), "")], DOCS))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    for size in (250_000, 0):
        got = {r.doc_id: r for r in decontam.find_contamination(df, bench, broadcast_tokens=size).collect()}
        assert {k for k, r in got.items() if r.contaminated} == {10, 12} and got[10].items == [1] and abs(got[10].overlap - 0.9) < 1e-9


def test_decontamination_of_a_trimmed_item_between_rows(spark):
    words = [f"q{i}" for i in range(38)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [(1, "some other words come before"), (2, " ".join(words[1:-1])), (3, "and others after it"), (4, None), (5, " ".join(words[4:-3])), (6, " ".join(words[:20])), (7, " ".join(words[20:]))]
    one = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    for df, most in ((one, 250_000), (one.repartition(7, "doc_id"), 250_000), (one, 0)):
        got = {r.doc_id: r for r in decontam.find_contamination(df, bench, broadcast_tokens=most).collect()}
        assert {k: (r.items, round(r.overlap, 4)) for k, r in got.items() if r.contaminated} == {2: ([1], round(36 / 38, 4)), 5: ([1], round(31 / 38, 4))}
