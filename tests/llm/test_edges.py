"""Each operator on nulls, empty and very long texts, ties, repeats, an empty table and clashing columns; larger inputs against brute force."""

import gzip
import io
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cardloom.llm import bpe, common, decontam, licenses, lm, omh, quality, simhash, toxicity, urlfilter, warc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
CLASH = (
    "IDS", "Decoded", "rest", "ROW", "found", "hits", "tokens", "h", "key", "words", "text_key", "row_hash", "Score", "Toxicity", "quality_stats", "quality_text",
    "quality_features", "QUALITY", "N_words", "n_tokens", "judged_url", "judgement", "contamination_hits", "fp", "id", "component_id", "fingerprint", "sig", "url", "gone_id",
    "host", "places", "label", "share", "block", "levels_of_text", "tokens_of_text", "n", "overlap",
)
LONG = "some words of a very long text number " + " ".join(f"w{i * i % 977}" for i in range(30_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "One two  three four five six seven eight"), (4, "One two  three four five six seven eight"), (None, "ünï 😀 x"), (6, LONG), (7, LONG)]
BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (None, "some other item of enough words"), (1, "a repeated id of the same benchmark table")]
TOXIC = [(i, f"you {'fool' if i % 2 else 'friend'} number {i}", i % 2) for i in range(40)]


def models(spark):
    labelled = spark.createDataFrame(TOXIC, "doc_id long, text string, toxic int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    coded = lambda df: bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    return {
        "bpe": (coded, {"ids", "decoded"}),
        "quality": (lambda df: quality.score(df, quality.fit(df)), {"quality", "keep"}),
        "omh": (omh.fingerprint, {"fingerprint"}),
        "licenses": (licenses.scan, {"n_words", "places", "matches"}),
        "urls": (lambda df: urlfilter.judge(df, "text"), {"host", "path", "rule", "verdict"}),
        "toxicity": (lambda df: toxicity.score(df, toxicity.fit(labelled)), {"toxicity"}),
        "lm": (lambda df: lm.score(df, lm.fit(df)), {"n_tokens", "n_known", "train_tokens", "base_score", "score"}),
        "lm slices": (lambda df: lm.score(df, lm.fit(df, max_bits=13, max_head=1)), {"n_tokens", "n_known", "train_tokens", "base_score", "score"}),
        "decontam": (lambda df: decontam.find_contamination(df, bench), {"contaminated", "n_items", "items", "overlap"}),
        "decontam join": (lambda df: decontam.find_contamination(df, bench, broadcast_tokens=0), {"contaminated", "n_items", "items", "overlap"}),
        "keep one": (simhash.keep_one, set()),
    }


@pytest.mark.parametrize("name", ["bpe", "quality", "omh", "licenses", "urls", "toxicity", "lm", "lm slices", "decontam", "decontam join", "keep one"])
def test_rows_and_clashing_columns_survive(spark, name):
    operator, outputs = models(spark)[name]
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").select("*", *(F.lit(c).alias(c) for c in CLASH))
    out = operator(df)
    rows = out.collect()
    kept = [c for c in CLASH if c.lower() not in outputs]
    assert all(r[c] == c for r in rows for c in kept) and outputs <= set(out.columns)
    if name == "keep one":  # empty ones are one text, as are the long ones; repeated rows and null ids stay
        assert sorted((r.doc_id for r in rows), key=str) == [1, 4, 4, 6, None]
    else:
        assert len(rows) == len(TEXTS)
        said = lambda r: tuple(r[o] for o in sorted(outputs))
        same = [r for r in rows if r.doc_id == 4]
        assert len(same) == 2 and said(same[0]) == said(same[1]) and not any(v is None for r in rows for o, v in r.asDict().items() if o in outputs - {"rule"})
    assert operator(df.limit(0)).count() == 0


@pytest.mark.parametrize("words", [1, 5])
def test_groups_of_edge_texts(spark, words):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("FP", F.lit("x"))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df, words=words).collect())
    assert len(got) == len(TEXTS) and {c for d, c in got if d in "123"} == {"1"} and ("7", "6") in got and got.count(("4", "4")) == 2
    assert len(omh.edited_likeness(df.filter("doc_id <> 4")).collect()) == 5


def test_fits_depend_on_rows_alone(spark):
    rows = spark.range(3000).select((F.col("id") % 2500).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2500).cast("string")).alias("text"))
    some = lambda df: sorted(r.doc_id for r in common.smallest_by_hash(df, 300).collect())
    first = some(rows)
    assert len(first) == len(set(first)) == 300 and first == some(rows.repartition(7, "text")) == some(rows.coalesce(1))
    assert len(some(rows.filter("doc_id < 100"))) == 100 and len(common.smallest_by_hash(rows.withColumns({"doc_id": F.lit(1), "text": F.lit("x")}), 5).collect()) == 1
    labelled = spark.createDataFrame(TOXIC, "doc_id long, text string, toxic int")
    a, b = toxicity.fit(labelled, max_rows=20), toxicity.fit(labelled.repartition(5, "text"), max_rows=20)
    assert np.allclose(a.weights, b.weights) and abs(a.bias - b.bias) < 1e-9
    q = [quality.score(rows.limit(50), quality.fit(x, max_rows=40)).agg(F.sum("quality")).first()[0] for x in (rows, rows.repartition(5, "text"))]
    assert abs(q[0] - q[1]) < 1e-6


def test_accuracies_by_brute_force():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.7
    kind = rng.integers(0, 3, 4000)
    vote = np.stack([np.where(rng.random(4000) < 0.3, -1, np.where(good | (kind != j), rng.random(4000) < 0.95, rng.random(4000) < 0.1)) for j in range(3)], axis=1).astype(int)
    patterns, counts = np.unique(vote, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts)
    # the same, text by text
    junk = vote == 0
    p = np.concatenate([~junk.any(axis=1, keepdims=True), junk / np.maximum(junk.sum(axis=1, keepdims=True), 1)], axis=1) * 0.9 + 0.1 / 4
    for _ in range(100):
        prior = (p.sum(axis=0) + 1) / (p.sum() + 4)
        table = np.array([[[0.5 + p[vote[:, j] == v, c].sum() for v in (0, 1)] for j in range(3)] for c in range(4)])
        table /= table.sum(axis=2, keepdims=True)
        p = np.array([[prior[c] * np.prod([table[c, j, v] for j, v in enumerate(row) if v >= 0]) for c in range(4)] for row in vote.tolist()])
        p /= p.sum(axis=1, keepdims=True)
    assert np.allclose(model.prior, prior) and np.allclose(model.table, table) and abs(model.prior[0] - good.mean()) < 0.1
    found = model.posterior(patterns)
    told = {tuple(x): y for x, y in zip(patterns.tolist(), found)}
    assert np.mean([(told[tuple(v)] > 0.5) == g for v, g in zip(vote.tolist(), good)]) > 0.8
    assert (model.accuracies() > 0.5).all()


def words_at(rng, n, vocabulary=60):
    return [f"t{int(k)}" for k in rng.zipf(1.3, n) % vocabulary]


def test_licences_of_a_large_library_by_brute_force(spark):
    rng = np.random.default_rng(4)
    templates = [licenses.Template(f"n{i}", tuple(words_at(rng, int(rng.integers(2, 12)), 400)), threshold=float(rng.choice([0.5, 0.8, 1.0]))) for i in range(300)]
    phrases = [licenses.Template(f"p{i}", tuple(words_at(rng, int(rng.integers(1, 4)), 400)), exact=True) for i in range(40)]
    texts = [(i, " ".join(words_at(rng, int(rng.integers(0, 120)), 400))) for i in range(60)] + [(90, " - ".join(templates[7].words)), (91, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df, phrases=tuple(phrases), notices=tuple(templates)).collect()}
    step = max(len(t.words) for t in (*templates, *phrases))
    for i, text in texts:
        w = (text or "").replace(" - ", " ").split()
        want = {(t.label, b, round(len(s & set(w[b : b + 2 * step])) / len(s), 9)) for t in templates for s in [set(t.words)] for b in range(0, len(w), step) if len(s & set(w[b : b + 2 * step])) >= t.needed}
        assert {(m.label, m.start, round(m.share, 9)) for m in got[i].matches} == want and got[i].n_words == len(w)
        assert {p.label: p.starts for p in got[i].places} == {p.label: [k for k in range(len(w)) if tuple(w[k : k + len(p.words)]) == p.words] for p in phrases}


def test_thousands_of_url_rules_by_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "1", "x", "yz"])
    sign = lambda: rng.choice("/.-_?&=")
    rules = [urlfilter.Rule.wildcard(rng.choice(["||", "", ""]) + "".join(rng.choice([word(), sign(), sign() + word() + sign(), "*", "^"]) for _ in range(rng.randint(1, 6))), rng.choice(["allow", "block"])) for _ in range(1200)]
    rules = list({r.name: r for r in rules}.values())
    places = [urlfilter.Rule.place(f"{word()}.{word()}", rng.choice(["", "/", f"/{word()}"]), "block") for _ in range(60)]
    urls = [f"http://{word()}.{word()}.{word()}/" + "".join(word() + sign() for _ in range(rng.randint(0, 6))) for _ in range(60)] + [None, "x", "http://", "://A.b/C"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (50_000, 10):
        monkeypatch.setattr(urlfilter, "BROADCAST_RULES", most)
        got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df, places=tuple(places), patterns=tuple(rules)).collect()}
        fit = {r: re.compile(r.pattern) for r in (*rules, *places)}
        for i, u in enumerate(urls):
            m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
            host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
            rest = u[m.end(1):].lower() if m else ""
            some = lambda own, subject: min(((-len(r.name), r.name, r.verdict) for r in own if (host or rest) and fit[r].search(subject)), default=None)  # noqa: E731, B023
            a, b = some(places, host + path), some(rules, host + rest)
            assert got[i] == (a and a[1], (a or b or (0, 0, "allow"))[2]), u


def test_records_are_stepped_over_without_inflating(spark):
    big = {"record_id": "urn:a", "record_type": "resource", "target_uri": "http://big/", "payload_digest": None, "refers_to": None, "payload_bytes": None, "payload": random.Random(1).randbytes(400_000)}
    small = {**big, "target_uri": "http://small/", "payload": b"tiny"}
    data = b"".join(warc.member(warc.record(r, "1970-01-01T00:00:00Z")) for r in [big] * 20 + [small] + [big] * 3)
    assert gzip.decompress(data).count(b"WARC/1.1") == 24
    f, seen = warc.Inflated(io.BufferedReader(io.BytesIO(data))), []
    while (headers := warc.read_headers(f)) is not None:
        seen.append(headers["warc-target-uri"])
        f.skip(int(headers["content-length"]) + 4)
    assert len(seen) == 24 and f.inflated < 24 * 2_100
    whole = warc.Inflated(io.BufferedReader(io.BytesIO(gzip.compress(gzip.decompress(data)))))  # one member, no lengths
    while (headers := warc.read_headers(whole)) is not None:
        whole.skip(int(headers["content-length"]) + 4)
    assert whole.inflated > 23 * 400_000


def test_foreign_archives(spark, tmp_path):
    records = [warc.record({"record_id": f"urn:{i}", "record_type": "response", "target_uri": f"http://{i}/", "payload_digest": None, "refers_to": None, "payload_bytes": None, "payload": b"p" * i}, "1970-01-01T00:00:00Z") for i in range(9)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records[:3])))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records[3:6])))
    (tmp_path / "c.warc").write_bytes(b"".join(records[6:]))
    got = warc.read_warc(spark, str(tmp_path)).filter("target_uri <> 'http://4/'").collect()
    assert {(r.record_id, len(r.payload), r.digest_ok) for r in got} == {(f"urn:{i}", i, True) for i in range(9) if i != 4}


def edits_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_signature(words, hashes, k=3, slots=64, per_slot=2):
    """Ring slots over numbered k-mers, in loops. ``hashes``: Spark's hashes of words, k-mers and tuples."""
    kmers = [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    seen, numbered = {}, []
    for p, m in enumerate(kmers):
        numbered.append((hashes[m, seen.setdefault(m, 0)], p))
        seen[m] += 1
    numbered.sort()
    out = []
    for slot in range(slots):
        point = -(2**63) + slot * 2**64 // slots
        after = [e for e in numbered if e[0] >= point] + [e for e in numbered if e[0] < point]
        out.append(tuple(s for s, _ in sorted(after[:per_slot], key=lambda e: e[1])))
    return out


def test_order_minhash_by_brute_force_and_edit_distance(spark):
    rng = np.random.default_rng(8)
    base = [[f"w{k}" for k in rng.integers(0, 60 if b % 2 else 3000, 150)] for b in range(6)]
    texts = []
    for b in base:
        for rate in (0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3):
            t = [w if rng.random() > rate else f"e{rng.integers(10**6)}" for w in b]
            texts.append((b, t))
        texts.append((b, b[75:] + b[:75]))  # the same words, moved
        texts.append((b, [f"v{k}" for k in rng.integers(0, 3000, 150)]))
    lists = [t for pair in texts for t in pair]
    need = {(tuple(t[i : i + 3]), n) for t in lists for i in range(len(t) - 2) for n in range(4)}
    table = spark.createDataFrame([(list(m), n) for m, n in need], "m array<string>, n int")
    h = F.xxhash64(F.xxhash64(*(F.xxhash64(F.get("m", F.lit(j))) for j in range(3))), "n")
    hashes = {(tuple(r.m), r.n): r.h for r in table.select("m", "n", h.alias("h")).collect()}
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(texts)], "i long, a string, b string")
    got = sorted(df.select("i", omh.likeness(omh.signature(F.col("a")), omh.signature(F.col("b"))).alias("like")).collect())
    distance = []
    for (i, like), (a, b) in zip(got, texts):
        x, y = plain_signature(a, hashes), plain_signature(b, hashes)
        assert abs(like - np.mean([p == q for p, q in zip(x, y)])) < 1e-9
        distance.append(edits_apart(a, b) / 150)
    rank = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(rank(distance), rank([-r.like for r in got]))[0, 1] > 0.9
    moved = [r.like for r in got[8::10]]
    assert max(moved) < 0.9  # a set of k-mers would say 0.97


def test_leaders_of_all_fingerprints_meet_in_one_join(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (4, 5))
    rows = []
    for i in range(60):
        fp = [int(b) for b in base[:, i % 5]]
        fp[i % 4] ^= 1 << int(rng.integers(0, 62))
        rows.append((i, i if i % 7 else 0, *fp))
    fps = ["fp0", "fp1", "fp2", "fp3"]
    nodes = spark.createDataFrame(rows, "id long, class long, " + ", ".join(f"{f} long" for f in fps))
    pairs = simhash.leader_pairs(nodes, fps, 3, 24)
    got = {(r.x, r.y) for r in pairs.collect()}
    apart = lambda a, b, k: bin(a[2 + k] ^ b[2 + k]).count("1")
    near = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and any(apart(a, b, k) <= 3 for k in range(4)) and sum(apart(a, b, k) for k in range(4)) <= 24}
    assert got <= near and {i for p in got for i in p} == {i for p in near for i in p}
    # a plan for each fingerprint and order had sixteen scans with Python, and the driver kept the stages of all
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 2


def test_no_side_of_the_anchors_is_broadcast(spark):
    """A few fingerprints are dozens of rows each at their anchors, which Spark doesn't foresee."""
    nodes = spark.range(500).select(F.xxhash64("id").alias("fp"), "id", F.col("id").alias("class"))
    for pairs in (simhash.near_pairs(nodes, 4), simhash.leader_pairs(nodes.withColumnRenamed("fp", "fp0"), ["fp0"], 3, 24)):
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
