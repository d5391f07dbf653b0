"""The queries' own columns, and the pipeline, against plain Python on whole small tables."""

import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import xxhash

import corpus_pipeline
from cardloom.llm import bpe, queries
from compare import SF

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_byte_bpe_query(spark):
    whole = bpe.encoder(PATH, public_tokenizers.PATTERN)
    want = {i: (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in documents() for ids in [whole.encode_ordinary(t or "")]}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_byte_bpe(spark, SF).collect()} == want


def test_simhash_query(spark):
    prints = {}
    for i, t in documents():
        words = (t or "").encode().lower().split()
        runs = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = np.array([xxhash.xxh64_intdigest(r, 42) for r in runs], np.uint64)
        prints[i] = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(runs))
    root = {i: i for i in prints}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, SF).collect()} == {i: (f"{f:016x}", find(i)) for i, f in prints.items()}


def held_items(texts: list[str], items: dict[int, str]) -> list[list[int]]:
    """By text the items of which at least 0.8 (and five words) stand at their places, at any alignment."""
    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    told = {k: np.array([hash(w) for w in split(t)]) for k, t in items.items()}
    out = []
    for text in texts:
        own, found = np.array([hash(w) for w in split(text)]), []
        for k, item in told.items():
            n = len(item)
            if n < 5 or not np.isin(item, own).mean() >= 0.8:
                continue
            best = max((int((own[max(s, 0) : s + n] == item[max(-s, 0) : len(own) - s]).sum()) for s in range(1 - n, len(own))), default=0)
            if best >= 0.8 * n:
                found.append(k)
        out.append(sorted(found))
    return out


def test_decontamination_query(spark):
    docs = documents()
    items = dict(duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall())
    want = dict(zip((i for i, _ in docs), held_items([t or "" for _, t in docs], items)))
    got = {r.doc_id: [int(x) for x in r["items"].split(",") if x] for r in queries.op10_decontaminate(spark, SF).collect()}
    assert got == want and any(want.values())


def plant(folder):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abdeghilmnorstu"), int(rng.integers(3, 8))))
    words = [word() for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    docs, toxic = {}, {}
    for i in range(240):
        docs[i], toxic[i] = " ".join(prose(14) for _ in range(6)), 0
    for i in range(240, 320):
        docs[i], toxic[i] = " ".join(prose(10) for _ in range(5)) + " You stupid idiot, shut up. " + prose(12), 1
    junk = {400 + i: "x%%% #### " * (30 + i) for i in range(12)} | {420 + i: "GO NOW " * (60 + i) for i in range(12)}
    items = {k: " ".join(rng.choice(words, 30)) for k in range(5)}
    copies = {500: docs[3], 501: docs[4] + " One more line here.", 502: docs[5].replace(".", ";", 1)}
    leaks = {600 + k: prose(20) + " " + t + " " + prose(15) for k, t in items.items()}
    every = docs | junk | copies | leaks | {700: None, 701: ""}
    pd.DataFrame({"doc_id": list(every), "text": list(every.values()), "lang": "en", "source": "s", "n_chars": [len(t or "") for t in every.values()]}).to_parquet(f"{folder}/documents.parquet")
    pd.DataFrame({"doc_id": list(toxic), "quality": 1, "toxic": list(toxic.values())}).to_parquet(f"{folder}/labels.parquet")
    pd.DataFrame({"item_id": list(items), "text": list(items.values())}).to_parquet(f"{folder}/benchmark.parquet")
    return every, toxic, junk, copies, items


def test_pipeline_by_brute_force(spark, tmp_path):
    every, toxic, junk, copies, items = plant(tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    good, kind, single, clean = kept
    assert not good & (set(junk) | {700, 701}) and {i for i in toxic if not toxic[i]} <= good
    learnt = [i for i in good if i in toxic]
    assert np.mean([(i in kind) == (not toxic[i]) for i in learnt]) > 0.97 and all(i in kind for i in learnt if not toxic[i])
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in kind for w in [every[i].lower().split()]}
    root = {i: i for i in kind}
    for a in sorted(kind):
        for b in sorted(kind):
            if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    assert single == {i for i in kind if root[i] == i} and not single & set(copies)
    order = sorted(single)
    assert clean == {i for i, found in zip(order, held_items([every[i] for i in order], items)) if not found} and not clean & set(range(600, 605))
    whole = bpe.encoder(PATH, public_tokenizers.PATTERN)
    out = {r.doc_id: (r.ids, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {i: (ids, len(ids)) for i in clean for ids in [whole.encode_ordinary(every[i])]}
