"""Prefix tries, vector codes and vantage-point trees against plain Python: given tables, edge cases, hot groups."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.llm import codebooks, queries, trie, vptree
from compare import SF

TURNS = "conv_id long, turn long, role string, text string, Depth int, place string, a string, block int, PATH string, n_bytes int"
VECTORS = "vec_id long, embedding array<double>, label int, Codes string, vector string, ERROR int, label_error string, summed_label int, row int, cell int, id int"


def brute_trie(rows, graft=True):
    told, nodes, ends, kids, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(set), defaultdict(list), {}, {}
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append((turn, role or "", text or ""))
    for c, turns in told.items():
        turns.sort(key=lambda k: (k[0] is not None, k[0] or 0, hashlib.sha256(f"{len(k[1])}:{k[1]}{k[2]}".encode()).digest()))
        told[c] = [t[1:] for t in turns]
    for c, turns in told.items():
        h = zlib.crc32(str(c).encode()) % 9 if graft else 0
        whole = tuple(told.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
        ends[whole].add(c)
        for d in range(len(whole) + 1):
            nodes[whole[:d]].add(c)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    hashed = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((len(n), min(m), min(nodes[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashed(ends[n])) for n, m in nodes.items())


def trie_rows(df):
    return sorted((r.depth, r.conv_id, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def grafted(df):
    return trie.build(*trie.grafted(trie.numbered(df), F.col("conv_id") - F.col("conv_id") % 5, queries.remainder("conv_id", 9), 8))


def with_clashes(spark, rows, schema):
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([(*r, *[None] * (len(names) - len(r))) for r in rows], schema)


def test_trie_query(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    assert trie_rows(queries.op11_prefix_trie(spark, SF)) == brute_trie(rows)


def test_trie_edges(spark):
    rows = [
        (1, None, "u", "null turn"), (1, 2, None, None), (1, 2, None, None), (1, 2, "b", "tie"), (-3, 1, "u", "ü😀"), (-3, 1, "u", "tie"), (None, 1, "u", "no conversation"),
        (7, 1, "ab", "c"), (8, 1, "a", "bc"), (5, 1, "u", ""), (9, 3, "x" * 40_000, "long " * 30_000), (10, 3, "x" * 40_000, "long " * 30_000),
    ]
    assert trie_rows(grafted(with_clashes(spark, rows, TURNS))) == brute_trie(rows)
    assert grafted(with_clashes(spark, [], TURNS)).count() == 0


def test_trie_hot_and_long(spark, monkeypatch):
    """Copies, a conversation of a third of all rows over many blocks, forks of forks, an end shared by more ids than a row holds."""
    monkeypatch.setattr(trie, "BLOCK", 16)
    monkeypatch.setattr(trie, "END_IDS", 8)
    rng = random.Random(5)
    rows = [(0, t, "u", f"t{t % 5}") for t in range(700)] + [(c, t, "u", f"t{t % 5}") for c in range(1, 120) for t in range(3)]
    rows += [(1_000 + c, t, "u", f"t{t % 5}" if t < 10 + c else f"own {c}") for c in range(25) for t in range(12 + c)]
    rows += [(2_000 + c, t, rng.choice("ua"), rng.choice("xyz")) for c in range(80) for t in range(rng.randrange(1, 9))]
    df = with_clashes(spark, rng.sample(rows, len(rows)), TURNS)
    assert trie_rows(grafted(df)) == brute_trie(rows)
    plain = trie.numbered(df)
    lengths = plain.groupBy("conv_id").agg(F.count("*").alias("length"))
    assert trie_rows(trie.build(plain.join(lengths, "conv_id"), lengths)) == brute_trie(rows, graft=False)


def test_running_totals_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = [(g, p, 3 * p + g) for g in range(3) for p in range(-30, 10 * g)]
    out = trie.running(spark.createDataFrame(rows, "g long, p long, x long").withColumn("y", F.col("x")), ["g"], "p", {"x": "sum", "y": "bit_xor"}).collect()
    for r in out:
        before = [x for g, p, x in rows if g == r.g and p <= r.p]
        folded = 0
        for x in before:
            folded ^= x
        assert (r.x, r.y) == (sum(before), folded)
    assert len(out) == len(rows)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((i is None, i or 0, v, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    w = len(kept[0][3]) // parts
    cut = [[r[3][p * w : p * w + w] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda: [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(c)] for c in cut]
    for _ in range(rounds):
        got = near()
        for p in range(parts):
            members = defaultdict(list)
            for c, g in zip(cut, got):
                members[g[p][1]].append(c[p])
            for k, xs in members.items():
                books[p][k] = [sum(x) // len(xs) for x in zip(*xs)]
    errors = defaultdict(int)
    got = near()
    for r, g in zip(kept, got):
        errors[r[4]] += sum(d for d, _ in g)
    told = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((None if r[0] else r[1]), "".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g), errors[r[4]], told) for r, g in zip(kept, got)), books


def code_rows(spark, df, **kinds):
    books = codebooks.fit(df, **kinds)
    out = codebooks.with_label_error(codebooks.encode(df, books)).collect()
    return sorted(((r.vec_id), "".join(f"{c:02x}" for c in r.codes), r.error, r.label_error, books.sha256()) for r in out)


def test_codes_query(spark):
    rows = duckdb.sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet'").fetchall()
    got = sorted(tuple(r) for r in queries.op12_vector_codes(spark, SF).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == brute_codes(rows)[0]


def test_codes_edges(spark):
    """Dropped rows, ties between equal entries, repeated ids and rows, negative means that round down, a hot label, nulls together, few rows, none."""
    rng = random.Random(3)
    rows = [(i % 150, [rng.choice([-0.5, -0.013, 0.0, 0.3, 1.0]) for _ in range(32)], None if i % 3 == 0 else i % 4) for i in range(300)]
    rows += [(500 + i, [0.25] * 32, 1) for i in range(200)] + [(7, [0.25] * 32, 1)] * 3
    bad = [(900, None, 1), (901, [math.nan] * 32, 1), (902, [math.inf] + [0.0] * 31, None), (903, [None] + [0.0] * 31, 2), (904, [], 1), (905, [0.5] * 16, 1), (906, [0.5] * 17, 1)]
    df = with_clashes(spark, rows + bad, VECTORS)
    want, books = brute_codes(rows)
    assert code_rows(spark, df) == want
    assert code_rows(spark, with_clashes(spark, rows[:5], VECTORS)) == brute_codes(rows[:5])[0]
    assert code_rows(spark, with_clashes(spark, bad[:5], VECTORS)) == [] == code_rows(spark, with_clashes(spark, [], VECTORS))
    fitted = codebooks.fit(df)
    for r in codebooks.decode(codebooks.encode(df, fitted), fitted).limit(50).collect():
        assert r.decoded == [x for p, c in enumerate(r.codes) for x in books[p][c]]
    with pytest.raises(Exception, match="exactly"):
        codebooks.fit(with_clashes(spark, [(1, [1e9] * 32, 0)], VECTORS))


def brute_neighbours(rows, chosen, k=5):
    kept = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in kept]), np.stack([v for _, v in kept])
    x = x / np.abs(x).max(1, keepdims=True)
    norms, out = np.sqrt((x * x).sum(1)), []
    for q in range(len(ids)):
        if chosen(ids[q]):
            score = (x * x[q]).sum(1) / (norms * norms[q])
            best = [j for j in np.lexsort((ids, -score)) if j != q][:k]
            out += [(int(ids[q]), rank + 1, int(ids[j]), round(float(score[j]), 12)) for rank, j in enumerate(best)]
    return sorted(out)


def neighbour_rows(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 12)) for r in df.collect())


def test_neighbours_query(spark):
    """The registered query, whose pruning is relaxed, against all pairs; with factor one the rows are the same."""
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    want = brute_neighbours(rows, lambda i: i % 50 == 0)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in queries.op13_vp_tree(spark, SF).collect())
    pairs = lambda rows: {(r[0], r[2]) for r in rows}
    assert len(got) == len(want) and len(pairs(got) & pairs(want)) >= 0.9 * len(want)
    index = vptree.build(spark.read.parquet(f"{SF}/embeddings.parquet"), shard_rows=60)
    assert len(index.pivots) > 4 and index.trees.count() == index.parts.sum()
    assert neighbour_rows(vptree.search(index, F.col("id") % 50 == 0, factor=1)) == want


def test_neighbours_on_clusters_hot_vectors_and_edges(spark):
    """Exact search where cells and trees are pruned, a third of all rows equal, ties, repeated ids, opposite, huge and tiny vectors."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.05).tolist()) for i in range(900)] + [(2_000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 3.0]) for i in range(450)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (50, [1e200] + [1e199] * 7), (100, [1e-200] + [1e-199] * 7), (150, [-1.0, -2.0, 0.0, 0.0, 0.0, 0.0, 0.0, -3.0])]
    bad = [(200, None), (250, [0.0] * 8), (300, [math.nan] * 8), (350, [None] * 8), (400, [math.inf] * 8), (450, []), (500, [1.0] * 7), (None, [1.0] * 8)]
    taken = [r for r in rows if r[0] not in {b[0] for b in bad}]
    index = vptree.build(with_clashes(spark, [(i, v) for i, v in taken + bad], VECTORS), shard_rows=100)
    got = neighbour_rows(vptree.search(index, F.col("id") % 50 == 0, factor=1))
    assert got == brute_neighbours(taken, lambda i: i % 50 == 0)
    few = vptree.build(with_clashes(spark, taken[:3] + bad, VECTORS))
    assert neighbour_rows(vptree.search(few, F.col("id") >= 0, factor=1)) == brute_neighbours(taken[:3], lambda i: True)
    for rows in ([], bad[:6], taken[:1]):
        assert vptree.search(vptree.build(with_clashes(spark, rows, VECTORS)), F.lit(True)).count() == 0


def test_tree_leaves_out_branches():
    """On clustered rows the search opens a fraction of the leaves and still finds all."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 6))
    x = np.concatenate([c + rng.normal(size=(100, 6)) * 0.02 for c in centres])
    tree, scanned = vptree.Tree(x, np.arange(4_000), np.arange(4_000), leaf=32), []
    scan = vptree.Tree._scan
    tree._scan = lambda start, stop, asked: (scanned.append(len(asked) * (stop - start)), scan(tree, start, stop, asked))
    query, found, score = tree.search(x[::100], np.arange(0, 4_000, 100), 5, 1.0, np.full(40, np.inf))
    like = vptree.unit(x[::100]) @ vptree.unit(x).T
    like[np.arange(40), np.arange(0, 4_000, 100)] = -2
    assert sum(scanned) < 0.2 * 40 * 4_000
    assert all(set(found[query == q]) == set(np.argsort(-like[q])[:5]) for q in range(40))
