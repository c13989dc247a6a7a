"""Near duplicates, leaks, vector search, mixing, archives, quality and the pipeline, against brute force."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapework.llm import ann, components, decontam, mixing, quality, queries, simhash, warc
from tapework.session import scratch

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def groups(prints, distance):
    """Smallest id reachable, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= distance:
            parent[find(a)] = find(b)
    out = {}
    for k, (i, _) in enumerate(prints):
        out.setdefault(find(k), []).append(i)
    return {i: min(v) for v in out.values() for i in v}


def naive_print(text):
    import xxhash
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").toPandas()
    prints = [(r.doc_id, naive_print(r.text)) for r in docs.itertuples()]
    want = groups(prints, 4)
    got = queries.op3_simhash(spark, MIDDLE).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == want
    assert dict(zip(got.doc_id, got.fingerprint)) == {i: f"{p:016x}" for i, p in prints}


def test_simhash_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "One"), (6, "ONE two"), (None, "x y z"), (7, "x y z"), (7, "x y z"), (8, "Ä ä"), (9, "w " * 50000)]
    docs = spark.createDataFrame([(i, t, "a", 0) for i, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = simhash.clusters(docs).toPandas()
    assert len(got) == len(rows)
    by = dict(zip(got.doc_id, got.component_id))
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[7] == 7
    assert set(got.fingerprint[got.doc_id == 2]) == {"0" * 16}
    assert all(f == f"{naive_print(t):016x}" for i, t in rows for f in got.fingerprint[got.doc_id == i])
    kept = simhash.deduplicated(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8, 9] and kept.columns == docs.columns
    named = docs.withColumn("_keep", F.lit(1)).withColumn("_Twice", F.lit(2)).withColumn("_fp", F.lit(3)).withColumn("root", F.lit(4))
    again = simhash.deduplicated(named)
    assert sorted(r.doc_id for r in again.collect()) == [1, 4, 6, 7, 8, 9] and again.columns == named.columns
    assert simhash.clusters(docs.limit(0)).count() == 0 and simhash.deduplicated(docs.limit(0)).count() == 0


def test_crowded_keys_lose_no_link(spark):
    """A dense ball, sparse noise and chains, with every key crowded: same components as all pairs."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 63))
    values = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)}
    values |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    chain = int(rng.integers(1 << 63))
    for step in range(12):
        chain ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        values.add(chain)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = groups([(v, v & ((1 << 64) - 1)) for v in signed], 4)
    for bucket in (2, 100000):
        roots = {r.node: r.root for r in components.connected(simhash.links(fps, bucket=bucket)).collect()}
        assert {v: roots.get(v, v) for v in signed} == want


def test_thresholds_follow_the_generalised_pigeonhole():
    costs = [[0, 10, 20, 40, 80, 99], [0, 1, 2, 3, 4, 5], [0, 50, 60, 70, 80, 90]]
    chosen = simhash.allot(costs, 4 - 3 + 1)
    best = min((sum(c[t + 1] for c, t in zip(costs, ts)), ts) for ts in itertools.product(range(-1, 5), repeat=3) if sum(ts) == 2)
    assert sum(c[t + 1] for c, t in zip(costs, chosen)) == best[0]
    both = np.full((64, 64), 25.0)
    np.fill_diagonal(both, 50)
    for a, b in ((0, 40), (3, 50)):
        both[a, b] = both[b, a] = 50
    parts = simhash.group_bits(both, 100, 4)
    assert sorted(sum(parts, [])) == list(range(64))
    assert any({0, 40} <= set(p) for p in parts) and any({3, 50} <= set(p) for p in parts)


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (7001, 7000), (7001, 7000), (None, 3)]
    roots = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(roots[k] == 0 for k in range(201)) and all(roots[1000 + k] == 1000 for k in range(300))
    assert roots[7000] == roots[7001] == 7000 and 5000 not in roots


# --- decontamination ---------------------------------------------------------------------------

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = ([str(x) for x in rng.integers(0, 6, rng.integers(0, 30))] for _ in range(2))
        assert decontam.common(a, b) == lcs(a, b)


def test_leaks_against_all_shingles(spark):
    """Documents that share two fifths of an item's five-word shingles, and no others."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{MIDDLE}/benchmark.parquet").toPandas()

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    of = {i: shingles(t) for i, t in zip(items.item_id, items.text)}
    want = {(d, i) for d, t in zip(docs.doc_id, docs.text) for s in [shingles(t)] for i, x in of.items() if len(s & x) >= 0.4 * len(x)}
    got = queries.op6_decontaminate(spark, MIDDLE).toPandas()
    assert set(zip(got.doc_id, got.item_id)) == want and want


def test_paraphrases_and_edges(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    word = lambda n: list(rng.choice(vocabulary, n))
    item = word(40)
    reworded = [w if k % 5 else str(rng.choice(vocabulary)) for k, w in enumerate(item)]
    half = item[:18] + word(22)
    rows = [(1, word(300) + item + word(100)), (2, word(50) + reworded + word(80)), (3, half + word(100)), (4, word(400)), (5, [])]
    docs = [(i, " ".join(w), "clash") for i, w in rows] + [(6, None, "x"), (None, " ".join(item), "x"), (1, "other text", "x"), (7, " ".join(word(9000) + item), "x"),
                                                         (8, ", ".join(x.upper() for x in item) + "!", "x")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, ""), (13, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (None, 10), (7, 10), (8, 10)}
    assert got[1, 10].lcs_share == 1.0 and abs(got[7, 10].word_at - 9000) <= 32
    clean = decontam.decontaminated(docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6] and clean.columns == docs.columns
    named = docs.withColumn("_bad", F.lit(1)).withColumn("_BAD_", F.lit(2))
    assert decontam.decontaminated(named, bench).columns == named.columns
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_marked_words_are_found(spark):
    """Verbatim items whose words stand in quotes or brackets, or before two marks, in a plain and a marked form of the item."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    word = lambda n: list(rng.choice(vocabulary, n))
    forms = ['"{}"', "({})", "[{}", "'{}", "{}!!", "{}).", "{}?\"", "({},"]
    items = [word(40) for _ in range(len(forms) + 1)]
    mixed = [forms[k % len(forms)].format(w) for k, w in enumerate(items[-1])]
    rows = [(k, word(200) + [f.format(w) for w in items[k]] + word(100)) for k, f in enumerate(forms)] + [(len(forms), word(90) + mixed + word(30)), (100, word(300))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([*items[:-1], mixed])], "item_id long, text string")
    got = decontam.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(len(items))} and all(r.lcs_share == 1.0 for r in got)
    seen, total = decontam.frequencies(docs.withColumnRenamed("text", "_text"), [items[0][0], items[4][0]])
    assert seen.tolist() == [sum(w in [x.strip(decontam._EDGES) for x in ws] for _, ws in rows) for w in (items[0][0], items[4][0])] and total == len(rows)


def test_long_items_leak_piecewise(spark):
    """Excerpts of an item of 300 words: any 32 words or more of it are a leak, few or scattered words are not."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    word = lambda n: list(rng.choice(vocabulary, n))
    item = word(300)
    parts = {1: item[100:200], 2: item[37:69], 3: item[260:], 4: item, 5: item[90:104], 6: list(rng.permutation(item[100:200])), 7: word(100)}
    docs = spark.createDataFrame([(i, " ".join(word(120) + w + word(150))) for i, w in parts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4].lcs_share == 1.0 and 100 <= 300 * got[1].lcs_share < 180


def test_benchmark_in_parts_and_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = lambda: {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).select("doc_id", "item_id").collect()}
    want = pairs()
    monkeypatch.setattr(decontam, "PART", 70)
    monkeypatch.setattr(decontam, "_WINDOWS", 7)
    assert pairs() == want and want


def test_sparse_rows_against_a_matrix():
    rng = np.random.default_rng(4)
    rows = [{int(t): float(rng.random() + 0.1) for t in rng.choice(30, n, replace=False)} for n in (1, 5, 12)]
    full = np.array([[r.get(t, 0.0) for t in range(30)] for r in rows])
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    some, right, left = decontam.Sparse.of(rows), rng.random((30, 4)), rng.random((3, 4))
    assert np.allclose(some.times(right), full @ right) and np.allclose(some.back(left, 30), full.T @ left)


def test_latent_space_holds_the_leading_directions(spark):
    """The one-pass decomposition against a full one."""
    rng = np.random.default_rng(3)
    idf = np.ones(40)
    rows = [(k, sorted(rng.choice(20 if k % 2 else np.arange(20, 40), 5, replace=False).tolist())) for k in range(200)]
    sparse = spark.createDataFrame([(k, [0] * 5, t, [1] * 5) for k, t in rows], "doc_id long, p array<int>, t array<int>, n array<int>")
    dense = np.eye(40)[:2]
    a = np.zeros((200, 40))
    for k, t in rows:
        a[k, t] = 1 / math.sqrt(5)
    gram = a.T @ a + 100 * dense.T @ dense
    basis = decontam.latent(sparse, idf, decontam.Sparse.of([{0: 2.0}, {1: 0.5}]), 40).basis.astype(float)
    top = np.linalg.eigh(gram)[1][:, -4:]
    assert np.linalg.norm(basis.T @ top, axis=0) == pytest.approx(np.ones(4), abs=1e-3)


# --- vectors -----------------------------------------------------------------------------------

def exact(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            pairs = [(-float(np.dot(x, y)), i) for i, y in good if i != q and len(y) == len(x)]
            out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in pairs)[:k]]
    return out


def test_nearest_edges_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(90)]
    rows += [(100 + k, rows[0][1]) for k in range(60)] + [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8),
             (204, [float("inf")] * 8), (220, [1.0, 2.0, 3.0]), (221, [3.0, 2.0, 1.0]), (None, rows[1][1])]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    for block in (16, 1000):
        got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20, block=block, query_block=block).toPandas().sort_values(["query_id", "rank"])
        assert got.groupby("query_id").vec_id.agg(list).to_dict() == exact(rows, 20)
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_codes_bound_their_error():
    rng = np.random.default_rng(6)
    q, c = rng.normal(size=(30, 64)), rng.normal(size=(50, 64)) * rng.lognormal(size=(50, 1))
    (qc, qs, qr, qn), (cc, cs, cr, cn) = ann.codes(q), ann.codes(c)
    near = (qc.astype(float) @ cc.T.astype(float)) * qs[:, None] * cs
    assert (np.abs(near - q @ c.T) <= qn[:, None] * cr + qr[:, None] * (cn + cr) + 1e-9).all()


# --- mixing ------------------------------------------------------------------------------------

def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, list(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            free.remove(s)
        left -= sum(cap * sizes[s] for s in over)
    return target


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = mixing.mix(docs, block=16).toPandas()
    words = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    assert dict(zip(got.doc_id, got["size"])) == words
    sizes = got.groupby("source")["size"].sum().to_dict()
    target = filled(sizes)
    for s, g in got.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s]) and (g.source_size == sizes[s]).all()
        assert abs(g.taken.sum() - target[s]) <= 0.02 * target[s] + 5
    assert ((got.taken >= 0) & (got.taken <= 2 * got["size"]) & (got.taken % got["size"].clip(lower=1) == 0)).all()
    again = mixing.mix(docs.repartition(5), block=16).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(got.doc_id, got.taken))


def test_mix_edges(spark):
    rows = [(k, "w " * (1 + k % 7), "a") for k in range(40)] + [(100, "x y", None), (101, None, "b"), (102, "", "b"), (None, "a b c", "c"), (103, "p q", "c")]
    rows += [(200, "same words here", "d")] * 30
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size int, taken int")
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("source", dropna=False)["size"].sum()
    target = filled({None if isinstance(s, float) else s: int(n) for s, n in sizes.items()})
    for s, g in got.groupby("source", dropna=False):
        assert g.target.iloc[0] == pytest.approx(target[None if isinstance(s, float) else s])
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 16
    assert (got[got["size"] == 0].taken == 0).all() and (got.taken <= 2 * got["size"]).all()
    kept = mixing.mixed(docs).toPandas()
    assert len(kept) == (got.taken > 0).sum() and kept.taken.sum() == got.taken.sum()
    for name in ("_tag", "_size", "_t", "_ratio", "target", "SOURCE_SIZE"):
        docs = docs.withColumn(name, F.lit("clash"))
    named = mixing.mixed(docs)
    assert named.columns == [c for c in docs.columns if c not in ("size", "taken")] + ["size", "taken"]
    assert named.agg(F.sum("taken")).first()[0] == got.taken.sum()
    assert mixing.mix(docs.limit(0)).count() == 0
    many = spark.createDataFrame([(f"s{k:04d}", 10 + k) for k in range(500)], "source string, source_size long")
    place = {r.source: r.place for r in mixing.numbered(many).collect()}
    assert place == {f"s{k:04d}": k for k in range(500)}


@pytest.mark.parametrize("copies", [8192, 100])
def test_mix_of_repeated_rows(spark, monkeypatch, copies):
    """Rows that cannot be told apart are dealt whole takings, in one group or in many."""
    monkeypatch.setattr(mixing, "COPIES", copies)
    rows = [(1, "word", "b")] * 3000 + [(10 + k // 2, "two words", "c") for k in range(400)] + [(900 + k, "w " * (1 + k % 5), "a") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and (got.taken % got["size"] == 0).all() and (got.taken <= 2 * got["size"]).all()
    target = filled(got.groupby("source")["size"].sum().to_dict())
    for s, g in got.groupby("source"):
        assert abs(g.taken.sum() - target[s]) <= 4 + 0.012 * target[s] * (copies < 8192)
    kept = mixing.mixed(docs)
    assert abs(kept.agg(F.sum("taken")).first()[0] - got.taken.sum()) <= 4 + 0.012 * got.taken.sum() * (copies < 8192)


def test_flight_keeps_the_balance():
    rng = np.random.default_rng(8)
    size = rng.integers(1, 3000, 400).astype(float)
    p = np.full(400, 0.3)
    q = mixing.flight(p, size, rng)
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum(), abs=1e-6) and (q * size).sum() == pytest.approx((p * size).sum(), rel=1e-9)
    taken = np.mean([mixing.flight(p, size, np.random.default_rng(s)) for s in range(200)], axis=0)
    assert abs(taken - 0.3).max() < 0.2  # every document keeps its probability


# --- archives ----------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    big, trap = "ä" * 600, "x" * 1200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (2, "u\r\nX: y", trap), (4, "u", trap), (6, "u", None), (7, "u", ""), (8, "u", "short"), (9, "u", "short"),
            (None, "n", big), (10, "u", "y" * 2000), (10, "u", "y" * 2000), (11, "u", "\r\n" * 700), (12, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(i, u, h, 0) for i, u, h in rows], "page_id long, url string, html string, record_type int")
    got = warc.round_trip(pages).toPandas()
    assert len(got) == len(rows)
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if x == h]
        top = max((j for j in same if j is not None), default=None)
        again = len(b) >= 1000 and i != top
        for r in got[got.page_id.isna() if i is None else got.page_id == i].itertuples():
            assert (r.payload_bytes, r.payload_digest, r.record_type) == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response")
            assert (r.refers_to == top) if again else pd.isna(r.refers_to)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_payloads_survive(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    path = warc.write_archive(pages, scratch(spark, "warc-test"))
    back = {r.page_id: r.payload for r in warc.read_records(spark, path).collect()}
    assert back == {r.page_id: r.html or "" for r in pages.collect()}


# --- quality and pipeline ----------------------------------------------------------------------

@pytest.mark.parametrize("pool", [0, 20, 2000])
def test_quality_on_held_out_labels(spark, pool):
    """Learned from the even labels, judged on the odd ones; sources say nothing, so that view has no say."""
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fitted(docs, labels.where("doc_id % 2 = 0"), pool=pool)
    got = quality.scored(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.keep.mean() >= 0.97 and bad.keep.mean() <= 0.05
    assert model.joint[1] == 0 and model.handed[1] == 0


def test_quality_with_all_rows_labelled(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() >= 0.97 and got[got.quality == 0].keep.mean() <= 0.05


def test_exchange_teaches_the_view_that_lacks_labels():
    """Metadata that tells good from bad labels the pool for a text view with few labelled rows, and is never worse for it."""
    rng = np.random.default_rng(4)

    def rows(n):
        y = (rng.random(n) < 0.7).astype(float)
        text = [(np.array([rng.integers(0, 300) + (300 if a else 0) for _ in range(3)]), np.ones(3)) for a in y]
        meta = [quality.meta_features(f"s{int(rng.integers(0, 3) + (3 if a else 0))}", "en", 1.0) for a in y]
        return y, text, meta

    y, text, meta = rows(80)
    _, pool_text, pool_meta = rows(600)
    z, test_text, test_meta = rows(500)
    alone = quality.co_train(text, meta, y, [], [])
    taught = quality.co_train(text, meta, y, pool_text, pool_meta)
    assert taught.handed[1] > 0 and alone.handed == (0, 0)

    def right(model):
        got = [model.score(quality.scores(model.text, test_text), quality.scores(model.meta, test_meta))[k] for k in (0, 1, 2)]
        return [np.mean((g >= 0.5) == (z > 0.5)) for g in got]

    before, after = right(alone), right(taught)
    assert after[0] > before[0] and after[2] >= max(after[:2]) - 0.01


def test_calibration_and_logistic_reach_their_minima():
    """Against long plain gradient descent, on separable and on mixed scores."""
    rng = np.random.default_rng(6)
    for shift in (0.5, 50.0):
        y = (rng.random(200) < 0.8).astype(float)
        x = np.column_stack([y * shift + rng.normal(0, 1, 200), rng.normal(0, 1, 200) + 0.2 * y])
        w = quality.calibrate(x, y)
        up, down = y.sum(), (1 - y).sum()
        t = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
        share = np.where(y > 0.5, 100 / up, 100 / down)
        m = np.column_stack([x, np.ones(200)])

        def value(v):
            return (share * quality._loss(m @ v, t)).sum() + 0.005 * (v @ v)

        plain = np.zeros(3)
        scale = np.abs(m).max() ** 2 * 200
        for _ in range(100_000):
            plain = plain - (m.T @ (share * (quality._sigmoid(m @ plain) - t)) + 0.01 * plain) / (0.25 * scale * share.max())
            plain[:2] = np.maximum(plain[:2], 0)
        assert (w[:2] >= 0).all() and value(w) <= value(plain) + 1e-6
    rows = [(rng.choice(30, 5, replace=False), rng.random(5)) for _ in range(60)]
    y = np.array([float(r[0].min() < 4) for r in rows])
    w = quality.logistic(rows, y, 30)
    weight = np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    dense = np.zeros((60, 30))
    for k, (i, v) in enumerate(rows):
        dense[k, i] = v
    assert np.abs(dense.T @ (weight * (quality._sigmoid(dense @ w) - y)) + 0.2 * w).max() < 1e-4


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 50000, "en", "s", 1), (None, "x", "en", "s", 1), (3, "again", "en", "s", 5)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == 5 and (got.keep == 1).all()  # one class only: nothing is rejected
    assert quality.kept(docs, labels).count() == 5
    assert quality.classify(docs.limit(0), labels.limit(0)).count() == 0
    both = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 1)], "doc_id long, quality int")
    assert quality.classify(docs, both).count() == 5


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, f"test-{name}")
        stage(spark, now, SMALL).write.parquet(path)
        steps[name] = (now, spark.read.parquet(path))
        now = steps[name][1]
    for name in list(steps)[:-1]:
        assert steps[name][1].columns == docs.columns
    ids = {name: {r.doc_id for r in after.select("doc_id").collect()} for name, (_, after) in steps.items()}
    every = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.keep for r in queries.op10_quality(spark, SMALL).collect()}
    assert ids["quality"] == {i for i, k in scores.items() if k}
    reach = groups([(i, naive_print(every[i])) for i in sorted(ids["quality"])], 4)
    assert ids["simhash"] == set(reach.values())
    leaky = {r.doc_id for r in decontam.leaks(steps["decontaminate"][0], spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert ids["decontaminate"] == ids["simhash"] - leaky
    assert ids["personal"] == ids["decontaminate"]
    from tapework.llm import pii
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in steps["personal"][1].collect())
    mixed = steps["mix"][1].toPandas()
    assert set(mixed.doc_id) <= ids["personal"] and (mixed.taken > 0).all() and (mixed.taken <= 2 * mixed["size"]).all()
    rows = corpus_pipeline.run(spark, SMALL).toPandas()
    assert dict(zip(rows.doc_id, rows.taken)) == dict(zip(mixed.doc_id, mixed.taken))


@pytest.mark.parametrize("table", ["documents"])
def test_pipeline_on_odd_tables(spark, table):
    """NULLs, empty and repeated rows go through every stage; an empty table stays empty."""
    import corpus_pipeline
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text of a few words", "en", None, 24), (4, "a b c d e f", "en", "s", 11), (4, "a b c d e f", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for first in (docs, docs.limit(0)):
        now = first
        for name, stage in corpus_pipeline.STAGES:
            path = scratch(spark, f"odd-{name}")
            stage(spark, now, SMALL).write.parquet(path)
            now = spark.read.parquet(path)
        assert now.count() <= first.count()


def test_sketch_sums_all_passages():
    """A'(A R) over every passage of a document, also those that overlap."""
    words = [f"w{k % 9}" for k in range(150)]
    terms = sorted(set(words))
    idf = np.linspace(0.5, 2.0, len(terms))
    p, t, n = decontam.rows_of(words, decontam.lookup(terms))
    frame = pd.DataFrame({"p": [p], "t": [t], "n": [n]})
    got, = decontam._sketch(idf, 4)(iter([frame]))
    y = np.concatenate([np.frombuffer(b, np.float32) for b in got["y"]]).reshape(len(terms), 4)
    a = np.zeros((p.max() + 1, len(terms)))
    a[p, t] = (1 + np.log(n)) * idf[t]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    np.testing.assert_allclose(y, a.T @ (a @ decontam._random(len(terms), 4)), rtol=1e-4, atol=1e-5)
    assert got["rows"].sum() == len(a)


def test_hits_of_a_batch_against_a_plain_split():
    """Words of a whole batch at the places of a plain split, whatever white space, marks and letters; passages of each document as if alone."""
    known = ["word", "other", "i̇x", "σας", "don't"]
    texts = [None, "", " \t ", "... word", "\x1cword\x85(other)　\"word!!\" WORD don't.", "İx ΣΑΣ, wor​d", "x " * 47 + "word " + "x " * 40 + "Other", "word " * 70, "no such"]
    text, place, word, size = decontam.hits(pa.array(texts), pa.array(known, pa.large_string()))
    plain = [[w.strip(decontam._EDGES) for w in (t or "").lower().split()] for t in texts]
    want = [(k, i, known.index(w)) for k, ws in enumerate(plain) for i, w in enumerate(ws) if w in known]
    assert [*zip(text.tolist(), place.tolist(), word.tolist())] == want
    assert [max(1, len(ws)) for ws in plain] == size.tolist()  # a text without words counts as one empty word
    got = [*zip(*(x.tolist() for x in decontam.passages(text, place, word, size)))]
    held = {}
    for k, i, w in want:
        for p in {i // decontam.STRIDE, i // decontam.STRIDE - 1}:
            if 0 <= p <= max(0, -(-(len(plain[k]) - decontam.WINDOW) // decontam.STRIDE)):
                held[k, p, w] = held.get((k, p, w), 0) + 1
    assert got == [(*x, n) for x, n in sorted(held.items())]


def test_sketch_steps_are_few():
    """Python steps of the sketch do not follow documents or terms."""
    import sys
    rng = np.random.default_rng(7)
    rows = [decontam.passages(*(np.array(x) for x in ([0] * 60, sorted(rng.choice(400, 60, replace=False)), rng.integers(0, 3000, 60), [400])))[1:] for _ in range(300)]
    frame = pd.DataFrame(rows, columns=["p", "t", "n"])
    lines, before = 0, sys.gettrace()

    def trace(step, event, _):
        nonlocal lines
        lines += event == "line" and step.f_code.co_filename == decontam.__file__
        return trace
    sys.settrace(trace)
    try:
        list(decontam._sketch(np.ones(3000), 4)(iter([frame])))
    finally:
        sys.settrace(before)
    assert lines < frame["p"].map(len).sum() / 10
