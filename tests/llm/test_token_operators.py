"""Token alignment, class n-grams and ball-tree search against brute force over whole texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapework.llm import chunked, classlm, lexsearch, queries, tokenalign

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, chunk string, n long, key string, part int, score double, rank int"

ODD = [None, "", " ", "\n", "a", "A a", "a  b", "  two", "end ", "x\n y \nz", "tab\tand\r\nline", "é ï Ä 漢字 かな 🙂 ok", "▁ x▁ y", "a ▁b",
       "<s> <|endoftext|> <unk> </s> <0x0A>", "a  b 　c", "don't I'll we've", "12 345 6789", "x" * 3000, "same text here", "same text here",
       "  x y", "word " * 3000, "é ﬁx ﻿q ​z", "\x00 nul \x7f del"]


def odd_docs(spark, rows=None):
    """Odd texts in a table whose other columns have the names of internal ones."""
    rows = rows if rows is not None else [(i, t) for i, t in enumerate(ODD)] + [(3, "again with id three"), (None, "no id"), (None, None)]
    return spark.createDataFrame([(i, t, "c", 7, "k", 1, 0.5, 2) for i, t in rows], SCHEMA)


# --- alignment ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokens():
    with open(f"{tokenalign.FOLDER}/{tokenalign.A_FILE}") as a, open(f"{tokenalign.FOLDER}/{tokenalign.B_FILE}", "rb") as b:
        return tokenalign.Tokens(a.read(), b.read())


def plain_alignment(tokens, text):
    """Groups and links from the two libraries' whole-text encodings, by comparing all boundaries."""
    if not text:
        return [], []
    a = tokens.a.encode(" " + text, add_special_tokens=False).ids
    b = tokens.b.encode(text)
    letters = tokenalign.byte_letters()
    a = [(i, bytes(letters[c] for c in tokens.a.id_to_token(i))) for i in a]
    b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for i in b for p in [tokens.b.id_to_piece(i)]]
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
        return [], []

    def spans(side):
        at, out = 0, []
        for i, x in side:
            out.append((at, at + len(x), i))
            at += len(x)
        return out

    a, b = spans(a), spans(b)
    cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
    lows = [0, *cuts]
    groups = [([i for s, e, i in a if lo <= s and e <= hi], [i for s, e, i in b if lo <= s and e <= hi]) for lo, hi in zip(lows, cuts)] if len(a) < 400 else None
    if groups is None:  # long texts: the same by walking along
        groups, p, q = [], 0, 0
        for hi in cuts:
            left, right = [], []
            while p < len(a) and a[p][1] <= hi:
                left.append(a[p][2])
                p += 1
            while q < len(b) and b[q][1] <= hi:
                right.append(b[q][2])
                q += 1
            groups.append((left, right))
    links, low = [], 0
    for s, e, i in a:
        while b[low][1] <= s:
            low += 1
        k = low
        while k < len(b) and b[k][0] < e:
            links.append((i, b[k][2]))
            k += 1
    return groups, links


def plain_summaries(tokens, rows):
    found = [plain_alignment(tokens, t) for _, t in rows]
    counts = Counter(p for _, links in found for p in set(links))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (i, _), (groups, links) in zip(rows, found):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    hashlib.sha256(text.encode()).hexdigest() if text else "", sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links)))
    return out, counts, top


def as_rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect())))


def test_alignment_query(spark, tokens):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(queries.op11_align(spark, SMALL)) == sorted(map(repr, plain_summaries(tokens, rows)[0]))


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_alignment_of_odd_texts(spark, tokens, monkeypatch, size):
    """The same in one chunk and in chunks of a few documents, joined in one call and one by one."""
    cut = chunked.cut
    monkeypatch.setattr(tokenalign, "cut", lambda batches: cut(batches, size))
    docs = odd_docs(spark).coalesce(1)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, counts, top = plain_summaries(tokens, rows)
    assert as_rows(tokenalign.summaries(docs)) == sorted(map(repr, want))
    got = {(r.a, r.b): (r.documents, r.best) for r in tokenalign.links(docs).collect()}
    assert got == {p: (n, n == top[p[0]]) for p, n in counts.items()}
    groups = tokenalign.groups(docs).collect()
    made = sorted((repr(r.doc_id), [(list(g.a), list(g.b)) for g in r.groups]) for r in groups)
    assert made == sorted((repr(i), plain_alignment(tokens, t)[0]) for i, t in rows)


def test_alignment_of_nothing(spark):
    assert tokenalign.summaries(odd_docs(spark, [])).count() == 0
    assert tokenalign.links(odd_docs(spark, [(1, None), (2, "")])).count() == 0


def test_fast_engine_is_the_same(tokens):
    assert tokens.fast
    for text in ODD:
        if text:
            assert tokens.fast.encode_ordinary(" " + text) == tokens.a.encode(" " + text, add_special_tokens=False).ids


def test_units_start_tokens_on_both_sides(tokens):
    rng = np.random.default_rng(5)
    letters = list("ab. \n\tÄ漢▁ 　'1🙂") + [" "] * 6
    for _ in range(300):
        text = "".join(rng.choice(letters, rng.integers(1, 40)))
        parts = tokenalign.units(text)
        assert " ".join(parts) == text
        for side in (lambda x: tokens.a.encode(" " + x, add_special_tokens=False).ids, tokens.b.encode):
            assert sum((list(side(p)) for p in parts), []) == list(side(text))


def test_coalesced_intervals_with_gaps():
    a, b = [(0, 2), (2, 3), (10, 12)], [(1, 3), (5, 6), (9, 11)]
    start, end = np.array([s for s, _ in a + b]), np.array([e for _, e in a + b])
    order, group = tokenalign.coalesced(start, end, np.array([0, 0, 0, 1, 1, 1]))
    assert [[int(x) for x in order[group == g]] for g in range(group.max() + 1)] == [[0, 3, 1], [4], [5, 2]]
    left, right = tokenalign.overlaps(start[:3], end[:3], start[3:], end[3:])
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (1, 0), (2, 2)]


# --- class n-grams -----------------------------------------------------------------------------

def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def plain_base(rows):
    counts = Counter()
    for i, t in rows:
        if not is_held_out(i):
            counts.update([*plain_words(t), None])
    n, v = sum(counts.values()), len(counts)
    return [(i, is_held_out(i), len(plain_words(t)) + 1, sum(counts[w] > 0 for w in [*plain_words(t), None]), n,
             sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*plain_words(t), None])) for i, t in rows]


def check_base(got, rows):
    want = sorted(plain_base(rows), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_perplexity_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_perplexity(spark, SMALL).collect()
    check_base(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) <= 1e-9 * r.perplexity for r in got)


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_perplexity_of_odd_texts(spark, monkeypatch, size):
    cut = chunked.cut
    monkeypatch.setattr(classlm, "cut", lambda batches, _: cut(batches, size))
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = classlm.score(docs, classes=4).collect()
    check_base(got, rows)
    scores = sorted((repr(r.doc_id), r.score) for r in got)
    again = sorted((repr(r.doc_id), r.score) for r in classlm.score(docs.repartition(5), classes=4).collect())
    assert [s[0] for s in scores] == [s[0] for s in again]
    np.testing.assert_allclose([s[1] for s in scores], [s[1] for s in again], rtol=1e-9)
    assert all(math.isfinite(s) for _, s in scores)


def test_perplexity_without_training_rows(spark):
    held = next(i for i in range(100) if is_held_out(i))
    docs = odd_docs(spark, [(held, "never learnt"), (held, None)])
    got = classlm.score(docs, classes=3).collect()
    check_base(got, [(held, "never learnt"), (held, None)])
    assert all(math.isfinite(r.score) for r in got)
    assert classlm.score(odd_docs(spark, []), classes=3).count() == 0


def test_gains_are_differences_of_likelihoods():
    rng = np.random.default_rng(1)
    for _ in range(30):
        units, size = 9, 4
        pairs = rng.integers(0, 4, (units, units)) * rng.integers(0, 2, (units, units))
        classes = rng.integers(0, size, units)

        def matrix(of):
            m = np.zeros((size, size))
            np.add.at(m, (of[:, None].repeat(units, 1), of[None].repeat(units, 0)), pairs)
            return m

        m = matrix(classes)
        for unit in range(units):
            after = np.bincount(classes, weights=pairs[unit], minlength=size)
            before = np.bincount(classes, weights=pairs[:, unit], minlength=size)
            got = classlm.gains(m, classes[unit], after, before, float(pairs[unit, unit]))
            for to in range(size):
                moved = classes.copy()
                moved[unit] = to
                assert abs(got[to] - (classlm.likelihood(matrix(moved)) - classlm.likelihood(m))) < 1e-8


def test_exchange_finds_planted_classes(spark):
    """Words of two kinds that alternate: two classes after which the likelihood cannot rise by any move."""
    rng = np.random.default_rng(2)
    units = 12
    lines = []
    for _ in range(200):
        line = [(k % 2) * 5 + int(rng.integers(1, 6)) for k in range(20)]
        lines.append((chunked.packed(np.array(line)),))
    neighbours = classlm._neighbours(spark.createDataFrame(lines, "units binary"), units)
    first = np.arange(units) % 3
    classes, matrix = classlm.exchange(neighbours, first, 3)
    assert len(set(classes[1:6])) == 1 and len(set(classes[6:11])) == 1 and classes[1] != classes[6]
    assert classlm.likelihood(matrix) >= classlm.likelihood(classlm._class_matrix(neighbours, first, 3))
    # Class bigrams against a plain count.
    plain = np.zeros((3, 3))
    for data, in lines:
        line = [0, *chunked.unpacked(data).tolist(), 0]
        for a, b in zip(line, line[1:]):
            plain[classes[a], classes[b]] += 1
    assert (plain == matrix).all()


def test_exchange_ends_when_no_unit_gains(spark):
    """Many units without clear classes: sweeps go on until a plain search finds no move that raises the likelihood."""
    rng = np.random.default_rng(5)
    units, size = 60, 6
    lines = [rng.integers(1, units, 30) for _ in range(40)]
    neighbours = classlm._neighbours(spark.createDataFrame([(chunked.packed(line),) for line in lines], "units binary"), units)
    classes, matrix = classlm.exchange(neighbours, np.arange(units) % size, size)
    pairs = np.zeros((units, units))
    for line in lines:
        np.add.at(pairs, (np.r_[0, line], np.r_[line, 0]), 1)

    def value(of):
        member = np.eye(size)[of]
        return classlm.likelihood(member.T @ pairs @ member)

    assert abs(value(classes) - classlm.likelihood(matrix)) < 1e-6
    for unit in range(units):
        for to in range(size):
            moved = classes.copy()
            moved[unit] = to
            assert value(moved) <= value(classes) + 1e-5


def test_long_words_are_units_of_their_own(spark):
    """Names of words say nothing where every word is a unit, so scores are those with short names."""
    rng = np.random.default_rng(4)
    names = {"left": "left" + "-" * 80 + "one", "right": "right" + "-" * 80 + "one"}
    rows = []
    for i in range(120):
        ws = [x for _ in range(8) for x in (("left", "ab", "cd") if rng.random() < 0.5 else ("right", "ef", "gh"))]
        rows.append((i, " ".join(ws), " ".join(names.get(w, w) for w in ws)))
    table = spark.createDataFrame(rows, "doc_id long, short string, text string")
    short, long = ({r.doc_id: r.score for r in classlm.score(table, classes=4, text_col=c).collect()} for c in ("short", "text"))
    np.testing.assert_allclose([long[i] for i in range(120)], [short[i] for i in range(120)], rtol=1e-9)


def test_moves_set_aside_are_judged_anew(spark, monkeypatch):
    """The last proposals of a turn are all made together, however few of the earlier ones could be."""
    # 1 and 2 are alike, and so are 5 and 6, but each is in a class with one of the others: all of them
    # want to change to the other class, and together they would only swap the classes.
    line = [x for a in (1, 2) for b in (5, 6) for x in (a, 3, b, 4)]
    lines, units, size = [(chunked.packed(np.array(line * 5)),)], 7, 5
    first = np.array([4, 0, 1, 2, 3, 0, 1])
    neighbours = classlm._neighbours(spark.createDataFrame(lines, "units binary"), units)
    asked, was, propose = [], [], classlm._moves

    def moves(table, classes, matrix, turn):
        found = propose(table, classes, matrix, turn)
        asked.append([(unit, to) for _, unit, to in found])
        was.append(classes.copy())
        return found

    monkeypatch.setattr(classlm, "_moves", moves)
    monkeypatch.setattr(classlm, "TURNS", 1)
    classes, matrix = classlm.exchange(neighbours, first, size, sweeps=1)
    made = [all(now[unit] == to for unit, to in found) for found, now in zip(asked, [*was[1:], classes])]
    assert made == [False] * (len(made) - 1) + [True] and len(made) > 1
    assert classlm.likelihood(matrix) > classlm.likelihood(classlm._class_matrix(neighbours, first, size))


def test_probabilities_add_up_to_one(spark):
    """Over all words and the unseen one of each class, after any two words."""
    rng = np.random.default_rng(3)
    size, units = 3, 8
    lines = spark.createDataFrame([(chunked.packed(rng.integers(1, units, 30)),) for _ in range(20)], "units binary")
    classes = rng.integers(0, size, units)
    neighbours = classlm._neighbours(lines, units)
    matrix = classlm._class_matrix(neighbours, classes, size)
    counts = matrix.sum(axis=0)
    distinct = np.ones(units)
    model = classlm._model(lines, classes, matrix, distinct)
    kinds = np.bincount(classes, weights=distinct, minlength=size)
    emitted = (counts + classlm.ADDED * (kinds + 1)) / 10 ** model.scale  # all words of a class and its unseen one
    np.testing.assert_allclose(emitted, 1)
    np.testing.assert_allclose((10 ** model.transitions).sum(axis=-1), 1)
    # A text's score from a plain walk over its classes.
    line = [2, 5, 1]
    path = [classes[0], classes[0], *classes[line], classes[0]]
    want = sum(model.transitions[path[k - 2], path[k - 1], path[k]] - model.scale[path[k]] for k in range(2, len(path)))
    assert abs(model.score(np.array(line), 0.0) - want) < 1e-9


# --- search ------------------------------------------------------------------------------------

def plain_search(docs, items, k=10):
    def terms(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(x for _, _, x in counted)
    by_item = {}
    for i, t in items:
        by_item.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in by_item.items():
        weights = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(w in c for _, c, _ in counted) + 1))) for w in words} if n else {}
        scored = []
        for i, c, x in counted:
            m = 10 + 90 * x * n // total
            s = sum(weights[w] * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k])]
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def test_search_query(spark):
    docs, items = ([(r[0], r.text) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").collect()] for t in ("documents", "benchmark"))
    assert found(queries.op13_search(spark, SMALL)) == plain_search(docs, items)


@pytest.mark.parametrize("block, leaf, part, seeds", [(4096, 16, 2000, 32), (7, 2, 3, 1), (5, 1, 2, 10 ** 9)])
def test_search_of_odd_tables(spark, monkeypatch, block, leaf, part, seeds):
    """Nulls, repeats, ties and long texts, in one tree and in many small ones, with and without floors."""
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("PART", part), ("SEEDS", seeds)):
        monkeypatch.setattr(lexsearch, name, value)
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, "same text"), (2, None), (3, ""), (4, "WORD word a A 漢字 ..."), (5, "nowhere"), (6, "text"), (6, "here 345"), (None, "two x"), (8, "a b c x y z e " * 20)]
    table = spark.createDataFrame([(i, t, 1, "d") for i, t in items], "item_id long, text string, rank int, doc_id string")
    assert found(lexsearch.search(docs, table)) == plain_search(rows, items)
    assert found(lexsearch.search(docs, table, k=2)) == plain_search(rows, items, 2)
    assert lexsearch.search(odd_docs(spark, []), table).count() == 0
    assert lexsearch.search(odd_docs(spark, [(1, None)]), table).count() == 0
    assert lexsearch.search(docs, table.limit(0)).count() == 0


def test_bounds_hold_at_every_node(monkeypatch):
    monkeypatch.setattr(lexsearch, "LEAF", 3)
    rng = np.random.default_rng(7)
    size = rng.integers(1, 12, 60)
    term = np.concatenate([np.sort(rng.choice(200, s, replace=False)) for s in size])
    value = rng.integers(0, 10 ** 6, len(term))
    asked = [{int(t): int(rng.integers(0, 20000)) for t in rng.choice(220, rng.integers(1, 30), replace=False)} for _ in range(15)]
    tree = lexsearch.Tree(size, term, value, lexsearch.Queries(asked))
    starts = chunked.starts_of(size)
    scores = np.array([[sum(q.get(int(t), 0) * int(v) for t, v in zip(term[a:b], value[a:b])) for a, b in zip(starts, starts[1:])] for q in asked])
    assert sorted(np.concatenate([r for r, c in zip(tree.rows, tree.children) if c is None]).tolist()) == list(range(60))
    for rows, bound in zip(tree.rows, tree.bounds):
        assert (scores[:, rows].max(axis=1) <= bound).all()
    for q in range(len(asked)):
        want = sorted(((int(s), r) for r, s in enumerate(scores[q]) if s > 0), key=lambda x: (-x[0], x[1]))[:5]
        for floor in (0, want[-1][0] if want else 0):
            got = tree.search(q, *tree_terms(asked[q]), 5, floor)
            assert sorted(got, key=lambda x: (-x[0], x[1])) == want


def tree_terms(row):
    keys = sorted(row)
    return np.array(keys), np.array([row[k] for k in keys])
