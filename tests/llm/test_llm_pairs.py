"""Near-duplicate operators against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from codecflow.llm import embedding_dedup, jaccard_join, suffix_dedup
from codecflow.llm.common import components, forest

DOCS = "doc_id long, text string, h long, rid string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], DOCS)


def reach(nodes, links):
    """The smallest node reachable from each."""
    out = {n: n for n in nodes}
    while True:
        new = {n: min([out[n], *(out[m] for m in links.get(n, ()))]) for n in nodes}
        if new == out:
            return out
        out = new


# -- components -----------------------------------------------------------------------------------------------------------


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    links = {}
    for a, b in edges:
        links.setdefault(a, []).append(b)
        links.setdefault(b, []).append(a)
    want = reach(list(links), links)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if set(links[n]) != {n}}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
    assert dict(forest(np.array([1, 4, 2]), np.array([2, 5, 3]))) == {2: 1, 3: 1, 5: 4}


# -- embeddings -------------------------------------------------------------------------------------------------------------


def brute_vectors(rows, at_least=0.98):
    able = {}
    for i, (k, v, label) in enumerate(rows):
        if k is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            able[i] = np.array(v, float)
    links, n = {}, {k: 0 for k, _, _ in rows}
    for i, j in itertools.combinations(able, 2):
        x, y = able[i], able[j]
        if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= at_least:
            for a, b in ((i, j), (j, i)):
                links.setdefault(rows[a][0], []).append(rows[b][0])
                n[rows[a][0]] += 1
    return n, reach([k for k, _, _ in rows if k is not None], links)


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(12, 8))
    rows = [(i, (base[i % 12] * (1 + i % 3) + r.normal(size=8) * 0.12).tolist(), i % 2) for i in range(180)]
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [float("inf")] + [1.0] * 7, 0), (1004, rows[0][1], None), (1005, rows[0][1], 0), (1006, [None] + [1.0] * 7, 0), (1007, [1.0, 0.0], 0), (1008, [1.0, 0.001], 0), (1009, [], 0)]
    df = spark.createDataFrame([(*x, "extra", 5) for x in rows], "vec_id long, embedding array<double>, label int, rep string, cell int")
    n, component = brute_vectors(rows)
    assert sum(n.values()) > 200
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embedding_dedup.near_duplicates(df).collect()}
    assert got == {k: (n[k], component[k], component[k] == k) for k, _, _ in rows}
    assert {x["vec_id"]: x["n_links"] for x in embedding_dedup.near_duplicates(df, centroids=1).collect()} == n
    assert embedding_dedup.near_duplicates(df.limit(0)).isEmpty()


def test_embedding_blocks_and_null_ids(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.normal(size=6)
    rows = [(i, (x + r.normal(size=6) * 0.2).tolist(), 1) for i in range(60)] + [(None, x.tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    n, component = brute_vectors(rows)
    monkeypatch.setattr(embedding_dedup.verify, "__defaults__", (7,))
    got = {v["vec_id"]: (v["n_links"], v["component_id"]) for v in embedding_dedup.near_duplicates(df).collect()}
    assert got == {k: (n[k] if k is not None else 0, component.get(k)) for k, _, _ in rows}


def test_repeated_ids_are_one_node(spark):
    probe = [(1, [1.0, 0.0, 0.0, 0.0], 1), (2, [0.0, 1.0, 0.0, 0.0], 1), (5, [1.0, 0.0, 0.0, 0.0], 1), (5, [0.0, 1.0, 0.0, 0.0], 1)]
    schema = "vec_id long, embedding array<double>, label int"
    got = {(v["vec_id"], v["n_links"], v["component_id"]) for v in embedding_dedup.near_duplicates(spark.createDataFrame(probe, schema)).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (5, 2, 1)}
    r = np.random.default_rng(4)
    base = r.normal(size=(6, 6))
    rows = [(int(r.integers(40)), (base[i % 6] + r.normal(size=6) * 0.15).tolist(), int(i % 5 == 0)) for i in range(150)]
    rows += rows[:20] + [(k, rows[0][1], 0) for k in (3, 3, 3, 9)]
    ids = {k for k, _, _ in rows}
    once = {(k, tuple(v), label) for k, v, label in rows}
    near = lambda x, y: np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.98
    linked = [(k, j) for k, v, a in once for j, w, b in rows if a == b and k != j and near(v, w)]
    n = {k: sum(x == k for x, _ in linked) for k in ids}
    links = {k: [j for x, j in linked if x == k] for k in ids}
    component = reach(list(ids), links)
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows) and {v["vec_id"]: (v["n_links"], v["component_id"]) for v in out} == {k: (n[k], component[k]) for k in ids}


def test_traversal_visits_cells_in_order():
    a, b = np.array([0.3, 0.0, 0.1]), np.array([0.2, 0.05])
    cells = list(embedding_dedup.traverse(a, b, 0.1))
    costs = [a[i] ** 2 + b[j] ** 2 for i, j in cells]
    assert costs == sorted(costs) and set(cells) == {(i, j) for i in range(3) for j in range(2) if a[i] ** 2 + b[j] ** 2 <= 0.1}


# -- word shingles ------------------------------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_documents(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links, n = {}, {}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
            for u, v in ((a, b), (b, a)):
                links.setdefault(u, []).append(v)
                n[u] = n.get(u, 0) + 1
    component = reach([i for i, _ in rows if i is not None], links)
    return sorted([(i, len(s), component.get(i), n.get(i, 0)) for i, s in sets], key=str)


def near_copies(seed=5, families=6, copies=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    passage = " ".join(word() for _ in range(40))
    rows, i = [], 0
    for _ in range(families):
        text = [word() for _ in range(r.randint(30, 160))]
        for _ in range(copies):
            t = list(text)
            for _ in range(r.randint(0, 5)):
                t[r.randrange(len(t))] = word()
            rows.append((i, " ".join(t).upper() if i % 5 == 0 else "\n".join(t) + (" " + passage if i % 3 == 0 else "")))
            i += 1
    return rows


@pytest.mark.parametrize("tile", [512, 4])
def test_jaccard_join(spark, tile):
    rows = near_copies()
    rows += [(500, ""), (501, None), (502, "one two"), (503, " One  TWO "), (504, "one two three"), (505, "\x1c\x1c"), (506, rows[3][1]), (507, "É é"), (508, "é é"), (None, rows[3][1])]
    got = jaccard_join.similar_documents(docs(spark, rows), tile=tile).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got], key=str) == brute_documents(rows)


def test_jaccard_join_edges(spark):
    assert jaccard_join.similar_documents(docs(spark, [])).isEmpty()
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.similar_documents(docs(spark, [(1, ""), (2, None)])).collect()} == {(1, 1), (2, 2)}
    rows = [(4, "a b c d e f g"), (4, "a b c d e f g"), (9, "a b c d e f g"), (3, "other words that are in no other text"), (None, "a b c d e f g")]
    kept = sorted(((r["doc_id"], r["h"]) for r in jaccard_join.keep_one(docs(spark, rows)).collect()), key=str)
    assert kept == [(3, 7), (4, 7), (4, 7), (None, 7)]


def test_pipeline_keeps_one_of_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(21)
    a, b, c, d = (" ".join("".join(r.choice("abcdefghijklm") for _ in range(6)) for _ in range(80)) for _ in range(4))
    rows = [(4, a), (4, a), (None, a), (None, b), (None, b), (5, c), (6, c), (7, d), (8, None), (8, None)]
    df, stages = docs(spark, rows), dict(corpus_pipeline.STAGES)
    kept = stages["n-gram Jaccard join"](spark, df, str(tmp_path))
    assert kept.columns == df.columns
    kept.write.parquet(str(tmp_path / "kept"))
    out = stages["suffix-array dedup"](spark, spark.read.parquet(str(tmp_path / "kept")), str(tmp_path))
    assert sorted(((x["doc_id"], x["text"]) for x in out.collect() if x["text"]), key=str) == sorted([(4, a), (None, b), (5, c), (7, d)], key=str)


def test_first_round_moves_few_bytes(spark):
    r = random.Random(8)
    rows = [(i, " ".join(str(r.random()) for _ in range(400))) for i in range(300)]
    written = lambda: sum(spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(spark.sparkContext._jsc.sc().statusStore().executorList(False).size()))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    assert all(x["n_links"] == 0 for x in jaccard_join.similar_documents(docs(spark, rows)).collect())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before < 8 * 300 * 396  # near half of all shingles are in prefixes


@pytest.mark.parametrize("sets, held", [(5, 1 << 21), (1 << 16, 100)])
def test_jaccard_join_in_small_slices(spark, sets, held, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLICE_SETS", sets)
    monkeypatch.setattr(jaccard_join, "SLICE_SHINGLES", held)
    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", 500)
    rows = near_copies()
    got = jaccard_join.similar_documents(docs(spark, rows)).collect()
    assert sorted([(x["doc_id"], x["n_shingles"], x["component_id"], x["n_links"]) for x in got], key=str) == brute_documents(rows)


def test_single_common_shingles_join_no_clusters(spark, monkeypatch):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    passages = [" ".join(word() for _ in range(8)) for _ in range(12)]
    rows, sizes = [], []
    for k in range(12):  # pairs of near copies in a ring, each with four shingles of the pair before and of the one behind
        text = [word() for _ in range(120)]
        for i in range(2):
            rows.append((2 * k + i, " ".join([passages[k], *text[:60], passages[k - 1], *text[60 : 119 + i]])))
    tiles = jaccard_join.tiles
    monkeypatch.setattr(jaccard_join, "tiles", lambda members, *rest: sizes.extend(x["count"] for x in members.groupBy("cluster").count().collect()) or tiles(members, *rest))
    got = jaccard_join.similar_documents(docs(spark, rows)).collect()
    assert sorted([(x["doc_id"], x["n_shingles"], x["component_id"], x["n_links"]) for x in got], key=str) == brute_documents(rows)
    assert sizes == [2] * 12


def test_matches_and_prefix_lengths():
    for n in range(1, 300):
        m = jaccard_join.matches(np.ones(n, np.int64))
        assert 1 <= m <= jaccard_join.needed(n) and n - jaccard_join.needed(n) + m <= n
        for partner in range(jaccard_join.needed(n), 100 * n // 75 + 1):
            assert jaccard_join.least_shared(n, m) <= min(m, jaccard_join.least_matches(partner)) or m < jaccard_join.least_matches(partner)
    frequent = np.r_[np.ones(80, np.int64), np.full(20, 10**7)]
    assert jaccard_join.matches(frequent) <= jaccard_join.matches(np.ones(100, np.int64))


# -- repeated strings ------------------------------------------------------------------------------------------------------------


def brute_cut(rows):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, b in bodies:
        for p in range(len(b) - 199):
            count[b[p : p + 200]] = count.get(b[p : p + 200], 0) + 1
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def repeating(seed=1):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abcdefghij klmé") for _ in range(n))
    a, b = noise(260), noise(199)
    rows = [(i, noise(r.randint(0, 500)) + (a if i % 3 == 0 else b if i % 3 == 1 else a[:230]) + noise(r.randint(0, 400))) for i in range(24)]
    rows += [(100, ""), (101, None), (102, "z" * 1500), (103, "ab" * 400), (104, "ba" * 150), (105, noise(150)), (106, rows[0][1]), (107, a + a + b + b), (None, noise(300)), (108, "short"), (109, "short"), (110, "q" * 199)]
    return rows


@pytest.mark.parametrize("hot", [100_000, 3])
def test_suffix_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = repeating()
    got = suffix_dedup.digests(docs(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_cut(rows)


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.digests(docs(spark, [])).isEmpty()
    rows = [(1, "x" * 50 + "y" * 150), (1, "x" * 50 + "y" * 150), (2, "é" * 300), (3, "tail " + "é" * 300)]
    assert sorted([tuple(r) for r in suffix_dedup.digests(docs(spark, rows)).collect()], key=str) == brute_cut(rows)
    left = {r["doc_id"]: (r["text"], r["h"], r["rid"]) for r in suffix_dedup.remove_repeats(docs(spark, [*rows, (9, None)])).collect()}
    assert left[3] == ("tail ", 7, "x") and left[9] == (None, 7, "x") and left[1][0] == ""


def test_long_text_in_segments():
    r = random.Random(9)
    unit = r.randbytes(700_000)
    find = suffix_dedup.Anchors()
    places = []
    for data, ends, where in suffix_dedup.segments([unit, unit[:100], unit[3:]]):
        p, h, lo, hi = find.of(data, ends)
        part = np.searchsorted(ends, p, side="right")
        for at, i, a, b, x in zip(p, part, lo, hi, h):
            text, offset = where[i]
            places.append((text, int(at - (ends[i - 1] if i else 0)) + offset, int(a), int(b), int(x)))
    for text, n, shift in ((0, 700_000, 0), (2, 699_997, 3)):
        mine = sorted(p for p in places if p[0] == text)
        starts = sorted(s for _, at, a, b, _ in mine for s in range(at - b, at - a + 1))
        assert starts == list(range(n - 199))  # every string has one anchor
    assert not [p for p in places if p[0] == 1]


def test_deep_shallow_order():
    r = random.Random(4)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 60))) for _ in range(300)] + [b"a" * k for k in range(60)] * 2
    order, common = suffix_dedup.deep_shallow(strings, 64, 16)
    padded = [s.ljust(64, b"\0") for s in strings]
    got = [padded[i] for i in order]
    assert got == sorted(padded)
    for a, b, c in zip(got, got[1:], common[1:]):
        assert c == next((k for k in range(64) if a[k] != b[k]), 64)


@pytest.mark.parametrize("n, letters", [(0, 2), (1, 2), (2, 1), (500, 1), (500, 2), (3000, 250)])
def test_multikey_quicksort(n, letters):
    words = np.random.default_rng(7).integers(0, letters, (n, 3)).astype(np.uint64) << np.uint64(56 if letters == 250 else 8)
    order, start = suffix_dedup.multikey_quicksort(words)
    rows = [tuple(r) for r in words.tolist()]
    assert order.tolist() == sorted(range(n), key=lambda i: rows[i])  # equal rows as they came
    assert start.tolist() == [i == 0 or rows[order[i]] != rows[order[i - 1]] for i in range(n)]
    spelled = [b"".join(x.to_bytes(8, "big") for x in r) for r in rows]
    shared = [0, *(next((k for k in range(24) if spelled[a][k] != spelled[b][k]), 24) for a, b in zip(order, order[1:]))]
    assert not n or suffix_dedup.common_bytes(words, order).tolist() == shared
