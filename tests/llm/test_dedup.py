import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cubeframe.llm import _text, embed_dedup, exact_dedup, minhash_dedup
from cubeframe.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def united(nodes, links):
    above = {n: n for n in nodes}

    def root(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def exact_by_hand(rows):
    keys = {}
    for i, (ident, text, *_) in enumerate(rows):
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()
        keys.setdefault(key, []).append((-len(text or ""), ident is None, ident or 0, i, ident))
    out = []
    for key, members in keys.items():
        members.sort()
        out += [(m[4], members[0][4], len(members), n == 0, key) for n, m in enumerate(members)]
    return Counter(out)


@pytest.mark.parametrize("share", [1000, 3])
def test_exact(monkeypatch, edge_docs, edge_rows, near_docs, near_rows, share):
    """Also with a lower share for the frequent, so that they are split off."""
    monkeypatch.setattr(exact_dedup, "SHARE", share)
    for docs, rows in ((edge_docs, edge_rows), (near_docs, near_rows)):
        assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == exact_by_hand(rows)


def test_exact_with_a_hot_text(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == exact_by_hand(rows)
    assert exact_dedup.without(docs, exact_dedup.exact_dedup(docs)).count() == 6001


def test_without_keeps_columns_and_one_of_repeated_rows(edge_docs, edge_rows):
    left = exact_dedup.without(edge_docs, exact_dedup.exact_dedup(edge_docs))
    assert left.columns == edge_docs.columns
    wanted = Counter(k[0] for k, n in exact_by_hand(edge_rows).items() for _ in range(n) if k[3])
    assert Counter(r["doc_id"] for r in left.collect()) == wanted


def test_without_tells_texts_of_an_id_apart(spark):
    """Id 2 has a copy of another text, which goes, a text of its own twice, of which the longer row stays, and a null id likewise."""
    rows = [(1, "a b"), (2, "ab"), (2, "z z"), (2, "z  z"), (None, "a  "), (None, "a b"), (3, "a"), (4, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = exact_dedup.without(docs, exact_dedup.exact_dedup(docs), text="text")
    assert left.columns == docs.columns
    assert Counter(map(tuple, left.collect())) == Counter([(1, "a b"), (2, "z  z"), (None, "a  "), (4, "q")])


def test_empty_tables(spark, no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert minhash_dedup.minhash_dedup(no_docs).count() == 0
    assert exact_dedup.without(no_docs, exact_dedup.exact_dedup(no_docs)).count() == 0
    assert embed_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_words_and_shingles(edge_rows, near_rows):
    texts = [r[1] for r in edge_rows] + [r[1] for r in near_rows]
    found = _text.words(pa.array(texts))
    assert np.diff(found.bounds).tolist() == [len(words(t)) for t in texts]
    known = {}
    for t, w in zip(texts, np.split(found.hashes, found.bounds[1:-1]), strict=True):
        for a, h in zip(words(t), w.tolist(), strict=True):
            assert known.setdefault(a, h) == h
    assert len(set(known.values())) == len(known)
    for width in (3, 5):
        assert [len(s) for s in _text.shingle_sets(found, width)] == [len(shingles(t, width)) for t in texts]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    assert sum(b.num_rows for b in _text.slices(batch, "text", 1000)) == len(texts)


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 1024), (5, 80, 1024), (3, 85, 8)])
def test_near_against_brute_force(monkeypatch, near_docs, near_rows, width, percent, block):
    """Also with blocks that cut every bucket of the hot group."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    sets = {r[0]: shingles(r[1], width) for r in near_rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    wanted = united(sets, links)
    got = {r["doc_id"]: r for r in minhash_dedup.minhash_dedup(near_docs, width, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == wanted
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (wanted[i] == i) for i, r in got.items())


def test_near_edges(edge_docs, edge_rows):
    got = minhash_dedup.minhash_dedup(edge_docs, 3, 85).collect()
    assert len(got) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["n_shingles"] for i in (1, 2, 3, 4, 9)] == [0, 0, 0, 1, 1]
    assert by_id[12]["component_id"] == 4 and by_id[1]["component_id"] == 1 and by_id[3]["kept"]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 1), (20, 21), (22, 22), *[(100, i) for i in range(101, 160)]]
    table = spark.createDataFrame(links, "a long, b long")
    nodes = {n for link in links for n in link}
    wanted = {n: c for n, c in united(nodes, links).items() if n != c}
    assert dict(map(tuple, components(table).collect())) == wanted
    assert components(table.limit(0)).count() == 0


def vectors():
    random = np.random.default_rng(4)
    x = random.normal(size=(900, 16))
    x[300:600] = x[0] + random.normal(size=(300, 16)) * 0.12
    x[600:640] = x[5]
    x[640:700] = x[640:700] * 0 + x[7] * random.uniform(0.5, 3, size=(60, 1))
    labels = [int(i % 5 == 0) if i < 250 or i >= 700 else 1 for i in range(900)]
    rows = [(i, [float(v) for v in x[i]], labels[i]) for i in range(900)]
    return [*rows, (900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[5][1], None), (904, [None, *rows[5][1][1:]], 1), (905, [float("inf")] * 16, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [], 1)]


@pytest.mark.parametrize("shard_rows", [8192, 150, 40])
def test_embeddings_against_brute_force(spark, shard_rows):
    rows = vectors()
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, id long, size int")
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for (i, a, p), (j, b, q) in itertools.combinations(good, 2):
        if p == q and len(a) == len(b):
            cosine = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
            assert abs(cosine - 0.98) > 1e-9
            if cosine >= 0.98:
                links.append((i, j))
    got = {r["vec_id"]: r for r in embed_dedup.embedding_dedup(table, shard_rows=shard_rows).collect()}
    assert len(got) == len(rows)
    degree = Counter(n for link in links for n in link)
    assert all(r["n_links"] == degree[i] for i, r in got.items())
    wanted = united(got, links)
    assert all(r["component_id"] == wanted[i] and r["kept"] == (wanted[i] == i) for i, r in got.items())
    assert [got[i]["n_links"] for i in (900, 901, 902, 903, 904, 905, 906, 907, 908)] == [0] * 6 + [1, 1, 0]


def test_rare_links_in_loose_clusters():
    """Two links in a hundred vectors, in clusters that are far from the threshold: the audit still has links to find, and all but a hundredth are found."""
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 64))[r.integers(0, 60, 3000)] + r.normal(size=(3000, 64)) * 0.9
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    places = r.permutation(3000)[:120]
    for a, b in zip(places[:60], places[60:], strict=True):
        aside = r.normal(size=64)
        aside -= aside @ x[a] * x[a]
        x[b] = 0.983 * x[a] + np.sqrt(1 - 0.983**2) * aside / np.linalg.norm(aside)
    x = np.ascontiguousarray(x.astype(np.float32))
    graph = embed_dedup.Graph.build(x)
    beam, recall = embed_dedup.audited_beam(graph, x, 0.98, True)
    assert recall >= embed_dedup.RECALL and beam <= len(x)
    left, right = embed_dedup.block_links(graph, x, 0.98, True)
    found = {(min(p), max(p)) for p in zip(left.tolist(), right.tolist(), strict=True) if p[0] != p[1]}
    truth = {tuple(p) for p in np.argwhere(np.triu(x @ x.T >= 0.98, 1)).tolist()}
    assert len(truth) >= 60 and len(truth - found) <= 0.01 * len(truth)


def test_probes_are_at_the_threshold():
    x = np.random.default_rng(3).normal(size=(500, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at, near = embed_dedup.probes(x, 0.98)
    assert len(at) == embed_dedup.PROBES and np.allclose((x[at] * near).sum(axis=1), 0.98, atol=1e-5)


def test_graph_recall():
    x = np.random.default_rng(1).normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embed_dedup.Graph.unpack(embed_dedup.Graph.build(x).pack())
    ids, _ = graph.near(x[:200], 64)
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids.tolist(), truth.tolist(), strict=True)]) > 0.9
