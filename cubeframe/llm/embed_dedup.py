"""Near-duplicate embeddings: navigable small-world graphs per shard, audited beams, verified links, components.

Vectors are compared within a label. Equal vectors of a label form classes first; one of each class goes on. The
representatives of a label are dealt to shards of about ``SHARD_ROWS`` by hash, so a label of any size is spread over many tasks; each
shard's hierarchical graph is built once and stored as a row. Then every shard's vectors search every shard of their label (a block of queries against a graph,
each pair of shards once; ``GROUP`` shards meet ``GROUP`` others in a task, so a shard is sent once per group, not once per shard). In a block

* the beam starts at ``BEAM`` and doubles until an audit passes. The audit always has links to find: for ``PROBES`` vectors of the graph, a vector at
  the threshold's cosine from it, in a random direction; and for ``AUDIT`` of the block's queries all links that a brute-force comparison finds. The beam must
  find ``RECALL`` of either. A query whose whole beam is at or above the threshold may have more links than the beam holds and is compared with
  the whole shard, so no number of partners is a cap;
* candidates from 32-bit arithmetic are verified by their cosine in double precision;
* links are reduced to what the result needs: the number of links of each vector, and a spanning forest of the block's links.

The forests of all blocks are united by large-star and small-star.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and vectors with a null label, link with nothing;
vectors of other lengths than the most of their block are compared only with their like; vectors that repeat are links of each other; rows
that repeat an id are reported once each; vectors of any length are taken whole; other columns are not read, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import materialize, ship
from .components import components
from .exact_dedup import equal_classes

SHARD_ROWS = 8192
DEGREE, BUILD_BEAM, BEAM = 12, 48, 32
PROBES, AUDIT, RECALL = 256, 64, 0.99
#: Shards that are in memory together on either side of a task.
GROUP = 4
BATCH = 512
#: How far below the threshold 32-bit candidates are still verified.
SLACK = 1e-4


def _search(x: np.ndarray, layer: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest found for each query by best-first search in a layer (a table of neighbours, -1 for none) from the entries, all queries in step.

    Returns ids (-1 where fewer) and similarities, best first.
    """
    n, width = len(queries), max(beam, entry.shape[1])
    ids = np.full((n, width), -1, np.int32)
    sims = np.full((n, width), -2.0, np.float32)
    ids[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("nd,nkd->nk", queries, x[entry]), -2.0)
    done = np.zeros((n, width), bool)
    done[ids < 0] = True
    seen = np.zeros((n, len(x)), bool)
    rows = np.arange(n)
    for k in range(entry.shape[1]):
        seen[rows, entry[:, k]] |= entry[:, k] >= 0
    live = rows
    while len(live):
        open_sims = np.where(done[live], -3.0, sims[live])
        pick = open_sims.argmax(axis=1)
        going = open_sims[np.arange(len(live)), pick] > -2.5
        live, pick = live[going], pick[going]
        if not len(live):
            break
        done[live, pick] = True
        near = layer[ids[live, pick]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        seen[live[r], near[r, c]] = True
        new = np.full(near.shape, -2.0, np.float32)
        new[r, c] = np.einsum("kd,kd->k", queries[live[r]], x[near[r, c]])
        all_sims = np.concatenate([sims[live], new], axis=1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width] if all_sims.shape[1] > width else np.arange(width)[None, :].repeat(len(live), 0)
        take = np.arange(len(live))[:, None]
        sims[live] = all_sims[take, best]
        ids[live] = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)[take, best]
        done[live] = np.concatenate([done[live], ~fresh], axis=1)[take, best]
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    """A hierarchical graph over unit vectors: ``layers[l]`` is a table of neighbours; the top layers hold few vectors."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x, layers, entry

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 5) -> Graph:
        n = len(x)
        random = np.random.Generator(np.random.PCG64(seed))
        level = np.minimum((-np.log(random.random(n)) / np.log(DEGREE)).astype(int), 6)
        level[0] = level.max(initial=0)
        layers = [np.full((n, DEGREE * (2 if at == 0 else 1)), -1, np.int32) for at in range(level[0] + 1)]
        graph, start = cls(x, layers, 0), 1
        while start < n:
            # A batch no larger than what is there; its members see each other by brute force.
            batch = np.arange(start, min(n, start + min(start, BATCH)))
            entry = np.zeros((len(batch), 1), np.int32)
            peers = x[batch] @ x[batch].T
            for at in range(level[0], -1, -1):
                ids, sims = _search(x, layers[at], x[batch], entry, BUILD_BEAM if at <= level[batch].max() else 1)
                entry = ids[:, :1]
                own = np.flatnonzero(level[batch] >= at)
                if len(own):
                    other = np.where(np.arange(len(batch))[None, :] < own[:, None], peers[own], -2.0)
                    other[:, level[batch] < at] = -2.0
                    near = np.concatenate([ids[own], np.broadcast_to(batch, (len(own), len(batch)))], axis=1)
                    graph._link(at, batch[own], near, np.concatenate([sims[own], other], axis=1))
            start = int(batch[-1]) + 1
        return graph

    def _link(self, at: int, nodes: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
        """Link each node with its nearest that are not nearer to each other, both ways; full tables keep the best by the same rule."""
        layer, x = self.layers[at], self.x
        few = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * DEGREE]
        near, sims = np.take_along_axis(near, few, 1), np.take_along_axis(sims, few, 1)
        chosen = self._diverse(near, sims, DEGREE)
        layer[nodes, :DEGREE] = chosen
        back: dict[int, list[int]] = {}
        for node, row in zip(nodes.tolist(), chosen.tolist(), strict=True):
            for other in row:
                if other >= 0:
                    back.setdefault(other, []).append(node)
        width = layer.shape[1]
        crowded, lists = [], []
        for other, new in back.items():
            have = layer[other][layer[other] >= 0].tolist()
            every = list(dict.fromkeys(have + new))
            if len(every) <= width:
                layer[other, : len(every)] = every
            else:
                crowded.append(other)
                lists.append(every)
        if crowded:
            table = np.full((len(crowded), max(map(len, lists))), -1, np.int32)
            for i, every in enumerate(lists):
                table[i, : len(every)] = every
            sims = np.where(table >= 0, np.einsum("nd,nkd->nk", x[crowded], x[table]), -2.0)
            order = np.argsort(-sims, axis=1, kind="stable")
            layer[crowded] = self._diverse(np.take_along_axis(table, order, 1), np.take_along_axis(sims, order, 1), width)

    def _diverse(self, near: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of each row (best first) those that are nearer to the node than to any chosen before; free places go to the best of the rest."""
        n, k = near.shape
        chosen = np.full((n, width), -1, np.int32)
        count = np.zeros(n, int)
        inner = np.einsum("nid,njd->nij", self.x[near], self.x[near])
        picked = np.zeros((n, k), bool)
        for j in range(k):
            hidden = (picked & (inner[:, j, :] > sims[:, j, None])).any(axis=1)
            take = (sims[:, j] > -1.5) & ~hidden & (count < width)
            picked[take, j] = True
            count[take] += 1
        rest = np.where(sims > -1.5, np.where(picked, 10.0, 0.0) + sims, -5.0)
        best = np.argsort(-rest, axis=1, kind="stable")[:, :width]
        ids = np.where(np.take_along_axis(rest, best, 1) > -4, np.take_along_axis(near, best, 1), -1)
        chosen[:, : ids.shape[1]] = ids
        return chosen

    def near(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(queries), 1), self.entry, np.int32)
        for layer in self.layers[:0:-1]:
            entry = _search(self.x, layer, queries, entry, 1)[0][:, :1]
        return _search(self.x, self.layers[0], queries, entry, beam)

    def pack(self) -> bytes:
        head = np.array([len(self.x), self.x.shape[1], len(self.layers), self.entry], np.int64).tobytes()
        return head + self.x.tobytes() + b"".join(layer.tobytes() for layer in self.layers)

    @classmethod
    def unpack(cls, data: bytes) -> Graph:
        n, d, layers, entry = np.frombuffer(data, np.int64, 4).tolist()
        at = 32
        x = np.frombuffer(data, np.float32, n * d, at).reshape(n, d)
        at += 4 * n * d
        out = []
        for i in range(layers):
            width = DEGREE * (2 if i == 0 else 1)
            out.append(np.frombuffer(data, np.int32, n * width, at).reshape(n, width))
            at += 4 * n * width
        return cls(x, out, entry)


def probes(x: np.ndarray, least: float, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """The places of some vectors, and for each a unit vector at the cosine ``least`` from it."""
    random = np.random.Generator(np.random.PCG64(seed))
    at = np.sort(random.permutation(len(x))[:PROBES])
    own = x[at].astype(np.float64)
    aside = random.normal(size=own.shape)
    aside -= (aside * own).sum(axis=1, keepdims=True) * own
    norm = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.divide(aside, norm, out=np.zeros_like(aside), where=norm > 1e-9)
    near = least * own + np.sqrt(max(0.0, 1 - least * least)) * aside
    return at, (near / np.linalg.norm(near, axis=1, keepdims=True)).astype(np.float32)


def audited_beam(graph: Graph, queries: np.ndarray, floor: float, same: bool) -> tuple[int, float]:
    """The beam that passes the audit (all vectors of the graph if none does), and the recall that it had."""
    n = len(graph.x)
    sample = np.arange(0, len(queries), max(1, len(queries) // AUDIT))[:AUDIT]
    truth = queries[sample] @ graph.x.T >= floor
    if same:
        truth[np.arange(len(sample)), sample] = False
    at, planted = probes(graph.x, floor)
    beam = min(BEAM, n)
    while beam < n:
        ids, sims = graph.near(queries[sample], beam)
        hit = (ids >= 0) & (sims >= floor)
        found = np.zeros_like(truth)
        r, c = np.nonzero(hit)
        found[r, ids[r, c]] = True
        full = hit.all(axis=1)
        wanted = int(truth[~full].sum())
        recall = int((found & truth)[~full].sum()) / wanted if wanted else 1.0
        # A probe whose whole beam is above the threshold would be compared with all.
        ids, sims = graph.near(planted, beam)
        reached = (ids == at[:, None]).any(axis=1) | (sims >= floor).all(axis=1)
        recall = min(recall, float(reached.mean()))
        if recall >= RECALL:
            return beam, recall
        beam = min(n, beam * 2)
    return n, 1.0


def block_links(graph: Graph, queries: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (query, vector of the graph) with a 32-bit cosine of about ``least`` or more, by beams that pass the audit."""
    floor, n = least - SLACK, len(graph.x)
    beam, _ = audited_beam(graph, queries, floor, same)
    left, right = [], []
    for start in range(0, len(queries), BATCH):
        own = np.arange(start, min(start + BATCH, len(queries)))
        if beam < n:
            ids, sims = graph.near(queries[own], beam)
            hit = (ids >= 0) & (sims >= floor)
            full = hit.all(axis=1)
            r, c = np.nonzero(hit & ~full[:, None])
            left.append(own[r])
            right.append(ids[r, c])
            own = own[full]
        r, c = np.nonzero(queries[own] @ graph.x.T >= floor)
        left.append(own[r])
        right.append(c)
    return np.concatenate([*left, np.zeros(0, int)]).astype(int), np.concatenate([*right, np.zeros(0, int)]).astype(int)


def _forest(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the links those that join two parts of the links before."""
    above: dict[int, int] = {}

    def root(v: int) -> int:
        above.setdefault(v, v)
        while above[v] != v:
            above[v] = above[above[v]]
            v = above[v]
        return v

    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(u), root(v)
        if p != q:
            above[max(p, q)] = min(p, q)
            yield u, v


def _unit(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index():
    schema = pa.schema([("label", pa.string()), ("shard", pa.int32()), ("rows", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("exact", pa.binary()), ("graph", pa.binary())])

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        unit = _unit(table.column("vector"))
        ids, sizes = table.column("id").to_numpy().astype(np.int64), table.column("size").to_numpy().astype(np.int64)
        graph = Graph.build(np.ascontiguousarray(unit.astype(np.float32)))
        row = [table.column("label")[0].as_py(), table.column("shard")[0].as_py(), len(ids), ids.tobytes(), sizes.tobytes(), unit.tobytes(), graph.pack()]
        return pa.table([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    return work, "label string, shard int, rows long, ids binary, sizes binary, exact binary, graph binary"


def _pair(own: dict, far: dict, least: float, same: bool) -> list[tuple]:
    """The rows of one pair of shards: (vector, null, gain in links) and (vector, vector, 0) for the links of a spanning forest."""
    ids, weight = np.frombuffer(own["ids"], np.int64), np.frombuffer(own["sizes"], np.int64)
    unit = np.frombuffer(own["exact"], np.float64).reshape(len(ids), -1)
    far_ids, far_weight = np.frombuffer(far["ids"], np.int64), np.frombuffer(far["sizes"], np.int64)
    far_unit = np.frombuffer(far["exact"], np.float64).reshape(len(far_ids), -1)
    q, v = block_links(Graph.unpack(own["graph"]), far_unit.astype(np.float32), least, same)
    if same:
        pairs = np.unique(np.stack([np.minimum(q, v), np.maximum(q, v)], axis=1)[q != v], axis=0)
        q, v = pairs[:, 0], pairs[:, 1]
    ok = np.concatenate([np.einsum("kd,kd->k", far_unit[q[s : s + 65536]], unit[v[s : s + 65536]]) >= least for s in range(0, len(q), 65536)] or [np.zeros(0, bool)])
    q, v = q[ok], v[ok]
    counts: dict[int, int] = {}
    for nodes, gains in ((far_ids[q], weight[v]), (ids[v], far_weight[q])):
        at, place = np.unique(nodes, return_inverse=True)
        for node, gain in zip(at.tolist(), np.bincount(place, gains, len(at)).astype(np.int64).tolist(), strict=True):
            counts[node] = counts.get(node, 0) + gain
    return [(n, None, k) for n, k in counts.items()] + [(a, b, 0) for a, b in _forest(far_ids[q], ids[v])]


def _compare(least: float):
    """Of two groups of shards all pairs, of a group with itself each pair once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def work(table: pa.Table) -> pa.Table:
        shards = sorted(table.to_pylist(), key=lambda r: r["shard"])
        g, h = table.column("g")[0].as_py(), table.column("h")[0].as_py()
        rows: list[tuple] = []
        for one in (r for r in shards if r["shard"] // GROUP == g):
            for two in (r for r in shards if r["shard"] // GROUP == h):
                if one["shard"] <= two["shard"]:
                    rows += _pair(one, two, least, one["shard"] == two["shard"])
        _text.release()
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, schema=schema)

    return work, "a long, b long, links long"


def embedding_dedup(vectors: DataFrame, least: float = 0.98, shard_rows: int = SHARD_ROWS, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    # The length stands in the label: vectors are compared with vectors of their length only.
    space = F.concat(F.size("vector").cast("string"), F.lit(":"), F.col("label"))
    vector_ = F.transform("vector", lambda v: v + F.lit(0.0))  # -0.0 becomes 0.0
    rows = materialize(rows.select("id", F.when(usable, space).alias("label"), F.when(usable, vector_).alias("vector")), "vectors")
    good, alone = rows.where("label IS NOT NULL"), rows.where("label IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    key = F.sha2(F.concat(F.col("label"), F.lit("\n"), F.to_json("vector")).cast("binary"), 256)
    classes = materialize(equal_classes(materialize(good.select("id", key.alias("key"), F.lit(0).alias("rank")), "keys")).select("id", F.col("keep_id").alias("class_id"), "group_size", "kept"), "classes")
    first = classes.where("kept").select("id", F.col("group_size").alias("size"))
    points = good.join(first, "id").dropDuplicates(["id"])
    per_label = good.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / shard_rows)).cast("int").alias("shards"))
    dealt = points.join(per_label, "label").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    work, types = _index()
    index = materialize(dealt.select("id", "label", "vector", "size", "shard").groupBy("label", "shard").applyInArrow(work, types), "index")
    # A shard goes to every pair of groups that its own is in.
    groups = index.groupBy("label").agg((F.call_function("div", F.max("shard"), F.lit(GROUP)) + 1).cast("int").alias("groups"))
    own = F.call_function("div", F.col("shard"), F.lit(GROUP)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda o: F.struct(F.least(own, o).alias("g"), F.greatest(own, o).alias("h")))
    met = index.join(groups, "label").select("label", "shard", "ids", "sizes", "exact", "graph", F.explode(pairs).alias("at")).select("*", "at.*").drop("at")
    check, kind = _compare(least)
    found = materialize(met.groupBy("label", "g", "h").applyInArrow(check, kind), "links")
    linked = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    placed = (
        classes.join(counts, "class_id", "left")
        .join(linked.withColumnsRenamed({"node": "class_id", "component": "component_id"}), "class_id", "left")
        .select("id", (F.col("group_size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    )
    return placed.unionByName(alone).select(F.col("id").alias(ident), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
