"""Page graphs: subgraph sampling, tensors, spectral positions, augmentation, summaries, embeddings."""

from __future__ import annotations

import collections
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import few_rows, spread

from . import markup
from .sampling import hash_int, hash_share


@dataclass(frozen=True)
class GraphParams:
    max_depth: int = 10
    max_nodes: int = 750
    max_neighbours: int = 30
    #: Subgraphs of a page; the sampling loop of a page stops after them.
    max_subgraphs: int = 11
    #: How many start nodes a subgraph's list has: text owners, or all nodes.
    starts: int = 64
    all_nodes: bool = False
    #: Whether every covered node is done (genre pages) or only those drawn as starts.
    drop_covered: bool = False
    seed: int = 0


def adjacency(root: markup.Element) -> dict[int, list[tuple[int, int]]]:
    """Neighbours of each element with the edge type: 0 to its parent, 1 to a child."""
    out: dict[int, list[tuple[int, int]]] = {e.number: [] for e in markup.elements(root)}
    for e in markup.elements(root):
        if e.parent.number >= 0:
            out[e.number].append((e.parent.number, 0))
            out[e.parent.number].append((e.number, 1))
    return out


def page_rng(page_id: object, seed: int, *more: object) -> np.random.Generator:
    """A generator that depends on the page alone, so results do not depend on partitions."""
    digest = hashlib.blake2b(repr((page_id, seed, *more)).encode(), digest_size=8).digest()
    return np.random.default_rng(int.from_bytes(digest, "little"))


def expand(links: dict[int, list[tuple[int, int]]], start: int, p: GraphParams, rng: np.random.Generator) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Breadth-first subgraph around `start`: its nodes in order of discovery and its edges (src, dst, type).

    A node keeps at most max_neighbours edges, those to nodes already found first and a random choice of the
    rest; an edge that one end drops is hidden from the other. Nodes at max_depth are not expanded; beyond
    max_nodes a random choice of a level's new nodes stays.
    """
    found, order, hidden = {start}, [start], set()
    level = [start]
    for _ in range(p.max_depth):
        fresh: list[int] = []
        for node in level:
            seen = [x for x, _ in links[node] if x in found and (node, x) not in hidden]
            new = [x for x, _ in links[node] if x not in found and (node, x) not in hidden]
            room = max(p.max_neighbours - len(seen), 0)
            if len(new) > room:
                new = [new[i] for i in sorted(rng.choice(len(new), room, replace=False))] if room else []
            kept = {*seen[: p.max_neighbours], *new}
            for x, _ in links[node]:
                if x not in kept:
                    hidden |= {(node, x), (x, node)}
            for x in new:
                if x not in found:
                    found.add(x)
                    fresh.append(x)
        over = len(order) + len(fresh) - p.max_nodes
        if over > 0:
            gone = {fresh[i] for i in rng.choice(len(fresh), over, replace=False)}
            found -= gone
            fresh = [x for x in fresh if x not in gone]
        order += fresh
        level = fresh
        if not level:
            break
    edges = [(a, b, kind) for a in order for b, kind in links[a] if b in found and (a, b) not in hidden]
    return order, edges


def tensor(order: list[int], edges: list[tuple[int, int, int]], p: GraphParams, edge_types: int = 2) -> np.ndarray:
    """adj (max_nodes, edge_types + 1, max_neighbours), numbers by place in `order`, -1 for none; the last
    type is the node itself."""
    place = {x: k for k, x in enumerate(order)}
    out = np.full((p.max_nodes, edge_types + 1, p.max_neighbours), -1, np.int32)
    fill: dict[tuple[int, int], int] = {}
    for a, b, kind in edges:
        n = fill.get((a, kind), 0)
        if n < p.max_neighbours:
            out[place[a], kind, n] = place[b]
            fill[a, kind] = n + 1
    for k in range(len(order)):
        out[k, edge_types, 0] = k
    return out


def page_subgraphs(root: markup.Element, page_id: object, p: GraphParams) -> Iterator[tuple[int, list[int], list[int], list[tuple[int, int, int]]]]:
    """(start, start list, nodes, edges) until every start node is covered or the cap is reached."""
    links = adjacency(root)
    if p.all_nodes:
        left = list(links)
    else:
        owners = {x.parent.number for x, _ in markup.texts(root) if x.text.split() and x.parent.number >= 0}
        left = sorted(owners)
    rng, done = page_rng(page_id, p.seed), []
    for _ in range(p.max_subgraphs):
        if not left:
            return
        start = left[int(rng.integers(len(left)))]
        order, edges = expand(links, start, p, rng)
        inside = set(order)
        covered = [x for x in left if x in inside]
        listed = [covered[i] for i in sorted(rng.choice(len(covered), min(p.starts, len(covered)), replace=False))]
        spare = [x for x in done if x in inside]
        listed += [spare[i] for i in sorted(rng.choice(len(spare), min(p.starts - len(listed), len(spare)), replace=False))]
        gone = inside if p.drop_covered else {*listed, start}
        done += [x for x in left if x in gone]
        left = [x for x in left if x not in gone]
        yield start, listed, order, edges


def subgraphs(pages: DataFrame, p: GraphParams = GraphParams(), with_tensor: bool = False) -> DataFrame:
    """page_id, sub (its number), start, node_list, nodes, edges; with_tensor adds adj, flattened."""
    edge = pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("type_id", pa.int32())]))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), edge]
    names = ["page_id", "sub", "start", "node_list", "nodes", "edges"]
    schema = "page_id long, sub int, start int, node_list array<int>, nodes array<int>, edges array<struct<src: int, dst: int, type_id: int>>"
    if with_tensor:
        kinds, names, schema = [*kinds, pa.list_(pa.int32())], [*names, "adj"], schema + ", adj array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for k, (start, listed, order, edges) in enumerate(page_subgraphs(markup.parse(html.as_py()), page_id, p)):
                    row = (page_id, k, start, listed, order, [{"src": a, "dst": b, "type_id": t} for a, b, t in edges])
                    rows.append((*row, tensor(order, edges, p).ravel().tolist()) if with_tensor else row)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return spread(pages.select("page_id", "html")).mapInArrow(run, schema)


def node_subgraphs(pages: DataFrame, labelled: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """One subgraph around each labelled node: page_id, node_id, label, nodes. labelled: page_id, node_id, label."""
    wanted = labelled.groupBy("page_id").agg(F.collect_list(F.struct("node_id", "label")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, html, some in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                links, rows = adjacency(markup.parse(html.as_py())), []
                for x in sorted(some, key=lambda x: x["node_id"]):
                    if x["node_id"] in links:
                        rows.append((page_id, x["node_id"], x["label"], expand(links, x["node_id"], p, page_rng(page_id, p.seed, x["node_id"]))[0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32())])], ["page_id", "node_id", "label", "nodes"])

    return pages.select("page_id", "html").join(wanted, "page_id").mapInArrow(run, "page_id long, node_id int, label string, nodes array<int>")


def normalised_laplacian(n: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    a = np.zeros((n, n))
    for x, y in pairs:
        a[x, y] = a[y, x] = 1.0
    d = a.sum(axis=1)
    with np.errstate(divide="ignore"):
        s = np.where(d > 0, 1 / np.sqrt(d), 0.0)
    return np.diag((d > 0).astype(float)) - s[:, None] * a * s[None, :]


def _tree_vectors(n: int, pairs: list[tuple[int, int]], k: int, shift: float = 1e-3, blocks: int = 60) -> np.ndarray | None:
    """The k lowest eigenvectors of the normalised Laplacian of a forest without its matrix: a block Krylov space of
    (L + shift)^-1, each solve by eliminating leaves level by level. None if the graph has a cycle or it does not converge."""
    links: list[list[int]] = [[] for _ in range(n)]
    edges = {(min(e), max(e)) for e in pairs if e[0] != e[1]}
    for a, b in edges:
        links[a].append(b)
        links[b].append(a)
    up, level, n_roots = np.full(n, -1), np.full(n, -1), 0
    for root in range(n):
        if level[root] < 0:
            n_roots, level[root], queue = n_roots + 1, 0, [root]
            for x in queue:
                for y in links[x]:
                    if level[y] < 0:
                        level[y], up[y] = level[x] + 1, x
                        queue.append(y)
    if len(edges) != n - n_roots:
        return None
    degree = np.array([len(x) for x in links], float)
    has_up = up >= 0
    w = np.zeros(n)
    w[has_up] = -1 / np.sqrt(degree[has_up] * degree[up[has_up]])
    own = (degree > 0).astype(float)
    steps = [np.flatnonzero(level == d) for d in range(1, level.max() + 1)]
    pivot = own + shift
    for at in reversed(steps):
        np.subtract.at(pivot, up[at], w[at] ** 2 / pivot[at])

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for at in reversed(steps):
            np.subtract.at(x, up[at], (w[at] / pivot[at])[:, None] * x[at])
        x /= pivot[:, None]
        for at in steps:
            x[at] -= (w[at] / pivot[at])[:, None] * x[up[at]]
        return x

    def times(x: np.ndarray) -> np.ndarray:
        out = own[:, None] * x
        out[has_up] += w[has_up, None] * x[up[has_up]]
        np.add.at(out, up[has_up], w[has_up, None] * x[has_up])
        return out

    block = np.linalg.qr(np.random.default_rng(0).normal(size=(n, min(k + 4, n))))[0]
    space = block
    for step in range(1, blocks + 1):
        block = solve(block)
        for _ in range(2):
            block = block - space @ (space.T @ block)
            block = np.linalg.qr(block)[0]
        space = np.concatenate((space, block), axis=1)
        if step % 5 == 0 or space.shape[1] + block.shape[1] > n:
            lx = times(space)
            values, small = np.linalg.eigh(space.T @ lx)
            found = space @ small[:, :k]
            if np.abs(lx @ small[:, :k] - found * values[:k]).max() < 1e-9:
                return found
            if space.shape[1] + block.shape[1] > n:
                return None
    return None


def spectral_positions(n: int, pairs: list[tuple[int, int]], k: int, most: int = 1500) -> np.ndarray:
    """The k eigenvectors after the first of the normalised Laplacian, by rising eigenvalue, each with its
    largest entry positive; columns beyond the graph's size are 0. A tree of over `most` nodes, as pages are, is
    solved without a dense matrix; other graphs always with one."""
    out = np.zeros((n, k))
    if n > 1:
        vectors = _tree_vectors(n, pairs, k + 1) if n > most else None
        if vectors is None:
            _, vectors = np.linalg.eigh(normalised_laplacian(n, pairs))
        some = vectors[:, 1 : k + 1]
        some = some * np.sign(some[np.abs(some).argmax(axis=0), np.arange(some.shape[1])])
        out[:, : some.shape[1]] = some
    return out


def laplacian_positions(pages: DataFrame, k: int = 8) -> DataFrame:
    """page_id, node_id, eigen (array of k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = markup.elements(markup.parse(html.as_py()))
                if found:
                    x = spectral_positions(len(found), [(e.number, e.parent.number) for e in found if e.parent.number >= 0], k)
                    yield pa.RecordBatch.from_arrays([pa.array([page_id] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["page_id", "node_id", "eigen"])

    return spread(pages.select("page_id", "html")).mapInArrow(run, "page_id long, node_id int, eigen array<double>")


def flip_signs(vector: Column, key: Column, seed: int = 0) -> Column:
    """Each entry's sign flipped or not, by key and place: the same for all nodes of a graph."""
    return F.transform(vector, lambda x, i: F.when(hash_int(F.concat_ws(":", key.cast("string"), i.cast("string")), seed) % 2 == 0, x).otherwise(-x))


def pick_nodes(nodes: Column, key: Column, draws: int, seed: int = 0) -> Column:
    """`draws` hashed members of an array, with replacement."""
    at = lambda i: (hash_int(F.concat_ws(":", key.cast("string"), i.cast("string")), seed) % F.size(nodes) + 1).cast("int")
    return F.when(F.size(nodes) > 0, F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.element_at(nodes, at(i))))


def mask_features(features: Column, key: Column, share: float, seed: int = 0) -> Column:
    """The whole vector is zeroed for a hashed share of keys."""
    return F.when(hash_share(key, seed) < share, F.transform(features, lambda x: x * 0)).otherwise(features)


def slice_features(features: Column, offset: int, length: int) -> Column:
    return F.slice(features, offset + 1, length)


def group_hash(groups: DataFrame, column: str = "grp") -> DataFrame:
    """`group_hash`: the first eight bytes of SHAKE-256 of the name, little-endian and signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [None if x is None else int.from_bytes(hashlib.shake_256(x.encode()).digest(8), "little", signed=True) for x in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [column, "group_hash"])

    return groups.select(column).mapInArrow(run, f"`{column}` string, group_hash long")


def lexrank(sentences: list[list[str]], threshold: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Centrality of sentences (lists of words): stationary shares of a walk over cosine links of tf-idf
    vectors; sentences without a link keep to themselves."""
    n = len(sentences)
    if not n:
        return np.zeros(0)
    number: dict[str, int] = {}
    counts = [collections.Counter(number.setdefault(w, len(number)) for w in s) for s in sentences]
    of = np.repeat(np.arange(n), [len(c) for c in counts])
    word = np.array([w for c in counts for w in c], np.int64)
    tf = np.array([x for c in counts for x in c.values()], float)
    v = tf * (np.log((1 + n) / (1 + np.bincount(word, minlength=len(number)))) + 1)[word]
    size = np.sqrt(np.bincount(of, weights=v * v, minlength=n))
    v = v / np.maximum(size, 1e-12)[of]
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    step = max(1, min(n, (1 << 21) // max(len(of), 1)))  # sentences whose similarities to all are held at once
    packed = []
    for lo in range(0, n, step):
        rows = np.zeros((min(step, n - lo), max(len(number), 1)))
        own = (of >= lo) & (of < lo + step)
        rows[of[own] - lo, word[own]] = v[own]
        near = np.zeros((n, len(rows)), bool)
        if len(of):
            near[of[starts]] = np.add.reduceat(v[:, None] * rows.T[word], starts, axis=0) > threshold
        near[np.arange(lo, lo + len(rows)), np.arange(len(rows))] = True
        packed.append(np.packbits(near.T, axis=1))  # a bit a pair
    bits = np.concatenate(packed)
    blocks = [(lo, min(lo + 512, n)) for lo in range(0, n, 512)]
    unpacked = lambda lo, hi: np.unpackbits(bits[lo:hi], axis=1, count=n).astype(float)
    held = unpacked(0, n) if n <= 512 else None  # one block: unpacked once for all rounds
    links = unpacked if held is None else lambda lo, hi: held
    degree = np.concatenate([links(lo, hi).sum(axis=1) for lo, hi in blocks])
    share = np.full(n, 1 / n)
    for _ in range(rounds):
        after = sum((share[lo:hi] / degree[lo:hi]) @ links(lo, hi) for lo, hi in blocks)
        if np.abs(after - share).max() < 1e-10:
            break
        share = after
    return share * n


def summarise(docs: DataFrame, k: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The k most central sentences of each whole text, in their order."""
    from weftline.functions.text import sentences

    def best(some: list[str]) -> list[str]:
        score = lexrank([s.lower().split() for s in some])
        return [some[i] for i in sorted(np.argsort(-score, kind="stable")[:k])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            found = [" ".join(best(x or [])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], [id_column, "summary"])

    kind = docs.schema[id_column].dataType.simpleString()
    return spread(docs.select(id_column, text_column)).select(id_column, sentences(F.col(text_column)).alias("s")).mapInArrow(run, f"`{id_column}` {kind}, summary string")


def hash_embeddings(df: DataFrame, key: list[str], words: Column, dim: int = 512) -> DataFrame:
    """key, vec: counts of md5 buckets of words, scaled to length 1; the stand-in for a sentence encoder.
    One explode and two aggregations, whatever the length of a text."""
    bucket = (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    counts = df.select(*key, F.explode(words).alias("w")).groupBy(*key, bucket.alias("b")).agg(F.count("*").cast("double").alias("n"))
    vectors = counts.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("size"), F.lit(0.0)))
    found = vectors.select(*key, dense.alias("vec"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return df.select(*key).distinct().join(found, key, "left").select(*key, F.coalesce("vec", zero).alias("vec"))


def hash_vector(words: Column, dim: int = 512) -> Column:
    """What `hash_embeddings` gives for one row's words, as an expression: no row is exploded, shuffled or joined."""
    from weftline.functions.css import let

    zero = F.lit(0.0)
    buckets = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dim).cast("int"))
    counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(own, lambda b: b == i)).cast("double"))
    scaled = lambda n: let(F.sqrt(F.aggregate(n, zero, lambda s, x: s + x * x)), lambda size: F.transform(n, lambda x: x / size))
    return F.when(F.size(words) > 0, let(buckets, lambda own: let(counts(own), scaled))).otherwise(F.array_repeat(zero, dim))


def visual_words(attrs: Column, strict_reference: bool = False) -> tuple[Column, Column]:
    """Texts of the class and id attributes; strict puts a blank between an id's characters."""
    get = lambda k: F.coalesce(F.try_element_at(attrs, F.lit(k)), F.lit(""))
    own_id = get("id")
    return F.array_join(F.filter(F.split(get("class"), r"\s+"), lambda w: w != ""), " "), F.array_join(F.split(own_id, ""), " ") if strict_reference else own_id


def box_size(attrs: Column, style: Column, name: str) -> Column:
    """Width or height as size features, from the attribute, else the style."""
    from weftline.functions.css import size_features, style_value

    given = F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(""))
    return size_features(F.when(given != "", given).otherwise(style_value(style, name)))
