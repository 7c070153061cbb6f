"""Forward passes of graph and sequence layers over one graph, in numpy, and a Spark wrapper per page.

A graph is x (n nodes by features) and `edges`, one (m, 2) array of (node, neighbour) a type. Weights are
given, never trained here. A node without any edge keeps its input where widths agree, else it gets 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import few_rows

Edges = list[np.ndarray]


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def quick_gelu(x: np.ndarray) -> np.ndarray:
    return x * sigmoid(1.702 * x)


def layer_norm(x: np.ndarray, gain: np.ndarray | float = 1.0, bias: np.ndarray | float = 0.0, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * gain + bias


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def degrees(n: int, edges: Edges) -> np.ndarray:
    """Per type and node, one at least."""
    return np.stack([np.maximum(np.bincount(e[:, 0], minlength=n), 1) for e in edges])


def _gather(values: np.ndarray, e: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]))
    np.add.at(out, e[:, 0], values[e[:, 1]])
    return out


def _without_edges(out: np.ndarray, x: np.ndarray, edges: Edges) -> np.ndarray:
    touched = np.zeros(len(x), bool)
    for e in edges:
        touched[e[:, 0]] = True
    out[~touched] = x[~touched] if out.shape[1] == x.shape[1] else 0
    return out


def gcn(x: np.ndarray, edges: Edges, weights: list[np.ndarray], how: str = "mean", act: Callable = relu) -> np.ndarray:
    """Per type a dense map, then mean, sum or max over neighbours; types are summed (max: the largest)."""
    n, parts = len(x), []
    for e, w, d in zip(edges, weights, degrees(n, edges)):
        h = x @ w
        if how == "max":
            part = np.full((n, w.shape[1]), -1e9)
            np.maximum.at(part, e[:, 0], h[e[:, 1]])
        else:
            part = _gather(h, e, n) / (d[:, None] if how == "mean" else 1)
        parts.append(part)
    out = np.max(parts, axis=0) if how == "max" else np.sum(parts, axis=0)
    return _without_edges(act(out), x, edges)


def sage(x: np.ndarray, edges: Edges, weight: np.ndarray, how: str = "mean", act: Callable = relu) -> np.ndarray:
    """Neighbours aggregated by type, types side by side, one dense map."""
    n, parts = len(x), []
    for e, d in zip(edges, degrees(n, edges)):
        if how == "max":
            part = np.full(x.shape, -1e9)
            np.maximum.at(part, e[:, 0], x[e[:, 1]])
            part[part == -1e9] = 0
        else:
            part = _gather(x, e, n) / (d[:, None] if how == "mean" else 1)
        parts.append(part)
    return _without_edges(act(np.concatenate(parts, axis=1) @ weight), x, edges)


def gat(x: np.ndarray, edges: Edges, weights: list[np.ndarray], attend: list[np.ndarray], how: str = "mean", per_type: bool = False, act: Callable = relu) -> np.ndarray:
    """Attention over neighbours: leaky-ReLU logits of (node, neighbour), softmax over all types' neighbours or
    over each type's; `sum` scales by the degree. Heads come by calling it with each head's weights."""
    n = len(x)
    maps = [x @ w for w in weights]
    logits = [(lambda z: np.where(z > 0, z, 0.2 * z))(h[e[:, 0]] @ a[: h.shape[1]] + h[e[:, 1]] @ a[h.shape[1] :]) for e, h, a in zip(edges, maps, attend)]
    groups = [[k] for k in range(len(edges))] if per_type else [list(range(len(edges)))]
    out = np.zeros((n, weights[0].shape[1]))
    for group in groups:
        rows = np.concatenate([edges[k][:, 0] for k in group])
        z = np.concatenate([logits[k] for k in group])
        values = np.concatenate([maps[k][edges[k][:, 1]] for k in group])
        top = np.full(n, -200.0)
        np.maximum.at(top, rows, z)
        w = np.exp(z - top[rows])
        total = np.bincount(rows, weights=w, minlength=n)
        part = np.zeros_like(out)
        np.add.at(part, rows, values * (w / total[rows])[:, None])
        if how == "sum":
            part *= np.bincount(rows, minlength=n)[:, None]
        out += part
    return _without_edges(act(out), x, edges)


def multi_head(x: np.ndarray, edges: Edges, heads: list[tuple[list[np.ndarray], list[np.ndarray]]], **options) -> np.ndarray:
    return np.concatenate([gat(x, edges, w, a, **options) for w, a in heads], axis=1)


def gated(x: np.ndarray, edges: Edges, weights: list[np.ndarray], gates: list[np.ndarray], own_gate: np.ndarray) -> np.ndarray:
    """Sums of neighbours' maps under sigmoid gates of both ends."""
    out = np.zeros((len(x), weights[0].shape[1]))
    for e, w, g in zip(edges, weights, gates):
        np.add.at(out, e[:, 0], sigmoid(x[e[:, 0]] @ own_gate + x[e[:, 1]] @ g) * (x[e[:, 1]] @ w))
    return _without_edges(out, x, edges)


def self_loop(x: np.ndarray, weight: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
    out = x @ weight
    if valid is not None:
        out[~valid] = 0
    return out


def residual_block(x: np.ndarray, conv: Callable[[np.ndarray], np.ndarray], own: np.ndarray, residual: bool = True) -> np.ndarray:
    h = relu(layer_norm(conv(x)))
    h = layer_norm(self_loop(h, own))
    return relu(h + x) if residual and h.shape == x.shape else relu(h)


def gru(x: np.ndarray, h: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    z, r, n = np.split(x @ w + b, 3, axis=1)
    uz, ur, un = np.split(u, 3, axis=1)
    z, r = sigmoid(z + h @ uz), sigmoid(r + h @ ur)
    return (1 - z) * np.tanh(n + (r * h) @ un) + z * h


def lstm(x: np.ndarray, h: np.ndarray, c: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, f, g, o = np.split(x @ w + h @ u + b, 4, axis=1)
    c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
    return sigmoid(o) * np.tanh(c), c


def recurrent(x: np.ndarray, layers: list[Callable[[np.ndarray], np.ndarray]], cell: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Layers in turn, with a cell over layers that keeps each node's state."""
    state = np.zeros_like(x)
    for layer in layers:
        state = cell(layer(x), state)
        x = state
    return state


def attention(x: np.ndarray, w_qkv: np.ndarray, w_out: np.ndarray, heads: int, mask: np.ndarray | None = None) -> np.ndarray:
    n, e = x.shape
    q, k, v = (a.reshape(n, heads, e // heads).transpose(1, 0, 2) for a in np.split(x @ w_qkv, 3, axis=1))
    z = q @ k.transpose(0, 2, 1) / np.sqrt(e // heads)
    if mask is not None:
        z = np.where(mask[None, None, :], z, -1e9)
    return (softmax(z) @ v).transpose(1, 0, 2).reshape(n, e) @ w_out


def transformer(x: np.ndarray, embed: np.ndarray, cls: np.ndarray, blocks: list[dict[str, np.ndarray]], heads: int) -> tuple[np.ndarray, np.ndarray]:
    """Embedded nodes with a learned last vector through pre-norm attention blocks: (nodes, summary)."""
    h = np.vstack((x @ embed, cls[None, :]))
    for b in blocks:
        h = h + attention(layer_norm(h), b["qkv"], b["out"], heads)
        h = h + quick_gelu(layer_norm(h) @ b["up"]) @ b["down"]
    return h[:-1], h[-1]


def readout(x: np.ndarray, valid: np.ndarray, how: str) -> np.ndarray:
    """sum, mean or max over nodes, where invalid rows count as zeros for sum and max."""
    kept = np.where(valid[:, None], x, 0)
    if how == "max":
        return kept.max(axis=0)
    return kept.sum(axis=0) / (max(valid.sum(), 1) if how == "mean" else 1)


def link_score(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    u, v = x[a], x[b]
    size = np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1)
    return np.where(size > 0, (u * v).sum(axis=1) / np.maximum(size, 1e-12), 0.0)


def node_classes(x: np.ndarray, nodes: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return softmax(x[nodes] @ weight + bias)


def node_binary(x: np.ndarray, nodes: np.ndarray, weight: np.ndarray, bias: float, both: bool = False) -> np.ndarray:
    p = sigmoid(x[nodes] @ weight + bias)
    return np.stack((1 - p, p), axis=1) if both else p


def run_per_page(nodes: DataFrame, edges: DataFrame, layer: Callable[[np.ndarray, Edges], np.ndarray], edge_types: int = 2) -> DataFrame:
    """Applies a layer to every page: nodes (page_id, node_id, x), edges (page_id, src, dst, type_id) to
    page_id, node_id, y. Both sides are grouped by page in one shuffle each; a page is one row in Python, and its nodes and
    edges are read from Arrow's buffers, 64 pages at a time."""
    n = nodes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "x"))).alias("n"))
    e = edges.groupBy("page_id").agg(F.collect_list(F.struct("type_id", "src", "dst")).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            pages, ids, found = [], [], []
            for page, some, links in zip(*(batch.column(k) for k in range(3))):
                own = some.values.field("node_id").to_numpy()
                x = np.array(some.values.field("x").to_pylist(), float)
                src, dst, kind = (links.values.field(f).to_numpy() if links.is_valid else np.zeros(0, np.int32) for f in ("src", "dst", "type_id"))
                known = np.isin(src, own) & np.isin(dst, own)
                ends = np.stack((np.searchsorted(own, src[known]), np.searchsorted(own, dst[known])), axis=1).astype(np.int64)
                kind, order = kind[known], np.lexsort((ends[:, 1], ends[:, 0]))
                y = layer(x, [ends[order[kind[order] == k]] for k in range(edge_types)])
                pages += [page.as_py()] * len(own)
                ids.append(own)
                found += list(y)
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(np.concatenate(ids), pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["page_id", "node_id", "y"])

    return n.join(e, "page_id", "left").mapInArrow(run, "page_id long, node_id int, y array<double>")


def gcn_mean_sql(nodes: DataFrame, edges: DataFrame, weights: list[list[list[float]]]) -> DataFrame:
    """The mean layer as joins and aggregations, for narrow features: nodes (page_id, node_id, x array) and
    edges to page_id, node_id, y array; weights by type, [in][out]."""
    width = len(weights[0][0])
    maps = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in w]) for w in weights])
    far = nodes.select(F.col("page_id").alias("_page"), F.col("node_id").alias("_node"), "x")
    rows = edges.join(far, (F.col("page_id") == F.col("_page")) & (F.col("dst") == F.col("_node"))).select("page_id", F.col("src").alias("node_id"), "type_id", F.posexplode("x").alias("i", "v"))
    kernel = F.element_at(F.element_at(maps, F.col("type_id") + 1), F.col("i") + 1)
    by_type = rows.groupBy("page_id", "node_id", "type_id").agg(*[(F.sum(F.col("v") * F.element_at(kernel, j + 1)) / F.count_if(F.col("i") == 0)).alias(f"y{j}") for j in range(width)])
    total = by_type.groupBy("page_id", "node_id").agg(*[F.greatest(F.sum(f"y{j}"), F.lit(0.0)).alias(f"y{j}") for j in range(width)])
    out = nodes.join(total, ["page_id", "node_id"], "left")
    alone = F.when(F.size("x") == width, F.col("x").cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), width))
    return out.select("page_id", "node_id", F.when(F.col("y0").isNull(), alone).otherwise(F.array(*[f"y{j}" for j in range(width)])).alias("y"))
