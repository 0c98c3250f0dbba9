"""SimHash near-duplicates: 64-bit fingerprints of word shingles and a binary trie self-join.

Linked are fingerprints that differ in at most ``budget`` bits. Equal fingerprints are one
entry. The trie is cut into subtrees that hold every pair within the budget at least once: the
bits are dealt into ``blocks`` blocks, and two fingerprints within the budget agree in at least
``blocks - budget`` of them, so for each choice of so many blocks the fingerprints that agree
there form a subtree of a trie that has these blocks at its root. Within a subtree pairs of
nodes are traversed together from the root down, adding up differing bits and dropping a pair of
nodes once it is over the budget. Subtrees of more than ``leaf_rows`` entries are dealt out as
pairs of their parts, so no task holds one whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import map_batches, materialize
from bibloom.llm.components import connected_components

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Entries of a subtree, or of one of its parts, that a task takes at a time.
LEAF_ROWS = 4096
#: Hashes whose bits are counted at a time, of however long a text.
_VOTES = 1 << 15
#: Pairs of nodes in work at a time.
_FRONTIER = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned number; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, _VOTES):
        bits = np.unpackbits(hashes[lo : lo + _VOTES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << (63 - k) for k in np.flatnonzero(votes * 2 > n).tolist()))


def fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp): the fingerprint of every row as a signed 64-bit number."""

    def start():
        def rows(ids, texts):
            fps = (fingerprint(t, shingle) for t in texts)
            return [ids, [f - (1 << 64) if f >> 63 else f for f in fps]]

        return rows

    return map_batches(df.select(id_col, text), start, f"`{id_col}` {dict(df.dtypes)[id_col]}, fp bigint")


# ---- the trie self-join of sorted entries


def _permute(fps: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The bits of each fingerprint in another order, the first at the top."""
    out = np.zeros_like(fps)
    run = 0
    while run < 64:  # whole runs of neighbouring bits at once
        width = 1
        while run + width < 64 and order[run + width] == order[run] + width:
            width += 1
        mask = np.uint64((1 << width) - 1)
        out |= (fps >> np.uint64(64 - int(order[run]) - width) & mask) << np.uint64(64 - run - width)
        run += width
    return out


def trie_links(keys: np.ndarray, roots: list[tuple[int, int, int, int]], depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of entries within the budget, each pair of a root once.

    ``keys`` has the entries of every node in sorted order; a root is a pair of nodes, each a
    range of entries that share their first ``depth`` bits or differ from the other's only in
    what the budget still allows. A node is (from, to); a pair of nodes of one entry each is
    settled by the bits that are left.
    """
    first = np.array(roots, np.int64).reshape(-1, 4)
    stack = [(depth, first, np.zeros(len(first), np.int64))]
    while stack:
        at, pairs, spent = stack.pop()
        if len(pairs) > _FRONTIER:
            half = len(pairs) // 2
            stack += [(at, pairs[half:], spent[half:]), (at, pairs[:half], spent[:half])]
            continue
        a0, a1, b0, b1 = pairs.T
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            x, y = a0[single], b0[single]
            near = (x != y) & (np.bitwise_count(keys[x] ^ keys[y]) <= budget)
            if near.any():
                yield x[near], y[near]
        keep = ~single
        if not keep.any():
            continue
        a0, a1, b0, b1, spent = a0[keep], a1[keep], b0[keep], b1[keep], spent[keep]
        if at == 64:  # nodes of equal entries; entries are distinct, so there is none
            continue
        am, bm = _middle(keys, a0, a1, at), _middle(keys, b0, b1, at)
        own = (a0 == b0) & (a1 == b1)
        children = [
            (a0, am, b0, bm, spent, am > a0),
            (am, a1, bm, b1, spent, a1 > am),
            (a0, am, bm, b1, spent + 1, am > a0),
            (am, a1, b0, bm, spent + 1, (a1 > am) & ~own),
        ]
        out, costs = [], []
        for p, q, r, s, cost, some in children:
            ok = some & (s > r) & (cost <= budget)
            out.append(np.stack([p[ok], q[ok], r[ok], s[ok]], axis=1))
            costs.append(cost[ok])
        stack.append((at + 1, np.concatenate(out), np.concatenate(costs)))


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where in each node the entries with the next bit set begin (binary search)."""
    bit = np.uint64(1 << (63 - depth))
    lo, hi = lo.copy(), hi.copy()
    while (todo := lo < hi).any():
        mid = (lo + hi) // 2
        ones = np.zeros(len(lo), bool)
        ones[todo] = (keys[mid[todo]] & bit) != 0
        hi = np.where(todo & ones, mid, hi)
        lo = np.where(todo & ~ones, mid + 1, lo)
    return lo


class _Forest:
    """Components of the entries of one batch: links that join nothing new are dropped."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def joining(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """The links among these that join two components, as rows of two indices."""
        ends = self.label[np.stack([xs, ys], axis=1)]
        apart = np.flatnonzero(ends[:, 0] != ends[:, 1])
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while (higher := up.get(c, c)) != c:
                up[c] = up.get(higher, higher)
                c = up[c]
            return c

        kept = []
        for k, (a, b) in zip(apart.tolist(), ends[apart].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                kept.append(k)
        if up:
            now = np.arange(len(self.label))
            for c in up:
                now[c] = root(c)
            self.label = now[self.label]
        return np.stack([xs[kept], ys[kept]], axis=1)


def _layout(blocks: int) -> list[np.ndarray]:
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    return [np.arange(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def blocks_for(entries: int, budget: int) -> int:
    """Blocks such that a subtree of evenly spread fingerprints has few entries.

    More blocks fix more bits and cost more copies; the first choice that fixes at least as
    many bits as the number of entries has is taken.
    """
    for blocks in range(budget + 1, 2 * budget + 4):
        if 64 * (blocks - budget) // blocks >= max(1, entries).bit_length():
            return blocks
    return 2 * budget + 4


def _joined(batches: Iterator[pa.RecordBatch], orders: list[np.ndarray], depths: list[int], budget: int) -> Iterator[pa.RecordBatch]:
    """Links of the subtrees in a partition; their rows come sorted by subtree."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([np.asarray(batch.column(k)) for k in range(4)], axis=1)
        # a subtree may go on in the next batch: keep back the rows of the last one
        held.append(rows)
        rows = np.concatenate(held)
        change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
        if not len(change):
            continue
        cut = change[-1] + 1
        held = [rows[cut:]]
        yield from _subtrees(rows[:cut], orders, depths, budget)
    if held:
        yield from _subtrees(np.concatenate(held), orders, depths, budget)


def _subtrees(rows: np.ndarray, orders: list[np.ndarray], depths: list[int], budget: int) -> Iterator[pa.RecordBatch]:
    """rows: (choice of blocks, subtree, pair of parts, fingerprint), sorted by the first three."""
    for choice in np.unique(rows[:, 0]).tolist():
        own = rows[rows[:, 0] == choice]
        fps = np.ascontiguousarray(own[:, 3]).view(np.uint64)
        keys = _permute(fps, orders[choice])
        # a group is one subtree, or one pair of its parts
        group = np.cumsum(np.concatenate([[0], (own[1:, 1:3] != own[:-1, 1:3]).any(axis=1)]))
        order = np.lexsort((keys, group))
        keys, group, fps = keys[order], group[order], fps[order]
        starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        sizes = np.diff(starts)
        roots = np.stack([starts[:-1], starts[1:], starts[:-1], starts[1:]], axis=1)[sizes > 1]
        forest = _Forest(len(keys))
        for xs, ys in trie_links(keys, roots, depths[choice], budget):
            at = forest.joining(xs, ys)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(fps[at[:, 0]].view(np.int64)), pa.array(fps[at[:, 1]].view(np.int64))], ["a", "b"])


def hamming_links(entries: DataFrame, fp: str = "fp", budget: int = BUDGET, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all within the budget.

    Of the pairs of a subtree only those that join something new are returned, as a spanning
    forest, so their number is bounded by the entries; none that matters to connectedness is
    lost. ``entries`` must have distinct fingerprints.
    """
    total = entries.count()
    blocks = blocks_for(total, budget)
    parts = _layout(blocks)
    chosen = list(combinations(range(blocks), blocks - budget))
    assert len(chosen) == comb(blocks, budget)
    orders, depths, masks = [], [], []
    for c in chosen:
        front = np.concatenate([parts[k] for k in c])
        orders.append(np.concatenate([front, *(parts[k] for k in range(blocks) if k not in c)]))
        depths.append(len(front))
        mask = sum(1 << (63 - int(b)) for b in front)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    dealt = entries.select(
        F.col(fp).alias("fp"), F.posexplode(F.array(*(F.col(fp).bitwiseAND(F.lit(m)) for m in masks))).alias("choice", "subtree")
    )
    sizes = dealt.groupBy("choice", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    sizes = materialize(sizes, "subtrees")
    placed = dealt.join(sizes, ["choice", "subtree"])
    # a large subtree: its entries are dealt into parts by hash, and each pair of parts is one group
    cut = F.ceil(F.col("n") / F.lit(leaf_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), cut).cast("int")
    others = F.filter(F.sequence(F.lit(0), cut - 1), lambda i: i != own)
    pairs = F.transform(others, lambda i: F.least(own, i) * cut + F.greatest(own, i))
    grouped = placed.where(F.col("n") <= leaf_rows).select("choice", "subtree", F.lit(0).alias("pair"), "fp").unionByName(
        placed.where(F.col("n") > leaf_rows).select("choice", "subtree", F.explode_outer(pairs).alias("pair"), "fp")
    )
    keys = ["choice", "subtree", "pair"]
    spread = grouped.select(*(F.col(k).cast("long") for k in keys), "fp").repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(lambda batches: _joined(batches, orders, depths, budget), "a bigint, b bigint")


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp, component_id) of every row: its fingerprint and the least id reachable over
    links of at most ``budget`` differing bits, itself included.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Fewer
    words than a shingle are one shingle. Repeated rows repeat with one component. Rows with a
    null id take part and show the component of the others; they never name it (null if all of
    a component's ids are null). Other columns are dropped; an empty table gives no rows.
    """
    prints = materialize(fingerprints(df, text, id_col, shingle), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    links = materialize(hamming_links(classes.select("fp"), "fp", budget), "hamming")
    reached = connected_components(links, "a", "b")
    members = classes.join(reached.withColumnRenamed("node", "fp"), "fp", "left")
    members = members.withColumn("component", F.coalesce("component", "fp"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = members.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
