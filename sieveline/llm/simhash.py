"""SimHash near-duplicates with BK-trees.

1. Fingerprints: one narrow Arrow stage over whole texts; the bits of a majority of the shingles' XXH64 hashes.
2. Documents with one fingerprint are one node, so that copies - however many - cost one row from here on.
3. Shards: of 64 bits cut in radius + 1 blocks, two fingerprints within the radius have one block in common. A node
   goes to the shard of each of its blocks; a shard with over ``SHARD_ROWS`` nodes is cut again by the bits that
   are left, which keeps every pair. At most a node's number of shards grows, not a shard.
4. In each shard a BK-tree takes the nodes one by one: children are keyed by their Hamming distance to the parent,
   and a search follows only the edges within the radius. A subtree known to lie in one component is not searched
   again once the searching node is in that component, so a dense group costs about its size, not its square. What
   leaves a shard is a spanning forest of its links.
5. Components: small and large stars over the forest's edges, checkpointed in the shared folder, until they rest.

Near copies by a similarity (the pipeline's stage): nodes are distinct sets of shingles. A shard is one block of 16 bits
of one of the fingerprints; nodes of a shard whose sketches are near are candidates. The texts of each component of
candidates meet, and those are linked whose sets of shingles have the similarity, counted in full. A component of
candidates is in one task.

The trees are built where their shard's nodes are; broadcasting them would bring all fingerprints to the driver.

Defined results: a null or empty text has fingerprint zero and links like any other; a text with fewer words than
a shingle is one shingle; a very long text is read whole, in one task's memory; rows with equal ids are separate rows; of
several with the smallest id of a group ``deduplicated`` leaves one, the first by checksum; a component without any id
has a null id; an empty table gives no rows; ``grouped`` keeps only the id of the input, ``deduplicated`` all columns,
whatever their names - they travel as one struct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import packed, sifted, written

SEED = 42
SHARD_ROWS = 50_000
#: Times that a shard can be cut again. Its fingerprints, which are distinct, then have 43 bits in common at least, so that
#: there are 2 ** 21 of them at most, whatever the size of the table.
CUTS = 3
#: Edges of a node beyond which they are dealt over ``SALTS`` keys; and such nodes up to which they are sent to all tasks.
HUB, SALTS, HUBS_SENT = 1000, 16, 100_000


# ---- fingerprints


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included, of the text with A to Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit b is set if it is in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hashes, made from the first (k = 0)."""
    if not k:
        return hashes
    x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Features:
    """What a document's fingerprints are made of."""

    width: int = 3
    #: Each shingle once.
    distinct: bool = False
    #: Fingerprints, from as many hashes of the family; a link in any of them is a candidate.
    family: int = 1
    radius: int = 3
    #: Jaccard similarity of the sets of shingles from which on candidates are links; None: candidates are links.
    similarity: float | None = None

    @property
    def near_bits(self) -> int:
        """Differing bits of SKETCH up to which a pair is a candidate: those at the similarity and four standard errors."""
        p = math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi
        return math.ceil(SKETCH * p + 4 * math.sqrt(SKETCH * p * (1 - p)))


#: The contract's fingerprint.
PLAIN = Features()
#: Finds copies with 0.8 of the shingles of five words. At 0.8 a bit differs with a probability of 0.15, so that one of
#: the 80 blocks of 16 bits is equal with one of 0.997; the shingles themselves then decide.
NEAR = Features(width=5, distinct=True, family=20, similarity=0.8)
#: Bits, of the first fingerprints, that go along with each block.
SKETCH = 128
#: Nodes of a block up to which all pairs are compared at once.
RUN = 16


def fingerprints(docs: DataFrame, what: Features = PLAIN, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (Spark's XXH64 of the text), fps (signed 64-bit numbers) and set_key (of the set of shingles, null without a similarity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                out, keys = [], []
                for t in part.column(2).to_pylist():
                    h = shingle_hashes(t, what.width)
                    h = np.unique(h) if what.distinct else h
                    out.append([majority(mixed(h, i)) for i in range(what.family)])
                    keys.append(xxhash.xxh3_128_digest(h.tobytes()) if what.similarity else None)
                flat = np.array(out, dtype=np.uint64).reshape(-1, what.family).view(np.int64)
                fps = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), what.family).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), fps, pa.array(keys, pa.binary())], names=["doc_id", "text_key", "fps", "set_key"])

    slim = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("_text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, text_key long, fps array<long>, set_key binary")


# ---- links


class BkTree:
    """Nodes are numbered as they come; components are kept by a union-find over the same numbers."""

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.fp: list[int] = []
        self.child: list[dict[int, int]] = []
        self.up: list[int] = []
        #: A node of the component that holds the whole subtree, or -1.
        self.whole: list[int] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def add(self, fp: int) -> None:
        """Links the new node to all components that it touches."""
        me = len(self.fp)
        self.fp.append(fp)
        self.child.append({})
        self.up.append(me)
        self.whole.append(me)
        if not me:
            return
        radius, path = self.radius, []
        node = 0
        while True:  # its place
            path.append(node)
            d = (self.fp[node] ^ fp).bit_count()
            nxt = self.child[node].get(d)
            if nxt is None:
                self.child[node][d] = me
                break
            node = nxt
        # Nearest place first, so that the node soon is in its component and most subtrees can be left out.
        todo = [0]
        for node in reversed(path):
            if (self.fp[node] ^ fp).bit_count() <= radius:
                self.join(node, me)
                break
        while todo:
            node = todo.pop()
            w = self.whole[node]
            if w >= 0 and self.root(w) == self.root(me):
                continue
            d = (self.fp[node] ^ fp).bit_count()
            if d <= radius:
                self.join(node, me)
            kids = [(abs(k - d), c) for k, c in self.child[node].items() if -radius <= k - d <= radius and c != me]
            kids.sort(reverse=True)
            todo += [c for _, c in kids]
        mine = self.root(me)
        for node in reversed(path):
            self.whole[node] = mine if self.root(node) == mine and all(self.whole[c] >= 0 and self.root(self.whole[c]) == mine for c in self.child[node].values()) else -1

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def forest(fps: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(first node, node) of each node that isn't the first of its component."""
    tree = BkTree(radius)
    for fp in fps:
        tree.add(fp)
    for n in range(len(fps)):
        if (r := tree.root(n)) != n:
            yield r, n


def _links(radius: int):
    mask = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may go on in the next batch."""
        shard, nodes, fps = None, [], []
        out: tuple[list[int], list[int]] = ([], [])

        def close() -> None:
            if len(nodes) > 1:
                for a, b in forest(fps, radius):
                    out[0].append(nodes[a])
                    out[1].append(nodes[b])

        for b in batches:
            for s, f, n in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                if s != shard:
                    close()
                    shard, nodes, fps = s, [], []
                nodes.append(n)
                fps.append(f & mask)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})
                out = ([], [])
        close()
        if out[0]:
            yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def _bits(x: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def links(nodes: DataFrame, what: Features = PLAIN) -> DataFrame:
    """Edges (a, b) between the nodes (node, fps): a forest of each component of the links."""
    blocks = what.radius + 1
    rest = nodes.select("node", F.posexplode("fps").alias("_t", "fp")).select("node", "fp", F.col("_t").cast("long").alias("shard"), F.col("fp").alias("left"))
    width, edges = 64, None
    for cut in range(CUTS + 1):
        cuts = [width * k // blocks for k in range(blocks + 1)]
        parts = []
        for k in range(blocks):
            at, n = cuts[k], cuts[k + 1] - cuts[k]
            low = _bits(F.col("left"), 0, at) if at else F.lit(0).cast("long")
            high = F.shiftrightunsigned("left", cuts[k + 1]) if cuts[k + 1] < 64 else F.lit(0).cast("long")
            # What is left has the block taken out; where blocks differ by a bit in length, the widest counts.
            parts.append(F.struct(F.xxhash64("shard", F.lit(cut), F.lit(k), _bits(F.col("left"), at, n)).alias("shard"), F.shiftleft(high, at).bitwiseOR(low).alias("left")))
        here = rest.select("node", "fp", F.explode(F.array(*parts)).alias("_p")).select("node", "fp", "_p.shard", "_p.left")
        hot = None
        if cut < CUTS:
            hot = written(here.groupBy("shard").count().where(F.col("count") > SHARD_ROWS).select("shard"))
            hot = None if hot.isEmpty() else hot
        cold = here.join(hot, "shard", "left_anti") if hot is not None else here
        near = cold.select("shard", "fp", "node").repartition("shard").sortWithinPartitions("shard", "fp", "node")
        found = near.mapInArrow(_links(what.radius), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if hot is None:
            break
        rest = here.join(hot, "shard", "left_semi")
        width -= min(b - a for a, b in zip(cuts, cuts[1:], strict=False))
    return edges


def _rounds(x: np.ndarray, left: np.ndarray, linked) -> Iterator[tuple[int, int]]:
    """(node, found) of a forest: each node takes what is linked to it of the nodes that none has taken before."""
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            me = todo.pop()
            near = np.bitwise_count(x[left] ^ x[me]).sum(axis=1, dtype=np.int64)
            hit = linked(me, left, near)
            found = left[hit].tolist()
            yield from ((me, n) for n in found)
            todo += found
            left = left[~hit]


def _alike(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, node, sketch) come sorted by shard; a shard may go on in the next batch."""
        held: list[tuple] = []

        def pairs(shard, node, x) -> pa.RecordBatch:
            start = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            size = np.diff(np.r_[start, len(shard)])
            small = np.repeat(size <= RUN, size)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for lag in range(1, int(min(RUN, size.max()))):
                at = np.flatnonzero((shard[lag:] == shard[:-lag]) & small[lag:])
                at = at[np.bitwise_count(x[at] ^ x[at + lag]).sum(axis=1, dtype=np.int64) <= bits]
                a.append(node[at])
                b.append(node[at + lag])
            for s, n in zip(start[size > RUN], size[size > RUN], strict=True):
                tied = np.array(list(_rounds(x, np.arange(s, s + n), lambda me, left, near: near <= bits)), dtype=np.int64).reshape(-1, 2)
                a.append(node[tied[:, 0]])
                b.append(node[tied[:, 1]])
            return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

        for r in batches:
            if not r.num_rows:
                continue
            shard, node = (r.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            x = np.stack([r.column(k).to_numpy(zero_copy_only=False) for k in range(2, r.num_columns)], axis=1).view(np.uint64)
            if shard[0] == shard[-1]:
                if held and held[0][0][0] != shard[0]:
                    yield pairs(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                held.append((shard, node, x))
                continue
            cut = int(np.flatnonzero(shard != shard[-1])[-1]) + 1
            held.append((shard[:cut], node[:cut], x[:cut]))
            yield pairs(*map(np.concatenate, zip(*held, strict=True)))
            held = [(shard[cut:], node[cut:], x[cut:])]
        if held:
            yield pairs(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (a, b) those that tie two parts not tied before; what was tied is forgotten beyond a million nodes."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for r in batches:
        out = []
        for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((a, b))
        if len(up) > 1_000_000:
            up.clear()
        yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})


def candidates(nodes: DataFrame, what: Features = NEAR) -> DataFrame:
    """Edges (a, b) between nodes (node, fps) with an equal block of 16 bits whose sketches are near: of each block a forest."""
    shards = [F.lit((4 * t + k) << 16) + _bits(F.get("fps", F.lit(t)), 16 * k, 16) for t in range(what.family) for k in range(4)]
    sketch = [F.get("fps", F.lit(t)).alias(f"x{t}") for t in range(SKETCH // 64)]
    rows = nodes.select(F.explode(F.array(*shards)).alias("shard"), "node", *sketch)
    found = rows.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(_alike(what.near_bits), "a long, b long")
    # The blocks' forests overlap: each task drops what its own edges tie already, and a few tasks what is left.
    return found.mapInArrow(_trees, "a long, b long").repartition(8).mapInArrow(_trees, "a long, b long")


def _exact(what: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (root, node, text, sketch) come sorted by root; a group of candidates may go on in the next batch."""
        root, nodes, sets, xs = None, [], [], []

        def close() -> list[tuple[int, int]]:
            if len(nodes) < 2:
                return []
            size = np.array([len(h) for h in sets])

            def linked(me: int, left: np.ndarray, near: np.ndarray) -> np.ndarray:
                hit = near <= what.near_bits
                mine = sets[me]
                if not len(mine):
                    return np.zeros(len(left), dtype=bool)
                # Sets whose sizes differ by more can't be as similar.
                hit &= (size[left] >= what.similarity * len(mine)) & (len(mine) >= what.similarity * size[left])
                at = np.flatnonzero(hit)
                for k in range(0, len(at), 1000):
                    some = at[k : k + 1000]
                    n = size[left[some]]
                    flat = np.concatenate([sets[i] for i in left[some]])
                    same = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    both = np.add.reduceat(same, np.r_[0, np.cumsum(n)[:-1]], dtype=np.int64)
                    hit[some] = both >= what.similarity * (len(mine) + n - both)
                return hit

            return [(nodes[a], nodes[b]) for a, b in _rounds(np.array(xs, dtype=np.int64).view(np.uint64), np.arange(len(nodes)), linked)]

        for b in batches:
            out = []
            for r, n, t, *x in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r != root:
                    out += close()
                    root, nodes, sets, xs = r, [], [], []
                if nodes and nodes[-1] == n:  # rows alike in id and text
                    continue
                nodes.append(n)
                sets.append(np.unique(shingle_hashes(t, what.width)))
                xs.append(x)
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})
        out = close()
        yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def confirmed(nodes: DataFrame, docs: DataFrame, what: Features = NEAR, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges (a, b) between nodes (node, fps, one: a document's id and text_key) whose sets of shingles have the similarity."""
    roots = components(candidates(nodes.select("node", "fps"), what))
    sketch = [F.get("fps", F.lit(t)).alias(f"x{t}") for t in range(SKETCH // 64)]
    roots = written(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct().join(nodes, "node").select("root", "node", "one", *sketch))
    mine = F.col("_d").eqNullSafe(F.col("one.doc_id")) & (F.col("_k") == F.col("one.text_key"))
    texts = docs.select(F.col(f"`{doc}`").alias("_d"), F.xxhash64(F.col(f"`{text}`")).alias("_k"), F.col(f"`{text}`").alias("_text"))
    # Only the candidates' texts leave their place, in the same way at any size.
    some, _ = sifted(texts, F.xxhash64("_d", "_k"), roots, F.xxhash64("one.doc_id", "one.text_key"))
    texts = some.join(roots.hint("merge"), mine).select("root", "node", "_text", *[f"x{t}" for t in range(SKETCH // 64)])
    return texts.repartition("root").sortWithinPartitions("root", "node").mapInArrow(_exact(what), "a long, b long")


# ---- components


def _with_least(both: DataFrame) -> DataFrame:
    """u, v and m, the smallest of u and its neighbours. The rows of nodes with over ``HUB`` edges are dealt over ``SALTS`` keys."""
    least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
    hubs = least.where(F.col("n") > HUB).select("u", F.lit(True).alias("hub"))
    n = hubs.count()
    if not n:
        return both.join(least.select("u", "m"), "u")
    hubs = F.broadcast(hubs) if n <= HUBS_SENT else hubs
    both = both.join(hubs, "u", "left").withColumn("s", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
    least = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HUB, SALTS - 1).otherwise(0))).alias("s"))
    return both.join(least, ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node on an edge: root is the smallest node that it reaches. Alternates large and small stars
    until nothing changes."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node's smaller neighbours go to the smallest of them. Few are left of each by now.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = written(e)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def grouped(docs: DataFrame, what: Features = PLAIN, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, fps, component_id (the smallest doc_id reachable) and n_rows (documents with these fingerprints)."""
    marked = written(fingerprints(docs, what, doc, text))
    key = ["set_key"] if what.similarity else ["fps"]
    nodes = marked.groupBy(*key).agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows"), F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("fps").alias("_f"))
    nodes = written(nodes.select(*key, F.col("_f").alias("fps"), "first", "n_rows", "one", F.monotonically_increasing_id().alias("node")) if what.similarity else nodes.select("fps", "first", "n_rows", F.monotonically_increasing_id().alias("node")))
    roots = components(confirmed(nodes, docs, what, doc, text) if what.similarity else links(nodes.select("node", "fps"), what))
    tied = nodes.join(roots, "node").select("root", "first").unionByName(nodes.join(roots.select("root").distinct(), nodes["node"] == F.col("root")).select("root", "first"))
    least = tied.groupBy("root").agg(F.min("first").alias("least"))
    label = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(least, "root", "left")
    label = label.select(*key, F.coalesce("least", "first").alias("component_id"), "n_rows")
    return marked.join(label, key).select("doc_id", "text_key", "fps", "component_id", "n_rows")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a signed 64-bit number."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, what: Features = NEAR, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns."""
    same = written(grouped(docs, what, doc, text).groupBy("component_id", "doc_id", "text_key").agg(F.count("*").alias("n")))
    rank = F.struct((-F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).cast("int")).alias("o"), "doc_id", "text_key", "n")
    kept = same.groupBy("component_id").agg(F.min(rank).alias("x")).select("component_id", "x.doc_id", "x.text_key", "x.n")
    # What goes is less than what stays.
    one = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")) & F.col("a.component_id").eqNullSafe(F.col("b.component_id"))
    gone = written(same.alias("a").join(kept.alias("b"), one, "left_anti").select(F.col("doc_id").alias("_i"), F.coalesce("text_key", F.lit(0)).alias("_h")))
    a = packed(docs, _d=F.col(f"`{doc}`"), _k=F.coalesce(F.xxhash64(F.col(f"`{text}`")), F.lit(0)))
    at = F.col("_d").eqNullSafe(F.col("_i")) & (F.col("_k") == F.col("_h"))
    some, rest = sifted(a, F.xxhash64("_d", "_k"), gone, F.xxhash64("_i", "_h"))
    left = rest.unionByName(some.join(gone.hint("merge"), at, "left_anti"))
    # Rows that are wholly alike in id and text: one of each is left.
    again = written(kept.where("n > 1").select(F.col("doc_id").alias("_i"), F.coalesce("text_key", F.lit(0)).alias("_h")))
    if again.isEmpty():
        return left.select("_row.*")
    alike = left.join(again, at, "left_semi").dropDuplicates(["_d", "_k"])
    return left.join(again, at, "left_anti").unionByName(alike).select("_row.*")
