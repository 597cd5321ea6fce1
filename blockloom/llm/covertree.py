"""Embedding near-dedup: dual traversal of cover trees.

Vectors are compared within a label; equal ones are folded into one that carries their number. The upper levels of a
label's tree are distributed: a cell with more vectors than a task should hold is parted among centres that are drawn
from it, and each new cell keeps its centre, its covering radius and its number of vectors. Pairs of cells are then gone
down together, a level a round. A pair goes when its centres are further apart than both radii and the threshold; it is
settled as a whole, without looking at its vectors, when no two of them can be further apart than the threshold. Only the
pairs of lowest cells that remain send their vectors to a task, each of them only to the cells that it can reach. The task
builds the lower levels (nested, with halving radii), goes down both trees by the same two rules, and decides the leaves
on exact cosines in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, table
from .components import components

#: Vectors that a task holds of a cell.
BLOCK = 8192
#: Cells that one is parted into at most in a round, and rounds. Cells that are still too large then are dealt to several
#: tasks by hash, so these bound no result.
FAN, ROUNDS = 64, 8
#: Shares that the rows of a component are dealt to.
SHARES = 64
#: Nodes of fewer vectors, or of a smaller radius than the threshold, are leaves.
LEAF = 16
#: Centres that are compared with all others at once.
STRIP = 256
SLACK = 1e-7


class Node:
    __slots__ = ("center", "radius", "rows", "children", "joined")

    def __init__(self, center: int, radius: float, rows: np.ndarray):
        self.center, self.radius, self.rows, self.children, self.joined = center, radius, rows, [], False


def _far(x: np.ndarray, center: int, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x[rows] @ x[center])))


def build(x: np.ndarray, reach: float) -> Node:
    """A cover tree of unit vectors. Level k has centres at least 2 / 2**k apart; each covers its rows within that."""
    rows = np.arange(len(x))
    root = Node(0, float(_far(x, 0, rows).max()), rows)
    todo = [(root, 1.0)]
    while todo:
        node, radius = todo.pop()
        if len(node.rows) <= LEAF or node.radius <= reach / 4:
            continue
        while radius > node.radius:
            radius /= 2
        left, at = node.rows, int(np.flatnonzero(node.rows == node.center)[0])
        vectors, alive = x[left], np.ones(len(left), dtype=bool)
        while True:
            center = int(left[at])
            square = 2 - 2 * (vectors @ x[center])
            near = alive & (square <= radius * radius)
            near[at] = True
            node.children.append(Node(center, float(np.sqrt(max(0.0, square[near].max()))), left[near]))
            alive &= ~near
            rest = np.count_nonzero(alive)
            if not rest:
                break
            if 2 * rest < len(left):  # copied a few times only
                left, vectors = left[alive], vectors[alive]
                alive = np.ones(rest, dtype=bool)
            at = int(alive.argmax())
        todo += [(c, radius / 2) for c in node.children if len(c.rows) > LEAF]
    return root


def _local_roots(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and columns of a link matrix, the smallest row that links reach; len(m) where there is none."""
    none = len(m)
    r = np.where(m.any(axis=1), np.arange(none), none)
    while True:
        c = np.where(m, r[:, None], none).min(axis=0)
        new = np.minimum(r, np.where(m, c[None, :], none).min(axis=1))
        if (new == r).all():
            return r, c
        r = new


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to about 1: exact, and norms neither over- nor underflow."""
    _, power = np.frexp(np.abs(v).max(axis=1))
    # In two steps, as 2**-power alone can leave the range of doubles.
    half = -power // 2
    return np.ldexp(np.ldexp(v, half[:, None]), (-power - half)[:, None])


def links(a: np.ndarray, b: np.ndarray | None, cosine: float, weight_a: np.ndarray | None = None, weight_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights of what is linked with each row of a and of b, and a forest that connects what links connect; rows of b are numbered
    on from those of a. With b None, links are those inside a, without a row's link to itself."""
    own = b is None
    a = scaled(a)
    b = a if own else scaled(b)
    wa = np.ones(len(a), dtype=np.int64) if weight_a is None else weight_a
    wb = wa if own else (np.ones(len(b), dtype=np.int64) if weight_b is None else weight_b)
    off = 0 if own else len(a)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    reach = float(np.sqrt(2 - 2 * cosine))
    x = a / na[:, None]
    y = x if own else b / nb[:, None]
    s = build(x, reach)
    t = s if own else build(y, reach)
    count_a, edges = np.zeros(len(a), dtype=np.int64), []
    count_b = count_a if own else np.zeros(len(b), dtype=np.int64)

    def whole(u: Node, v: Node) -> None:
        """All rows of both are linked. A node whose rows are connected already adds one edge, whatever its size."""
        p, q = u.rows, v.rows
        count_a[p] += wb[q].sum()
        if u is v:
            count_a[p] -= wa[p]
        else:
            count_b[q] += wa[p].sum()
        for n, rows, shift in ((u, p, 0), (v, q, off)):
            if not n.joined:
                n.joined = True
                edges.append(np.stack([rows + shift, np.full(len(rows), rows[0] + shift)]))
        edges.append(np.array([[q[0] + off], [p[0]]]))

    def exact(us: list[Node], vs: list[Node], meet: np.ndarray, same: bool) -> None:
        """The rows of nodes without children, all pairs of them that meet at once; in one tree, each pair of rows once."""
        (p, of_p), (q, of_q) = _rows_of(us), _rows_of(vs)
        for at in range(0, len(p) if len(q) else 0, STRIP):
            i, of_i = p[at : at + STRIP], of_p[at : at + STRIP]
            m = meet[of_i][:, of_q]
            if same:
                m &= (of_i[:, None] != of_q[None, :]) | (i[:, None] < q[None, :])
            if not m.any():
                continue
            m &= (a[i] @ b[q].T) / (na[i][:, None] * nb[q][None, :]) >= cosine
            if not m.any():
                continue
            count_a[i] += m @ wb[q]
            count_b[q] += wa[i] @ m
            r, c = _local_roots(m)
            edges.append(np.stack([i[r < len(i)], i[r[r < len(i)]]]))
            edges.append(np.stack([q[c < len(i)] + off, i[c[c < len(i)]]]))

    todo = [([s], [t], own)]
    while todo:
        us, vs, same = todo.pop()
        centers, radii = y[[n.center for n in vs]], np.array([n.radius for n in vs])
        low = np.array([not n.children for n in vs])
        for at in range(0, len(us), STRIP):
            part = us[at : at + STRIP]
            d = np.sqrt(np.maximum(0, 2 - 2 * (x[[n.center for n in part]] @ centers.T)))
            both = np.array([n.radius for n in part])[:, None] + radii[None, :]
            meet = d <= both + (reach + SLACK)
            if same:  # each pair once
                meet &= np.arange(at, at + len(part))[:, None] <= np.arange(len(vs))[None, :]
            inside = meet & (d + both <= reach - SLACK)
            lowest = np.array([not n.children for n in part])[:, None] & low[None, :]
            # Pairs of single vectors are decided below, many at once.
            alone = np.array([len(n.rows) == 1 for n in part])[:, None] & np.array([len(n.rows) == 1 for n in vs])[None, :]
            inside &= ~alone
            for i, j in zip(*np.nonzero(inside)):
                whole(part[i], vs[j])
            meet &= ~inside
            for i, j in zip(*np.nonzero(meet & ~lowest)):
                u, v = part[i], vs[j]
                todo.append((u.children or [u], v.children or [v], own and u is v))
            exact([*([None] * at if same else []), *part], vs, np.pad(meet & lowest, ((at if same else 0, 0), (0, 0))), same)
    return count_a, count_b, _forest(len(a) + (0 if own else len(b)), edges)


def _rows_of(nodes: list[Node | None]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of those nodes that have no children, and the place of each row's node."""
    some = [(k, n.rows) for k, n in enumerate(nodes) if n is not None and not n.children]
    if not some:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([r for _, r in some]), np.repeat([k for k, _ in some], [len(r) for _, r in some])


def _forest(n: int, edges: list[np.ndarray]) -> list[tuple[int, int]]:
    """An edge from each connected row to the smallest that it reaches, fewer than there are rows."""
    e = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), dtype=np.int64)
    top = np.arange(n)
    while True:
        least = np.minimum(top[e[0]], top[e[1]])
        new = top.copy()
        for ends in (e[0], e[1]):
            np.minimum.at(new, top[ends], least)
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == top).all():
            break
        top = new
    at = np.flatnonzero(top != np.arange(n))
    return list(zip(at.tolist(), top[at].tolist()))


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _units(column) -> np.ndarray:
    v = scaled(_vectors(column))
    return v / np.linalg.norm(v, axis=1)[:, None]


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, row by row."""
    return np.sqrt(np.maximum(0, 2 - 2 * (p * q).sum(axis=1)))


def _nearest(_, rows: pa.Table, centers: pa.Table) -> pa.Table:
    """Each row to the nearest centre of its cell."""
    if not centers.num_rows:
        raise ValueError("a cell without centres")  # its 64 draws and more are all empty with a probability of 1e-28
    if not rows.num_rows:
        return rows.select(["uid", "w", "vector", "path", "cell", "dist"])
    x, c = _units(rows["vector"]), _units(centers["vector"])
    dot = x @ c.T
    best = dot.argmax(axis=1)
    child = centers["node"].to_numpy()[best]
    path = [[*above, n] for above, n in zip(rows["path"].to_pylist(), child.tolist())]
    return pa.table({"uid": rows["uid"], "w": rows["w"], "vector": rows["vector"], "path": pa.array(path, pa.list_(pa.int64())), "cell": pa.array(child), "dist": pa.array(_apart(x, c[best]))})


@dataclass
class Cells:
    """rows: uid, w, vector, path (of nodes), cell (the lowest). nodes: node, parent, center, radius, n, w, rep, lowest."""

    rows: DataFrame
    nodes: DataFrame


ROWS = "uid long, w long, vector array<double>, path array<long>, cell long, dist double"


def grow(classes: DataFrame, reach: float, block: int = BLOCK) -> Cells:
    """The upper levels. classes: uid, w, root (a number of the label's and length's own), vector."""
    rows = cut(classes.select("uid", "w", "vector", F.array("root").alias("path"), F.col("root").alias("cell"), F.lit(2.0).alias("dist")))
    stats = [F.max("dist").alias("radius"), F.count("*").alias("n"), F.sum("w").alias("w"), F.min("uid").alias("rep")]
    nodes = cut(rows.groupBy(F.col("cell").alias("node")).agg(*stats).withColumns({"parent": F.lit(None).cast("long"), "center": F.lit(None).cast("array<double>")}))
    split = F.col("n") > block
    large = nodes.filter(split).select("node", "n")
    done, known = [], []
    for k in range(ROUNDS):
        if large.isEmpty():
            break
        fan = F.greatest(F.lit(2), F.least(F.lit(FAN), F.ceil(2 * F.col("n") / block)))
        here = rows.join(large.withColumnRenamed("node", "cell"), "cell")
        draw = F.pmod(F.xxhash64(F.lit(k), "uid"), F.lit(1 << 30)) / float(1 << 30)
        drawn = here.withColumn("draw", draw).filter(F.col("draw") * F.col("n") < F.greatest(F.lit(64), 2 * fan))
        few = drawn.groupBy("cell", fan.cast("int").alias("fan")).agg(F.array_sort(F.collect_list(F.struct("draw", "uid", "vector"))).alias("c"))
        centers = few.select(F.col("cell").alias("parent"), F.explode(F.slice("c", 1, F.col("fan"))).alias("c")).select("parent", F.col("c.vector").alias("center"))
        centers = cut(centers.withColumn("node", F.monotonically_increasing_id() + F.lit((k + 1) << 56)))
        # Groups of bounded size, whatever a cell holds; each gets the few centres of its cell.
        shares = F.ceil(F.col("n") / (2 * block)).cast("int")
        dealt = here.withColumn("share", F.pmod(F.xxhash64("uid", F.lit(7)), shares).cast("int"))
        copies = centers.join(large.withColumnRenamed("node", "parent"), "parent").select(F.col("parent").alias("cell"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), "node", F.col("center").alias("vector"))
        moved = dealt.groupBy("cell", "share").cogroup(copies.groupBy("cell", "share")).applyInArrow(_nearest, ROWS)
        moved = cut(moved)
        done.append(rows.join(large.select(F.col("node").alias("cell")), "cell", "left_anti"))
        known.append(nodes.join(large.select("node"), "node", "left_anti").withColumn("lowest", F.lit(True)))
        known.append(nodes.join(large.select("node"), "node", "left_semi").withColumn("lowest", F.lit(False)))
        nodes = cut(moved.groupBy(F.col("cell").alias("node")).agg(*stats).join(centers, "node"))
        rows = moved
        # A cell whose vectors are all linked with each other needs no parting.
        large = nodes.filter(split & (2 * F.col("radius") > reach - SLACK)).select("node", "n")
    done.append(rows)
    known.append(nodes.withColumn("lowest", F.lit(True)))
    columns = ["node", "parent", "center", "radius", "n", "w", "rep", "lowest"]
    return Cells(_union([d.select("uid", "w", "vector", "path", "cell") for d in done]), cut(_union([d.select(*columns) for d in known])))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def traverse(nodes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of nodes whose vectors are all linked, and pairs of lowest cells whose vectors have to meet."""
    roots = nodes.filter("parent IS NULL")
    meet = [roots.filter("lowest").select(F.col("node").alias("u"), F.col("node").alias("v"))]
    inside = [roots.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)]
    todo = roots.filter("NOT lowest").select(F.col("node").alias("u"), F.col("node").alias("v"))
    child = nodes.filter("parent IS NOT NULL").select("parent", "node", "center", "radius", "lowest")
    child = child.unionByName(nodes.filter("parent IS NOT NULL AND lowest").select(F.col("node").alias("parent"), "node", "center", "radius", "lowest"))

    def side(c: str) -> DataFrame:
        return child.select(F.col("parent").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("node", "center", "radius", "lowest")])

    def judge(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ru, rv = (b.column(f"radius_{c}").to_numpy() for c in "uv")
            u, v = (b.column(f"node_{c}").to_numpy() for c in "uv")
            d = np.where(u == v, 0.0, _apart(_units(b.column("center_u")), _units(b.column("center_v"))))
            low = b.column("lowest_u").to_numpy(zero_copy_only=False) & b.column("lowest_v").to_numpy(zero_copy_only=False)
            fate = np.where(d + ru + rv <= reach - SLACK, 1, np.where(low, 2, 3))
            near = d <= ru + rv + reach + SLACK
            yield pa.RecordBatch.from_arrays([pa.array(u[near]), pa.array(v[near]), pa.array(fate[near].astype(np.int32))], names=["u", "v", "fate"])

    while not todo.isEmpty():
        pairs = todo.withColumnsRenamed({"u": "pu", "v": "pv"}).join(side("u").withColumnRenamed("u", "pu"), "pu").join(side("v").withColumnRenamed("v", "pv"), "pv")
        pairs = pairs.filter("pu <> pv OR node_u <= node_v")  # each pair once
        judged = cut(pairs.select(*[f"{x}_{c}" for x in ("node", "center", "radius", "lowest") for c in "uv"]).mapInArrow(judge, "u long, v long, fate int"))
        inside.append(judged.filter("fate = 1").select("u", "v"))
        meet.append(judged.filter("fate = 2").select("u", "v"))
        todo = judged.filter("fate = 3").select("u", "v")
    return cut(_union(inside)), cut(_union(meet))


def _task(cosine: float):
    def run(key, rows):
        uid, w = rows["uid"].to_numpy(), rows["w"].to_numpy()
        x = _vectors(rows["vector"])
        left, right = rows["left"].to_numpy(), rows["right"].to_numpy()
        nothing = {"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "n": pa.array([], pa.int64())}
        if key[0].as_py() == key[1].as_py() and key[2].as_py() == key[3].as_py():
            counts, _, edges = links(x, None, cosine, w)
            names = uid
        else:
            if not left.any() or not right.any():
                return pa.table(nothing)
            ca, cb, edges = links(x[left], x[right], cosine, w[left], w[right])
            names, counts = np.concatenate([uid[left], uid[right]]), np.concatenate([ca, cb])
        e = np.unique(np.array(edges, dtype=np.int64).reshape(-1, 2), axis=0)
        e = e[e[:, 0] != e[:, 1]]
        some = counts > 0
        return pa.table({"u": np.concatenate([names[some], names[e[:, 0]]]), "v": np.concatenate([names[some], names[e[:, 1]]]), "n": np.concatenate([counts[some], np.zeros(len(e), dtype=np.int64)])})

    return run


def _meetings(cells: Cells, meet: DataFrame, reach: float, block: int) -> DataFrame:
    """The rows of each pair of lowest cells that have to meet: (u, v, i, j), with the halves of large cells numbered."""
    about = cells.nodes.select("node", "center", "radius", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    pairs = meet.join(about.withColumnsRenamed({"node": "u", "center": "cu", "radius": "ru", "parts": "parts_u"}), "u")
    pairs = pairs.join(about.withColumnsRenamed({"node": "v", "center": "cv", "radius": "rv", "parts": "parts_v"}), "v")
    sides = pairs.select(F.col("u").alias("cell"), "u", "v", F.lit(True).alias("first"), F.col("cv").alias("center"), F.col("rv").alias("radius"), F.col("parts_u").alias("own_parts"), F.col("parts_v").alias("other_parts"))
    sides = sides.unionByName(pairs.filter("u <> v").select(F.col("v").alias("cell"), "u", "v", F.lit(False).alias("first"), F.col("cu").alias("center"), F.col("ru").alias("radius"), F.col("parts_v").alias("own_parts"), F.col("parts_u").alias("other_parts")))

    def reachable(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keep = np.ones(b.num_rows, dtype=bool)
            at = np.flatnonzero(b.column("other").to_numpy(zero_copy_only=False))
            if len(at):
                some = b.take(pa.array(at))
                d = _apart(_units(some.column("vector")), _units(some.column("center")))
                keep[at] = d <= some.column("radius").to_numpy() + (reach + SLACK)
            yield b.filter(pa.array(keep)).select(["uid", "w", "vector", "u", "v", "first", "own_parts", "other_parts"])

    joined = cells.rows.join(sides, "cell").select("uid", "w", "vector", "u", "v", "first", "own_parts", "other_parts", "center", "radius", (F.col("u") != F.col("v")).alias("other"))
    sent = joined.mapInArrow(reachable, "uid long, w long, vector array<double>, u long, v long, first boolean, own_parts int, other_parts int")
    sent = sent.withColumn("own", F.pmod(F.xxhash64("uid", F.lit(3)), F.col("own_parts")).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    same = F.col("u") == F.col("v")
    i = F.when(same, F.least("own", "met")).when(F.col("first"), F.col("own")).otherwise(F.col("met"))
    j = F.when(same, F.greatest("own", "met")).when(F.col("first"), F.col("met")).otherwise(F.col("own"))
    sent = sent.withColumns({"i": i, "j": j})
    return sent.select("u", "v", "i", "j", "uid", "w", "vector", F.when(same, F.col("own") == F.col("i")).otherwise(F.col("first")).alias("left"), F.when(same, F.col("own") == F.col("j")).otherwise(~F.col("first")).alias("right"))


def _settled(cells: Cells, inside: DataFrame) -> DataFrame:
    """What pairs that are linked as a whole add to each vector, as _task returns it: counts, and edges to one vector that
    all of a node are linked with."""
    about = cells.nodes.select("node", "w", "rep")
    both = inside.select(F.col("u").alias("node"), F.col("v").alias("met")).unionByName(inside.filter("u <> v").select(F.col("v").alias("node"), F.col("u").alias("met")))
    both = both.join(about.withColumnsRenamed({"node": "met", "rep": "met_rep", "w": "met_w"}), "met")
    adds = cut(both.groupBy("node").agg(F.sum("met_w").alias("plus"), F.sum((F.col("node") == F.col("met")).cast("long")).alias("own"), F.min("met_rep").alias("anchor")))
    of_rows = cells.rows.select("uid", "w", F.explode("path").alias("node")).join(adds, "node")
    counts = of_rows.select(F.col("uid").alias("u"), F.col("uid").alias("v"), (F.col("plus") - F.col("own") * F.col("w")).alias("n"))
    edges = of_rows.select(F.col("uid").alias("u"), F.col("anchor").alias("v"), F.lit(0).cast("long").alias("n")).filter("u <> v")
    between = both.join(adds.select("node", "anchor"), "node").select(F.col("anchor").alias("u"), F.col("met_rep").alias("v"), F.lit(0).cast("long").alias("n")).filter("u <> v")
    return counts.unionByName(edges).unionByName(between)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row for each input row: id, n_links, component_id, kept, stays, row (of the input row, any number).

    Vectors are linked when their labels are equal and not null, their lengths are equal, and the cosine is at least as
    asked. Vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing; each has its
    own id and is kept; very small and very large ones are compared like others. Rows that repeat are linked with each
    other. ``kept`` says that the component's id is the row's own, so rows that repeat it are all kept; ``stays`` is true
    for just one row of a component: the first with the smallest id. Null ids are never the smallest, unless a component
    has no other. An empty table gives an empty result; other columns are ignored.
    """
    reach = float(np.sqrt(2 - 2 * cosine))
    v = F.col(vector_col).cast("array<double>")
    rows = cut(vectors.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(label_col).alias("label"), v.alias("vector")))
    big = float("inf")
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < big)) & F.exists("vector", lambda c: c != 0)
    key = ["label", "dim", "h1", "h2"]
    usable = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(fine)
    usable = usable.withColumns({"dim": F.size("vector"), "h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector")})
    # Of equal vectors the first stands for all; a group of any size is one record a task before the shuffle.
    classes = cut(usable.groupBy(*key).agg(F.min(F.struct("uid", "vector")).alias("m"), F.count("*").alias("w")).select(*key, F.col("m.uid").alias("uid"), F.col("m.vector").alias("vector"), "w"))
    roots = cut(classes.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.monotonically_increasing_id().alias("root")))
    cells = grow(classes.join(roots, ["label", "dim"]), reach, block)
    inside, meet = traverse(cells.nodes, reach)
    found = _meetings(cells, meet, reach, block).groupBy("u", "v", "i", "j").applyInArrow(_task(cosine), "u long, v long, n long")
    if not inside.isEmpty():
        found = found.unionByName(_settled(cells, inside))
    found = cut(found)
    counts = found.filter("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    tops = cut(components(found.filter("u <> v").select("u", "v")))
    names = classes.select(*key, F.col("uid").alias("node"), "w").join(counts, "node", "left").join(tops, "node", "left")
    names = cut(names.select(*key, (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    member = usable.select("uid", "id", *key).join(names, key)
    member = cut(member.select("uid", "id", "n_links", "root"))
    # The answer goes back the way the rows came: to the shares of a component, then to its rows.
    member = member.withColumn("share", F.pmod(F.xxhash64("uid"), F.lit(SHARES)))
    shares = member.groupBy("root", "share").agg(F.min(F.struct(F.col("id").isNull(), "id", F.col("uid"))).alias("m"))
    least = shares.select("root", "share").join(shares.groupBy("root").agg(F.min("m").alias("m")), "root")
    linked = member.join(least, ["root", "share"]).select("uid", "n_links", F.col("m.id").alias("component_id"), F.col("m.uid").alias("keeper"))
    out = rows.select("uid", "id").join(linked, "uid", "left")
    alone = F.col("keeper").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        (alone | (F.col("uid") == F.col("keeper"))).alias("stays"),
        F.col("uid").alias("row"),
    )


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
