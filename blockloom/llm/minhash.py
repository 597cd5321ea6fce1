"""MinHash near-dedup by a multi-index Hamming join.

A text's signature has CHUNKS * WIDTH components of 16 bits. By the pigeonhole principle two signatures that differ in
fewer than CHUNKS * (ERRORS + 1) components agree, in some chunk, in all but ERRORS components; so each chunk is
indexed once for each choice of the ERRORS components that may differ, and every pair under that distance meets in a
bucket. Candidates are confirmed on full shingle sets.

Texts with equal sets are one class from the start. In a bucket, classes are first compared with two pivots only. Buckets
of a chunk that hold mostly the same classes are then taken as one, so that these come once a chunk, not once a bucket;
what the pivots left outside its largest component tries the few most like it. So a bucket of copies that the pivots
have joined costs what is outside them, not the square of its size. Components that still have alike signatures are
brought together, and those outside the largest are compared with all the rest on full sets, in blocks: no pairs are
written but links.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, remembered, table, tidy
from .components import components

CHUNKS, WIDTH, ERRORS = 10, 6, 1
SIZE = CHUNKS * WIDTH
#: Signatures of candidates agree in half of the components at least. At a similarity of 0.8 a pair has fewer with a
#: probability under 1e-6.
AGREE = SIZE // 2
#: Classes of a bucket that are compared in one block.
BLOCK = 1024
#: Classes of a bucket that go together, about, where the bucket is looked up.
SHARE = 128
#: Candidates that a class tries before all of them are compared.
BEST = 3
#: Words that a worker remembers at most; the memory is emptied when it is full.
REMEMBER = 50_000

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes(words: list[bytes]) -> np.ndarray:
    known = remembered("shingles")
    try:
        return np.array([known[w] for w in words], dtype=np.uint64)
    except KeyError:
        if len(known) > REMEMBER:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], dtype=np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text in UTF-8: A-Z lower-cased, words between ASCII white
    space; one shingle of all words if they are fewer than asked for, none without words."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    h = _hashes(tokens)
    q = min(words, len(h))
    n = len(h) - q + 1
    s = np.full(n, np.uint64(q))
    for j in range(q):
        s = (s ^ h[j : j + n]) * _C1
        s ^= s >> np.uint64(29)
    s *= _C2
    s ^= s >> np.uint64(32)
    return np.unique(s)


@functools.lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(0, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, SIZE, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(number of sets, SIZE) components of 16 bits; no set is empty."""
    a, b = _functions()
    out = np.empty((len(sets), SIZE), dtype=np.uint16)
    at = 0
    while at < len(sets):  # as many shingles at once as a core's cache holds
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= 1 << 15):
            n += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        for k in range(SIZE):
            least = np.minimum.reduceat(x * a[k] + b[k], starts)
            out[at:to, k] = ((least ^ (least >> np.uint64(31))) * _C2) >> np.uint64(48)
        at = to
    return out


def _sketch(words: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full)) if full else iter(())
            key = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("uid"), b.column("check"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array([next(sig).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                names=["id", "uid", "check", "n", "key", "sig"],
            )

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SIZE)


def _index(batches):
    """A row for each chunk and each choice of components that may differ: a hash of the other components, and ``rest``,
    those that may differ."""
    for b in batches:
        if not b.num_rows:
            continue
        sig, node = _matrix(b.column("sig")).astype(np.uint64), b.column("node").to_numpy()
        keys, rests = [], []
        for c in range(CHUNKS):
            for i, free in enumerate(combinations(range(WIDTH), ERRORS)):
                h = np.full(len(sig), np.uint64(c * 1000 + i))
                rest = np.zeros(len(sig), dtype=np.uint64)
                for j in range(WIDTH):
                    if j in free:
                        rest = (rest << np.uint64(16)) | sig[:, c * WIDTH + j]
                    else:
                        h = (h ^ sig[:, c * WIDTH + j]) * _C1
                        h ^= h >> np.uint64(29)
                keys.append(((h * _C2) ^ (h >> np.uint64(32))).view(np.int64))
                rests.append(rest.view(np.int64))
        for i in range(0, len(keys), 6):
            part = keys[i : i + 6]
            slot = np.repeat(np.arange(i, i + len(part), dtype=np.int32), len(node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)), pa.array(np.tile(node, len(part))), pa.array(slot), pa.array(np.concatenate(rests[i : i + 6]))], names=["bucket", "node", "slot", "rest"])


def _gathered(members: DataFrame) -> DataFrame:
    """(bucket, slot, node, size): crowded buckets, with those of a chunk taken as one in which the same value of the whole
    chunk is the commonest and has half of the classes or more.

    Each of them holds all classes of that value, so what it adds are the classes that differ; every pair of a bucket is
    still a pair of what it became. That has the least class of the value for a bucket, -1 - chunk for a slot, and twice
    the classes of the value for a size, from which its own is a matter of a few times.
    """
    values = members.groupBy("bucket", "slot", "size", "rest").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    most = values.groupBy("bucket", "slot", "size").agg(F.max(F.struct("n", "least")).alias("m")).filter(2 * F.col("m.n") >= F.col("size"))
    shares = F.ceil(F.col("size") / SHARE).cast("int")
    most = most.select("bucket", "slot", F.col("m.least").alias("least"), F.col("m.n").alias("n"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    # A bucket may hold a third of all classes: its answer goes back to shares of it.
    found = members.withColumn("share", F.pmod(F.xxhash64("node"), shares).cast("int")).join(most, ["bucket", "slot", "share"], "left")
    one = F.col("least").isNotNull()
    chunk = F.floor(F.col("slot") / len(_FREE)).cast("int")
    return found.select(F.coalesce("least", "bucket").alias("bucket"), F.when(one, -1 - chunk).otherwise(F.col("slot")).alias("slot"), "node", F.when(one, 2 * F.col("n")).otherwise(F.col("size")).alias("size")).distinct()


_FREE = {free: i for i, free in enumerate(combinations(range(WIDTH), ERRORS))}


def _first_slot(same: np.ndarray) -> np.ndarray:
    """The first of the buckets that pairs share, by which components agree: each pair is taken up in one bucket only."""
    by_chunk = same.reshape(-1, CHUNKS, WIDTH)
    chunk = (by_chunk.sum(axis=2) >= WIDTH - ERRORS).argmax(axis=1)
    own = by_chunk[np.arange(len(same)), chunk]
    # What differs must be free; the first choice of free components that has it.
    choice = np.full(len(same), -1)
    for free, i in sorted(_FREE.items(), key=lambda x: -x[1]):
        bound = np.ones(WIDTH, dtype=bool)
        bound[list(free)] = False
        choice[own[:, bound].all(axis=1)] = i
    return chunk * len(_FREE) + choice


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_u"), b.column("set_v")):
                p, q = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _across(percent: int, best: int | None):
    """What signatures and sizes allow to be linked across components, in one block pair of a bucket: for each left class
    the ``best`` that agree most, or, without a number, a forest that connects components so alike. The rows of a block
    pair come one after another; those on the left are outside the bucket's largest component."""

    def pairs(rows: pa.Table) -> list[tuple[int, int]]:
        node, comp, n, left, right, slot = (rows[c].to_numpy() for c in ("node", "comp", "n", "left", "right", "slot"))
        sig = _matrix(rows["sig"].combine_chunks())
        out = []
        for i in np.flatnonzero(left):
            may = np.flatnonzero(right & (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            if not len(may):
                continue
            same = sig[may] == sig[i]
            agree = same.sum(axis=1)
            here = agree >= AGREE
            if best:
                first = _first_slot(same)
                here &= (first if slot[i] >= 0 else -1 - first // len(_FREE)) == slot[i]
            may, agree = may[here], agree[here]
            if best:
                order = np.lexsort((may, -agree))[:best]
                may, agree = may[order], agree[order]
            names_of = node if best else comp
            out += [(min(names_of[i], x), max(names_of[i], x)) for x in names_of[may]]
        return out if best else _spanning(set(out))

    return _by_block(pairs, ["bucket", "slot", "i", "j"])


def _spanning(pairs: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect, fewer than there are nodes."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    out = []
    for u, v in sorted(pairs):
        a, b = top(u), top(v)
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((u, v))
    return out


def _settle(percent: int):
    """Links of the left rows of a block pair with the right ones of other components, by full sets: one for each row and
    component. The sets of the right rows are counted all at once for a left row."""

    def links(rows: pa.Table):
        node, comp, left, right = (rows[c].to_numpy() for c in ("node", "comp", "left", "right"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["set"].to_pylist()]
        r = np.flatnonzero(right)
        if not len(r) or not left.any():
            return []
        flat = np.concatenate([sets[k] for k in r])
        size = np.array([len(sets[k]) for k in r])
        starts = np.r_[0, np.cumsum(size)[:-1]]
        known, ids = np.unique(flat, return_inverse=True)
        out = []
        for i in np.flatnonzero(left):
            at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
            mark = np.zeros(len(known), dtype=np.int64)
            mark[at[known[at] == sets[i]]] = 1
            common = np.add.reduceat(mark[ids], starts)
            ok = np.flatnonzero((comp[r] != comp[i]) & (100 * common >= percent * (size + len(sets[i]) - common)))
            _, first = np.unique(comp[r[ok]], return_index=True)
            out += [(node[i], node[k]) for k in r[ok[first]]]
        return out

    return _by_block(links, ["root", "i", "j"])


def _by_block(pairs, key: list[str]):
    """Run over sorted batches, a block at a time."""

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def run(batches):
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            if not rows.num_rows:
                continue
            ids = np.stack([rows[c].to_numpy() for c in key])
            starts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()]
            for s, t in zip(starts, starts[1:]):
                if found := pairs(rows.slice(s, t - s)):
                    yield batch(found)
            held = rows.slice(starts[-1])
        if held is not None and (found := pairs(held)):
            yield batch(found)

    return run


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id, kept, stays, row (of the input row, any number).

    ``row_col`` names a column of distinct longs that become ``row``, so that decisions can be joined to the rows; it has
    to be stored, as the input is read more than once.

    Two texts are linked when 100 * common shingles >= percent * all shingles of both. component_id is the smallest id
    that links reach; ``kept`` says that it is the row's own id, so rows that repeat that id are all kept. ``stays`` is true
    for just one row of a component, the first with that id: a filter goes by it. Null and empty texts and texts without
    words have no shingles and are linked with nothing; each is kept and stays, with its own id. Null ids are never the
    smallest, unless a component has no other. An empty table gives an empty result; other columns are ignored.
    """
    uid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), uid.alias("uid"))
    base = base.withColumn("check", F.xxhash64("text"))
    kind = base.schema["id"].dataType.simpleString()
    rows = cut(base.select("id", "text", "check", "uid").mapInArrow(tidy(_sketch(words)), f"id {kind}, uid long, check long, n long, key binary, sig binary"))
    # Of a class, the first row stands for all: its number is the class's, and its id and checksum find its text again.
    first = F.struct("uid", "id", "check", "n", "sig")
    classes = cut(
        rows.filter("n > 0").groupBy("key").agg(F.min(first).alias("first"), F.min("id").alias("least_id")).select("key", F.col("first.uid").alias("node"), F.col("first.id").alias("id"), "first.check", "first.n", "first.sig", "least_id")
    )
    index = classes.select("node", "sig").mapInArrow(_index, "bucket long, node long, slot int, rest long")
    buckets = index.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).filter("low < high")
    members = cut(index.join(buckets, "bucket"))
    pivots = members.select(F.col("low").alias("u"), F.col("node").alias("v")).unionByName(members.select(F.col("node").alias("u"), F.col("high").alias("v"))).filter("u < v").distinct()

    sizes = classes.select("node", "n", "sig")
    agree = F.lit(0)
    for i in range(SIZE):
        agree = agree + (F.substring("sig_u", 2 * i + 1, 2) == F.substring("sig_v", 2 * i + 1, 2)).cast("int")

    def likely(pairs: DataFrame) -> DataFrame:
        for c in ("u", "v"):
            pairs = pairs.join(sizes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")), c)
        return pairs.filter(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")).filter(agree >= AGREE).select("u", "v")

    def shingles(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle_set(t, words).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["node", "set"])

    def sets_of(nodes: DataFrame) -> DataFrame:
        need = nodes.select("node", "id", "check")
        texts = base.join(need, base["id"].eqNullSafe(need["id"]) & (base["check"] == need["check"])).select("node", "text")
        # Rows that repeat an id and a text give a class's set again; one is enough.
        return cut(texts.dropDuplicates(["node"]).mapInArrow(tidy(shingles), "node long, set binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes, "node"))
        for c in ("v", "u"):
            pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")), c)
        return pairs.mapInArrow(tidy(_confirm(percent)), "u long, v long")

    links = cut(confirmed(likely(pivots)))
    roots = cut(components(links))
    # What the pivots left apart: buckets with classes of several components, three classes at least. First each class
    # tries those most like it; after that only the components that are still alike are named.
    crowded = cut(_gathered(members.filter("size > 2")))
    for best in (BEST, None):
        apart = cut(crowded.join(roots, "node", "left").select("bucket", "slot", "node", "size", F.coalesce("root", "node").alias("comp")))
        counts = apart.groupBy("bucket", "slot", "size", "comp").agg(F.count("*").alias("n"))
        several = counts.groupBy("bucket", "slot", "size").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("comps")).filter("comps > 1")
        # Its answer goes back to shares of a bucket again.
        shares = F.ceil(F.col("size") / SHARE).cast("int")
        several = several.select("bucket", "slot", "all", F.col("m.comp").alias("main"), F.col("m.n").alias("inside"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
        apart = apart.withColumn("share", F.pmod(F.xxhash64("node"), shares).cast("int")).join(several, ["bucket", "slot", "share"]).join(sizes, "node")
        out = F.col("comp") != F.col("main")
        b, s = (F.ceil(x / BLOCK).cast("int") for x in (F.col("all"), F.col("all") - F.col("inside")))
        own = F.xxhash64("node", F.lit(1))
        cols = ["bucket", "slot", "node", "comp", "n", "sig"]
        right = apart.select(*cols, F.pmod(own, b).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), s - 1)).alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))
        left = apart.filter(out).select(*cols, F.explode(F.sequence(F.lit(0), b - 1)).alias("i"), F.pmod(own, s).cast("int").alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"))
        apart = right.unionByName(left).repartition("bucket", "slot", "i", "j").sortWithinPartitions("bucket", "slot", "i", "j", "node")
        more = cut(apart.mapInArrow(_across(percent, best), "u long, v long").distinct())
        if best:
            links = cut(links.unionByName(confirmed(more)))
            roots = cut(components(links))
    # Components that are still alike, taken together: those outside the largest of them are compared with all.
    near = cut(components(more)).select(F.col("node").alias("comp"), F.col("root").alias("root"))
    crowd = classes.select("node", "id", "check").join(roots, "node", "left").select("node", "id", "check", F.coalesce("root", "node").alias("comp")).join(near, "comp")
    counts = crowd.groupBy("root", "comp").agg(F.count("*").alias("n"))
    largest = counts.groupBy("root").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all"))
    largest = largest.select("root", F.col("m.comp").alias("main"), F.greatest(F.lit(1), F.ceil(F.col("all") / BLOCK)).cast("int").alias("b"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("m.n")) / BLOCK)).cast("int").alias("s"))
    crowd = cut(crowd.join(largest, "root").join(sets_of(crowd), "node"))
    own, mine = F.pmod(F.xxhash64("node"), F.col("b")).cast("int"), F.pmod(F.xxhash64("node"), F.col("s")).cast("int")
    right = crowd.select("root", "node", "comp", "set", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    left = crowd.filter("comp <> main").select("root", "node", "comp", "set", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("i"), mine.alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    blocks = right.unionByName(left).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    roots = components(links.unionByName(blocks.mapInArrow(_settle(percent), "u long, v long")))
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = classes.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull(), "least_id")).alias("least")).select("root", F.col("least.least_id").alias("component_id"))
    answer = classes.join(named, "root").select("key", "component_id", "root")
    slim = rows.select("id", "uid", "n", "key")
    out = slim.join(answer, "key", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    # One row stays where ids repeat: the first of the rows that have the component's id.
    keepers = out.filter("n > 0").filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("uid").alias("keeper"))
    out = out.join(keepers, "root", "left")
    kept, stays = F.col("id").eqNullSafe(F.col("component_id")), F.coalesce(F.col("uid") == F.col("keeper"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), stays.alias("stays"), F.col("uid").alias("row"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=2, percent=80)
