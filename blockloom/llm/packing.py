"""Best-fit packing with certified bounds.

Texts become pieces of at most ``capacity`` tokens. Pieces are dealt to partitions of bounded size; each packs its own by
best-fit decreasing and computes a lower bound from dual feasible functions. A partition that meets its bound is certified:
no arrangement of its pieces has fewer sequences, and only its few emptiest are opened for others. One with a gap opens
twice the gap more. The pieces of open sequences are exchanged and packed again in as many partitions as they fill, as long
as the bound over all of them together says that a sequence can be saved and the round before has saved one.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, remembered, shuffle_partitions, table, tidy, tokenizer, tokenizer_path
from .bpe import as_letters

CAPACITY = 2048
#: Words, and parts of words, that a worker remembers at most; a memory is emptied when it is full.
REMEMBER = 250_000
#: Pieces that a partition of any round should hold.
PER_PART = 20_000
#: Sequences that a certified partition opens for the exchange.
OPENED = 4
#: Rounds at most.
ROUNDS = 8


#: Lower-case letters that normalisation leaves as they are, then punctuation other than the apostrophe: two matches of
#: the splitting pattern, on each of which the merges can be run alone.
PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")


class WordIds:
    """Ids of texts, for a tokenizer that lower-cases and drops white space: ASCII white space ends every match of its
    pattern, so words between are encoded once each. Texts with a special token's name go to the tokenizer whole."""

    def __init__(self, path: str, end_id: int = 0):
        self.tokenizer = tokenizer(path)
        names = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(names)) if names else None
        self.letters = as_letters()
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.end = np.array([end_id], dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """The ids of one match; the parts of words recur more often than the words."""
        if part not in self.parts:
            if len(self.parts) > REMEMBER:
                self.parts.clear()
            merged = self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
            self.parts[part] = np.array([x.id for x in merged], dtype="<u4").tobytes()
        return self.parts[part]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        out, hard = {}, []
        for w in words:
            if m := PLAIN.fullmatch(w.decode("utf-8", "replace")):
                out[w] = b"".join([self._part(x) for x in m.groups() if x])
            else:
                hard.append(w)
        for i in range(0, len(hard), 4096):
            part = hard[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                out[w] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def __call__(self, text: bytes) -> bytes:
        """The ids and the end id, as little-endian unsigned 32-bit integers."""
        if self.special and self.special.search(text):
            ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes() + self.end
        words = text.lower().split()
        known = self.known
        try:
            return b"".join([known[w] for w in words]) + self.end
        except KeyError:
            new = self._learn([*{w for w in words if w not in known}])
            out = b"".join([known[w] if w in known else new[w] for w in words]) + self.end
            if len(known) + len(new) > REMEMBER:
                known.clear()
            if len(new) <= REMEMBER:
                known.update(new)
            return out


def word_ids(path: str, end_id: int) -> WordIds:
    """One encoder for each Python worker."""
    kept = remembered("packing")
    if (path, end_id) not in kept:
        kept[path, end_id] = WordIds(path, end_id)
    return kept[path, end_id]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, uid (of the input row), piece, start, length, ids_crc32 and, if asked for, ids."""
    slim = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        encode = word_ids(path, end_id)
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                data = encode(t)
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4"))
            at = pa.array(row, pa.int64())
            columns = [b.column("id").take(at), b.column("uid").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "uid", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(tidy(run), f"id {kind}, uid long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """A bound on the sequences for so many pieces of each length, the best of a family of dual feasible functions: lengths
    over capacity - k count as a whole sequence and those under k as nothing, for every k up to half the capacity."""
    if not count.any():
        return 0
    total = np.cumsum(count * np.arange(capacity + 1))
    number = np.cumsum(count)
    k = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - k]  # longer than capacity - k
    middle = total[capacity - k] - np.where(k > 0, total[k - 1], 0)  # k to capacity - k
    return int((large + -(-middle // capacity)).max())


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each length, which come longest first. Open sequences are kept by the room left, and a bit mask
    of rooms finds the smallest that suffices."""
    out = np.empty(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = opened = 0
    for i, n in enumerate(lengths.tolist()):
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, opened
            opened += 1
        out[i] = b
        left = room - n
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return out


def _pack_group(capacity: int, level: int):
    def pack(key, pdf):
        pdf = pdf.sort_values(["length", "id", "piece", "uid"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        n = pdf["length"].to_numpy()
        b = best_fit_decreasing(n, capacity)
        fill = np.bincount(b, weights=n).astype(np.int64)
        bound = lower_bound(n, capacity)
        open_bins = np.zeros(len(fill), dtype=bool)
        emptiest = np.argsort(fill, kind="stable")[: OPENED + 2 * (len(fill) - bound)]
        open_bins[emptiest[fill[emptiest] < capacity]] = True
        order = np.lexsort((np.arange(len(b)), b))
        offset = np.zeros(len(b), dtype=np.int64)
        run = np.cumsum(n[order]) - n[order]
        first = np.r_[True, b[order][1:] != b[order][:-1]]
        offset[order] = run - np.repeat(run[first], np.diff(np.r_[np.flatnonzero(first), len(b)]))
        return pdf.assign(sequence_id=(np.int64(level) << 58) | (np.int64(key[0]) << 36) | b, offset=offset, bins=len(fill), bound=bound, open=open_bins[b])

    return pack


def _dealt(todo: DataFrame, parts: int) -> DataFrame:
    """With a column ``part``. Pieces are ranked by length over all partitions and dealt in turn, so that each part has its
    share of every length: parts with too many long or short pieces would lose sequences that only an exchange saves."""
    if parts == 1:
        return todo.withColumn("part", F.lit(0))
    order = ["length", F.xxhash64("uid", "piece"), "uid", "piece"]
    ranged = todo.repartitionByRange(shuffle_partitions(todo.sparkSession), *order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumns({"at": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = sorted((r["at"], r["count"]) for r in ranged.groupBy("at").count().collect())  # one number for each partition
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    firsts = todo.sparkSession.createDataFrame([(at, k) for (at, _), k in zip(counts, before)], "at int, before long")
    return ranged.join(F.broadcast(firsts), "at").withColumn("part", F.pmod(F.col("before") + F.col("place"), F.lit(parts)).cast("int")).drop("at", "place", "before")


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, per_part: int = PER_PART) -> DataFrame:
    """Adds sequence_id, offset, and bins and bound of the partition that packed the piece. Full pieces make sequences of
    their own. No task of any round holds more than about ``per_part`` pieces; what the driver sees of a round is the
    number of pieces by length."""
    columns = [*pieces_df.columns, "sequence_id", "offset", "bins", "bound"]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    whole = pieces_df.filter(F.col("length") >= capacity)
    done = [whole.withColumns({"sequence_id": (F.lit(31).cast("long") * F.lit(1 << 58)).bitwiseOR(F.monotonically_increasing_id()), "offset": none, "bins": one, "bound": one})]
    todo = pieces_df.filter(F.col("length") < capacity)
    n, before, held = todo.count(), None, None
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_df.schema)
    for level in range(ROUNDS):
        parts = max(1, -(-n // per_part))
        packed = _dealt(todo.select(*pieces_df.columns), parts).select(*pieces_df.columns, "part").groupBy("part").applyInPandas(_pack_group(capacity, level), f"{fields}, part int, sequence_id long, offset long, bins long, bound long, open boolean")
        packed = cut(packed)
        is_first, is_open = (F.col("offset") == 0).cast("long"), F.col("open").cast("long")
        sums = packed.groupBy("length").agg(F.sum(is_first).alias("sequences"), F.sum(is_open).alias("pieces"), F.sum(is_first * is_open).alias("opened")).toPandas()  # a row for each length
        sequences, opened, n = (int(sums[c].sum()) for c in ("sequences", "opened", "pieces"))
        if before is not None and sequences >= before:  # nothing saved: the packing before stays
            break
        count = np.zeros(capacity + 1, dtype=np.int64)
        count[sums["length"].to_numpy()] = sums["pieces"].to_numpy()
        held, before = packed, opened
        if parts == 1 or opened <= bound_of(count, capacity) or level == ROUNDS - 1:
            break
        done.append(packed.filter("NOT open").select(*columns))
        todo = held = packed.filter("open")
    done.append(held.select(*columns))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound.

    Null texts are empty and hold the end id alone. Ids may be null or repeated: each input row is a document of its
    own. Only documents over the capacity are cut. An empty table gives an empty result, other columns are ignored.
    """
    packed = pack(cut(pieces(docs, path, capacity, end_id, id_col, text_col)), capacity)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
