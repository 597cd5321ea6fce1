"""Line dedup with DataFrame operations only.

Lines that occur once end every repeated run, so suffixes start at repeated lines and reach to the next line that is not
one. Their ranks come from distributed prefix doubling: the rank of 2**(k+1) lines is the place of the pair of ranks of
2**k lines in a range-partitioned sort. Equal ranks are an interval of the suffix array whose common prefix is that long.
A run counts from MIN_WORDS words on, so a suffix's interval is asked for at the shortest prefix that has so many, and a
few doublings are enough whatever the length of the runs. In each interval the first place stays and the lines of all
others are deleted; overlapping deletions join up to the maximal repeated run.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut, table

#: Words that a repeated run has at least.
MIN_WORDS = 50
KEY = ["id", "c1", "c2"]
#: Shares that the rows of an interval are dealt to, as one passage may be in a third of all documents.
SHARES = 64
#: White space other than the space, and words between all of it.
RARE = [9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WORD = "[^ " + "".join(f"\\x{{{c:X}}}" for c in RARE) + "]+"


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def _plain_words(line: Column) -> Column:
    """The same in a text with no white space but spaces, found much faster."""
    return F.size(F.filter(F.split(line, " "), lambda w: w != ""))


def _plain(text: Column) -> Column:
    """Whether a text has no white space but spaces and line feeds. Most of the others begin with the same two bytes, which
    are looked for before them."""
    begin = b"\xe2\x80"
    alike = [c for c in RARE if chr(c).encode().startswith(begin)]
    found = text.cast("binary").contains(F.lit(begin)) & functools.reduce(Column.__or__, [text.contains(chr(c)) for c in alike])
    return ~functools.reduce(Column.__or__, [*(text.contains(chr(c)) for c in RARE if c not in alike), found])


def _ranks(pairs: DataFrame) -> DataFrame:
    """(a, b, rank) of distinct pairs: numbers that rise with the pair, across partitions too."""
    ordered = pairs.distinct().repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    return cut(ordered.withColumn("rank", F.monotonically_increasing_id()))


def _lines(text_col: str, words) -> Column:
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), words(x).alias("words")))
    return F.filter(lines, lambda x: x["words"] > 0)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, c1, c2, low, high): maximal runs of lines to delete, by document; lines are numbered from 0. c1 and c2 are
    hashes of the text, which tell apart rows that repeat an id."""
    # Asked once for a text: inside the lambda it would be asked for each line.
    lines = F.when(_plain(F.col(text_col)), _lines(text_col, _plain_words)).otherwise(_lines(text_col, _words))
    every = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), *_hashes(text_col), F.posexplode(lines).alias("seq", "x"))
    every = every.select(*KEY, "seq", "x.pos", "x.words", F.col("x.h1").alias("a"), F.col("x.h2").alias("b"))
    often = every.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    ranks = _ranks(often)
    # Rows that repeat both id and text are one document.
    found = every.join(ranks, ["a", "b"]).groupBy(*KEY, "seq").agg(F.first("pos").alias("pos"), F.first("words").alias("words"), F.first("rank").alias("rank"))
    by_doc = W.partitionBy(*KEY).orderBy("seq")
    found = found.withColumn("segment", F.col("seq") - F.row_number().over(by_doc))
    by_segment = W.partitionBy(*KEY, "segment").orderBy("seq")
    ahead = F.collect_list("words").over(by_segment.rowsBetween(0, min_words - 1))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    need = F.aggregate("ahead", start, lambda s, x: F.when(s["sum"] >= min_words, s).otherwise(F.struct((s["sum"] + x).alias("sum"), (s["n"] + 1).alias("n"))))
    found = found.withColumn("ahead", ahead).withColumn("need", need)
    found = found.withColumn("need", F.when(F.col("need.sum") >= min_words, F.col("need.n")))
    # Segments without a run that long are of no use.
    found = found.withColumn("longest", F.max("need").over(W.partitionBy(*KEY, "segment"))).filter("longest IS NOT NULL")
    state = cut(found.select(*KEY, "segment", "seq", "pos", "need", F.array("rank").alias("ranks")))
    longest = state.agg(F.max("need")).first()[0] or 1
    for k in range(longest.bit_length() - 1):
        pairs = state.withColumn("a", F.get("ranks", F.lit(k))).withColumn("b", F.lead(F.get("ranks", F.lit(k)), 2**k).over(by_segment))
        pairs = cut(pairs)
        ranks = _ranks(pairs.filter("b IS NOT NULL").select("a", "b"))
        state = cut(pairs.join(ranks, ["a", "b"], "left").select(*KEY, "segment", "seq", "pos", "need", F.concat("ranks", F.array("rank")).alias("ranks")))
    level = F.floor(F.log2("need") + 1e-9).cast("int")
    starts = state.filter("need IS NOT NULL").withColumn("level", level).withColumn("second", F.col("seq") + F.col("need") - F.pow(F.lit(2), F.col("level")).cast("int"))
    starts = starts.withColumn("last", F.col("seq") + F.col("need") - 1)
    place = state.select(*KEY, F.col("seq").alias("second"), F.col("ranks").alias("more"))
    end = state.select(*KEY, F.col("seq").alias("last"), F.col("pos").alias("high"))
    # The ids may be null: joins on them are null-safe.
    starts = _join(_join(starts, place, "second"), end, "last")
    intervals = starts.select(*KEY, "seq", F.col("pos").alias("low"), "high", "need", F.get("ranks", "level").alias("a"), F.get("more", "level").alias("b"))
    same = ["need", "a", "b"]
    intervals = cut(intervals.withColumn("share", F.pmod(F.xxhash64(*KEY, "seq"), F.lit(SHARES))))
    spot = F.struct(*KEY, "seq")
    # The answer goes back the way the rows came: to the shares of an interval, then to its rows.
    shares = intervals.groupBy(*same, "share").agg(F.min(spot).alias("first"), F.count("*").alias("n"))
    first = shares.groupBy(*same).agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    first = shares.select(*same, "share").join(first, same)
    later = intervals.join(first, [*same, "share"]).filter(~spot.eqNullSafe(F.col("first"))).select(*KEY, "low", "high")
    before = F.max("high").over(W.partitionBy(*KEY).orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1))
    later = later.withColumn("new", F.coalesce((F.col("low") > before + 1).cast("int"), F.lit(1)))
    later = later.withColumn("run", F.sum("new").over(W.partitionBy(*KEY).orderBy("low", "high").rowsBetween(W.unboundedPreceding, 0)))
    return later.groupBy(*KEY, "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def _hashes(text_col: str) -> list[Column]:
    return [F.xxhash64(F.col(text_col)).alias("c1"), F.xxhash64(F.lit(7), F.col(text_col)).alias("c2")]


def _join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    right = right.select(*[F.col(c).alias(f"__{c}") if c in [*KEY, on] else F.col(c) for c in right.columns])
    same = left[on] == right[f"__{on}"]
    for c in KEY:
        same = same & (left[c].eqNullSafe(right[f"__{c}"]) if c == "id" else left[c] == right[f"__{c}"])
    return left.join(right, same).drop(*[f"__{c}" for c in [*KEY, on]])


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """The input rows and columns, with later copies of repeated line runs deleted from the text.

    Lines end at line feeds, words at any white space, also in scripts that have none. A run is consecutive lines, not counting those without words, of at least
    ``min_words`` words together; lines without words inside a deleted run go with it. Copies are ordered by id (null
    first), then by the text's hashes, then by place; the first stays whole, and a copy that overlaps the one before it
    is deleted too. Rows that repeat both id and text are one document and get the same text. Null texts stay null, a text
    whose lines all go becomes empty, and an empty table stays empty. ``removed_col`` names a column for the number of
    lines deleted; it takes the place of one that the table has by that name.
    """
    runs = repeated_runs(docs, min_words, id_col, text_col)
    mark = "__"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    found = mark + "runs"
    runs = runs.groupBy(*KEY).agg(F.collect_list(F.struct("low", "high")).alias(found)).withColumnsRenamed({c: mark + c for c in KEY})
    c1, c2 = _hashes(text_col)
    same = docs[id_col].eqNullSafe(runs[mark + "id"]) & (c1 == runs[mark + "c1"]) & (c2 == runs[mark + "c2"])
    joined = docs.join(runs, same, "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.exists(found, lambda r: i.between(r["low"], r["high"])))
    text = F.when(F.col(found).isNull(), F.col(text_col)).otherwise(F.concat_ws("\n", kept))
    own = lambda c: docs["`" + c.replace("`", "``") + "`"]
    columns = [text.alias(c) if c == text_col else own(c) for c in docs.columns if not removed_col or c.lower() != removed_col.lower()]
    if removed_col:
        gone = F.aggregate(found, F.lit(0), lambda s, r: s + r["high"] - r["low"] + 1)
        columns.append(F.coalesce(gone, F.lit(0)).cast("long").alias(removed_col))
    return joined.select(*columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, removed_col="lines_removed")


SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS words FROM l),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM w WHERE words > 0),
c AS (SELECT a.doc_id, a.seq, a.pos AS low, b.seq AS other, b.pos, b.line, b.words,
             sum(b.words) OVER (PARTITION BY a.doc_id, a.seq ORDER BY b.seq) AS total
      FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + {MIN_WORDS - 1}),
g AS (SELECT doc_id, seq, low, max(pos) AS high, string_agg(line, chr(10) ORDER BY other) AS run
      FROM c WHERE total - words < {MIN_WORDS} GROUP BY ALL HAVING max(total) >= {MIN_WORDS}),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, seq) AS copy FROM g) WHERE copy > 1),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN d ON l.doc_id = d.doc_id AND l.pos BETWEEN d.low AND d.high),
left_over AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS text, count(gone.pos) AS lines_removed
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(left_over.text, '') END AS text, coalesce(lines_removed, 0) AS lines_removed
FROM documents LEFT JOIN left_over ON documents.doc_id = left_over.doc_id
"""
