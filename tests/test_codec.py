"""Queries against their SQL, and fixtures with known results."""

from functools import reduce
from operator import add

import duckdb
import numpy as np
import pytest

from blockloom.functions import tables
from blockloom.functions.dialect import Spark
from blockloom.operators import codec
from blockloom.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    got = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    for table in ("documents", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_scan_tables_are_inverse_permutations():
    z, r = tables.zigzag(), tables.rank()
    assert z[:6] == [0, 1, 8, 16, 9, 2] and r[:8] == [0, 1, 5, 6, 14, 15, 27, 28]
    assert [z[i] for i in r] == list(range(64)) and sum(a != b for a, b in zip(z, r)) == 58


def test_fixed_basis_has_seven_magnitudes():
    assert sorted({abs(v) for v in tables.fixed_basis()}) == [6393, 12540, 18205, 23170, 27246, 30274, 32138]


def test_ordered_rounding_equals_whole_numbers(spark):
    def even(v, bits):
        low, rest = v >> bits, v & ((1 << bits) - 1)
        return low + (rest > 1 << (bits - 1) or (rest == 1 << (bits - 1) and low & 1))

    x = np.random.default_rng(2).integers(-128, 128, (12, 64)).tolist()
    c, d = tables.fixed_basis(), Spark()
    df = spark.createDataFrame([(v,) for v in x], "shifted array<int>").selectExpr("shifted", f"{codec.dct_fourk(d)} AS fourk")
    for row in df.selectExpr("shifted", "fourk", f"{codec.quantise_fourk(d)} AS q").collect():
        for f in range(64):
            u, w, s = f // 8, f % 8, 0
            for k in range(8):
                s = even((s << 10) + sum(c[u * 8 + r] * row.shifted[r * 8 + k] for r in range(8)) * c[w * 8 + k], 10)
            assert row.fourk[f] == s
            ratio = s * 4 // tables.QUANT[f]
            assert row.q[f] == (1 if ratio >= 0 else -1) * ((abs(ratio) + (1 << 23)) >> 24)


@pytest.mark.parametrize("pixel, cpu, stream", [(0, -64, -64), (255, 64, 63), (128, 0, 0)])
def test_constant_blocks(spark, pixel, cpu, stream):
    d = Spark()
    df = spark.createDataFrame([([pixel] * 64,)], "px array<int>")
    df = df.selectExpr(f"{codec.level_shift(d)} AS shifted").selectExpr(f"{codec.dct(d)} AS dct", f"{codec.dct_stream(d)} AS fixed", f"{codec.dct_fourk(d)} AS fourk")
    a, b, c = df.selectExpr(f"{codec.quantise(d)} AS a", f"{codec.quantise_stream(d, 'fixed')} AS b", f"{codec.quantise_fourk(d)} AS c").first()
    assert (a[0], b[0], c[0]) == (cpu, stream, stream) and not any(c[1:]) and not any(a[1:]) and not any(b[1:])


def test_ordered_dct_is_bit_equal(spark):
    r = np.random.default_rng(1)
    x = r.integers(-128, 128, (20, 64))
    d = Spark()
    got = spark.createDataFrame([(v.tolist(),) for v in x], "shifted array<int>").selectExpr(f"{codec.dct(d)} AS y").collect()
    c = tables.basis()
    for v, g in zip(x.tolist(), got):
        # sum() would compensate for rounding
        t = [reduce(add, [c[u * 8 + k] * v[k * 8 + j] for k in range(8)]) for u in range(8) for j in range(8)]
        y = [reduce(add, [t[u * 8 + k] * c[j * 8 + k] for k in range(8)]) for u in range(8) for j in range(8)]
        assert list(g.y) == y


def test_documents_encode_as_whole_numbers_say(spark):
    got = {(r.doc_id, r.block_id): (r.dc, r.pairs) for r in catalog.queries()["encode_documents_cpu"](spark, SF).collect()}
    c = np.array(tables.basis()).reshape(8, 8)
    seen = 0
    for doc in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect():
        data = np.frombuffer((doc.text or "").encode(), np.uint8)
        grid = data[: len(data) // 512 * 512].reshape(-1, 64).astype(float) - 128
        for k in range(len(grid) // 8 * 8):
            x = grid[k // 8 * 8 : k // 8 * 8 + 8, k % 8 * 8 : k % 8 * 8 + 8]
            y = (c @ x @ c.T / np.array(tables.QUANT).reshape(8, 8)).reshape(-1)
            if np.abs(np.abs(y) % 1 - 0.5).min() < 1e-9:
                continue  # a tie, which the order of sums decides
            q = np.sign(y) * np.floor(np.abs(y) + 0.5)
            assert got[doc.doc_id, k] == (q[0], np.count_nonzero(q[1:]))
            seen += 1
    assert seen > 50


def test_odd_vectors(spark, tmp_path):
    """Vectors of other lengths, or with null or NaN, are no blocks; repeated and null ids are blocks apart."""
    r = np.random.default_rng(4)
    good = [(1, r.normal(0, 0.2, 64).tolist(), 0), (1, r.normal(0, 0.2, 64).tolist(), 0), (None, r.normal(0, 0.2, 64).tolist(), None), (2, [float("inf"), -float("inf")] * 32, 1), (3, [0.0] * 64, 1)]
    bad = [(4, [0.1] * 3, 0), (5, None, 0), (6, [], 2), (7, [0.1] * 63 + [None], 1), (8, [float("nan")] * 64, 1)]
    spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name, sql in catalog.oracle_sql().items():
        if "FROM embeddings" in sql and "fourk" not in name:
            got, want = catalog.queries()[name](spark, str(tmp_path)), con.sql(sql)
            assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()), name
    assert "Exchange" not in catalog.queries()["rle_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
