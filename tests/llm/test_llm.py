"""Each operator on odd input (nulls, empty and long texts, repeated rows, empty tables) and against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

pytest.importorskip("blockloom.llm")
from blockloom.llm import bpe, covertree, exact, htmltext, lines, minhash, packing, quality, sharding, toxicity  # noqa: E402
from blockloom.llm._common import tokenizer, tokenizer_path  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(20000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "one two three"), (None, None), (6, LONG), (7, LONG), (8, "a  b\n\nc é 日本 <|endoftext|>")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "uid", 0) for i, t in ODD], "doc_id long, text string, node string, n int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_exact(spark, odd, none):
    got = exact.exact_dedup(odd, keep="largest").collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == len({t or "" for _, t in ODD})
    assert {r.keep_id for r in got if r.group_size == 3} == {5} or {r.keep_id for r in got if r.doc_id in (1, 2)} == {2}
    assert exact.exact_dedup(none).count() == 0


def test_exact_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(exact.SQL).fetchall())
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.op10_exact_dedup(spark, SF).collect())
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n, 3)
    y = f.forward(np.arange(n))
    assert sorted(y) == list(range(n)) and (f.backward(y) == np.arange(n)).all()


def test_sharding(spark, odd, none):
    got = sharding.shard(odd, 4).collect()
    assert len(got) == len(ODD)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for r in got:
        assert sharding.row_at(np.array([r.shard]), np.array([r.slot]), len(ODD), 4)[0] == r.row_number
    assert sharding.shard(none, 4).count() == 0


def texts(k=300):
    r, letters = random.Random(4), list(" \n\t'  aZé0.,!<|>s ́日à")
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(k)] + [t for _, t in ODD if t]


def test_bpe_equals_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    t, c = tokenizer(path), bpe.Codec(path)
    for x in texts():
        ids = t.encode(x, add_special_tokens=False).ids
        assert c.encode(x.encode()) == ids and c.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_odd(spark, odd, none):
    path = tokenizer_path("byte_bpe_50k.json")
    got = bpe.encode_texts(odd, path).collect()
    assert len(got) == len(ODD) and {r.ids_sha256 for r in got if r.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode_texts(none, path).count() == 0


def test_packing_ids_equal_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    t, w = tokenizer(path), packing.WordIds(path)
    for x in texts():
        assert np.frombuffer(w(x.encode()), dtype="<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 0]


def test_packing(spark, odd, none):
    got = packing.best_fit_packing(odd, tokenizer_path("word_bpe_49k.json"), capacity=64).collect()
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 64 and len(fill) >= packing.lower_bound(np.array([r.length for r in got]), 64)
    assert len(fill) <= packing.lower_bound(np.array([r.length for r in got]), 64) + 1
    assert packing.best_fit_packing(none, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_bound_is_below_best_fit():
    r = np.random.default_rng(2)
    for _ in range(50):
        n = np.sort(r.integers(1, 101, r.integers(1, 80)))[::-1]
        b = packing.best_fit_decreasing(n, 100)
        assert np.bincount(b, weights=n).max() <= 100 and packing.lower_bound(n, 100) <= b.max() + 1


def near_groups(docs, q, percent):
    sets = [frozenset(tuple(w[i : i + q]) for i in range(max(1, len(w) - q + 1))) if (w := (t or "").encode().lower().split()) else frozenset() for _, t in docs]
    top = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    return top, sets


@pytest.mark.parametrize("block,share", [(minhash.BLOCK, minhash.SHARE), (4, 3)])
def test_minhash_against_brute_force(spark, none, monkeypatch, block, share):
    # With small blocks a bucket is dealt to many of them, on both sides.
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SHARE", share)
    r = random.Random(9)
    base = [[f"w{r.randint(0, 4000)}" for _ in range(60)] for _ in range(6)]
    docs = []
    for i in range(120):
        w = base[i % 6][:]
        for _ in range(r.randint(0, 14)):
            w[r.randint(0, 59)] = f"x{r.randint(0, 10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "Solo"), (503, "solo")]
    top, sets = near_groups(docs, 2, 80)
    got = {x.doc_id: x for x in minhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), words=2).collect()}
    least = {}
    for (i, _), t in zip(docs, top):
        least[t] = min(least.get(t, i), i)
    for (i, _), t, s in zip(docs, top, sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), least[t], least[t] == i)
    assert minhash.near_dedup(none).count() == 0


def test_minhash_odd(spark, odd):
    assert minhash.near_dedup(odd, words=2).count() == len(ODD)


def test_gathered_buckets_keep_every_pair(spark):
    r = np.random.default_rng(4)
    a = np.where(r.random((80, minhash.SIZE)) < 0.88, 1, r.integers(2, 5, (80, minhash.SIZE))).astype(np.uint16)
    a[60:] = r.integers(0, 2, (20, minhash.SIZE))  # no value has half of their buckets
    index = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(a)], "node long, sig binary").mapInArrow(minhash._index, "bucket long, node long, slot int, rest long")
    sizes = index.groupBy("bucket").count().withColumnRenamed("count", "size").filter("size > 2")
    members = index.join(sizes, "bucket")
    before, after = {}, {}
    for x in members.collect():
        before.setdefault((x.bucket, x.slot), set()).add(x.node)
    got = minhash._gathered(members).collect()
    for x in got:
        after.setdefault((x.bucket, x.slot), set()).add(x.node)
    homes = [{k for k, v in after.items() if i in v} for i in range(80)]
    chunk = lambda slot: slot // len(minhash._FREE) if slot >= 0 else -1 - slot
    for (_, slot), nodes in before.items():
        assert any(chunk(s) == chunk(slot) and nodes <= after[b, s] for b, s in set.intersection(*(homes[i] for i in nodes)))
    assert {s < 0 for _, s in after} == {True, False}
    assert len(got) == sum(map(len, after.values())) < 0.5 * sum(map(len, before.values()))
    assert len({(x.bucket, x.slot, x.size) for x in got}) == len(after)


def test_a_large_group_of_near_copies_comes_once_a_chunk(spark, tmp_path, monkeypatch):
    import uuid

    # Edits of one text, most of them too far from each other for a link: the pivots leave the buckets full.
    r = random.Random(3)
    base, docs = [f"w{i}" for i in range(150)], []
    for i in range(300):
        w = base[:]
        for _ in range(r.randint(1, 14)):
            w[r.randint(0, 149)] = f"x{r.randint(0, 10**6)}"
        docs.append((i, " ".join(w)))
    real = minhash._across

    def counted(percent, best):
        run = real(percent, best)

        def rows(batches):
            held = [*batches]
            (tmp_path / uuid.uuid4().hex).write_text(str(sum(sum(b.column("right").to_pylist()) for b in held)))
            yield from run(held)

        return rows

    monkeypatch.setattr(minhash, "_across", counted)
    top, _ = near_groups(docs, 5, 80)
    got = {x.doc_id: x.component_id for x in minhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert [got[i] for i, _ in docs] == top and 1 < len(set(top)) < 300
    # In two rounds; by single buckets it is 22 times the classes in each.
    assert 0 < sum(int(x.read_text()) for x in tmp_path.iterdir()) <= 2 * len(docs) * minhash.CHUNKS


def test_first_slot_agrees_with_the_index():
    import pyarrow as pa

    r = np.random.default_rng(0)
    a = r.integers(0, 2, (40, minhash.SIZE)).astype(np.uint16)
    out = [*minhash._index([pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in a], pa.binary()), pa.array(np.arange(40))], names=["sig", "node"])])]
    keys = {n: {} for n in range(40)}
    for o in out:
        for b, n, s in zip(*(o.column(c).to_pylist() for c in ("bucket", "node", "slot"))):
            keys[n][s] = b
    for i in range(40):
        shared = [[s for s in sorted(keys[i]) if keys[i][s] == keys[j][s]] for j in range(40)]
        first = minhash._first_slot(a == a[i])
        assert all(not s or f == s[0] for s, f in zip(shared, first))


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(3)
    c = r.normal(size=(5, 16))
    x = np.concatenate([c[i % 5] + 0.12 * r.normal(size=16) for i in range(200)]).reshape(200, 16)
    data = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, x[0].tolist(), None), (904, [1.0], 1), (905, [2.0], 1), (None, x[1].tolist(), 1)]
    got = {v.vec_id: v for v in covertree.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    y = x / np.linalg.norm(x, axis=1)[:, None]
    m = (y @ y.T >= 0.98) & (np.arange(200)[:, None] % 3 == np.arange(200) % 3) & ~np.eye(200, dtype=bool)
    for i in range(200):
        seen, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(m[todo.pop()])) - seen
            seen |= new
            todo += new
        extra = int(i % 3 == 1 and (m[i, 1] or i == 1))
        assert (got[i].n_links, got[i].component_id) == (m[i].sum() + extra, min(seen))
    assert got[904].n_links == 1 and got[905].component_id == 904 and all(got[k].n_links == 0 and got[k].kept for k in (900, 901, 902, 903))


def test_lines_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(lines.op2_line_dedup(spark, SF).collect()) == sorted(con.sql(lines.SQL).fetchall())


def test_lines_odd(spark, odd, none):
    a, b = " ".join(["x"] * 30), " ".join(["y"] * 30)
    docs = spark.createDataFrame([(1, f"{a}\n\n{b}\nend"), (2, f"start\n{a}\n\n{b}"), (3, b), (4, None)], "doc_id long, text string")
    assert dict(lines.line_dedup(docs).collect()) == {1: f"{a}\n\n{b}\nend", 2: "start", 3: b, 4: None}
    got = lines.line_dedup(odd)
    assert got.columns == odd.columns and got.count() == len(ODD) and {r.text for r in got.collect() if r.doc_id == 7} == {""}
    assert lines.line_dedup(none).count() == 0


def test_classifiers(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for module, score, column in ((quality, quality.score_quality, "quality"), (toxicity, toxicity.score_toxicity, "toxic")):
        model = module.train(docs, labels)
        got = score(docs, model).join(labels, "doc_id").filter("held_out").select("predicted", column).toPandas()
        assert (got.predicted == got[column]).mean() > 0.95
        assert all(0 <= r.score <= 1 for r in score(odd, model).collect()) and score(odd, model).count() == len(ODD)
        assert score(none, model).count() == 0
        blank = module.train(docs, labels.limit(0))
        assert score(odd, blank).count() == len(ODD)


def test_html(spark):
    model = htmltext.train(htmltext.labelled_pages())
    good = total = 0
    for source, content in htmltext.labelled_pages(80, seed=77):
        page = htmltext.Page(source)
        for (e, t), m in zip(page.blocks, [model.marginals(page)[e] > 0.5 for e, _ in page.blocks]):
            good, total = good + (m == (t in content)), total + 1
    assert good / total > 0.95
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>T &amp; U</h1><p>One\n two<p>Three</article><footer>&copy; x</footer>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<")], "page_id long, url string, html string")
    got = {r.page_id: r for r in htmltext.extract(pages, model).collect()}
    assert got[1].text == "T & U One two Three" and got[1].n_chars == 19 and got[2].text == ""
    assert htmltext.extract(pages.limit(0), model).count() == 0


def test_filters_keep_what_the_scores_say(spark, odd, none):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    for module, score, keep, sign in ((quality, quality.score_quality, quality.keep_good, 1), (toxicity, toxicity.score_toxicity, toxicity.keep_clean, 0)):
        model = module.train(docs, labels)
        for rows in (docs, odd):
            kept = keep(rows, model)
            assert kept.schema == rows.schema
            want = score(rows, model).filter(f"predicted = {sign}").select("doc_id").collect()
            assert sorted(map(str, kept.select("doc_id").collect())) == sorted(map(str, want))
        assert keep(none, model).count() == 0


def test_words_of_lines_at_any_white_space(spark, tmp_path):
    """A repeated line counts its words at tabs and wide spaces."""
    lines_ = ["\t".join(f"t{i}" for i in range(50)), " ".join(f"n{i}" for i in range(50)), "　".join(f"w{i}" for i in range(49)), "漢" * 99, "字" * 98, " ".join(f"é{i}" for i in range(50)), "\r".join(["x"] * 50)]
    docs = [(i + 20 * k, f"{line}\nend {i} {k}") for k in range(2) for i, line in enumerate(lines_)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.lines_removed for r in lines.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[20 + i] for i in range(len(lines_))] == [1, 1, 0, 0, 0, 1, 1] and not any(got[i] for i in range(len(lines_)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r[2] for r in con.sql(lines.SQL).fetchall()} == got


def test_lines_beside_clashing_columns(spark):
    a = " ".join(["x"] * 50)
    docs = spark.createDataFrame([(1, a, 7, 8, 9), (2, a, 7, 8, 9)], "doc_id long, text string, __runs int, __id int, lines_removed int")
    got = lines.line_dedup(docs, removed_col="lines_removed").orderBy("doc_id").collect()
    assert [(r.text, r["__runs"], r["__id"], r.lines_removed) for r in got] == [(a, 7, 8, 0), ("", 7, 8, 1)]


def test_plain_texts_have_no_white_space_but_spaces(spark):
    """Each rare white space is found, whatever its first bytes; characters that begin alike aren't white space."""
    from pyspark.sql import functions

    texts = [*(f"a{chr(c)}b" for c in lines.RARE), "a “b” – c", "a b\nc", "", None]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(lines._plain(functions.col("t"))).collect()
    assert [r[0] for r in got] == [False] * len(lines.RARE) + [True, True, True, None]
