"""Mixing, URL lists, toxicity, vector searches, components and the pipeline."""

import collections
import datetime as dt
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from check_queries import compare, duck
from itemloom.llm import components, kdtree, mixing, queries, rabit, toxicity, urls

RND = random.Random(9)


def words(n):
    return " ".join("".join(RND.choice("aeioulmnrst") for _ in range(RND.randint(2, 8))) for _ in range(n))


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by refilling until no source is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    left = {s: weights[k % len(weights)] for k, s in enumerate(order) if sizes[s]}
    rest, out = share * sum(sizes.values()), {s: 0.0 for s in sizes}
    while left:
        total = sum(left.values())
        over = [s for s in left if rest * left[s] / total > most * sizes[s]]
        if not over:
            return out | {s: rest * w / total for s, w in left.items()}
        for s in over:
            out[s] = float(most * sizes[s])
        rest -= sum(out[s] for s in over)
        for s in over:
            del left[s]
    return out


def test_targets_and_takes(spark):
    rows = [(k, words(RND.choice([0, 1, 3, 40, 200])), RND.choice(["a", "b", "b", "b", "Z", "é", None]), "en", 0, 7) for k in range(400)]
    rows += [(None, words(30), "a", "en", 0, 7), (5, rows[5][1], rows[5][2], "en", 0, 7), (900, None, "b", "en", 0, 7), (901, " \t\n", "only", "en", 0, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint, size int").repartition(4)
    got = mixing.taken_words(docs).collect()
    count = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sizes = collections.Counter()
    for r, n in zip(rows, count):
        sizes[r[2]] += n
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in got) == sorted((r[0] is None, r[0], n) for r, n in zip(rows, count))
    want, taken = water(dict(sizes)), collections.Counter()
    by_id = {r[0]: r[2] for r in rows}
    for r in got:
        assert r["source_size"] == sizes[by_id[r["doc_id"]]] and r["target"] == pytest.approx(want[by_id[r["doc_id"]]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[by_id[r["doc_id"]]] += r["taken"]
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.05 * target + 3 * mixing.BLOCK
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken_words(docs.repartition(7)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    again = collections.Counter()
    for r in mixed.collect():
        again[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert {s: n for s, n in again.items() if s != by_id[5]} == {s: n for s, n in taken.items() if n and s != by_id[5]}
    assert mixing.taken_words(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_permutations_take_every_block_once_a_round(spark):
    drawn = spark.createDataFrame([(0, 0, 37, 40), (1, 0, 37, 40), (0, 1, 1, 2), (0, 2, 64, 64)], "shard bigint, rank int, blocks bigint, count bigint")
    taken = collections.defaultdict(list)
    for r in mixing.slots(drawn).collect():
        taken[r["rank"], r["round"]].append(r["block"])
    assert {k: len(v) for k, v in taken.items()} == {(0, 0): 37, (0, 1): 37, (1, 0): 1, (1, 1): 1, (2, 0): 64}
    assert all(sorted(v) == list(range(len(v))) for v in taken.values())


def test_url_lists(spark):
    day = dt.date(2024, 1, 1)
    entries = [("example.com", "block", 10), ("example.com", "allow", 50), ("a.example.com", "drop", 20), ("A.example.com", "block", 5), ("example.com/x", "allow", 12), ("example.com", "drop", 90), (None, "block", 1), ("z.org", "noise", 1), ("z.org", "block", None), ("example.com", "block", 10)]
    captures = [(k, u, d) for k, (u, d) in enumerate([("https://example.com/x/y?q", 11), ("http://u@example.com:80/x/y", 12), ("https://a.example.com/", 9), ("https://a.example.com/", 10), ("https://a.example.com/", 60), ("https://example.com/", 90), ("https://badexample.com/", 30), ("no url", 30), (None, 30), ("https://z.org", 5), ("https://example.com.", 49), ("https://example.com/x", None)])]
    captures += [captures[0], (None, captures[3][1], 10)]
    list_ = spark.createDataFrame([(p, a, day + dt.timedelta(d) if d else None, 1) for p, a, d in entries], "pattern string, action string, day date, salt int")
    table = spark.createDataFrame([(k, u, day + dt.timedelta(d) if d else None, 3) for k, u, d in captures], "capture_id bigint, url string, fetched date, period int")
    got = urls.judge(table, list_).collect()
    verdicts = {r["capture_id"]: (r["verdict"], r["pattern"]) for r in got}
    assert len(got) == len(captures)
    assert [verdicts[k] for k in range(12)] == [
        ("block", "example.com"), ("allow", "example.com/x"), ("block", "a.example.com"), ("block", "a.example.com"), ("allow", "example.com"), ("none", None),
        ("none", None), ("none", None), ("none", None), ("none", None), ("block", "example.com"), ("none", None),
    ]
    assert urls.judge(table.limit(0), list_).count() == 0
    assert {r["verdict"] for r in urls.judge(table, list_.limit(0)).collect()} == {"none"}


def test_toxicity_learns_and_keeps_its_fold(spark):
    rows = [(k, words(60) + (" you utter blockhead " if k % 5 == 0 else " fine ") + words(40), int(k % 5 == 0)) for k in range(400)]
    docs = spark.createDataFrame([(k, t, 1) for k, t, _ in rows] + [(None, None, 1), (5000, "", 1), (5001, "utter blockhead " + words(3000), 1)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(k, 0, y) for k, _, y in rows] + [(None, 0, 1), (3, 0, None), (10**9, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    fold = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in got.items() if r["held_out"]} - {5000, 5001, 10**9} == set(fold)
    right = sum(got[k]["predicted"] == rows[k][2] for k in fold)
    assert right >= 0.95 * len(fold)
    # Held-out labels change nothing.
    flipped = spark.createDataFrame([(k, 0, 1 - y if k in fold else y) for k, _, y in rows], "doc_id bigint, quality int, toxic int")
    other = toxicity.train(docs, flipped)
    assert np.allclose(model[0], other[0]) and model[1] == pytest.approx(other[1])
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got.values())
    weights, intercept = toxicity.train(docs, labels.limit(0))
    assert not weights.any() and toxicity.toxicity(docs.limit(0), (weights, intercept)).count() == 0


def vectors(n, length, seed):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((n, length))
    base[n // 2 :] = base[rnd.integers(0, 6, n - n // 2)] + 0.15 * rnd.standard_normal((n - n // 2, length))
    return base


ODD = [(7001, None), (7002, []), (7003, [None, 1.0]), (7004, [float("nan")] * 16), (7005, [float("inf")] * 16), (7006, [0.0] * 16), (7100, [0.5, -0.5]), (7101, [0.5, -0.4]), (None, [1.0] * 16)]


@pytest.mark.parametrize("shard", [60, 10_000])
def test_top_k_is_exact(spark, shard):
    points = vectors(500, 16, 1)
    points[40] = points[41] = points[42]
    rows = [(k, p.tolist()) for k, p in enumerate(points)] + ODD
    got = collections.defaultdict(list)
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, part int").repartition(3)
    for r in kdtree.top_k(table, shard=shard).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in usable:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i and len(w) == len(v))[:10]
            assert got.pop(i) == [(k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    assert not got and kdtree.top_k(table.limit(0)).count() == 0


def test_products_beyond_floating_point():
    a, b = np.array([[2**31 + 1, 3]]), np.array([[2**30 + 7, -5]])
    assert kdtree.exact_products(a, b)[0, 0] == (2**31 + 1) * (2**30 + 7) - 15


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(rabit, "BLOCK", 40)  # cells of several blocks
    points = vectors(600, 16, 2)
    rows = [(k, p.tolist()) for k, p in enumerate(points)] + [(1000 + k, points[3].tolist()) for k in range(5)] + ODD
    got = {r["vec_id"]: r for r in rabit.near_duplicates(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, links int")).collect()}
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: {j for j, w in usable if j != i and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9} for i, v in usable}
    found = sum(got[i]["n_links"] for i in links)
    assert len(got) == len(rows) and all(got[i]["n_links"] <= len(n) for i, n in links.items())
    assert found >= 0.98 * sum(map(len, links.values()))
    for i, v in ODD:
        if i is None or i < 7100:
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, i is not None)
    assert got[7100]["component_id"] == 7100 and got[7101]["component_id"] == 7100
    assert all(got[1000 + k]["component_id"] == got[3]["component_id"] for k in range(5))
    assert rabit.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(200, 200 + k) for k in range(1, 40)] + [(500, 400), (400, 450), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{200 + k: 200 for k in range(40)}, 400: 400, 450: 400, 500: 400}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, duck(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf).startswith("ok")


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (None, "", "src1", "en", 0), (10**6 + 1, "token = abcdefgh1234 " + words(30), "src1", "en", 0)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= 2 * before.count()
        if name == "secret_scan":
            assert docs.filter("text like '[assign]%'").count() == 1
    assert set(docs.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    empty = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
