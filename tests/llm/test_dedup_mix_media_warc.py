"""Near-duplicates, mixing, media, archives and graphs against brute force on small tables."""

import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import common, embeddings, graph, media, mixing, simhash, warc

ODD = [None, "", " ", "\n\t ", "a", "É x", "a  b\n c", "A B C", "a b c", "a b c d", "x" * 4000, "na na na", "na na na", "ab cd " * 2000, "w" * 31 + " " + "v" * 40 + " u"]


# -- plain versions


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, links):
    parent = {i: i for i in range(len(ids))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return [low.get(root(k)) for k in range(len(ids))]


# -- graphs


@pytest.mark.parametrize("finish", [10**6, 3])
def test_components(spark, finish):
    r = random.Random(5)
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 30)]
    loose = [(r.randint(200, 240), r.randint(200, 240)) for _ in range(25)]
    edges = chain + star + loose + chain[:5] + [(300, 300)]
    r.shuffle(edges)
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long"), finish).collect()}
    nodes = sorted({n for e in edges for n in e if e[0] != e[1]})
    expected = dict(zip(nodes, plain_components(nodes, [(nodes.index(a), nodes.index(b)) for a, b in edges if a != b])))
    assert got == expected
    assert graph.components(spark.createDataFrame([], "a long, b long"), finish).count() == 0


def test_join_keyed_hot_and_null_keys(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = left.select("k").distinct().withColumn("v", F.concat(F.lit("v"), F.coalesce("k", F.lit("null"))))
    rows = common.join_keyed(left, right, "k").collect()
    assert len(rows) == 6000 and all(r["v"] == "v" + (r["k"] or "null") for r in rows)
    plans = common.join_keyed(left, right, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plans and "strategy=broadcast" in plans


# -- simhash


def test_fingerprints():
    texts = ODD + ["".join(random.Random(k).choice("ab \né") for _ in range(k % 40)) for k in range(400)]
    buf, offs = common.utf8(pa.array(texts, pa.string()))
    got = np.concatenate([simhash.fingerprints(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in common.steps(offs, 3000)])
    assert got.tolist() == [plain_print(t) for t in texts]


@pytest.mark.parametrize("m", [4, 5, 6, 7])
def test_close_pairs_share_a_block(m):
    masks, r = simhash.block_masks(m), random.Random(m)
    assert len(masks) == math.comb(m, m - 3)
    for _ in range(300):
        x = sum(1 << b for b in r.sample(range(64), 3))
        assert any(x & k == 0 for k in masks)


def check_near(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, component_id string, fp string")
    out = simhash.near_duplicates(df, **kw).collect()
    prints = [plain_print(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    near = [0] * len(rows)
    for a, b in links:
        near[a] += 1
        near[b] += 1
    comp = plain_components([i for i, _ in rows], links)
    expected = sorted((str(i), f"{p:016x}", n, str(c), i == c) for (i, _), p, n, c in zip(rows, prints, near, comp))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["n_near"], str(r["component_id"]), r["kept"]) for r in out) == expected


def test_near_duplicates(spark, monkeypatch):
    r = random.Random(3)
    base = ["".join(r.choice("abcdef") for _ in range(5)) for _ in range(300)]
    texts = list(ODD)
    for _ in range(12):
        words = [r.choice(base) for _ in range(120)]
        for k in range(r.randint(1, 8)):
            changed = list(words)
            for _ in range(k % 3):
                changed[r.randrange(120)] = r.choice(base)
            texts.append(" ".join(changed))
    rows = list(enumerate(texts)) + [(3, "a b c"), (3, "a b c"), (None, texts[-1]), (None, "alone here now")]
    check_near(spark, rows)
    monkeypatch.setattr(graph, "BLOCK", 4)  # buckets of more than four fingerprints go in blocks
    check_near(spark, rows, m=4)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_bucket_in_blocks(spark, monkeypatch):
    """Many distinct fingerprints in one bucket: counts and components stay exact."""
    monkeypatch.setattr(graph, "BLOCK", 16)
    r = random.Random(9)
    prints = sorted({sum(1 << b for b in r.sample(range(20), r.randint(0, 4))) for _ in range(150)})
    df = spark.createDataFrame([(k, p) for k, p in enumerate(prints)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "simhash", lambda docs, *a, **kw: df)
    out = {x["doc_id"]: x for x in simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), m=4).collect()}
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    near = np.bincount(np.array(links).ravel(), minlength=len(prints))
    comp = plain_components(list(range(len(prints))), links)
    assert [out[k]["n_near"] for k in range(len(prints))] == near.tolist() and [out[k]["component_id"] for k in range(len(prints))] == comp


def plain_drop(rows):
    """What drop_near_duplicates keeps, as (doc_id, text): a row of each component, by id, fingerprint (signed)."""
    prints = [plain_print(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    comp = plain_components(list(range(len(rows))), links)
    best = {}
    for k, (i, t) in enumerate(rows):
        key = (i is None, i or 0, prints[k] - (1 << 64) if prints[k] >> 63 else prints[k])
        best.setdefault(comp[k], set()).add((key, t))
    return best


@pytest.mark.parametrize("seed,most", [(1, 1_000_000), (2, 0), (3, 1_000_000)])
def test_dropping_decides_by_rows(spark, seed, most):
    """Repeated ids, null ids, repeated rows, near and exact copies, nulls and empty texts against the plain version."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcdef") for _ in range(5)) for _ in range(200)]
    texts = [None, "", "a", "a b c d"]
    for _ in range(10):
        words = [r.choice(base) for _ in range(150)]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join(words[:-1])]
    rows = [(r.choice([None, 1, 2, 3, 4, 5, 6, 7]), r.choice(texts)) for _ in range(120)]
    df = spark.createDataFrame([(i, t, k % 2, {"a": 1}) for k, (i, t) in enumerate(rows)], "doc_id long, text string, mark1 int, `row` map<string,int>")
    kept = simhash.drop_near_duplicates(df, broadcast_rows=most)
    assert kept.columns == df.columns
    got = [(x["doc_id"], x["text"]) for x in kept.collect()]
    best = plain_drop(rows)
    allowed = []
    for found in best.values():
        top = min(k for k, _ in found)
        allowed.append({(None if top[0] else top[1], t) for k, t in found if k == top})
    assert len(got) == len(allowed)
    for options in allowed:
        assert sum(g in options for g in got) == 1
    again = simhash.drop_near_duplicates(df.repartition(7), broadcast_rows=most)
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_dropping_loses_no_other_text(spark):
    a, b = "a b c d", "something else entirely here"
    for rows, stays in (
        ([(3, a), (5, a), (5, b)], [(3, a), (5, b)]),
        ([(1, a), (None, a)], [(1, a)]),
        ([(None, b), (None, b), (None, a)], [(None, a), (None, b)]),
        ([(3, a), (5, a), (5, b), (5, b), (6, a), (8, None), (9, ""), (9, b + " and more of it")], [(3, a), (5, b), (8, None), (9, b + " and more of it")]),
    ):
        kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(str, stays))
    one_id = [(5, " ".join(f"w{k}" for k in range(400))), (5, " ".join(f"w{k}" for k in range(401)))]
    assert (plain_print(one_id[0][1]) ^ plain_print(one_id[1][1])).bit_count() <= 3
    assert simhash.drop_near_duplicates(spark.createDataFrame(one_id, "doc_id long, text string")).count() == 1
    assert simhash.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_in_slices():
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abAé") for _ in range(r.randint(1, 9))) for _ in range(300)), "x" * 500, "x" * 300 + " y", "a " + "B" * 400 + "  c d\n" + "e" * 200 + " f g", "one two", " " * 200, " " * 90 + "a" + " " * 90, ("w" * 70 + " ") * 9]
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        for step in (1, 2, 7, 64, 1000):
            assert simhash.long_fingerprint(raw, step=step) == plain_print(text)


# -- embeddings


def check_links(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], f"vec_id long, embedding array<{kind}>, n_links string")
    out = embeddings.cosine_links(df, recall=0.9999).collect()
    dtype = np.float32 if kind == "float" else np.float64
    good = [None if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, dtype).astype(float) for _, v in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if good[a] is not None and good[b] is not None and len(good[a]) == len(good[b]) and good[a] @ good[b] / math.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.9]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = plain_components([i for i, _ in rows], links)
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in out) == sorted((str(i), k, str(c), i == c) for (i, _), k, c in zip(rows, n, comp))


@pytest.mark.parametrize("kind,block,fill", [("float", 4096, 1 << 19), ("double", 8, 32)])
def test_cosine_links(spark, monkeypatch, kind, block, fill):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "FILL", fill)
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(12, 24))
    rows = [(k, (centers[k % 12] + rng.normal(size=24) * rng.choice([0.05, 0.35])).tolist()) for k in range(120)]
    rows += [(200, None), (201, []), (202, [0.0] * 24), (203, [1.0, None]), (204, [float("nan")] * 24), (205, rows[3][1]), (206, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (207, [2 * x for x in rows[7][1]]), (208, [1.0, 2.0]), (209, [1.0, 2.01]), (210, [float("inf"), 1.0])]
    check_links(spark, rows, kind)


def test_norms_neither_overflow_nor_vanish(spark):
    rows = [(1, [1e-180, 2e-180]), (2, [1e-180, 2e-180]), (3, [1e200, 2e200]), (4, [1.0, 2.0]), (5, [5e-324, 0.0]), (6, [1.0, 0.0]), (7, [-1e300, 0.0])]
    out = embeddings.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.9999).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_sketches_do_not_depend_on_company():
    v = np.random.default_rng(1).normal(size=(500, 64)).astype(np.float32).astype(float)
    whole = embeddings.sketches(v)
    assert (np.concatenate([embeddings.sketches(v[k : k + 7]) for k in range(0, 500, 7)]) == whole).all() and (embeddings.sketches(v * 2.0**40) == whole).all()


@pytest.mark.parametrize("n", [100, 51_282, 10**6, 10**8, 10**10])
def test_plan_at_any_size(n):
    """Recall by the plan's own chances at the threshold, and what is shuffled a vector (at most 88 bytes a table)."""
    p, same = embeddings.plan(n, 0.9), 1 - math.acos(0.9) / math.pi
    found = (1 - (1 - same**p.bits) ** p.tables) * (1 - (1 - same**p.inner_bits) ** p.inner)
    assert found >= 0.975 and n / 2**p.bits <= 2 * embeddings.FILL and n / 2 ** (p.bits + p.inner_bits) <= 32
    assert p.tables <= (14 if n <= 10**8 else 45)


def test_candidates_are_each_pair_once(monkeypatch):
    monkeypatch.setattr(embeddings, "STEP", 50)
    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 2**63, (40, 3), dtype=np.uint64)
    sketch = np.concatenate([sketch, sketch[:20] ^ np.uint64(5), sketch[:10], sketch[:1].repeat(15, 0)])
    inner = embeddings.choices(3, 5, 1, False)
    mask = embeddings.masks(inner)
    got = [(int(x), int(y)) for a, b, _ in embeddings.candidates(sketch, inner, 12) for x, y in zip(a, b)]
    want = [(x, y) for x in range(len(sketch)) for y in range(x + 1, len(sketch)) for d in [sketch[x] ^ sketch[y]] if np.bitwise_count(d).sum() <= 12 and any(not (d & m).any() for m in mask)]
    assert sorted(got) == want


def test_recall_at_the_threshold(spark):
    """Among 51 000 vectors, pairs just above the threshold are found as often as planned; nothing below it is linked."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(17_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b, far = 0.901 * a + math.sqrt(1 - 0.901**2) * o, 0.895 * a + math.sqrt(1 - 0.895**2) * o
    vectors = np.concatenate([a, b, -far])
    table = pa.table({"vec_id": np.arange(len(vectors)), "embedding": pa.FixedSizeListArray.from_arrays(vectors.ravel(), 64).cast(pa.list_(pa.float64()))})
    out = {r["vec_id"]: r["n_links"] for r in embeddings.cosine_links(spark.createDataFrame(table).repartition(4)).collect()}
    assert sum(out[k] for k in range(17_000)) >= 0.96 * 17_000 and all(out[k] == 0 for k in range(34_000, 51_000))
    assert embeddings.cosine_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- mixing


def docs_of(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, "clash") for i, s, t in rows], "doc_id long, source string, text string, size int, target string")


def test_mix_against_the_rule(spark):
    r = random.Random(1)
    rows = [(k, r.choice(["b", "a", "é", None, "hot", "hot", "hot"]), " ".join(["w"] * r.randint(0, 60))) for k in range(900)]
    rows += [(k, "hot", None) for k in (1000, 1001)] + [(2000, "a", "same text here")] * 9 + [(None, None, "x y")] * 7 + [(3000, "zero", "")]
    df = docs_of(spark, rows)
    sizes = [len((t or "").split()) for _, _, t in rows]
    per = {}
    for (_, s, _), n in zip(rows, sizes):
        per[s] = per.get(s, 0) + n
    target = mixing.waterfill(per.items())
    assert abs(sum(target.values()) - 1.5 * sum(per.values())) < 1e-6 and all(target[s] <= 2 * per[s] for s in per)
    source = {i: s for i, s, _ in rows}
    out = mixing.mix(df).collect()
    assert sorted((str(x["doc_id"]), x["size"]) for x in out) == sorted((str(i), n) for (i, _, _), n in zip(rows, sizes))
    taken = {}
    for x in out:
        s = source[x["doc_id"]]
        assert x["source_size"] == per[s] and math.isclose(x["target"], target[s], abs_tol=1e-6) and x["taken"] <= 2 * x["size"]
        taken[s] = taken.get(s, 0) + x["taken"]
    assert all(abs(taken[s] - target[s]) <= 61 for s in per), (taken, target)
    again = mixing.mix(docs_of(spark, random.Random(2).sample(rows, len(rows)))).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", [10_000, 5])
def test_applied_mix_takes_what_the_mix_says(spark, monkeypatch, part):
    """The rows of each unit (doc_id, source, size) add up to the mix's total, and are the same at any partitioning."""
    monkeypatch.setattr(mixing, "PART", part)
    monkeypatch.setattr(mixing, "RANKED", 7)
    r = random.Random(8)
    rows = [(k, r.choice(["b", "a", None, "hot", "hot"]), " ".join(["w"] * r.randint(0, 60))) for k in range(200)]
    rows += [(7000, "hot", f"one of many {k}") for k in range(101)] + [(2000, "a", "same text here")] * 9 + [(None, None, "x y")] * 7 + [(None, None, "y x")] * 4 + [(3000, "zero", ""), (3001, "zero", None)]
    kind = "doc_id long, source string, text string, `__n` int, `row` string, times string"
    df = spark.createDataFrame([(i, s, t, 1, "r", "t") for i, s, t in rows], kind)
    units = {}
    for x in mixing.mix(df.select("doc_id", "source", "text").coalesce(1)).collect():
        units[x["doc_id"]] = units.get(x["doc_id"], 0) + x["taken"]
    first = None
    for n, most in ((1, 1_000_000), (4, 0), (7, 1_000_000)):
        applied = mixing.apply_mix(df.repartition(n), broadcast_rows=most)
        assert applied.columns == df.columns
        got = applied.collect()
        words = {}
        for x in got:
            words[x["doc_id"]] = words.get(x["doc_id"], 0) + len(x["text"].split())
        assert words == {i: n for i, n in units.items() if n}
        got = sorted(map(str, got))
        assert first is None or first == got
        first = got
    assert mixing.apply_mix(df.limit(0)).count() == 0


def test_targets_of_many_sources(spark):
    r = random.Random(3)
    sizes = [(None if k == 17 else f"s{k:03}", r.choice([0, 1, 5, 100, 10_000, 10**6])) for k in range(60)]
    want = mixing.waterfill(sizes)
    got = mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, size long, c long")).collect()
    assert len(got) == 60 and all(math.isclose(x["target"], want[x["source"]], rel_tol=1e-9, abs_tol=1e-9) for x in got)


def test_flight_keeps_both_totals():
    rng = random.Random(0)
    for trial in range(60):
        n = rng.randint(0, 80)
        size = [float(rng.choice([0, 1, 5, rng.randint(1, 500)])) for _ in range(n)]
        pi = [rng.random() for _ in range(n)]
        x = mixing.flight(pi, size, rng)
        assert sum(0 < p < 1 for p in x) <= 2 and math.isclose(sum(x), sum(pi), abs_tol=1e-5) and math.isclose(sum(a * b for a, b in zip(x, size)), sum(a * b for a, b in zip(pi, size)), abs_tol=1e-3)
        y = mixing.landing(x, size, rng)
        assert set(y) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(y, size)) - sum(a * b for a, b in zip(pi, size))) <= max(size, default=0) + 1e-3
        z = mixing.repair(y, pi, size)
        error = lambda v: abs(sum((a - p) * s for a, p, s in zip(v, pi, size)))
        assert set(z) <= {0.0, 1.0} and error(z) <= error(y) + 1e-6


def test_flight_keeps_expectations():
    pi, size, hits = [0.3, 0.5, 0.7, 0.2, 0.8], [3.0, 8.0, 1.0, 9.0, 4.0], np.zeros(5)
    for k in range(4000):
        hits += mixing.landing(mixing.flight(pi, size, random.Random(k)), size, random.Random(-k - 1))
    assert np.abs(hits / 4000 - pi).max() < 0.035


def test_blocks_of_a_large_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    r = random.Random(4)
    rows = [(k, "s" if k % 10 else "t", "w " * r.randint(1, 50)) for k in range(3000)]
    out = mixing.mix(docs_of(spark, rows)).collect()
    for s in "st":
        mine = [x for x in out if dict((i, q) for i, q, _ in rows)[x["doc_id"]] == s] if s == "t" else []
        if mine:
            assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 50
    total = sum(x["taken"] for x in out)
    assert abs(total - 1.5 * sum(x["size"] for x in out)) <= 100


def test_waterfill():
    assert mixing.waterfill([("a", 100), ("b", 100), ("c", 100)]) == {"a": 200.0, "b": 250 / 3, "c": 500 / 3}
    assert mixing.waterfill([]) == {} and mixing.waterfill([("a", 0)]) == {"a": 0.0}


# -- media


def slow_resize(image, height, width):
    h, w = image.shape
    fine = np.kron(image, np.ones((height, width)))
    return fine.reshape(height, h, width, w).mean((1, 3))


def slow_hash(image):
    small = np.round(slow_resize(image, 8, 9), 9)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


@pytest.mark.parametrize("form", ["auto", "pgm", "bmp"])
def test_media_round_trip(spark, monkeypatch, form):
    texts = [*ODD, "Ä long one " * 900]
    df = spark.createDataFrame([(k, t, "clash", "x") for k, t in enumerate(texts)], "doc_id long, text string, media string, tiles string")
    monkeypatch.setattr(media, "BAND", 20)  # the tall ones go in bands
    rows = {r["doc_id"]: r for r in media.media_columns(df, form, then=(media.digest, media.DIGESTS)).collect()}
    assert len(rows) == len(texts)
    for r in media.media_columns(df, form).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        d = rows[r["doc_id"]]
        image = np.frombuffer(padded, np.uint8).reshape(-1, 64)
        assert r["form"] == d["form"] == ("bmp" if form == "bmp" or form == "auto" and len(image) >= 64 else "pgm")
        assert (media.decode_bmp if r["form"] == "bmp" else media.decode_netpbm)(bytes(r["media"])).tobytes() == padded
        loaded = [np.load(io.BytesIO(t["npy"]), allow_pickle=False) for t in r["tiles"]]
        assert (np.concatenate(loaded) == image).all() and [t["row"] for t in r["tiles"]] == list(range(len(loaded))) and all(len(t) <= 64 for t in loaded)
        assert [t["hash"] for t in r["tiles"]] == [slow_hash(t) for t in loaded] and r["feature"] == slow_hash(image)
        assert np.allclose(np.load(io.BytesIO(r["thumb"])), slow_resize(image, 16, 16), atol=1e-4)
        assert (d["n_bytes"], d["payload_bytes"], d["payload_sha256"], d["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (d["media_bytes"], d["media_sha256"], d["feature"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest(), r["feature"])
        cut = b"".join(bytes(t["npy"]) + t["hash"].encode() for t in r["tiles"])
        assert (d["n_tiles"], d["tiles_sha256"], d["thumb_sha256"]) == (len(loaded), hashlib.sha256(cut).hexdigest(), hashlib.sha256(r["thumb"]).hexdigest())
    assert rows[11]["tiles_sha256"] == rows[12]["tiles_sha256"]
    assert media.media_columns(df.limit(0)).count() == 0


def test_media_query(spark):
    text = {r["doc_id"]: r["text"] for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    out = media.op10_media_columns(spark, "/root/testdata/sf0.001")
    kinds = ["bigint", "bigint", "bigint", "string", "bigint", "bigint", "string", "string"]
    assert out.dtypes[:8] == list(zip(["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], kinds))
    rows = out.collect()
    assert len(rows) == len(text) and {x["form"] for x in rows} == {"pgm", "bmp"}
    for x in rows:
        data = media.payload((text[x["doc_id"]] or "").encode())
        assert (x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))


def test_decoders():
    gray = np.arange(15, dtype=np.uint8).reshape(3, 5)
    assert (media.decode_bmp(media.encode_bmp(gray)) == gray).all()
    assert (media.decode_netpbm(b"P5 # note\n5 3\n255\n" + gray.tobytes()) == gray).all()
    assert media.decode_netpbm(b"P6\n2 1\n255\n" + bytes(range(6))).tolist() == [[[0, 1, 2], [3, 4, 5]]]
    for broken in (b"P4\n1 1\n255\n0", b"P5\nx", b"P5\n1 1\n70000\n0"):
        with pytest.raises(ValueError):
            media.decode_netpbm(broken)


def test_area_resize_is_the_mean_over_exact_areas():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (7, 10)).astype(np.uint8)
    fine = np.kron(image, np.ones((8 * 9, 9)))  # every target edge falls on a fine pixel's edge
    got = media.area_resize(image, 8, 9)
    h, w = fine.shape
    assert np.allclose(got, fine.reshape(8, h // 8, 9, w // 9).mean((1, 3)))
    assert np.allclose(media.area_resize(image, 7, 10), image)


# -- archives


def test_framing():
    for n in (0, 1, 8191, 8192, 20000):
        data = random.Random(n).randbytes(n)
        assert warc.unframe(warc.frame(data)) == data
    assert warc.unframe(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unframe(b"5\r\nabc\r\n0\r\n\r\n")


PAGES = [(5, "http://a/", "<p>x</p>"), (3, None, "<p>x</p>"), (4, "http://b/\r\nX: y", "é" * 50000), (9, "u", None), (8, "u", ""), (7, "u", "é" * 50000), (7, "u", "other"), (None, "u", "<p>x</p>"), (3, "again", "<p>x</p>"), (1, "u", "abc " * 9000)]


def pages_of(spark):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in PAGES], "page_id long, url string, html string, digest string")


def test_archive_round_trip(spark):
    manifest = warc.write_archive(pages_of(spark), segment=1000)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    rows = warc.read_archive(manifest).collect()
    assert len(rows) == len(PAGES) and all(r["problem"] is None for r in rows)
    got = sorted((r["record_id"].split(":")[2], r["warc_type"], (r["refers_to"] or "::").split(":")[2], r["payload"] is None or base(r["payload"]) == r["header_digest"]) for r in rows)
    assert got == sorted([("3", "response", "", True), ("3", "revisit", "3", True), ("5", "revisit", "3", True), ("null", "revisit", "3", True), ("4", "response", "", True), ("7", "revisit", "4", True), ("7", "response", "", True), ("8", "response", "", True), ("9", "revisit", "8", True), ("1", "response", "", True)])
    payloads = {r["record_id"].split(":")[2]: bytes(r["payload"]) for r in rows if r["warc_type"] == "response"}
    assert payloads["4"] == ("é" * 50000).encode() and payloads["1"] == b"abc " * 9000 and payloads["8"] == b""
    assert {r["stated_bytes"] for r in rows if r["warc_type"] == "revisit"} == {8, 100000, 0}
    assert warc.read_archive(warc.write_archive(pages_of(spark).limit(0))).count() == 0


def test_archive_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = warc.read_archive(warc.write_archive(pages_of(spark))).collect()
    assert sorted(r["warc_type"] for r in rows) == ["response"] * 5 + ["revisit"] * 5


def base(data):
    return warc.base32_sha1(bytes(data))


def test_base32_in_sql(spark):
    values = [b"", b"abc", bytes(range(256))]
    rows = spark.createDataFrame([(v,) for v in values], "b binary").select(warc.base32_of_sha1(F.sha1("b"))).collect()
    assert [r[0] for r in rows] == [base(v) for v in values]


def test_reassembly_reports_what_is_wrong():
    def segments(**change):
        block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.frame(b"payload " * 100)
        parts = [block[k : k + 300] for k in range(0, len(block), 300)]
        rows = [{"record_id": f"r{k}", "warc_type": "response", "target_uri": "u", "refers_to": None, "header_digest": None, "stated_bytes": None, "origin": "r", "segment": k + 1, "total": len(block) if k == len(parts) - 1 else None, "data": p} for k, p in enumerate(parts)]
        random.Random(0).shuffle(rows)
        return rows

    whole = warc.assemble(pa.Table.from_pylist(segments())).to_pylist()[0]
    assert whole["payload"] == b"payload " * 100 and whole["problem"] is None
    missing = [r for r in segments() if r["segment"] != 2]
    assert warc.assemble(pa.Table.from_pylist(missing)).to_pylist()[0]["problem"] == "segments missing or doubled"
    wrong = [r | {"total": r["total"] and r["total"] + 1} for r in segments()]
    assert warc.assemble(pa.Table.from_pylist(wrong)).to_pylist()[0]["problem"] == "total length differs"


def test_members_and_parsing():
    data = b"".join(warc.record(b"resource", f"id{k}", b"x" * k, WARC_Target_URI=b"u") for k in range(40))
    records = [warc.parse(m) for m in warc.members(io.BytesIO(data))]
    assert [len(b) for _, b in records] == list(range(40)) and records[3][0]["warc-record-id"] == "<id3>"
    found = list(warc.members(io.BytesIO(data[:-5])))
    assert len(found) == 40 and isinstance(found[-1], ValueError) and all(isinstance(m, bytes) for m in found[:-1])


@pytest.mark.parametrize("counted", [True, False])
def test_damage_is_reported_and_reading_goes_on(spark, tmp_path, counted):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    pack = gzip.compress
    fine = lambda k: warc.record(b"response", f"urn:{k}", http + warc.frame(b"p%d" % k))
    broken = bytearray(fine(9) * 3)
    broken[len(broken) // 2] ^= 0xFF
    broken[len(broken) // 2 + 1] ^= 0xFF
    files = {
        "cut": fine(1) + fine(2)[:-9],
        "chunk": warc.record(b"response", "urn:3", http + b"5\r\nabc") + fine(4),
        "length": pack(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:5>\r\nContent-Length: 99\r\n\r\nabc\r\n\r\n") + fine(6),
        "other": b"not a gzip file at all" * 10 + fine(7),
        "text": pack(b"hello") + fine(8),
        "flip": fine(10) + bytes(broken) + fine(11),
        "empty": b"",
        "number": warc.record(b"response", "urn:12", b"x", WARC_Segment_Number=b"one") + fine(13),
    }
    rows = []
    for name, data in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
        rows.append((f"file:{tmp_path}/{name}.warc.gz", 0))
    manifest = spark.createDataFrame(rows, "path string, segments long")
    got = warc.read_archive(manifest if counted else manifest.drop("segments")).collect()
    payloads = {r["record_id"]: r["payload"] and bytes(r["payload"]) for r in got if r["record_id"]}
    for k in (1, 4, 6, 7, 8, 10, 11, 13):
        assert payloads[f"urn:{k}"] == b"p%d" % k
    assert payloads["urn:3"] is None and next(r["problem"] for r in got if r["record_id"] == "urn:3") == "broken chunk"
    said = [r["problem"] for r in got if r["record_id"] is None]
    assert all(r is not None for r in said)
    for name in ("cut", "length", "other", "text", "flip", "number"):
        assert any(f"/{name}.warc.gz: " in x for x in said), name
    assert not any("/empty.warc.gz" in x or "/chunk.warc.gz" in x for x in said)
