"""Merkle proofs, whitening and language identification against plain versions and held-out labels."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import langid, merkle, whitening
from quire.llm import queries as llm


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row, **other):
    values = {c: row[c] for c in merkle.FIELDS} | other
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values.values()))


def slow_tree(nodes):
    """The root, and for each node the nodes beside its way up, with their sides."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            path.append((nodes[i ^ 1], "l" if i & 1 else "r") if i ^ 1 < len(nodes) else ("", "-"))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], paths


def slow_proofs(rows, changed):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, slow_leaf(r), slow_leaf(r, n_chars=r["n_chars"] + 1) if changed(r) and r["n_chars"] is not None else None))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: slow_tree([x[2] for x in sorted(groups[k])]) for k in order}
    root, above = slow_tree([trees[k][0] for k in order])
    for k, more in zip(order, above, strict=True):
        for (has, i, leaf, said), path in zip(sorted(groups[k], key=lambda x: x[:3]), trees[k][1], strict=True):
            now = said or leaf
            for beside, side in path + more:
                now = h(beside, now) if side == "l" else h(now, beside)
            yield (i if has else None, leaf, trees[k][0], root, "".join(b for b, _ in path + more), "".join(s for _, s in path + more), now)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_proofs(docs, nothing, spark, bits):
    rnd = random.Random(4)
    rows = [r.asDict() for r in docs.select(*merkle.FIELDS).collect()]
    sizes = {"b": 1, "a": 2, "é": 8, "Z": 17, None: 5, "": 3, "zz": 37}
    rows += [dict(doc_id=rnd.choice([None, rnd.randint(-9, 40)]), source=None, lang=k, n_chars=rnd.choice([None, i]), text=rnd.choice(["x", "y"])) for k, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame([(*(r[c] for c in merkle.FIELDS), "t", "p") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, payload string").repartition(5)
    odd = F.col("doc_id") % 3 == 1
    got = merkle.proofs(table, {"n_chars": F.when(odd, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, bits=bits)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(slow_proofs(rows, lambda r: r["doc_id"] is not None and math.fmod(r["doc_id"], 3) == 1))
    assert merkle.proofs(nothing).count() == 0
    for r in merkle.proofs(table.limit(9)).collect():
        assert merkle.folded(r.leaf, r.path, r.sides) == r.root == r.folded_root


def test_merkle_query_by_sql(spark):
    got = llm.FOUND["op11_merkle"](spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id").values.tolist()
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    assert got == con.sql(llm.SQL["op11_merkle"]).df().sort_values("doc_id").values.tolist()
    assert {r[-1] for r in got if zlib.crc32(str(r[0]).encode()) % 7} == {True}
    assert {r[-1] for r in got if zlib.crc32(str(r[0]).encode()) % 7 == 0} == {False}


VECTORS = "vec_id long, embedding array<float>, label int, id string, v string"


def slow_whitening(vectors, k):
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), c @ v / np.sqrt(e), e / np.square(c).sum() * n


def compared(got, ids, vectors, k):
    n, deviation, w, share = slow_whitening(vectors, k)
    rows = sorted(got.collect(), key=lambda r: (r.id, r.component))
    assert [(r.id, r.component) for r in rows] == [(i, j + 1) for i in sorted(ids) for j in range(k)]
    order = np.argsort(ids)
    assert {r.n for r in rows} == {n}
    assert [r.deviation for r in rows] == np.repeat(deviation[order], k).tolist()
    mine = np.array([r.whitened for r in rows]).reshape(-1, k)
    signs = np.sign((mine * w[order]).sum(0))
    assert np.abs(mine - signs * w[order]).max() < 1e-7
    assert np.abs(np.array([r.explained for r in rows[:k]]) / share - 1).max() < 1e-9
    assert {r.identity_error < 1e-9 for r in rows} == {True}


@pytest.mark.parametrize("size", [1, 3, 24, 100])
def test_whitening(spark, size):
    rng = np.random.default_rng(size)
    vectors = (rng.normal(size=(400, size)) * rng.uniform(0.01, 1, size) + rng.normal(size=size)).astype(np.float32)
    vectors[300:] = vectors[0]  # a common vector
    bad = [None, [], [float("nan")] * size, [float("inf")] * size, [1e30] * size, [None] * size, [0.1] * (size + 1)]
    rows = [(i, v.tolist(), 0, "x", "y") for i, v in enumerate(vectors)] + [(1000 + i, v, None, None, None) for i, v in enumerate(bad)]
    table = spark.createDataFrame(rows, VECTORS).repartition(6)
    k = min(8, size)
    compared(whitening.whitened(table, whitening.fit(table)), list(range(400)), vectors, k)


def test_whitening_of_few_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whitened(none, whitening.fit(none)).count() == 0
    bad = spark.createDataFrame([(1, None, 1, "", ""), (2, [None, 1.0], 1, "", "")], VECTORS)
    assert whitening.whitened(bad, whitening.fit(bad)).count() == 0
    one = spark.createDataFrame([(None, [1.5, 2.0], 1, "", "")], VECTORS)
    assert [tuple(r) for r in whitening.whitened(one, whitening.fit(one)).collect()] == [(None, k, 1, 0, None, 0.0, None) for k in (1, 2)]
    flat = spark.createDataFrame([(7, [0.0, 5.0], 1, "", ""), (7, [1.0, 5.0], 1, "", "")], VECTORS)
    got = sorted((r.component, r.whitened and round(r.whitened, 12), r.deviation, r.explained, round(r.identity_error, 12)) for r in whitening.whitened(flat, whitening.fit(flat)).collect())
    assert sorted(got, key=str) == sorted([(1, -1.0, 1024**2, 1.0, 0.0), (1, 1.0, 1024**2, 1.0, 0.0), (2, None, 1024**2, 0.0, 0.0), (2, None, 1024**2, 0.0, 0.0)], key=str)


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(8)
    vectors = np.round(rng.normal(size=(50, 4)) * 2.0**40, 3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    model = whitening.fit(table)
    x = [[math.floor(c * 1024) + 100_000 for c in v] for v in vectors.tolist()]
    assert list(model.sums) == [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((50 * c - s) ** 2 for c, s in zip(v, model.sums, strict=True)) for i, v in enumerate(x)}
    assert {r.id: r.deviation for r in whitening.whitened(table, model).collect()} == {i: d if d < 1 << 63 else None for i, d in want.items()}


def test_eigenpairs_are_certified():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    for spectrum in (np.linspace(1, 2, 300), np.r_[np.ones(20) * 3, np.ones(280)], np.r_[1e8, 1e4, np.ones(298)]):
        a = q * spectrum @ q.T
        a = (a + a.T) / 2
        e, v = whitening.lobpcg(lambda b: a @ b, 300, 8)
        assert np.abs(e - np.sort(spectrum)[::-1][:8]).max() <= 1e-12 * spectrum.max()
        assert np.linalg.norm(a @ v - v * e, axis=0).max() <= 1e-12 * spectrum.max()
        assert np.abs(v.T @ v - np.eye(8)).max() < 1e-12


def slow_slots(text, slots):
    """Each n-gram's slot, hashed on its own."""
    text = langid.letters(text)
    for n in range(1, langid.ORDERS + 1):
        for i in range(len(text) - n + 1):
            x = 0
            for m, c in enumerate(text[i : i + n], 1):
                x = (x + ord(c) + m) * 0x9E3779B1 & 0xFFFFFFFF
                x ^= x >> 15
            yield ((x * 0x85EBCA6B & 0xFFFFFFFF) >> 16) & (slots - 1)


def test_naive_bayes_by_brute_force(spark, texts, nothing):
    rnd = random.Random(2)
    letters = {"aa": "abcdef ", "bb": "efghij ", "cc": "uvwxyz. "}
    rows = [(i, "".join(rnd.choice(letters[k]) for _ in range(60)), k) for i, k in enumerate(rnd.choices(list(letters), k=60))]
    rows += [(100 + i, t, None) for i, t in enumerate(texts)] + [(None, "abc abc", "aa"), (None, None, None), (200, "½ ² 7", "aa"), (201, "e f", None), rows[0]]
    table = spark.createDataFrame([(i, t, k, "x", 0.5) for i, t, k in rows], "doc_id long, text string, lang string, names string, score double").repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    known = [(t, k) for i, t, k in rows if k and t and re.search(r"[a-z]", t.lower()) and not held(i)]
    slots, names = langid.SLOTS, sorted(letters)
    count = {k: collections.Counter(s for t, lang in known if lang == k for s in slow_slots(t, slots)) for k in names}
    n = {k: sum(lang == k for _, lang in known) for k in names}

    def slow(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        each = collections.Counter(slow_slots(text, slots))
        logs = [math.log((n[k] + 0.5) / (len(known) + 1.5)) + sum(m * math.log((count[k][s] + 0.5) / (sum(count[k].values()) + 0.5 * slots)) for s, m in each.items()) for k in names]
        best = max(range(3), key=lambda j: logs[j])
        return names[best], 1 / sum(math.exp(x - logs[best]) for x in logs)

    got = sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in langid.predictions(table, langid.train(table)).collect()), key=str)
    assert got == sorted(((i, held(i), slow(t)[0], round(slow(t)[1], 6)) for i, t, _ in rows), key=str)
    empty = langid.train(nothing)
    assert langid.predictions(nothing, empty).count() == 0
    assert {(r.lang_pred, r.score) for r in langid.predictions(table, empty).collect()} == {("und", 0.0)}


def test_pieces_of_long_texts(monkeypatch):
    rng = np.random.default_rng(3)
    model = langid.Model(("x", "y"), np.zeros(2), rng.normal(size=(2, 1 << 10)))
    texts = [langid.letters("".join(rng.choice(list("abcdefgh "), n))) for n in (1, 2, 29, 30, 31, 32, 33, 60, 61, 62, 90, 500)] + [""]
    whole = model.scores(texts)
    for size in (8, 30, 31):
        monkeypatch.setattr(langid, "PIECE", size)
        assert np.allclose(model.scores(texts), whole)


def test_languages_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = langid.predictions(docs, langid.train(docs, per_language=300))
    right = found.where("held_out").join(docs, "doc_id").where(F.col("text").rlike(r"\p{L}")).agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right[0] > 0.99 and right[1] > 2000
