"""SimHash, components and suffix arrays against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from quire.llm import simhash, suffix
from quire.llm.components import connected_components


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(items):
    """The root of each item of a list, over links that ``near`` says."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i] ^ items[j]).count("1") <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(items))]


def test_fingerprint(texts):
    assert [simhash.fingerprint(t or "") for t in texts] == [slow_fingerprint(t) for t in texts]


def test_components_of_documents(docs, nothing):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    least = {}
    for (i, _), k in zip(rows, linked([f for _, f in rows]), strict=True):
        least[k] = min(x for x in (i, least.get(k)) if x is not None) if i is not None or least.get(k) is not None else None
    want = collections.Counter((i, f, least[k]) for (i, f), k in zip(rows, linked([f for _, f in rows]), strict=True))
    got = collections.Counter((r.doc_id, int(r.hex, 16), r.component_id) for r in simhash.components(docs).withColumn("hex", simhash.hex_digits()).collect())
    assert got == want
    assert simhash.components(nothing).count() == 0


def test_survivors_of_null_and_equal_ids(spark, docs, nothing):
    import corpus_pipeline

    rnd = random.Random(21)
    text = lambda: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40))
    base = [text() for _ in range(12)]
    rows = [(k, base[k]) for k in range(3)]
    rows += [(None, t) for t in (*base[3:8], base[0], base[3], None)]  # five of their own, a copy of a numbered one, a copy among them, null
    rows += [(7, base[8]), (7, base[9]), (7, base[9]), (7, base[1])]  # one id with two texts of its own, one twice, and a copy
    rows += [(None, base[10]), (50, base[10]), (40, base[10].upper())]
    for source in (spark.createDataFrame(rows, "doc_id long, text string").repartition(4), docs.select("doc_id", "text")):
        all_ = [(r.doc_id, r.text) for r in source.collect()]
        best = {}
        for row, k in zip(all_, linked([slow_fingerprint(t) for _, t in all_]), strict=True):
            best.setdefault(k, []).append(row)
        got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, source, "").collect()]
        assert len(got) == len(best)
        for group in best.values():
            least = min((i for i, _ in group if i is not None), default=None)
            assert len([g for g in got if g in {(i, t) for i, t in group if i == least}]) == 1
    assert simhash.survivors(nothing).count() == 0


@pytest.mark.parametrize("split", [16384, 7])
def test_links_lose_none(spark, split):
    rnd = random.Random(4)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    values = {c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) & ((1 << 64) - 1) for c in centres for _ in range(8)} | {0, (1 << 64) - 1}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    found = connected_components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), split=split)).collect()
    mine = {r.node: r.root for r in found}
    order = [v & (1 << 64) - 1 for v in signed]
    roots = linked(order)
    groups = collections.defaultdict(set)
    for v, k in zip(signed, roots, strict=True):
        groups[k].add(v)
    for g in groups.values():
        assert {mine.get(v, v) for v in g} == {min(g)}


def test_replicas_cover_all_near_pairs():
    rnd = random.Random(2)
    for _ in range(200):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), 4):
            y ^= 1 << b
        keys, whose, home = simhash.replicas(np.array([x, y], np.uint64), 4, 3)
        mine = set(keys[(whose == 0) & home].tolist())
        assert mine & set(keys[whose == 1].tolist())


def slow_removals(rows, length):
    counts = collections.Counter()
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        counts.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone, end = bytearray(len(b)), 0
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[max(k, end) : k + length] = b"\x01" * (k + length - max(k, end))
                end = k + length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("limits", [{}, {"split": 2, "shard_bytes": 3000}])
def test_removals(docs, nothing, limits):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix.removals(docs, **limits).collect())
    assert got == slow_removals(rows, 200)
    assert suffix.removals(nothing, **limits).count() == 0


def test_periodic_and_shared_passages(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcde ") for _ in range(n))
    passage = word(320)
    rows = [(i, word(rnd.randint(0, 400)) + passage[rnd.randint(0, 90) :] + word(rnd.randint(0, 300))) for i in range(40)] + [(90, "ab" * 700), (91, "z" * 900), (92, word(150))]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix.removals(spark.createDataFrame(rows, "doc_id long, text string"), split=4, shard_bytes=4000).collect())
    assert got == slow_removals(rows, 200)


def test_suffix_array_and_prefixes():
    rnd = random.Random(3)
    snippets = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(12, 30))) for _ in range(40)]
    data = np.frombuffer(b"".join(snippets), np.uint8)
    order, _ = suffix.suffix_array(data, 16)
    text = data.tobytes()
    keys = [text[i : i + 16].ljust(16, b"\0") for i in order]
    assert keys == sorted(keys)
    twice, at, shared, _ = suffix.repeated_windows(snippets, 10)
    for k in range(1, len(at)):
        x, y = text[at[k - 1] : at[k - 1] + 10], text[at[k] : at[k] + 10]
        assert shared[k] == next((i for i in range(10) if x[i] != y[i]), 10)


def test_cut_texts_keeps_whole_characters(spark):
    shared = "ü" * 150
    rows = spark.createDataFrame([(1, "aé" + shared + "é1", 9), (2, "bé" + shared, 9), (3, "clean", 5), (4, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix.cut_texts(rows).collect()}
    assert got[3] == ("clean", 5) and got[4][0] is None
    assert len(got[1][0]) <= 4 and "�" not in got[1][0] and got[1][1] == len(got[1][0])


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(50)] + [(7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 1000 for i in (1000, *range(2000, 2050))}}
