"""Token ids, counts, files and packing against the tokenizers library and exact round trips."""

import collections
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from quire.llm import counts, idfiles, packing
from quire.llm.tokens import Encoder, encoder

ODD = ["it's don't We'LL  x\n\ny  \n z 12345 ²³ ﬁ İstanbul ΣΑΣ <|endoftext|> __a_b__ ,'s ''s", "\x1fa\x85b", " a", "a ", "\n", "...\n...", "naïve Ünïted_x", "a!, b!. c,, d.. e.\n", "x.y,z"]


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|endoftext|>", "A <|ENDOFTEXT|> <|endoftext| > <|", "x" * 50 + "<|endoftext|><|endoftext|>\n\n y"]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(spark, texts, name):
    known, mine = library(name), encoder(name)
    more = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in [*(t or "" for t in texts), *ODD, *SPECIAL, *more]:
        assert np.frombuffer(mine.encode(t), mine.dtype).tolist() == known.encode(t, add_special_tokens=False).ids, t[:80]


def test_a_full_cache_is_emptied():
    mine = Encoder(public_tokenizers.path("byte_bpe_50k.json"), keep=3)
    first = [mine.encode(t) for t in ("one two three", "four five six", "one two three")]
    assert first[0] == first[2]


def by_library(pieces, has_bytes):
    t = Tokenizer(models.Unigram(pieces, 0, has_bytes))
    t.normalizer = normalizers.Sequence([normalizers.Replace(Regex(r"[\x09-\x0D\x20]+"), " "), normalizers.Replace(Regex(r"^ | $"), "")])
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.mark.parametrize("has_bytes", [True, False])
def test_counts_are_the_librarys(texts, has_bytes):
    pieces = [p for p in counts.vocabulary("piece_bpe_32k.model") if has_bytes or not counts.BYTE.fullmatch(p[0])]
    known, mine = by_library(pieces, has_bytes), counts.Counter(pieces)
    for t in [*(t or "" for t in texts), *ODD, "a▁b ▁▁c <s> <0x41>"]:
        assert mine.count(t)[1] == len(known.encode(t, add_special_tokens=False).ids), t[:80]


def test_ties_go_as_in_the_library():
    rnd = random.Random(6)
    for _ in range(15):
        pieces = [("<unk>", 0.0)] + [(p, float(-rnd.randint(0, 4))) for p in sorted({"".join(rnd.choice("abc▁") for _ in range(rnd.randint(1, 4))) for _ in range(25)})]
        known, mine = by_library(pieces, False), counts.Counter(pieces)
        for _ in range(20):
            t = " ".join("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) for _ in range(4))
            assert mine.count(t)[1] == len(known.encode(t, add_special_tokens=False).ids)


def test_token_counts_of_rows(docs, nothing):
    found = counts.token_counts(docs).collect()
    assert len(found) == docs.count() and counts.token_counts(nothing).count() == 0
    assert all(r.n_tokens == 0 for r in found if r.n_words == 0)


def test_elias_fano():
    rnd = random.Random(5)
    for values in ([], [0], [0, 0, 0], [5], sorted(rnd.randint(0, 10**7) for _ in range(3000)), sorted(rnd.randint(0, 90) for _ in range(3000)), [3, 10**12]):
        back = idfiles.EliasFano.read(io.BytesIO(idfiles.EliasFano.encode(np.array(values, np.int64)).tobytes()))
        assert back.decode().tolist() == values
        assert [back.select(k) for k in range(len(values))] == values
    dense = idfiles.EliasFano.encode(np.arange(0, 10**6, 100))
    assert len(dense.tobytes()) < 2 * 10**4 * 8 / 4


def test_a_file_reads_back():
    data = idfiles.file_bytes([None, -5, 7, 7], [2, 2, 5, 6], np.arange(6, dtype="<u2").tobytes(), 2)
    f = idfiles.IdFile(io.BytesIO(data))
    assert f.doc_ids == [None, -5, 7, 7] and [f.document(k).tolist() for k in range(4)] == [[0, 1], [], [2, 3, 4], [5]]


@pytest.mark.parametrize("file_tokens", [1 << 22, 300])
def test_id_files(docs, nothing, file_tokens):
    known = library("word_bpe_49k.json")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode("utf-8", "surrogatepass")))
    want, at = [], 0
    for i, t in rows:
        ids = [*known.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, at, np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in idfiles.read(idfiles.write(docs, "word_bpe_49k.json", 1, file_tokens=file_tokens)).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert idfiles.read(idfiles.write(nothing, "word_bpe_49k.json", 1)).count() == 0


def whole(pieces):
    """Checks that pieces make up documents and sequences; gives the documents' ids by (id, length)."""
    sequences = collections.defaultdict(list)
    for p in pieces:
        assert len(bytes(p.ids)) == 4 * p.length > 0
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0, *(p.length for p in s[:-1])]).tolist()
        n = sum(p.length for p in s)
        assert n <= 1024 and n & (n - 1) == 0
    return sequences


@pytest.mark.parametrize("limits", [{}, {"shard_docs": 3}, {"shard_tokens": 60}, {"shard_tokens": 500}])
def test_packing(docs, nothing, limits):
    known = library("byte_bpe_50k.json")
    pieces = packing.pack(docs, **limits).collect()
    whole(pieces)
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*known.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.update((r.doc_id, k, v) for k, v in enumerate(ids))
    got = collections.Counter((p.doc_id, p.start + k, v) for p in pieces for k, v in enumerate(np.frombuffer(bytes(p.ids), "<u4").tolist()))
    assert got == want
    assert packing.pack(nothing, **limits).count() == 0


def test_neighbours_come_first(spark):
    """Documents about one thing fill a window before others do."""
    rnd = random.Random(1)
    topics = [[f"{a}{rnd.choice('bcdfgh')}{k}word" for k in range(30)] for a in ("red", "blue")]
    rows = [(i, " ".join(rnd.choice(topics[i % 2]) for _ in range(40))) for i in range(40)]
    sequences = whole(packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    pure = [len({p.doc_id % 2 for p in s}) == 1 for s in sequences.values() if sum(p.length for p in s) == 1024]
    assert sum(pure) >= len(pure) * 0.6


def test_bm25_scores():
    docs = [np.array(x) for x in ([1, 2, 3, 3], [3, 4], [5, 6, 1], [7])]
    df = np.bincount([1, 2, 3, 3, 4, 5, 6, 1, 7], minlength=8)
    idf = np.log1p((4 - df + 0.5) / (df + 0.5)).astype(np.float32)
    index = packing.Index(docs, idf, 2.5)
    for q in range(4):
        scores = index.query(docs[q])
        for d in range(4):
            want = sum(idf[t] * (tf := (docs[d] == t).sum()) * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / 2.5)) for t in set(docs[q]) & set(docs[d]))
            assert abs(scores[d] - want) < 1e-5 and abs(index.query(docs[q], q)[d] - want) < 1e-5


def test_windows_are_filled_greedily():
    """Against a plain loop: the unused document of the seed's best score comes next, in the next shard as well."""
    rng = np.random.default_rng(2)
    docs = {k: rng.integers(0, 30, int(rng.integers(1, 40))) for k in range(60)}
    df = np.bincount(np.concatenate([np.unique(d) for d in docs.values()]), minlength=30)
    idf = np.log1p((60 - df + 0.5) / (df + 0.5)).astype(np.float32)

    def score(q, d):
        return sum(float(idf[t]) * (tf := int((docs[d] == t).sum())) * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / 20)) for t in set(docs[q].tolist()) & set(docs[d].tolist()))

    packer, got = packing.Packer(64, 0), []
    want, fill, seed, sequence = [], 0, None, 0
    for shard in (range(0, 35), range(35, 60)):
        own = {k: docs[k] for k in shard}
        got += packer.shard(own, packing.Index(list(own.values()), idf, 20), docs)
        left = list(shard)
        while left:
            best = max(left, key=lambda k: (round(score(seed, k), 4), -k)) if fill else left[0]
            left.remove(best)
            start = 0
            while start < len(docs[best]):
                seed = seed if fill else best
                take = min(len(docs[best]) - start, 64 - fill)
                want.append((best, start, take, sequence, fill))
                start, fill = start + take, fill + take
                if fill == 64:
                    fill, sequence = 0, sequence + 1
    got += packer.open
    assert got == want


def test_best_neighbours_of_a_shard_are_found(spark):
    """Recall of the ten best within a shard, against scores of every pair: the search leaves nothing out."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    enc = encoder("byte_bpe_50k.json")
    docs = [np.frombuffer(enc.encode(t), enc.dtype) for t in texts if t]
    count = np.zeros((len(docs), 50257), np.float32)
    for k, d in enumerate(docs):
        np.add.at(count[k], d, 1)
    df = (count > 0).sum(0)
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
    sizes = count.sum(1)
    mean = float(sizes.mean())
    weight = idf * count * (packing.K1 + 1) / (count + packing.K1 * (1 - packing.B + packing.B * sizes[:, None] / mean))
    every = (count > 0).astype(np.float32) @ weight.T
    index, found = packing.Index(docs, idf, mean), []
    for q in range(len(docs)):
        a, b = (np.argsort(-np.round(np.r_[x[:q], x[q + 1 :]], 2), kind="stable")[:10] for x in (every[q], index.query(docs[q], q)))
        found.append(len(set(a.tolist()) & set(b.tolist())) / 10)
    assert np.mean(found) >= 0.99
