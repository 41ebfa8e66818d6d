"""Line quality, decontamination, urls, pages, toxicity and the pipeline."""

import collections
import html
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import crf, decontaminate, mainhtml, queries, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    ws = WORD.findall(text)
    seen = collections.Counter(zip(ws, ws[1:], ws[2:], strict=False))
    again = {k for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_base_counts(spark, texts):
    more = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in [*(t or "" for t in texts), *more, "a b c a b c", "a a a", "a\x0bb\x0cc\rd\te"]:
        a = crf.analyse(t)
        assert (a.n_words, a.word_chars, a.n_symbols, a.n_dup_lines, a.n_repeat_words) == slow_base(t)


def test_viterbi_and_gradient():
    rng = np.random.default_rng(1)
    field = crf.Field(rng.normal(size=crf.N_FEATURES), rng.normal(size=(2, 2)))
    features = rng.integers(0, 2, (6, crf.N_FEATURES)).astype(np.float32)
    e = field.emissions(features)
    score = lambda z: sum(e[t, z[t]] for t in range(6)) + sum(field.pair[z[t], z[t + 1]] for t in range(5))
    every = [[k >> t & 1 for t in range(6)] for k in range(64)]
    assert field.viterbi(features).tolist() == max(every, key=score)
    p = np.exp([score(z) for z in every])
    p /= p.sum()
    labels = np.array([1, 0, 1, 1, 0, 1])
    w, pair = crf._gradient(field, features, labels, np.array([0]), np.ones(6))
    expected = sum(q * (2 * np.array(z) - 1)[:, None] * features for q, z in zip(p, every, strict=True)).sum(0)
    assert np.allclose(w, ((2 * labels - 1)[:, None] * features).sum(0) - expected, atol=1e-4)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1], labels[1:]), 1)
    for q, z in zip(p, every, strict=True):
        np.add.at(seen, (np.array(z[:-1]), np.array(z[1:])), -q)
    assert np.allclose(pair, seen, atol=1e-4)
    # Sequences in a row, each with its weight, give the sum of their gradients.
    sizes = [6, 1, 9, 2]
    rows = rng.integers(0, 2, (sum(sizes), crf.N_FEATURES)).astype(np.float32)
    marks = rng.integers(0, 2, sum(sizes))
    cuts = np.cumsum([0, *sizes])
    alone = [crf._gradient(field, rows[a:z], marks[a:z], np.array([0]), np.full(z - a, 1 / (z - a))) for a, z in zip(cuts, cuts[1:], strict=False)]
    together = crf._gradient(field, rows, marks, cuts[:-1], np.repeat(1 / np.array(sizes), sizes))
    for k in range(2):
        assert np.allclose(together[k], sum(x[k] for x in alone), atol=1e-6)


def test_factorization_machine_score():
    rng = np.random.default_rng(3)
    model = toxicity.Model(6, 0.3, rng.normal(size=64).astype(np.float32), rng.normal(0, 0.3, (64, 4)).astype(np.float32))
    for n in (0, 1, 5, 20):
        slots = np.sort(rng.choice(64, n, replace=False))
        z = 0.3 + sum(model.weight[i] for i in slots) + sum(model.factors[i] @ model.factors[j] for i in slots for j in slots if i < j)
        assert np.isclose(model.score(slots), 1 / (1 + np.exp(-z)), atol=1e-5)
    again = toxicity.Model.frombytes(model.tobytes())
    assert again.bits == 6 and again.bias == 0.3 and (again.weight == model.weight).all() and (again.factors == model.factors).all()


def test_factorization_machine_learns_a_pair():
    """Label 1 needs both of two terms: neither tells anything alone beyond what the pair brings."""
    rng = np.random.default_rng(4)
    docs, y = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        docs.append(np.unique(np.r_[rng.choice(np.arange(10, 60), 8), [1] * a, [2] * b]).astype("<u4"))
        y.append(float(a == b))
    model = toxicity.fit(docs, np.array(y, np.float32), 6, 4, 60, 0.5, 1e-4, 1e-4, 7)
    right = [(model.score(d) > 0.5) == bool(t) for d, t in zip(docs, y, strict=True)]
    assert np.mean(right) > 0.95
    assert model.factors[1] @ model.factors[2] > 0


def test_line_quality_of_rows(docs, nothing, labels):
    field = crf.train(docs, labels)
    found = crf.judged(docs, field).collect()
    assert len(found) == docs.count() and not any(r.kept for r in found if r.base_failed)
    assert crf.judged(nothing, crf.train(nothing, labels)).count() == 0


def test_line_quality_on_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    field = crf.train(docs, labels.where("doc_id % 3 <> 0"))
    r = crf.judged(docs, field).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").toPandas()
    assert (r.kept == (r.quality == 1)).mean() > 0.97


def slow_matches(docs, items, window=13, share=0.8):
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, t in docs:
        d = tok(t)
        for k, text in items:
            m = tok(text)
            w = min(window, len(m))
            if not m:
                continue
            for shift in range(-len(m), len(d)):
                eq = [0 <= shift + j < len(d) and d[shift + j] == m[j] for j in range(len(m))]
                inside = [0 <= shift + j < len(d) for j in range(len(m))]
                for s in range(len(m) - w + 1):
                    if all(inside[s : s + w]) and sum(eq[s : s + w]) >= share * w - 1e-9:
                        out.add((i, k))
    return out


@pytest.mark.parametrize("broadcast_tokens", [4_000_000, 0])
def test_decontamination(spark, docs, nothing, broadcast_tokens):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(rnd.randint(15, 40)))) for k in range(6)] + [(8, "too short"), (9, None), (0, None), (10, "abcd efgh abcd abce"), (11, "single")]
    rows = []
    for n in range(40):
        body = [word() for _ in range(rnd.randint(0, 60))]
        part = items[n % 6][1].split()
        if n % 3 == 0:
            for at in rnd.sample(range(len(part)), len(part) // 10):
                part[at] = word()
        if n % 4 == 0:
            part = part[: len(part) // 2]
        if n % 5:
            body[len(body) // 2 : len(body) // 2] = [x.upper() + "," for x in part]
        rows.append((n, " ".join(body)))
    rows += [(90, None), (91, ""), (None, items[1][1]), (92, "it is too short"), (93, "too late"), (94, "abcd efgh abcd abce efgh"), (95, "efgh abcd abce"), (96, "single two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench, broadcast_tokens=broadcast_tokens).collect()}
    want = slow_matches(rows, items)
    assert got == want
    exact = {(i, k) for i, t in rows for k, m in items if m and len(m) > 20 and m in (t or "").lower().replace(",", "")}
    assert exact <= got
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert decontaminate.matches(nothing, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_every_accepted_substitution_is_found(spark):
    """All ways to substitute tokens that the comparison accepts, for items of 1 to 14 tokens and windows at either end of 14."""
    items, rows = [], []
    for m in range(1, 15):
        item = [f"w{m}x{j}" for j in range(m)]
        items.append((m, " ".join(item)))
        width = min(13, m)
        for n in range(width - -(-width * 4 // 5) + 1):
            for at in itertools.combinations(range(width), n):
                for shift in {0, m - width}:
                    text = [w if j - shift not in at else "other" for j, w in enumerate(item)]
                    rows.append((len(rows), m, " ".join(["before", *text, "after"])))
    docs = spark.createDataFrame(rows, "doc_id long, m int, text string")
    for limit in (4_000_000, 0):
        found = decontaminate.matches(docs.select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string"), broadcast_tokens=limit)
        assert {(r.doc_id, r.item_id) for r in found.collect()} >= {(i, m) for i, m, _ in rows}


def test_long_text_with_many_hits(spark):
    item = " ".join(f"tok{k}" for k in range(20))
    rows = spark.createDataFrame([(1, (item + " ") * 2000)], "doc_id long, text string")
    got = decontaminate.matches(rows, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_equal, r.token_start) for r in got] == [(1, 5, 20, 0)]


def test_decontamination_plan_has_no_python(docs, spark):
    plan = decontaminate.matches(docs, spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/7/x?y#z", "https://b.example.com/en/1", "ftp://x.net/de/9", "http://example.net/de/88", "http://notexample.net/de/88", "http://casino-win.example.net", "http://m.ads-track.example.com/fr/1", "http://org/es/", "http://a.org#/es/", "x://y://z.com/en/", "http://com/en/"]


def test_urls(spark, nothing):
    rows = spark.createDataFrame([*enumerate(URLS), (None, URLS[5]), (5, URLS[5])], "page_id long, url string")
    lists = [spark.createDataFrame([*x.items(), (None, "block"), ("", "block")], "key string, verdict string") for x in (queries.URL_RULES, queries.BLOCKED_URLS)]
    found = urls.judged(rows, lists).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        if r.page_id is None:
            continue
        u = URLS[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [k for k in queries.URL_RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path) == (host, path)
        if rule:
            assert (r.rule, r.verdict, r.list) == (rule, queries.URL_RULES[rule], 0)
        else:
            blocked = any(host == k or host.endswith("." + k) for k in queries.BLOCKED_URLS)
            assert r.verdict == ("block" if blocked else None)
    none = lists[0].limit(0)
    assert urls.judged(rows.limit(0), [none]).count() == 0 and urls.judged(rows, [none]).where("verdict is not null").count() == 0
    with pytest.raises(ValueError, match="different verdicts"):
        urls.store(lists[0].union(spark.createDataFrame([("com/en/", "allow")], "key string, verdict string")))


def test_a_list_of_many_files(spark):
    """Keys in many files say what a dictionary says."""
    keys = {f"h{k % 700}.example{k % 3}.org/{'p' * (k % 5)}": ("block", "allow")[k % 2] for k in range(3000)}
    listed = spark.createDataFrame([*keys.items()], "key string, verdict string")
    stored = urls.store(listed, file_keys=200)
    names = urls.ship(spark, stored)
    assert len(names) > 5 and stored.keys == len(keys)
    from pyspark import SparkFiles

    files = [urls.UrlList(SparkFiles.get(n)) for n in names]
    assert sum(f.n for f in files) == len(keys) and all(np.all(np.diff(f.digests.astype(object)) >= 0) for f in files)
    hosts = [f"{'www.' * (k % 2)}h{k}.example{k % 4}.org" for k in range(900)]
    paths = ["/" + "p" * (k % 7) for k in range(900)]
    for host, path, key, said in zip(hosts, paths, *urls.judge(files, hosts, paths), strict=True):
        fits = [k for k in (host.removeprefix("www.") + path[:n] for n in range(1, len(path) + 1)) if k in keys]
        assert (key, said) == ((max(fits, key=len), keys[max(fits, key=len)]) if fits else (None, None))
    # Dealt to the files, without giving them to all executors, the answers are the same.
    pages = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p) in enumerate(zip(hosts, paths, strict=True))] + [(None, None), (1, "http://h1.example1.org/"), (2, "no url")], "page_id long, url string")
    lists = [listed.where("key like '%ppp'"), listed, listed.limit(0)]
    shipped, dealt = (sorted(map(str, urls.judged(pages, lists, ship_keys=n, file_keys=200).collect())) for n in (10**6, 100))
    assert shipped == dealt and len(dealt) == 903


def test_equal_digests_decide_nothing(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "digest", lambda k: len(k))
    rows = [(5, b"aa.b/", b"block"), (5, b"cc.d/", b"allow"), (5, b"e.f/x", b"block")]
    (tmp_path / "l").write_bytes(urls.list_bytes(rows, [1, 2], 4))
    got = urls.judge([urls.UrlList(str(tmp_path / "l"))], ["x.cc.d", "xx.y", "e.f", ""], ["/q", "/", "/xyz", "/"])
    assert got == (["cc.d/", None, "e.f/x", None], ["allow", None, "block", None])


PAGE = """<html><head><title>T</title></head><body><div id="wrapper" class="page has-sidebar"><header class="site-header"><h2>Site</h2></header><div class="cookie-notice">We use cookies</div>
<nav>menu</nav><div class="content"><h1>Head &amp; line</h1><p>One<br>two <b>th</b>ree &nbsp; x</p><div class="ad">buy</div><form>f<input></form><script>var a="<p>no</p>"</script><p>Four five six seven.</p></div>
<div class="comments"><p>A long comment, very long, which is much longer than the article itself is, in fact.</p></div><aside>s</aside></div><footer>f</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "http://a.b/1", PAGE), (2, "http://a.b/2", PAGE.replace("One", "Uno")), (3, None, "<p>bare"), (4, "http://a.b/3", None), (5, "http://a.b/4", ""), (None, "http://a.b/5", "no markup &lt; here"), (1, "http://a.b/1", PAGE), (7, "http://c.d", "<div><p>" + "word " * 90000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, path string")
    got = collections.defaultdict(list)
    for r in mainhtml.extracted(df).collect():
        got[r.page_id].append(r.text)
    assert got[1] == ["Head & line One two three x Four five six seven."] * 2
    assert got[2] == ["Head & line Uno two three x Four five six seven."]
    assert got[3] == ["bare"] and got[4] == [""] and got[5] == [""] and got[None] == ["no markup < here"]
    assert len(got[7][0]) == 90000 * 5 - 1
    assert mainhtml.extracted(df.limit(0)).count() == 0


def test_a_host_agrees_on_a_path(spark):
    """A page whose sidebar outweighs its article is read by its host's path."""
    page = lambda n, m: f'<body><div class="story"><p>{"art " * n}</p></div><div class="extra9"><p>{"side " * m}</p></div></body>'
    rows = [(k, "http://h/x", page(60, 5)) for k in range(5)] + [(9, "http://h/y", page(8, 90))]
    got = {r.page_id: r for r in mainhtml.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9].text == " ".join(["art"] * 8) and got[9].path == ">body>div.story"


def test_factorization_machine_learns_pairs(spark):
    """Two words that are toxic together only."""
    rnd = random.Random(3)
    rows, known = [], []
    for k in range(1200):
        w = [f"filler{rnd.randint(0, 60)}" for _ in range(8)]
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        w += ["zab"] * a + ["qud"] * b
        rnd.shuffle(w)
        rows.append((k, " ".join(w)))
        known.append((k, int(a and b)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id < 900"), epochs=30)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    held = [(got[k], y) for k, y in known if k >= 900]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.97


def test_toxicity_of_rows(docs, nothing, labels):
    model = toxicity.train_on(docs, labels)
    found = toxicity.scores(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert toxicity.scores(nothing, toxicity.train_on(nothing, labels)).count() == 0
    held = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    r = toxicity.scores(docs.join(labels.where(toxicity.held_out()), "doc_id"), toxicity.train_on(docs, labels)).join(labels, "doc_id").toPandas()
    rank = r.score.rank()
    n1, n0 = (r.toxic == 1).sum(), (r.toxic == 0).sum()
    assert (rank[r.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.96


def test_every_stage_takes_awkward_rows(spark, docs, nothing):
    d = "/root/testdata/sf0.001"
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for source in (docs, nothing, docs.select(columns)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, source, d)
            assert name == "packing" or out.columns == source.columns
            assert out.count() >= (name == "packing" and source is not nothing)


def test_no_stage_touches_other_columns(spark, docs):
    """Columns of any name come out by value as they went in, beside the id that they came with."""
    names = "_id _mark _text _score _h1 _h2 h1 h2 row cut places mark removed _cut _removed score fp root first what.ever id said".split()
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").dropDuplicates(["doc_id"])
    source = plain.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names), F.create_map(F.lit("k"), "doc_id").alias("places2"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, source, "/root/testdata/sf0.001")
        assert out.columns == source.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[n] == f"{n}{r.doc_id}" for n in names) and r.places2 == {"k": r.doc_id}, name


def test_near_duplicates_keep_every_text(spark):
    """Rows without id or with one id, each with a text of its own, all stay; of copies one does, that of the least id."""
    rnd = random.Random(12)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    texts = [text() for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (4, texts[3]), (4, texts[4]), (6, texts[5])]
    more = [(9, texts[5]), (None, texts[5]), (2, texts[6]), (None, texts[7]), (1, texts[7]), (1, texts[7])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + more], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    want = collections.Counter([*rows, (2, texts[6]), (1, texts[7])])
    assert collections.Counter((r.doc_id, r.text) for r in kept) == want


def held_items(docs, items):
    """Documents that hold an item, by comparing every item with every place of every document."""
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    number, bad = {}, set()
    ids = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
    for i, t in docs:
        d = ids(tok(t))
        for m in (ids(tok(x)) for _, x in items):
            w = min(13, len(m))
            if not w or len(d) < w:
                continue
            padded = np.concatenate([np.full(len(m), -1), d, np.full(len(m), -1)])
            equal = np.lib.stride_tricks.sliding_window_view(padded, len(m)) == m
            total = np.concatenate([np.zeros((len(equal), 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
            if (total[:, w:] - total[:, :-w]).max() >= 0.8 * w:
                bad.add(i)
                break
    return bad


def test_pipeline_by_brute_force(spark):
    """run() on the smallest tables: each stage's rows, but for the trained scores, by the slow way."""
    from test_dedup import linked, slow_fingerprint

    d = "/root/testdata/sf0.001"
    table = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    model = toxicity.train_on(table("documents"), table("labels"))
    score = {r.doc_id: r.score for r in toxicity.scores(table("documents"), model).collect()}
    rows = sorted((r.doc_id, r.text) for r in table("documents").collect() if score[r.doc_id] < corpus_pipeline.TOXIC)
    roots = linked([slow_fingerprint(t) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    data = [t.encode() for _, t in rows]
    counts = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    cut = []
    for (i, t), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        kept = t if keep.all() else bytes(np.frombuffer(b, np.uint8)[keep]).decode("utf-8", "ignore")
        if keep.all() or WORD.search(kept):
            cut.append((i, kept))
    bad = held_items(cut, [(r.item_id, r.text) for r in table("benchmark").collect()])
    want = collections.Counter()
    for i, t in cut:
        if i not in bad:
            ids = [*library_ids(t), 0]
            want.update((i, k, v) for k, v in enumerate(ids))
    got = collections.Counter((p.doc_id, p.start + k, v) for p in corpus_pipeline.run(spark, d).collect() for k, v in enumerate(np.frombuffer(bytes(p.ids), "<u4").tolist()))
    assert got == want


def library_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _LIBRARY
    if _LIBRARY is None:
        _LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return _LIBRARY.encode(text, add_special_tokens=False).ids


_LIBRARY = None


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, seen = seen, stage(spark, seen, d).checkpoint()
        assert seen.count() <= before.count() and seen.join(before, "doc_id", "left_anti").count() == 0
    texts = {r.doc_id: r.text for r in seen.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, d)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(texts)
    assert corpus_pipeline.run(spark, d).count() == pieces.count()


def plain_article(source):
    """The text of a page's article by substitution: blocks become lines, other tags go."""
    found = re.search(r"(?s)<article[^>]*>(.*?)</article>", source or "")
    if not found:
        return None
    inner = re.sub(r"(?s)<!--.*?-->|<(script|style|form|aside)\b.*?</\1>|<div class=\"(?:ad|comments)\">.*?</div>", "\n", found[1])
    inner = re.sub(r"</?(?:p|h[1-6]|br|li|ul|ol|div|section|blockquote|pre|table|tr|td|th|figure|figcaption|header|hr)\b[^>]*>", "\n", inner)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in inner.split("\n"))
    return " ".join(x for x in lines if x)


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r.text for r in mainhtml.extracted(pages).collect()}
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    assert len(got) == len(want) and sum(w is not None for w in want.values()) > 0.9 * len(want)
    assert [(k, got[k], w) for k, w in want.items() if w is not None and got[k] != w][:2] == []


@pytest.mark.parametrize("source", ["<a " * 350_000, "<script" * 150_000, "<div>" * 200_000 + "x" + "</section>" * 100_000, '<a "' * 250_000, "<a '" + '<b "' * 250_000, "<!--" * 250_000, "<" * 1_000_000, "<p title=" * 110_000])
def test_broken_markup_takes_linear_time(source):
    began = time.process_time()
    page = mainhtml.Page(source)
    page.votes()
    page.text("x")
    assert time.process_time() - began < 8


@pytest.mark.parametrize(
    "source, want",
    [
        ('<body><div class="post comments-on"><p>real text here</p></div></body>', "real text here"),
        ('<body><div class="story-widget"><h2>Head</h2><p>real text</p></div></body>', "Head real text"),
        ('<article><p>one</p><div class="related-facts"><p>two</p></div></article>', "one two"),
        ('<main><p>one</p><section class="notice-period"><p>two</p></section></main>', "one two"),
        ('<article><p>one one</p><div class="cookie-notice">no</div><div class="ad-slot-3">no</div><div id="comments"><p>no no no no no no no</p></div></article>', "one one"),
        ('<body><form><article><p>in a form</p></article><input></form></body>', "in a form"),
        ('<body><div class="sidebar"><p>only this</p></div></body>', "only this"),
        ('<p class="a>text</p><p>more</p>', "text more"),
        ("<nav>menu</nav>", ""),
    ],
)
def test_names_drop_with_care(source, want):
    assert mainhtml.Page(source).text(None) == want
