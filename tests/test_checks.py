"""Rules without an SQL twin, against plain versions."""

import difflib
import json
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import checks, jsonio, similarity
from quire.operators import articles, dedup, fragments, glossary, images, metrics, process, progress, retries, translate
from quire.plans.checks import variants
from quire.sources import files, sinks


def plain_fault(original, translated):
    """The quality rules one after the other."""
    if not translated or not translated.strip():
        return "empty"
    if any(m in translated for m in checks.LEAKS):
        return "leak"
    table = any(t in original.lower() for t in ("<table>", "<td>", "<tr>"))
    structured = original.count("@") >= 2 or original.count("http") >= 2 or original.count("$") >= 3
    bare = original.strip()
    url = (bare.startswith(("http", "www.")) or ".com" in original or ".org" in original) and len(original.split()) <= 3
    contact = "@" in original and (original.count(":") >= 2 or "+" in original and len(original) < 200)
    right = bare.startswith(("©", "BY:")) or "All rights reserved" in original
    chinese = sum("一" <= c <= "鿿" for c in original) / max(len(bare), 1) > 0.3
    if not (url or contact or right or chinese):
        a, b = (re.sub("[ \n]", "", t) for t in (original, translated))
        if len(a) > 50 and difflib.SequenceMatcher(None, a, b).ratio() > (0.98 if table or structured else 0.9):
            return "untranslated"
    if len(translated) > len(original) * (10 if len(original) < 20 else 5):
        return "too_long"
    if not (table or structured) and len(translated) > 100:
        for size in (20, 30, 50):
            for i in range(min(200, len(translated) - size)):
                if translated.count(translated[i : i + size]) >= 3:
                    return "repetition"
    if any(m.lower() in translated[:50].lower() for m in checks.ANNOUNCEMENTS):
        return "meta"
    return None


def test_translation_faults(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", *(c.alias(k) for k, c in variants().items())).where("original is not null")
    more = [(None, "a b@c.d x@y", "a b@c.d x@y"), (None, "word " * 30, "word " * 29 + "ward"), (None, "<td>" + "x1 " * 40, "<td>" + "x1 " * 36 + "zzzz"), (None, "© all of it " * 9, "© all of it " * 9), (None, "short", "q" * 51), (None, "text of it", "I will translate: x")]
    rows = rows.union(spark.createDataFrame(more, "doc_id long, original string, translated string"))
    found = rows.withColumn("fault", checks.translation_fault(F.col("original"), F.col("translated"))).collect()
    assert [(r.original, r.translated, r.fault, w) for r in found if r.fault != (w := plain_fault(r.original, r.translated))] == []
    assert {r.fault for r in found} == {"empty", "leak", "untranslated", "too_long", "repetition", "meta", None}


def slow_balanced(text):
    for start in range(len(text)):
        if text[start] not in "[{":
            continue
        stack = []
        for at in range(start, len(text)):
            if text[at] in "[{":
                stack.append("]" if text[at] == "[" else "}")
            elif text[at] in "]}":
                if stack.pop() != text[at]:
                    break
                if not stack:
                    return text[start : at + 1]
    return None


def test_first_balanced():
    rnd = random.Random(3)
    for _ in range(4000):
        t = "".join(rnd.choice("[]{}ab") for _ in range(rnd.randint(0, 12)))
        assert jsonio.first_balanced(t) == slow_balanced(t), t
    assert jsonio.first_balanced('x {"a": "}\\"{"} y') == '{"a": "}\\"{"}'
    assert jsonio.first_balanced("[" * 200_000) is None


def test_mended_json(spark):
    texts = ['{"p":"C:\\\\dir\\x"}', '{"p":"C:\\dir"}', '{"a":"\\u0041\\n\\q\x02"}', "\\", "\\\\", "a\\\nb"]
    got = [r.m for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(jsonio.mended(F.col("t")).alias("m")).collect()]
    assert got == [jsonio.mend(t) for t in texts]
    assert json.loads(jsonio.mend(texts[0])) == {"p": "C:\\dir\\x"} and jsonio.parse(texts[0], "object") == '{"p": "C:\\\\dir\\\\x"}'


def plain_score(first, second):
    a, b = (" ".join(re.sub(r"[^\w\s]", " ", t.lower()).split()) for t in (first, second))
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    wa, wb = set(a.split()), set(b.split())
    ka, kb = wa - set(similarity.STOP_WORDS), wb - set(similarity.STOP_WORDS)
    jac = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    short, long = sorted((a, b), key=len)
    inside = len(short) / len(long) if short in long or len(a) == len(b) else 0.0
    return 0.25 * (1 - table[-1][-1] / len(long)) + 0.2 * jac(wa, wb) + 0.25 * difflib.SequenceMatcher(None, a, b).ratio() + 0.05 * inside + 0.25 * jac(ka, kb)


def titles(n, seed):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("naval drone war of the army future a logistics letters in editor space".split()) for _ in range(rnd.randint(1, 7))) for _ in range(n // 2)]
    near = [" ".join(w if rnd.random() > 0.08 else w + "s" for w in t.split()) for t in base]
    return [t for pair in zip(base, near, strict=True) for t in pair]


def test_scores_and_their_bounds(spark):
    ts = titles(60, 1)
    for a in ts[:30]:
        for b in ts:
            want = plain_score(a, b)
            assert similarity.score_text(a, b) == pytest.approx(want, abs=1e-9)
            assert (similarity.score_titles(similarity.Title(a), similarity.Title(b), 0.82) >= 0.82) == (want >= 0.82)
    rows = spark.createDataFrame([(a, b) for a in ts[:12] for b in ts[:12]], "a string, b string")
    for r in rows.withColumn("h", similarity.hybrid(F.col("a"), F.col("b"))).withColumn("s", similarity.is_similar(F.col("a"), F.col("b"))).collect():
        assert r.h == pytest.approx(plain_score(r.a, r.b), abs=1e-9) and r.s == (r.a.strip() == r.b.strip() or plain_score(r.a, r.b) >= 0.82)


def kept_rows(rows):
    """The sequential rule over (order, title, content) with every score worked out: the orders of the rows that stay."""
    slots, opened = [], []
    for k, title, content in rows:
        title = title.strip()
        if not title and not content.strip():
            continue
        if not title:
            heads = [c[:500].lower().strip() for _, c in slots]
            head = content[:500].lower().strip()
            n = [min(len(head), len(h)) for h in heads]
            if any(m and (head[:m] == h[:m] or (head in h if len(head) < len(h) else h in head)) for m, h in zip(n, heads, strict=True)) or len(content.strip()) < 200:
                continue
            slots.append((k, content))
            continue
        at = next((s for t, s in opened if t == title or plain_score(title, t) >= 0.82), None)
        if at is None:
            opened.append((title, len(slots)))
            slots.append((k, content))
        elif len(content) > len(slots[at][1]):
            slots[at] = k, content
    return sorted(k for k, _ in slots)


def test_articles_that_stay(spark):
    rnd = random.Random(5)
    each = {}
    for f in range(6):
        rows = [(k, t if rnd.random() > 0.15 else " ", "x" * rnd.randint(0, 20) + t * rnd.randint(0, 9)) for k, t in enumerate(titles(50, f))]
        each[f"f{f}"] = rows + [(100 + k, rnd.choice([t, "", None]) or "", c * rnd.randint(1, 3)) for k, (_, t, c) in enumerate(rows[:20])]
    each["ties"] = [(1, "The Future of Armor", "x" * 10), (2, "Future of Armor", "y" * 5), (4, "Future of Armor", "z" * 12), (7, "The Future of Armor", "w" * 12)]
    df = spark.createDataFrame([(f, k, t, c, "e") for f, rows in each.items() for k, t, c in rows], "file string, n long, title string, content string, at string").repartition(5)
    got = {}
    for r in dedup.dedup_articles(df, "file", "n", "title", "content").collect():
        got.setdefault(r.file, []).append(r.n)
    assert {f: sorted(ns) for f, ns in got.items()} == {f: kept_rows(rows) for f, rows in each.items()}
    assert got["ties"] == [4]


def test_paragraphs():
    """The paragraph rule with every kept paragraph compared."""
    rnd = random.Random(13)
    heads = ["a" * 20, "a" * 60, "b" * 25 + "c" * 40, "x"]
    for _ in range(300):
        parts = [rnd.choice(heads) + "".join(rnd.choice("aB—…") for _ in range(rnd.choice([0, 3, 40, 120]))) for _ in range(9)]
        kept, keys = [], []
        for part in parts:
            key = " ".join(re.sub("…", "...", re.sub("[–—-]", "-", part.lower())).split())
            if len(key) < 20:
                kept.append(part)
                continue
            if any(k == key for k, _ in keys):
                continue
            like = next((e for e in keys if len(e[0]) > 50 and e[0][: min(100, len(e[0]), len(key))] == key[: min(100, len(e[0]), len(key))]), None)
            if like is None:
                keys.append((key, len(kept)))
                kept.append(part)
            elif len(key) > 1.5 * len(like[0]):
                keys.remove(like)
                keys.append((key, like[1]))
                kept[like[1]] = part
        assert fragments.dedup_text("\n \n".join(parts)) == "\n\n".join(kept)


def test_groups_of_titles(spark):
    """The first group that fits a title's key, for fragments in any partitions."""
    rnd = random.Random(14)
    rows, want = [], {}
    for f in range(60):
        opened: list[str] = []
        for n in range(10):
            t = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 4)))
            rows.append((f"f{f}", n // 3, n % 3, t))
            fits = [i for i, o in enumerate(opened) if t and (o in t or t in o)]
            if t and not fits:
                fits = [len(opened)]
                opened.append(t)
            if t:
                assert want.setdefault((f"f{f}", t), fits[0]) == fits[0]
    df = spark.createDataFrame(rows, "file string, b int, s int, key string").repartition(4)
    assert {(r.file, r.key): r.group_no for r in fragments.title_groups(df, "file", "key", ["b", "s"]).collect()} == want


def test_single_and_several_fragments(spark):
    """What is alone stays as it is; three fragments are folded in the order of batches; a loose one is an article of its own."""
    raw = "  first\n\n\nfirst paragraph of some length\n\nfirst paragraph of some length  "
    parts = [("f", 0, 0, "One", raw, True), ("f", 2, 0, "Three parts", "the end " * 9, None), ("f", 0, 1, "Three parts", "start of it all " * 8, False), ("f", 1, 0, "three parts and more", "middle " * 12, True), ("f", 1, 1, "", raw, None), ("f", 1, 2, None, None, None), ("g", 0, 0, "One", None, None), (None, 0, 0, "One", "no file", None)]
    rows = [(f, b, s, t, " " if s else None, f"a{b}", c, n, 10 * b or None, 10 * b + 5, [f"i{b}{s}"] if c else None) for f, b, s, t, c, n in parts]
    df = spark.createDataFrame(rows, "file_id string, batch_idx int, frag_seq int, title string, subtitle string, authors string, content string, not_in_toc boolean, start_page int, end_page int, images array<string>").repartition(3)
    got = sorted((str(r.file_id), r.title, r.subtitle, r.authors, r.content, r.not_in_toc, r.start_page, r.end_page, r.images, r.n_fragments) for r in fragments.merge_fragments(df).collect())
    folded = fragments.fold_contents(["start of it all " * 8, "middle " * 12, "the end " * 9])
    assert got == sorted(
        [
            ("f", "One", None, "a0", raw, True, None, 5, ["i00"], 1),
            ("f", "three parts and more", None, "a0", folded, True, 10, 25, ["i01", "i10", "i20"], 3),
            ("f", "", None, "a1", raw, False, 10, 15, ["i11"], 1),
            ("f", "", None, "a1", "", False, 10, 15, [], 1),
            ("g", "One", None, "a0", "", False, None, 5, [], 1),
            ("None", "One", None, "a0", "no file", False, None, 5, ["i00"], 1),
        ]
    )


def test_all_similar_titles_are_paired(spark):
    ts = titles(120, 8) + ["the same title again"] * 70 + [f"naval logistics in the army of number {k} future war letters and space" for k in range(6)]
    df = spark.createDataFrame([("f", k, t) for k, t in enumerate(ts)], "file string, n int, title string")
    first = {}
    for k, t in enumerate(ts):
        first.setdefault(t.strip(), k)
    each = spark.createDataFrame([("f", k, t) for t, k in first.items()], df.schema)
    got = {(r.first, r.second) for r in dedup.similar_titles(each, "file", "n", "title").collect()}
    want = {(i, j) for t, i in first.items() for u, j in first.items() if i < j and plain_score(u, t) >= 0.82}
    assert got == want and len(want) > 4
    root, score = {}, {}
    for t, k in first.items():
        named = [(o, plain_score(t, u)) for u, o in first.items() if o < k and root[o] == o]
        root[k], score[k] = next(((o, s) for o, s in named if s >= 0.82), (k, 1.0))
    found = dedup.title_classes(df, "file", "n", "title").collect()
    assert {(r.title, r.at): (r.root, round(r.score, 9), r.n_similar) for r in found} == {(t, k): (root[k], round(score[k], 9), sum(k in p for p in want)) for t, k in first.items()}


def test_ratio_is_the_librarys():
    rnd = random.Random(9)
    for _ in range(1500):
        letters = rnd.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyzé0123456789 "])
        text = lambda n, letters=letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
        a, b = text(rnd.choice([5, 60, 260])), text(rnd.choice([5, 60, 260]))
        if rnd.random() < 0.5:
            k = rnd.randint(0, len(a))
            b = b[: rnd.randint(0, len(b))] + a[k : k + rnd.randint(0, 80)] + text(20)
        assert similarity.matching_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)


def test_terms_are_replaced_in_order():
    rnd = random.Random(4)
    urls = ["https://a.b/the", "www.the.org", "[the](x)", "doi: 10.1/the"]
    words = ["the", "The", "other", "İi", "ıı", "ſea", "sea", "mother", "x"]
    for _ in range(400):
        terms = sorted({(rnd.choice(["the", "other", "sea", "i", "ss", "a", "he"]), rnd.choice(["sea", "THE", "q", "other"])) for _ in range(3)}, key=lambda t: (-len(t[0]), t))
        text = " ".join(rnd.choice(words + urls) for _ in range(8))
        for whole in (True, False):
            kept, hits = [], 0
            plain = glossary.URL.sub(lambda m, kept=kept: (kept.append(m[0]), f"\x00{len(kept) - 1}\x00")[1], text)
            for source, target in terms:
                plain, n = re.subn(rf"\b{source}\b" if whole else source, target, plain, flags=re.I)
                hits += n
            plain = re.sub(r"\x00(\d+)\x00", lambda m, kept=kept: kept[int(m[1])], plain)
            assert glossary.replace_terms(text, terms, whole, True) == (plain, hits)


def test_content_heads(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("ab cd efg hi".split()) for _ in range(rnd.randint(0, 12))) for _ in range(60)] + ["z" * 700, "z" * 600, "z" * 30, "Z", "  "]
    df = spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "file string, n int, content string")
    heads = {t[:500].lower().strip() for t in texts} - {""}
    got = {r["head"]: (r["first"], r["n_rows"], r["n_longer"]) for r in articles.head_classes(df, "file", "n", "content").collect()}
    own = [t[:500].lower().strip() for t in texts]
    assert got == {h: (own.index(h), own.count(h), sum(h in x and len(x) > len(h) for x in heads)) for h in heads}
    pairs = spark.createDataFrame([(a, b) for a in texts[:20] for b in texts[:20]], "a string, b string").withColumn("same", articles.is_content_duplicate(F.col("a"), F.col("b")))
    for r in pairs.collect():
        x, y = r.a[:500].lower().strip(), r.b[:500].lower().strip()
        assert r.same == bool(x and y and (x in y or y in x))


def test_long_content_heads(spark):
    """Heads cut from one text, of lengths around each lead, and a head that lower case makes longer than 500 characters."""
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcde ") for _ in range(700))
    texts = [base[i : i + n] for n in (7, 9, 15, 16, 33, 70, 129, 255, 256, 300, 479, 480, 481, 499, 500) for i in rnd.sample(range(200), 4)] + ["\u0130" * 500, "\u0130" * 499, "x" * 500]
    df = spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "file string, n int, content string")
    heads = {t[:500].lower().strip() for t in texts}
    got = {r["head"]: r.n_longer for r in articles.head_classes(df, "file", "n", "content").collect()}
    assert got == {h: sum(h in x and len(x) > len(h) for x in heads) for h in heads}
    # Of a head of 500 characters some hundreds of anchors are joined as numbers, and not the head itself at each of its places.
    own = pd.Series([base[:500]])
    assert sum(len(articles.anchors(own, lead)[0]) for lead in articles.LEADS if lead >= 32) < 150


def test_fuzzy_windows(spark):
    rnd = random.Random(2)
    rows = [("".join(rnd.choice("abc") for _ in range(6)), "".join(rnd.choice("abc") for _ in range(30))) for _ in range(60)]
    found = spark.createDataFrame(rows, "a string, b string").withColumn("f", similarity.fuzzy_contains(F.col("a"), F.col("b"), 0.8)).collect()
    for r in found:
        assert r.f == any(sum(p == q for p, q in zip(r.a, r.b[k:], strict=False)) / 6 >= 0.8 for k in range(25))


def test_suppression(spark):
    rnd = random.Random(6)
    rows = [(rnd.randint(0, 2), k, rnd.randint(0, 40) / 2) for k in range(120)]
    df = spark.createDataFrame(rows, "u int, n int, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    want, last, hidden = {}, {}, {}
    for u, n, s in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if u not in last or s - last[u] >= 5:
            want[n] = (True, hidden.get(u, 0))
            last[u], hidden[u] = s, 0
        else:
            want[n] = (False, None)
            hidden[u] = hidden.get(u, 0) + 1
    assert {r.n: (r.shown, r.n_suppressed) for r in metrics.suppressed(df, "u", "ts", "n").collect()} == want


def test_concurrency_states(spark):
    rnd = random.Random(7)
    rows = [(1, k, rnd.choice([200] * 40 + [429]), float(k * 3)) for k in range(300)]
    got = {r.n: r.limit_now for r in retries.concurrency(spark.createDataFrame(rows, "u long, n long, status int, seconds double"), "u", "n").collect()}
    want = limits([(status, at) for _, _, status, at in rows])
    assert [got[n] for n in range(300)] == want and len(set(want)) > 2


def limits(calls):
    """The limit after each call: by the calls since the last rise, looked at anew each time."""
    out, risen = [8], -1  # the limit before each call; the number of the call that last raised it
    for k, (status, at) in enumerate(calls):
        counted = [s for s, _ in calls[risen + 1 : k + 1] if s != 429]
        since = calls[max(risen, 0)][1]
        if status == 429:
            out.append(max(1, out[-1] // 2))
        elif status == 200 and len(counted) >= 20 and counted.count(200) >= 0.9 * len(counted) and at - since >= 30 and out[-1] < 64:
            out.append(min(64, out[-1] * 2))
            risen = k
        else:
            out.append(out[-1])
    return out[1:]


def test_what_a_429_and_failures_change(spark):
    """A 429 does not delay the next rise, a failure at the moment of a rise does, and at the upper limit nothing begins anew."""
    calls = {
        1: [(200, 2.0 * k) for k in range(19)] + [(429, 38.0), (200, 39.0), (200, 40.0)],
        2: [(200, 2.0 * k) for k in range(19)] + [(500, 38.0), (200, 39.0)],
        3: [(200, 2.0 * k) for k in range(200)],
        4: [(429, 1.0)] * 6 + [(500, 50.0)] * 3 + [(200, 60.0)] * 40,
    }
    rows = [(u, n, s, t) for u, one in calls.items() for n, (s, t) in enumerate(one)]
    got = {(r.u, r.n): r.limit_now for r in retries.concurrency(spark.createDataFrame(rows, "u long, n long, status int, seconds double"), "u", "n").collect()}
    for u, one in calls.items():
        assert [got[u, n] for n in range(len(one))] == limits(one), u
    assert [got[1, n] for n in (18, 19, 20, 21)] == [8, 4, 8, 8] and [got[2, n] for n in (19, 20)] == [8, 16] and max(got[3, n] for n in range(200)) == 64


def test_sessions_are_read(spark, tmp_path):
    good = json.dumps({"session_id": "s", "files": ["a\\b.pdf", "c.pdf"], "file_progress": {"a/b.pdf": {"status": "failed", "error": "e", "issues": ["i"], "stages": {"extraction": {"status": "failed"}, "translation": "completed"}}}})
    (tmp_path / "one.json").write_text("{ broken")
    (tmp_path / "one.json.bak").write_text(good)
    (tmp_path / "two.json").write_text(good.replace('"s"', '"t"'))
    (tmp_path / "two.json.bak").write_text("{}")
    found, stages = progress.session_files(progress.read_sessions(spark, str(tmp_path)))
    assert sorted(tuple(r) for r in found.collect()) == sorted((s, *x) for s in "st" for x in (("a/b.pdf", "failed", "e", 1), ("c.pdf", "pending", None, 0)))
    assert {tuple(r) for r in stages.collect()} == {(s, "a/b.pdf", k, v) for s in "st" for k, v in (("extraction", "failed"), ("translation", "completed"))}


def test_logs_and_listings(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "text_id string, n int, text string")
    sinks.append_log(log, f"{tmp_path}/log")
    sinks.append_log(log.where("n = 1"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 5
    assert {(r.text_id, r.text) for r in files.json_lines_latest(spark, f"{tmp_path}/log", "text_id", "n").collect()} == {("a", "y"), ("b", "z")}
    sinks.write_articles(log, f"{tmp_path}/articles")
    assert spark.read.json(f"{tmp_path}/articles").count() == 3
    sinks.write_glossary(spark.createDataFrame([("a,b", 'x"y')], "source_term string, target_term string"), f"{tmp_path}/glossary", "zh")
    assert [tuple(r) for r in spark.read.option("header", "true").option("escape", "\\").csv(f"{tmp_path}/glossary").collect()] == [("a,b", 'x"y', "zh")]
    sinks.write_sheet(spark.createDataFrame([("a\x01b", 1)], "t string, n int"), f"{tmp_path}/sheet")
    assert [tuple(r) for r in spark.read.option("header", "true").csv(f"{tmp_path}/sheet").collect()] == [("ab", "1")]


def test_quality_loop():
    calls = []
    client = translate.with_quality(lambda ts: (calls.append(ts[0]), [ts[0]])[1], lambda ts: ["done " + ts[0]] if ts[0] != "no" else ["no"], lambda a, b: a != b)
    assert client(["a", "no"]) == ["done a", "no"] and calls == ["a", "a", "no", "no"]
    never = translate.with_quality(lambda ts: ts, lambda ts: ts, lambda a, b: a != b)
    assert never(["a"] * 5) == ["a"] * 5


def test_images_again(spark):
    cached = spark.createDataFrame([("f", 1, "d"), ("f", 1, None), ("f", 2, " ")], "file string, batch int, description string")
    assert [tuple(r) for r in images.reusable(cached, ["file", "batch"]).collect()] == [("f", 1)]
    with pytest.raises(ValueError, match="content_zh"):
        checks.in_language(cached.withColumn("content", F.lit("c")), ["content"], "_zh", ["content"])
    assert fragments.totals(cached, ["file"], "description").first().n_fragments == 3


def test_versions_and_missing_outputs(spark, tmp_path):
    df = spark.createDataFrame([("f1", "<p>a</p>"), ("f2", "<p>b</p>")], "name string, html string")
    with pytest.raises(FileNotFoundError):
        files.newest_version(spark, f"{tmp_path}/final", f"{tmp_path}/merged")
    assert sinks.save_if_changed(df, f"{tmp_path}/merged", ["name"]) and not sinks.save_if_changed(df, f"{tmp_path}/merged", ["name"])
    assert sinks.save_if_changed(df.where("name = 'f1'"), f"{tmp_path}/merged", ["name"])
    assert files.newest_version(spark, f"{tmp_path}/final", f"{tmp_path}/merged").count() == 1
    assert sinks.save_if_changed(df, f"{tmp_path}/final", ["name"])
    assert files.newest_version(spark, f"{tmp_path}/final", f"{tmp_path}/merged").count() == 2
    assert not [p for p in (tmp_path / "merged").iterdir() if "trial" in p.name]
    made = sinks.render_missing(df, spark.createDataFrame([("f1",)], "name string"), "name", lambda t: t.encode()).collect()
    assert [(r.name, bytes(r.file), r.error) for r in made] == [("f2", b"<p>b</p>", None)]
    sinks.write_image_notes(df, f"{tmp_path}/notes")
    assert spark.read.json(f"{tmp_path}/notes").count() == 2


def test_calls_are_limited(spark):
    df = spark.range(40).repartition(8)
    out = retries.limited(df, 2, lambda parts: parts)
    assert out.count() == 40 and out.rdd.getNumPartitions() <= 2


def test_a_file_is_processed(spark):
    parts = [("f", 0, 0, "One", "one " * 30, 1, 4), ("f", 1, 0, "One", "more of one " * 12, 4, 6), ("f", 1, 1, "Sponsored", "buy " * 40, 6, 6), ("f", 1, 2, "Two", "two e " * 30, 6, 8), ("f", 0, 1, "Table of Contents", "x " * 40, 1, 1)]
    rows = spark.createDataFrame([(f, b, s, t, None, None, c, False, a, z) for f, b, s, t, c, a, z in parts], "file_id string, batch_idx int, frag_seq int, title string, subtitle string, authors string, content string, not_in_toc boolean, start_page int, end_page int")
    pictures = spark.createDataFrame([("f", 2, "a.png", 90000, 500, 400, 0.5), ("f", 8, "b.png", 90000, 500, 400, 0.5), ("f", 7, "small.png", 9, 500, 400, 0.5)], "file_id string, page int, path string, size int, width int, height int, color_richness double")
    cache = spark.createDataFrame([("f", 0, "eins")], "file_id string, article_idx int, translated string")
    out = process.process(rows, pictures, cache, spark.createDataFrame([("f", "Journal")], "file_id string, name string"), translate.digit_client)
    got = {r.title: (r.article_idx, r.images, r.n_fragments) for r in out.articles.collect()}
    assert got == {"One": (0, ["a.png"], 2), "Two": (1, ["b.png"], 1)}
    assert {r.title: r.translated[:5] for r in out.translated.collect()} == {"One": "eins", "Two": "two 3"}
    html = out.translated_pages.first()["html"]
    assert "<h1>Journal</h1>" in html and "<p>eins</p>" in html and 'id="article-2"' in html and out.pages.first().n_articles == 2


def test_anchors_are_filtered_before_they_are_dealt_out(spark):
    """Of the anchors within long heads few others go on than those that short heads begin with; no link is lost."""
    rnd = random.Random(12)
    some = lambda n: "".join(rnd.choice("abcdefghij klm") for _ in range(n)).strip() or "x"
    long = [some(480) for _ in range(120)]
    short = [t[k : k + n].strip() for t, k, n in ((long[i], 11 * i, rnd.choice([20, 40, 90, 200])) for i in range(20))] + [some(30) for _ in range(40)]
    rows = [("f" if i % 3 else None, i, t) for i, t in enumerate(long + short)]
    df = spark.createDataFrame(rows, "file string, n long, content string")
    got = {(r["file"], r["head"]): r["n_longer"] for r in articles.head_classes(df, "file", "n", "content").collect()}
    want = {(f, t) for f, _, t in rows}
    assert got == {(f, t): len({u for g, u in want if g == f and f is not None and len(u) > len(t) and t in u}) for f, t in want}
    heads = df.select("file", F.col("content").alias("head"), F.col("n").alias("id"), F.array(F.lit(16), F.lit(32)).alias("leads"))
    asked = heads.where("n >= 120").withColumn("leads", F.array(F.lit(16)))
    bits = articles.anchor_filter(asked, "file")
    beginnings = {(r["file"], r["lead"], r["key"]) for r in articles._anchored(asked, "file", True).collect()}
    passed = articles._anchored(heads.where("n < 120"), "file", False, bits)
    every = articles._anchored(heads.where("n < 120"), "file", False)
    meets = lambda rows: sorted(map(str, (r for r in rows.collect() if (r["file"], r["lead"], r["key"]) in beginnings)))
    assert meets(passed) == meets(every) != [] and passed.count() < len(meets(every)) + 20 < every.count() / 20
    assert articles.anchor_filter(asked.limit(0), "file") is None
