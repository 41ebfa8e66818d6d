"""Operators on small tables, golden values and plain-Python twins of the folds."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import archive, dedup, fragments, glossary, images, layout, matching, metrics, progress, render, tables, translate
from quire.sources import files, sinks


def test_fold_of_contents():
    a = "x" * 30 + "shared words that overlap here"
    assert fragments.fold_contents([a, "shared words that overlap here and more"]) == a + "\n\nand more"
    assert fragments.fold_contents(["short text to be replaced", "Short text to be replaced by a longer version of it"]) == "Short text to be replaced by a longer version of it"
    assert fragments.fold_contents(["one", "", "two"]) == "one\n\ntwo"


def test_text_dedup_is_idempotent():
    rnd = random.Random(1)
    for _ in range(40):
        parts = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 130))) for _ in range(4)]
        once = fragments.dedup_text("\n\n".join(rnd.choice(parts) for _ in range(8)))
        assert fragments.dedup_text(once) == once


def test_merge_fragments(spark):
    rows = [("f", 1, 0, "Alpha Beta", None, "by", "second", True, 0, 9), ("f", 0, 0, "Alpha", "sub", "", "first", False, 1, 4), ("f", 0, 1, None, None, None, "loose", None, 2, 2)]
    df = spark.createDataFrame(rows, "file_id string, batch_idx int, frag_seq int, title string, subtitle string, authors string, content string, not_in_toc boolean, start_page int, end_page int")
    out = {r.title: r for r in fragments.merge_fragments(df).collect()}
    a = out["Alpha Beta"]
    assert (a.subtitle, a.authors, a.content, a.not_in_toc, a.start_page, a.end_page, a.n_fragments) == ("sub", "by", "first\n\nsecond", True, 1, 9, 2)
    assert out[""].content == "loose"


def test_article_dedup(spark):
    rows = [("f", 1, "The Future of Armor", "short"), ("f", 2, "Future of Armor", "a longer text"), ("f", 3, "", "a longer text"), ("f", 4, None, "z" * 250), ("f", 5, "", "tiny"), ("f", 6, "", ""), ("g", 7, "Future of Armor", "other file"), ("f", 8, "Letters", "q")]
    df = spark.createDataFrame(rows, "file string, n int, title string, content string")
    got = sorted((r.file, r.n) for r in dedup.dedup_articles(df, "file", "n", "title", "content").collect())
    assert got == [("f", 2), ("f", 4), ("f", 8), ("g", 7)]
    found = {(r.file, r.at): (r.root, r.n_similar) for r in dedup.title_classes(df, "file", "n", "title").collect()}
    assert found == {("f", 1): (1, 1), ("f", 2): (1, 1), ("f", 8): (8, 0), ("g", 7): (7, 0)}


@pytest.mark.parametrize("parts", [1, 5])
def test_paragraph_dedup_by_partitions(spark, parts):
    df = spark.createDataFrame([(k, "A line that is long enough\nshort\na line  that is long enough\nshort") for k in range(20)], "doc_id long, text string").repartition(parts)
    for long in (2000, 2):
        out = dedup.dedup_paragraphs(df, "doc_id", "text", "\n", long=long).collect()
        assert len(out) == 20 and {r.content for r in out} == {"A line that is long enough\nshort\nshort"}


def merged(texts):
    out, i = [], 0
    while i < len(texts):
        t, n = texts[i].strip(), texts[i + 1].strip() if i + 1 < len(texts) else ""
        if n and t and (t[-1] == "-" or t[-1] not in ".!?。！？,;:" and n[0].islower()):
            out.append(texts[i].rstrip() + " " + texts[i + 1].lstrip())
            i += 2
        else:
            out.append(texts[i])
            i += 1
    return out


def test_adjacent_merge(spark):
    rnd = random.Random(2)
    pages = [["frig-", "ates"], ["a-", "b-", "c-"]] + [[rnd.choice(["ab", "Ab.", "x-", "Yz", "q,"]) for _ in range(rnd.randint(1, 9))] for _ in range(60)]
    rows = [(p, k, t) for p, texts in enumerate(pages) for k, t in enumerate(texts)]
    out = layout.merge_adjacent(spark.createDataFrame(rows, "page int, n int, text string"), ["page"], "n", "text")
    got = {}
    for r in out.orderBy("page", "n").collect():
        got.setdefault(r.page, []).append(r.text)
    assert [got[p] for p in range(len(pages))] == [merged(t) for t in pages]


def test_runs_of_narrow_images(spark):
    rows = [(p, k, p != 3 or k != 2) for p, n in ((1, 6), (2, 5), (3, 5)) for k in range(n)]
    out = layout.group_runs(spark.createDataFrame(rows, "page int, n int, narrow boolean"), ["page"], "n", F.col("narrow"))
    got = {(r.page, r.n): (r.run, r.group_no, r.grouped) for r in out.collect()}
    assert [got[1, k][1:] for k in range(6)] == [(0, True)] * 4 + [(1, True)] * 2
    assert [got[2, k][2] for k in range(5)] == [True] * 4 + [False]
    assert [got[3, k][2] for k in range(5)] == [True, True, False, True, True]


@pytest.mark.parametrize("block", [64, 2])
def test_interval_match(spark, block):
    points = spark.createDataFrame([("f", 1, 5), ("g", 2, 5), ("f", 3, 99), ("f", 4, 0)], "file string, img int, page int")
    ranges = spark.createDataFrame([("f", 1, 1, 4), ("f", 2, 5, 9), ("g", 1, 1, 4), ("g", 2, 6, 9)], "file string, art int, s int, e int")
    got = {r.img: (r.art, r.score) for r in matching.match_pages(points, ranges, "file", "page", "s", "e", "art", block=block).collect()}
    assert got == {1: (2, 1.0), 2: (1, 0.5), 4: (1, 0.5)}


@pytest.mark.parametrize("slack", [0, 1, 3])
def test_pages_of_ranges_of_any_length(spark, slack):
    """Against every point with every range: ranges of one page, long ones, reversed ones, none."""
    rnd = random.Random(slack)
    ranges = [(f, 100 * f + k, s, s + rnd.choice([-3, 0, 1, 5, 40, 300])) for f in range(3) for k, s in enumerate(rnd.choices(range(-5, 200), k=14))] + [(0, 99, None, 4), (1, 199, 4, None)]
    points = [(f, n, rnd.randint(-10, 320)) for f in range(4) for n in range(250)] + [(0, 999, None)]
    a = spark.createDataFrame(points, "f long, n long, p int").repartition(3)
    plan = matching.match_pages(a, spark.createDataFrame(ranges, "f long, art long, s int, e int"), "f", "p", "s", "e", "art", slack=slack, block=7)
    want = {}
    for f, n, p in points:
        fits = []
        for g, art, s, e in ranges:
            if f == g and None not in (p, s, e):
                score = 1.0 if s <= p <= e else 0.5 if min(abs(p - s), abs(p - e)) <= slack else 0
                fits += [(-score, art)] * (score > 0)
        if fits:
            want[f, n] = (min(fits)[1], -min(fits)[0])
    assert {(r.f, r.n): (r.art, r.score) for r in plan.collect()} == want
    assert "Window" not in plan._jdf.queryExecution().toString()


def test_places_of_one_point(spark):
    points = spark.createDataFrame([(1, 0, 4), (1, 0, 9), (2, 0, 4), (3, 0, 90)], "n int, f int, p int")
    ranges = spark.createDataFrame([(0, 7, 1, 3), (0, 8, 9, 9)], "f int, art int, s int, e int")
    found = matching.match_pages(points, ranges, "f", "p", "s", "e", "art", ["n"])
    assert sorted((r.n, r.p, r.art, r.score) for r in found.collect()) == [(1, 9, 8, 1.0), (2, 4, 7, 0.5)]


def test_images_by_strategy(spark):
    images_ = spark.createDataFrame([("f", "a", 1, 0.9), ("f", "b", 2, 0.1), ("f", "a", 3, 0.2), ("f", None, 1, None), ("f", "", 1, 0.6), ("f", "c", 0, 0.1), ("f", "d", None, 0.1), ("f", "e", 5, 0.3)], "file string, path string, page int, y double")
    arts = spark.createDataFrame([("f", 1, 1, 3), ("f", 2, 6, 9)], "file string, art int, s int, e int")
    found = lambda how: {(r.path, r.y): (r.art, r.score, r.place) for r in matching.match_images(images_, arts, "file", "page", "s", "e", "art", "path", "y", how).collect()}
    assert found("page_proximity") == {(None, None): (1, 1.0, 1), ("", 0.6): (1, 1.0, 2), ("a", 0.9): (1, 1.0, 3), ("b", 0.1): (1, 1.0, 4), ("e", 0.3): (2, 0.5, 1)}
    assert found("vertical_position") == {("b", 0.1): (1, 1.0, 1), (None, None): (1, 1.0, 2), ("", 0.6): (1, 1.0, 3), ("a", 0.9): (1, 1.0, 4), ("e", 0.3): (2, 0.5, 1)}
    assert found("else") == {}


def test_references(spark):
    refs = spark.createDataFrame([(1, "a", 9), (2, "a", 2), (3, "a", 1), (4, "b", 1)], "n int, img string, at int")
    known = spark.createDataFrame([("a", 1)], "img string, page int")
    got = {r.n: r.verdict for r in images.check_references(refs, known, "img", "n", "page", "at").collect()}
    assert got == {1: "page", 2: "accepted", 3: "repeated", 4: "missing"}


def test_evidence(spark):
    row = spark.createDataFrame([("Table 1", "see Table 1 and [PLACE] x", "[PLACE]", "nowhere", 3)], "c string, b string, k string, a string, p int")
    assert row.select(matching.evidence(F.col("c"), F.col("b"), F.col("k"), F.col("a"), F.col("p"), F.lit(1), F.lit(4))).first()[0] == 190


def test_tables(spark):
    row = spark.createDataFrame([([["a|b", "c"], ["", None], ["1"]],), ([],)], "r array<array<string>>")
    assert [r[0] for r in row.select(tables.markdown(F.col("r"))).collect()] == ["| a\\|b | c |\n| --- | --- |\n| 1 |  |", ""]
    rows = [("f", 1, 1, 2, "T", [["h"], ["x"]]), ("f", 2, 2, 3, None, [["h"], ["y"]]), ("f", 3, 3, 2, None, [["h"], ["z"]])]
    df = spark.createDataFrame(rows, "file string, n int, page int, n_columns int, caption string, rows array<array<string>>")
    assert [r.rows for r in tables.continue_tables(df, "file", "n").collect()] == [[["h"], ["x"], ["y"], ["z"]]]
    assert [r.n_parts for r in tables.continue_tables(df, "file", "n", chains=False).orderBy("n").collect()] == [2, 1]


def test_glossary_places(spark):
    """A term that shares a character with one before it is found, but no longer there to be replaced."""
    terms = spark.createDataFrame([("the", "DIE", 0), ("entre", "ZWISCHEN", 1)], "source_term string, target_term string, ord int")
    df = spark.createDataFrame([(1, "Thentre http://the.org/the the"), (2, None)], "k int, t string")
    got = {r.k: (r.t, r.hits, r.found) for r in glossary.apply_glossary(df, "t", terms).collect()}
    assert got == {1: ("ThZWISCHEN http://the.org/the DIE", 2, 3), 2: (None, 0, 0)}


def test_glossary():
    terms = [("air force", "LUFT"), ("air", "A\\1")]
    assert glossary.replace_terms("Air Force air http://air.com/air", terms, True, True) == ("LUFT A\\1 http://air.com/air", 2)


def test_translation_of_missing_rows(spark):
    calls = spark.sparkContext.accumulator(0)

    def client(texts):
        calls.add(len(texts))
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "s", "a"), (2, "s", "b"), (3, "s", "")], "k int, sig string, text string")
    cache = spark.createDataFrame([(1, "s", "A!"), (2, "old", "B!")], "k int, sig string, translated string")
    out = {r.k: (r.status, r.translated) for r in translate.translate_missing(df, cache, ["k", "sig"], "text", client).collect()}
    assert out == {1: ("success", "A!"), 2: ("success", "B"), 3: ("empty_input", None)} and calls.value == 1


def test_failing_clients_give_rows(spark):
    def client(texts):
        raise TimeoutError("timed out")

    r = translate.translate_column(spark.createDataFrame([("x",)], "t string"), "t", client).first().result
    assert (r.status, r.error_category, r.retry_count) == ("llm_error", "timeout", 3)


def test_chunks_join_to_the_text():
    rnd = random.Random(3)
    for _ in range(50):
        t = "".join(rnd.choice(["word ", "\n\n", "\n \n", "x" * 30]) for _ in range(rnd.randint(0, 60)))
        parts = translate.chunks(t, 100)
        assert "".join(parts) == t and all(len(p) <= 100 or "\n\n" not in p.strip() for p in parts)


def test_archives(spark, tmp_path):
    def put(name, entries):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in entries.items():
                z.writestr(k, v)

    put("ok.zip", {"a.md": "# x", "x_content_list.json": json.dumps([{"type": "table", "page_idx": 4}]), "images/1.jpg": b"1"})
    put("bad.zip", {"a.json": "{"})
    put("none.zip", {"a.txt": "x"})
    (tmp_path / "broken.zip").write_bytes(b"PK nonsense")
    found = files.discover(spark, str(tmp_path), "*.zip", content=True).select("path", "content")
    found = found.union(spark.createDataFrame([("x/empty.zip", bytearray())], "path string, content binary"))  # Spark lists no empty files
    out = {r.path.rsplit("/", 1)[1]: r for r in archive.read_archives(found).collect()}
    assert {k: r.status for k, r in out.items()} == {"ok.zip": "valid", "bad.zip": "invalid_json", "none.zip": "incomplete", "broken.zip": "invalid_zip", "empty.zip": "empty"}
    assert out["ok.zip"].markdown == "# x" and out["ok.zip"].images == ["images/1.jpg"]
    flags = archive.content_flags(F.col("content"))
    assert spark.createDataFrame([(out["ok.zip"].content,)], "content string").select(*(c.alias(k) for k, c in flags.items())).first()[:] == (5, True, False)


def test_versions_are_written_when_rows_change(spark, tmp_path):
    path = str(tmp_path / "state")
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sinks.save_if_changed(df, path, ["k"]) and not sinks.save_if_changed(df.repartition(3), path, ["k"])
    assert sinks.save_if_changed(df.where("k = 1"), path, ["k"]) and sinks.read_latest(spark, path).count() == 1


def test_renderers(spark):
    out = sinks.rendered(spark.createDataFrame([("ok",), ("no",)], "html string"), lambda t: t.encode() if t == "ok" else 1 / 0).collect()
    assert bytes(out[0].file) == b"ok" and out[1].file is None and "ZeroDivision" in out[1].error


def test_selection():
    assert files.selected("1,3-5,99", 6) == [1, 3, 4, 5] and files.selected("a", 2) == [1, 2]
    with pytest.raises(ValueError, match="selection"):
        files.selected("x", 3)


def test_progress(spark):
    every = [("s", "f1", s, "completed") for s in progress.STAGES] + [("s", "f4", s, "completed") for s in progress.STAGES]
    rows = [*every, ("s", "f2", "extraction", "completed"), ("s", "f2", "translation", "pending"), ("s", "f3", "extraction", "failed"), ("s", "f6", "extraction", "in_progress")]
    files = [("s", "f1", 0, None), ("s", "f2", 1, None), ("s", "f3", 0, "e"), ("s", "f4", 2, None), ("s", "f5", 0, None), ("s", "f6", 0, None)]
    by = progress.file_rollup(spark.createDataFrame(files, "session string, file string, n_issues int, error string"), spark.createDataFrame(rows, "session string, file string, stage string, status string"), ["session", "file"])
    assert {r.file: r.state for r in by.collect()} == {"f1": "completed_no_issues", "f2": "partial_with_issues", "f3": "failed", "f4": "completed_with_issues", "f5": "pending", "f6": "partial_no_issues"}
    r = progress.session_rollup(by, "session").first()
    assert (r.n_files, r.n_incomplete, r.n_failed, r.done) == (6, 3, 1, False) and r.percent == 33.3333


def test_documents_are_rendered(spark):
    rows = [("f", 2, "B & C", None, "p1\n\np2", True), ("f", 1, "A", "me", "x", False)]
    df = spark.createDataFrame(rows, "file string, n int, title string, authors string, content string, not_in_toc boolean").withColumn("name", F.lit("J"))
    html = render.documents(df, "file", "n", "name").first().html
    assert html.index('id="article-1"') < html.index('id="article-2" data-not-in-toc="true"') and "<h2>B &amp; C</h2>" in html and "<p>p1</p><p>p2</p>" in html


def test_error_groups(spark):
    df = spark.createDataFrame([("e 1",), ("e 22",), ("f",)], "m string")
    assert [(r.key, r.n) for r in metrics.error_groups(df, "m").collect()] == [("e {n}", 2), ("f", 1)]


def test_concurrency_keeps_state_over_batches(spark):
    """Against a loop, with batches much smaller than a user's calls; no user's calls are one frame."""
    import random

    from quire.operators import retries

    rnd = random.Random(3)
    users = [1] * 900 + [2] * 60 + [None] * 120 + [3]
    rows = [(u, n, 429 if rnd.random() < 0.02 else 500 if rnd.random() < 0.03 else 200, n * 1.5) for n, u in enumerate(users)]
    from test_checks import limits

    want = set()
    for user in {u for u, *_ in rows}:
        mine = [(n, status, at) for u, n, status, at in rows if u == user]
        want |= {(user, n, limit) for (n, _, _), limit in zip(mine, limits([x[1:] for x in mine]), strict=True)}
    rnd.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = retries.concurrency(spark.createDataFrame(rows, "u long, n long, status int, seconds double").repartition(5), "u", "n")
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) and set(got) == want
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()


def test_answers_are_checked_and_asked_for_again(spark):
    def client(texts):
        return [{"same": "same", "half a text": "half a", "over": '{"error": {"code": 1}}', "cut": "a [TRUNCATED]", "blank": " ", "label": '译文：“L”', "quoted": ' Translation: "Q" ', "was the": "saw"}.get(t, f"<{t}>") for t in texts]

    def insist(texts):
        return ["other" if t == "same" else client([t])[0] for t in texts]

    texts = ["same", "half a text", "over", "cut", "blank", "label", "quoted", "fine", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    got = [tuple(r.result) for r in translate.translate_column(df, "t", client).orderBy("n").collect()]
    refused = lambda why: ("validation_failed", None, "validation", why, 3)
    assert got == [refused("identical"), refused("prefix"), refused("error"), refused("incomplete"), refused("empty"),
                   ("success", "“L”", None, None, 0), ("success", "Q", None, None, 0), ("success", "<fine>", None, None, 0),
                   ("empty_input", None, "validation", "empty input", 0), ("empty_input", None, "validation", "empty input", 0)]
    first = translate.translate_column(df, "t", client, insist=insist, terms=[("fine", "was the")]).orderBy("n").collect()
    assert tuple(first[0].result) == ("success", "other", None, None, 1) and first[7].result.translated_text == "saw"
    gives_back = translate.translate_column(df.where("n = 0"), "t", lambda ts: [f'"{t}"' for t in ts]).first().result
    assert (gives_back.status, gives_back.error_category, gives_back.retry_count) == ("identical_to_source", "identical", 3)


def test_answers_are_judged_as_columns_judge_them(spark):
    rnd, parts = random.Random(2), ["译文：", "Translation: ", '"', "「", "」", "《", "》", "word", " ", "[Truncated]", '{"error": {', "404  Not Found", "\n"]
    pairs = [("".join(rnd.choices(parts, k=rnd.randint(0, 3))), "".join(rnd.choices(parts, k=rnd.randint(0, 4)))) for _ in range(300)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "n int, o string, t string")
    from quire.functions.text import clean_translation, translation_problem

    for r in df.select("*", translation_problem(F.col("o"), F.col("t")).alias("p"), clean_translation(F.col("t")).alias("c")).collect():
        assert translate.answer_problem(r.o, r.t) == r.p and translate.cleaned(r.t) == r.c, r


def test_long_texts_go_in_parts(spark):
    def client(texts):
        if "bad" in texts[0]:
            raise ConnectionError("network")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("one two\n\nbad three\n\nfour five",)], "t string")
    r = translate.translate_column(df, "t", client, limit=12).first().result
    assert (r.status, r.translated_text) == ("success", "ONE TWO\n\nbad three\n\n\n\nFOUR FIVE")  # a part that failed keeps its end


def test_titles_of_stop_words_meet(spark):
    rows = [("f", 1, "The"), ("f", 2, "the."), ("f", 3, "To be"), ("f", 4, "The tank"), ("f", 5, "!!"), ("f", 6, "??"), ("g", 7, "the")]
    df = spark.createDataFrame(rows, "file string, n int, title string")
    found = {(r.first, r.second): r.score for r in dedup.similar_titles(df, "file", "n", "title").collect()}
    assert found == {(1, 2): 1.0}
