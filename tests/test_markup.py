"""Pages as nodes, and edits of their texts, against a plain scanner."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import markup, text
from quire.operators import placing


def scan(page: str) -> list[str]:
    """The nodes of a page, a character at a time."""
    out, i, low = [], 0, page.lower()
    while i < len(page):
        end = i + 1
        if page[i] != "<":
            while end < len(page) and page[end] != "<":
                end += 1
        elif page.startswith("<!--", i):
            at = page.find("-->", i + 4)
            end = len(page) if at < 0 else at + 3
        elif any(low.startswith(f"<{t}", i) and not (low[i + len(t) + 1 : i + len(t) + 2] or "x").isalnum() and ">" in page[i:] for t in ("script", "style")):
            tag = "script" if low.startswith("<script", i) else "style"
            at = low.find(f"</{tag}>", page.index(">", i))
            end = len(page) if at < 0 else at + len(tag) + 3
        elif low[i + 1 : i + 2].isalpha() or low[i + 1 : i + 2] in ("/", "!", "?") and i + 1 < len(page):
            quote, k = "", i + 1
            named = low[i + 1 : i + 2].isalpha() or low[i + 1 : i + 2] == "/" and low[i + 2 : i + 3].isalpha()
            while k < len(page):
                c = page[k]
                if quote:
                    quote = "" if c == quote else quote
                elif named and c in "\"'":
                    quote = c
                elif c in "<>":
                    break
                k += 1
            if k >= len(page) or page[k] == "<":  # quotes may be out of order
                k = min((x for x in (page.find("<", i + 1), page.find(">", i + 1)) if x > 0), default=len(page))
            if k < len(page) and page[k] == ">":
                end = k + 1
        out.append(page[i:end])
        i = end
    return out


PIECES = ["<p>", "</p>", "<div class=\"a>b\">", "</div>", "<br/>", "<!-- the -->", "<script>the < 3</script>", "<style>p{}</style>", "the ", "Anchor words", " a<b ", "<", ">", "é😀", "<a title='the'>", "</a>", "\n", "<P>", "<pre>"]


def pages(n=150):
    rnd = random.Random(5)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)] + ["<script>the", "<!-- open", '<a title="x', "<a b='c\" d='>x", "<p" * 50, ""]


def test_nodes(spark):
    given = [(i, p) for i, p in enumerate(pages())] + [(-1, None)]
    df = spark.createDataFrame(given, "k int, html string")
    got = {r.k: r for r in df.select("k", markup.nodes(F.col("html")).alias("n"), markup.map_text(F.col("html"), lambda x: text.mask_words(x, ["THE"])).alias("m")).collect()}
    assert got[-1].n is None and got[-1].m is None
    for k, p in given[:-1]:
        want = scan(p)
        assert "".join(got[k].n) == p and got[k].n == want, p
        assert got[k].m == "".join(x if x.startswith("<") and x != "<" else x.replace("the", "***") for x in want)


def test_rows_of_nodes(spark):
    df = spark.createDataFrame([(1, "<div><p>a<br>b</p><!--x--></div>c"), (2, ""), (3, None)], "k int, html string")
    rows = markup.node_rows(df, ["k"], "html")
    assert [(r.begin, r.kind, r.tag, r.depth) for r in rows.orderBy("k", "n").collect()] == [
        (1, "open", "div", 0), (6, "open", "p", 1), (9, "text", None, 2), (10, "void", "br", 2), (14, "text", None, 2),
        (15, "close", "p", 2), (19, "other", None, 1), (27, "close", "div", 1), (33, "text", None, 0)]
    assert [tuple(r) for r in markup.joined(rows, ["k"]).collect()] == [(1, "<div><p>a<br>b</p><!--x--></div>c")]


def plain(page, fig, anchor, before):
    parts, anchor = scan(page), (anchor or "").strip().lower()
    hit = next((i for i, x in enumerate(parts) if anchor in x.lower() and (x == "<" or x[0] != "<")), None) if len(anchor) >= 5 else None
    if hit is None:
        at = parts.index("</div>") if "</div>" in parts else None
        return "".join(parts) + "\n" + fig if at is None else "".join([*parts[:at], "\n", fig, "\n", *parts[at:]])
    opened = max((i for i in range(hit) if parts[i].lower().startswith(("<p>", "<p "))), default=-1)
    shut = max((i for i in range(hit) if parts[i].lower() == "</p>"), default=-1)
    end = next((i for i in range(hit, len(parts)) if parts[i].lower() == "</p>"), None)
    if opened > shut and end is not None:
        at = opened if before else end + 1
    else:
        at = hit if before else hit + 1
    return "".join([*parts[:at], "\n", fig, "\n", *parts[at:]])


@pytest.mark.parametrize("before", [False, True])
def test_figures_by_anchor(spark, before):
    given = [(p, a) for p in pages(80) for a in (" anchor ", "the", "nowhere", None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(given)], "k int, html string, anchor string")
    got = {r[0]: r[1] for r in df.select("k", placing.by_anchor(F.col("html"), F.lit("<i/>"), F.col("anchor"), before)).collect()}
    for i, (p, a) in enumerate(given):
        assert got[i] == plain(p, "<i/>", a, before), (p, a)


def test_figures_one_after_the_other(spark):
    rnd, given = random.Random(7), []
    for i, p in enumerate(pages(60)):
        some = [(rnd.choice(["a", "b", "c", "", None]), rnd.choice(["Anchor", "words", "figure 1", None]), rnd.choice(["before", "after", None])) for _ in range(rnd.randint(0, 4))]
        given.append((i, p, some))
    given.append((-1, "x", None))
    df = spark.createDataFrame(given, "k int, html string, images array<struct<path:string, anchor:string, insert_position:string>>")
    figure = lambda x, n: F.concat(F.lit("<img "), x["path"], F.lit(">figure "), n)
    got = {r[0]: r[1] for r in df.select("k", placing.by_anchors(F.col("html"), F.col("images"), figure)).collect()}
    for k, page, images in given:
        seen = []
        for path, anchor, where in images or []:
            if path and path not in seen:
                seen.append(path)
                page = plain(page, f"<img {path}>figure {len(seen)}", anchor, where == "before")
        assert got[k] == page


def test_anchor_in_upper_case(spark):
    """Characters whose upper case is several, and those whose lower case hangs on what stands around, are found too."""
    given = [(1, "<p>Eine große Stra\u00dfe</p>", "gro\u00dfe Str"), (2, "<p>\u03b4\u03c1\u03cc\u03bc\u03bf\u03c3\u03b1 los</p>", "\u03b4\u03c1\u03cc\u03bc\u03bf\u03c3")]
    df = spark.createDataFrame(given, "k int, html string, anchor string").withColumn("anchor", text.upper_each(F.col("anchor")))
    got = {r[0]: r[1] for r in df.select("k", placing.by_anchor(F.col("html"), F.lit("<i/>"), F.col("anchor"))).collect()}
    assert got == {k: f"{page}\n<i/>\n" for k, page, _ in given}
