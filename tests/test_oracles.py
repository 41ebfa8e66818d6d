"""Each query with SQL gives DuckDB's rows on the small tables; the entry point runs."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].round(6) if frame[c].dtype.kind == "f" else frame[c].map(lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    return frame.astype(str).replace({"None": "~", "nan": "~", "<NA>": "~", "NaT": "~"}).sort_values(sorted(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, name):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
        want = rows(con.execute(__spark_entry__.oracle_sql()[name]).df())
    got = rows(__spark_entry__.queries()[name](spark, D).toPandas())
    pd.testing.assert_frame_equal(got, want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["hybrid_similarity", "article_dedup", "fragment_merge"])
def test_queries_without_sql(spark, name):
    assert __spark_entry__.queries()[name](spark, D).count() > 0


@pytest.mark.parametrize("whole", [False, True])
def test_similar_titles(spark, whole):
    """The classes of each source's titles, or of all titles as one file, against the scores of all pairs."""
    from pyspark.sql import functions as F

    from quire.functions.similarity import SIMILAR, score_text
    from quire.operators.dedup import title_classes
    from quire.plans.documents import titled

    first = {}
    for r in sorted(spark.read.parquet(f"{D}/documents.parquet").collect(), key=lambda r: r.doc_id):
        title = (r.text or "").split("\n")[0].strip()
        if title and (len(title) < 60 or not whole):
            first.setdefault(("all" if whole else r.source, title), r.doc_id)
    want = {}
    for source in {s for s, _ in first}:
        titles = sorted((at, t) for (s, t), at in first.items() if s == source)
        near = {(p, q) for i, (p, t) in enumerate(titles) for q, u in titles[i + 1 :] if score_text(t, u) >= SIMILAR}
        opened = []
        for at, _ in titles:
            root = next((o for o in opened if (o, at) in near), at)
            if root == at:
                opened.append(at)
            want[source, at] = root, sum(at in pair for pair in near)
    if whole:
        found = title_classes(titled(spark, D).where("length(trim(title)) < 60").withColumn("file", F.lit("all")), "file", "doc_id", "title").withColumnRenamed("at", "doc_id")
        assert len(want) > 20
    else:
        found = __spark_entry__.queries()["similar_titles"](spark, D)
    assert {(r.file, r.doc_id): (r.root, r.n_similar) for r in found.collect()} == want


def test_titles_of_one_key(spark):
    """Titles that differ in case and punctuation are scored as one: the same classes and links as by all pairs, from few scores."""
    import random

    from quire.functions.similarity import SIMILAR, score_text
    from quire.operators.dedup import similar_titles, title_classes

    rnd = random.Random(8)
    words = "panzer tanks desert story armour night battle river".split()
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 7))) for _ in range(25)]
    base += [b + "s" for b in base[:12]] + [" ".join(b.split()[1:] + b.split()[:1]) for b in base[:12]] + ["of the", "the of", "!!", "??"]
    texts = sorted({rnd.choice([b, b.upper(), b + "!", b.replace(" ", ", ", 1), b.title() + "?"]) for b in base * 4})
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    near = {(p, q) for i, (p, t) in enumerate(rows) for q, u in rows[i + 1 :] if score_text(u, t) >= SIMILAR}
    want, opened = {}, []
    for at, _ in rows:
        root = next((o for o in opened if (o, at) in near), at)
        opened += [at] * (root == at)
        want[at] = root, sum(at in pair for pair in near)
    df = spark.createDataFrame([("f", at, t) for at, t in rows], "file string, n long, title string")
    assert {r["at"]: (r.root, r.n_similar) for r in title_classes(df, "file", "n", "title").collect()} == want
    from quire.functions.text import title_key
    from pyspark.sql import functions as F

    keys = df.where(title_key(F.col("title")) != "").groupBy("file", title_key(F.col("title")).alias("k")).agg(F.min("n").alias("n"))
    assert similar_titles(keys, "file", "n", "k").count() < len(near) / 3


def both(spark, name, folder, **tables):
    """A query's rows and its SQL's over tables of the given columns."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    with duckdb.connect() as con:
        for t, columns in tables.items():
            pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        want = rows(con.execute(__spark_entry__.oracle_sql()[name]).df())
    return rows(__spark_entry__.queries()[name](spark, str(folder)).toPandas()), want


def test_odd_articles(spark, tmp_path):
    """Empty and blank texts, capitals that lower to several characters, and lines that only Java takes for numbers."""
    texts = [None, "", " ", "\n\n", "İSTANBUL\nx", "ÍNDİCE\nx", "ΑΣ\nx", "a\n1\x0b\n2\x0b", "a\n1\x85\n2 ", "a\n1\r\n 2 ", "a\n3", "a\nb\nc\nd\ne"]
    got, want = both(spark, "non_article_filter", tmp_path, documents={"doc_id": range(len(texts)), "text": texts, "source": ["s"] * len(texts)})
    pd.testing.assert_frame_equal(got, want)
    assert len(want) == 8


def test_odd_pages(spark, tmp_path):
    """Anchors with white space of all kinds at their ends, and tags that Java's patterns end elsewhere."""
    text = "ab{}cd ef{}gh{} ab cd ef gh and more words"
    some = [text.format(*x) for x in (("\n", "\n", "\n"), ("\t", " ", "\t"), (" ", "　", " "), ("\x0b", "\x85", "\n"))]
    pages = [f"<p>{a}{t}{b}</p><p>{t.replace(t[10], ' ')}</p>" for t in some for a, b in (("", ""), (" ", "　 "), ("\n", "\t"), (" ", "\x0b"))]
    pages += ["<p>short</p><p>cd ef gh</p><p>\nabcd efgh\nij kl</p>", "<p\x0bid=1>abcdef ghijkl</p>", "<scripté>abcdef ghijkl</script><p>cdef ghij ab</p>", "<ſcript>abcdef ghijkl</ſcript><p>x</p></div>"]
    pages += ["<style>x</style\x0b>abcdef ghijkl</style><p>cdef</p>", "ab<Ka>abcdef ghijkl", "", None]
    got, want = both(spark, "place_by_anchor", tmp_path, pages={"page_id": range(5 * len(pages)), "html": [p for p in pages for _ in range(5)]})
    pd.testing.assert_frame_equal(got, want)
