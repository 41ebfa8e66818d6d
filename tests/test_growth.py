"""What keeps the cost of some steps in proportion to their input: how rows are dealt, read and compared."""

import random

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeats_look_for_the_least_size(spark):
    """By blocks and by the least size alone, the same as by all parts of all sizes."""
    from quire.functions.checks import repeats

    rnd = random.Random(4)
    some = lambda n, letters="abc é": "".join(rnd.choice(letters) for _ in range(n))
    texts = [None, "", "x" * 100, "x" * 101, some(300, "ab")]
    for _ in range(150):
        part = some(rnd.choice([18, 19, 20, 21, 30, 50, 60]))
        gaps = [some(rnd.choice([0, 1, 7, 40])) for _ in range(rnd.choice([2, 3, 4]))]
        texts.append(some(rnd.choice([0, 5, 150, 179, 180, 185, 198, 199, 200, 201, 260])) + part.join(["", *gaps]) + some(rnd.choice([0, 30])))

    def plain(t):
        return len(t) > 100 and any(t.count(t[i : i + s]) >= 3 for s in (20, 30, 50) for i in range(min(200, len(t) - s)))

    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", "t", repeats(F.col("t")).alias("r")).collect()
    assert {r.n: r.r for r in rows if r.t is not None} == {n: plain(t) for n, t in enumerate(texts) if t is not None}
    assert len({r.r for r in rows if r.t}) == 2
    assert str(repeats(F.col("t"))).count("replace(") == 2  # one for blocks, one for parts


def test_settings_are_grouped_once(spark):
    from quire.functions.checks import setting_faults

    rows = [(1, "PDF_API_KEY", "k"), (1, "HTML_API_KEY", " "), (1, "OVERLAP_PAGES", "5"), (1, "PAGES_PER_BATCH", "5"), (2, "TRANSLATION_API_KEY", None), (2, "PDF_API_KEY", "your-api-key-here"), (2, "PDF_API_KEY", "k"), (2, "OVERLAP_PAGES", "1")]
    found = setting_faults(spark.createDataFrame(rows, "k int, name string, value string"), ["k"])
    assert sorted(found.where("name != 'PAGES_PER_BATCH'").select("k", "name").collect()) == [(1, "HTML_API_KEY"), (1, "OVERLAP_PAGES"), (1, "TRANSLATION_API_KEY"), (2, "HTML_API_KEY"), (2, "TRANSLATION_API_KEY")]
    assert plan(found).count("Exchange hashpartitioning") == 1


def test_translations_of_a_batch_go_by_slices(spark):
    from quire.operators import translate

    n = 2 * translate.SLICE + 7
    rows = spark.range(n, numPartitions=1).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("e"), "id")).alias("t"))
    got = translate.translate_column(rows, "t", translate.digit_client).select("id", "result.*").collect()
    assert [tuple(r) for r in got] == [(k, "success", f"3{k}", None, None, 0) if k % 3 else (k, "empty_input", None, "validation", "empty input", 0) for k in range(n)]
    assert translate.translate_column(rows.limit(0), "t", translate.digit_client).count() == 0


def test_references_without_key_stay_where_they_are(spark):
    """They were dealt to one task by their null."""
    from quire.operators.images import check_references

    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        refs = spark.range(800, numPartitions=8).select(F.col("id").alias("n"), F.when(F.col("id") % 10 == 0, F.col("id")).alias("img"), F.lit(1).alias("at"))
        found = check_references(refs, spark.range(20).select(F.col("id").alias("img"), F.lit(1).alias("page")), "img", "n", "page", "at")
        sizes = [r["count"] for r in found.where("verdict = 'format'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 720 and max(sizes) < 200


def test_documents_are_read_once(spark):
    from quire.plans.files import text_documents_back

    assert "quire_docx" not in plan(text_documents_back(spark, "/root/testdata/sf0.001"))


class Handle:
    """A state in memory that counts the ways to it."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def getValueState(self, *_):  # noqa: N802
        return Value(self)

    def getMapState(self, *_):  # noqa: N802
        return Map(self)

    def deleteTimer(self, _):  # noqa: N802
        self.calls += 1

    registerTimer = deleteTimer  # noqa: N815


class Value:
    def __init__(self, handle):
        self.h = handle

    def exists(self):
        self.h.calls += 1
        return self.h.value is not None

    def get(self):
        self.h.calls += 1
        return self.h.value

    def update(self, v):
        self.h.calls, self.h.value = self.h.calls + 1, v

    def clear(self):
        self.update(None)


class Map(Value):
    def containsKey(self, k):  # noqa: N802
        self.h.calls += 1
        return k in self.h.map

    def updateValue(self, k, v):  # noqa: N802
        self.h.calls += 1
        self.h.map[k] = v

    def iterator(self):
        self.h.calls += 1
        return iter(list(self.h.map.items()))

    def keys(self):
        self.h.calls += 1
        return iter(list(self.h.map))

    def clear(self):
        self.h.calls += 1
        self.h.map.clear()


def test_a_file_asks_its_state_once_a_batch():
    from datetime import timedelta

    import pandas as pd

    from quire.streaming.parts import Assembler

    handle, one = Handle(), Assembler(timedelta(hours=6))
    one.init(handle)
    at = lambda k: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=k)
    rows = lambda parts, start: pd.DataFrame([(1, p, 4, "done", f"p{p}", 10 * p, 1, at(start + k), start + k) for k, p in enumerate(parts)], columns="file part n_parts state path page_offset n_items ts seq".split())
    told = [*one.handleInputRows((1,), iter([rows([2, 0] * 200, 0)]), None)][0]
    assert told.empty and handle.calls < 12 and set(handle.map) == {(0,), (2,)}
    told = [*one.handleInputRows((1,), iter([rows([1, 1, 3, 2], 400)]), None)][0]
    assert told[["status", "n_parts", "paths"]].values.tolist() == [["whole", 4, ["p0", "p1", "p2", "p3"]]] and not handle.map
    told = [*one.handleInputRows((1,), iter([rows([1], 404), rows([0], 9000), rows([1], 19000)]), None)][0]
    assert told[["status", "paths"]].values.tolist() == [["expired", ["p0"]]] and set(handle.map) == {(1,)}


def test_pairs_of_titles_are_dealt_out(spark, tmp_path):
    """Nearly all titles are of one file: its pairs are scored by many tasks, with the scores of a plain version."""
    import __spark_entry__
    from quire.functions.similarity import score_text

    rnd = random.Random(6)
    title = lambda: " ".join(rnd.choice("tank tanks of the desert story night x".split()) for _ in range(rnd.randint(0, 9)))
    docs = [(i, f"{title()}\nmore", "a" if i % 20 else "b") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = __spark_entry__.queries()["hybrid_similarity"](spark, str(tmp_path))
    want, last = {}, {}
    for i, text, source in docs:
        t = text.split("\n")[0]
        if source in last:
            want[i] = score_text(t, last[source])
        last[source] = t
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert {r.doc_id for r in rows} == set(want)
    assert all(abs(r.score - want[r.doc_id]) < 1e-5 for r in rows)
    tasks = [r.task for r in rows]
    assert max(tasks.count(t) for t in set(tasks)) < len(rows) / 2


def test_distances_by_bits_and_runs_by_columns():
    from difflib import SequenceMatcher

    from quire.functions.similarity import edit_distance, matching_ratio

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rnd = random.Random(9)
    some = lambda n: "".join(rnd.choice("ab\u00e9") for _ in range(n))
    for _ in range(800):
        a, b = some(rnd.choice([0, 1, 5, 70])), some(rnd.choice([0, 1, 6, 63, 64, 65, 90]))
        assert edit_distance(a, b) == plain(a, b)
        assert matching_ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_a_bucket_of_files_asks_its_state_once_a_batch():
    """Hundreds of files, and a few calls for each micro-batch; by a timer all that are due are forgotten."""
    from datetime import timedelta
    from types import SimpleNamespace

    import pandas as pd

    from quire.streaming.parts import Assemblers

    handle, some = Handle(), Assemblers(timedelta(hours=6))
    some.init(handle)
    start = pd.Timestamp("2024-01-01")
    names = "file part n_parts state path page_offset n_items ts seq".split()
    rows = lambda parts, files, minute: pd.DataFrame([(f, p, 2, "done", f"{f}/{p}", 10 * p, 1, start + pd.Timedelta(minutes=minute + f % 7), f) for p in parts for f in files], columns=names)
    told = [*some.handleInputRows((3,), iter([rows([1], range(150), 0), rows([1], range(150, 300), 0)]), None)][0]
    assert told.empty and handle.calls < 8
    told = [*some.handleInputRows((3,), iter([rows([0], range(100), 10)]), None)][0]
    assert handle.calls < 16 and len(told) == 100 and set(told["status"]) == {"whole"} and told["paths"][7] == ["7/0", "7/1"]
    late = int((start + pd.Timedelta(hours=6, minutes=4)).timestamp() * 1000)
    first = handle.value[1]
    told = [*some.handleExpiredTimer((3,), SimpleNamespace(getCurrentWatermarkInMs=lambda: late), SimpleNamespace(getExpiryTimeInMs=lambda: first))][0]
    assert sorted(told["file"]) == [f for f in range(100, 300) if f % 7 < 4] and set(told["status"]) == {"expired"}
    assert handle.value[1] > late and handle.calls < 24
