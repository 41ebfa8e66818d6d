"""Column functions on small literals."""

import pytest
from pyspark.sql import functions as F

from quire.functions import jsonio, numeric, similarity, text
from quire.operators import articles


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [
        ("The Future of Armor", "Future of Armor", 0.857430),
        ("Drone Warfare: A New Era", "Drone Warfare - A New Era", 1.0),
        ("Naval Logistics in 2030", "Naval Logistics in 2031", 0.773261),
        ("Letters", "Letters to the Editor", 0.400000),
        ("From the Editor", "From the Director", 0.509926),
        ("Army Aviation Today", "Space Command Review", 0.063782),
        ("Space Command Review", "Army Aviation Today", 0.076603),
        ("", "x", 0.0),
    ],
)
def test_hybrid_similarity(spark, a, b, score):
    row = spark.createDataFrame([(a, b)], "a string, b string")
    assert row.select(similarity.hybrid(F.col("a"), F.col("b"))).first()[0] == pytest.approx(score, abs=1e-6)
    assert similarity.score_text(a, b) == pytest.approx(score, abs=1e-6)
    assert row.select(similarity.is_similar(F.col("a"), F.col("b"))).first()[0] == (score >= 0.82)


def test_page_ranges(spark):
    get = lambda n: [(r.start_page, r.end_page) for r in spark.range(1).select(F.inline(numeric.page_ranges(F.lit(n), 6, 2))).collect()]
    assert get(10) == [(1, 6), (5, 10), (9, 10)]
    assert get(12) == [(1, 6), (5, 10), (9, 12)]
    assert get(0) == []
    for n in range(1, 40):
        assert {p for a, z in get(n) for p in range(a, z + 1)} == set(range(1, n + 1))
    with pytest.raises(ValueError, match="overlap"):
        numeric.page_ranges(F.lit(3), 2, 2)


def test_backoff_and_percentile(spark):
    assert [r[0] for r in spark.range(7).select(numeric.backoff(F.col("id"))).collect()] == [2, 4, 8, 16, 32, 60, 60]
    assert spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "x double").select(F.percentile("x", F.lit(0.95))).first()[0] == pytest.approx(9.2)


def test_null_box_is_in_the_middle(spark):
    y = numeric.relative_position(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(10.0))
    assert spark.range(1).select(y, numeric.vertical(y), numeric.horizontal(y)).first()[:] == (0.5, "middle", "center")


def test_garbage_and_scrub(spark):
    assert one(spark, "\x01" * 9, text.is_garbage) is False
    assert one(spark, "\x01" * 10, text.is_garbage) is True
    assert one(spark, "a\x00b\tc\x85\x9f", text.scrub_controls) == "ab\tc\x85"


def test_ads(spark):
    assert one(spark, "The Long Road: Part 1", articles.ad_reason) == "AD:"
    assert one(spark, "The Long Road: Part 1", lambda c: articles.ad_reason(c, whole_words=True)) is None
    assert one(spark, "sponsored news", lambda c: articles.ad_reason(c, whole_words=True)) == "Sponsored"


def test_translation_checks(spark):
    row = spark.createDataFrame([("Hello world", "Hello")], "a string, b string")
    assert row.select(text.translation_problem(F.col("a"), F.col("b"))).first()[0] == "prefix"
    assert one(spark, "译文：「你好」", text.clean_translation) == "你好"
    assert one(spark, '"', text.clean_translation) == '"'
    assert one(spark, "see www.x.com", lambda c: text.translation_kind(c)["is_url_only"]) is True


def test_masks_and_names(spark):
    assert one(spark, "A b. A.B", lambda c: text.mask_words(c, ["a.b"])) == "A b. ***"
    assert one(spark, "x", lambda c: text.mask_words(c, [])) == "x"
    assert one(spark, "12-Army Review-2024", text.journal_name) == "Army Review"
    assert one(spark, "Request 12 failed  at 3 (x4)", text.error_key) == "Request {n} failed at {n}"
    assert len(one(spark, "y" * 60, text.ellipsis)) == 50


def test_json_of_answers():
    assert jsonio.parse('text [{"a": [1, 2]}, {"b": "]"}] more', "array") == '[{"a": [1, 2]}, {"b": "]"}]'
    assert jsonio.parse('```json\n{"a": 1}\n```', "array") == '[{"a": 1}]'
    assert jsonio.parse('[{"a": 1}]', "object") == '{"a": 1}'
    assert jsonio.parse('{"a": "\\q"}', "object") == '{"a": "\\\\q"}'
    assert jsonio.parse("nothing", "array") is None


def test_four_fields(spark):
    full = '```json\n{"title": "a", "subtitle": "", "authors": "", "content": "c"}\n```'
    assert one(spark, full, jsonio.four_fields).content == "c"
    assert one(spark, '{"title": "a"}', jsonio.four_fields) is None


def test_fuzzy_window():
    assert similarity.best_window("abcd", "xxabzdxx") == pytest.approx(0.75)
    assert similarity.best_window("", "x") == 0 and similarity.best_window("long", "s") == 0


def test_edit_distance():
    assert similarity.edit_distance("kitten", "sitting") == 3
    assert similarity.edit_distance("", "abc") == 3 and similarity.edit_distance("abc", "") == 3
