from pyspark.sql import functions as F

from sieveworks.functions import text


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names))).first()[0]


def test_stop_word_lists():
    lists = text.stop_word_lists()
    assert len(lists) == 30 and all(lists.values())
    assert {k: len(lists[k]) for k in ("en", "de", "fr", "yi")} == {"en": 69, "de": 105, "fr": 100, "yi": 62}
    assert text.stop_words("zh") == text.stop_words("xx") == text.stop_words("EN") == ()


def test_terms(spark):
    assert one(spark, text.extract_terms, "what is ferry performance") == ["ferry", "performance"]
    assert one(spark, text.extract_terms, "  Der  Hund a 猫 hello, hello, ") == ["der", "hund", "猫", "hello,", "hello,"]
    assert one(spark, lambda c: text.extract_terms(c, "de"), "der Hund") == ["hund"]
    assert one(spark, lambda c: text.extract_terms(c, "en", ("Hund",)), "der Hund") == ["der"]
    assert one(spark, text.extract_terms, None) == []
    assert one(spark, lambda q, lang: text.extract_terms(q, lang), "der the hund", "de") == ["the", "hund"]


def test_valid_terms(spark):
    for term, valid in (("a", False), ("ab", True), ("猫", True), ("12", False), ("12a", True), ("the", False), ("The", False), ("the cat", True)):
        assert one(spark, text.is_valid_term, term) is valid, term
    assert one(spark, lambda c: text.is_valid_term(c, "es"), "por qué") is False


def test_queries(spark):
    for query, expected in (
        ('  "Hello World" ', (["hello", "world"], True, True)), ('"', ([], False, False)), ('""', (['""'], False, False)), ("hello", (["hello"], False, False)),
        ('"hello" there', (['"hello"', "there"], True, False)), ("", ([], False, False)), ("the of", ([], False, False)),
    ):
        assert tuple(one(spark, text.extract_query, query)) == expected, query
        assert text.query_terms(query) == expected[0]
