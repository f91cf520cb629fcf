"""Scalar text functions on the expected values of small fixtures."""

import pytest
from pyspark.sql import functions as F

from convlens.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "score"), [("This is great and wonderful", 1.0), ("This is terrible and broken", -1.0), ("The sky is blue", 0.0)])
def test_sentiment(spark, text, score):
    assert one(spark, T.sentiment_by_count(F.col("t")), t=text) == score
    assert one(spark, T.sentiment_by_presence(F.col("t")), t=text) == score


@pytest.mark.parametrize(
    ("text", "category"), [("I found a bug in the system", "Bug Report"), ("Can you help me?", "Support"), ("I love this product", "Feedback"), ("Nothing here", "General")]
)
def test_category(spark, text, category):
    assert one(spark, T.category_scored(F.col("t")), t=text) == category
    assert one(spark, T.category_cascade(F.col("t")), t=text) == category


def test_category_tie_goes_to_first(spark):
    assert one(spark, T.category_scored(F.col("t"), {"A": ("x",), "B": ("y",)}), t="x y") == "A"


def test_whitespace(spark):
    assert one(spark, T.normalize_whitespace(F.col("t"), True), t="  Hello    world  \n\n  How   are   you?  ") == "Hello world\nHow are you?"
    assert one(spark, T.normalize_whitespace(F.col("t")), t=" a \n b ") == "a b"


def test_unicode(spark):
    assert one(spark, T.normalize_unicode("NFC")(F.col("t")), t="café") == "café"


def test_encoding_keeps_healthy_text(spark):
    assert one(spark, T.fix_encoding(F.col("t")), t="naïve café 你") == "naïve café 你"
    assert one(spark, T.fix_encoding(F.col("t")), t="cafÃ©") == "café"


def test_clean_unescapes_once(spark):
    assert one(spark, T.clean_text(F.col("t")), t="<p>a &amp;lt; b</p>") == "a &lt; b"


def test_redaction(spark):
    text, counts = T.redact(F.col("t"))
    assert one(spark, text, t="mail a.b@c.org or 555-123-4567") == "mail [EMAIL] or [PHONE]"
    assert one(spark, counts["phone"], t="555-123-4567 and 555.123.4568") == 2


def test_names(spark):
    assert one(spark, T.names_after(F.col("t")), t="Hi, my name is Ada Lovelace and so on") == ["Ada Lovelace"]


@pytest.mark.parametrize(
    ("answer", "low", "high", "value"),
    [("3", 1, 5, 3), ("The score is 4", 1, 5, 4), ("10", 1, 5, 5), ("0", 1, 5, 1), ("invalid", 1, 5, 3), ("-1", 0, 1, 0), ("2", 0, 1, 1), ("5", 10, 20, 10), ("25", 10, 20, 20), ("no number", 10, 20, 15)],
)
def test_facet_numbers(spark, answer, low, high, value):
    assert one(spark, T.facet_number(F.col("t"), low, high), t=answer) == value


def test_parsers(spark):
    assert one(spark, T.facet_text(F.col("t"), "Category: "), t="Category:  Billing  ") == "Billing"
    got = one(spark, T.name_and_description(F.col("t")), t="Name: A\nDescription: B c")
    assert (got["name"], got["description"]) == ("A", "B c")
    assert one(spark, T.name_and_description(F.col("t")), t="Name: A") is None
    assert one(spark, T.assignments(F.col("t"), 3, 2), t="1 -> A\n2 -> B\n3 -> A") == [0, 1, 0]
    assert one(spark, T.assignments(F.col("t"), 3, 2), t="nothing") == [0, 0, 0]


@pytest.mark.parametrize(("text", "code"), [("Привет, как дела сегодня", "ru"), ("你好你好你好你好你好你好", "zh"), ("plain English text", "en"), ("short", "en")])
def test_script_language(spark, text, code):
    assert one(spark, T.script_language(F.col("t"))[0], t=text) == code


def test_retry_delay_is_capped(spark):
    assert one(spark, T.retry_delay(F.lit(10), 0.5, 2.0, 30.0), t="") == 30.0


def test_normalisation_takes_few_texts_at_once(spark):
    """Texts stay in Arrow but for a few, so memory is not that of a batch as Python's strings."""
    import pyarrow as pa

    from convlens.functions import text as T

    seen = []

    class Texts:
        def __init__(self, x):
            self.x = x

        def __len__(self):
            return len(self.x)

        def slice(self, k, n):
            seen.append(len(self.x.slice(k, n)))
            return self.x.slice(k, n)

    given = ["é", None, ""] * 67
    assert T.normalize_unicode("NFC").func(Texts(pa.array(given))).to_pylist() == ["é", None, ""] * 67
    assert max(seen) == 64 and sum(seen) == 201
    assert T.normalize_unicode("NFC").func(pa.array([], pa.string())).to_pylist() == []
