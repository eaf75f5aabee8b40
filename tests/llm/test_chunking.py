import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import chunking as c


def words(rng, topic, n):
    return " ".join(f"{topic}{rng.randrange(12)}" for _ in range(n))


@pytest.mark.parametrize("text", ["a" * 5000, "palabra " * 700, "Una frase corta. " * 300, "我没有胃口。" * 400, "ฉันนอนไม่หลับ" * 200, "é" * 1201, "x y" * 2000])
def test_pieces_cover_the_text_within_the_limit(text):
    t = c.collapse(text)
    got = c.cut(t, 1200, 100)
    assert got[0][0] == 0 and got[-1][1] == len(t) and all(b - a <= 1200 for a, b in got)
    for (_, end), (start, _) in zip(got, got[1:]):
        assert start < end and 0 < end - start <= 131


def test_cuts_at_sentence_ends_where_there_are_any():
    t = c.collapse("Hoy fui al parque con mi tía y volví tarde a casa. " * 60)
    assert all(t[:b].rstrip().endswith(".") for _, b in c.cut(t, 1200, 100))


def test_deepest_valley_is_the_topic_boundary():
    """Two topics of many sentences; of the gaps in the window the one between the topics is cut."""
    rng = random.Random(0)
    one = ". ".join(words(rng, "rio", 8) for _ in range(18)) + ". "
    two = ". ".join(words(rng, "sol", 8) for _ in range(30)) + "."
    assert 600 < len(one) < 1200
    assert abs(c.cut(c.collapse(one + two), 1200, 100)[0][1] - len(one)) <= 1


def test_short_and_empty():
    assert c.cut("", 1200, 100) == [] and c.cut("hola", 1200, 100) == [(0, 4)]
    assert c.collapse(" a\xa0\t\n b ") == "a b"


def test_operator(spark):
    long = "Una frase corta y clara. " * 100
    df = spark.createDataFrame([(1, long), (1, long), (2, "x" + " " * 3000 + "y"), (3, None), (4, "y" * 1200), (5, "y" * 1201)], "row_id long, text string").withColumns({"ident": F.lit(9), "piece": F.lit("z")})
    got = c.split_oversized(df)
    assert {r["row_id"] for r in got.collect()} == {1, 5}
    assert got.count() == got.distinct().count() and got.where("char_length(text) > 1200").count() == 0
    assert c.split_oversized(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        c.split_oversized(df, limit=100, overlap=90)
