import random

import pytest

WORDS = {"en": "the of and to in that it is was for on with as his they at be this from or".split(),
         "de": "der die und zu den das nicht von sie ist des sich mit dem dass er es ein ich auf".split(),
         "fr": "le de un et etre avoir que pour dans ce il qui ne sur se pas plus par je avec".split()}


def sentence(lang, n, rng):
    """n words made of common ones and of made-up compounds of them."""
    base = WORDS[lang]
    return " ".join(rng.choice(base) if rng.random() < 0.5 else rng.choice(base) + rng.choice(base) + rng.choice(base)
                    for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: names that results use too
CLASH = "score string, rejected int, component_id string, size int, target string, live int, hash string, item_id int, row int"


def rows_of(texts, lang="en", source="s0", first=1):
    return [(first + k, t, lang, source, None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, rng):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties."""
    long = sentence("en", 60_000, rng)
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", "de", "b", 4), (4, "12 34", "fr", "b", 5),
            (5, "x", "en", None, 1), (6, sentence("de", 40, rng), None, None, 9), (None, sentence("fr", 30, rng), "fr", "c", 9),
            (None, None, None, None, None), (7, long, "en", "c", len(long)), (8, "𝔘nicode ſ end", "en", "a", 14)]
    same = (9, sentence("en", 25, rng), "en", "a", 9)
    rows += [same, same, same, (10, same[1], "en", "b", 9), (None, same[1], "en", "b", 9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clash(odd):
    """The same with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = [x.strip().split() for x in CLASH.split(",")]
    return odd.select("*", *[F.lit("7").cast(kind).alias(name) for name, kind in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
