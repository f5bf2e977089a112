import random

import pytest

#: Columns whose names the operators use themselves.
CLASHING = {"node": 1, "key": "k", "keep": False, "sig": "s", "n": 5, "copy": 2, "h": "x", "tokens": 9, "w": 1.5, "range": "r", "id": 7, "digest": "d", "window": 3, "group_id": 4, "copies": 6, "budget": 1.0}
SYLLABLES = "an be cor den est fal gor hin ist jo kal lem mon nar op per qui ras sol tin ur ven wol yar zim".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, words):
    return " ".join(word(rng) + ("," if rng.random() < 0.1 else "." if rng.random() < 0.1 else "") for _ in range(words))


def table(spark, rows, clash=True):
    """documents from (doc_id, text, lang, source), with clashing columns beside."""
    extra = ", ".join(f"`{c}` {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for c, v in CLASHING.items()) if clash else ""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + (", " + extra if extra else "")
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), *(CLASHING.values() if clash else ())) for i, t, g, s in rows], schema)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, clashing columns."""
    rng = random.Random(5)
    long = prose(rng, 60_000)
    base = prose(rng, 200)
    rows = [(1, base, "en", "src1"), (2, base, "en", "src1"), (2, base, "en", "src1"), (3, base + " end", None, "src2"), (None, base, "en", None), (4, None, "de", "src3"), (5, "", "de", "src3"), (6, " \n\t ", None, None), (7, "!!! ... ---", "en", "src1")]
    rows += [(8, long, "fr", "src4"), (9, long + " tail", "fr", "src4"), (10, "x", "en", "src1"), (None, None, None, None), (7, prose(rng, 50), "en", "src1"), (11, "a\x00b ퟿ é ß", "en", "src9")]
    rows += [(100 + i, prose(rng, rng.randint(20, 400)), rng.choice(["en", "fr", "de", "es"]), f"src{rng.randint(0, 19)}") for i in range(40)]
    return table(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(100 + i, i % 3 != 0 and 1 or 0, 0) for i in range(30)] + [(1, None, None), (None, 1, 0), (999, 1, 0), (100, 1, 0), (100, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
