import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key long, n long, ids string, k1 int, k2 int, words string, part int, kind int, label string, _part int, url string, `a.b` string, tags map<string, int>"


def rows():
    """Texts with every edge: nulls, blanks, repeats, ties, other scripts, and one very long one."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = [prose(rng.randint(25, 120)) for _ in range(30)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, t) for i, t in enumerate(base[:6])]  # copies
    out += [(200 + i, t + " " + prose(1)) for i, t in enumerate(base[:8])]  # near copies
    out += [(300, None), (301, ""), (302, " \n\t "), (None, prose(30)), (None, None), (303, prose(3)), (304, "one"), (305, "Two WORDS")]
    out += [(306, base[3].upper()), (306, base[3].upper()), (307, "é" * 50 + " 日本 語 \u00a0 x\u2581y"), (308, "a" * 5000), (309, prose(20_000))]
    out += [(310, "\n".join([base[1]] * 3)), (311, "# $ % " * 40 + prose(20)), (312, "<|endoftext|> in a text <s> </s>  two  spaces "), (313, "1 " * 5000)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0, 1, 2, "x", 1, 2, "w", 3, 4, "l", 5, "u", "v", {"x": 1}) for i, t in data], SCHEMA)


@pytest.fixture(scope="session")
def data():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, data):
    return frame(spark, data).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
