import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, _text string, hash long, component_id string, _maybe int, _bits string, __q_kept int, _gone long, _chunks string, _m_rest string"


@pytest.fixture
def odd(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    data = [(1, "plain words of a short text", "en", "s"), (2, None, None, None), (None, None, None, None), (3, "", "en", "s"), (4, " \n\t\n ", "en", None), (5, long, "en", "s"), (6, "plain words of a short text", "en", "s"), (6, "plain words of a short text", "en", "s"), (None, "no id here", "de", "s"), (7, "x", "", "")]
    return spark.createDataFrame([(*d, None, "extra", 0.5, "extra", 7, "extra", 1, "extra", 0, 6, "extra", "extra") for d in data], SCHEMA)


@pytest.fixture
def none(odd):
    return odd.limit(0)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, None, None), (None, 1, 1), (6, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"
