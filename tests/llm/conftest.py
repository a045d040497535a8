import pytest

from packlens.session import build_session

#: Extra columns whose names clash with those that the operators make inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, h bigint, kept string, score string"
LONG = " ".join(f"word{i % 997} stem{i * 7 % 1013}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potent brews in old copper pots " * 2
PLAIN = " ".join(f"alpha{i} beta{i * i}" for i in range(60))


def row(doc_id, text, lang="en", source="s0"):
    return doc_id, text, lang, source, len(text or ""), 1, 2, "x", "y"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", cores=8, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and clashing columns."""
    near = PLAIN.replace("alpha30 ", "omega ")
    rows = [
        row(1, PLAIN), row(2, PLAIN), row(3, near), row(4, ""), row(5, None), row(6, "   \n \n"), row(7, "one"), row(8, LONG), row(8, LONG),
        row(9, "a " + PASSAGE + " b"), row(10, "c " + PASSAGE + " d\n" + PLAIN), row(None, PLAIN), row(11, "Grüße an ñandú " * 30, None, None), row(12, "token: abcdef1234 AKIA" + "Z" * 20),
        row(13, "\n".join(["a first line of nine plain words stands here", "a first line of nine other words stands here", "short", "short"])),
        (None,) * 9,
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return "/root/testdata/sf0.001"
