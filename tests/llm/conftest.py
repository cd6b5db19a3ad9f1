import pytest


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("shared")))
    return spark


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int, seed: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(shared):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    base = prose(80, 1)
    texts = [
        (1, base), (2, base), (2, base), (2, prose(70, 2)), (3, ""), (4, None), (None, base), (None, None), (5, "one"), (6, "É ÀÇ ñandú 北京 \U0001f600 ́x"),
        (7, prose(6000, 3)), (8, base.replace("alpha", "omega", 1)), (9, "\n\n \t"), (10, "a" * 5000), (11, prose(60, 4) + "\n" + base), (12, base + "\n" + prose(60, 5)), (13, "don't I'll <|endoftext|> x's 12.5%"),
    ]
    rows = [(i, t, "en" if k % 3 else None, "src0", None if t is None else len(t), 0.5, "x", 1, 2, None, "r") for k, (i, t) in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, fp int, part int, row string, predicted string"
    return shared.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
