import pytest

WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta iota rho tau phi chi psi mu nu xi pi".split()


def prose(seed: int, n: int) -> str:
    import random

    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """(rows, frame): documents with copies, near copies, odd texts, nulls, a repeated row and a clashing extra column."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [(0, base, "b"), (1, base, "a"), (2, near, "a"), (3, None, None), (4, "", "a"), (5, "one two", "b"), (6, "one two", "b"), (7, prose(2, 3000), "a"), (8, "Ünïcode text  \n\n mixed\ttabs 😀", None), (8, "Ünïcode text  \n\n mixed\ttabs 😀", None)]
    rows += [(i, prose(i, 20 + i), "abc"[i % 3]) for i in range(9, 60)]
    df = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, key string, size int")
    return rows, df
