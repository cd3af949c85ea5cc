import random

import pytest

from rolesift.llm.common import tuned

SCHEMA = "doc_id long, text string, lang string, n_words long, bucket string, _kept string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "iß", "tion", "ë", "qu"])
                            for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Awkward and ordinary texts by id; the last ids repeat rows."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(30, 90)) for _ in range(30)]
    passage = "\n".join(sentence(rng, 9) for _ in range(9))
    rows = list(enumerate(base))
    rows += [(100 + i, base[i % 4]) for i in range(12)]                       # exact copies
    rows += [(200 + i, base[5].replace(base[5].split()[i], "zz", 1)) for i in range(6)]
    rows += [(300 + i, f"{sentence(rng, 5 + i)}\n{passage}\n{sentence(rng, 6)}")
             for i in range(8)]
    rows += [(400, ""), (401, None), (402, "   \n\t "), (403, "word"), (404, "a  b\n\n c "),
             (405, sentence(rng, 30_000)), (406, "x" * 50_000), (407, "end <|endoftext|> it's"),
             (408, "same " * 400), (None, base[7]), (None, None), (409, base[1]), (409, base[1]),
             (410, base[20]), (410, base[21])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With extra columns whose names the operators use themselves."""
    tuned(spark)
    rows = [(i, t, "en", 7, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return tuned(spark).createDataFrame([], SCHEMA)
