import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = "word " * 3000 + "tail"


@pytest.fixture(scope="session")
def prose():
    """(id, text): prose of small vocabulary with exact and near copies, repeated passages and awkward texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and", "to", "is", "Été", "Ünder"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = make(60), []
    for i in range(90):
        w = make(rng.randint(1, 160))
        if i % 9 == 0:
            w[rng.randrange(len(w)) : 0] = passage
        rows.append((i, " ".join(w)[:-1] + ".\n"))
    for i in range(90, 130):  # near copies of a few documents, a chain of them
        w = rows[i % 4 * 20][1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w)))
    awkward = [None, "", " \t\n", "one", "one two", "ONE TWO", LONG, LONG, "a\x0bb\x0cc d\x1ce", "🙂 " * 30, "<|endoftext|> x"]
    return rows + [(200 + k, t) for k, t in enumerate(awkward)] + [(None, "no id here"), (None, rows[0][1])]


@pytest.fixture(scope="session")
def documents(spark, prose):
    """The prose with the other columns of documents and one whose name an operator uses."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in prose], "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(5)
