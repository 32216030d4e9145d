import hashlib
import random

import pytest

SYLLABLES = "ba co di fu ge hi jo ka le mi no pu ra se ti vo wa xe yo zu".split()


class Corpus:
    """Small random documents: repeated and near-equal lines and texts, shared passages, odd rows."""

    def __init__(self, seed: int = 1, n: int = 60):
        rnd = random.Random(seed)
        word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3)))
        line = lambda: " ".join(word() for _ in range(rnd.randint(1, 14)))
        passage = " ".join(word() for _ in range(20))
        texts = []
        for i in range(n):
            kind = i % 6
            if kind == 0 or not texts:
                texts.append("\n".join(line() for _ in range(rnd.randint(1, 6))))
            elif kind == 1:
                texts.append(rnd.choice(texts))
            elif kind == 2:
                w = rnd.choice(texts).split(" ")
                w[rnd.randrange(len(w))] = word()
                texts.append(" ".join(w))
            elif kind == 3:
                texts.append(line() + "\n" + passage + "\n" + rnd.choice(texts).split("\n")[0])
            elif kind == 4:
                w = rnd.choice(texts).split(" ")
                del w[rnd.randrange(len(w))]
                texts.append(" ".join(w))
            else:
                texts.append(line() + " É" + passage[:60] + "é 😀\t" + passage[:70])
        self.rows = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s0", "s1", None]), len(t)) for i, t in enumerate(texts)]
        odd = [None, "", " \n\t ", "one", "\n\n", "a b", "x " * 40, "=" * 200]
        self.rows += [(1000 + k, t, None, None, None) for k, t in enumerate(odd)]

    def frame(self, spark, rows=None):
        return spark.createDataFrame(self.rows if rows is None else rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def corpus():
    return Corpus()


@pytest.fixture(scope="session")
def digest():
    return lambda data: hashlib.sha256(data).hexdigest()
