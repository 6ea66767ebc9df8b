import random

import pytest

DATA = "/root/testdata"


def text(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" + r.choice(["", "", ",", "."]) for _ in range(n))


def edited(r, t, n):
    w = t.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): edge cases, exact and near copies in small and large groups, a passage and lines that many share."""
    r = random.Random(5)
    rows = [None, "", "   \n\t ", "one", "One", "one two three", "ONE two\nthree", "a b c d e", "a b c d e f", "é́ ß İ x", "12 34 56"]
    base = [text(r, r.randrange(20, 160), 50000) for _ in range(60)]
    rows += base
    for b in base[:25]:
        rows += [edited(r, b, k) for k in (0, 1, 2, 3)]
    big = text(r, 150, 50000)
    rows += [edited(r, big, r.randrange(0, 5)) for _ in range(70)] + [big] * 45
    passage = text(r, 60, 50000)
    rows += [text(r, r.randrange(5, 60), 50000) + "\n" + passage + "\n" + text(r, r.randrange(5, 60), 50000) for _ in range(50)]
    rows += [text(r, 4, 50000) + " " + passage for _ in range(40)]
    rows.append(text(r, 20000, 50000))
    r.shuffle(rows)
    return list(enumerate(rows, start=3))


@pytest.fixture()
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "zz", 7) for i, t in corpus], "doc_id long, text string, component_id string, n long").repartition(3)
