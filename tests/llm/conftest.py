import random

import pytest

#: Columns that operators use inside, with other content.
CLASHING = "id string, chunk string, key long, n string, prefix string, stands long, label string, v string, score string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' if rng.random() < .1 else ''}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empty and long texts, copies, near copies, shared passages, periodic text, odd characters."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(60, 300)) for _ in range(30)]
    passage, other = prose(rng, 60), prose(rng, 42)
    out = list(base)
    out += [base[0]] * 12 + [base[1], base[1].upper(), base[2]]
    for b in base[3:9]:  # near copies
        for _ in range(5):
            w = b.split(" ")
            for _ in range(rng.randrange(1, max(2, len(w) // 60))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            out.append(" ".join(w))
    out += [f"{prose(rng, 50)} {passage} {prose(rng, 30)} {other if k % 3 else passage}" for k in range(15)]
    out += [None, None, "", "", " \t\n", "one", "One", "two words", "two  words", "a b c d", "%%% --- !!!", "12 34"]
    out += ["To " * 400, "ab" * 300, "a" * 500, "é" * 120, "日本語 テキスト" * 30, "x\x00y " * 60, " \x85\x1c " * 40]
    out += [" ".join(base[:25]) * 3, passage, passage + " ", " ".join([other, other])]
    table = [(i * 7 % 1009, t) for i, t in enumerate(out)]
    table += [table[4], table[4], (table[5][0], "the same id with another text"), (None, base[6]), (None, None)]
    rng.shuffle(table)
    return table


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a documents table over several partitions, with clashing columns."""
    full = [(i, t, "en" if k % 2 else "de", None, None, *[None if k % 3 else ("7" if c != "key" and c != "stands" else 7)
                                                           for c in [x.split()[0] for x in CLASHING.split(", ")]])
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
