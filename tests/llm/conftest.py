import random

import pytest

LETTERS = ("the", "of", "and", "a", "in", "river", "stone", "light", "morning", "paper", "Glass", "été", "niño", "über", "don't", "x1", "(aside)", "end.")


def prose(rng, n):
    return " ".join(rng.choice(LETTERS) + str(rng.randrange(60)) * rng.randrange(2) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text) with nulls, blanks, copies, near copies, shared passages, repeated rows, marks and a long text."""
    rng = random.Random(5)
    passage = prose(rng, 80)
    base = [prose(rng, rng.randrange(3, 160)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(12)]  # copies
    rows += [(120 + i, "  " + base[i].replace(" ", "\n\t") + " ") for i in range(6)]  # copies but for white space
    rows += [(140 + i, base[i] + " one more") for i in range(8)]
    rows += [(160 + i, f"{prose(rng, 20)} {passage} {prose(rng, 15)}") for i in range(5)]
    rows += [(170, passage), (171, passage + " " + passage), (172, "repeat " * 300)]
    rows += [(180, None), (181, ""), (182, " \n\t "), (183, None), (184, "one"), (185, "a  b c   d e\x1cf"), (186, "<|endoftext|> it's \"'s\" don't-we'll (x),y 12,345.67!!??\r\n\r\n  tail  ")]
    rows += [(190, base[3]), (190, base[3]), (190, base[4])]  # a repeated row, and its id again with another text
    rows += [(None, base[5]), (None, "no id here at all")]
    rows += [(200, prose(rng, 30_000)), (201, "z" * 200_000), (-7, base[2])]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same rows among columns whose names clash with those that operators use inside."""
    names = ("digest", "_digest", "text_key", "_text_key", "marks", "_marks", "_id", "_key", "marked_id", "marked_key", "points", "_points", "keep", "kept", "stay_id", "fp", "root", "anchor", "run", "norm", "salt")
    extra = [(i, t, *("x" for _ in names), 7, i, 1.5) for i, t in odd_rows]
    schema = "doc_id long, text string, " + "".join(f"{c} string, " for c in names) + "n int, block long, score double"
    return spark.createDataFrame(extra, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
