"""Documents with everything that must not break an operator, and small helpers."""

import random

import pytest

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "é", "ß") for b in ("ra", "ti", "so", "wen", "x", "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def make_rows(seed: int = 3, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    rows: list[tuple] = []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 5)))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None]), len(text)))
    base = rows[0][1] + " " + sentence(rng, 80)
    rows += [(100 + i, base, "en", "a", len(base)) for i in range(6)]  # copies
    words = base.split(" ")
    for i in range(6):  # near copies
        changed = list(words)
        changed[rng.randrange(len(words))] = f"new{i}"
        rows.append((200 + i, " ".join(changed), "en", "b", None))
    rows += [
        (300, base.replace(" ", "  \t"), "en", "a", 1),  # equal but for spaces
        (301, None, None, None, None),
        (302, "", "en", "a", 0),
        (303, " \n\t ", "en", "a", 4),
        (304, "one", "en", "a", 3),
        (305, " ".join(["again"] * 4000), "en", "b", None),
        (306, "x" * 20_000, "en", "b", None),
        (None, "no id at all " + sentence(rng, 30), "en", "a", None),
        (None, base, "en", "a", None),
        (5, rows[5][1], rows[5][2], rows[5][3], rows[5][4]),  # a row twice
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """A table, as some operators read their input more than once in one order; with columns named as operators name theirs."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    extra = {c: F.lit("clash") for c in ("size", "sha", "kept", "kept_id", "score", "rep", "digest", "key", "row", "copies", "ident", "doc", "no", "quality", "Chosen_id")}
    spark.createDataFrame(rows, SCHEMA).withColumns(extra).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
