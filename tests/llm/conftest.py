import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, print string, label string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with columns whose names clash with inner ones."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or ""), "x", "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, empty and long ones."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) + ("\n" if rng.random() < 0.1 else "") for _ in range(n))

    passage = prose(60)
    rows = [(None, "no id here"), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three")]
    at = 10
    for i in range(40):
        base = prose(rng.choice([7, 12, 30, 80, 200]))
        rows.append((at, base))
        for j in range(rng.randint(0, 4)):
            near = base.split(" ")
            for _ in range(rng.randint(0, 1 + len(near) // 20)):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((at + j + 1, " ".join(near)))
        at += 10
    for i in range(6):
        rows.append((at + i, prose(50) + " " + passage + " " + prose(50)))
    rows.append((at + 10, prose(4000)))
    rows += [rows[12], rows[13]]
    return rows
