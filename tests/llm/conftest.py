import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    """A documents table of (doc_id, text[, lang[, source]])."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts with exact copies, near copies, shared passages, nulls, empty and white texts."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["be", "ta", "ri", "on", "Ä", "é", "ly", "sh"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    out = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(1, 150))]
        out.append(" ".join(words))
        if i % 3 == 0:
            for _ in range(rng.randint(1, 5)):
                near = list(words)
                for _ in range(rng.randint(0, 3)):
                    near[rng.randrange(len(near))] = word()
                out.append(rng.choice([" ", "\n", "  "]).join(near))
        if i % 4 == 0:
            out.append(f"{' '.join(words[:20])} {passage}\n{word()}")
    out += ["", " \n\t ", None, "one two", "ONE two", "a b c d e", "x" * 300, "x" * 301, passage, passage]
    return list(enumerate(out))
