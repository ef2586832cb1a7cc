"""Messy documents shared by the operator tests: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, component_id long, `text_crc32` long"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(3000)]


@pytest.fixture(scope="session")
def messy(vocabulary):
    """(doc_id, text) rows: copies, near copies, short, empty, null and long texts, a repeated row, a null id."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(40, 120), vocabulary) for _ in range(12)]
    rows, doc = [], 0
    for text in base:
        for k in range(rng.randint(1, 5)):
            parts = text.split(" ")
            if k:
                parts[rng.randrange(len(parts))] = f"edit{k}"
            rows.append((doc, " ".join(parts)))
            doc += 1
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE two"), (905, "one two three four five"),
             (906, words(rng, 20_000, vocabulary)), (907, base[0]), (907, base[0]), (None, base[1]), (None, "no id here at all"),
             (908, "éa ünï 漢字 ½   <|endoftext|> " * 3)]
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(d, t, "en", "src0", 0, 1.5, 3, 4, 5) for d, t in rows], DOC)
    return make
