"""Small tables with everything that is odd, for all operators."""

import random

import pytest

VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("r", "st", "é") for c in ("a", "en", "or", "ß")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="session")
def prose():
    """A function that makes random prose."""
    return sentence


@pytest.fixture(scope="session")
def odd(spark):
    """Null keys and texts, empty, blank, wordless and very long texts, repeated rows and ids, and clashing extra columns."""
    rng = random.Random(5)
    long_text, text = sentence(rng, 30_000), sentence(rng, 120)
    line = "This is a line that repeats, over and over.\n"
    texts = [
        (1, text), (1, text), (2, text), (3, None), (4, ""), (5, " \n\t \n"), (6, "!!! ... ###"), (None, text), (None, None), (7, long_text),
        (8, line * 3 + text[:90]), (9, line + sentence(rng, 60)), (10, line + "x\n" + line), (11, "word"), (1, "another text under the id of the first"),
        (12, "日本語のテキスト 각 한국 🙂 émigré"), (13, "null\x00byte and \x1c odd \x85 blanks <|endoftext|>"), (14, text + " almost the same"),
    ]
    rows = [(i, t, None if i == 2 else "en", None, 7, "x", 1.5, True, b"z", 3, "y", 0, 0, 0) for i, t in texts]
    names = "doc_id long, text string, lang string, source string, n_chars long, node string, score double, toxic boolean, _doc binary, length long, items string, n_lines long, piece int, _run int"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
