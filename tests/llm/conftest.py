import random

import pytest

from cartwheel.llm.common import workers_import_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """make(rows, schema): a DataFrame; Python workers can import the package."""
    workers_import_package(spark)
    return lambda rows, schema=DOCS: spark.createDataFrame(rows, schema)


def prose(rnd: random.Random, words: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(words))


#: Texts that every operator has to take: null, empty, blank, no letters, one word, very long.
ODD = [None, "", " ", "\n\n\t ", "1234 $$ %%", "word", "a " * 30_000, "x" * 5_000, "é ü 中文 😀", "\x00\x1c\x85"]
