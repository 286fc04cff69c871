import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from samples import ODD  # noqa: E402

@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, ties, repeats, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", len(t or ""), k, k * 0.5, "x", "y", "z", True, "q") for k, (i, t) in enumerate(ODD)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, found string, ids string, __text string, kept boolean, word string"
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
