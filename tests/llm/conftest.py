import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empties, blanks only, very long, ties, repeats, odd characters."""
    rng = random.Random(4)
    long, one = prose(rng, 30_000, 5000), prose(rng, 60)
    return [None, "", "   \t\n", "x", "a b c", one, one, one + " ", one.upper(), long, long + " end", "é\u00a0ü \u2003 ß", "\u0000 \u0001", "日本 語 テキスト", prose(rng, 25), prose(rng, 300), None, ""]
