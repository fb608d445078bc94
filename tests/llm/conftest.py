import re

import pytest

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text, lang, source), with a column that clashes with the operators' own."""
    def build(rows):
        rows = [(*r, *("en", "s")[len(r) - 2:]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), True) for r in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, kept boolean")
    return build


@pytest.fixture
def words():
    return lambda text: SPACES.findall((text or "").translate(LOWER))
