from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from conftest_llm import words  # noqa: E402


@pytest.fixture(scope="session")
def small():
    """Texts with every hard case: nulls, empties, copies, near copies, long, repeated rows, ties."""
    base = [" ".join(words(k, 40 + 13 * k)) for k in range(14)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, None, None), (21, "", "s1"), (22, " \n\t ", "s1"), (23, "one", "s1"), (24, "one two", None), (25, "ONE two", "s0")]
    rows += [(30, base[3], "s1"), (31, base[3], "s2"), (32, base[3] + " end", "s2"), (33, base[5].replace(" a", " b", 1), "s0"), (34, base[9][100:500] + " middle " + base[10][50:400], "s0")]
    rows += [(35, base[3], "s1"), (35, base[3], "s1"), (36, "é" * 300 + " " + base[12][:260] + "ß" * 150, "s0"), (37, "ab" * 400, "s2"), (38, "line\n" * 50 + base[1], "s2")]
    rows += [(40, " ".join(words(99, 9000)), "s0"), (41, "x" + " ".join(words(99, 9000))[7:], "s0"), (42, "nospace" * 12000, "s0")]
    rows += [(50 + i, base[7] + f" tail {i}", "s1") for i in range(12)]
    return rows
