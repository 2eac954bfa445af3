from __future__ import annotations

import random

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, h1 long, recipe string, n int, component string, tag int, marks string"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en" if i is not None and i % 2 else None, s, None, "x", "y", 1, "z", 2, "c", 3, "m") for i, t, s in rows], EXTRA)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    made = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)]
    return [r.choice(made) for _ in range(n)]
