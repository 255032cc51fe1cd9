"""Small tables with the cases that every operator must survive."""

import random

LONG = "lorem ipsum dolor sit amet " * 20000
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, _mix int, n int, size string"


def prose(rng, n, words=("the of and to in is that it was for on are as with his they at be this "
                         "from have or by one had not but what all were when").split()):
    return " ".join(rng.choice(words) + rng.choice(["", "er", "ing", "ed"]) for _ in range(n))


def documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    rng = random.Random(4)
    base = prose(rng, 120)
    rows = [(i, prose(rng, 30 + i), ("en", "de")[i % 2], f"s{i % 3}", None) for i in range(20)]
    rows += [(20, None, "en", "s0", None), (21, "", None, None, None), (22, " \n\t ", "en", "s1", None),
             (23, LONG, "en", None, None), (24, "%%% 123 ***", "de", "s2", None), (25, "ok", "en", "s2", None),
             (26, base, "en", "s0", None), (27, base, "en", "s0", None), (27, base, "en", "s0", None),
             (28, base + " tail", "en", "s0", None), (None, base, "en", "s0", None),
             (30, None, None, None, None), (31, "naïve 😀 <|im_end|>  two  spaces \n\n x", "de", "s1", None)]
    return spark.createDataFrame([(*r, 1.0, 2, 3, "x") for r in rows], COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, (i // 2) % 2) for i in range(20)] + [(21, None, None), (None, 1, 1), (99, 1, 0)],
        "doc_id long, quality int, toxic int")
