"""Small documents with what real tables hold: nulls, empty and long texts, copies, repeated rows."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, lane int, slot long, bucket int, block long"
)


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words))


def documents():
    base = prose(1, 120)
    words = base.split()
    texts = [
        (0, base, "en"),
        (1, base, "en"),
        (2, " ".join(["changed", *words[1:]]), "en"),
        (3, " ".join([*words[:-1], "other"]), "de"),
        (4, base.replace(" ", " \t\n", 3), "en"),
        (5, None, "en"),
        (6, "", None),
        (7, "one two", "fr"),
        (8, prose(2, 9000), "en"),
        (9, "l1 a b\nl2 c d\nl3 e f\nl4 g h\nl5 i j", "en"),
        (10, "x\nl1 a b\nl2 c d\nl3 e f\nl4 g h\ny", "en"),
        (11, "\n\n\n\n\n", "en"),
        (12, "***", "en"),
        (None, prose(3, 40), "en"),
        (None, None, "en"),
        (13, prose(4, 60), None),
        (13, prose(4, 60), None),
    ]
    texts += [(100 + i, prose(50 + i, 30 + i % 40), ["en", "de", None][i % 3]) for i in range(60)]
    return [
        (i, t, lang, None if (i or 0) % 7 == 3 else f"s{(i or 0) % 3 if (i or 0) < 110 else 0}", -1, "r", None, 1, 2, 3, 4)
        for i, t, lang in texts
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
