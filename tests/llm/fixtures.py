"""A small table of awkward rows: nulls everywhere, empty and very long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, fp long, entry string, label string, score double"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "in", "on", "re", "ed", "sh", "ti", "le", "so", "ka"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


LONG = words(99, 30_000)

TEXTS = [
    (1, words(1, 60)), (2, words(1, 60)), (3, words(1, 60).replace(" ", " \n\t", 3)), (4, None), (5, ""), (6, "   \n"), (7, LONG),
    (8, words(2, 200)), (9, words(2, 200) + " extra"), (10, words(3, 3)), (11, "Größe naïve 日本語 🙂 <|endoftext|> don't"), (12, words(4, 80)),
    (12, words(4, 80)), (12, words(5, 40)), (None, words(6, 30)), (None, words(6, 30)), (None, words(1, 60)), (20, 'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"'),
    (21, "Released under the MIT License. Some words."), (22, "x" * 5000), (23, "idiot trash " + words(7, 50)),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None, None, None, "clash", None, None, None, None) for i, t in rows], SCHEMA)


def empty(spark):
    return frame(spark, [])
