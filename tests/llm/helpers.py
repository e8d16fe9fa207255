"""Documents for the tests, and their words as the contracts take them."""

import random
import re

ID_TEXT = "doc_id long, text string"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
#: Null and empty texts, white space only, one word, other white space, and characters of several bytes.
ODD_TEXTS = [None, "", " \t\n\r\x0b\x0c ", "word", "a\u00a0b\u2003c d\x1ce", "é ü 漢字 🎉", "A" * 3000, "x\n\nx\nx \n"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def vocabulary(seed=0, size=400):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(draw.randint(2, 9))) for _ in range(size)]


def prose(draw, words, n):
    return " ".join(draw.choice(words) for _ in range(n))


def odd_rows():
    """Odd texts under ids, under a null id, twice, and one id with two texts."""
    rows = [(i, text) for i, text in enumerate(ODD_TEXTS)]
    return [*rows, (None, "no id at all"), (None, "no id at all"), (3, "word"), (3, "another text of id three")]


def frame(spark, rows, schema=ID_TEXT):
    """With columns whose names clash with what the operators use inside and return."""
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, schema)
    for name in ("key", "part", "n", "fp", "size", "shard", "sid", "start", "taken", "_hash", "row", "rule", "n_words", "spans"):
        if name not in table.columns:
            table = table.withColumn(name, F.lit("clash"))
    return table


def empty(spark, schema=ID_TEXT):
    return frame(spark, [], schema)
