"""Small documents with every odd case, and brute-force versions of the operators' contracts."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; a table may have them already.
CLASHING = ["n_words", "name", "row", "row_hash", "label", "rep", "kept", "score", "band", "key", "names", "ranges", "spans", "words", "__text", "held_out", "piece", "length", "task", "window", "item_ids", "predicted"]

WORDS = "the of and river stone cloud maple under seven light window paper garden silver travel morning market bridge winter cotton doctor forest island letter number orange pocket rocket signal ticket valley wonder yellow zipper anchor basket candle dragon engine flower".split()


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    out = [pick.choice(WORDS) + str(pick.randrange(40)) if pick.random() < 0.4 else pick.choice(WORDS) for _ in range(n)]
    return " ".join(w + "." if k % 9 == 8 else w for k, w in enumerate(out))


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace("river", "lake", 1)
    long = prose(2, 30_000)
    rows = [
        (10, base, "en", "a", len(base)), (11, near, "en", "a", None), (12, base, None, None, None), (3, base, "en", "a", 1),
        (20, None, "en", "a", 0), (21, "", "en", "a", 0), (22, "  \n\t ", "en", "a", 5), (23, "one", "en", "a", 3), (24, "one", "en", "a", 3), (25, "one two", "en", "a", 7), (26, "é ü ß 漢字 \U0001F600 x", "de", "b", None),
        (30, long, "en", "a", len(long)), (31, "x" * 200_000, "en", "a", None), (32, "ab" * 40_000, None, "a", None), (33, ("the same line here\n") * 300, "en", "a", None),
        (40, prose(4, 60), "en", "a", 1), (40, prose(4, 60), "en", "a", 1), (41, prose(5, 60), "en", "a", 1), (41, prose(6, 60), "en", "a", 1),
        (None, base, "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None),
        (50, prose(7, 40) + " " + prose(8, 80), "en", "a", 1), (51, prose(9, 30) + "\n" + prose(8, 80), "en", "a", 1), (52, prose(8, 80).upper(), "en", "a", 1),
        (-5, prose(10, 100) + " " + base[100:400], "en", "a", 1),
    ]
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def with_clashes(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING if c not in df.columns])


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def as_set(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text: str | None, pattern: str = r"[^\x20\x09-\x0D]+") -> list[str]:
    return re.findall(pattern, text or "")
