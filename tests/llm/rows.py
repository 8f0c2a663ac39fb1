"""Small tables with the awkward cases: nulls, blanks, repeats, a long text, clashing extra columns."""

import random

#: Columns that the operators use for themselves, as columns of a document table.
TAKEN = (
    "base found row ratios id tk th fp root gone_lines id_of tk_of th_of leak seg sid window least n m a b node key part copies copy kept words host doc_id_ _place _served _id _tk _key _first _th "
    "_text _leaks _gone stack bucket bounds is_point at held_out predicted label weight text_ spans hs marks start bits first firsts"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, text_hash string, h long, id long"


def prose(seed, n):
    rng = random.Random(seed)
    syllables = "an be co da el fi go hu in ka lo mi no or pa re su ta un ve".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def awkward():
    base = prose(1, 80)
    texts = [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n"), (None, prose(2, 40)), (None, None), (6, prose(3, 30) + "\n" + prose(3, 30)),
        (7, "one"), (8, "one two"), (9, prose(4, 20_000)), (10, base.replace(base.split()[40], "changed", 1)), (11, "x" * 50_000), (12, prose(5, 60) + " été ß 日本 \U0001f600"),
    ]
    return [(d, t, None, None if d == 1 else "s", None, 0.5, "a", 1, 2) for d, t in texts]


def awkward_frame(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)


def crowded_frame(spark):
    """The awkward rows with a column for every name of TAKEN, which holds its name and the row's text_hash."""
    from pyspark.sql import functions as F

    df = awkward_frame(spark)
    return df.select(*df.columns, *(F.concat(F.lit(f"{c}:"), F.col("text_hash")).alias(c) for c in TAKEN if c not in df.columns))
