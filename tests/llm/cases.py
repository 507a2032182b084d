"""Small tables with every awkward row, shared by the tests of the operators."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the and of that with inger stion thorea anted whent bly ther ous rean mor dell".split()
DE = "der die und nicht schen keit lich verein zungen achter mauf pfen tzer heit".split()


def prose(words, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(words) * rng.randint(0, 1) for _ in range(n))


def rows():
    passage = prose(EN, 70, 1)
    made = [(i, prose(EN if i % 2 else DE, 30 + i, i), "en" if i % 2 else "de", "src0") for i in range(24)]
    made += [
        (30, passage, "en", "src0"), (31, prose(EN, 20, 9) + " " + passage + "\n" + prose(EN, 9, 8), "en", "src1"),
        (32, passage, "en", "src0"), (33, passage, "en", "src0"), (34, passage + " more", "en", None),
        (40, None, "en", "src0"), (41, "", "de", None), (42, " \t\n ", None, "src0"), (43, "...!? 12", "de", "src2"),
        (44, "word", "en", "src2"), (45, "Ünï ço∂é 日本語 \U0001f600 x y", None, "src2"), (46, prose(EN, 5000, 5), "en", "src0"),
        (47, "same " * 100, "en", "src0"), (50, "twin rows here", "en", "src0"), (50, "twin rows here", "en", "src0"),
        (51, "one id " + passage, "en", "src0"), (51, "other text", "en", "src0"), (None, passage + " null id", None, None), (None, None, None, None),
        (60, 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here\nReleased under the MIT License.\nmore', "en", "src0"),
    ]
    return [(a, b, c, d, len(b) if b else None) for a, b, c, d in made]


def table(spark, some=None, extra=True):
    df = spark.createDataFrame(rows() if some is None else some, SCHEMA)
    if extra:  # columns whose names the operators use themselves
        for name in ("tag", "fp", "z", "score", "lang_pred", "findings", "piece", "length", "kind", "key", "a", "c", "h", "m_id"):
            df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)
