"""Small tables with every awkward case: nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


def documents(n=60, seed=5):
    r = random.Random(seed)
    words = {"en": [f"the{a}ing" for a in "abcdefghijklmnop"] + ["of", "and", "the"], "de": [f"ge{a}heit" for a in "abcdefghijklmnop"] + ["und", "der", "ü"], "fr": [f"eau{a}ment" for a in "abcdefghijklmnop"] + ["le", "et", "é"], "es": [f"cion{a}ado" for a in "abcdefghijklmnop"] + ["el", "y", "ñ"]}
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr", "es")[i % 4]
        text = sentence(r, words[lang], r.choice([1, 2, 5, 30, 80]))
        rows.append((i, text, lang, f"s{i % 5}", len(text)))
    base = rows[3][1] if len(rows[3][1]) > 200 else sentence(r, words["es"], 90)
    rows += [(100, base, "es", "s1", 1), (101, base, "es", "s1", 1), (102, base.replace("  ", " ").replace(" ", "\n\t ", 3), None, None, None)]
    rows += [(103, base + " one more", "es", "s2", 1), (104, "", "en", "s0", 0), (105, " \t\n", "en", "s0", 3), (106, None, "en", "s0", None), (107, None, None, None, None)]
    rows += [(None, base, "es", "s1", 1), (None, "lonely text here", "en", None, 1), (108, "12 -- !! 34", "en", "s3", 1), (104, "", "en", "s0", 0), (100, base, "es", "s1", 1)]
    rows += [(109, sentence(r, words["en"], 20000), "en", "s0", 1), (110, "Wörter Ünd ÉÈ ñ 漢字 😀 x", "de", "s9", 1)]
    return rows


def frame(spark, rows=None):
    x = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    # columns that operators also make, or use inside
    return x.selectExpr("*", "1 as shard", "'x' as Size", "2 as cell", "named_struct('doc_id', 1) as row", "false as kept", "0 as h", "array(1) as spans")


def empty(spark):
    return frame(spark, [])
