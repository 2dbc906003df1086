"""Small tables with every odd case: nulls, empty and long texts, repeated rows, clashing names."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key string, tag int, size string, ids string, score string, n_words string, part string, row string, kept string"
)


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdeghilmnorstu") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def row(i, text, lang="en", source="src0"):
    return (i, text, lang, source, len(text or ""), "k", 1, "big", "x", "y", "z", "p", "r", "w")


def odd_rows():
    rnd = random.Random(4)
    base = sentence(rnd, 60)
    long = sentence(rnd, 6000)
    words = base.split()
    return [
        row(1, base),
        row(2, base),
        row(3, " ".join([*words[:-1], "other"])),
        row(4, base.upper()),
        row(5, None),
        row(6, ""),
        row(7, " \n\t "),
        row(8, "two words", None),
        row(9, "two words", "de", None),
        row(10, long, "fr", "src1"),
        row(10, long, "fr", "src1"),
        row(11, sentence(rnd, 20) + " " + " ".join(words[5:30]) + " " + sentence(rnd, 9), None, None),
        row(12, sentence(rnd, 13)),
        row(13, "na " * 40, "en", "src2"),
        row(14, "été naïve 漢字   x y 1234 $$$", None, "src2"),
        row(15, "12345 --- 678", "es", "src3"),
        row(None, sentence(rnd, 30), None, None),
        row(16, " ".join(words[:40])),
        row(17, sentence(rnd, 3) + "\n" + base + "\n" + base),
    ]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
