import math
from collections import Counter

import pytest

from marginlake.llm import licenses, queries

MIT = "Released under the MIT License."
GPL = "This work is licensed under the GNU General Public License, version 3."


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string, score string, folder string")


def row(path, text):
    return (path, text, "clash", "mine")


def found(df):
    return {r["path"]: (r["license"], r["how"], r["from_path"]) for r in licenses.scan(df).collect()}


def test_headers_files_and_inheritance(spark):
    rows = [
        row("a/LICENSE", "Header\n" + MIT),
        row("a/b/x.txt", "nothing here\nat all"),
        row("a/b/y.txt", "some text\n" + GPL + "\nmore text"),
        row("a/b/c/COPYING", GPL),
        row("a/b/c/d/z.txt", None),
        row("other/z.txt", ""),
        row("plain/statement", "Licensed under CC BY-NC 4.0."),
        row("plain/z.txt", "The license of this text is unknown."),
        row("top.txt", "no folder"),
        row(None, MIT),
    ]
    got = found(files(spark, rows))
    assert got == {
        "a/LICENSE": ("MIT", "file", None),
        "a/b/x.txt": ("MIT", "inherited", "a/LICENSE"),
        "a/b/y.txt": ("GPL-3.0", "header", None),
        "a/b/c/COPYING": ("GPL-3.0", "file", None),
        "a/b/c/d/z.txt": ("GPL-3.0", "inherited", "a/b/c/COPYING"),
        "other/z.txt": (None, "none", None),
        "plain/statement": ("CC-BY-NC-4.0", "file", None),
        "plain/z.txt": ("CC-BY-NC-4.0", "inherited", "plain/statement"),
        "top.txt": (None, "none", None),
        None: ("MIT", "file", None),
    }
    assert licenses.scan(files(spark, rows)).columns == ["path", "license", "how", "score", "from_path", "folder"]


def test_root_license_reaches_everything(spark):
    got = found(files(spark, [row("LICENSE", MIT), row("deep/er/x", "words"), row("y", "words")]))
    assert got["deep/er/x"] == ("MIT", "inherited", "LICENSE") and got["y"] == ("MIT", "inherited", "LICENSE")


def test_repeated_rows_ties_and_empty_table(spark):
    rows = [row("a/LICENSE", MIT), row("a/LICENSE", MIT), row("a/COPYING", GPL), row("a/x", "t"), row("a/x", "t")]
    all_rows = licenses.scan(files(spark, rows)).collect()
    assert len(all_rows) == 5
    assert {(r["license"], r["from_path"]) for r in all_rows if r["path"] == "a/x"} == {("GPL-3.0", "a/COPYING")}
    assert licenses.scan(files(spark, [])).count() == 0


def test_long_text_is_read_to_its_end(spark):
    text = "\n".join(["plain words in a row"] * 20_000 + [GPL])
    assert found(files(spark, [row("a/x", text)]))["a/x"][:2] == ("GPL-3.0", "header")


def brute_cosine(words, template, counts, n):
    idf = lambda t: math.log((n + 1) / (counts.get(t, 0) + 1)) + 1
    known = licenses.Vocabulary().known
    weigh = lambda b: {t: c * (idf(t) if t in known else 1.0 if isinstance(t, str) else 0.0) for t, c in b.items()}
    a, b = weigh(licenses.bag(words)), weigh(licenses.bag(template))
    return sum(v * b.get(t, 0) for t, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def test_cosines_equal_brute_force(spark):
    texts = [MIT, GPL, "Copyright 2020 Someone. " + GPL, "the license of the work", "Licensed under the Apache License, Version 2.0 or later", None]
    counts = licenses.document_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    vocabulary = licenses.Vocabulary()
    plain: Counter = Counter()
    for t in texts:
        plain.update(vocabulary.known & set(licenses.bag(licenses.terms(t or ""))))
    assert {k: v for k, v in counts.items() if k} == dict(plain) and counts[None] == len(texts)
    scorer = licenses.Scorer(counts)
    for t in texts[:-1]:
        words = licenses.terms(t)
        want = max(brute_cosine(words, licenses.terms(x), counts, len(texts)) for _, x in vocabulary.templates)
        assert scorer.best(words)[0] == pytest.approx(want)


def test_every_license_line_of_the_sample_is_found(spark):
    sf = "/root/testdata/sf0.01"
    lines = {MIT: "MIT", GPL: "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = [lines[x] for x in r["text"].split("\n") if x in lines]
        if own:
            want[r["doc_id"]] = set(own)
    rows = queries.op5_licenses(spark, sf).collect()
    assert len(rows) == 1000 and len(want) > 30
    got = {r["doc_id"]: r["license"] for r in rows if r["how"] in ("header", "file")}
    assert set(got) == set(want) and all(got[i] in want[i] for i in want)


WRAPPED_GPL_3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful.
def f(x): return x
"""


def wrapped(text, width=60, lead=""):
    import textwrap

    return "\n".join(lead + line for line in textwrap.wrap(text, width))


def test_headers_that_run_across_lines(spark):
    rows = [
        row("a/three.py", WRAPPED_GPL_3),
        row("a/two.py", WRAPPED_GPL_3.replace("3 of", "2 of")),
        row("a/mit.c", "/* Copyright 2020 Someone\n" + wrapped(licenses.TEXTS["MIT"], 50, " * ") + "\n */\n" + "int main;\n" * 500),
        *[row(f"b/{k}.py", WRAPPED_GPL_3) for k in range(20)],  # a header that most rows carry
    ]
    got = found(files(spark, rows))
    assert got["a/three.py"][:2] == ("GPL-3.0", "header") and got["a/two.py"][:2] == ("GPL-2.0", "header")
    assert got["a/mit.c"][:2] == ("MIT", "header")
    assert {got[f"b/{k}.py"][0] for k in range(20)} == {"GPL-3.0"}


def test_full_texts_are_licence_files_whatever_their_name(spark):
    rows = [row(f"{name}/terms.txt", f"{name}\n\nCopyright (c) 2021 Some One\n\n" + wrapped(text)) for name, text in licenses.TEXTS.items()]
    rows += [row(f"{name}/code.py", "x = 1") for name in licenses.TEXTS]
    rows += [row(f"t{k}/x", title + "\n" + "Everyone is permitted to copy. " * 400) for k, title in enumerate(licenses.TITLES.values())]
    rows += [row(f"t{k}/deep/code.py", "y") for k in range(len(licenses.TITLES))]
    got = found(files(spark, rows))
    for name in licenses.TEXTS:
        assert got[f"{name}/terms.txt"] == (name, "file", None)
        assert got[f"{name}/code.py"] == (name, "inherited", f"{name}/terms.txt")
    for k, name in enumerate(licenses.TITLES):
        assert got[f"t{k}/x"][:2] == (name, "file") and got[f"t{k}/deep/code.py"][:2] == (name, "inherited")
