"""Shared inputs: awkward rows, and columns named like the operators' own."""

import re

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "Same text, twice over"), (5, "Same text, twice over"),
        (None, "no id here"), (7, LONG), (8, "ÉTÉ naïve 12 \u4e2d\u6587 \U0001f600"), (9, "<|endoftext|> x")]
CLASHING = ["value", "_value", "simhash", "overlap", "kept", "row_key", "size", "key", "slice", "host", "found", "block"]


def frame(spark, rows=ROWS, clashing=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("*", *[f"concat('{c}', '!') AS {c}" for c in CLASHING]) if clashing else df


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def union_find(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
