"""Small tables with every odd case that the operators promise to handle."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

LONG = "alpha beta gamma. " * 3000 + "x" * 20000 + " a@" + "b." * 3000 + "c 1" + "2" * 4000
TEXTS = [
    (1, "Mail me: jo.doe@mail.example.com or +1 (555) 010-9999.\nToken = 0123456789abcdef0123456789abcdef"),
    (2, "Mail me: jo.doe@mail.example.com or +1 (555) 010-9999.\nToken = 0123456789abcdef0123456789abcdef"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, LONG),
    (7, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, host 10.0.0.1 not 10.0.0.256 but 1.2.3.4.5.6.7.8"),
    (8, "IBAN DE89 3704 0044 0532 0130 00, ssn 078-05-1120; then a long stretch of words without any hint at all 078-05-1120 and an end"),
    (9, "Ünïcode 😀 tést a_b@c.de.x@y.zz x@y @z.de q@w.e..r " + "ab " * 40),
    (9, "Ünïcode 😀 tést a_b@c.de.x@y.zz x@y @z.de q@w.e..r " + "ab " * 40),
    (None, "a row without an id has a text like any other row, and it is long enough to count"),
    (11, "one two three four five\none two three four five\nOne, two; three four FIVE!\nshort\nshort"),
    (12, "The MIT License\nReleased under the MIT licence.\nCopyright 2020 Jo\nnothing else"),
    (13, "Licensed under the Apache License, Version 2.0."),
]


def edge_docs(spark):
    """The texts above with columns whose names the operators use inside."""
    rows = spark.createDataFrame([(i, t, "en", f"s{n}") for n, (i, t) in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    extra = {c: F.lit(7) for c in ("fp", "rid", "row", "digest", "s", "line", "th", "kept", "number", "length", "key", "grp")}
    return rows.withColumn("n_chars", F.length("text").cast("long")).withColumns(extra)


def no_docs(spark):
    return edge_docs(spark).where("false")


def union_find(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
