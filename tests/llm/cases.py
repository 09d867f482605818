"""Tables that operators meet: nulls, empty and long texts, ties, repeated rows, no rows, and other columns of clashing names."""

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHING = "key fp src dst h s1 start n size bucket hits starts base spans contexts words lines hashes failed score x y run shard mined token tokens url_ component_id fingerprint _size _hash _source _times _copy".split()


def hostile(spark, rows, schema="doc_id long, text string, lang string, source string"):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


def real(spark, sf=SF):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def texts(seed, n=60):
    """Texts made of few words, with copies, near copies, shared passages and odd white space."""
    r = random.Random(seed)
    word = lambda: r.choice(("alpha", "Beta", "gamma", "délta", "ÄÖ", "x", "10", "\u00a0y", "zeta\u2028", "Ωmega"))
    passage = " ".join(f"p{i}" for i in range(70))
    out = [None, "", " ", "\n", "\t\x0b\x0c\r\n ", "one", "ONE", "one two", "a\nb\n", "a  b", "\u3000", passage, passage.upper()]
    for _ in range(n):
        t = [word() for _ in range(r.randrange(1, 160))]
        if r.random() < 0.4:
            a = r.randrange(0, 15)
            t[r.randrange(len(t)) :] = passage.split()[a : a + r.randrange(40, 60)]
        if r.random() < 0.3:
            t *= 2
        out.append("".join(w + r.choice((" ", " ", " ", "  ", "\n", "\r\n", "\t")) for w in t))
    out += r.sample(out, 12)
    out.append(" ".join(r.choice(("long", "Text", "w%d" % i)) for i in range(30_000)))
    return out


def table(spark, seed, n=60):
    """(DataFrame, rows): rows in any order, with null ids and ids that repeat a whole row."""
    r = random.Random(seed)
    rows = [(i, t, "en", r.choice((None, "a", "b", "é"))) for i, t in enumerate(texts(seed, n))]
    rows += [rows[20], rows[21], (None, rows[22][1], None, None), (None, None, None, "a")]
    r.shuffle(rows)
    return hostile(spark, rows).repartition(5), rows
