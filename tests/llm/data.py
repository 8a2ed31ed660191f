"""Small document tables with the awkward cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sentence(r, n, words=40):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


#: Null, empty, blank, tiny, repeated and long texts.
ODD = [None, "", "   \n", "a", "a", "é", "same text here again", "same text here again", "x " * 3000, " \u0000 odd", "😀 " * 50]


def texts(seed, n=60):
    """Random texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    out = [sentence(r, r.randrange(1, 120), 400) for _ in range(n)]
    shared = sentence(r, 90, 400)
    for k in range(0, n, 3):
        base = out[k].split()
        for _ in range(r.randrange(3)):
            words = list(base)
            for _ in range(r.randrange(1 + len(words) // 15)):
                words[r.randrange(len(words))] = f"n{r.randrange(99)}"
            out.append(" ".join(words))
    return out + [f"{sentence(r, 10)} {shared} {sentence(r, 8)}" for _ in range(6)] + [out[0]] * 3
