import random
import re

import pytest

from tidewire.llm.licenses import COVERAGE, LONG, NEIGHBOUR, NOTICES, PHRASES, SHORT, TEXTS, scan

from .data import ODD, empty, table

DOCS = [
    "Released under the MIT License. mit license, MIT--license!", "the apache license and the General Public License", "general public licenses mitlicense mit  \n license",
    "This program: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "You may redistribute it and/or really modify it under terms of the GNU General Public License as published by the Free Software foundation",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Licensed under CC BY-NC 4.0.", "mit K license", "MİT LICENSE é mit license",
]


def brute(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    places = [(i, label) for i in range(len(w)) for label, p in PHRASES if w[i : i + len(p.split())] == p.encode().split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_brute_force(spark):
    docs = DOCS + ODD
    got = scan(table(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("k,labels", [(0, "mit"), (1, "apache,gpl"), (2, "mit"), (3, "gpl"), (4, "gpl"), (5, "mit"), (6, "cc"), (7, "")])
def test_labels(spark, k, labels):
    assert scan(table(spark, [DOCS[k]])).first()["labels"] == labels


def test_merged_diagonals(spark):
    """A notice with a word put in stands on two neighbouring diagonals; only together do they cover it."""
    words = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met".split()
    text = " ".join(words[:10] + ["really"] + words[10:])
    assert scan(table(spark, [text])).first()["labels"] == "bsd"


def test_native_and_rows(spark):
    out = scan(table(spark, ["mit license"] * 2, [1, 1]).selectExpr("*", "1 as pos", "2 as rid", "3 as template"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert [r["n_base"] for r in out.collect()] == [1, 1]
    assert scan(empty(spark)).count() == 0


def brute_labels(text):
    """Labels and score by plain lists of hits, diagonal by diagonal."""
    split = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    w, labels, score = split(text), set(), 0.0
    for k, (label, template) in enumerate(PHRASES + NOTICES + TEXTS):
        t, size = split(template), SHORT if k < len(PHRASES + NOTICES) else LONG
        grams = [t[i : i + size] for i in range(len(t) - size + 1)]
        diagonals = {}
        for at, gram in enumerate(grams):
            for pos in range(len(w) - size + 1):
                if w[pos : pos + size] == gram:
                    diagonals.setdefault(pos - at, set()).add(at)
        runs, before = [], None
        for d in sorted(diagonals):
            if before is None or k < len(PHRASES) or d - before > NEIGHBOUR:
                runs.append(set())
            runs[-1] |= diagonals[d]
            before = d
        for run in runs:
            share = len(run) / len(grams)
            if k >= len(PHRASES) or share == 1:
                score = max(score, share)
            if share == 1 or k >= len(PHRASES) and share >= COVERAGE:
                labels.add(label)
    return ",".join(sorted(labels)), round(score, 9)


def test_notices_against_brute_force(spark):
    r = random.Random(11)
    docs = []
    for label, text in [*NOTICES, *TEXTS]:
        words = text.split()
        for change in (0, 0.02, 0.2):
            edited = [x for x in words if r.random() >= change / 2]
            edited = [y for x in edited for y in ([x, "indeed"] if r.random() < change / 2 else [x])]
            docs.append(f"{' '.join(f'z{r.randrange(99)}' for _ in range(r.randrange(40)))} {' '.join(edited)} the end of the text")
        docs.append(" ".join(words[: len(words) // 2]))
    docs.append(" ".join(r.choice(" ".join(t for _, t in TEXTS).split()) for _ in range(20_000)))
    got = {x["doc_id"]: (x["labels"], round(x["score"], 9)) for x in scan(table(spark, docs)).collect()}
    assert got == {k: brute_labels(d) for k, d in enumerate(docs)}
    whole = [k for k in range(len(NOTICES) * 4, len(docs) - 1) if k % 4 == 0]
    assert all(TEXTS[k // 4 - len(NOTICES)][0] in got[k][0].split(",") and got[k][1] == 1 for k in whole)
