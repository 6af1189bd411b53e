"""Raw values in documents: against a plain search of every value in every document."""

import random

import pytest

from tallyglass.operators import leaks
from tallyglass.operators.leaks import leaked_values


def plain(docs, values, least):
    out = set()
    for path, text in docs:
        text = f" {text or ''} "
        for field, v in values:
            if v is None or len(v) < least:
                continue
            at = [i for i in range(len(text)) if text.startswith(v, i)]
            if any(not text[i - 1].isalnum() and not text[i + len(v)].isalnum() for i in at if 0 < i < len(text) - len(v)):
                out.add((path, field, v, "plain"))
            if v.encode().hex() in text:
                out.add((path, field, v, "hex"))
    return out


def test_leaks_are_those_of_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PIECE", 40)  # many pieces, so that values cross their ends
    g = random.Random(4)
    word = lambda n: "".join(g.choice("ab1.-é\\") for _ in range(n))
    values = [("f", word(g.randrange(5, 14))) for _ in range(60)] + [("g", r"x\E[a-z]+\Q"), ("f", None), ("g", "same value"), ("f", "same value"), ("g", "short"), ("g", "z" * 90)]
    docs = []
    for i in range(60):
        parts = [word(g.randrange(0, 60))]
        for _ in range(3):
            v = g.choice(values)[1] or ""
            parts += [g.choice(["", " ", "é", "/", '"']), g.choice([v, v.encode().hex(), v + "a"]), g.choice(["", ",", "7"]), word(g.randrange(30))]
        docs.append((f"d{i}", "".join(parts)))
    docs += [("null", None), ("empty", ""), ("twice", "same value"), ("twice", "same value"), ("long", "y" * 30_000 + " same value " + "y" * 10)]
    d = spark.createDataFrame([(*r, "mine") for r in docs], "path string, document string, value string").repartition(3)
    s = spark.createDataFrame([(v if f == "f" else None, v if f == "g" else None, "x") for f, v in values], "f string, g string, gram string")
    got = [tuple(r) for r in leaked_values(d, s, ["f", "g"], least=6).collect()]
    want = plain(docs, values, 6)
    assert len(got) == len(set(got)) and set(got) == want and {w[3] for w in want} == {"plain", "hex"}
    assert leaked_values(d.limit(0), s, ["f"]).count() == 0 and leaked_values(d, s.limit(0), ["f"]).count() == 0
    with pytest.raises(ValueError):
        leaked_values(d, s, ["f"], least=3)
    with pytest.raises(ValueError):
        leaked_values(d, s, [])
