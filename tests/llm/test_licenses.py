import random

import pytest

from quillon.llm import licenses

from .helpers import docs, sentence
from .test_decontam import words


def brute(rows):
    out = []
    for i, text in rows:
        w, places, base = words(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            for x in range(len(w) - len(p) + 1):
                if w[x : x + len(p)] == p:
                    places.append(x)
                    base.add(label)
        labels, best = set(base), 0.0
        for line in (text or "").split("\n"):
            have = set(words(line))
            for label, notice in licenses.TEMPLATES:
                t = set(words(notice))
                if 10 * len(t & have) >= 9 * len(t):
                    labels.add(label)
                    best = max(best, len(t & have) / len(t))
        out.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_as_brute_force(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(90, None), (91, ""), (92, "..\n"), (93, "cc by cc by, CC-BY!"), (94, "all rights\nreserved"), (94, "all rights\nreserved"), (95, "license " * 5000 + "cc by")]
    for i in range(60):
        t = list(words(rnd.choice(licenses.TEMPLATES)[1]))
        for _ in range(rnd.choice((0, 0, 1, 2))):
            t[rnd.randrange(len(t))] = rnd.choice(("zzz", "the", "license"))
        if rnd.random() < 0.3:
            rnd.shuffle(t)
        rows.append((i, sentence(rnd, rnd.randint(0, 30)) + rnd.choice(("\n", " ", ". ")) + " ".join(t).title() + rnd.choice(("\n", " x ")) + sentence(rnd, 5)))
    found = licenses.scan(docs(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert licenses.scan(docs(spark, [])).count() == 0


def test_clashing_columns_are_replaced(spark):
    frame = spark.createDataFrame([(1, "x cc by", "mine", 7)], "doc_id long, text string, labels string, other int")
    row = licenses.scan(frame).first()
    assert (row["labels"], row["other"]) == ("cc-by", 7)


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the"
BSD = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"


@pytest.mark.parametrize(
    "text, labels, line",
    [
        (f"Copyright\n\n{MIT} Software)\n\nx", "mit", 2),
        (f"/*\n{BSD}\n *\n */\nint x;", "bsd", 1),
        (BSD.replace("\n", "\n\n").replace("Redis", "x\n\ny\n\nRedis"), "bsd", 4),
        (MIT.replace("\n", "\n\n"), "mit", 0),
        ("licensed under cc\nby nc 4.0\n" + "x " * 30 + "nd", "cc-by,cc-by-nc", 0),
        ("nd\nlicensed under cc by nc 4.0", "cc-by,cc-by-nc", 1),
        ("the\nterms of\nthis work\n" + BSD.replace("forms", "kinds").replace("source", "text").replace("met", "kept"), "", None),
        (MIT.replace("\n", " x\n\n" + "y " * 30), "", None),
    ],
)
def test_wrapped_notices(spark, text, labels, line):
    row = licenses.scan(docs(spark, [(1, text)])).first()
    assert row["labels"] == labels
    assert [b["line"] for b in row["blocks"]] == ([] if line is None else [line])


@pytest.mark.parametrize("seed", range(3))
def test_windows_as_brute_force(seed):
    rnd = random.Random(seed)
    matcher = licenses.Matcher(licenses.TEMPLATES, {}, {}, 90)
    for _ in range(60):
        number = rnd.randrange(len(matcher.templates))
        label, order, need, size = matcher.templates[number]
        assert size >= len(order)
        text = []
        for w in words(licenses.TEMPLATES[number][1]) * 2:
            text += [w] * rnd.choice((0, 1, 1, 1, 1, 1, 1, 1, 1)) + ["zzz"] * rnd.choice((0, 0, 0, 0, 0, 0, 1))
            text += ["zzz"] * rnd.choice((0, 0, 0, 0, 0, 30))
        text = [w.encode() for w in text]
        want = max((len(set(text[i : i + size]) & set(order)) for i in range(len(text))), default=0)
        got = [round(c * len(order)) for _, _, c in matcher.windows(number, text)]
        assert max(got, default=0) == (want if want >= need else 0)
