import random
import zlib
from collections import Counter

import numpy as np

from quillon.llm import langid

from .helpers import docs

ALPHABETS = {"aa": "abcdefgh", "bb": "fghijklm", "cc": "éèàçklmn", "dd": "привет", "ee": "𐐨𐐩𐐪ab"}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(ALPHABETS[lang]) for _ in range(rnd.randint(2, 8))) for _ in range(n)).title()


def plain_grams(t):
    run = "".join(c if c.isalpha() else " " for c in t.lower()).split()
    out = Counter()
    for w in run:
        padded = f" {w} "
        for n in (1, 2, 3):
            out.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " " and g.strip())
    return out


def test_grams_as_plain_loop():
    texts = ["Ab, ab1c é!", "", "123", "x", "  Zz\n\nzz ", "ÀB"]
    whose, _, count = langid.grams(texts)
    for i, t in enumerate(texts):
        assert sorted(count[whose == i].tolist()) == sorted(plain_grams(t).values())


def test_held_out_accuracy(spark):
    rnd = random.Random(1)
    rows = [(i, text(rnd, lang := rnd.choice(list(ALPHABETS)), rnd.randint(3, 60)), lang, "s") for i in range(500)]
    rows += [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 !?", "bb", "s"), (903, text(rnd, "bb", 50), None, "s"), (0, *rows[0][1:]), (None, "abc abc", "aa", "s")]
    frame = docs(spark, rows)
    got = langid.identify(frame.select("doc_id", "text", "lang"), langid.fit(frame)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 500 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) > 0
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[900] == by[901] == by[902] == ("und", 0.0)
    assert by[903][0] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_distance_by_hand():
    profiles = langid.Profiles([("x", ord("a"), 0), ("x", ord("b"), 1), ("y", ord("b"), 0)], 300)
    # ranks of 'a a b': blanks and letters by count, then by code; both lack the longer n-grams alike
    langs, scores = profiles.predict(["a a b", "b", ""])
    assert langs == ["x", "y", "und"]
    assert scores[2] == 0


def test_nothing_to_learn(spark):
    frame = docs(spark, [(1, "abc", None, "s")])
    assert langid.identify(frame.select("doc_id", "text"), langid.fit(frame)).first()["lang_pred"] == "und"
    assert langid.identify(docs(spark, []), langid.Profiles([], 300)).count() == 0


def test_long_text_is_read_whole():
    profiles = langid.Profiles([("x", ord("a"), 0), ("y", ord("b"), 0)], 300)
    assert profiles.predict(["a " * 1000 + "b " * 500_000])[0] == ["y"]
    assert np.all(langid.grams(["a" * 300_000])[2] > 0)


def code(gram):
    out = 0
    for c in gram:
        out = out << 16 | (langid.BLANK if c == " " else ord(c))
    return out


def ranking(counts, top):
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:top])}


def plain(rows, top):
    """lang_pred and score of every row, by loops over dictionaries."""
    learned = {}
    for i, t, lang, _ in rows:
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            learned.setdefault(lang, Counter()).update(plain_grams(t or ""))
    profiles = {lang: ranking(c, top) for lang, c in learned.items() if c}
    out = []
    for i, t, *_ in rows:
        own = ranking(plain_grams(t or ""), top)
        if not own or not profiles:
            out.append((i, "und", 0.0))
            continue
        far = sorted((sum(abs(p[g] - r) if g in p else top for g, r in own.items()), lang) for lang, p in profiles.items())
        lead = 1.0 if len(far) == 1 else 0.5 + 0.5 * (far[1][0] - far[0][0]) / max(far[1][0], 1)
        out.append((i, far[0][1], lead))
    return sorted(out, key=repr)


def test_whole_queries_as_plain_loops(spark, tmp_path):
    rnd = random.Random(4)
    names = ["aa", "bb", "cc", "dd"]
    rows = [(i, text(rnd, lang := rnd.choice(names), rnd.randint(0, 30)) + rnd.choice(["", " 12!", "\n", " É"]), lang, "s") for i in range(120)]
    rows += [(900, None, "aa", "s"), (901, "", None, "s"), (902, "-- 7", "bb", "s"), (0, *rows[0][1:]), (None, "abc abc", "zz", "s")]
    frame = docs(spark, rows)
    for top in (5, 300):
        got = langid.identify(frame.select("doc_id", "text"), langid.fit(frame, top=top)).collect()
        assert sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in got), key=repr) == plain(rows, top)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.query(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in got), key=repr) == plain(rows, 300)


def test_more_texts_than_16_bits_number():
    profiles = langid.Profiles([("x", ord("a"), 0), ("y", ord("b"), 0)], 300)
    texts = ["a", "b", ""] * 30_000
    assert profiles.predict(texts)[0] == ["x", "y", "und"] * 30_000


def test_clashing_columns(spark):
    frame = docs(spark, [(1, "abc", "aa", "s")]).withColumnsRenamed({"source": "lang_pred", "n_chars": "score"})
    got = langid.identify(frame, langid.Profiles([("x", ord("a"), 0)], 300))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert tuple(got.first())[3:] == ("x", 1.0)
