import hashlib
import random
import re

import pytest

from quillon.llm import decontam

from .helpers import docs, save, sentence


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute(rows, items):
    out = []
    for i, text in rows:
        d, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(13, len(b))
            for x in range(len(b) - n + 1 if b else 0):
                for y in range(len(d) - n + 1):
                    if d[y : y + n] == b[x : x + n]:
                        hit |= set(range(y, y + n))
                        found.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(d), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(d)))
    return sorted(out, key=repr)


def tables(spark, seed):
    rnd = random.Random(seed)
    items = [(i, sentence(rnd, rnd.choice((2, 5, 13, 14, 30)))) for i in range(12)] + [(20, None), (21, "..."), (22, "")]
    items += [(23, items[0][1])]
    rows = [(i, sentence(rnd, rnd.randint(0, 200))) for i in range(20)] + [(90, None), (91, ""), (92, "-- !!")]
    for i in range(20):
        w = words(rnd.choice(items[:12])[1])
        a = rnd.randint(0, 3)
        rows.append((100 + i, sentence(rnd, rnd.randint(0, 400)) + ", " + "; ".join(w[a:]).upper() + " - " + sentence(rnd, 20)))
    rows.append(rows[-1])
    return rows, items


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force(spark, tmp_path, seed):
    rows, items = tables(spark, seed)
    folder = save(spark, tmp_path, documents=docs(spark, rows), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, decontam.query(spark, folder).collect()), key=repr) == brute(rows, items)


def test_pieces_and_spans():
    machine = decontam.Automaton([(1, "a b c d e f g h i j k l m n"), (2, "x y")], 13)
    data = ("zz " * 50 + "É, A b-c d e f g h i j k l m!! X  y qq").encode()
    for piece in (1, 7, 40, 1 << 20):
        n, runs, found = machine.scan(data, piece)
        assert (n, runs, found) == (67, [(51, 66)], {1, 2})
    (span,) = decontam.character_spans(data, runs)
    assert data.decode()[span["start"] : span["end"]] == "A b-c d e f g h i j k l m!! X  y"


def test_short_items_in_texts_of_many_pieces():
    machine = decontam.Automaton([(1, "yes")], 13)
    data = b"yes no no no yes no no no no no no no"
    assert {machine.scan(data, piece)[1] == [(0, 1), (4, 5)] for piece in (20, 1 << 20)} == {True}
    rnd = random.Random(3)
    for _ in range(40):
        items = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.choice((1, 1, 2, 3, 5))))) for i in range(4)]
        machine = decontam.Automaton(items, 4)
        text = " ".join(rnd.choice("abcdddd") for _ in range(rnd.randint(1, 80))).encode()
        whole = machine.scan(text)
        assert all(machine.scan(text, piece) == whole for piece in (1, 3, 8, 20))


def test_text_over_the_piece(spark):
    clean = "filler " * 700_000
    got = decontam.scan(docs(spark, [(1, "yes " + clean + "yes of course"), (2, clean)]), spark.createDataFrame([(1, "yes"), (2, "of course")], "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(700_004, 4, 2, False), (700_000, 0, 0, False)]


def test_empty_tables_and_clashes(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(docs(spark, [(1, "a b")]), bench).first()["contaminated"] is False
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.scan(docs(spark, []), items).count() == 0
    clash = spark.createDataFrame([(1, "x a b c", "mine"), (2, "x", "yours")], "doc_id long, text string, n_words string")
    assert [tuple(r) for r in decontam.remove_contaminated(clash, items).collect()] == [(2, "x", "yours")]


def test_size_is_checked(spark):
    with pytest.raises(ValueError, match="the benchmark has"):
        decontam.scan(docs(spark, [(1, "a")]), spark.createDataFrame([(1, "word " * 100)], "item_id long, text string"), max_words=10)


@pytest.mark.parametrize("max_words", (200,))
def test_large_benchmark_is_scanned_in_blocks(spark, tmp_path, max_words):
    rows, items = tables(spark, 7)
    rnd = random.Random(8)
    items = [*items, (30, sentence(rnd, 400)), (31, "ß-é " * 40), (30, items[3][1]), (31, "ß-é " * 40)]
    long = words(items[-4][1])
    rows += [(200, "x " + " ".join(long)), (201, " ".join(long[100:150]) + " y"), (201, "ß é " * 7 + "z")]
    frame, bench = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    whole = decontam.scan(frame, bench)
    with pytest.raises(ValueError, match="the benchmark has"):
        decontam.scan(frame, bench, max_words=max_words)
    got = decontam.scan_all(frame, bench, max_words=max_words)
    assert got.columns == whole.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    pieces, n_blocks = decontam._blocks(bench, 13, 12 * max_words)
    sizes = [sum(len(r["text"]) for r in pieces.collect() if r["block"] == k) for k in range(n_blocks)]
    assert n_blocks > 1 and max(sizes) <= max(12 * max_words, max(len(r["text"]) for r in pieces.collect()))
    kept = decontam.remove_contaminated(frame, bench, max_words=max_words)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, decontam.remove_contaminated(frame, bench).collect()), key=repr)
