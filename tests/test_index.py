import random
from collections import Counter

import pyarrow as pa
import pytest

import quillon
from quillon import cli
from quillon.operators import lists, tables
from quillon.sources import ciff
from quillon.sources.runs import result_frame, run_lines, write_run
from quillon.sources.storage import numbered

HEADER = ciff.Header(1, 13, 39, 399, 200, 888, 12.7, "Test description")
TEXT = """----- CIFF HEADER -----
Version: 1
No. Postings Lists: 13
Total Postings Lists: 399
No. Documents: 39
Total Documents: 200
Total Terms in Collection 888
Average Document Length: 12.7
Description: Test description
-----------------------"""
VECTORS = [("doc1", {"a": 1, "b": 5, "c": 8}), ("doc2", {"a": 2, "c": 1, "d": 8, "f": 2})]


def test_header_text():
    assert str(HEADER) == TEXT


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame(VECTORS, "docno string, toks map<string,int>")


@pytest.fixture
def ciff_file(tmp_path):
    path = str(tmp_path / "a.ciff")
    lists = [("a", [(0, 1), (1, 2)]), ("b", [(0, 5)]), ("c", [(0, 8), (1, 1)]), ("d", [(1, 8)]), ("f", [(1, 2)])]
    ciff.write(path, ciff.Header(1, 5, 2, 5, 2, 7, 13.5, "x"), lists, [("doc1", 14), ("doc2", 13)])
    return path


def test_ciff_tables(spark, ciff_file):
    assert ciff.read_header(ciff_file).num_docs == 2
    rows = ciff.read(spark, ciff_file).orderBy("ordinal").collect()
    assert [(r["term"], r["df"], [tuple(p) for p in r["postings"]]) for r in rows][:2] == [("a", 2, [(0, 1), (1, 2)]), ("b", 1, [(0, 5)])]
    assert [tuple(r) for r in ciff.read(spark, ciff_file, "docs").orderBy("doc_id").collect()] == [(0, "doc1", 14), (1, "doc2", 13)]


def test_ciff_refuses(tmp_path):
    path = str(tmp_path / "b.ciff")
    ciff.write(path, ciff.Header(1, 0, -1), [], [])
    with pytest.raises(ValueError, match="number of documents is negative"):
        ciff.read_header(path)


def test_ciff_documents_in_order(tmp_path):
    path = str(tmp_path / "c.ciff")
    ciff.write(path, ciff.Header(1, 0, 2), [], [("x", 1)])
    with open(path, "ab") as f:
        body = ciff._put(1, 5) + ciff._put(2, "y")
        f.write(ciff._put_varint(len(body)) + body)
    with pytest.raises(ValueError, match="must come in order"):
        list(ciff.CiffReader(path, "docs").read(None))


def test_searcher(spark, vectors, tmp_path):
    quillon.SparseIndex.from_vectors(vectors, 32).save(str(tmp_path / "i"))
    with quillon.Searcher(spark, str(tmp_path / "i")) as s:
        assert s.search({"a": 5.3, "c": 1.1}, 10) == (["doc1", "doc2"], [88.0, 71.0])
        assert s.search({"zzz": 1.0}, 10) == ([], [])
        assert s.search({}, 10) == ([], [])
    with pytest.raises(Exception, match="(?i)exist"):
        quillon.SparseIndex.from_vectors(vectors, 32).save(str(tmp_path / "i"))


def test_all_ways_build_the_same(spark, vectors, ciff_file, tmp_path):
    one = quillon.SparseIndex.from_vectors(vectors, 1, compress_range=False).save(str(tmp_path / "one"))
    two = quillon.build_from_ciff(spark, ciff_file, str(tmp_path / "two"), 1)
    three = quillon.Indexer(spark, str(tmp_path / "three"), 1)
    four = quillon.InvertedIndexer(spark, str(tmp_path / "four"), 1)
    names = ["a", "b", "c", "d", "f"]
    for docno, toks in VECTORS:
        three.add_document(docno, toks)
        four.add_document(docno, [(names.index(t), w) for t, w in toks.items()])
    for name in names:
        four.add_term(name, [(i, toks[name]) for i, (_, toks) in enumerate(VECTORS) if name in toks])
    found = [one, two, three.finish(), four.finish()]
    assert len({tuple(sorted(map(tuple, x.postings.select("doc_id", "term_id", "impact").collect()))) for x in found}) == 1
    assert one.statistics() == {"n_blocks": 2, "terms_per_block": 3, "docs_per_term": 1.0}
    assert spark.read.parquet(str(tmp_path / "one/block_max_raw")).count() == 5
    with pytest.raises(RuntimeError, match="finished"):
        three.finish()


def test_refusals(spark, vectors):
    docs = spark.createDataFrame([(0, "d")], "doc_id long, docno string")
    lists = spark.createDataFrame([("t", [(3, 1)])], "term string, postings array<struct<doc_id:long,impact:int>>")
    with pytest.raises(Exception, match="not there"):
        quillon.SparseIndex.from_postings(docs, lists, 1)
    with pytest.raises(ValueError, match="twice"):
        quillon.SparseIndex.from_postings(docs, lists.union(lists), 1)
    with pytest.raises(ValueError, match="differ"):
        quillon.SparseIndex.from_postings(docs, lists, 1, spark.createDataFrame([(0, "t", 1)], "doc_id long, term string, impact int"))
    with pytest.raises(ValueError, match="block"):
        quillon.SparseIndex.from_vectors(vectors, 0)
    with pytest.raises(Exception, match="impact outside"):
        quillon.SparseIndex.from_vectors(spark.createDataFrame([("d", {"a": 2.56})], "docno string, toks map<string,double>"), 1)


def test_float_vectors_and_equal_names(spark):
    frame = spark.createDataFrame([("d", {"a": 0.29}), ("d", {"a": 1.0})], "docno string, toks map<string,double>")
    with pytest.warns(UserWarning, match="equal names"):
        index = quillon.SparseIndex.from_vectors(frame, 4)
    assert sorted(r["impact"] for r in index.postings.collect()) == [28, 100]


def test_handle_and_retriever(spark, vectors, tmp_path):
    frame = spark.createDataFrame([(1, "first", {"a": 5.3, "c": 1.1}), (2, "second", {"d": 1.0})], "qid int, note string, query_toks map<string,float>")
    with quillon.IndexHandle(spark, str(tmp_path / "h")) as handle:
        assert not handle.built()
        handle.indexer(bsize=32)(vectors)
        with pytest.raises(FileExistsError):
            handle.index(vectors)
        rows = handle.transform(frame).orderBy("qid", "rank").collect()
        assert [(r["qid"], r["note"], r["docno"], r["score"], r["rank"]) for r in rows] == [(1, "first", "doc1", 88.0, 0), (1, "first", "doc2", 71.0, 1), (2, "second", "doc2", 256.0, 0)]
        wide = handle.retriever(10)
        assert wide.fuse_rank_cutoff(1).transform(frame).count() == 2
        assert wide.fuse_rank_cutoff(10) is wide
        with pytest.raises(ValueError, match="query_toks"):
            wide.transform(frame.drop("query_toks"))


def test_run_lines(spark, tmp_path):
    hits = spark.createDataFrame([("q1", "d2", 7, 1), ("q1", "d1", 3, 2)], "qid string, docno string, score long, rank long")
    assert [r["value"] for r in run_lines(hits, "T").orderBy("rank").collect()] == ["q1 Q0 d2 1 7 T", "q1 Q0 d1 2 3 T"]
    write_run(hits, str(tmp_path / "run"))
    assert spark.read.text(str(tmp_path / "run")).count() == 2
    assert result_frame(hits, spark.createDataFrame([("q1", 5)], "qid string, n int")).orderBy("rank").first()["rank"] == 0


def test_command_line(spark, ciff_file, tmp_path, capsys, monkeypatch):
    (tmp_path / "q.txt").write_text("q1: a a c\nq4: a a a b b c\n")
    assert cli.main(["index", "-c", ciff_file, "-o", str(tmp_path / "x"), "-b", "1"]) == 0
    assert cli.main(["search", "-i", str(tmp_path / "x"), "-q", str(tmp_path / "q.txt"), "-k", "10", "-t", "T"]) == 0
    assert capsys.readouterr().out == "q1 Q0 doc1 1 10 T\nq1 Q0 doc2 2 5 T\nq4 Q0 doc1 1 21 T\nq4 Q0 doc2 2 7 T\n"
    assert cli.main(["search", "-i", str(tmp_path / "none"), "-q", str(tmp_path / "q.txt"), "-k", "1"]) == 1


def test_numbered_is_dense(spark):
    got = numbered(spark.range(0, 1000, 1, 7).where("id % 3 = 0"), "n").orderBy("n").collect()
    assert [(r["id"], r["n"]) for r in got] == [(3 * i, i) for i in range(334)]


def test_stream(spark, vectors, tmp_path):
    from quillon.streaming.search import search_stream

    index = quillon.SparseIndex.from_vectors(vectors, 1)
    spark.createDataFrame([("q", "a", 1)], "qid string, term string, weight int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid string, term string, weight int").parquet(str(tmp_path / "in"))
    search_stream(index, stream, str(tmp_path / "out"), str(tmp_path / "ck"), 10).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("rank").collect()
    assert [(r["docno"], r["score"]) for r in got] == [("doc2", 2), ("doc1", 1)]


def test_frames_as_transformers(spark, tmp_path):
    import pandas as pd

    from quillon.transformers import FrameIndex

    handle = quillon.IndexHandle(spark, str(tmp_path / "t"))
    index = FrameIndex(handle).index({"docno": d, "toks": t} for d, t in [*VECTORS, ("doc3", {"c": 0.29}), ("doc4", {})])
    with pytest.raises(FileExistsError):
        index.index([])
    frame = pd.DataFrame({"qid": ["x", "y", "x"], "query_toks": [{"a": 5.3, "c": 1.1}, {"zzz": 1.0}, {"c": 2}], "note": [1, 2, 3]})
    got = index(frame)
    assert list(got.columns) == ["qid", "query_toks", "note", "docno", "score", "rank"]
    assert got[["note", "docno", "score", "rank"]].to_numpy().tolist() == [[1, "doc3", 196.0, 0], [1, "doc1", 88.0, 1], [1, "doc2", 71.0, 2], [3, "doc3", 896.0, 0], [3, "doc1", 256.0, 1], [3, "doc2", 32.0, 2]]
    cut = index.retriever(3).fuse_rank_cutoff(1)
    assert len(cut.transform(frame)) == 2
    assert index.retriever(3).fuse_rank_cutoff(3) is None
    with pytest.raises(ValueError, match="query_toks"):
        index.transform(frame.drop(columns="query_toks"))
    assert len(index.transform(frame.iloc[:0])) == 0


def test_rows_given_one_by_one_are_spooled(spark, tmp_path):
    indexer = quillon.Indexer(spark, str(tmp_path / "s"), 2)
    indexer.rows.limit = 3
    for i in range(10):
        indexer.add_document(f"d{i}", {"a": i})
    assert len(indexer.rows.rows) < 3
    index = indexer.finish()
    assert [tuple(r) for r in index.docs.orderBy("doc_id").collect()] == [(i, f"d{i}") for i in range(10)]
    assert sorted((r["doc_id"], r["impact"]) for r in index.postings.collect()) == [(i, i) for i in range(10)]
    lists = quillon.InvertedIndexer(spark, str(tmp_path / "u"), 2)
    lists.add_document("d", [(5, 1)])
    lists.add_term("t", [(0, 1)])
    with pytest.raises(Exception, match="a term that is not there: 5"):
        lists.finish()


def test_order_statistics_of_wrapped_impacts_come_before_the_wrap(spark):
    frame = spark.createDataFrame([(f"d{i}", {"a": w}) for i, w in enumerate([300, 290, 280, 270, 265, 264, 263, 262, 261, 260, 5])], "docno string, toks map<string,int>")
    index = quillon.SparseIndex.from_vectors(frame, 4, impacts="wrap")
    # the tenth of the whole impacts is 260, whose low byte is 4; of the wrapped ones it would be 5
    assert index.terms.first()["k10"] == 4
    assert index.terms.first()["max_impact"] == 44


def test_gaps_over_many_ranges(spark):
    from quillon.operators import tables

    rows = [(d, t, d % 7 + 1) for t, step in (("a", 1), ("b", 7), ("c", 40)) for d in range(3, 100, step)] + [(0, "a", 9), (99, "z", 1)]
    base = spark.createDataFrame(rows, "doc_id long, term string, impact int")
    gaps = tables.encode_gaps(base, span=8)
    want, last = [], {}
    for d, t, w in sorted(rows, key=lambda r: (r[1], r[0])):
        pos, before = last.get(t, (-1, 0))
        want.append((t, pos + 1, d - before, w))
        last[t] = (pos + 1, d)
    assert sorted(map(tuple, gaps.collect())) == sorted(want)
    assert sorted(map(tuple, tables.decode_gaps(gaps, span=5).collect())) == sorted((t, d, w) for d, t, w in rows)
    lists = spark.createDataFrame([("a", [(3, 1), (2, 5)]), ("b", []), ("n", None), ("c", [(0, 2)])], "term string, postings array<struct<gap:int,tf:int>>")
    assert sorted(map(tuple, tables.decode_gap_lists(lists.coalesce(1)).collect())) == [("a", 3, 1), ("a", 5, 5), ("c", 0, 2)]


def test_dense_maxima_hold_only_runs_with_one(spark):
    from quillon.operators import tables

    maxima = spark.createDataFrame([("a", 0, 3), ("a", 255, 4), ("a", 256, 5), ("b", 100_000, 7)], "term string, block_id int, max_impact smallint")
    raw = tables.raw_maxima(maxima, 100_001)
    assert sorted((r["term"], r["superblock"], len(r["maxima"])) for r in raw.collect()) == [("a", 0, 256), ("a", 1, 256), ("b", 390, 161)]
    assert sorted(map(tuple, tables.from_raw(raw).collect())) == sorted(map(tuple, maxima.collect()))


def test_saved_index_leaves_no_steps(spark, vectors, tmp_path):
    index = quillon.SparseIndex.from_vectors(vectors, 1)
    steps = [x._step_path for x in index._steps]
    kept = index.save(str(tmp_path / "k"))
    from pathlib import Path

    assert steps and not any(Path(p.removeprefix("file://")).exists() for p in steps)
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, kept.postings.collect()))


def test_saved_postings_are_summed_where_they_lie(spark, tmp_path):
    rows = [(f"d{i}", {f"t{j}": (i * j) % 5 + 1 for j in range(6) if (i + j) % 3}) for i in range(200)]
    built = quillon.SparseIndex.from_vectors(spark.createDataFrame(rows, "docno string, toks map<string,int>"), 8)
    asked = spark.createDataFrame([(q, f"t{t}", t + 1) for q in range(5) for t in range(q + 1)], "qid long, term string, weight int")
    before = sorted(map(tuple, built.search(asked, 7).collect()))
    kept = built.save(str(tmp_path / "b"))
    found = quillon.SparseIndex.load(spark, str(tmp_path / "b")).search(asked, 7)
    assert sorted(map(tuple, found.collect())) == before == sorted(map(tuple, built.search(asked, 7).collect()))
    assert kept.about.buckets > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" in plan
    assert "doc_id#" not in "".join(line for line in plan.splitlines() if "hashpartitioning(qid" in line)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("written_", "read_"))]
    assert sorted(map(tuple, kept.search(asked, 7, prune=True).collect())) == before


def _ciff_lists():
    return [("a", [(0, 1), (1, 2), (300, 255)]), ("b", [(0, 5)]), ("c", [(7, 128), (40_000, 1)]), ("é", [(i, 1 + i % 200) for i in range(0, 3000, 3)])]


@pytest.mark.parametrize("run_bytes", [1, 40, 1 << 20])
def test_ciff_is_read_in_runs(tmp_path, run_bytes):
    """Runs of whole messages, each read by itself, hold every list and record once, in order."""
    path = str(tmp_path / "r.ciff")
    given, docs = _ciff_lists(), [(f"d{i}", i % 3) for i in range(50)]
    ciff.write(path, ciff.Header(1, len(given), len(docs)), given, docs)
    for table in ("postings", "docs"):
        reader = ciff.CiffReader(path, table, run_bytes)
        runs = reader.partitions()
        assert len(runs) == (1 if run_bytes > 40_000 else len(runs)) and (run_bytes > 1 or len(runs) == (len(given) if table == "postings" else len(docs)))
        rows = [row for run in runs for batch in reader.read(run) for row in batch.to_pylist()]
        if table == "docs":
            assert [(r["doc_id"], r["docno"], r["doclength"]) for r in rows] == [(i, *d) for i, d in enumerate(docs)]
            continue
        back = []
        for r in rows:
            last, pairs = 0, []
            for p in r["postings"]:
                last += p["gap"]
                pairs.append((last, p["tf"]))
            back.append((r["term"], pairs))
        assert back == given and [r["ordinal"] for r in rows] == list(range(len(given)))
        assert [(r["df"], r["cf"]) for r in rows] == [(len(x), sum(tf for _, tf in x)) for _, x in given]


def test_ciff_lists_of_other_writers(tmp_path):
    """Fields in another order, unknown ones, zeros left out and long varints are read as before."""
    pair = lambda *parts: ciff._put(4, b"".join(parts))
    odd = [
        pair(ciff._put(2, 3), ciff._put(1, 4)) + ciff._put(1, "x"),
        ciff._put(1, "y") + ciff._put(2, 2) + pair(ciff._put(1, 4)) + pair(),
        ciff._put(1, "z") + ciff._put(9, "more") + pair(ciff._put(1, 1), ciff._put(2, -1)),
        ciff._put(1, "w") + pair(ciff._put_varint(8) + b"\x84\x00", ciff._put(2, 9)),
    ]
    path = str(tmp_path / "o.ciff")
    ciff.write(path, ciff.Header(1, len(odd), 0), [], [])
    with open(path, "ab") as f:
        f.write(b"".join(ciff._put_varint(len(x)) + x for x in odd))
    for run_bytes in (1, 1 << 20):
        reader = ciff.CiffReader(path, "postings", run_bytes)
        rows = [r for run in reader.partitions() for b in reader.read(run) for r in b.to_pylist()]
        assert [(r["term"], [(p["gap"], p["tf"]) for p in r["postings"]]) for r in rows] == [("x", [(4, 3)]), ("y", [(4, 0), (0, 0)]), ("z", [(1, -1)]), ("w", [(4, 9)])]
    with open(path, "r+b") as f:
        f.truncate(f.seek(0, 2) - 1)
    with pytest.raises(EOFError):
        list(ciff.CiffReader(path, "postings").read(None))


def test_ciff_written_by_tasks(spark, tmp_path):
    """Frames give the bytes that one writer gives; a term's rows may come in any order and number."""
    given, docs = _ciff_lists(), [(f"d{i}", i % 3) for i in range(50)]
    rows = [(t, [d for d, _ in some], [tf for _, tf in some]) for t, pairs in given for some in (pairs[len(pairs) // 2 :], pairs[: len(pairs) // 2]) if some]
    frame = spark.createDataFrame(rows, "term string, docs array<bigint>, impacts array<int>").repartition(3)
    header = ciff.write_frames(str(tmp_path / "many"), frame, spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "ordinal long, docno string, doclength int"), "x")
    ciff.write(str(tmp_path / "one"), header, given, docs)
    assert (tmp_path / "many").read_bytes() == (tmp_path / "one").read_bytes()
    assert len(ciff.CiffReader(str(tmp_path / "many"), "postings", 10).partitions()) > 1


def test_counted_lists(spark):
    """Tokens part at ASCII white space but vertical tabs, rows of one document count together, up to the top."""
    texts = [(3, "a b c a"), (1, " a\tb\n\n"), (3, "a " * 300), (2, None), (4, "x\x0by x\x0by\rz\x1cz"), (5, "")]
    for run_bytes in (1, 1 << 20):
        got = lists.counted(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), 255, run_bytes=run_bytes).collect()
        pairs = sorted((r["term"], d, n) for r in got for d, n in zip(r["docs"], r["impacts"]))
        assert pairs == [("a", 1, 1), ("a", 3, 255), ("b", 1, 1), ("b c", 3, 1), ("x\x0by", 4, 2), ("z\x1cz", 4, 1)]


def test_gap_list_sums(spark):
    rows = [(1, [(0, 2), (3, 1)]), (2, []), (3, None), (4, [(7, 255)])]
    frame = spark.createDataFrame(rows, "term int, postings array<struct<gap:int,tf:int>>").coalesce(1)
    assert sorted(map(tuple, tables.gap_list_sums(frame, ["term"]).collect())) == [(1, 2, 3, 3, 3), (4, 1, 7, 7, 255)]


def test_whole_terms_against_loops():
    """Statistics, postings and block maxima of terms whose rows come in several lists, some pairs given twice."""
    rng, n_docs = random.Random(3), 40 * lists.ROW_BLOCKS
    rows, sums = [], {}
    for term, n in (("a", 1), ("b", 30), ("c", 1500)):
        for _ in range(3):
            docs = sorted(rng.sample(range(n_docs), n))
            rows.append((term, docs, [rng.randrange(200) for _ in docs]))
            for d, x in zip(*rows[-1][1:]):
                sums[term, d] = sums.get((term, d), 0) + x
    table = pa.table({"term": [r[0] for r in rows], "docs": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "impacts": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})
    batch, n = lists.term_rows(table, 0, 5, n_docs, 32, "clip")
    got = batch.to_pylist()
    assert n == 3 and len(got) > 3 and [r["term"] for r in got if r["term"]] == ["a", "b", "c"]
    for place, term in enumerate("abc", 5):
        own, mine = {d: min(255, x) for (t, d), x in sums.items() if t == term}, [r for r in got if r["place"] == place]
        assert {d: x for r in mine for d, x in zip(r["docs"], r["impacts"])} == own and mine[0]["df"] == len(own)
        ranked = [*sorted(own.values(), reverse=True), *[0] * 1000]
        assert [mine[0][x] for x in lists.STATISTICS] == [ranked[0], *(ranked[k - 1] if k <= len(own) else 0 for k in (10, 100, 1000))]
        best = {}
        for d, x in own.items():
            if x:
                best[d // 32] = max(best.get(d // 32, 0), x)
        assert [(b, m) for r in mine for b, m in zip(r["blocks"], r["maxima"])] == sorted(best.items())


def test_ciff_of_texts(spark, tmp_path):
    """Texts are counted where they are read: documents in any order, some in several tasks, give the bytes of one writer."""
    rng = random.Random(5)
    texts = [(rng.randrange(40), " ".join(rng.choice(["a", "b", "é", "zz", "x\x0by", "ω" * 50]) for _ in range(rng.randrange(30)))) for _ in range(200)]
    texts += [(300, "a " * 300), (300_000, "a rare"), (7, None), (8, ""), (None, "not there")]
    sums: dict = {}
    for doc, text in texts:
        for term in (text or "").split(" ") if doc is not None else []:
            if term:
                sums.setdefault(term, Counter())[doc] += 1
    given = [(t, [(d, min(255, n)) for d, n in sorted(c.items())]) for t, c in sorted(sums.items(), key=lambda x: x[0].encode())]
    docs = [(f"d{i}", 0) for i in range(9)]
    records = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "ordinal long, docno string, doclength int")
    for n in (1, 4):
        header = ciff.write_texts(str(tmp_path / f"many{n}"), spark.createDataFrame(texts, "doc_id long, text string").repartition(n), records, "x", 255)
        assert (header.num_postings_lists, header.num_docs) == (len(given), 9)
        ciff.write(str(tmp_path / "one"), header, given, docs)
        assert (tmp_path / f"many{n}").read_bytes() == (tmp_path / "one").read_bytes()
    empty = ciff.write_texts(str(tmp_path / "none"), spark.createDataFrame([], "doc_id long, text string"), records, "x", 255)
    assert (empty.num_postings_lists, empty.num_docs) == (0, 9)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_ciff_blocks_are_put_together(tmp_path, rows):
    """Blocks of a part hold pieces whose documents interleave; about `rows` of them are put together at a time."""
    given, blocks = _ciff_lists(), []
    for k in range(3):
        some = [(t, pairs[k::3]) for t, pairs in given if pairs[k::3]]
        columns = pa.array([t for t, _ in some]), *(pa.array([[p[i] for p in pairs] for _, pairs in some], pa.list_(pa.int64())) for i in (0, 1))
        blocks += [b.select(["block"]) for b in ciff._blocks(pa.RecordBatch.from_arrays(list(columns), names=["term", "docs", "impacts"]), [])]
    found = list(ciff._lists_of(blocks, 255, rows))
    assert sum(n for n, _, _ in found) == len(given) and len(found) == (1 if rows == 1000 else len(found)) and (rows > 1 or len(found) == len(given))
    for name, some in (("none", []), ("all", given)):
        ciff.write(str(tmp_path / name), ciff.Header(), some, [])
    body = b"".join(bytes(x) for _, _, out in found for x in out)
    assert (tmp_path / "all").read_bytes() == (tmp_path / "none").read_bytes() + body


def test_ciff_rows_may_interleave(spark, tmp_path):
    """A term's rows of a frame may overlap, but a document may not be in two of them."""
    docs = spark.createDataFrame([], "ordinal long, docno string, doclength int")
    frame = lambda rows: spark.createDataFrame(rows, "term string, docs array<bigint>, impacts array<int>")
    header = ciff.write_frames(str(tmp_path / "a"), frame([("t", [1, 5, 300], [1, 2, 3]), ("t", [0, 200], [9, 8]), ("u", [0], [1])]), docs, "x")
    ciff.write(str(tmp_path / "b"), header, [("t", [(0, 9), (1, 1), (5, 2), (200, 8), (300, 3)]), ("u", [(0, 1)])], [])
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()
    with pytest.raises(Exception, match="twice"):
        ciff.write_frames(str(tmp_path / "c"), frame([("t", [1, 5], [1, 2]), ("t", [5], [9])]), docs, "x")


def test_ciff_sums(spark, tmp_path):
    """The reader's sums are those of the lists it gives; empty lists have none."""
    path = str(tmp_path / "s.ciff")
    given = [*_ciff_lists(), ("zero", [])]
    ciff.write(path, ciff.Header(1, len(given), 0), given, [])
    got = sorted(map(tuple, ciff.read(spark, path, "sums").collect()))
    assert got == sorted((t, i, len(p), sum(n for _, n in p), len(p), sum(d for d, _ in p), max(d for d, _ in p), sum(n for _, n in p)) for i, (t, p) in enumerate(given) if p)
    assert got == sorted(map(tuple, tables.gap_list_sums(ciff.read(spark, path), ["term", "ordinal", "df", "cf"]).collect()))
