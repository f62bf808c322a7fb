import functools
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import chat


@pytest.fixture(scope="module")
def coder():
    with open(chat.VOCABULARY, "rb") as f:
        return chat.Coder(f.read())


PARTS = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "/", "s>", "INST]", "é", "😀", " ", "\n", "a"]), max_size=12).map("".join)


@given(st.one_of(PARTS, st.text(max_size=60)))
@settings(max_examples=400, deadline=None)
def test_escape(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROLS)


def test_round_trip(coder):
    turns = [("system", "be <s>"), ("user", chat.PROBE), ("assistant", chat.PROBE), ("to[INST]ol", ""), ("", "x"), ("assistant", ""), ("assistant", "é😀\\")]
    ids, mask, offsets = coder.assemble(turns, True)
    assert coder.read(np.array(ids), np.array(mask)) == (turns, "".join(t for r, t in turns if r == "assistant"), len(coder.decode(ids)))
    assert offsets[-1] == len(ids) == len(mask)
    assert all(m == 0 for i, m in zip(ids, mask, strict=True) if i >= coder.size)


def test_no_ids(coder):
    assert coder.read(np.zeros(0, np.int32), np.zeros(0, np.int32)) == ([], "", 0)


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 30_000, "\n a" * 9000, "x'll  don't 12 - ..\t\tÀé 中文 \u3000\x1c y\x85 z" * 900])
def test_long_texts_get_the_ids_of_the_whole(coder, text):
    for stretch in (1, 7, 1000):
        coder.stretch = stretch
        assert coder.encode(text) == coder.encoding.encode_ordinary(text)
    coder.stretch = 10_000
    ids, mask, _ = coder.assemble([("assistant", text)], True)
    assert coder.read(np.array(ids), np.array(mask))[1] == text


@functools.cache
def short_stretches():
    with open(chat.VOCABULARY, "rb") as f:
        return chat.Coder(f.read(), 3)


@given(st.one_of(PARTS, st.text(max_size=60)))
@settings(max_examples=300, deadline=None)
def test_any_cut_gives_the_ids_of_the_whole(text):
    coder = short_stretches()
    assert coder.encode(text) == coder.encoding.encode_ordinary(text)


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), digest("".join(x for r, x in t if r == "assistant"))) for c, t in out.items()}


def test_as_plain_loop(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x"), (1, 2, None, "x"), (1, None, "system", "s"), (2, 5, "assistant", "</s>"), (None, 0, "user", "lost"), (None, 1, "assistant", "too")]
    rows += [(3, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(150)]
    frame = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    pieces = chat.format_conversations(frame, turns_per_piece=7)
    assert max(r["n_turns"] for r in pieces.collect()) == 7
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_sha256"]) for r in chat.read_back(pieces).collect()}
    assert got == expected(rows)
    same = chat.read_back(pieces, in_order=True).collect()
    assert sorted(map(tuple, same), key=repr) == sorted(map(tuple, chat.read_back(pieces).collect()), key=repr)


def test_batches_of_few_ids(spark, monkeypatch):
    monkeypatch.setattr(chat, "BATCH_IDS", 5)
    monkeypatch.setattr(chat, "BATCH_PIECES", 2)
    rows = [(c, i, "user" if i % 2 else "assistant", f"turn {i} of {c}") for c in range(6) for i in range(c)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_sha256"]) for r in chat.read_back(chat.format_conversations(frame, turns_per_piece=2)).collect()}
    assert got == expected(rows)


def test_empty(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
