"""Chat formatting: conversations as token ids with a loss mask, assembled from separately encoded segments.

Every turn becomes segments: control strings, spliced in as reserved ids beyond the vocabulary, and texts, encoded each
by itself. Mask and offsets follow from prefix sums over the segments' lengths. The template:

    <s>                        once, before the first turn
    [INST] text [/INST]        a user's turn
    [OUT] text </s>            an assistant's turn; its text, and nothing else, is under the loss mask
    [ROLE] role [/ROLE] text [END]    any other turn

(without the blanks shown). In contents a backslash follows the first character of every control string and every
backslash, so no control string is left in them and taking the backslashes out again restores them.

A conversation comes as pieces of at most ``turns_per_piece`` turns, in order, so that no task holds a whole one.

Defined results: turns are ordered by turn (null first), then role and text; a null role or text counts as empty; rows
repeated with equal turn, role and text are turns of their own; rows without conv_id form one conversation; empty tables
give no rows; other columns are not read. A text of any length gets the ids that the tokenizer gives the whole of it: it
is encoded in stretches of about ``stretch`` characters, cut where a blank follows another character, which is always a
border between the tokenizer's words.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import built, parts, ship

#: Reserved ids are the vocabulary's size plus the place in this list.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[END]")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public byte-level vocabulary cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RISKY = re.compile(r"\\|[<\[](?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")")
_ESCAPED = re.compile(r"([\\<\[])\\", re.S)
#: A blank after something that is none: words of PATTERN end here, and what follows is cut as it is within the text.
_BORDER = re.compile(r"(?<=[^\s\x1c-\x1f]) ")
#: Ids and conversations that go into one Arrow batch.
BATCH_IDS, BATCH_PIECES = 1 << 19, 1000


def escape(text: str) -> str:
    return _RISKY.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Coder:
    """A byte-level tokenizer and the ids reserved beyond it."""

    def __init__(self, vocabulary: bytes, stretch: int = 10_000):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.size, self.stretch = max(ranks.values()) + 1, stretch
        self.encoding = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.reserved = {c: self.size + i for i, c in enumerate(CONTROLS)}

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.stretch:
            return self.encoding.encode_ordinary(text)
        ids, at = [], 0
        while at < len(text):
            border = _BORDER.search(text, at + self.stretch)
            end = border.start() if border else len(text)
            ids += self.encoding.encode_ordinary(text[at:end])
            at = end
        return ids

    def assemble(self, turns: list[tuple[str, str]], opening: bool) -> tuple[list[int], list[int], list[int]]:
        """Ids, loss mask and the offsets at which segments begin (with the end), of some turns in sequence."""
        segments: list[tuple[list[int], int]] = [([self.reserved["<s>"]], 0)] if opening else []
        mark = lambda c: ([self.reserved[c]], 0)
        for role, text in turns:
            body = self.encode(escape(text))
            if role == "user":
                segments += [mark("[INST]"), (body, 0), mark("[/INST]")]
            elif role == "assistant":
                segments += [mark("[OUT]"), (body, 1), mark("</s>")]
            else:
                segments += [mark("[ROLE]"), (self.encode(escape(role)), 0), mark("[/ROLE]"), (body, 0), mark("[END]")]
        offsets = [0, *accumulate(len(ids) for ids, _ in segments)]
        # +1 where a masked segment begins and -1 where it ends; the running sum is the mask
        steps = [0] * (offsets[-1] + 1)
        for (_, masked), a, b in zip(segments, offsets, offsets[1:], strict=False):
            if masked:
                steps[a] += 1
                steps[b] -= 1
        return [i for ids, _ in segments for i in ids], list(accumulate(steps[:-1])), offsets

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], str, int]:
        """Turns, the text under the mask (unescaped turn by turn) and the formatted length, read back from ids and mask.

        Ids are cut at control strings and where the mask changes, and each stretch between is decoded once.
        """
        control = ids >= self.size
        cuts = np.flatnonzero(control | np.concatenate([[True], mask[1:] != mask[:-1]])) if len(ids) else ids
        turns: list[tuple[str, str]] = []
        loss: list[str] = []
        held: list[bytes] = []
        role, length = "", 0
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=False):
            if control[a]:
                name = CONTROLS[ids[a] - self.size]
                content, held = unescape(b"".join(held).decode()) if held else "", []
                length += len(name)
                if name == "[/ROLE]":
                    role = content
                elif name in ("[/INST]", "</s>", "[END]"):
                    turns.append(({"[/INST]": "user", "</s>": "assistant"}.get(name, role), content))
                a += 1
            if a < b:
                raw = self.encoding.decode_bytes(ids[a:b].tolist())
                held.append(raw)
                length += sum((x & 0xC0) != 0x80 for x in raw) if not raw.isascii() else len(raw)
                if mask[a]:
                    loss.append(unescape(raw.decode()))
        return turns, "".join(loss), length

    def decode(self, ids: list[int]) -> str:
        """Formatted text, control strings included."""
        out, held = [], []
        for i in ids:
            if i >= self.size:
                out += [self.encoding.decode_bytes(held).decode(), CONTROLS[i - self.size]]
                held = []
            else:
                held.append(i)
        return "".join([*out, self.encoding.decode_bytes(held).decode()])


PIECES = "conv_id long, piece long, n_turns long, input_ids array<int>, loss_mask array<int>"
_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int32()))])


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver; some megabytes whatever the tables hold."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def format_conversations(conversations: DataFrame, vocabulary: str = VOCABULARY, turns_per_piece: int = 64) -> DataFrame:
    """Pieces of each conversation, in order within it and within a partition: conv_id, piece, n_turns, input_ids, loss_mask."""
    spark = conversations.sparkSession
    ship(spark)
    shipped = _vocabulary(spark, vocabulary)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        coder = built(shipped, Coder)
        conv, piece, held = None, 0, []

        done: list[tuple] = []
        n_ids = 0

        def put():
            nonlocal n_ids
            ids, mask, _ = coder.assemble(held, piece == 0)
            done.append((conv, piece, len(held), np.array(ids, np.int32), np.array(mask, np.int32)))
            n_ids += len(ids)

        def out():
            nonlocal n_ids
            conv_ids, numbers, counts, ids, masks = zip(*done, strict=True)
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            columns = [pa.array(x, pa.int64()) for x in (conv_ids, numbers, counts)] + [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (ids, masks)]
            done.clear()
            n_ids = 0
            return pa.RecordBatch.from_arrays(columns, schema=_PIECES)

        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if held and (c != conv or len(held) >= turns_per_piece):
                    put()
                    piece, held = (piece + 1 if c == conv else 0), []
                    if n_ids >= BATCH_IDS or len(done) >= BATCH_PIECES:
                        yield out()
                elif c != conv:
                    piece = 0
                conv = c
                held.append((role, text))
        if held:
            put()
        if done:
            yield out()

    return ordered.mapInArrow(run, PIECES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("loss_tokens", pa.int64())])


def read_back(pieces: DataFrame, vocabulary: str = VOCABULARY, in_order: bool = False) -> DataFrame:
    """What each conversation's ids and mask hold, as digests; only running hashes are kept between pieces.

    ``in_order`` says that pieces come as ``format_conversations`` gives them, so they need not be shuffled again.
    """
    spark = pieces.sparkSession
    ship(spark)
    shipped = _vocabulary(spark, vocabulary)
    ordered = pieces.select("conv_id", "piece", "input_ids", "loss_mask")
    if not in_order:
        ordered = ordered.repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches):
        coder = built(shipped, Coder)
        state = None
        done: list[tuple] = []

        def put():
            conv, n, turns, chars, loss, formatted, tokens, masked = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, tokens, masked))

        def out():
            columns = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), _DIGESTS.types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_DIGESTS)

        for batch in batches:
            ids_of, masks_of = batch.column(2), batch.column(3)
            values, flags, offsets = ids_of.values.to_numpy(), masks_of.values.to_numpy(), ids_of.offsets.to_numpy()
            if not np.array_equal(offsets, masks_of.offsets.to_numpy()):
                raise ValueError("input_ids and loss_mask differ in length")
            for k, conv in enumerate(batch.column(0).to_pylist()):
                if state is None or state[0] != conv:
                    if state is not None:
                        put()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids, mask = values[offsets[k] : offsets[k + 1]], flags[offsets[k] : offsets[k + 1]]
                found, loss, length = coder.read(ids, mask)
                state[1] += len(found)
                state[2].update("".join(f"{role}\n{text}\n" for role, text in found).encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += length
                state[6] += len(ids)
                state[7] += int(mask.sum())
            if len(done) >= BATCH_PIECES:
                yield out()
        if state is not None:
            put()
        if done:
            yield out()

    return ordered.mapInArrow(run, DIGESTS)


PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(table.unionByName(probe)), in_order=True).drop("n_tokens", "loss_tokens")


SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
           union all values (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
f as (select *, length(t) + length(t) - length(replace(t, chr(92), '')) + {" + ".join(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in CONTROLS)} e from c)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) turns_sha256,
       coalesce(sum(length(t)) filter (where r = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (where r = 'assistant'), '')) loss_sha256,
       (3 + sum(case r when 'user' then e + 13 when 'assistant' then e + 9 else e + length(r) + 18 end))::bigint formatted_chars
from f group by conv_id
"""
