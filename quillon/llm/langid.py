"""Language identification by rank-order profiles.

A profile lists the ``top`` most frequent letter n-grams (1 to 3 letters, word ends as a blank) of a language, most
frequent first. A text's own list is held against each profile: an n-gram's out-of-place distance is the difference of
its ranks, or ``top`` where the profile lacks it. The language of the smallest sum wins; the score is half one plus half
the relative lead over the second.

Profiles are learned from ``per_lang`` labelled documents of each language (expected, by the hash of doc_id), never from
those whose crc32(doc_id as text) mod 4 is 2. Predictions read whole texts and nothing but texts.

Defined results: a null text and one without letters are ``und`` with score 0, and so is everything where no language
was learned; ties go to the name that comes first; repeated documents get a row each; a null doc_id is held out;
further columns are kept and those with the added names replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import SLICE_BYTES, built, held_out, ship, slices, text_buffer

BLANK = 1
#: A text's number within a call has 16 bits, beside three letters of 16 bits each.
MOST_TEXTS = 1 << 16
_CODES: list[np.ndarray] = []


def codes() -> np.ndarray:
    """For every code point of the first plane: itself if a letter, else BLANK."""
    if not _CODES:
        _CODES.append(np.array([i if chr(i).isalpha() else BLANK for i in range(0x10000)], np.uint64))
    return _CODES[0]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters, lower case, with one BLANK for each run of others, and the text each belongs to."""
    parts = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([len(p) + 1 for p in parts])
    high = points >= 0x10000
    coded = codes()[np.where(high, 0, points)]
    for point in np.unique(points[high]):
        coded[points == point] = 2 + int(point) % 0xFFF0 if chr(point).isalpha() else BLANK
    owner = np.repeat(np.arange(len(parts), dtype=np.uint64), np.diff(bounds, prepend=0))[: len(coded)]
    keep = coded != BLANK
    keep[1:] |= coded[:-1] != BLANK  # the first other character after a letter
    if len(keep):
        keep[0] = True
    coded, owner = coded[keep], owner[keep]
    return np.concatenate([[np.uint64(BLANK)], coded, [np.uint64(BLANK)]]), np.concatenate([owner[:1], owner, owner[-1:]])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count), sorted by text and n-gram; MOST_TEXTS texts at most. An n-gram has no blank inside and is not a blank alone."""
    if len(texts) > MOST_TEXTS:
        raise ValueError(f"more than {MOST_TEXTS} texts")
    c, owner = letters(texts)
    shift, letter = np.uint64(16), c != BLANK
    one = (owner[letter] << np.uint64(48)) | c[letter]
    pair = letter[:-1] | letter[1:]
    whose = np.where(letter[:-1], owner[:-1], owner[1:])
    two = ((whose << np.uint64(48)) | (c[:-1] << shift) | c[1:])[pair]
    middle = letter[1:-1]
    three = ((owner[1:-1] << np.uint64(48)) | (c[:-2] << np.uint64(32)) | (c[1:-1] << shift) | c[2:])[middle]
    keys = np.sort(np.concatenate([one, two, three]))
    if not len(keys):
        return keys.astype(np.int64), keys, keys.astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(first, append=len(keys))
    return (keys[first] >> np.uint64(48)).astype(np.int64), keys[first] & np.uint64((1 << 48) - 1), counts


class Profiles:
    """The ranks of n-grams in each language."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int):
        self.top, self.names = top, sorted({r[0] for r in rows})
        self.known = np.array(sorted({r[1] for r in rows}), np.uint64)
        self.ranks = np.full((len(self.names), len(self.known) + 1), -1, np.int64)
        at = {g: i for i, g in enumerate(self.known.tolist())}
        for name, gram, rank in rows:
            self.ranks[self.names.index(name), at[gram]] = rank

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if len(texts) > MOST_TEXTS:
            done = [self.predict(texts[i : i + MOST_TEXTS]) for i in range(0, len(texts), MOST_TEXTS)]
            return [x for names, _ in done for x in names], [x for _, scores in done for x in scores]
        whose, gram, count = grams(texts)
        if not len(gram) or not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        order = np.argsort((whose << 32) + (0x7FFFFFFF - np.minimum(count, 0x7FFFFFFF)), kind="stable")
        whose, gram = whose[order], gram[order]
        start = np.searchsorted(whose, np.arange(len(texts)))
        rank = np.arange(len(whose)) - start[whose]
        front = rank < self.top
        whose, gram, rank = whose[front], gram[front], rank[front]
        place = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
        place = np.where(self.known[place] == gram, place, len(self.known))
        distance = np.stack([np.bincount(whose, np.where(r[place] >= 0, np.abs(r[place] - rank), self.top), len(texts)) for r in self.ranks])
        best = distance.argmin(0)
        lead = np.sort(distance, 0)
        score = np.ones(len(texts)) if len(self.names) == 1 else 0.5 + 0.5 * (lead[1] - lead[0]) / np.maximum(lead[1], 1)
        some = np.bincount(whose, minlength=len(texts)) > 0
        return [self.names[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0).tolist()


def fit(documents: DataFrame, per_lang: int = 3000, top: int = 300, max_langs: int = 1000) -> Profiles:
    """Profiles of all languages, of at most max_langs * top rows, which is checked."""
    ship(documents.sparkSession)
    usable = documents.where(F.col("lang").isNotNull() & ~held_out())
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"lang has more than {max_langs} values")
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_lang / r["n"]))]), F.col("lang")) if counts else F.lit(0.0)
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            _, off = text_buffer(batch.column(1))
            for i, j in slices(off):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                for lang in sorted(set(langs[i:j])):
                    joined = "\n".join(t for t, x in zip(texts, langs[i:j], strict=True) if x == lang)
                    _, gram, n = grams([joined])
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(gram), "gram": pa.array(gram.astype(np.int64)), "n": pa.array(n.astype(np.int64))}, schema=pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))

    total = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = total.select("lang", "gram", (place - 1).alias("rank")).where(F.col("rank") < top).collect()
    return Profiles([(r["lang"], r["gram"], r["rank"]) for r in rows], top)


def identify(documents: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every document."""
    ship(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(profiles)
    own = [c for c in documents.columns if c not in ("lang_pred", "score")]
    kept = documents.select(*[F.col(f"`{c}`") for c in own])
    place = own.index(text)

    def run(batches):
        profile = built(shipped, lambda x: x)
        for batch in batches:
            _, off = text_buffer(batch.column(place))
            for i, j in slices(off, SLICE_BYTES // 2):
                part = batch.slice(i, j - i)
                langs, scores = profile.predict([t or "" for t in part.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*own, "lang_pred", "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def _sql(top: int = 300) -> str:
    # crc32 of a short string, bit by bit; DuckDB has none
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint)"
    point = lambda i: f"(case when substr(g, {i}, 1) = ' ' then {BLANK} else unicode(substr(g, {i}, 1)) end)::bigint"
    code = f"case length(g) when 1 then {point(1)} when 2 then {point(1)} * 65536 + {point(2)} else ({point(1)} * 65536 + {point(2)}) * 65536 + {point(3)} end"
    return f"""
with d as (select row_number() over () rid, doc_id, lang, lower(coalesce(text, '')) x, coalesce({crc} % 4 = 2, true) held_out from documents),
w as (select rid, ' ' || unnest(regexp_extract_all(x, '\\p{{L}}+')) || ' ' p from d),
c as (select rid, p, count(*) n from w group by 1, 2),
k as (select rid, g, sum(n) n from (select rid, substr(p, i, k) g, n from c, (values (1), (2), (3)) v(k), unnest(range(1, length(p) - k + 2)) r(i)) where trim(g) <> '' group by 1, 2),
learned as (select lang, g, sum(n) n from k join d using (rid) where lang is not null and not held_out group by 1, 2),
profile as (select lang, g, row_number() over (partition by lang order by n desc, {code}) - 1 r from learned qualify r < {top}),
own as (select rid, g, row_number() over (partition by rid order by n desc, {code}) - 1 r from k qualify r < {top}),
far as (select rid, l.lang, sum(case when p.r is null then {top} else abs(p.r - own.r) end)::double f from own cross join (select distinct lang from profile) l left join profile p on p.lang = l.lang and p.g = own.g group by 1, 2),
best as (select rid, lang, f, lead(f) over (partition by rid order by f, lang) f2, row_number() over (partition by rid order by f, lang) o from far)
select doc_id, held_out, coalesce(b.lang, 'und') lang_pred, case when b.lang is null then 0.0::double when f2 is null then 1.0::double else 0.5::double + 0.5::double * (f2 - f) / greatest(f2, 1) end score
from d left join (select * from best where o = 1) b using (rid)
"""


#: For tables of no more learnable texts a language than are sampled, where all of them are learned from.
SQL = _sql()
