"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Base statistics of a text are counted with array and string functions. Five rules (share of symbols, share of repeated
lines, mean word length above or below, share of capitals) get their cutoffs from labelled documents: of a fixed grid,
the strictest cutoff of each stratum (length class) and rule whose rate of false rejection is proved to be at most
``risk`` / rules, so that all rules together falsely reject at most ``risk`` of a stratum. Proof is the exact binomial
tail ``P(Bin(n, risk / rules) <= k) <= delta / (strata * rules)`` (the Clopper-Pearson bound with Bonferroni's
correction), where n good documents of the stratum lie in the holdout and the cutoff rejects k of them. A rule's cutoffs
are tested from the laxest on in a fixed sequence, and as a stricter one never rejects fewer, its first failure is the
last to be looked at: within a rule no further correction is due. Without a proved cutoff a rule rejects nothing. A
document is kept if neither the base nor a cutoff rejects it.

Defined results: a null, empty or wordless text has zero counts and fails the base; null labels and labels without a
document are no evidence; repeated documents get a row each, and count once as evidence for each of their labels; tables
may be empty; only doc_id, text and quality are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import materialise

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Strata: texts of fewer words than this. There is one more for the rest, so the table of cutoffs has a fixed size.
LENGTHS = (50, 200, 1000)
#: A rule rejects where its statistic is over (+1) or under (-1) the cutoff; cutoffs are per thousand, strictest first.
RULES = {
    "symbols": (1, (20, 50, 100, 150, 200, 300, 400)),
    "lines": (1, (50, 100, 200, 300, 400, 500, 700)),
    "long_words": (1, (6000, 6500, 7000, 8000, 9000, 10000, 12000, 15000)),
    "short_words": (-1, (4000, 3500, 3000, 2500, 2000)),
    "capitals": (1, (50, 100, 200, 300, 500, 700, 900)),
}


def with_repeated_window_words(table: DataFrame, words: str, name: str, width: int = 8) -> DataFrame:
    """Adds how many words lie in windows of `width` words found twice or more in the text, the first included.

    Windows are compared by a 64-bit hash. Sorted (hash, start) pairs put equal windows side by side; starts of windows
    that have an equal neighbour are sorted and each covers the words up to the next start, `width` at most. Each step
    is a column of its own, so that it is worked out once; texts without an equal pair end after the first.
    """
    size = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), size - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    table = table.withColumn("__h", F.when(size > width, windows))
    several = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    table = table.withColumn("__ranked", F.when(several, F.array_sort(pairs))).drop("__h")
    none = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i")))
    before, after = F.concat(none, F.col("__ranked")), F.concat(F.slice("__ranked", F.lit(2), F.size("__ranked")), none)
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    early = F.zip_with("__ranked", before, lambda r, b: F.struct(r["h"].alias("h"), r["i"].alias("i"), same(r["h"], b["h"]).alias("twice")))
    marked = F.zip_with(early, after, lambda r, a: F.struct(r["i"].alias("i"), (r["twice"] | same(r["h"], a["h"])).alias("twice")))
    starts = F.array_sort(F.transform(F.filter(marked, lambda m: m["i"].isNotNull() & m["twice"]), lambda m: m["i"]))
    table = table.withColumn("__at", F.when(F.col("__ranked").isNotNull(), starts)).drop("__ranked")
    nexts = F.concat(F.slice("__at", F.lit(2), F.size("__at")), F.array(F.element_at("__at", -1) + width))
    covered = F.aggregate(F.zip_with("__at", nexts, lambda a, b: F.least(b - a, F.lit(width))), F.lit(0), lambda s, x: s + x)
    return table.withColumn(name, F.when(F.col("__at").isNotNull(), covered).otherwise(0).cast("long")).drop("__at")


def statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, capitals and base_failed."""
    bare = lambda x: F.trim(x, F.lit(SPACES))
    out = documents.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    out = out.withColumn("__words", F.when(bare("__text") == "", F.array().cast("array<string>")).otherwise(F.split(bare("__text"), f"[{SPACES}]+")))
    out = out.withColumn("__lines", F.transform(F.filter(F.split("__text", "\n", -1), lambda x: bare(x) != ""), lambda x: F.xxhash64(x)))
    plain = F.col("__text")
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.concat_ws("", "__words")).cast("long"),
            "n_symbols": (F.length("__text") - F.length(plain)).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "capitals": (F.length("__text") - F.length(F.regexp_replace("__text", "[A-Z]+", ""))).cast("long"),
        }
    ).drop("__text", "__lines")
    out = with_repeated_window_words(out, "__words", "n_repeat_words").drop("__words")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def measures() -> dict[str, Column]:
    """The rules' statistics, per thousand; null where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, 1000 * F.col(a) / F.col(b))
    return {"symbols": share("n_symbols", "word_chars"), "lines": share("n_dup_lines", "n_lines"), "long_words": share("word_chars", "n_words"), "short_words": share("word_chars", "n_words"), "capitals": share("capitals", "word_chars")}


def stratum() -> Column:
    found = F.lit(len(LENGTHS))
    for i in reversed(range(len(LENGTHS))):
        found = F.when(F.col("n_words") < LENGTHS[i], i).otherwise(found)
    return found


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k); for k under the mean, else 0. Terms are summed from the largest, the k-th, downwards."""
    odds = (1 - p) / p
    top = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log((n - i + 1) / i.cast("double")))
    top = F.when(k > 0, top).otherwise(0.0) + k * math.log(p) + (n - k) * math.log(1 - p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda s, i: F.struct((s["term"] * (k - i + 1) / (n - k + i) * odds).alias("term"), (s["sum"] + s["term"] * (k - i + 1) / (n - k + i) * odds).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), start, step)["sum"]
    return F.when(k < n * p, top + F.log(F.when(k > 0, total).otherwise(1.0))).otherwise(0.0)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """One row for each stratum, with the cutoff of each rule or null; at most len(LENGTHS) + 1 rows."""
    tests = (len(LENGTHS) + 1) * len(RULES)
    good = labels.where("quality = 1").select("doc_id")
    held = good.join(measured.where(~F.col("base_failed")).select("doc_id", stratum().alias("stratum"), *[m.alias(r) for r, m in measures().items()]), "doc_id")
    rejected = [F.sum(F.coalesce((F.col(r) > c if sign > 0 else F.col(r) < c).cast("long"), F.lit(0))).alias(f"{r}_{c}") for r, (sign, grid) in RULES.items() for c in grid]
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *rejected)
    proved = lambda r, c: log_binomial_tail(F.col("n"), F.col(f"{r}_{c}"), risk / len(RULES)) <= math.log(delta / tests)
    return counts.select("stratum", "n", *[F.coalesce(*[F.when(proved(r, c), F.lit(float(c))) for c in grid]).alias(f"cut_{r}") for r, (_, grid) in RULES.items()])


def judge(documents: DataFrame, labels: DataFrame, text: str = "text", risk: float = 0.05, delta: float = 0.1) -> DataFrame:
    """documents (doc_id, ...) without the text, with the statistics and kept; measured once and written down."""
    measured = materialise(statistics(documents, text).drop(text), "quality")
    limits = cutoffs(measured, labels, risk, delta).withColumnRenamed("stratum", "__stratum").drop("n")
    table = measured.withColumn("__stratum", stratum()).join(F.broadcast(limits), "__stratum", "left")
    over = F.lit(False)
    for r, (sign, _) in RULES.items():
        m, cut = measures()[r], F.col(f"cut_{r}")
        over = over | F.coalesce(m > cut if sign > 0 else m < cut, F.lit(False))
    return table.withColumn("kept", ~F.col("base_failed") & ~over).drop("__stratum", *[f"cut_{r}" for r in RULES])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql(risk: float = 0.05, delta: float = 0.1) -> str:
    tests, risk = (len(LENGTHS) + 1) * len(RULES), risk / len(RULES)
    values = {"symbols": ("n_symbols", "word_chars"), "lines": ("n_dup_lines", "n_lines"), "long_words": ("word_chars", "n_words"), "short_words": ("word_chars", "n_words"), "capitals": ("capitals", "word_chars")}
    stat = ", ".join(f"case when {b} > 0 then 1000.0::double * {a} / {b} end m_{r}" for r, (a, b) in values.items())
    strata = "case " + " ".join(f"when n_words < {x} then {i}" for i, x in enumerate(LENGTHS)) + f" else {len(LENGTHS)} end"
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln({1 - risk}))))"
    bad = {(r, c): f"m_{r} {'>' if sign > 0 else '<'} {c}" for r, (sign, grid) in RULES.items() for c in grid}
    tried = " union all ".join(f"select s, '{r}' r, {grid.index(c)} o, count(*) n, count(*) filter (where {bad[r, c]}) k from held group by s" for r, (_, grid) in RULES.items() for c in grid)
    over = " or ".join(f"(r = '{r}' and o = {grid.index(c)} and {bad[r, c]})" for r, (_, grid) in RULES.items() for c in grid)
    return f"""
with w as (select row_number() over () rid, doc_id, coalesce(text, '') x, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '') ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \\x09-\\x0D]')) ls from documents),
win as (select rid, i, md5(array_to_string(ws[i : i + 7], ' ')) h from w, unnest(range(1, len(ws) - 6)) r(i) where len(ws) >= 8),
twice as (select rid, h from win group by rid, h having count(*) > 1),
rep as (select rid, count(distinct p) c from win join twice using (rid, h), unnest(range(i, i + 8)) r(p) group by rid),
st as (select rid, doc_id, len(ws)::bigint n_words, length(regexp_replace(x, '[ \\x09-\\x0D]', '', 'g'))::bigint word_chars,
              (length(x) - length(translate(x, '{SYMBOLS}', '')))::bigint n_symbols, len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
              coalesce(c, 0)::bigint n_repeat_words, (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::bigint capitals
       from w left join rep using (rid)),
m as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, {strata} s, {stat} from st),
held as (select m.* from m join labels l on l.doc_id = m.doc_id where l.quality = 1 and not base_failed),
tried as ({tried}),
cut as (select s, r, min(o) o from (select s, r, o, n, k, {tail} tail from tried) where k < n * {risk} and ln(greatest(tail, 1e-300)) <= ln({delta} / {tests}) group by s, r),
fall as (select distinct rid from m join cut using (s) where {over})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and fall.rid is null kept
from m left join fall using (rid)
"""


SQL = _sql()
