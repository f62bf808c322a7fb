"""Small tables for the operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)"""
    full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] else 0) for r in rows]
    return spark.createDataFrame(full, DOCS)


def save(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "tu", "vi", "za") for b in ("ber", "din", "fol", "gar", "hem", "jul", "kos", "lin", "mar", "nes")]


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))
