"""Small tables that every operator is tried on."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "pii_spans string, n_lines int, lang_pred string, redacted string, bpe_ids int, fp string, `a b` int"


def documents(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else "fr", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    if extra:
        rows = [(*r, "x", 1, "y", "z", 2, "w", 3) for r in rows]
    return spark.createDataFrame(rows, DOCS + (", " + EXTRA if extra else ""))


def as_table(df, folder, name="documents"):
    """Writes a table where queries look for it; gives the folder."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
