"""Small tables that hold the odd cases."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i * i % 7919}" for i in range(30_000))
SHARED = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree at night"


def documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rows = [
        (1, SHARED + ". And some more words follow here.", "en", "a", 1), (2, SHARED + ". And some more words follow here.", "en", "a", 1), (2, SHARED + ". And some more words follow here.", "en", "a", 1),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, "   \n\t ", "en", "b", 4), (6, "one", "de", "b", 3), (7, LONG, "de", None, 9), (8, LONG + " end", "de", "a", 9), (None, SHARED, "en", "a", 1), (None, None, None, None, None),
        (9, "Été à l'école.\nEine Straße, größer.\n" + SHARED, "fr", "b", 2), (10, "!!! ... ???", "en", "b", 1), (11, "12345 67890", "en", "b", 1), (-5, SHARED.upper(), "en", "a", 1), (2**62, "x " * 40, "en", "a", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def crowded(df):
    """The same rows with more columns, by names that the operators use inside."""
    names = ("a", "b", "key", "rep", "sig", "band", "bands", "rid", "part", "kind", "blob", "gone", "r", "node", "component", "kept", "spans", "score", "u", "of", "k", "low", "label", "place", "h1", "n", "id", "y", "_good", "_kept", "_gone")
    return df.select("*", *[F.lit("clash").alias(n) for n in names if n not in df.columns])


def sorted_rows(df, *drop):
    return sorted((tuple(str(v) for v in r) for r in df.drop(*drop).collect()))
