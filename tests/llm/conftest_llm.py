"""Makes documents for the tests."""

from pyspark.sql import functions as F

CLASH = ["kept", "size", "tag", "doc", "id", "row", "key", "cdf", "parts", "label", "nth", "_nth", "n", "c", "shard", "expected_grade", "tail_prob", "mix_source", "bucket", "marks", "copy", "n_copies", "place", "part", "item", "h", "text_crc32", "own", "set", "before"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, ids=None, langs=None, sources=None, extra=True):
    """Documents of the texts, with extra columns whose names the operators use themselves."""
    n = len(texts)
    rows = [((ids or list(range(n)))[i], texts[i], (langs or ["en"] * n)[i], (sources or [f"s{i % 3}" for i in range(n)])[i], len(texts[i] or "")) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumns({c: F.lit(f"mine-{c}") for c in CLASH})
    return df


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))
