import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table; extra columns clash with the operators' own names."""
    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        if extra:
            for c in ("id", "part", "key", "n_tokens", "places", "root", "score"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df
    return make


def rows_of(df, *cols):
    """Rows as sorted tuples (null first)."""
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(got, key=lambda t: [(x is not None, x) for x in t])
