import duckdb
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text, lang="en", source="src1"):
    return (i, text, lang, source, None if text is None else len(text))


ODD = [
    doc(1, None), doc(2, ""), doc(3, "  \n \n"), doc(None, "an unnamed text about rivers and hills"), doc(5, "one short line", None, None),
    doc(6, "repeated row of some words here", "de", "src2"), doc(6, "repeated row of some words here", "de", "src2"), doc(7, "Été ñandú 漢字 " * 3000, "fr", "src3"),
    doc(8, "x" * 70_000), doc(None, None, None, None), (10, "length is null", "en", "src1", None), doc(11, "don't\tmix   blanks\r\n\n\nplease"),
]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from rows, with extra columns of awkward names if wanted."""

    def f(rows, clash=False):
        df = spark.createDataFrame(rows, DOCS)
        if clash:
            from pyspark.sql import functions as F

            for c in ("score", "h", "key", "n", "count", "__row", "__src", "__h", "b", "toxicity", "i", "t"):
                df = df.withColumn(c, F.lit("kept"))
        return df

    return f


@pytest.fixture(scope="session")
def duck():
    """Rows of a DuckDB query over documents given as a DataFrame."""

    def f(sql, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toArrow())
        t = con.execute(sql).to_arrow_table()
        return canon(t)

    return f


def canon(t):
    t = t if hasattr(t, "column_names") else t.toArrow()
    cols = sorted(t.column_names)
    return cols, sorted(tuple(repr(round(v, 9) if isinstance(v, float) else v) for v in (r[c] for c in cols)) for r in t.to_pylist())
