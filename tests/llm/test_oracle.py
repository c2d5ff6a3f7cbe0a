"""The queries of the package that have SQL, against DuckDB."""

import duckdb
import pytest

from labelloom.llm import licenses
from labelloom.llm.queries import QUERIES, SQL
from tests.llm.common import SF, TEXTS


def compare(spark, folder, name):
    base = duckdb.connect()
    for table in ("documents", "conversations"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'" if folder != SF else
                 f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = base.sql(SQL[name])
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(str(tuple(r)) for r in got.select(*want.columns).collect())
    assert rows and rows == sorted(str(r) for r in want.fetchall())
    return got.count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, SF, name)


def licence_documents():
    """Whole texts with titles, copyright lines and other wrapping, and near misses."""
    out = []
    for name, text in licenses.TEXTS:
        words = text.split()
        for body in (text, " ".join(words), "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))):
            out += [body, f"{name}\n\n{body}", f"The {name} Licence\n\nCopyright (c) 2020 Jo\n(c) 2021 the owners\n\n{body}",
                    f"Copyright 2020 Jo {body}", body.upper(), body + " and more", f"© all\nCopyright in this\n{body}"]
    return out + ["Copyright holders are many.\nMIT", "copyright\nnotice", "Licensed under GPL v3.\nlicence: isc", "copyright0text", "a\x1eb"]


def test_licence_scan_equals_sql_on_whole_texts(spark, tmp_path):
    texts = [*licence_documents(), *[t for _, t in TEXTS]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/conversations.parquet").write.parquet(f"{tmp_path}/conversations.parquet")
    assert compare(spark, str(tmp_path), "op9_license_scan") > 3 * 3 * 5
