import pytest

from taintgraph.llm import queries
from tests.test_queries import check, column, count, db  # noqa: F401

#: what a query without SQL is checked for
NO_SQL = {
    "p8_ids": lambda df, got, path, db: sorted(column(df, got, "doc_id")) == [r[0] for r in db.execute("select doc_id from documents order by 1").fetchall()] and all(isinstance(x, tuple) for x in column(df, got, "ids")),
    "p8_counts": lambda df, got, path, db: column(df, got, "n_docs") == [count(db, "select count(*) from documents")] and column(df, got, "n_empty")[0] == count(db, "select count(*) from documents where coalesce(text, '') = ''"),
    "p10_found": lambda df, got, path, db: 0 < len(got) == sum(got.values()) and set(column(df, got, "doc_id")) <= {r[0] for r in db.execute("select doc_id from documents where trim(text) <> ''").fetchall()},
    "p10_kinds": lambda df, got, path, db: sum(column(df, got, "n_docs")) == queries.QUERIES["p10_found"](df.sparkSession, path).count() and (False, False, False, False) not in {tuple(x) for x in zip(*[column(df, got, c) for c in ("slot", "filler", "error", "scripts")])},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, smallest, db):  # noqa: F811
    check(name, spark, smallest, db, NO_SQL)
