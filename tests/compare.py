"""Run a query and its SQL over the same tables and compare the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame, columns):
    text = frame[columns].astype(object).where(frame[columns].notna(), None)
    shown = lambda v: "" if v is None else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    return sorted(tuple(shown(v) for v in r) for r in text.itertuples(index=False))


def agree(spark, query, sql, sf_dir):
    got = query(spark, sf_dir).toPandas()
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = db.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)
