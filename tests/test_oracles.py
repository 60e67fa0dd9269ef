"""Every query with SQL of its own against DuckDB, over the smallest tables: the driver's comparison."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from quillsight.plans import media_queries, queries  # noqa: F401  media_queries registers its own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield c


def plain(x):
    if isinstance(x, (float, Decimal)):
        return round(float(x), 5) + 0.0
    return int(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    rows = Counter(tuple(plain(r[n]) for n in sorted(names)) for r in got.collect())
    expected = Counter(tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in found.fetchall())
    assert rows == expected, (list((rows - expected).items())[:3], list((expected - rows).items())[:3])
