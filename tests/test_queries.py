"""Every query with SQL against DuckDB, on the smallest tables."""

import pytest

from parsefold import table_queries  # noqa: F401  registers its queries
from parsefold.queries import ORACLES, QUERIES
from tests.conftest import SF

# What the tables must show, or the comparison proves nothing.
MAY_BE_EMPTY = set()


def compare(spark, duck, f, sql, tmp_path):
    df = f(spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    duck.execute(f"CREATE OR REPLACE TEMP TABLE oracle AS {sql}")
    columns = sorted(r[0] for r in duck.execute("DESCRIBE oracle").fetchall())
    assert columns == sorted(df.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    ours = f"SELECT {names} FROM '{tmp_path}/out/*.parquet'"
    for one, other in ((f"SELECT {names} FROM oracle", ours), (ours, f"SELECT {names} FROM oracle")):
        assert duck.execute(f"{one} EXCEPT ALL {other} LIMIT 3").fetchall() == []
    return duck.execute("SELECT count(*) FROM oracle").fetchall()[0][0]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name, tmp_path):
    rows = compare(spark, duck, QUERIES[name], ORACLES[name], tmp_path)
    assert rows > 0 or name in MAY_BE_EMPTY


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
