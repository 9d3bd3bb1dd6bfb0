"""Every query with an SQL twin gives the same rows in Spark and in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from ledgerloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float) and math.isfinite(v):
        return round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert rows
        return
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


def test_name_keys_of_words_with_digits(spark, tmp_path):
    """Words that mix letters and digits stay as they are, as in the SQL."""
    text = "Token 2abc3ff 5hop 7 x. Rest of it"
    spark.createDataFrame([(415, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["name_keys"](spark, str(tmp_path)).select("id", "key").collect())
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(c.execute(ORACLES["name_keys"]).fetchall()) and (415, "n|2abc3ff") in got


@pytest.mark.parametrize("small", [0, 1 << 21])
def test_part_features_compare_names_once(spark, tmp_path, monkeypatch, small):
    """Repeated, null and lone names over several runs of ids give the SQL's pairs, whose plan only reads scores of names."""
    from ledgerloom.functions import similarity
    from ledgerloom.queries import linking

    monkeypatch.setattr(linking, "RUN", 2)
    monkeypatch.setattr(linking, "SMALL", small)
    rows = [(k * 37 % 101, [None, "red ring", "ring red", "large bolt", "red rung"][k % 5], f"B{k % 2}" if k % 11 else None, "T") for k in range(60)]
    spark.createDataFrame([*rows, (500, "only one", "B9", "T"), (2, "red ring", "B0", "T")], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    c.execute("create view named as select * from part where p_name is not null")
    for name in ("feat_levenshtein", "feat_jaro_damerau", "feat_char3_cosine", "feat_indel_family"):
        df = QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "levenshtein" not in plan and "python" not in plan
        assert df.count() == c.execute(f"with {linking.PARTS_SQL} select count(*) from pp").fetchone()[0]  # null names too
        got = sorted(repr(tuple(map(plain, r))) for r in df.collect())
        if name in ORACLES:
            want = c.execute(ORACLES[name].replace("from part a join part b on", "from named a join named b on")).fetchall()
            got = sorted(repr(tuple(map(plain, r))) for r in df.where(f"{df.columns[2]} is not null").collect())
        else:
            found = c.execute(f"with {linking.PARTS_SQL} select q, p, l, r from pp").fetchall()
            kernels = [similarity.KERNELS[n] for n in ("ratio", "token_set", "token_sort", "partial")]
            want = [(q, p, *(None if l is None or r is None else round(k(l, r), 6) for k in kernels)) for q, p, l, r in found]
        assert len(want) > 400 and got == sorted(repr(tuple(map(plain, r))) for r in want), name


def test_first_word_negatives_make_no_rows_of_pairs(spark, tmp_path, monkeypatch):
    """Over several tiles the rows are the SQL's, and no plan sorts, windows or joins rows by pair."""
    from ledgerloom.operators import reports

    monkeypatch.setattr(reports, "TILE", 3)
    rows = [(k, f"{'Same' if k % 2 else 'Other'} {k % 7} name here. Text {k}", "en" if k % 5 else "de") for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["first_word_negatives"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, df.select("q", "p", "kind").collect())) == sorted(c.execute(ORACLES["first_word_negatives"]).fetchall())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower() and "row_number" not in plan and "array_min" in plan


def test_entry():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
