import duckdb
import pytest

from keelson.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else v if v is None or isinstance(v, (bool, str)) else round(float(v), 6) if hasattr(v, "__float__") else str(v)


#: The same queries run at a larger size by the driver; here one of each kind.
CHOSEN = "latest_wins get_many_ordered record_layout range_merge batch_io_counters range_merge_capped coaccess_edges edge_prune components layout_plan budget_select adapted_vs_baseline orphan_segments nearest_rank_p50_p95 sign_flips workload_mixed workload_adversarial workload_digest crc_check rewrite_status segment_roundtrip segment_recovery edge_decay median_iqr".split()


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = duck.execute(catalogue.SQL[name])
    named = [d[0] for d in rows.description]
    assert sorted(named) == columns
    theirs = sorted(repr(tuple(plain(r[named.index(c)]) for c in columns)) for r in rows.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in found.select(*columns).collect()) == theirs


def test_every_query_is_known_and_entry_runs(spark, sf_dir):
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert catalogue.entry(spark, sf_dir).count() == 1


def test_part_layout_is_one_pass(spark, sf_dir):
    plan = catalogue.batch_io_counters(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan
