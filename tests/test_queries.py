"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from murmurlake.plans.answer_queries import ENTRIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(rows, columns, order):
    return sorted([tuple(round(r[columns.index(c)], 9) if isinstance(r[columns.index(c)], float) else r[columns.index(c)] for c in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql])
def test_query(spark, duck, name):
    query, sql = ENTRIES[name]
    df = query(spark, SF)
    made = duck.execute(sql)
    columns = [d[0] for d in made.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert _rows(df.collect(), df.columns, order) == _rows(made.fetchall(), columns, order)


def test_pieces_of_a_message_join_to_it(spark):
    whole = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    found = {}
    for r in ENTRIES["chunk_message"][0](spark, SF).orderBy("conv_id", "turn", "chunk").collect():
        found.setdefault((r["conv_id"], r["turn"]), []).append((r["chunk"], r["piece"]))
    assert found.keys() == whole.keys()
    for key, pieces in found.items():
        assert [n for n, _ in pieces] == list(range(len(pieces)))
        told = "".join(p.removeprefix("…").removesuffix("…") if len(pieces) > 1 else p for _, p in pieces)
        assert "".join(told.split()) == "".join(whole[key].split())
        assert all(len(p) <= 280 for _, p in pieces[:-1]) and len(pieces[-1][1]) < 280 + 32


LINK_KINDS = {"maps.google": "google_maps", "airbnb": "airbnb", "youtu": "youtube"}


def test_links_are_those_of_the_addresses(spark):
    from murmurlake.plans.queries import messages

    rows = {(r["chat_id"], r["id"]): r for r in messages(spark, SF).collect()}
    found = ENTRIES["activity_links"][0](spark, SF).collect()
    assert len(found) == len({(r["chat_id"], r["message_id"], r["url_no"]) for r in found}) > 0
    for r in found:
        urls = rows[r["chat_id"], r["message_id"]]["urls"]
        assert 0 <= r["url_no"] < len(urls) and 0 < r["confidence"] <= 1
        for part, platform in LINK_KINDS.items():
            assert part not in urls[r["url_no"]] or r["platform"] == platform


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
