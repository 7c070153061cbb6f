from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from oracle import check

from weftline.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, small, name):
    check(spark, small, QUERIES[name], ORACLE_SQL[name])


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def cut_references(tmp_path_factory):
    """The small tables, with pages of titles that were cut off within a character reference."""
    made = tmp_path_factory.mktemp("cut")
    for t in Path(SMALL).glob("*.parquet"):
        if t.name != "pages.parquet":
            (made / t.name).symlink_to(t)
    ends = [whole[:n] for whole in ("&amp;", "&quot;", "&lt;", "&gt;", "&copy;", "&middot;", "&amp;amp;") for n in range(1, len(whole) + 1)]
    html = [f"<!DOCTYPE html><html><head><title>one &amp;&amp; two{x}</title></head><body><h1>one &amp;&amp; two{x}</h1><p>a{x}<b>b</b> {x} c</body></html>" for x in ends]
    pq.write_table(pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "url": ["http://a.example.com/"] * len(html), "html": html}), made / "pages.parquet")
    return str(made)


@pytest.mark.parametrize("name", ["dom_texts", "dom_tokens"])
def test_cut_references_equal_sql(spark, cut_references, name):
    check(spark, cut_references, QUERIES[name], ORACLE_SQL[name])
