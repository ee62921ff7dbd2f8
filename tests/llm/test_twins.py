"""Queries of the subpackage that have a SQL twin agree with it; and all of them run on the smallest data."""

import os

import duckdb
import pytest

from siltstone.llm import sites, twins
from siltstone.llm.queries import QUERIES, SQL
from test_queries import plain


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    order = sorted(got.columns)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert order
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [x[0] for x in cur.description]
        at = [names.index(c) for c in order]
        assert a == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_sites_of_odd_urls_in_sql():
    urls = ["http://WWW.Étude.example/x", "https://xn--tude-9oa.example:443/", " étude.example. ", "//a.étude.example/p?q=a@b.test", "u:p@étude.example/z", "http://xn--80ak6aa92e.example/", "xn--mgbh0fb.example", "xn--fiqs8s.test", "XN--BCHER-KVA.co.test",
            None, "", "  ", "n/a", "about:blank", "mailto:a@b.example", "http:///x", "http://example/", "http://a.other/", "http://edu.example/x", "http://x.y.edu.example/", "a_b.example", "-a.example", "http://a..example"]
    suffixes = ["example", "test", "edu.example", "co.test"]
    c = duckdb.connect()
    c.execute("create table t (url varchar); create table public_suffixes (suffix varchar)")
    c.executemany("insert into t values (?)", [(u,) for u in urls])
    c.executemany("insert into public_suffixes values (?)", [(s,) for s in suffixes])
    got = dict(c.execute(f"with {twins.sites_sql('t')} select url, site from sites").fetchall())
    assert {u: got.get(u) for u in urls} == {u: sites.site_of(u, frozenset(suffixes)) for u in urls}
