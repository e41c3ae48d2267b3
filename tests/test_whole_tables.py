"""Queries that cover all rows of their tables, against brute force."""

import duckdb

from loomgraph import queries


def rows_of(small, table, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{small}/{table}.parquet'").fetchall()


def test_members_of_all_documents(spark, small):
    spans = [(0, 1000, "all"), *((100 * j, 100 * j + 90, f"a{j}") for j in range(10)), *((100 * j + 20, 100 * j + 60, f"b{j}") for j in range(10))]
    places = [u * 37 % 1100 for u in range(40)]
    inner = {p: min(((e - s, name) for s, e, name in spans if s <= p < e), default=(0, None))[1] for p in places}
    want = sorted((str(d), p, inner[p]) for (d,) in rows_of(small, "documents", "doc_id") for p in places)
    got = queries.QUERIES["enclosing_members"](spark, small).select("file", "place", "member_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_components_of_all_line_items(spark, small):
    of_customer, of_supplier = dict(rows_of(small, "customer", "c_custkey, c_nationkey")), dict(rows_of(small, "supplier", "s_suppkey, s_nationkey"))
    ordered_by = dict(rows_of(small, "orders", "o_orderkey, o_custkey"))
    after = {}
    for order, supplier in rows_of(small, "lineitem", "l_orderkey, l_suppkey"):
        a, b = of_customer[ordered_by[order]], of_supplier[supplier]
        if a != b:
            after.setdefault(f"N{a}", set()).add(f"N{b}")
    nodes = set(after).union(*after.values())
    reach = {n: set(after.get(n, ())) for n in nodes}
    for via in nodes:
        for n in nodes:
            if via in reach[n]:
                reach[n] |= reach[via]
    want = sorted((n, min(x for x in reach[n] if n in reach[x])) for n in nodes if n in reach[n])
    for name in ("container_scc", "container_scc_by_colour"):
        assert sorted(map(tuple, queries.QUERIES[name](spark, small).select("node", "component").collect())) == want


def test_call_sites_of_all_pages(spark, small):
    counts = dict(map(tuple, queries.QUERIES["replace_call_sites"](spark, small).select("kind", "n").collect()))
    assert counts["FrontendCallSite"] == len(rows_of(small, "pages", "page_id"))
