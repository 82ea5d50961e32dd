"""Roles by what the pages of a host share and what only one of them says."""

from lodestack.operators import titles


def test_roles(spark):
    rows = [(i, "acme.com", 0, f"{t} | Acme Careers") for i, t in enumerate(["Data Analyst", "Chef - Night", "Driver", "Cook"])]
    rows += [(4, "acme.com", 0, "Acme Careers"), (4, "acme.com", 1, "Careers"), (4, "acme.com", 2, "Baker · Acme Careers"), (5, "acme.com", 0, "Acme Careers"), (5, "acme.com", 1, None)]
    rows += [(i, "tiny.org", 0, "Tiny - Cook") for i in (6, 7)] + [(8, None, 0, "Working at Meta"), (8, None, 1, "Product Lead"), (None, "acme.com", 0, "Lost")]
    found = titles.recover_roles(spark.createDataFrame(rows, "k int, host string, rank int, text string"), "k").collect()
    assert {r["k"]: (r["role"], r["rank"]) for r in found} == {0: ("Data Analyst", 0), 1: ("Chef - Night", 0), 2: ("Driver", 0), 3: ("Cook", 0), 4: ("Baker", 2), 6: ("Tiny - Cook", 0), 7: ("Tiny - Cook", 0), 8: ("Product Lead", 1)}
