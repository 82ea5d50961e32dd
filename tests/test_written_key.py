"""A capture's key by all of its head and by the details behind its body."""

import pytest

from lodestack.operators import identity

UUID = "0b9e1c2d-1111-2222-3333-444455556666"
LEVER = f"https://jobs.lever.co/findem/{UUID}"


def details(apply="Not Available", posting="Not Available", name="ORIGINAL"):
    return f"\n\n{name} CAPTURE DETAILS\nCaptured At: x\nApplication URL: {apply}\nSource: y\nPosting ATS ID: {posting}\n"


@pytest.mark.parametrize("end", ["=== JOB POST END ===", "--- JOB TEXT END ---"])
def test_written_key(spark, end):
    cases = [
        ("Company: A\n" + "Notes: " + "n" * 9000 + "\nJob Posting URL: https://a.com/x\n" + end, "https://a.com/x"),
        ("Company: A\n" + "n\n" * 9000 + "URL: https://a.com/y\n" + end, "https://a.com/y"),
        ("Company: A\n" + end + "\nJob Posting URL: https://a.com/x", None),
        ("Job Posting URL: https://a.com/x\n" + end + details(LEVER), f"lever:findem:{UUID}"),
        ("Job Posting URL: https://asana.com/x\n" + end + details(posting="7392230"), "greenhouse:asana:7392230"),
        ("Job Posting URL: https://a.com/x\n" + end + details() + details(LEVER, name="LATEST"), "https://a.com/x"),
        ("Job Posting URL: https://a.com/x\n" + end + "\nORIGINAL CAPTURE DETAILS\n\n" + details(LEVER, name="LATEST"), f"lever:findem:{UUID}"),
        (None, None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "pos int, text string")
    got = [r["k"] for r in rows.orderBy("pos").select(identity.written_key("text").alias("k")).collect()]
    assert got == [k for _, k in cases]
