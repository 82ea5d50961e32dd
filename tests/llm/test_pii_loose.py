"""Looser shapes are found wherever they begin."""

from lodestack.llm import pii


def kinds(text):
    return [(t[0], t[4]) for t in pii.tokens(text, pii.base(text)) if not t[1]]


def test_starts_inside_tokens():
    assert kinds("to jane.doe [at] example [dot] org now") == [("email", "jane.doe [at] example [dot] org")]
    assert kinds("mail:jane.doe(at)example(dot)org") == [("email", "jane.doe(at)example(dot)org")]
    assert kinds("phone:555-010-7777") == [("phone", "555-010-7777")] and kinds("tel=(555) 010-7777") == [("phone", "555) 010-7777")]
    assert kinds("card=4111.1111.1111.1111") == [("card", "4111.1111.1111.1111")] and kinds("host:fe80:0:0:1:2") == [("ip", "fe80:0:0:1:2")]
    assert kinds("v2 x@") == [("", "v2"), ("", "x@")] and kinds("id 12345-6789012-345678-9") == [("", "12345-6789012-345678-9")]
    assert kinds("meet (at) noon") == [] and kinds("see a@b.cd") == []


def test_unseen_identifiers_behind_sure_contexts(spark):
    rows = [(i, f"Hello friend, phone: +1 (555) 010-{1000 + i} today") for i in range(6)]
    rows += [(10 + i, f"please write to ann{i}@example.org soon") for i in range(6)]
    rows += [(20, "so phone:555-010-7777 now"), (21, "please write to jane.doe [at] example [dot] org"), (22, "please write to jane.doe(at)example(dot)org"), (23, "jane.doe(at)example(dot)org")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(20, 24)] == ["phone:9:21", "email:16:47", "email:16:43", ""]


def test_long_texts_stay_linear():
    for t in ("a" * 100_000, "1" * 100_000, "1." * 50_000, "a:" * 50_000, "@" * 100_000, "a(at)" * 20_000, "1:" * 50_000, "-" * 100_000 + "(at)"):
        assert pii.tokens(t, pii.base(t)) is not None
