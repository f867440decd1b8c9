import re

import pytest
from pyspark.sql import functions as F

from tickweave.llm.pii import with_pseudonyms

CARD = "4799 1346 8104 4206"
IP6 = ["2001:db8::1", "fe80::1", "::1", "2001:db8::", "2001:db8:0:1:1:1:1::", "1::2:3:4:5:6:7", "a::b:c0"]


def run(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    return {r.doc_id: r for r in with_pseudonyms(df, found="found", secret="k").collect()}


def test_what_starts_inside_a_failed_candidate_is_found(spark):
    texts = [
        f"2026 {CARD}", f"a\U0001f600 2026 1111 {CARD}, 2027 {CARD} 12 x@y.de", f"+49 {CARD}", f"{CARD} 4207 1985-02-28",
        f"2026 4799 1346 8104 4207 {CARD}", "1985-02-30 4799134681044207 b@c.de",
    ]
    got = run(spark, *texts)
    kinds = [[f.kind for f in got[k].found] for k in range(len(texts))]
    assert kinds == [["card"], ["card", "card", "email"], ["card"], ["card", "date"], ["card"], ["email"]]
    pseudonym = got[0].found[0].value
    assert got[0].text == f"2026 {pseudonym}" and pseudonym != CARD and re.fullmatch(r"4\d{3}( \d{4}){3}", pseudonym)
    for k in (1, 2, 3, 4):
        want = texts[k].replace(CARD, pseudonym)
        for f, old in zip([f for f in got[k].found if f.kind != "card"], ("1985-02-28",) if k == 3 else ("x@y.de",)):
            want = want.replace(old, f.value)
        assert got[k].text == want
    assert got[5].text == f"1985-02-30 4799134681044207 {got[5].found[0].value}"


@pytest.mark.parametrize("around", ["{}", "at [{}]:80, ", "2026 4799 1346 8104 x {}/64"])
def test_short_ip6(spark, around):
    got = run(spark, *(around.format(a) for a in IP6))
    for k, address in enumerate(IP6):
        (f,) = got[k].found
        assert f.kind == "ip6" and got[k].text == around.format(f.value)
        assert re.sub("[0-9a-f]", "0", f.value) == re.sub("[0-9a-f]", "0", address)


def test_what_is_no_short_ip6_stays(spark):
    texts = ["std::a1 a::b dead::beef :: 1:2:3 10:20:30 1::2::3 x::1 1", "1:2:3:4:5:6:7:8:9 1:2:3:4::5:6:7:8"]
    got = run(spark, *texts)
    assert [got[k].text for k in range(2)] == texts
    assert [f.kind for f in run(spark, "::ffff:192.0.2.1")[0].found] == ["ip"]


def test_dates_before_a_time(spark):
    texts = ["1985-02-28T10:00", "1985-02-28T10:00:00Z", "1985-02-28t100000", "1985-02-28", "1985-02-28Tx", "1985-02-28x"]
    got = run(spark, *texts)
    day = got[3].text
    assert [got[k].text for k in range(6)] == [f"{day}T10:00", f"{day}T10:00:00Z", f"{day}t100000", day, *texts[4:]]
    assert day != texts[3]
