import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm.pii import BASE, KINDS, find, luhn, mod97, personal_data


def plain(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c not in " -"]
        if 14 <= len(d) <= 19 and sum(sum(divmod(2 * n, 10)) if i % 2 else n for i, n in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text("ab@.-+12 (9%é\n", max_size=80))
def test_base_is_the_plain_patterns(text):
    assert [(s.kind, s.start, s.end) for s in find(text) if KINDS.index(s.kind) < BASE] == plain(text)


def test_validators():
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    assert mod97("GB82 WEST 1234 5698 7654 32") and mod97("DE89370400440532013000") and not mod97("GB82 WEST 1234 5698 7654 33") and not mod97("GB82")


def test_long_numbers_take_linear_time():
    began = time.perf_counter()
    assert find("7" * 1_000_000 + " 10.0.0.1 1.2.3.4.5.6.7.8.9") == find(" " * 1_000_000 + " 10.0.0.1 1.2.3.4.5.6.7.8.9")
    assert [(s.start, s.end) for s in find("1.2.3.4.5.6.7.8.9.300.1.1.1")] == [(0, 7), (8, 15)]
    assert time.perf_counter() - began < 5


def test_other_kinds_leave_base_spans_alone():
    assert kinds("credit card +49 151 0000 0004") == ["phone"]
    text = "iban account DE89 3704 0044 0532 0130 00"
    assert kinds(text) == ["iban"]
    for text in ("iban GB33 BUKB 2020 1555 5555 55", "credit card 4222 2222 2222 2 call +1 743 555 3824", "visa 10.0.0.1 4222222222222"):
        spans = find(text)
        base = [s for s in spans if KINDS.index(s.kind) < BASE]
        assert all(b.end <= s.start or s.end <= b.start or s.kind == "iban" and s.start <= b.start and b.end <= s.end for s in spans if s not in base for b in base)


def kinds(text):
    return [s.kind for s in find(text)]


def test_kinds_and_context():
    assert kinds("write to a.b@c.example.org now") == ["email"]
    assert kinds("at 10.0.0.255 and 10.0.0.256, 1.2.3") == ["ip"]
    assert kinds("card 4539 5787 6362 1486.") == ["card"] and kinds("card 4539 5787 6362 1487.") == []
    assert kinds("call +1 (743) 555-3824 today") == ["phone"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 ok") == ["iban"]
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("phone 555-123-4567") == ["local_phone"] and kinds("row 555-123-4567") == []
    raised, lowered = find("email a@b.org")[0].score, find("sample a@b.org")[0].score
    assert raised > lowered and len(find("sample a@b.org")) == 1


def test_odd_rows(spark):
    long = "x " * 200000 + "a@b.org" + " 1" * 1000
    rows = [(1, None, "s"), (2, "", "s"), (3, long, "s"), (4, "é a@b.org 10.0.0.1", "s"), (4, "é a@b.org 10.0.0.1", "s"), (None, "a@b.org", "s"), (5, "0" * 6000 + ".1.1.1", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = personal_data(df).collect()
    assert len(found) == len(rows)
    by = {r["id"]: r for r in found}
    assert by[1]["base_sha256"] == by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[1]["spans"] == []
    assert [(s["kind"], s["start"], s["end"]) for s in by[4]["spans"]] == [("email", 2, 9), ("ip", 10, 18)]
    assert by[4]["base_sha256"] == hashlib.sha256(b"email:2:9,ip:10:18").hexdigest()
    assert [s["start"] for s in by[3]["spans"]] == [400000]
    assert personal_data(spark.createDataFrame([], df.schema)).collect() == []
