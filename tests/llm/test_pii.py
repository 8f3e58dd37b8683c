import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from llm_helpers import documents, frame

from fieldloom.llm.pii import BASE_KINDS, KINDS, candidates, personal_spans, span_list

# the published rules, as written
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return (kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in found.split(".")))
            or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15))


def expected(text):
    found = [(m.start(), KINDS.index(k), m.end()) for k, rule in RULES.items() for m in re.finditer(rule, text or "")
             if holds(k, m[0])]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def base(spark, texts):
    out = personal_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return {r[0]: r[1] for r in out.select("id", span_list(out["base"])).collect()}


def check(spark, texts):
    assert base(spark, texts) == {i: expected(t) for i, t in enumerate(texts)}


EDGES = [
    None, "", "a@b.c", "x@y@z.com", "x@y_z@w.com", "a@b.c._x@y.z", "a@b.c.d@e.f", "é@b.co ü 🙂 a.b+c@d-e.fr.", "1.2.3.4.5.6.7.8",
    "999.1.1.1 1.1.1.256 001.002.003.004", "1.2.3.4444 12345678901234567890.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111-",
    "x4111111111111111y", "41111111111111110000000", "4111  1111 1111 1111", "5 4111111111111111", "+1 (743) 555-3824", "++33 1 23 45 67 89",
    "+1 2 3", "+12345678901234567", "+49 30 901820 . next", "🙂🙂 +1 555 555 5555 a@b.de 10.0.0.1", "@@@ ... +++ ---",
]


def test_edges(spark):
    check(spark, EDGES)


def test_fully_separated_cards(spark):
    card = "4111111111111111"
    texts = ["card " + " ".join(card), "-".join(card), "card " + " ".join(card[:-1] + "2"), "1 2 3"]
    check(spark, texts)
    assert expected(texts[0]) == "card:5:36" and expected(texts[2]) == ""
    found = candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()
    like = {r["id"]: [KINDS[s["kind"]] for s in r["extra"]] for r in found}
    assert like == {0: [], 1: [], 2: ["card_like"], 3: []}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab@.+-_% 0123456789()é🙂\n", max_size=60), min_size=60, max_size=60))
def test_any_text(spark, texts):
    check(spark, texts)


def test_long_texts(spark):
    check(spark, ["a" * 100_000, "1" * 100_000, "1 " * 50_000, "a@" * 20_000, "ab@cd.ef " * 3_000, "+1" * 30_000, "1." * 50_000])


def test_documents_and_added_kinds(spark):
    docs = documents(spark)
    out = personal_spans(docs)
    rows = out.select("id", span_list(out["base"]).alias("base"), span_list(out["added"]).alias("added")).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["id"]: r["base"] for r in rows} == {i: expected(t) for i, t in texts.items()}
    planted = {i for i, t in texts.items() if re.search(r'token = "[0-9a-f]{40}"', t)}
    assert planted <= {r["id"] for r in rows if "secret" in r["added"]}


def test_repeated_rows_clashing_names_and_empty_tables(spark):
    out = personal_spans(frame(spark, (1, "a@b.com"), (1, "a@b.com"), (None, "a@b.com"), (2, None)))
    assert sorted(map(str, (tuple(r) for r in out.select("id", span_list(out["base"])).collect()))) == sorted(
        map(str, [(1, "email:0:7"), (1, "email:0:7"), (None, "email:0:7"), (2, "")]))
    assert personal_spans(frame(spark)).count() == 0
    assert KINDS[:4] == BASE_KINDS and hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
