import hashlib
import math
import random
import re

from llm_odd import ODD

from keelson.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": kind == "card" and 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


def texts():
    rng = random.Random(3)
    bits = ["a@b.co", "x.y+z@mail-1.example.com", "a@b.co_x@d.com", "@b.com", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "5472476151044309", "+1 (938) 555-1226", "+49.30.1234567", "+1", "+12 3", "(938) 555-1226", "938-555-1226", "bob [at] host [dot] com", "ann (at) web.org", "é🙂", "word", "7", "12", "3.14", "1 2 3 4 5 6 7 8 9 0 1 2 3", "…", "a.a.a.a@c.d.e.f"]
    made = list(ODD) + ["a@b" + ".c" * 20000, "1" + " 1" * 30000, "x" * 3000 + "@", "1." * 5000, "+1" + " 2" * 9000, "5 " * 500 + "4111111111111111"]
    for _ in range(150):
        made.append("".join(rng.choice(bits) + rng.choice([" ", ", ", "\n", "-", "", " call ", " mail: "]) for _ in range(rng.randrange(12))))
    return made


def test_base_spans_by_brute_force(spark, docs):
    all_texts = texts()
    rows = {r["doc_id"]: r for r in pii.find_personal_data(docs(all_texts)).collect()}
    assert len(rows) == len(all_texts)
    for k, text in enumerate(all_texts):
        expected, r = base(text), rows[k]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if x.split(":")[0] in FORMS] == expected, repr(text)[:200]
        assert [r[f"n_{n}"] for n in FORMS] == [sum(x.startswith(n) for x in expected) for n in FORMS]
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert len(spans) == len(expected) + r["n_added"]
        ends = [tuple(map(int, x.split(":")[1:])) for x in expected]
        for x in spans:
            if x.split(":")[0] not in FORMS:
                s, e = map(int, x.split(":")[1:])
                assert not any(s < b and a < e for a, b in ends)


def test_the_classifier_adds_announced_spans_and_no_bare_numbers(spark, docs):
    rng = random.Random(5)
    made = []
    for k in range(60):
        made.append(f"please call ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} or mail: user{k} [at] host{k} [dot] com today")
        made.append(f"call +1 (938) 555-{rng.randrange(1000, 9999)}, mail user{k}@host.com, ip 10.0.{k}.1")
        made.append(f"table {k} 12 7 300 cells and version 1.2.{k} of 2024-01-{k % 28 + 1:02d}")
    rows = {r["doc_id"]: r for r in pii.find_personal_data(docs(made)).collect()}
    assert all(rows[3 * k]["n_added"] == 2 for k in range(60))
    assert all(rows[3 * k + 2]["spans"] == "" for k in range(60))


def test_estimation_finds_the_labelers_reliabilities(spark):
    rng = random.Random(9)
    true_rates, counts = [(0.9, 0.05), (0.8, 0.2), (0.7, 0.1), (0.95, 0.3)], {}
    for _ in range(20000):
        y = rng.random() < 0.4
        code = sum((rng.random() < rates[0 if y else 1]) << k for k, rates in enumerate(true_rates))
        counts[code] = counts.get(code, 0) + 1
    prior, rates = pii.estimate(spark.createDataFrame(list(counts.items()), "code int, n bigint"), rounds=40)
    assert math.isclose(prior, 0.4, abs_tol=0.03)
    for (a, b), (x, y) in zip(true_rates, rates):
        assert math.isclose(a, x, abs_tol=0.04) and math.isclose(b, y, abs_tol=0.04)


def test_odd_tables_and_no_python(spark, docs):
    assert pii.find_personal_data(docs([])).count() == 0
    twice = docs(["a@b.co", "a@b.co", None], [None, None, 4]).withColumnRenamed("lang", "kind").withColumnRenamed("source", "found")
    assert sorted(r["n_email"] for r in pii.find_personal_data(twice).collect()) == [0, 1, 1]
    plan = pii.find_personal_data(docs(["a@b.co"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def verdicts(spark, true_rates, kinds=(4, 5)):
    """Of simulated votes, the classifier's verdict by kind and votes (gazetteer, context, edges)."""
    rng = random.Random(12)
    counts = {}
    for _ in range(30000):
        y = rng.random() < 0.5
        code = sum((rng.random() < rates[0 if y else 1]) << k for k, rates in enumerate(true_rates, 1))
        code += pii._KIND * rng.choice(kinds)
        counts[code] = counts.get(code, 0) + 1
    accepted = pii.train(spark.createDataFrame(list(counts.items()), "code int, n bigint"), rounds=40)
    every = spark.createDataFrame([(k * pii._KIND + 2 * v,) for k in kinds for v in range(8)], "code int")
    return {(r["code"] // pii._KIND, *((r["code"] >> k) & 1 for k in (1, 2, 3))): r["a"] for r in every.select("code", accepted.alias("a")).collect()}


def test_the_verdict_is_no_single_labeler(spark):
    found = verdicts(spark, [(0.8, 0.2), (0.75, 0.2), (0.8, 0.25)])
    for kind in (4, 5):
        assert {v: found[kind, *v] for v in [(1, 1, 0), (0, 1, 1), (1, 0, 1), (1, 1, 1)]} == dict.fromkeys([(1, 1, 0), (0, 1, 1), (1, 0, 1), (1, 1, 1)], True)
        assert not any(found[kind, *v] for v in [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)])


def test_an_unreliable_labeler_is_outvoted(spark):
    found = verdicts(spark, [(0.9, 0.1), (0.5, 0.5), (0.9, 0.15)])
    for kind in (4, 5):
        assert found[kind, 1, 0, 1] and found[kind, 1, 1, 1]  # the two that know decide, whatever the second says
        assert not found[kind, 0, 0, 0] and not found[kind, 0, 1, 0]


def test_added_spans_against_a_plain_version(spark, docs):
    """Loose patterns without possessive forms, the verdict by the classifier's own test."""
    mail = r"[A-Za-z0-9._%+-]+ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({](?:dot|DOT)[\])}]) ?[A-Za-z0-9-]+)+"
    rng = random.Random(8)
    made = [f"write to user{k} [at] host{k} [dot] {rng.choice(['com', 'zzq', 'pl'])} or {'see' if k % 3 else 'mail'} a{k}@host.org" for k in range(80)]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(docs(made)).collect()}
    for k, text in enumerate(made):
        m = re.search(mail, text)
        loose = [x for x in rows[k]["spans"].split(",") if x.startswith("masked")]
        assert loose in ([], [f"masked_email:{m.start()}:{m.end()}"])
    assert sum(r["n_added"] for r in rows.values()) > 70  # one without a listed domain isn't vetoed
