import hashlib
import random
import re
import time

from llm_odd import ODD

from keelson.llm import secrets

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [x for *_, x in sorted(out)]


def texts():
    rng = random.Random(4)
    hexa = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    made = list(ODD)
    for _ in range(120):
        bits = [f"token = \"{hexa(40)}\"", "password:short", "PassWord='long.enough+x'", "api_key=AKIA" + "B" * rng.choice([3, 12, 20]), hexa(31), hexa(32), "AKIAAKIA0123456789", "apikey : abc", "ſecret=abcdefgh1", "toKen=abcdefgh1", "secret=token=abcdefghi", "é", "word", "passwd\"  =  'x/y=zzzzzz"]
        made.append(rng.choice([" ", "\n", ""]).join(rng.choices(bits, k=rng.randrange(6))))
    return made


def test_base_by_brute_force(spark, docs):
    all_texts = texts()
    rows = {r["doc_id"]: r for r in secrets.find_secrets(docs(all_texts)).collect()}
    for k, text in enumerate(all_texts):
        expected, r = base(text or ""), rows[k]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if not x.startswith("novel")] == expected, repr(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(n) for x in expected) for n in ("assign", "access", "hex")]


def test_novelty_tells_random_strings_from_names(spark, docs):
    rng = random.Random(1)
    rand = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    found = [rand(32) for _ in range(30)]
    risky = [f"authorization bearer {x} end" for x in found]
    names = ["bearer get_access_token_from_refresh_token_v2", "auth 00000000000000000000000000000001", "private abcdefghijklmnopqrstuvwxyz0123", "credential username_password_default_value_1"]
    clean = [f"the string {rand(32)} stands alone", "secretary of the committee2024meetingroom was", *names]
    recurs = rand(32)
    clean.append(f"commit {recurs} built. auth {recurs}")
    rows = {r["doc_id"]: r for r in secrets.find_secrets(docs(risky + clean)).collect()}
    for k, x in enumerate(found):
        assert rows[k]["spans"] == f"novel:{risky[k].index(x)}:{risky[k].index(x) + 32}"
    assert [rows[len(risky) + k]["n_novel"] for k in range(len(clean))] == [0] * len(clean)


def test_odd_tables(spark, docs):
    assert secrets.find_secrets(docs([])).count() == 0
    same = docs(["token=abcdefgh"] * 2, [None, None]).withColumnRenamed("lang", "spans")
    assert [r["n_assign"] for r in secrets.find_secrets(same).collect()] == [1, 1]


def test_the_compressor_alone_tells_names_from_letters():
    names = "getUserAccountIdentifier refreshAccessTokenHandler correcthorsebatterystaple internationalization get_value_from_config MAX_RETRY_COUNT Einstellungen 2024-05-06 555-0100-1234 userProfileSettings documentation"
    for name in names.split():
        assert not secrets.novel_spans(f"the token {name} end", []), name
    assert secrets.novel_spans("the token qwLkZmPtRvXyBnHsJdFg end", []) == [(10, 30, "novel")]


def test_surroundings_of_any_distance_count():
    rng = random.Random(2)
    odd = "".join(rng.choices("QXZJKVWYqxzjkvwy0123456789", k=30))
    far = " ".join(f"line {k} of the log" for k in range(2000))
    assert secrets.novel_spans(f"the token {odd} end {far}", [])
    assert not secrets.novel_spans(f"the token {odd} end {far} build {odd} done", [])


def test_many_sensitive_words_take_seconds():
    text = "token " * 200_000
    began = time.process_time()
    assert secrets.novel_spans(text, secrets.base_spans(text)) == []
    assert time.process_time() - began < 20
