import random
import re

import duckdb
from llm_odd import ODD

from keelson.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = {}
    for k in range(len(words) - 4):
        places.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {k + j for own in places.values() if len(own) > 1 for k in own for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(6)
    words = ["the", "of", "und", "que", "alpha", "beta", "gamma.", "x#", "|", "é", "漢字"]
    made = list(ODD)
    for _ in range(80):
        own = []
        for _ in range(rng.randrange(60)):
            own.append(rng.choice(words) + rng.choice([" ", "\n", "\t", "  ", "\x0b", "\r\n"]))
        made.append("".join(own) + ("".join(own[:20]) if rng.random() < 0.4 else ""))
    return made


def test_counts_by_brute_force(spark, docs):
    all_texts = texts()
    rows = {r["doc_id"]: r for r in quality.judge(docs(all_texts)).collect()}
    for k, text in enumerate(all_texts):
        r = rows[k]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base(text), repr(text)[:80]
        assert not (r["base_failed"] and r["kept"])


def test_equal_to_its_sql(spark, docs):
    made = docs([t for t in texts() if t is None or len(t) < 6000])  # DuckDB copies a text's words for each of its windows
    con = duckdb.connect()
    con.register("documents", made.toPandas()[["doc_id", "text"]].astype({"text": object}).where(lambda d: d.notna(), None))
    theirs = con.execute(quality.oracle())
    names = [d[0] for d in theirs.description]
    rows = sorted(tuple(r) for r in theirs.fetchall())
    assert sorted(tuple(r) for r in quality.judge(made).select(*names).collect()) == rows


def test_rules_reject_what_they_name(spark, docs):
    prose = "The cat of the house sat on a mat and looked at birds that flew over trees in spring. "
    clean = "".join(prose.replace("cat", f"cat{k}").replace("birds", f"birds{k * 7}").replace("trees", f"trees{k * 3}").replace("house", f"house{k}").replace("mat ", f"mat{k} ").replace("spring", f"spring{k}").replace("looked at", f"looked{k} at{k}").replace("that flew over", f"that{k} flew{k} over") for k in range(12))
    cases = {
        "clean": (clean, None),
        "symbols": (" ".join(f"word{k}###" for k in range(60)), "ok_symbols"),
        "word_length": (" ".join("a" * 30 + str(k) for k in range(60)), "ok_word_length"),
        "stop_words": (" ".join(f"noun{k}" for k in range(200)), "ok_stop_words"),
        "repeated_lines": ("\n".join([f"line of {k % 4}" for k in range(30)]), "ok_repeated_lines"),
    }
    rows = quality.judge(docs([t for t, _ in cases.values()])).orderBy("doc_id").collect()
    for r, (name, (_, rule)) in zip(rows, cases.items()):
        assert r["kept"] is (name == "clean"), name
        assert rule is None or r[rule] is False, name


def test_keep_leaves_columns_alone(spark, docs):
    made = docs(["x " * 3, None, " ".join(f"the w{k} of" for k in range(20))])
    kept = quality.keep(made)
    assert kept.schema == made.schema and [r["doc_id"] for r in kept.collect()] == [2]
    clash = made.withColumnRenamed("lang", "words").withColumnRenamed("source", "kept")
    assert quality.keep(clash).columns == clash.columns and quality.keep(clash).count() == 1
    assert quality.judge(docs([])).count() == 0
    assert quality.judge(docs(["a"] * 3, [None, 1, 1])).count() == 3


def test_no_python_in_the_plan(spark, docs):
    plan = quality.judge(docs(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
