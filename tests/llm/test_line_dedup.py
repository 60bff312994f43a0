import random
import re

import duckdb
from llm_odd import ODD
from pyspark.sql import functions as F

from keelson.llm import line_dedup
from keelson.llm.common import Scratch


BLANKS = " \t\n\x0b\x0c\r"


def plain(rows, ratio=0.1, holding=3):
    """[(host, text)] -> kept texts."""
    pages, count = {}, {}
    for host, text in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(BLANKS) for x in (text or "").split("\n")} - {""}:
            count[host, line] = count.get((host, line), 0) + 1
    drop = {k for k, n in count.items() if n >= holding and n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(BLANKS) or (h, x.strip(BLANKS)) not in drop) for h, t in rows]


def corpus():
    rng = random.Random(8)
    rows = []
    for host, n in (("a", 200), ("b", 60), ("small", 19), (None, 30)):
        for k in range(n):
            lines = [f"own {host} {k} {j}" for j in range(rng.randrange(4))]
            if rng.random() < 0.3:
                lines.insert(0, rng.choice([" footer ", "\tfooter", "footer\r"]))
            if rng.random() < 0.08:
                lines.append("rare line")
            lines += ["footer"] * (rng.random() < 0.1) + [""] * (rng.random() < 0.2)
            rows.append((host, "\n".join(lines)))
    return rows + [("a", t) for t in ODD]


def test_documents_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "en", h, None if t is None else len(t)) for k, (h, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = line_dedup.clean_documents(df)
    assert found.schema.simpleString() == df.schema.simpleString()
    made = found.collect()
    assert len(made) == len(rows)
    expected = plain(rows)
    by_id = {r["doc_id"]: r for r in made}
    assert [by_id[k]["text"] for k in range(len(rows))] == expected
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in made)
    assert any(a != b for (_, a), b in zip(rows, expected))


def test_a_shuffled_join_gives_the_same(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "en", h, 0) for k, (h, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", -1)
    by_id = {r["doc_id"]: r["text"] for r in line_dedup.clean_documents(df).collect()}
    assert [by_id[k] for k in range(len(rows))] == plain(rows)


def test_hosts_and_blocks(spark):
    urls = {"http://A.example.com/x": "a.example.com", "https://m.b.org:80?q": "m.b.org", "ftp://u@h.net#f": "h.net", "nope": None, None: None}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r["url"]: r["h"] for r in df.select("url", line_dedup.host_of(F.col("url")).alias("h")).collect()} == urls
    html = spark.createDataFrame([("<p>one</p><b>two\nthree</b> <br>",)], "html string")
    assert html.select(line_dedup.html_lines(F.col("html"))).first()[0] == ["one", "two", "three"]
    hidden = spark.createDataFrame([("<SCRIPT x>a<b</script >&amp;lt; &lt;<!-- c\nd -->e<style>f",), (None,)], "html string")
    assert [r[0] for r in hidden.select(line_dedup.html_lines(F.col("html"))).collect()] == [["&lt; <", "e"], None]


def test_pages_equal_their_sql(spark):
    rows = [(k % 70, None if k % 31 == 30 else f"http://H{k % 3}.com/{k}", None if k % 37 == 36 else f"<p>menu {k % 2}\t</p><style>p {{}}</style><!-- <b>x</b> --><p> shared &amp;lt;</p><script>if (a < b) {k}</script><div>page {k}</div>") for k in range(120)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    con = duckdb.connect()
    con.register("pages", df.toPandas().astype(object).where(lambda d: d.notna(), None))
    theirs = con.execute(line_dedup.oracle())
    names = [d[0] for d in theirs.description]
    made = line_dedup.clean_pages(df)
    assert sorted(map(repr, (tuple(r) for r in made.select(*names).collect()))) == sorted(map(repr, theirs.fetchall()))
    assert any(r["n_dropped"] for r in made.collect())


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert line_dedup.clean_pages(df).count() == 0
    names = ("kept", "n_lines", "n_dropped", "drop", "row", "_host", "_own", "_lines", "_hit", "lines", "a.b")
    odd = spark.createDataFrame([(k, f"x{k}\nfoot", "s") for k in range(3)], "doc_id bigint, text string, source string").withColumns({c: F.lit(c) for c in names})
    found = line_dedup.clean_documents(odd)
    assert found.columns == odd.columns
    assert sorted(r["text"] for r in found.collect()) == ["x0", "x1", "x2"]


def test_boilerplate_counts_are_partial_first(spark):
    pages = spark.createDataFrame([("h", ["x"])], "host string, lines array<string>")
    plan = line_dedup.boilerplate(pages, Scratch(spark, "t"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
