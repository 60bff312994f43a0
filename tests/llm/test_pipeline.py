import re

import corpus_pipeline
from test_decontaminate import plain as contaminated
from test_line_dedup import plain as without_boilerplate
from test_packing import one_by_one, whole_ids
from test_quality import base
from test_near import plain as roots_of

from keelson.llm import quality
from keelson.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept(text):
    n, chars, symbols, dup, _, failed = base(text)
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    stops = sum(w.lower() in quality.STOP_WORDS for w in WORD.findall(text or ""))
    values = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_lines": lines, "n_stop_words": stops}
    for r in quality.RULES:
        top, bottom = 1000 * values[r.top], values[r.bottom]
        if n >= r.words and ((r.least is not None and top < r.least * bottom) or (r.most is not None and top > r.most * bottom)):
            return False
    return not failed


def test_run_equals_a_plain_version(spark, sf_dir):
    rows = [r.asDict() for r in read(spark, sf_dir, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in read(spark, sf_dir, "benchmark").collect()]
    rows = [r for r in rows if kept(r["text"])]
    for r, t in zip(rows, without_boilerplate([(r["source"], r["text"]) for r in rows])):
        r["text"] = t
    rows.sort(key=lambda r: r["doc_id"])
    roots = roots_of([r["text"] for r in rows])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    rows = [r for r, c in zip(rows, contaminated([r["text"] for r in rows], items)) if not c[4]]
    ids = {r["doc_id"]: whole_ids(r["text"]) for r in rows}

    made = corpus_pipeline.run(spark, sf_dir).collect()
    lengths = {}
    for r in made:
        lengths.setdefault(r["doc_id"], []).append((r["piece"], r["length"]))
    assert {d: sum(n for _, n in own) for d, own in lengths.items()} == {d: len(x) for d, x in ids.items()}
    assert len({r["sequence_id"] for r in made}) == len(one_by_one([r["length"] for r in made], 2048))
    assert 0 < len(rows) < read(spark, sf_dir, "documents").count()


def test_stages_return_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
