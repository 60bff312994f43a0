"""Heuristic quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    """
    the of and to in that is was on for with this be at by it as are from or an
    le la les de des du un une et est que qui dans pour pas sur par au
    der die das und ist ein eine mit nicht von zu den auf im auch
    el los las y por con para se del no en su lo
    """.split()
)


@dataclass(frozen=True)
class Rule:
    """A ratio top / bottom in thousandths and its least and most allowed value.

    It holds for texts of at least `words` words only; a zero bottom passes.
    """

    name: str
    top: str
    bottom: str
    least: int | None = None
    most: int | None = None
    words: int = 0


#: Symbols a word; letters and marks a word; stop words a word; repeated lines a line.
RULES = (
    Rule("symbols", "n_symbols", "n_words", most=100),
    Rule("word_length", "word_chars", "n_words", least=2000, most=12000),
    Rule("stop_words", "n_stop_words", "n_words", least=10, words=100),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=400, words=10),
)
#: The base: fewest words, and the greatest part of words in repeated windows, in hundredths.
LEAST_WORDS, MOST_REPEATED = 10, 20


def _passes(rule: Rule) -> Column:
    top, bottom = 1000 * F.col(rule.top), F.col(rule.bottom)
    ok = F.lit(True)
    if rule.least is not None:
        ok = ok & (top >= rule.least * bottom)
    if rule.most is not None:
        ok = ok & (top <= rule.most * bottom)
    return ok | (F.col("n_words") < rule.words)


def _repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words to (.., words): words in 5-word windows found twice or more.

    Only a text with a repeated window hash sorts its windows. Each step is a column of its own, so
    that the next one's lambda reads it in place.
    """
    at = F.sequence(F.lit(0), F.size("words") - WINDOW)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    docs = docs.withColumn("_h", F.when(F.size("words") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("_pairs", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs).otherwise(none))
    twin = lambda e, k: (F.get("_pairs", k - 1)["h"] == e["h"]) | (F.get("_pairs", k + 1)["h"] == e["h"])
    docs = docs.withColumn("_at", F.sort_array(F.filter("_pairs", twin)["i"]))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    return docs.withColumn("n_repeat_words", covered).drop("_h", "_pairs", "_at")


def measure(docs: DataFrame) -> DataFrame:
    """Adds the counts that rules read, and per rule `ok_<name>`, base_failed and kept, to docs(text, ..).

    Built-in functions only, one pass, no shuffle. A null text counts as empty: no words, rejected.
    """
    has_word = lambda line: F.length(F.trim(line, F.lit(SPACE))) > 0
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("words", F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), ""))
    docs = docs.withColumn("_lines", F.filter(F.split(text, "\n"), has_word))
    docs = docs.withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
            "n_symbols": (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_stop_words": F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint"),
        }
    ).drop("_lines")
    docs = _repeated_words(docs).drop("words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    docs = docs.withColumns({f"ok_{r.name}": _passes(r) for r in RULES} | {"base_failed": failed})
    kept = ~F.col("base_failed")
    for rule in RULES:
        kept = kept & F.col(f"ok_{rule.name}")
    return docs.withColumn("kept", kept)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the rules' own results.

    A row for each row of docs, repeated rows and null ids included; columns other than doc_id and
    text are ignored; an empty table gives no rows.
    """
    found = measure(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[f"ok_{r.name}" for r in RULES])


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that every rule keeps; columns as they are."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    # a plain filter would be pushed below the columns that measure() builds on each other, and repeat them
    rows = measure(own).select(F.explode_outer(F.when(F.col("kept"), F.array("_row"))).alias("_row"))
    return rows.where("_row IS NOT NULL").select("_row.*")


def oracle() -> str:
    """The same as judge() without the rules' own results, for DuckDB."""
    space = "[\\x20\\x09-\\x0D]+"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)

    def passes(rule: Rule) -> str:
        ok = [f"1000 * {rule.top} >= {rule.least} * {rule.bottom}"] * (rule.least is not None)
        ok += [f"1000 * {rule.top} <= {rule.most} * {rule.bottom}"] * (rule.most is not None)
        return f"({' AND '.join(ok)} OR n_words < {rule.words})"

    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    g AS (SELECT rid, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}),
    h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(words, i, i + {WINDOW - 1})) AS n FROM g),
    c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM h, range({WINDOW}) r(k) WHERE n > 1 GROUP BY rid),
    m AS (SELECT doc_id, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
                 length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(lines) AS n_lines,
                 len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                 len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
                 coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
    b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
                 {", ".join(f"{passes(r)} AS ok_{r.name}" for r in RULES)} FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {" AND ".join(f"ok_{r.name}" for r in RULES)} AS kept, {", ".join(f"ok_{r.name}" for r in RULES)}
    FROM b
    """
