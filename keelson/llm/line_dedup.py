"""Removal of lines that recur over a site's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import Scratch

#: A line in more than this part of a host's pages, and on so many of them at least, is boilerplate. Hosts of every size are judged.
MOST_RATIO, LEAST_HOLDING = 0.1, 3
#: Boilerplate lines (by host and hash) and hosts broadcast at most; beyond it, the join is shuffled.
MOST_BROADCAST = 500_000
#: White space at the ends of a line, as in all of these operators.
BLANKS = "\t\n\x0b\x0c\r "

#: What of a page is no text, and what parts its lines.
_HIDDEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
_BREAKS = r"<[^>]*>|\n"
#: Entities that are decoded, the ampersand last, so that none is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def bare(line: Column) -> Column:
    """A line without the white space around it."""
    return F.trim(line, F.lit(BLANKS))


def _print(line: Column) -> Column:
    """128 bits that stand for a line; as a string, arrays of which Spark compares by hashing."""
    return F.concat(F.hex(F.xxhash64(line)), F.lit("."), F.hex(F.xxhash64(F.lit(1), line)))


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= MOST_BROADCAST else df


def boilerplate(pages: DataFrame, scratch: Scratch, most_ratio: float = MOST_RATIO, least_holding: int = LEAST_HOLDING) -> DataFrame:
    """(host, lines): by host, the prints of lines found in more than most_ratio and in least_holding or more of its pages.

    pages has host and lines (trimmed, array). A line counts once a page. Counts are summed in each
    task first, so neither a hot host nor a hot line meets in one task; a host has at most
    lines a page / most_ratio such lines.
    """
    each = pages.select("host", F.explode(F.transform(F.array_distinct("lines"), _print)).alias("line"))
    # a line that is too rare for any host needs no host's total
    counts = scratch.save(each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_holding), "counts")
    totals = scratch.save(pages.groupBy(F.col("host").alias("site")).agg(F.count(F.lit(1)).alias("total")), "totals")
    found = counts.join(_small(totals, totals.count()), F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > most_ratio * F.col("total"))
    return found.groupBy("host").agg(F.collect_list("line").alias("drop"))


def drop_boilerplate(df: DataFrame, host: Column, lines: Column, most_ratio: float = MOST_RATIO, least_holding: int = LEAST_HOLDING) -> DataFrame:
    """row (a struct of df's columns), kept (its lines less boilerplate), n_lines and n_dropped, a row for each row of df.

    lines is an array of strings; a line is compared without surrounding white space, and blank lines
    always stay. Null lines count as none; a null host is a host of its own; every row of df counts as
    a page, repeated rows included; an empty table gives no rows. Lines and pages may be of any length.
    A line in exactly most_ratio of the pages stays. Columns of any name may be there.
    """
    scratch = Scratch(df.sparkSession, "lines")
    none = F.array().cast("array<string>")
    trimmed = F.filter(F.transform(lines, bare), lambda x: F.length(x) > 0)
    pages = df.select(host.alias("host"), F.coalesce(trimmed, none).alias("lines"))
    found = scratch.save(boilerplate(pages, scratch, most_ratio, least_holding).withColumnRenamed("host", "_host"), "boilerplate")
    side = _small(found, found.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()[0])
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), host.alias("_own"), F.coalesce(lines, none).alias("_lines"))
    joined = own.join(side, F.col("_own").eqNullSafe(F.col("_host")), "left")
    # of the host's lines those that this page has: by hashing, so that a long list costs its length once
    joined = joined.withColumn("_hit", F.array_intersect(F.transform("_lines", lambda x: _print(bare(x))), F.coalesce("drop", none)))
    stays = lambda x: (F.length(bare(x)) == 0) | ~F.array_contains("_hit", _print(bare(x)))
    kept = F.when(F.size("_hit") == 0, F.col("_lines")).otherwise(F.filter("_lines", stays))
    return joined.withColumn("kept", kept).select(
        "row", "kept", F.size("_lines").cast("bigint").alias("n_lines"), (F.size("_lines") - F.size("kept")).cast("bigint").alias("n_dropped")
    )


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def html_lines(html: Column) -> Column:
    """The text of a page by blocks: what stands between tags and line breaks, without scripts, styles and comments, entities decoded."""

    def decoded(line: Column) -> Column:
        for name, char in ENTITIES:
            line = F.replace(line, F.lit(name), F.lit(char))
        return line

    shown = F.regexp_replace(html, _HIDDEN, "\n")
    return F.transform(F.filter(F.split(shown, _BREAKS), lambda x: F.length(bare(x)) > 0), decoded)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    found = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.nullif(found, F.lit(""))


def clean_pages(pages: DataFrame, most_ratio: float = MOST_RATIO, least_holding: int = LEAST_HOLDING) -> DataFrame:
    """page_id, host, n_lines, n_dropped and text (kept lines) of web pages, a row for each row.

    A null or empty html has no lines and an empty text; pages without a host (null or odd url) are one
    host; repeated rows count as pages each; ties are as in drop_boilerplate(); an empty table gives no
    rows; other columns are ignored. Whole pages count, however long.
    """
    found = drop_boilerplate(pages.select("page_id", "url", "html"), host_of(F.col("url")), html_lines(F.col("html")), most_ratio, least_holding)
    return found.select("row.page_id", host_of(F.col("row.url")).alias("host"), "n_lines", "n_dropped", F.array_join("kept", "\n").alias("text"))


def clean_documents(docs: DataFrame, most_ratio: float = MOST_RATIO, least_holding: int = LEAST_HOLDING) -> DataFrame:
    """docs with boilerplate lines of their source gone from text, and n_chars to match, if there is such a column.

    Null texts stay null and empty ones empty; null sources are one source; repeated rows count each and
    stay; a text without boilerplate is unchanged; an empty table gives no rows; other columns stay as
    they are, whatever their names.
    """
    found = drop_boilerplate(docs, F.col("source"), text_lines(F.col("text")), most_ratio, least_holding)
    own = lambda c: F.col(f"row.`{c}`")
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.array_join("kept", "\n")).otherwise(own("text"))
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return found.select(*[made.get(c, own(c)).alias(c) for c in docs.columns])


def oracle() -> str:
    """clean_pages() for DuckDB, with its own idea of white space."""
    decoded = "x"
    for name, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        decoded = f"replace({decoded}, '{name}', {char})"
    bare = r"regexp_replace({}, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')".format
    return rf"""
    WITH p AS (SELECT row_number() OVER () AS rid, page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
                      list_transform(list_filter(regexp_split_to_array(regexp_replace(coalesce(html, ''),
                        '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', chr(10), 'g'), '<[^>]*>|\n'),
                        lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')), lambda x: {decoded}) AS lines FROM pages),
    e AS (SELECT rid, host, page_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM p),
    b AS (SELECT e.host, {bare("line")} AS line FROM e JOIN (SELECT host, count(*) AS total FROM p GROUP BY host) t ON e.host IS NOT DISTINCT FROM t.host
          GROUP BY e.host, {bare("line")}, total HAVING count(DISTINCT rid) > {MOST_RATIO}::DOUBLE * total AND count(DISTINCT rid) >= {LEAST_HOLDING}),
    k AS (SELECT rid, list(line ORDER BY pos) AS kept FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.host IS NOT DISTINCT FROM e.host AND b.line = {bare("e.line")}) GROUP BY rid)
    SELECT page_id, host, len(lines) AS n_lines, len(lines) - coalesce(len(kept), 0) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text
    FROM p LEFT JOIN k USING (rid)
    """
