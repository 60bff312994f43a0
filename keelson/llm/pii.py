"""Personal data by weak supervision.

Patterns propose spans. Labelers - the strict pattern, a gazetteer, context words and the span's edges
- vote on each; expectation-maximisation estimates how many proposals of each kind are true and how reliable each
labeler is from how they agree, without labels. A labeler that can't judge a kind abstains there (the strict pattern,
on the looser kinds). The posteriors train the final span classifier, a naive Bayes model over kind, votes and
shape, which alone decides on the looser spans: no vote is a veto. Spans of the strict patterns always stay.

Built-in functions only. A candidate's kind, votes and shape form a small integer. Spark counts those; the
counts (768 at most, whatever the corpus) are what estimation and training run over, on the driver, and the
classifier is a sum of weights by bit, a column expression.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import Scratch

#: Order of kinds at the same start; the last two are the looser ones.
KINDS = ("email", "ip", "card", "phone", "masked_email", "local_phone")
BASE = KINDS[:4]

#: Possessive forms of the patterns: the same matches without backtracking. \G is the end of the match before.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked_email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({](?:dot|DOT)[\])}])\x20?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
}

#: Words that announce a kind.
CUES = {
    "email": "mail|contact|write|reach|courriel|correo",
    "ip": "ip|host|server|address|adresse|login|from",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|contact|anruf|appel|llam",
}
#: Gazetteers: top-level domains, and issuers' first digits of cards.
TOP_LEVEL = (
    "com org net edu gov mil int info biz io co ai app dev me tv eu uk us ca au nz ie de at ch fr be nl lu es pt it gr se no dk fi is pl cz sk hu ro bg hr si rs "
    "ua ru by lt lv ee tr il in pk cn hk tw jp kr sg my th vn id ph ae sa eg ma ng ke za br ar cl pe mx"
).split()
ISSUERS = [str(x) for x in (4, *range(51, 56), *range(2221, 2721), 34, 37, 6011, *range(644, 650), 65, 62, 36, 38, *range(300, 306), *range(3528, 3590))]
#: Calling codes: one digit, two digits, and the tens of which all ten are codes of three digits.
CALLING = ["1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()]
CALLING_TENS = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
LABELERS = ("strict", "gazetteer", "context", "edges")
#: Shape beside the votes: a long span, blanks inside, a blank or mark behind.
SHAPE = ("long", "blanks", "closed")
ROUNDS = 12
_KIND = 1 << (len(LABELERS) + len(SHAPE))


def _proposals(text: Column, kind: str, guard: Column) -> Column:
    """Matches of a kind with the lengths that place them: array of (kind, k, gap, size, value, before, after)."""
    pattern = PATTERNS[kind]
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rank = KINDS.index(kind)

    def placed(pair: Column, k: Column) -> Column:
        gap, hit = pair["g"], pair["v"]
        return F.struct(F.lit(rank).alias("kind"), k.alias("k"), F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("value"), F.right(gap, F.lit(40)).alias("before"), F.left(pair["n"], F.lit(1)).alias("after"))

    # gaps number one more than hits; a zip pads the last pair, which is dropped
    paired = F.arrays_zip(gaps.alias("g"), hits.alias("v"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("n"))
    found = F.filter(F.transform(paired, placed), lambda x: x["value"].isNotNull())
    none = F.array().cast("array<struct<kind:int,k:int,gap:int,size:int,value:string,before:string,after:string>>")
    return F.when(guard, found).otherwise(none)


def propose(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, doc_id and proposals of each row, written once; rid numbers the rows of the written table."""
    text = F.coalesce("text", F.lit(""))
    digits, at = F.col("text").rlike("[0-9]"), F.col("text").contains("@")
    guards = {"email": at, "ip": digits, "card": digits, "phone": F.col("text").contains("+") & digits, "masked_email": F.col("text").rlike(r"[\[({](?:at|AT)[\])}]"), "local_phone": digits}
    each = F.concat(*[_proposals(text, k, F.coalesce(g, F.lit(False))) for k, g in guards.items()])
    return scratch.save(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", each.alias("found")), "proposals")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _luhn_digit(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _luhn_digit(d: Column, i: Column) -> Column:
    double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.when(i % 2 == 1, double).otherwise(d)


def _strict() -> Column:
    value, digits = F.col("value"), F.regexp_replace("value", "[^0-9]", "")
    octet = F.forall(F.split("value", "\\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(x, F.lit("0")), 3, "0") <= "255"))
    tests = {
        "email": value.isNotNull(),
        "ip": octet,
        "card": F.length(digits).between(12, 19) & _luhn(digits),
        "phone": F.length(digits).between(9, 15),
    }
    return _by_kind(tests | {"masked_email": F.lit(False), "local_phone": F.lit(False)})


def _by_kind(of: dict[str, Column]) -> Column:
    chosen = F.lit(False)
    for kind, test in of.items():
        chosen = F.when(F.col("kind") == KINDS.index(kind), test).otherwise(chosen)
    return chosen


def _votes() -> dict[str, Column]:
    value, before = F.col("value"), F.lower("before")
    cue = lambda kind: before.rlike(f"(?:{CUES[kind]})[^\\n]*$")
    top = F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(TOP_LEVEL)
    digits = F.regexp_replace("value", "[^0-9]", "")
    first = lambda of, *sizes: reduce(or_, (F.left(digits, F.lit(n)).isin([x for x in of if len(x) == n]) for n in sizes))
    octet = F.split(value, "\\.")[0].try_cast("int")
    return {
        "strict": _strict(),
        "gazetteer": _by_kind({"email": top, "masked_email": top, "ip": octet.between(1, 223) & (octet != 127), "card": first(ISSUERS, 1, 2, 3, 4), "phone": first(CALLING, 1, 2) | F.left(digits, F.lit(2)).isin(CALLING_TENS), "local_phone": value.rlike("^\\(?[2-9]")}),
        "context": _by_kind({"email": cue("email"), "masked_email": cue("email"), "ip": cue("ip"), "card": cue("card"), "phone": cue("phone"), "local_phone": cue("phone")}),
        "edges": ~F.col("before").rlike("[0-9A-Za-z_.-]$") & ~F.col("after").rlike("^[0-9A-Za-z_]"),
    }


def _placed(found: DataFrame) -> DataFrame:
    """One row per proposal with start, end (code points), strict and code (votes and shape as an integer)."""
    rows = found.where(F.size("found") > 0).select("rid", "doc_id", F.explode("found").alias("x")).select("rid", "doc_id", "x.*")
    so_far = Window.partitionBy("rid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    votes = _votes()
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in votes.items()})
    shape = {"long": F.col("size") >= 14, "blanks": F.col("value").contains(" "), "closed": ~F.col("after").rlike("^[0-9A-Za-z_@/-]")}
    code = F.col("kind") * _KIND
    for k, bit in enumerate([*(F.col(x) for x in LABELERS), *(shape[x] for x in SHAPE)]):
        code = code + F.when(F.coalesce(bit, F.lit(False)), 1 << k).otherwise(0)
    return rows.select("rid", "doc_id", "kind", "start", "end", F.col("strict"), code.alias("code"))


def _speaks(k: int, kind: int) -> bool:
    """Whether labeler (or shape) k judges this kind: the strict pattern abstains on the looser ones."""
    return k > 0 or kind < len(BASE)


def _said(k: int, rates: tuple[float, float], yes: bool) -> float:
    on_true, on_false = rates
    return math.log(on_true / on_false) if yes else math.log((1 - on_true) / (1 - on_false))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _weighed(patterns: list[tuple[int, int]], priors: list[float], rates: list[tuple[float, float]], bits: int) -> tuple[list[float], list[tuple[float, float]], float]:
    """Priors by kind and rates of the first bits, counted with the posteriors that these priors and rates lead to, smoothed; and the part of true spans."""
    by_kind = [[0.0, 0.0] for _ in KINDS]
    yes, spoken = ([[0.0, 0.0] for _ in range(bits)] for _ in "ab")
    for code, n in patterns:
        kind = code // _KIND
        odds = _logit(priors[kind]) + sum(_said(k, r, code >> k & 1 == 1) for k, r in enumerate(rates) if _speaks(k, kind))
        true = n / (1 + math.exp(-odds))
        for side, weight in enumerate((true, n - true)):
            by_kind[kind][side] += weight
            for k in range(bits):
                if _speaks(k, kind):
                    spoken[k][side] += weight
                    yes[k][side] += weight * (code >> k & 1)
    # a labeler is taken to be more often right than wrong until it is seen to be otherwise
    fitted = [((y[0] + 2) / (a[0] + 3), (y[1] + 1) / (a[1] + 3)) for y, a in zip(yes, spoken)]
    part = (sum(x[0] for x in by_kind) + 1) / (sum(map(sum, by_kind)) + 2)
    return [(t + 1) / (t + f + 2) for t, f in by_kind], fitted, part


def _maximised(patterns: list[tuple[int, int]], rounds: int) -> tuple[list[float], list[tuple[float, float]], float]:
    priors, rates, part = [0.5] * len(KINDS), [(0.7, 0.3)] * len(LABELERS), 0.5
    for _ in range(rounds):
        priors, rates, part = _weighed(patterns, priors, rates, len(LABELERS))
    return priors, rates, part


def _counted(patterns: DataFrame) -> list[tuple[int, int]]:
    """Rows (code, n), in order so that sums of rounded numbers come out equal: as many as there are codes at most."""
    return sorted((r["code"], r["n"]) for r in patterns.collect())


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """The part of true spans, and of each labeler its votes' rates on true and on false spans.

    patterns: (code, n). Rates start from labelers that are mostly right, and are smoothed. Priors are by kind.
    """
    _, rates, part = _maximised(_counted(patterns), rounds)
    return part, rates


def train(patterns: DataFrame, rounds: int = ROUNDS) -> Column:
    """The span classifier: a test of code, fitted on the posteriors that expectation-maximisation ends with."""
    counted = _counted(patterns)
    priors, rates, _ = _maximised(counted, rounds)
    priors, rates, _ = _weighed(counted, priors, rates, len(LABELERS) + len(SHAPE))
    kind = F.expr(f"code div {_KIND}")
    score = F.get(F.array(*[F.lit(_logit(x)) for x in priors]), kind)
    for k, r in enumerate(rates):
        said = F.when(F.shiftright("code", k).bitwiseAND(F.lit(1)) == 1, _said(k, r, True)).otherwise(_said(k, r, False))
        score = score + (F.when(kind < len(BASE), said).otherwise(0.0) if k == 0 else said)
    return score > 0


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of each row of docs.

    spans lists kind:start:end by start, then kind, in code points; base_sha256 covers the strict
    patterns' spans alone. Added spans never overlap those. A null or empty text has none; repeated rows
    and null ids stay rows of their own; texts count whole, however long; spans of one start go in the order
    of KINDS; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = propose(docs.select("doc_id", "text"), scratch)
    placed = scratch.save(_placed(found), "placed")
    patterns = scratch.save(placed.groupBy("code").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    accepted = train(patterns)
    is_base = F.col("kind") < len(BASE)
    rows = placed.where((is_base & F.col("strict")) | (~is_base & accepted))
    order = Window.partitionBy("rid").orderBy("start", "kind")
    base_end = F.when(is_base, F.col("end"))
    base_start = F.when(is_base, F.col("start"))
    before = F.max(base_end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(base_start).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("_clear", is_base | ((F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end")))).where("_clear")
    span = F.struct("start", "kind", "end")
    grouped = rows.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("own"))
    none = found.join(rows.select("rid").distinct(), "rid", "left_anti").select("rid", "doc_id", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>").alias("own"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(own: Column) -> Column:
        return F.array_join(F.transform(own, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")

    count = lambda k: F.size(F.filter("own", lambda x: x["kind"] == k)).cast("bigint")
    base = F.filter("own", lambda x: x["kind"] < len(BASE))
    return grouped.unionByName(none).select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("own")).alias("spans"), (F.size("own") - F.size(base)).cast("bigint").alias("n_added"),
    )
