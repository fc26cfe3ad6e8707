"""Personal data: pattern proposals, checksum validation, context scores.

All of it is DataFrame functions. For a pattern, ``regexp_extract_all`` gives
the matches and ``split`` the pieces between them; their lengths in code points
add up to the positions. The context of a match is read from the whole text
around it, across neighbouring matches. Patterns are written with possessive quantifiers and
run-start conditions, so that they find the leftmost non-overlapping matches of
the plain pattern without its backtracking on very long texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
#: A span that is not of a base kind stays at this score or more.
KEEP_SCORE = 0.6
CONTEXT_BONUS = 0.3


#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE BI", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BF BJ CM CF CG CI DJ FR GA GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SN SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Account numbers of their country's length; of other countries the longest run of groups."""
    def body(n: int) -> str:
        return f"(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    known = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}{body(n)}" for n, c in IBAN_LENGTHS.items())
    codes = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    return rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|(?!{codes})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[0-9]{{1,3}})?)"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: str  # words that raise the score when they stand nearby
    base: bool = True
    head: str = ""  # a match's first characters, if a match that fails may hold another; all starts are then tried

    def finds(self, after: str = "") -> str:
        """The pattern with one group: the match, or with ``after`` what follows it."""
        if self.head:
            return f"(?=(?:{self.pattern})({after})){self.head}" if after else f"(?=({self.pattern})){self.head}"
        return f"(?:{self.pattern})(?=({after}))" if after else f"({self.pattern})"

    def consumed(self) -> str:
        return f"(?={self.pattern}){self.head}" if self.head else self.pattern


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|write to"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, r"\bip\b|address|host|server|login"),
    # a maximal run of single-separated digits, kept only if it has 14 to 19 of them
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", 0.8, r"card|visa|credit|debit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, r"phone|call|tel|mobile|fax|whatsapp"),
    Kind("iban", _iban(), 0.7, r"iban|account|bank|transfer", base=False, head="[A-Z]{2}[0-9]{2}"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, r"ssn|social security|insurance", base=False),
)
_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double,base:boolean>"


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass Luhn's check."""
    digits = F.filter(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), ""), lambda c: c != "")

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(digits, weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters moved to the end."""
    flat = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(flat, 5, 1000), F.substring(flat, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        return F.when(c < "A", (a * 10 + (F.ascii(c) - 48)) % 97).otherwise((a * 100 + (F.ascii(c) - 55)) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "ssn":
        return ~value.rlike(r"^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _placed(kind: Kind, rank: int, text: Column, hits: Column) -> Column:
    """The spans of one kind: positions from the lengths of matches and pieces, then checks and scores."""
    pieces = F.split(text, kind.consumed(), -1)
    n = F.size(hits)
    after = F.regexp_extract_all(text, F.lit(kind.finds(rf"[\s\S]{{0,{CONTEXT_CHARS}}}")), F.lit(1))
    around = F.zip_with(F.slice(pieces, 1, n), after, lambda a, b: F.struct(a.alias("before"), b.alias("after")))
    pairs = F.zip_with(hits, around, lambda h, p: F.struct(h.alias("hit"), p["before"].alias("before"), p["after"].alias("after")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["before"])
        b = a + F.length(x["hit"])
        left = F.right(F.concat(acc["tail"], x["before"]), F.lit(CONTEXT_CHARS))
        near = F.lower(F.concat(left, F.lit(" "), x["after"]))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
        span = F.struct(a.alias("start"), F.lit(rank).alias("rank"), b.alias("end"), F.lit(kind.name).alias("kind"),
                        score.alias("score"), F.lit(kind.base).alias("base"))
        head = F.left(x["hit"], F.lit(4)) if kind.head else x["hit"]
        keep = valid(kind.name, x["hit"]) & (F.lit(kind.base) | (score >= KEEP_SCORE))
        if kind.head:
            keep = (a >= F.coalesce(F.get(acc["out"], F.size(acc["out"]) - 1)["end"], F.lit(0))) & keep
        out = F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        tail = F.right(F.concat(left, head), F.lit(CONTEXT_CHARS))
        return F.struct((a + F.length(head)).alias("at"), tail.alias("tail"), out.alias("out"))

    return F.when(n > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(f"array<{_SPAN}>"))


def with_spans(df: DataFrame, text_col: str, to: str = "spans") -> DataFrame:
    """``df`` with an array column: (start, rank, end, kind, score, base) by start, then kind.

    Positions are code points, ends exclusive. A null text counts as empty and
    has no spans. Texts are scanned whole.
    """
    work = df.withColumn("__text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    work = work.withColumns({f"__h{i}": F.regexp_extract_all("__text", F.lit(k.finds()), F.lit(1)) for i, k in enumerate(KINDS)})
    found = [_placed(k, i, F.col("__text"), F.col(f"__h{i}")) for i, k in enumerate(KINDS)]
    work = work.withColumn("__spans", F.array_sort(F.flatten(F.array(*found))))
    keep = [F.col(f"`{c}`") for c in df.columns if c != to]
    return work.select(*keep, F.col("__spans").alias(to))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, counts of the base kinds, digest of the base spans, all spans, their scores.

    Repeated rows stay; an empty table gives none; null texts count as empty.
    """
    work = with_spans(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t", "__s")
    base = F.filter("__s", lambda s: s["base"])
    count = lambda name: F.size(F.filter("__s", lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")
    return work.select(
        F.col("__id").alias(id_col), *[count(k.name) for k in KINDS if k.base],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__s")).alias("spans"),
        F.transform("__s", lambda s: F.round(s["score"], 2)).alias("scores"))


def redact(df: DataFrame, text_col: str) -> DataFrame:
    """``df``, same columns, with every span of ``text_col`` replaced by ``[KIND]``.

    Overlapping spans become one, named after the first. Texts without spans
    (null included) stay as they are.
    """
    work = with_spans(df, text_col, "__spans_of")
    text = F.col(f"`{text_col}`")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("__spans_of", start, step,
                        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    cols = [F.when(F.size("__spans_of") > 0, clean).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    return work.select(*cols)
