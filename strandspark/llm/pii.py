"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame operations only. Matches and the gaps between them come from one expression each
(regexp_extract_all and split over the same pattern), which gives positions without a UDF. Patterns are
written so that no start of a run is tried twice: a long run of letters or digits costs its length once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

# The patterns of the four base kinds, in the order in which equal starts are listed.
# email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
# ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
# card  [0-9]([\x20-]?[0-9])+
# phone \+[0-9][\x20().0-9-]+[0-9]
# The forms below match the same spans; a run is entered at its start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ OM TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9_])(?:password|passwd|secret|token|api_key)\x20?[=:]\x20?\"?[A-Za-z0-9+/_-]{8,}+"


@dataclass(frozen=True)
class Kind:
    """score: of a confirmed span without context. near: words that raise it, far: that lower it, both
    looked for in the characters just before and after the span. Below keep the span is dropped."""

    name: str
    pattern: str
    quick: str
    confirm: str = ""
    score: float = 1.0
    near: str = ""
    far: str = ""
    keep: float = 0.0


KINDS = (
    Kind("email", EMAIL, "@", score=0.9, near="mail|contact|write"),
    Kind("ip", IP, r"[0-9]\.[0-9]", "ip", 0.7, near="address|host|server|client", far="version|release|section"),
    Kind("card", CARD, r"[0-9][ -]?[0-9]", "luhn", 0.7, near="card|visa|credit|payment", far="order|isbn|serial"),
    Kind("phone", PHONE, r"\+[0-9]", "digits", 0.7, near="phone|tel|call|mobile|fax"),
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", "mod97", 0.9, near="iban|account|bank"),
    Kind("ssn", SSN, "[0-9]-[0-9]{2}-[0-9]", "ssn", 0.4, near="ssn|social security", far="order|serial|part", keep=0.6),
    Kind("access_key", ACCESS_KEY, "AKIA", score=0.9, near="key|secret"),
    Kind("secret", SECRET, "[=:]", score=0.8, near="login|auth"),
)
BASE = ("email", "ip", "card", "phone")
#: Characters before and after a span that count as its context, and what context adds to or takes from a score.
CONTEXT, SHIFT = 40, 0.3


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten; other characters are skipped."""
    d = F.reverse(_digits(value))
    code = lambda i: F.ascii(F.substring(d, i + 1, F.lit(1))) - 48
    twice = lambda i: F.when(i % 2 == 0, code(i)).when(code(i) > 4, code(i) * 2 - 9).otherwise(code(i) * 2)
    total = F.aggregate(F.sequence(F.lit(0), F.least(F.length(d), F.lit(19)) - 1), F.lit(0), lambda a, i: a + twice(i))
    return F.length(d).between(12, 19) & (total % 10 == 0)


def mod97(value: Column) -> Column:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, remainder 1 by 97."""
    s = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    step = lambda a, c: F.when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.length(s).between(15, 34) & (F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1)


CONFIRM = {
    "": lambda v: F.lit(True),
    "luhn": luhn,
    "mod97": mod97,
    "digits": lambda v: F.length(_digits(v)).between(9, 15),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "ssn": lambda v: ~v.rlike("^(000|666|9..)|-00-|-0000$"),
}


PLACES = "array<struct<start:int,end:int,value:string>>"
#: Matches that are placed in one inner fold: arrays grow by copying, so a long text's are put together in pieces.
PIECE = 256


def places_of(found: Column, gaps: Column) -> Column:
    """array<struct<start,end,value>> from matches and the texts between them."""

    def step(acc: Column, i: Column) -> Column:
        value = F.get(found, i)
        start = acc["at"] + F.length(F.get(gaps, i))
        end = start + F.length(value)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value")))).alias("out"))

    def piece(acc: Column, k: Column) -> Column:
        return F.aggregate(
            F.sequence(k * PIECE, F.least((k + 1) * PIECE, F.size(found)) - 1), F.struct(acc["at"].alias("at"), F.array().cast(PLACES).alias("out"), acc["out"].alias("before")),
            lambda a, i: F.struct(step(a, i)["at"].alias("at"), step(a, i)["out"].alias("out"), a["before"].alias("before")), lambda a: F.struct(a["at"].alias("at"), F.concat(a["before"], a["out"]).alias("out")),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PIECE).cast("int")), zero, piece)["out"]).otherwise(F.array().cast(PLACES))


#: Characters of the pieces that a long text is cut into: what stands at a place is then looked up in its
#: piece, where a substring of the whole text would count characters from the start each time.
STRIDE = 1024


def strides(text: Column) -> Column:
    """The pieces of a text; none of one that is short."""
    return F.when(F.octet_length(text) > 4 * STRIDE, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRIDE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def cut(text: Column, pieces: Column, start: Column, n: Column) -> Column:
    """n characters from start on."""
    k = F.floor(start / STRIDE).cast("int")
    near = F.substring(F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit(""))), start - k * STRIDE + 1, n)
    return F.when((F.size(pieces) == 0) | (n > STRIDE), F.substring(text, start + 1, n)).otherwise(near)


def spans_of(text: Column, pieces: Column, kind: Kind, some: Column) -> Column:
    """array<struct<start,end,kind,value,score>> of the confirmed spans among places of one kind, by start;
    positions in characters, end exclusive."""
    sure = F.filter(some, lambda s: CONFIRM[kind.confirm](s["value"]))

    def scored(s: Column) -> Column:
        score = F.lit(kind.score)
        lo = F.greatest(s["start"] - CONTEXT, F.lit(0))
        around = F.lower(F.concat(cut(text, pieces, lo, F.least(s["start"], F.lit(CONTEXT))), F.lit(" "), cut(text, pieces, s["end"], F.lit(CONTEXT))))
        if kind.near:
            score = score + F.when(around.rlike(rf"\b({kind.near})"), SHIFT).otherwise(0.0)
        if kind.far:
            score = score - F.when(around.rlike(rf"\b({kind.far})"), SHIFT).otherwise(0.0)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), s["value"].alias("value"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))

    out = F.filter(F.transform(sure, scored), lambda s: s["score"] >= kind.keep) if kind.keep else F.transform(sure, scored)
    return out


def pii_spans(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, out_col: str = "spans") -> DataFrame:
    """docs with spans: array<struct<start,end,kind,value,score>>, by start, then by kind as listed.

    Base kinds (email, ip, card, phone) keep every confirmed span whatever its score; the others drop
    those below their kind's bound. Null and empty texts have none. Rows are independent; an own column
    named out_col is replaced, all others stay whatever their names. An empty table gives an empty result.
    """
    # each step is a column of its own: what a lambda refers to is then computed once for a row. Columns of
    # docs travel in a struct, so none of theirs is taken for one of these
    left = [c for c in docs.columns if c != out_col]
    df = docs.select(F.struct(*left).alias("__row") if left else F.lit(None).alias("__row"), F.coalesce(docs[text_col], F.lit("")).alias("__text"))
    names = [f"__k{i}" for i, _ in enumerate(kinds)]
    t, none = F.col("__text"), F.array().cast("array<string>")
    df = df.withColumn("__s", strides(t))
    df = df.withColumns({f"__f{i}": F.when(t.rlike(k.quick), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(none) for i, k in enumerate(kinds)})
    df = df.withColumns({f"__g{i}": F.when(F.size(f"__f{i}") > 0, F.split(t, k.pattern, -1)).otherwise(none) for i, k in enumerate(kinds)})
    df = df.withColumns({f"__p{i}": places_of(F.col(f"__f{i}"), F.col(f"__g{i}")) for i, _ in enumerate(kinds)})
    df = df.withColumns({n: spans_of(t, F.col("__s"), k, F.col(f"__p{i}")) for i, (n, k) in enumerate(zip(names, kinds))})
    rank = {k.name: i for i, k in enumerate(kinds)}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    keyed = F.transform(F.flatten(F.array(*names)), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), s["score"].alias("score")))
    plain = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), s["score"].alias("score")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,value:string,score:double>>")
    some = F.lit(False)
    for n in names:
        some = some | (F.size(n) > 0)
    return df.select(F.col("__row.*"), F.when(some, plain).otherwise(empty).alias(out_col))


def joined(spans: Column, base_only: bool) -> Column:
    """kind:start:end, comma-joined."""
    if base_only:
        spans = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with each span of text_col replaced by its kind in brackets, such as [email]. Overlapping
    spans go as one, named after the first. A null text stays null, an empty or very long one is treated as
    any other, repeated rows come back as often, an empty table is empty, and other columns stay as they
    are whatever their names."""
    row = docs.select(F.struct(*docs.columns).alias("row"), docs[text_col].alias("t"))
    found = pii_spans(row, "t", kinds, "found").withColumn("pieces", F.when(F.size("found") > 0, strides(F.col("t"))).otherwise(F.array().cast("array<string>")))
    zero = F.array().cast("array<int>")

    def ends(acc: Column, i: Column) -> Column:
        """The greatest end so far, for each span; as in places_of, in pieces."""
        return F.struct(F.greatest(acc["at"], F.get("found", i)["end"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def piece(acc: Column, k: Column) -> Column:
        return F.aggregate(
            F.sequence(k * PIECE, F.least((k + 1) * PIECE, F.size("found")) - 1), F.struct(acc["at"].alias("at"), zero.alias("out"), acc["out"].alias("before")),
            lambda a, i: F.struct(ends(a, i)["at"].alias("at"), ends(a, i)["out"].alias("out"), a["before"].alias("before")), lambda a: F.struct(a["at"].alias("at"), F.concat(a["before"], a["out"]).alias("out")),
        )

    first = F.struct(F.lit(0).alias("at"), zero.alias("out"))
    found = found.withColumn("to", F.when(F.size("found") > 0, F.aggregate(F.sequence(F.lit(0), F.floor((F.size("found") - 1) / PIECE).cast("int")), first, piece)).otherwise(first))

    def put(s: Column, i: Column) -> Column:
        at = F.get(F.col("to.out"), i)
        return F.when(s["start"] < at, "").otherwise(F.concat(cut(F.col("t"), F.col("pieces"), at, s["start"] - at), F.lit("["), s["kind"], F.lit("]")))

    new = F.when(F.size("found") == 0, F.col("t")).otherwise(F.concat(F.array_join(F.transform("found", put), ""), F.substring("t", F.col("to.at") + 1, F.length("t"))))
    return found.withColumn("new", new).select(*[F.col("new").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
