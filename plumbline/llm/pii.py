"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts a score.

Each kind is a `Kind`: a pattern, a confirming expression over the matched text (Luhn, mod-97,
number ranges), a score, and context words that raise it when they stand among the `REACH`
characters of the text before or after the match.  A span stays if its score reaches the threshold.  A
text is split by the pattern, and the lengths of the pieces give the places, so all of it is one
row-local projection without a shuffle or Python.

The patterns are written so that Java's matcher stays linear and iterative on texts of any
length: runs start only at their beginning (or where the last match ended) and repeat possessively,
and what repeats without bound is a single character guarded by a lookahead.  Characters by place
come out of chunks of a fixed length, so that a long text isn't walked from its start for each span.

Defined results: null text is empty for `spans` and null for `redact`; repeated rows and null doc_ids keep
their own result rows; further columns are kept by `redact` and ignored by `spans`; spans of several kinds
may overlap, and `redact` puts the first one's kind for all that hang together; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of at most 19 digits; zeros in front count nothing."""
    padded = F.lpad(digits, 19, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    terms = [F.substring(padded if k % 2 else doubled, k, 1).cast("int") for k in range(1, 20)]
    return reduce(lambda a, b: a + b, terms) % 10 == 0


def mod97(code: Column) -> Column:
    """The remainder of an account number: first four characters moved to the end, A as 10 to Z as 35."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    value = lambda c: F.when(F.ascii(c) < 58, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """apart: characters that may not adjoin a match; context: words that raise the score by boost."""

    name: str
    pattern: str
    confirm: Callable[[Column], Column] = lambda m: F.lit(True)
    score: float = 1.0
    context: str = ""
    boost: float = 0.0
    apart: str = ""


def _card(match: Column) -> Column:
    return F.length(_digits(match)).between(12, 19) & luhn(_digits(match))


def _account(match: Column) -> Column:
    code = F.replace(match, F.lit(" "), F.lit(""))
    return F.length(code).between(15, 34) & mod97(code)


#: The contract's kinds, in its order: what they confirm stays whatever stands around it.
BASE_KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?=\.[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"), 0.6, r"(?i)\bip\b|host|server|address", 0.3),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11}(?:(?![\x20-](?![0-9]))[0-9\x20-])*+", _card, 0.7, r"(?i)card|credit|visa|payment", 0.3),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.6, r"(?i)phone|mobile|call|\bfax\b|\btel\b", 0.3),
)
#: The method's own kinds: an account number needs its checksum, hexadecimal strings and social security numbers their context.
OWN_KINDS = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", _account, 0.8, r"(?i)iban|account|konto|cuenta|compte", 0.2),
    Kind("secret", r"[0-9A-Fa-f]{32,64}", score=0.3, context=r"(?i)token|secret|password|passwd|api.?key|access.?key", boost=0.5),
    Kind("key", r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64}", score=0.9),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", score=0.3, context=r"(?i)\bssn\b|social.security", boost=0.5, apart="0-9-"),
)
KINDS = BASE_KINDS + OWN_KINDS
#: Characters before and after a match that may hold its context words; and of a chunk.
REACH, CHUNK = 100, 1 << 14


def _chunks(text: Column) -> Column:
    return F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def _cut(chunks: Column, a: Column, b: Column) -> Column:
    """The characters a to b - 1."""
    i, j = (F.floor(x / CHUNK).cast("int") for x in (a, b))
    within = lambda x: (x % CHUNK).cast("int")
    chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    between = F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    several = F.concat(F.substring(chunk(i), within(a) + 1, F.lit(CHUNK)), between, F.substring(chunk(j), F.lit(1), within(b)))
    return F.when(i == j, F.substring(chunk(i), within(a) + 1, (b - a).cast("int"))).otherwise(several)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, kinds: Sequence[Kind] = KINDS, threshold: float = 0.5) -> Column:
    """All spans of a text, by start and then by the order of kinds; code points, end exclusive."""
    return F.array_sort(F.concat(*(_spans_of(text, kind, rank, threshold) for rank, kind in enumerate(kinds))))


def _spans_of(text: Column, kind: Kind, rank: int, threshold: float) -> Column:
    none = F.array().cast(SPAN)
    pieces, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda before, match: F.struct(F.length(before).alias("before"), match.alias("match")))

    def walked(chunks):
        def step(acc, pair):
            start = acc["at"] + pair["before"]
            end = start + F.length(pair["match"])
            before, after = _cut(chunks, F.greatest(start - REACH, F.lit(0)), start), _cut(chunks, end, end + REACH)
            score = F.lit(kind.score)
            if kind.context:
                score = score + F.when(before.rlike(kind.context) | after.rlike(kind.context), kind.boost).otherwise(0.0)
            sure = kind.confirm(pair["match"])
            if kind.apart:
                sure = sure & ~before.rlike(f"[{kind.apart}]$") & ~after.rlike(f"^[{kind.apart}]")
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
            kept = F.when(sure, _bound(span, lambda s: F.when(s["score"] >= threshold, F.array_append(acc["found"], s)).otherwise(acc["found"]))).otherwise(acc["found"])
            return F.struct(end.alias("at"), kept.cast(SPAN).alias("found"))

        begin = F.struct(F.lit(0).alias("at"), none.alias("found"))
        return F.aggregate(pairs, begin, step, lambda acc: acc["found"])

    return F.when(text.rlike(kind.pattern), _bound(_chunks(text), walked)).otherwise(none)


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(found: Column) -> Column:
    """The spans' scores in percent, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def find(docs: DataFrame, kinds: Sequence[Kind] = KINDS, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text) to (doc_id, found): every row's spans with their scores."""
    return docs.select("doc_id", spans(F.coalesce("text", F.lit("")), kinds, threshold).alias("found"))


def redact(text: Column, kinds: Sequence[Kind] = KINDS, threshold: float = 0.5) -> Column:
    """The text with its spans replaced by their kind in brackets; overlapping ones become one; null stays null."""
    found = "array<struct<start:int,end:int,kind:string>>"

    def merged(all_spans):
        def step(acc, s):
            last = F.get(acc, F.size(acc) - 1)
            longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
            new = F.array_append(acc, F.struct(s["start"], s["end"], s["kind"]))
            joined = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), longer)
            return F.when((F.size(acc) > 0) & (s["start"] < last["end"]), joined).otherwise(new).cast(found)

        return F.aggregate(all_spans, F.array().cast(found), step)

    def rebuilt(own):
        begins = lambda i: F.when(i == 0, 0).otherwise(F.get(own["spans"], i - 1)["end"])
        parts = F.transform(own["spans"], lambda s, i: F.concat(_cut(own["chunks"], begins(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        rest = _cut(own["chunks"], F.get(own["spans"], F.size(own["spans"]) - 1)["end"], F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    def chosen(all_spans):
        own = F.struct(merged(all_spans).alias("spans"), _chunks(text).alias("chunks"))
        return F.when(F.size(all_spans) == 0, text).otherwise(_bound(own, rebuilt))

    return F.when(text.isNotNull(), _bound(spans(text, kinds, threshold), chosen))
