"""Secret scan with multipart credential linking, with DataFrame functions alone.

Strong spans come from three patterns. Weak candidates (a bare random-looking value, a service
address) are reported only if complementary parts lie near each other: an interval join links
access identifiers with secret values and endpoints of the same scope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "weak_secret", "endpoint")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
#: A host name has 253 characters at most.
ENDPOINT = r"(?i)\b(?:https?://)?[a-z0-9.-]{1,253}\.(?:amazonaws\.com|core\.windows\.net|googleapis\.com)[^\s\"'<>]*"
SCOPE_CHARS = 512
#: Characters of the parts in which a text is masked.
PART_CHARS = 2_048


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as (start, rank, end, kind); offsets in code points.

    The text between matches and the matches alternate, so running sums of lengths place them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))
    placed = common.running(
        sizes,
        F.lit(0),
        lambda at, x: at + x["b"] + F.length(x["m"]),
        lambda at, x: F.struct((at + x["b"]).alias("s"), (at + x["b"] + F.length(x["m"])).alias("e"), x["m"].alias("m")),
        "struct<s:int,e:int,m:string>",
    )
    if keep is not None:
        placed = F.filter(placed, lambda x: keep(x["m"]))
    spans = F.transform(
        placed,
        lambda x: F.struct(
            x["s"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["e"].alias("end"), F.lit(kind).alias("kind")
        ),
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return F.when(F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)), spans).otherwise(none)


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 8


_FAR = 1 << 30


def _beside(spans: Column, **groups: Callable[[Column], Column]) -> Column:
    """Sorted spans as (x, before, after): the furthest end before and the nearest start behind, of each group."""
    names, state = list(groups), "struct<" + ",".join(f"{g}:int" for g in groups) + ">"
    span = "struct<start:int,rank:int,end:int,kind:string>"
    edge = lambda at: F.struct(*[F.lit(at).alias(g) for g in names])
    forward = common.running(
        spans,
        edge(-_FAR),
        lambda s, x: F.struct(*[F.when(groups[g](x), F.greatest(s[g], x["end"])).otherwise(s[g]).alias(g) for g in names]),
        lambda s, x: F.struct(x.alias("x"), s.alias("before")),
        f"struct<x:{span},before:{state}>",
    )
    backward = common.running(
        F.reverse(forward),
        edge(_FAR),
        lambda s, y: F.struct(*[F.when(groups[g](y["x"]), F.least(s[g], y["x"]["start"])).otherwise(s[g]).alias(g) for g in names]),
        lambda s, y: F.struct(y["x"].alias("x"), y["before"].alias("before"), s.alias("after")),
        f"struct<x:{span},before:{state},after:{state}>",
    )
    return F.reverse(backward)


def _near(y: Column, group: str, reach: int) -> Column:
    """Whether a span lies less than ``reach`` characters from one of a group."""
    return (y["x"]["start"] < y["before"][group] + reach) | (y["after"][group] < y["x"]["end"] + reach)


def _found(text: Column, scope_chars: int) -> tuple[Column, Column]:
    """Strong spans, and the weak ones that the interval join links.

    A scope never leaves its text, so the join runs over the span arrays of one row, as a merge of
    the sorted spans: nothing is shuffled, and no text meets another.
    """
    assign, access, hexes = _spans(text, ASSIGN, "assign", _long_value), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")
    weak, endpoint = _spans(text, WEAK_SECRET, "weak_secret"), _spans(text, ENDPOINT, "endpoint")
    base = F.array_sort(F.concat(assign, access, hexes))
    is_id, strong, secret = (lambda s: s["kind"] == "access"), (lambda s: s["rank"] < 3), (lambda s: ~s["kind"].isin("access", "endpoint"))

    def link(parts: Column) -> Column:
        both = _beside(F.array_sort(F.concat(parts["strong"], parts["weak"])), id=is_id, strong=strong)
        new = F.filter(both, lambda y: ~strong(y["x"]) & _near(y, "id", scope_chars) & ~_near(y, "strong", 0))

        def with_new(new: Column) -> Column:
            every = _beside(F.array_sort(F.concat(parts["strong"], new, parts["endpoint"])), id=is_id, secret=secret)
            near = F.filter(every, lambda y: (y["x"]["kind"] == "endpoint") & _near(y, "id", scope_chars) & _near(y, "secret", scope_chars))
            return F.array_sort(F.concat(new, F.transform(near, lambda y: y["x"])))

        return common.let(F.transform(new, lambda y: y["x"]), with_new)

    parts = F.struct(base.alias("strong"), weak.alias("weak"), endpoint.alias("endpoint"))
    # complementary parts must occur at all: most texts have no access identifier and skip the rest
    some = F.regexp_like(text, F.lit(ACCESS))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return base, F.when(some, common.let(parts, link)).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope_chars: int = SCOPE_CHARS) -> DataFrame:
    """(id_col, base, linked): spans of each row as arrays of (start, rank, end, kind).

    ``base`` has the spans of the three patterns, ``linked`` the weak candidates that share a scope
    with complementary parts: a weak secret within ``scope_chars`` of an access identifier, an
    endpoint within it of an access identifier and of a secret value (strong or weak). Both are
    ordered by start, then kind. Null and empty texts have none; repeated rows each get a row.
    Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    base, linked = _found(F.col("text"), scope_chars)
    return rows.select(F.col("id").alias(id_col), base.alias("base"), linked.alias("linked"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, hash and spans of every row's findings."""
    found = scan(docs, id_col, text_col)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col,
        *[count(k) for k in KINDS[:3]],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", scope_chars: int = SCOPE_CHARS) -> DataFrame:
    """The rows with every reported span replaced by a mark; all columns keep their names and order.

    A null text stays null, a row without findings keeps its text. Overlapping or touching spans
    are replaced as one.
    """
    base, linked = _found(F.coalesce(F.col("text"), F.lit("")), scope_chars)
    out = docs.select(common.boxed(docs), F.col(f"`{text_col}`").alias("text")).withColumn("spans", F.array_sort(F.concat(base, linked)))
    # pieces are taken from parts of the text: to reach a place, a string is read from its start
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART_CHARS}}}"), F.lit(0))
    part_of = lambda at: (at / PART_CHARS).cast("int")
    piece = lambda ps, a, b: F.substring(F.array_join(F.slice(ps, part_of(a) + 1, part_of(b) - part_of(a) + 1), ""), a % PART_CHARS + 1, b - a)

    def masked(cut: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(cut["m"], lambda x: x["b"].cast("int")))
        after = F.concat(F.transform(cut["m"], lambda x: x["a"].cast("int")), F.array(F.length("text")))
        return F.array_join(F.zip_with(before, after, lambda a, b: piece(cut["ps"], a, b)), mark)

    cut = F.struct(common.joined_spans(F.col("spans"), "start", "end").alias("m"), parts.alias("ps"))
    out = out.withColumn("text", F.when(F.size("spans") > 0, common.let(cut, masked)).otherwise(F.col("text")))
    return common.unboxed(out, docs.columns, **{text_col: F.col("text")})
