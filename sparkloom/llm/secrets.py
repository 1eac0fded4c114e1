"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base rules find assignments, access identifiers and long hex runs. Beyond them, weak candidates
are looked for: bare key material (40 characters of base64 or more, with both cases and digits),
identifiers (named accounts, mail addresses, UUIDs) and endpoints (URLs, IPv4 addresses, named
hosts). Alone, none of them means a thing; they are reported only where complementary parts (an
identifier and a secret, or a secret and an endpoint) lie in one scope, a stretch of at most
`reach` code points between the ends of both. Parts that overlap do not complete each other.

One scan takes all parts with their places: a text is split at the matches of a pattern, and
running lengths of pieces and matches give the offsets. Lists grow by chunks of `_CHUNK` parts, so a
text of many parts costs in proportion to their number. Parts wait in a scratch table without
texts; the interval join runs over it by (row, stretch of `reach` code points), so the shuffle
carries a few numbers for each part. Both ends that an interval touches are joined, and no
bucket is held whole in memory.

Defined results: a null or empty text has no spans; repeated rows are scanned each for itself;
an empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise

# The contract's base rules, with both cases spelled out (fixed values).
_KEYWORD = (
    "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
)
ASSIGN = rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A greedy run that must be long enough matches the same stretches as any run filtered by length.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

# Weak parts. Possessive runs keep the scan linear.
WEAK = {
    "key": ("secret", r"(?<![A-Za-z0-9+/])(?=[A-Z0-9+/]*+[a-z])(?=[a-z0-9+/]*+[A-Z])(?=[A-Za-z+/]*+[0-9])[A-Za-z0-9+/]{40,}+"),
    "account": ("id", r"(?<![A-Za-z0-9])(?i:client_id|account_id|user_id|username|login|access_key_id)[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?[A-Za-z0-9_.@-]{4,}+"),
    "mail": ("id", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "uuid": ("id", r"(?<![A-Za-z0-9-])[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![A-Za-z0-9-])"),
    "endpoint": ("endpoint", r"(?:https?|ftp|s3|jdbc:[a-z]{2,16}|mongodb|postgres|mysql|redis|amqp)://[A-Za-z0-9._:@/-]{4,}+"),
    "address": ("endpoint", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?(?![0-9])"),
    "host": ("endpoint", r"(?<![A-Za-z0-9])(?i:host|hostname|server|endpoint|region)[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?[A-Za-z0-9_.-]{4,}+"),
}
# What each part gives when others are looked for: the identifier, the secret or the place.
ROLES = {"assign": "secret", "access": "id", "hex": "secret"} | {k: role for k, (role, _) in WEAK.items()}
# Roles that complete each other.
COMPLETES = {"secret": ("id", "endpoint"), "id": ("secret",), "endpoint": ("secret",)}
REACH = 400

_SPAN = "array<struct<kind:string,start:int,end:int>>"
_CHUNK = 256


def _numbers(items: Column) -> Column:
    """The numbers of the chunks of an array."""
    count = F.ceil(F.size(items) / _CHUNK).cast("int")
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def chunked(items: Column, zero: Column, kind: str, step, finish=lambda at: at) -> Column:
    """What step(state, item) adds for each item, in order, in one array of the given element type.

    step gives (state, array of what to add). Arrays are copied as they grow, so they grow in chunks:
    the work is _CHUNK for each item, and one for each pair of chunks. The state carries the items, as an
    expression in a lambda would be evaluated for each chunk. finish turns the last state and the array
    into the result.
    """
    many, chunks = f"array<{kind}>", f"array<array<{kind}>>"
    none = F.array().cast(many)
    def inner(acc, x):
        state, more = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], more).alias("out"))

    def outer(acc, k):
        return F.aggregate(
            F.slice(acc["items"], k * _CHUNK + 1, F.lit(_CHUNK)), F.struct(acc["state"].alias("state"), none.alias("out")), inner,
            lambda a: F.struct(acc["items"].alias("items"), a["state"].alias("state"), F.concat(acc["out"], F.array(a["out"])).alias("out")),
        )

    start = F.struct(items.alias("items"), zero.alias("state"), F.array().cast(chunks).alias("out"))
    return F.aggregate(_numbers(items), start, outer, lambda acc: finish(F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out"))))


def match_spans(text: Column, kind: str, pattern: str, keep=None) -> Column:
    """array<struct<kind,start,end>> of a pattern's matches, places in code points.

    keep: a condition on the matched text; matches that fail it are dropped afterwards.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))

    def step(at, x):
        start = at + x["gap"]
        end = start + F.length(x["m"])
        return end, F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("m")))

    spans = chunked(zipped, F.lit(0), "struct<kind:string,start:int,end:int,m:string>", step, lambda acc: acc["out"])
    if keep is not None:
        spans = F.filter(spans, lambda s: keep(s["m"]))
    spans = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """The base rules' spans by kind."""
    long_value = lambda m: F.length(F.regexp_extract(m, f"^(?:{ASSIGN})$", 2)) >= 6
    return {
        "assign": match_spans(text, "assign", ASSIGN, long_value),
        "access": match_spans(text, "access", ACCESS),
        "hex": match_spans(text, "hex", HEX),
    }


def ordered(spans: Column) -> Column:
    """Spans by start, then kind in the order base kinds, weak kinds, then end."""
    rank = {k: i for i, k in enumerate((*BASE, *WEAK))}
    place = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def parts_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, base, weak): the parts of each row, written once. rid numbers the rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(text)
    weak = [match_spans(text, kind, pattern) for kind, (_, pattern) in WEAK.items()]
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        F.monotonically_increasing_id().alias("rid"), "id",
        *[c.alias(k) for k, c in base.items()], F.concat(*weak).alias("weak"),
    )
    return materialise(found, "secret-parts")


def linked_weak(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(rid, linked): the weak candidates of each row that have a complementary part in reach."""
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    every = (
        parts.where(F.size("weak") > 0)
        .select("rid", F.explode(F.concat(*BASE, "weak")).alias("s"))
        .select("rid", "s.*", role[F.col("s.kind")].alias("role"))
    )
    bin_of = lambda c: F.floor(c / reach)
    wanted = F.create_map(*[x for r, others in COMPLETES.items() for x in (F.lit(r), F.array(*map(F.lit, others)))])
    weak = every.where(F.col("kind").isin(*WEAK)).select(
        "rid", "kind", "start", "end",
        F.explode(wanted[F.col("role")]).alias("role"),
        F.sequence(bin_of(F.greatest(F.col("start") - reach, F.lit(0))), bin_of(F.col("end") + reach)).alias("bins"),
    ).withColumn("bin", F.explode("bins")).drop("bins")
    partners = every.select(
        "rid", "role", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end")))).alias("bin"),
        F.col("start").alias("p_start"), F.col("end").alias("p_end"),
    )
    near = (F.col("p_start") <= F.col("end") + reach) & (F.col("p_end") >= F.col("start") - reach)
    overlaps = (F.col("p_start") < F.col("end")) & (F.col("p_end") > F.col("start"))
    hits = weak.alias("w").join(partners.alias("p"), (F.col("w.rid") == F.col("p.rid")) & (F.col("w.role") == F.col("p.role")) & (F.col("w.bin") == F.col("p.bin")) & near & ~overlaps, "left_semi")
    return hits.groupBy("rid").agg(F.collect_set(F.struct("kind", "start", "end")).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_spans, spans) of each row; spans also hold linked candidates."""
    parts = parts_table(docs, id_col, text_col)
    linked = linked_weak(parts, reach)
    base = ordered(F.concat(*BASE))
    return parts.join(linked, "rid", "left").select(
        "rid", "id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE],
        base.alias("base_spans"),
        ordered(F.concat(*BASE, F.coalesce("linked", F.array().cast(_SPAN)))).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """docs with every found stretch of the text replaced by `mark`; overlapping stretches merge.

    Rows without a finding stay as they are. Rows are scanned once and wait with their parts in
    a scratch table; only rows with weak candidates go through the interval join.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    weak = [match_spans(text, kind, pattern) for kind, (_, pattern) in WEAK.items()]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    flat = docs.select(
        F.monotonically_increasing_id().alias("rid"), row,
        *[c.alias(k) for k, c in base_spans(text).items()], F.concat(*weak).alias("weak"),
    )
    flat = materialise(flat, "secret-rows")
    linked = linked_weak(flat.select("rid", *BASE, "weak"), reach)
    none = F.array().cast(_SPAN)
    plain = flat.where(F.size("weak") == 0).withColumn("linked", none)
    joined_rows = flat.where(F.size("weak") > 0).join(linked, "rid", "left").withColumn("linked", F.coalesce("linked", none))
    every = plain.unionByName(joined_rows)

    body = F.col(f"row.`{text_col}`")
    changed = cut_out(body, F.concat(*BASE, "linked"), mark)
    found = F.size(F.concat(*BASE, "linked")) > 0
    return every.select(*[
        (F.when(found, changed).otherwise(body) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns
    ])


def cut_out(body: Column, spans: Column, mark: str) -> Column:
    """The text with every stretch of the spans replaced by the mark.

    A chunk of spans works on the part of the text that begins where the chunk before it ended, as
    places in a text are found by walking along it.
    """
    spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    none = F.array().cast("array<string>")

    def outer(acc, k):
        own = F.slice(acc["spans"], k * _CHUNK + 1, F.lit(_CHUNK))
        upto = F.greatest(acc["at"], F.array_max(F.transform(own, lambda s: s["end"])))
        part = F.substring(acc["rest"], F.lit(1), upto - acc["base"])

        def inner(a, s):
            gap = F.substring(a["part"], a["at"] - acc["base"] + 1, s["start"] - a["at"])
            inside = (s["start"] < a["at"]) & a["begun"]  # only lengthens the last stretch
            out = F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(gap, F.lit(mark))))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.lit(True).alias("begun"), a["part"].alias("part"), out.alias("out"))

        def finish(a):
            rest = F.substring(acc["rest"], a["at"] - acc["base"] + 1, F.length(acc["rest"]))
            out = F.concat(acc["out"], F.array(F.array_join(a["out"], "")))
            return F.struct(acc["spans"].alias("spans"), a["at"].alias("at"), a["begun"].alias("begun"), a["at"].alias("base"), rest.alias("rest"), out.alias("out"))

        zero = F.struct(acc["at"].alias("at"), acc["begun"].alias("begun"), part.alias("part"), none.alias("out"))
        return F.aggregate(own, zero, inner, finish)

    start = F.struct(spans.alias("spans"), F.lit(0).alias("at"), F.lit(False).alias("begun"), F.lit(0).alias("base"), body.alias("rest"), none.alias("out"))
    return F.aggregate(_numbers(spans), start, outer, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))
