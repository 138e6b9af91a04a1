"""Secrets in texts: patterns that stand for themselves, and weak candidates that count only beside their other parts.

Three base kinds are always reported: assignments to a password-like name, access identifiers and long runs of hex.
Three weak kinds are parts of a credential: a name or identifier, an opaque string, an endpoint. A weak candidate
is reported only when complementary parts co-occur in its scope, the stretch of ``reach`` code points before and after it:
an identifier with a secret, a secret with an identifier, an endpoint with both. The parts of all kinds are joined by
interval: each covers bins of ``BIN`` code points, scopes meet the parts of their bins by equi-join on (row, bin), and the
distance decides. Parts of a kind do not overlap, so a bin holds a bounded number of them, whatever the text's length.

Everything is built-in functions: a match's place follows from the lengths of the pieces between matches, summed by a window
per text and kind. Texts are read once, no text is shuffled, and only texts with a match go past the first pass.

Spans are in code points, the end exclusive. A null text is empty, an empty text has no spans, a null id stays null and repeated rows
are rows of their own. An empty table gives no rows. Only the two named columns are read. Overlapping spans of different base kinds are all kept;
a weak candidate that overlaps a base span is not reported again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import stored

REACH = 200
BIN = 256
NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
HOLDERS = "[Uu][Ss][Ee][Rr](?:_?[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|(?:[Cc][Ll][Ii][Ee][Nn][Tt]|[Kk][Ee][Yy])_?[Ii][Dd]"
SIGN = r"""["']?\x20*[:=]\x20*["']?"""
#: In the order of the report: pattern, part of a credential. The group of a pattern, if any, is what its length is asked of.
KINDS = {
    "assign": (f"({NAMES}){SIGN}([A-Za-z0-9+/_.=-]+)", "secret"),
    "access": ("AKIA[A-Z0-9]{16,}", "identifier"),
    "hex": ("(?<![0-9a-f])[0-9a-f]{24,}", "secret"),
    "key_id": (f"({HOLDERS}){SIGN}([A-Za-z0-9@._+-]+)", "identifier"),
    "blob": ("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", "secret"),
    "endpoint": (r"""(?:https?|ftps?|s3a?|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]+""", "endpoint"),
}
BASE = ("assign", "access", "hex")
NAMED = list(KINDS)
HITS = "array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>"


def hits(text: Column, kind: str) -> Column:
    """The matches of a kind in order: code points since the last match, length, and whether it is kept."""
    pattern = F.lit(KINDS[kind][0])
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, KINDS[kind][0], -1), F.length)
    if kind in ("assign", "key_id"):
        kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda v: F.length(v) >= (6 if kind == "assign" else 3))
    elif kind == "blob":
        kept = F.transform(whole, lambda m: F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Za-z]")))
    else:
        kept = F.transform(whole, lambda m: F.lit(True))
    return F.transform(
        F.arrays_zip(whole.alias("m"), F.slice(gaps, F.lit(1), F.size(whole)).alias("g"), kept.alias("k")),
        lambda z, i: F.struct(F.lit(NAMED.index(kind)).alias("kind"), i.alias("i"), z["g"].alias("gap"), F.length(z["m"]).alias("len"), z["k"].alias("ok")),
    ).cast(HITS)


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, hits) of every text, one pass; patterns of weak kinds run only where a counterpart is."""
    none = F.array().cast(HITS)
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def seen(kind: str) -> Column:
        return F.contains(text, F.lit("AKIA")) if kind == "access" else F.rlike(text, F.lit(KINDS[kind][0]))

    first = narrow.select("*", *[F.when(seen(k), hits(text, k)).otherwise(none).alias(k) for k in BASE], seen("key_id").alias("named"))
    held = (F.size("access") > 0) | F.col("named")
    second = first.withColumn("blob", F.when(held, hits(text, "blob")).otherwise(none))
    both = held & ((F.size("assign") > 0) | (F.size("hex") > 0) | (F.size("blob") > 0))
    weak = F.when(both, F.concat(F.when(F.col("named"), hits(text, "key_id")).otherwise(none), F.col("blob"), hits(text, "endpoint"))).otherwise(none)
    return stored(second.select("row", "doc_id", F.concat(*BASE).alias("hits"), weak.alias("parts")))


def placed(found: DataFrame, column: str) -> DataFrame:
    """(row, kind, start, end) of the kept matches in ``column``."""
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = found.filter(F.size(column) > 0).select("row", F.inline(column))
    ends = F.sum((F.col("gap") + F.col("len")).cast("long")).over(upto)
    return each.withColumn("end", ends).filter("ok").select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def part_of(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(part) for _, part in KINDS.values()]), kind + 1)


def bins(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(F.greatest(first, F.lit(0)) / BIN), F.floor(last / BIN)))


def linked(base: DataFrame, weak: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak candidates whose complementary parts lie within ``reach``, by interval join."""
    at = ["row", "kind", "start", "end"]
    every = base.withColumn("strong", F.lit(True)).unionByName(weak.withColumn("strong", F.lit(False)))
    parts = every.select("row", part_of(F.col("kind")).alias("part"), F.col("start").alias("a"), F.col("end").alias("b"), "strong", bins(F.col("start"), F.col("end") - 1).alias("bin"))
    scopes = weak.select(*at, bins(F.col("start") - reach, F.col("end") + reach).alias("bin"))
    near = (F.col("a") - F.col("end") <= reach) & (F.col("start") - F.col("b") <= reach)
    over = F.col("strong") & (F.col("a") < F.col("end")) & (F.col("start") < F.col("b"))
    met = scopes.join(parts, ["row", "bin"]).filter(near).groupBy(*at).agg(
        F.bool_or(F.col("part") == "identifier").alias("identifier"), F.bool_or(F.col("part") == "secret").alias("secret"), F.bool_or(over).alias("known"))
    own = part_of(F.col("kind"))
    whole = F.when(own == "identifier", F.col("secret")).when(own == "secret", F.col("identifier")).otherwise(F.col("identifier") & F.col("secret"))
    return met.filter(whole & ~F.col("known")).select(*at)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(doc_id, spans) per row: spans ascend by start and kind, each with its kind's name, start and end, and whether it is a base span."""
    found = marked(docs, id_col, text_col)
    base = placed(found, "hits")
    weak = stored(placed(found, "parts"))
    extra = linked(base.join(weak.select("row").distinct(), "row", "left_semi"), weak, reach)
    spans = base.unionByName(extra).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    name = F.array(*[F.lit(k) for k in NAMED])
    kind = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    told = F.transform("spans", lambda s: F.struct(F.get(name, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["kind"] < len(BASE)).alias("base"))).cast(kind)
    return found.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce(told, F.array().cast(kind)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak): counts, and spans as text."""

    def text(keep=None) -> Column:
        chosen = F.filter("spans", keep) if keep else F.col("spans")
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(text(lambda s: s["base"]), 256).alias("base_sha256"), text().alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_weak"))
