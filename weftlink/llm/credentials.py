"""Secrets in texts: base patterns, and weak candidates that other parts of a credential confirm. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

KINDS = ["assign", "access", "hex"]
ADDED = ["id", "secret"]
REACH = 500

_SET = r"[\"']?\x20*[:=]\x20*[\"']?"
_KEYED = r"(?i)(?<![a-z0-9])(?:%s)" + _SET
# Each pattern finds its leftmost matches that don't overlap, in time linear in the text; group 1, where there is one, is
# the value. Matches of "assign" are tested after they are found, as a match that fails still takes its place.
PATTERNS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)" + _SET + r"([A-Za-z0-9+/_.=-]++)",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "endpoint": r"(?i)(?<![a-z0-9+.-])(?:[a-z][a-z0-9+.-]{0,31}+://[^\s\"'<>]++|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])(?::[0-9]++)?|(?:host(?:name)?|server|endpoint|base_?url|region|bucket|database|db_?name)" + _SET + r"[a-z0-9._:/-]{2,}+)",
    "id": _KEYED % r"user(?:_?name)?|login|account(?:_?id)?|client_?id|app_?id|key_?id|access_?key(?:_?id)?" + r"([a-z0-9@._+-]{3,}+)",
    "secret": _KEYED % r"pwd|pass(?:phrase|code)?|auth(?:orization)?|bearer|credentials?|signature|(?:private|shared|encryption)_?key" + r"([a-z0-9+/_.=-]{6,}+)",
    "loose": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
    "login": r"://[^\s:/@\"'<>]{1,128}+:[^\s/@\"'<>]{1,128}+@",
    "break": r"\n[ \t\r]*+\n",
}
_WEAK = ["id", "secret", "loose", "login"]
_LOOSE_CHARACTERS = 10
_STEPS = "array<struct<kind:string,i:int,gap:int,match:string>>"


def steps(text: Column, kind: str) -> Column:
    """Matches of a kind in order, each with the number of characters since the one before."""
    pattern = PATTERNS[kind]
    matches = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    found = F.transform(F.filter(matches, lambda x: x["match"].isNotNull()), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["match"].alias("match")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_STEPS))


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, row (a number of its own) and the steps of all kinds; blank lines only where weak parts are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = rows.select("doc_id", "text", F.concat(*(steps(F.col("text"), k) for k in _WEAK)).alias("weak"))
    other = F.concat(*(steps(F.col("text"), k) for k in ("endpoint", "break")))
    more = F.when(F.size("weak") > 0, F.concat("weak", other)).otherwise(F.array().cast(_STEPS))
    return near.select("doc_id", F.monotonically_increasing_id().alias("row"), F.concat(*(steps(F.col("text"), k) for k in KINDS), more).alias("steps"))


def parts(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end, value) of all matches that pass their kind's test; places by a running sum in each row and kind.

    Keyed values and the two halves of a login in a URL are parts of their own; kind "loose" is a long token of mixed
    letters and digits. Parts that hold a base match are left to that.
    """
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = scanned.where(F.size("steps") > 0).select("row", F.explode("steps").alias("s")).repartition("row").select("row", "s.*")
    found = found.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(order)).withColumn("start", F.col("end") - F.length("match"))
    value = F.coalesce(*(F.when(F.col("kind") == k, F.regexp_extract("match", PATTERNS[k], 1)) for k in ("assign", "id", "secret")), F.col("match"))
    m, n = F.col("match"), F.length("match")
    user = F.substring_index(F.substring(m, F.lit(4), n), ":", 1)
    after = F.length(user) + 4
    halves = F.array(
        F.struct(F.lit("id").alias("kind"), (F.col("start") + 3).alias("start"), (F.col("start") + 3 + F.length(user)).alias("end"), user.alias("value")),
        F.struct(F.lit("secret").alias("kind"), (F.col("start") + after).alias("start"), (F.col("end") - 1).alias("end"), F.substring(m, after + 1, n - after - 1).alias("value")),
    )
    begin = F.when(F.col("kind").isin("id", "secret"), F.col("end") - F.length(value)).otherwise(F.col("start"))
    one = F.array(F.struct("kind", begin.alias("start"), "end", value.alias("value")))
    out = found.select("row", F.explode(F.when(F.col("kind") == "login", halves).otherwise(one)).alias("p")).select("row", "p.*")
    v = F.col("value")
    base = v.rlike("|".join(PATTERNS[k] for k in ("access", "hex", "assign")))
    mixed = v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]") & (F.size(F.array_distinct(F.split(v, ""))) > _LOOSE_CHARACTERS)
    keep = F.when(F.col("kind") == "assign", F.length("value") >= 6).when(F.col("kind") == "loose", mixed & ~base).when(F.col("kind").isin("id", "secret"), ~base).otherwise(True)
    return out.where(keep)


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, kind, start, end, partners): base spans, and the weak candidates that complementary parts confirm.

    Scopes are the stretches between blank lines. A band join by window frames gives each weak part the nearest parts of
    each other kind that begin within ``reach`` characters in its scope, so no pairs are made. A weak identifier is
    reported next to a base secret (assign, hex), or next to a weak secret if an endpoint is there as well; a weak secret
    next to an access key, or next to a weak identifier and an endpoint. Parts that begin inside a base span, and loose
    tokens that begin inside an endpoint or a keyed value, are none. partners: kind:start:end of what confirms, joined.
    """
    kind = F.col("kind")
    place = Window.partitionBy("row").orderBy("start", kind == "loose")
    ahead = place.rowsBetween(Window.unboundedPreceding, -1)
    base_end = F.max(F.when(kind.isin(KINDS), F.col("end"))).over(Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    any_end = F.max(F.when(~kind.isin("loose", "break"), F.col("end"))).over(ahead)
    rows = found.select("*", base_end.alias("base_end"), any_end.alias("any_end"), F.sum((kind == "break").cast("long")).over(place.rowsBetween(Window.unboundedPreceding, 0)).alias("scope"))
    hidden = kind.isin(*ADDED, "loose") & (F.coalesce("base_end", F.lit(0)) > F.col("start")) | (kind == "loose") & (F.coalesce("any_end", F.lit(0)) > F.col("start"))
    rows = rows.where(~hidden & (kind != "break")).select("row", "scope", F.when(kind == "loose", "secret").otherwise(kind).alias("kind"), "start", "end")
    near = Window.partitionBy("row", "scope").orderBy("start")
    span = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))

    def nearest(*kinds: str) -> Column:
        of = F.when(kind.isin(*kinds), span)
        return F.coalesce(F.last(of, True).over(near.rangeBetween(-reach, 0)), F.first(of, True).over(near.rangeBetween(1, reach)))

    seen = rows.select("row", "kind", "start", "end", nearest("assign", "hex").alias("strong"), nearest("access").alias("access"), nearest("secret").alias("weak_secret"), nearest("id").alias("weak_id"), nearest("endpoint").alias("at"))
    of_id = F.when(F.col("strong").isNotNull(), F.concat_ws(",", "strong", "at")).when(F.col("weak_secret").isNotNull() & F.col("at").isNotNull(), F.concat_ws(",", "weak_secret", "at"))
    of_secret = F.when(F.col("access").isNotNull(), F.concat_ws(",", "access", "at")).when(F.col("weak_id").isNotNull() & F.col("at").isNotNull(), F.concat_ws(",", "weak_id", "at"))
    partners = F.when(kind == "id", of_id).when(kind == "secret", of_secret).when(kind.isin(KINDS), F.lit(""))
    return seen.select("row", "kind", "start", "end", partners.alias("partners")).where("partners is not null").distinct()


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, assign, access, hex, id, secret: arrays of (start, end, partners) in code points, end exclusive, by start.

    One row per row of docs (doc_id, text). Base kinds follow their patterns and tests and never change by what stands
    around them; id and secret hold the weak candidates that ``linked`` confirms, each with its partners. Null or empty
    text: no spans. Rows that repeat are scanned each and give the same spans; a null doc_id stays null. A text of any
    length takes time linear in it but for ordering its matches; only matches are shuffled, by row. An empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    found = common.settle(scan(docs), "secret-steps")
    each = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end", "partners")))).alias(k) for k in (*KINDS, *ADDED)]
    spans = linked(parts(found), reach).groupBy(F.col("row").alias("at")).agg(*each)
    none = F.array().cast("array<struct<start:bigint,end:bigint,partners:string>>")
    return found.select("doc_id", "row").join(spans, F.col("row") == F.col("at"), "left").select("doc_id", *(F.coalesce(k, none).alias(k) for k in (*KINDS, *ADDED)))


def joined(kinds: list[str]) -> Column:
    """kind:start:end of all spans by start, then kind in the order given, comma-joined."""

    def named(n: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("n"), F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")).alias("span")))

    return F.array_join(F.transform(F.sort_array(F.concat(*(named(n, k) for n, k in enumerate(kinds)))), lambda x: x["span"]), ",")
