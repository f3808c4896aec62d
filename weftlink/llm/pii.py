"""Personal data in texts: base patterns, and identifiers found by bootstrapped contexts. Built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ["email", "ip", "card", "phone"]
ADDED = "id"
# Each finds the leftmost non-overlapping matches of its kind in time linear in the text: a match is only tried where a
# run of its characters begins (or, for an email, where the last match ended), and runs are never given back.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_MARK = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
# Identifier-like: a run of 6 or more letters, digits, _ and - with a digit.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
# An identifier written in groups: 2 or more runs of such characters, each with a digit, between single blanks or dots;
# of 2 characters or more where blanks part them. GROUPED_DIGITS digits or more in all.
_GROUP = r"(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{%d,}+"
GROUPED = r"(?<![A-Za-z0-9_-])(?:" + _GROUP % 2 + r"(?:[ .]" + _GROUP % 2 + r")++|" + _GROUP % 1 + r"(?:\." + _GROUP % 1 + r")++)"
GROUPED_DIGITS = 4
# Adjacent letters and digits change class this often in codes that people make up, and in values drawn at random from
# letters and digits; a value is random if the second is RANDOM_ODDS times as likely to have made its changes.
MADE_CHANGE, RANDOM_CHANGE, RANDOM_ODDS = 0.1, 0.4, 1000.0
CONTEXT = 256
_SPAN = "array<struct<start:int,end:int,match:string,left:string,right:string>>"


_BLOCK = 64
_SHIFT = 8  # blocks of 256 characters


def bound(value: Column, f) -> Column:
    """f of a value that is evaluated once, as a lambda's variable."""
    return F.transform(F.array(value), f)[0]


def running(x: Column, op, zero: int, levels: int = 2) -> Column:
    """At each place of an array of whole numbers, op over all up to it; x is a column or a lambda's variable.

    Blocks of _BLOCK are folded first, then each place within its block, so time is linear in the array's length.
    """
    fold = lambda part: F.aggregate(part, F.lit(zero), op)
    if levels == 0:
        return F.transform(x, lambda _, i: fold(F.slice(x, F.lit(1), i + 1)))
    last = F.greatest(F.shiftright(F.size(x) - 1, 6), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: fold(F.slice(x, k * _BLOCK + 1, F.lit(_BLOCK))))
    inside = lambda i: fold(F.slice(x, i - i % _BLOCK + 1, i % _BLOCK + 1))
    before = lambda upto, i: F.when(i < _BLOCK, F.lit(zero)).otherwise(F.get(upto, F.shiftright(i, 6) - 1))
    return bound(bound(blocks, lambda b: running(b, op, zero, levels - 1)), lambda upto: F.transform(x, lambda _, i: op(before(upto, i), inside(i))))


def located(text: Column, pattern: str) -> Column:
    """Matches with their places in code points, and up to CONTEXT characters before and after each.

    split() gives what lies between the matches, and lengths add up. In a context the neighbouring match stands as #, and
    what is beyond it follows, up to the match after that.
    """
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    sizes = lambda p: F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
    tail, head = (lambda g: F.right(g, F.lit(CONTEXT))), (lambda g: F.left(g, F.lit(CONTEXT)))
    gap = lambda p, i: F.get(p, i)["gap"]

    def one(p: Column, x: Column, i: Column, end: Column) -> Column:
        left = F.when(i == 0, tail(x["gap"])).otherwise(tail(F.concat(tail(gap(p, i - 1)), F.lit("#"), tail(x["gap"]))))
        right = F.when(F.get(p, i + 2).isNull(), head(gap(p, i + 1))).otherwise(head(F.concat(head(gap(p, i + 1)), F.lit("#"), head(gap(p, i + 2)))))
        return F.struct((end - F.length(x["match"])).alias("start"), end.alias("end"), x["match"].alias("match"), left.alias("left"), right.alias("right"))

    def every(both: Column) -> Column:
        return F.transform(F.slice(both["parts"], F.lit(1), F.size(both["parts"]) - 1), lambda x, i: one(both["parts"], x, i, F.get(both["ends"], i)))

    placed = lambda p: bound(F.struct(p.alias("parts"), bound(sizes(p), lambda x: running(x, lambda u, v: u + v, 0)).alias("ends")), every)
    return bound(parts, placed)


def luhn(match: Column) -> Column:
    """Whether the digits of a string pass the Luhn test."""
    digits = F.filter(F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), ""), lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def base(text: Column, kind: str) -> Column:
    """Spans of one kind that pass its test; failing matches are dropped."""
    pattern, mark = PATTERNS[kind], _MARK[kind]
    tests = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(_OCTETS),
        "card": luhn,
        "phone": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15),
    }
    found = F.filter(located(text, pattern), lambda x: tests[kind](x["match"]))
    there = text.rlike(pattern) if mark is None else text.contains(mark) & text.rlike(pattern)
    return F.when(there, found).otherwise(F.array().cast(_SPAN))


def candidates(text: Column) -> Column:
    """Identifier-like tokens, and identifiers written in groups, with their places and contexts."""
    none = F.array().cast(_SPAN)
    grouped = F.filter(located(text, GROUPED), lambda x: F.length(F.regexp_replace(x["match"], "[^0-9]", "")) >= GROUPED_DIGITS)
    return F.concat(F.when(text.rlike(CANDIDATE), located(text, CANDIDATE)).otherwise(none), F.when(text.rlike(GROUPED), grouped).otherwise(none))


def random_looking(value: Column) -> Column:
    """Whether letters and digits of a value alternate as in keys drawn at random rather than in codes of a few groups."""
    plain = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    changes = F.regexp_count(plain, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"))
    odds = changes * math.log(RANDOM_CHANGE / MADE_CHANGE) + (F.length(plain) - 1 - changes) * math.log((1 - RANDOM_CHANGE) / (1 - MADE_CHANGE))
    return odds >= math.log(RANDOM_ODDS)


def clean(word: Column) -> Column:
    """A word as it stands in patterns: lower-cased, without digits and outer marks other than = : and #."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}=:#]+|[^\p{L}\p{N}=:#]+$|[0-9]+", "")


def contexts(left: Column, right: Column) -> Column:
    """Lexical patterns of a place: the word before, the two words before, and the words on both sides."""
    word = r"([^\s]*)"
    one = clean(F.regexp_extract(left, rf"{word}[\s\"'(\[<]*$", 1))
    two = clean(F.regexp_extract(left, rf"{word}\s+[^\s]+[\s\"'(\[<]*$", 1))
    nxt = clean(F.regexp_extract(right, rf"^[^\s]*\s+{word}", 1))
    made = F.array(
        F.when(one != "", F.concat(F.lit("L "), one)),
        F.when((one != "") & (two != ""), F.concat(F.lit("LL "), two, F.lit(" "), one)),
        F.when((one != "") & (nxt != ""), F.concat(F.lit("LR "), one, F.lit(" _ "), nxt)),
    )
    return F.array_compact(made)


def word_counts(docs: DataFrame) -> DataFrame:
    """(pattern, uses): how often each word stands in the texts, as the pattern of one word before; summed before the shuffle."""
    words = docs.select(F.explode(F.split(F.col("text").cast("string"), r"\s+")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select(F.concat(F.lit("L "), clean(F.col("word"))).alias("pattern"), "n").where("pattern != 'L '").groupBy("pattern").agg(F.sum("n").alias("uses"))


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, key (of the text), the spans of each kind and the candidates, all with contexts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = F.when(F.col("text").rlike("[0-9]"), candidates(F.col("text"))).otherwise(F.array().cast(_SPAN))
    return rows.select("doc_id", F.xxhash64("text").alias("key"), *(base(F.col("text"), k).alias(k) for k in KINDS), near.alias("near"))


def bootstrap(found: DataFrame, words: DataFrame, least: float = 0.8, support: int = 5, doubt: float = 1.0) -> DataFrame:
    """(doc_id, key, start, end): identifiers off the base spans whose contexts are those of seed entities.

    Instances are the values of base spans and of candidates (identifier-like tokens, and identifiers in groups),
    patterns their contexts. Seed entities are the base spans, candidates that overlap one, and candidates that look
    random; no form of an identifier is named. Each round scores a pattern by the mean score of its distinct instances, ``doubt`` instances of score 0
    added, and an instance off the seeds by the mean of its patterns; patterns that reach ``least`` with at least
    ``support`` instances are trusted from then on, others count as 0. That asks for seeds in most instances. A word
    after which hardly anything but identifiers stands in the whole corpus (``words``, from word_counts) is a slot: there
    instances off the seeds tell nothing against it, and its score is that of its seeds alone, at least ``support`` of
    them, times the share of its uses that an identifier follows. Rounds go on until no pattern is new, which comes,
    as patterns are finite. Both scores run on the graph's distinct edges, so copies of a text count once and hot
    patterns are summed before they are shuffled. A candidate is found if one of its patterns is trusted and its value's
    score reaches ``least``; a seed that only looks random needs the trusted pattern as well, as it may name a file version.
    """
    bases = F.concat(*(F.col(k) for k in KINDS))
    covered = F.exists("bases", lambda s: (s["start"] < F.col("c.end")) & (F.col("c.start") < s["end"]))
    near = found.where(F.size("near") > 0).select("doc_id", "key", bases.alias("bases"), F.explode("near").alias("c")).select("doc_id", "key", "c", covered.alias("base"))
    places = near.union(found.select("doc_id", "key", F.explode(bases).alias("c"), F.lit(True)))
    seed = F.col("base") | random_looking(F.col("c.match"))
    places = places.select("doc_id", "key", "c.start", "c.end", F.xxhash64("c.match").alias("value"), "base", seed.alias("seed"), contexts(F.col("c.left"), F.col("c.right")).alias("patterns")).distinct()
    places = common.settle(places, "pii-places")
    edges = common.settle(places.select("value", F.explode("patterns").alias("pattern"), F.col("seed").cast("int").alias("seed")).groupBy("value", "pattern").agg(F.max("seed").alias("seed")), "pii-edges")
    held = places.where("start > 0").select("doc_id", "key", "start", F.explode("patterns").alias("pattern")).where("pattern like 'L %'").groupBy("pattern").agg(F.count(F.lit(1)).alias("held"))
    seeded = edges.groupBy("pattern").agg(F.sum("seed").alias("s")).where(F.col("s") >= support)
    slots = held.join(seeded, "pattern").join(words, "pattern").select("pattern", (F.least(F.col("held") / F.col("uses"), F.lit(1.0)) * F.col("s") / (F.col("s") + doubt)).alias("trust"))
    trusted = common.settle(slots.where(F.col("trust") >= least), "pii-slots")
    scores = edges.groupBy("value").agg(F.max("seed").cast("double").alias("score"), F.max("seed").alias("seeds"))
    known = -1
    while True:
        patterns = edges.join(scores, "value").groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + doubt)).alias("trust"), F.count(F.lit(1)).alias("instances"))
        strong = patterns.where((F.col("trust") >= least) & (F.col("instances") >= support)).select("pattern", "trust")
        strong = strong.union(trusted).groupBy("pattern").agg(F.max("trust").alias("trust"))
        trusted = common.settle(strong, "pii-patterns")
        judged = edges.join(trusted, "pattern", "left").groupBy("value").agg(F.max("seed").alias("seeds"), F.avg("trust").alias("mean"))
        scores = common.settle(judged.select("value", F.when(F.col("seeds") == 1, 1.0).otherwise(F.coalesce("mean", F.lit(0.0))).alias("score"), "seeds"), "pii-scores")
        was, known = known, trusted.count()
        if known == was:
            break
    open_ = places.where(~F.col("base")).select("doc_id", "key", "start", "end", "value", F.explode("patterns").alias("pattern"))
    good = scores.where(F.col("score") >= least).select("value")
    return open_.join(trusted.select("pattern"), "pattern", "left_semi").join(good, "value", "left_semi").select("doc_id", "key", "start", "end").distinct()


def outermost(ordered: Column) -> Column:
    """Spans that lie in no other, from (start, back) in order, where back is the negative end."""
    most = bound(F.transform(ordered, lambda x: (-x["back"]).cast("int")), lambda ends: running(ends, lambda u, v: F.greatest(u, v), -1))
    spans = bound(F.struct(ordered.alias("spans"), most.alias("most")), lambda s: F.transform(s["spans"], lambda x, i: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), F.when(i == 0, F.lit(-1)).otherwise(F.get(s["most"], i - 1)).alias("before"))))
    kept = F.filter(spans, lambda x: x["end"] > x["before"])
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, key, email, ip, card, phone, id: arrays of (start, end) in code points, end exclusive, by start.

    One row per row of docs. Base kinds follow their patterns and tests; id holds what the contexts add, off the base
    spans, without those that lie inside another. Null or empty text: no spans. Equal texts of one doc_id get equal
    spans, repeated rows stay repeated; a null doc_id is a value of its own. Patterns take time linear in a text of any
    length. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    found = common.settle(scan(docs), "pii-base")
    ordered = F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("back"))))
    more = bootstrap(found, word_counts(docs)).groupBy("doc_id", "key").agg(outermost(ordered).alias(ADDED))
    more = common.settle(more, "pii-added").select(F.col("doc_id").alias("d"), F.col("key").alias("k"), ADDED)
    out = found.drop("near").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    places = (F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS)
    return out.select("doc_id", "key", *places, F.coalesce(ADDED, F.array().cast("array<struct<start:int,end:int>>")).alias(ADDED))


def joined(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind and start, comma-joined."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def replaced(text: Column, spans: Column) -> Column:
    """text with the marks of spans (start, end, mark; in order) in their places, in time linear in both.

    The text is cut into blocks once, so that a piece of it is found without counting characters from the start.
    """
    size = 1 << _SHIFT

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        i, j = F.shiftright(start, _SHIFT), F.shiftright(end, _SHIFT)
        within = F.substring(F.get(blocks, i), start % size + 1, end - start)
        across = F.concat(F.substring(F.get(blocks, i), start % size + 1, F.lit(size)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.coalesce(F.substring(F.get(blocks, j), F.lit(1), end % size), F.lit("")))
        return F.when(start >= end, F.lit("")).when(i == j, within).otherwise(across)

    def write(x: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(x["ends"], i - 1))
        heads = F.filter(F.transform(x["spans"], lambda s, i: F.struct(s["start"].alias("start"), before(i).alias("before"), s["mark"].alias("mark"))), lambda h: h["start"] >= h["before"])
        parts = F.transform(heads, lambda h: F.concat(piece(x["blocks"], h["before"], h["start"]), h["mark"]))
        return F.concat(F.array_join(parts, ""), piece(x["blocks"], F.element_at(x["ends"], -1), x["size"]))

    ends = bound(F.transform(spans, lambda s: s["end"]), lambda e: running(e, lambda u, v: F.greatest(u, v), 0))
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))
    return bound(F.struct(spans.alias("spans"), ends.alias("ends"), blocks.alias("blocks"), F.length(text).alias("size")), write)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; of spans that overlap the first by place stands for all.

    All columns stay, whatever their names; n_chars, where there is one, becomes the new length of a changed text. Null
    text stays null, repeated rows stay repeated, an empty table stays empty.
    """
    spans = find(docs)

    def masked(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark")))

    doc, key, found = common.unused(docs, "span_doc", "span_key", "text_spans")
    marked = F.sort_array(F.concat(*map(masked, [*KINDS, ADDED])))
    hits = spans.select("doc_id", "key", marked.alias("spans")).where(F.size("spans") > 0).groupBy("doc_id", "key").agg(F.first("spans").alias("spans")).toDF(doc, key, found)
    hits = common.settle(hits, "pii-spans")
    text = F.col("text").cast("string")

    clean = replaced(text, F.col(found))
    new = F.when(F.col(found).isNull() | text.isNull(), text).otherwise(clean)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(key))
    out = docs.join(hits, same, "left").withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNull() | F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(common.columns(docs))
