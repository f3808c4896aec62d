"""The registered queries: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_ids import read_shards, write_shards

    manifest = write_shards(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))
    return read_shards(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read, write

    return read(write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_versions

    return fingerprint_versions(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(pii.KINDS), 256).alias("base_sha256"), pii.joined([*pii.KINDS, pii.ADDED]).alias("spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import link_components

    return link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items with at least 75 percent of the item's 5-word shingles in the document."""
    from .decontaminate import find

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import credentials

    found = credentials.find(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in credentials.KINDS]
    return found.select("doc_id", *counts, F.sha2(credentials.joined(credentials.KINDS), 256).alias("base_sha256"), credentials.joined([*credentials.KINDS, *credentials.ADDED]).alias("spans"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import planted, runs

    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs(docs).withColumn("longest", F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))))
    length, period = -F.col("longest.l"), F.col("longest.period")
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {"op1_token_ids": op1_token_ids, "op2_warc": op2_warc, "op3_pii": op3_pii, "op4_packing": op4_packing, "op5_fingerprints": op5_fingerprints, "op6_language_id": op6_language_id, "op7_decontamination": op7_decontamination, "op8_minhash": op8_minhash, "op9_main_text": op9_main_text, "op10_url_filter": op10_url_filter, "op11_ranked_search": op11_ranked_search, "op12_secrets": op12_secrets, "op13_periodic_runs": op13_periodic_runs}


# Words of a text, A-Z lower-cased, and the distinct 5-word shingles.
_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SHINGLES = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))"

_OP7 = f"""
with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
ds as (select distinct doc_id, unnest({_SHINGLES}) as s from d),
bs as (select distinct item_id, unnest({_SHINGLES}) as s from b),
n as (select item_id, count(*) as n_item from bs group by item_id)
select doc_id, item_id, count(*) as n_shared, any_value(n_item) as n_item
from ds join bs using (s) join n using (item_id) group by doc_id, item_id having 100 * count(*) >= 75 * any_value(n_item)
"""

_OP8 = f"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then {_SHINGLES} when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 75 * (na.n + nb.n - shared)),
reach(a, b) as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a),
c as (select a, least(a, min(b)) as c from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.c, d.doc_id) as component_id, d.doc_id = coalesce(c.c, d.doc_id) as kept
from d left join n using (doc_id) left join c on c.a = d.doc_id
"""


_OP2 = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from p),
g as (select payload_digest, max(page_id) as first, count(*) as n from d where payload_bytes >= 1000 group by 1 having count(*) > 1)
select page_id, payload_bytes, payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from d left join g using (payload_digest)
"""


def _op10(levels: int = 6) -> str:
    """The template tree with its defaults, for paths of up to ``levels`` steps: a CTE for each level's pools, children and rows."""
    from .url_filter import BAD_WORDS, RULES, STEPS, margin

    ordered = sorted(RULES, key=lambda r: (len(r.text), r.text), reverse=True)
    fits = [f"(host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}')" for r in ordered]
    rule = "case " + " ".join(f"when {f} then '{r.text}'" for f, r in zip(fits, ordered, strict=True)) + " end"
    ruled = "case " + " ".join(f"when {f} then '{r.verdict}'" for f, r in zip(fits, ordered, strict=True)) + " end"
    words = ", ".join(f"'{w}'" for w in BAD_WORDS)
    bad_word = lambda c: f"list_has_any(regexp_split_to_array(lower({c}), '[^a-z]+'), [{words}])"
    e = f"{margin(0.05)!r}::double"
    step = "case when count(*) over w = 1 then child " + " ".join(f"when kind = '{k}' then '{v}'" for k, v in STEPS.items()) + " end"
    part = lambda x, of: f"case when {x} > 0 then {x} * ln({x} * labels / (({{n}}) * ({of}))) else 0 end"
    surprise = lambda x, n: (part(f"({x})", "bads") + " + " + part(f"(({n}) - ({x}))", "labels - bads")).replace("{n}", n)
    ctes = []
    for n in range(levels + 1):
        ctes.append(f"""p{n} as (select *, case when bads > 0 and bads < labels then greatest(bads * ln(labels::double / bads), (labels - bads) * ln(labels::double / (labels - bads))) else 0 end >= {e} and deep > {n} as more
  from (select host, code, sum(bad) as bads, sum(labelled) as labels, max(len(shape)) as deep, count(distinct case when labelled > 0 then coalesce(shape[{n + 1}], '') end) as kids from t{n} group by host, code)),
j{n} as (select * from t{n} join p{n} using (host, code)),
d{n} as (select host, shape, bad, labelled, code, case when deep > {n} then steps || ['**'] else steps end as template from j{n} where not more),
c{n} as (select host, code, coalesce(shape[{n + 1}], '') as child, sum(bad)::double as b, sum(labelled)::double as l, any_value(bads)::double as bads, any_value(labels)::double as labels, any_value(kids) as kids from j{n} where more group by all),
g{n} as (select *, case when l > 0 and labels > l then greatest({surprise("b", "l")}, {surprise("bads - b", "labels - l")}) end as odd from c{n}),
k{n} as (select host, code, child, case when odd >= {e} + ln(kids) then case when b * labels > bads * l then 'a' else 'b' end else 's' end as kind from g{n}),
s{n} as (select *, {step} as step from k{n} window w as (partition by host, code, kind)),
t{n + 1} as (select j{n}.host, shape, bad, labelled, code || kind as code, steps || [step] as steps from j{n} join s{n} on s{n}.host = j{n}.host and s{n}.code = j{n}.code and child = coalesce(shape[{n + 1}], '') where more)""".replace("code || kind as code", f"j{n}.code || kind as code"))
    return f"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, {rule} as rule, {ruled} as ruled, list_filter(string_split(path, '/'), lambda x: x <> '') as s from h),
p as (select page_id, host, path, rule, ruled, flatten(list_transform(s, lambda x: case when regexp_full_match(x, '[0-9]+') then [x[1] || '~', '{{n}}'] when regexp_full_match(x, '[0-9a-fA-F-]{{8,}}') and regexp_matches(x, '[0-9]') then ['{{id}}']
  when regexp_matches(x, '^[0-9]') then [x[1] || '~', regexp_replace(x, '[0-9]+', '{{n}}', 'g')] else [regexp_replace(x, '[0-9]+', '{{n}}', 'g')] end)) as shape, case when {bad_word("host")} or {bad_word("path")} or ruled = 'block' then 1 when ruled = 'allow' then 0 end as bad from r),
t0 as (select host, shape, coalesce(sum(bad), 0) as bad, count(bad) as labelled, '' as code, []::varchar[] as steps from p group by host, shape),
{", ".join(ctes)},
d as ({" union all ".join(f"select * from d{n}" for n in range(levels + 1))}),
x as (select host, sum(bad) as bads, sum(labelled) as labels from d group by host),
z as (select host, code, sum(bad) as b, sum(labelled) as l, any_value(bads) as bads, any_value(labels) as labels from d join x using (host) group by host, code),
y as (select host, code, (b + 2.0::double * ((bads - b + 0.4::double) / (labels - l + 2.0::double))) / (l + 2.0::double) as purity from z)
select page_id, p.host, path, rule, coalesce(ruled, case when purity >= 0.5 then 'block' else 'allow' end) as verdict, '/' || array_to_string(template, '/') as template, purity
from p join d on d.host = p.host and d.shape = p.shape join y on y.host = d.host and y.code = d.code
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP11 = f"""
with d as (select doc_id, {_TERMS} as t from documents), b as (select item_id, {_TERMS} as t from benchmark),
c as (select count(*)::bigint as docs, sum(len(t))::bigint as total from d where len(t) > 0),
q as (select item_id, term, count(*)::bigint as reps from (select item_id, unnest(t) as term from b) group by all),
f as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, len(t)::bigint as n, unnest(t) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, c group by term, docs),
s as (select item_id, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint as score from q join f using (term) join w using (term), c group by all)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank from s where score > 0) where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": _OP2, "op7_decontamination": _OP7, "op8_minhash": _OP8, "op10_url_filter": _op10(), "op11_ranked_search": _OP11}
