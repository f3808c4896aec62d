"""The registered queries as DuckDB SQL."""

from __future__ import annotations

NOT_WORD = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]"
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
CANON = "MAP {'private':'pvt','limited':'ltd','corporation':'corp','incorporated':'inc','company':'co','street':'st','road':'rd','avenue':'ave','boulevard':'blvd'}"


def simple(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '{NOT_WORD}', ' ', 'g'), '{SPACES}', ' ', 'g'))"


def canonical(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda t: coalesce(({CANON})[t], t)), ' ')"


def tokens(c: str) -> str:
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda t: t <> ''))"


def grams(c: str) -> str:
    return f"(case when length({c}) >= 3 then list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) else [] end)"


def short_grams(c: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(2, length({c}) - 1)), lambda i: substr({c}, i, 3)))"


def jaccard(a: str, b: str) -> str:
    return f"(case when len({a}) = 0 or len({b}) = 0 then 0.0::double else len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) end)"


def profile_jaccard(a: str, b: str) -> str:
    return f"(case when {a} = '' and {b} = '' then 1.0::double when {a} = '' or {b} = '' then 0.0::double else {jaccard(short_grams(a), short_grams(b))} end)"


# DuckDB compares names byte by byte. Names hold no capitals or punctuation, so every other character gets one of these:
# the measures only ask which characters are equal.
BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^`{|}~"
CHARS = "chars as (select coalesce(string_agg(c, '' order by c), '') as s from (select distinct unnest(regexp_extract_all(business_name, '[^\\x00-\\x7f]')) as c from er))"


def coded(c: str) -> str:
    return f"translate({c}, (select s from chars), '{BYTES}')"


def keep(rows: str, key: str, n: str, name: str) -> str:
    """CTE that numbers rows by md5 and marks the first n."""
    return f"{name} as (select *, row_number() over (order by md5({key} || '42'), {key}) <= {n} as chosen from {rows})"


ER = f"""words as (select doc_id, lang, source, list_filter(string_split({simple("text")}, ' '), lambda x: x <> '') as t from documents),
er as (select 'S' || (cast(substr(source, 4) as int) % 3 + 1) || '-' || lpad(cast(doc_id as varchar), 7, '0') as entity_id, array_to_string(t[1:4], ' ') as business_name,
  array_to_string(t[5:12], ' ') as business_address, upper(lang) as country, array_to_string(t[13:20], ' ') as link from words),
s1 as (select * from er where entity_id like 'S1-%'), pool as (select * from er where entity_id not like 'S1-%'),
links as (select distinct s1.entity_id as s1_id, pool.entity_id as pool_id from s1 join pool using (link) where link <> ''),
truth as (select entity_id as source1_entity_id, coalesce(ids, '') as matched_entity_ids from s1 left join (select s1_id, string_agg(pool_id, ',' order by pool_id) as ids from links group by s1_id) on s1_id = entity_id)"""
EXACT = "exact as (select s1.entity_id as s1_id, pool.entity_id as pool_id from s1 join pool using (country, business_name) where business_name <> '' and country not in ('', 'UNKNOWN'))"
HOT = """hot as (select country, business_name from (select country, business_name, count(*) as n from s1 group by all) join (select country, business_name, count(*) as m from pool group by all) using (country, business_name)
  where n * m > 50 and business_name <> '' and country not in ('', 'UNKNOWN'))"""
PAIRS = f"""{EXACT}, ids as (select * from exact union select * from links),
pairs as (select s1_id, pool_id, a.business_name as business_name_1, a.business_address as business_address_1, a.country as country_1, b.business_name as business_name_2, b.business_address as business_address_2, b.country as country_2
  from ids join s1 a on a.entity_id = s1_id join pool b on b.entity_id = pool_id)"""


def tfidf(max_df: float = 0.03, cap: int = 150_000) -> str:
    def counts(rows: str) -> str:
        return f"""select country, entity_id, gram, count(*) as tf from (select country, entity_id, unnest(list_transform(range(1, greatest(2, length(p) - 1)), lambda i: substr(p, i, 3))) as gram
  from (select country, entity_id, ' ' || unnest(list_filter(string_split(business_name, ' '), lambda t: t <> '')) || ' ' as p from {rows} where country not in ('', 'UNKNOWN'))) group by all"""

    def weighted(counts_name: str) -> str:
        return f"""select country, entity_id, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by country, entity_id)) as w from {counts_name} join vocab using (country, gram)"""

    return f"""c2 as ({counts("pool")}), c1 as ({counts("s1")}),
sizes as (select country, count(*) as n from pool group by country),
vocab as (select country, gram, df, ln((1 + n) / (1 + df)) + 1 as idf from (select *, row_number() over (partition by country order by total desc, gram) as rank
  from (select country, gram, count(*) as df, sum(tf) as total from c2 group by all) join sizes using (country) where df >= 2 and df <= {max_df} * n) where rank <= {cap}),
w2 as ({weighted("c2")}), w1 as ({weighted("c1")}),
cosines as (select w1.entity_id as s1_id, w2.entity_id as pool_id, sum(w1.w * w2.w) as cosine from w1 join w2 using (country, gram) group by all having sum(w1.w * w2.w) > 0.65)"""


HEX = "cast('0x' || substr(md5({0}), {1}, {2}) as bigint)"
NEGATIVES = f"""np as (select count(*) as n from pool), ranked as (select entity_id as pool_id, row_number() over (order by md5(entity_id || '42'), entity_id) - 1 as place from pool),
steps as (select list(k order by k) as ks from (select k from range(1, 100000) t(k), np where gcd(k, n) = 1 order by k limit 1024)),
spoiled as (select s1_id as entity_id, count(*) as m from links group by s1_id),
draws as (select entity_id as s1_id, {HEX.format("entity_id || '42'", 1, 15)} as first, ks[{HEX.format("entity_id || '42'", 16, 8)} % len(ks) + 1] as step, unnest(range(0, least(2 + coalesce(m, 0), n))) as draw, n from s1 left join spoiled using (entity_id), steps, np),
picked as (select s1_id, pool_id, draw from draws join ranked on place = (first + draw * step) % n),
negatives as (select s1_id, pool_id from (select *, row_number() over (partition by s1_id order by draw) as r from picked anti join links using (s1_id, pool_id)) where r <= 2)"""
JUDGED = f"""{NEGATIVES}, both_ids as (select s1_id, pool_id, 1 as is_match from links union all select s1_id, pool_id, 0 from negatives),
named as (select s1_id, pool_id, is_match, a.business_name as n1, b.business_name as n2, a.business_address as a1, b.business_address as a2, a.country as c1, b.country as c2 from both_ids join s1 a on a.entity_id = s1_id join pool b on b.entity_id = pool_id),
judged as (select s1_id, pool_id, is_match, n1, n2, (n1 = n2)::int as exact_name, (a1 = a2)::int as exact_addr, (c1 = c2 and c1 <> '')::int as country_match, {jaccard(tokens("n1"), tokens("n2"))} as name_token_jaccard, {jaccard(tokens("a1"), tokens("a2"))} as address_token_jaccard,
  {profile_jaccard("n1", "n2")} as name_3gram_jaccard, {profile_jaccard("a1", "a2")} as address_3gram_jaccard from named)"""
SCORES = f"""{CHARS}, {PAIRS}, scores as (select s1_id as source1_entity_id, pool_id as candidate_entity_id, round(0.4::double * jaro_winkler_similarity({coded("business_name_1")}, {coded("business_name_2")}) + 0.3::double * {jaccard(grams("business_name_1"), grams("business_name_2"))}
  + 0.2::double * {jaccard(tokens("business_address_1"), tokens("business_address_2"))} + 0.1::double * (country_1 = country_2 and country_1 <> '')::int, 9) as p from pairs),
levels as (select unnest([0.70, 0.75, 0.80, 0.85, 0.90, 0.95])::double as threshold),
sweep as (select threshold, entity_id as source1_entity_id, coalesce(ids, '') as matched_entity_ids from s1 cross join levels left join
  (select threshold as t, source1_entity_id as s, string_agg(distinct candidate_entity_id, ',' order by candidate_entity_id) as ids from scores join levels on p > threshold group by all) on t = threshold and s = entity_id),
lists as (select threshold, source1_entity_id, list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') as found from sweep),
f as (select threshold, source1_entity_id, case when len(own) = 0 then (len(found) = 0)::int::double when len(found) = 0 or len(list_intersect(own, found)) = 0 then 0.0::double else
  1.25::double * (hits / len(found)) * (hits / len(own)) / (0.25::double * hits / len(found) + hits / len(own)) end as f05
  from (select *, len(list_intersect(own, found))::double as hits from (select source1_entity_id, list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') as own from truth) join lists using (source1_entity_id)))"""


def er(tail: str, *ctes: str) -> str:
    return "with " + ",\n".join([ER, *ctes]) + "\n" + tail


MATCHES = "m as (select source1_entity_id, len(ids) as n, len(list_filter(ids, lambda x: x like 'S2-%')) as n2, len(list_filter(ids, lambda x: x like 'S3-%')) as n3 from (select source1_entity_id, list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') as ids from truth))"
SPLIT_A = ",\n".join([
    "n0 as (select cast(ceil(0.1 * count(*)) as bigint) as n from s1)", keep("s1", "entity_id", "(select n from n0)", "a0"), "r0 as (select entity_id from a0 where not chosen)",
    "n1 as (select cast(ceil(0.2::double / (1 - 0.1::double) * count(*)) as bigint) as n from r0)", keep("r0", "entity_id", "(select n from n1)", "a1"),
    "parts as (select entity_id, 'test' as part from a0 where chosen union all select entity_id, case when chosen then 'val' else 'train' end from a1)",
])


def counts(column: str, rows: str, by: str = "") -> str:
    return f"select {by}coalesce({column}, 'MISSING') as {column}, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 2) as percent from {rows} group by all"


SQL: dict[str, str] = {
    "normalize_text": f"select doc_id, md5({canonical('s')}) as text_md5, trim(upper(coalesce(lang, 'UNKNOWN'))) as country from (select doc_id, lang, {simple('text')} as s from documents)",
    "canonical_tokens": er(f"select entity_id, {canonical('n')} as name from (select entity_id, business_name || ' ' || ['private', 'limited', 'road', 'company', 'boulevard', 'limitedness'][cast(substr(entity_id, 4) as int) % 6 + 1] as n from pool)"),
    "country_filter": er("select entity_id, country from pool where country = 'DE'"),
    "null_filter": er("select entity_id, business_address as address from pool where business_address <> ''"),
    "pool_union_all": er("select entity_id, business_name, business_address, country from pool"),
    "country_except": er("select distinct country from s1 except select country from (select country, round(100.0::double * count(*) / sum(count(*)) over (), 2) as percent from pool group by country) where percent >= 12"),
    "distinct_countries": er("select distinct country from pool"),
    "equality_flags": er("select s1_id, pool_id, (business_name_1 = business_name_2)::int as same_name, (business_address_1 = business_address_2)::int as same_address, (country_1 = country_2)::int as same_country from pairs join links using (s1_id, pool_id)", PAIRS),
    "block_exact_name": er("select * from exact", EXACT),
    "block_tfidf_cosine": er("select s1_id, pool_id, round(cosine, 6) as cosine from cosines", tfidf(1.0, 2**62)),
    "block_name_members": er("select country, business_name, side, id from hot join (select country, business_name, 1 as side, entity_id as id from s1 union all select country, business_name, 2, entity_id from pool) using (country, business_name)", HOT),
    "block_names_expanded": er("select * from exact", EXACT),
    "block_ngram_jaccard": er(f"select s1_id, pool_id, round(j, 9) as jaccard from (select a.entity_id as s1_id, b.entity_id as pool_id, {jaccard('a.g', 'b.g')} as j from (select *, {grams('business_name')} as g from s1) a join (select *, {grams('business_name')} as g from pool) b using (country)) where j > 0.4::double"),
    "candidate_pairs_distinct": er("select * from exact union select s1_id, pool_id from cosines", EXACT, tfidf()),
    "candidate_lists": er("select entity_id as source1_entity_id, coalesce(string_agg(distinct pool_id, ',' order by pool_id), '') as candidate_entity_ids from s1 left join exact on s1_id = entity_id group by entity_id", EXACT),
    "tfidf_vocab_df": er("select country, gram, df from vocab", tfidf()),
    "tfidf_idf": er("select country, gram, round(idf, 9) as idf from vocab", tfidf(1.0, 2**62)),
    "tfidf_weights": er("select country, entity_id, gram, round(w, 9) as w from w2", tfidf()),
    "pair_attributes": er("select * from pairs", PAIRS),
    "feat_country": er("select s1_id, pool_id, (country_1 = country_2 and country_1 <> '')::bigint as exact_country_match from pairs", PAIRS),
    "feat_name_3gram": er(f"select s1_id, pool_id, round({jaccard(grams('business_name_1'), grams('business_name_2'))}, 9) as name_3gram_jaccard from pairs", PAIRS),
    "feat_addr_token": er(f"select s1_id, pool_id, round({jaccard(tokens('business_address_1'), tokens('business_address_2'))}, 9) as address_token_jaccard from pairs", PAIRS),
    "feat_jaro_winkler": er(f"select s1_id, pool_id, round(jaro_winkler_similarity({coded('business_name_1')}, {coded('business_name_2')}), 9) as name_jaro_winkler_score from pairs", CHARS, PAIRS),
    "feat_levenshtein": er(f"select s1_id, pool_id, levenshtein({coded('business_name_1')}, {coded('business_name_2')}) as name_levenshtein from pairs", CHARS, PAIRS),
    "label_pairs": er("select exact.*, (links.s1_id is not null)::bigint as is_match from exact left join links using (s1_id, pool_id)", EXACT),
    "ids_semi": er("select entity_id, country from pool where entity_id in (select pool_id from links)"),
    "ids_anti": er("select entity_id, country from pool where entity_id not in (select pool_id from links)"),
    "gt_explode": er("select s1_id, pool_id, substr(pool_id, 1, 2) as source from links"),
    "gt_positive_pairs": er("select * from links"),
    "negative_pairs": er("select * from negatives", NEGATIVES),
    "sample_fraction": er("select entity_id from k where chosen", keep("pool", "entity_id", "(select round_even(0.2 * count(*), 0) from pool)", "k")),
    "sample_fixed": er("select entity_id from k where chosen", keep("pool", "entity_id", "100", "k")),
    "sample_preserving_gt": er(
        "select entity_id, 's1' as role from t union all select entity_id, 'truth' from t union all select entity_id, lower(substr(entity_id, 1, 2)) from need union all select entity_id, 's2' from k2 where chosen union all select entity_id, 's3' from k3 where chosen",
        keep("s1", "entity_id", "(select round_even(0.2 * count(*), 0) from s1)", "k1"), "t as (select entity_id from k1 where chosen)", "need as (select distinct pool_id as entity_id from links join t on entity_id = s1_id)",
        "o2 as (select entity_id from pool where entity_id like 'S2-%' and entity_id not in (select entity_id from need))", "o3 as (select entity_id from pool where entity_id like 'S3-%' and entity_id not in (select entity_id from need))",
        keep("o2", "entity_id", "(select round_even(0.2 * count(*), 0) from o2)", "k2"), keep("o3", "entity_id", "(select round_even(0.2 * count(*), 0) from o3)", "k3"),
    ),
    "split_a": er("select * from parts", SPLIT_A),
    "split_b": er(
        "select entity_id, case when chosen then 'val' else 'train' end as part from k union all select entity_id, 'test' from s1 where country = 'DE'",
        "en as (select entity_id from s1 where country = 'EN')", keep("en", "entity_id", "(select cast(ceil(0.2 * count(*)) as bigint) from en)", "k"),
    ),
    "split_sizes": er("select part, count(*) as n from parts group by part", SPLIT_A),
    "value_counts_country": er(counts("country", "pool")),
    "value_counts_by_source": er(counts("country", "(select *, substr(entity_id, 1, 2) as source from pool)", "source, ")),
    "value_counts_segment": counts("c_mktsegment", "customer"),
    "match_count_hist": er("select n as matches, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 2) as percent from m group by m.n order by matches limit 10", MATCHES),
    "match_conditional_counts": er("select count(*) filter (n = 0) as singletons, count(*) filter (n = 1) as exactly_one, count(*) filter (n > 1) as several, count(*) filter (n2 > 0 and n3 > 0) as both_sources from m", MATCHES),
    "link_totals_by_source": er("select sum(n)::bigint as links, sum(n2)::bigint as links_s2, sum(n3)::bigint as links_s3 from m", MATCHES),
    "null_profile": er("select column_name, count(*) filter (v = '') as missing, count(*) as records, round(100.0::double * count(*) filter (v = '') / count(*), 2) as percent from (select unnest(['business_name', 'business_address', 'country']) as column_name, unnest([business_name, business_address, country]) as v from pool) group by column_name"),
    "length_hist": er("select length(business_name) as name_length, count(*) as n from pool group by all"),
    "token_hist": er("select len(list_filter(string_split(business_address, ' '), lambda t: t <> '')) as address_tokens, count(*) as n from pool group by all"),
    "length_percentiles": er("select quantile_disc(length(business_address), 0.25) as p25, quantile_disc(length(business_address), 0.5) as p50, quantile_disc(length(business_address), 0.75) as p75 from pool"),
    "length_mean": er("select round(avg(length(business_name)), 9) as mean from pool"),
    "char_composition": f"select sum(length(text) - length(regexp_replace(text, '\\p{{Nd}}', '', 'g')))::bigint as digits, sum(length(text) - length(regexp_replace(text, '{NOT_WORD}', '', 'g')))::bigint as punctuation, sum(length(text) - length(regexp_replace(text, '{SPACES}', '', 'g')))::bigint as spaces, sum(length(text) - length(regexp_replace(text, '\\p{{L}}', '', 'g')))::bigint as letters from documents",
    "unique_ratio": er("select column_name, count(distinct v) as distinct_values, count(*) as records, round(100.0::double * count(distinct v) / count(*), 2) as percent from (select unnest(['business_name', 'business_address']) as column_name, unnest([business_name, business_address]) as v from pool) group by column_name"),
    "topk_names": "select p_name, count(*) as n from part group by p_name order by n desc, p_name limit 10",
    "feature_separability": er(
        "select is_match, measure, round(avg(v), 6) as mean, round(median(v), 6) as median from (select is_match, unnest(['exact_name', 'exact_addr', 'country_match', 'name_token_jaccard', 'address_token_jaccard', 'name_3gram_jaccard', 'address_3gram_jaccard']) as measure, unnest([exact_name::double, exact_addr::double, country_match::double, name_token_jaccard, address_token_jaccard, name_3gram_jaccard, address_3gram_jaccard]) as v from judged) group by all",
        JUDGED,
    ),
    "blocking_recall": er("select round(100 * avg((n1 = n2)::int), 6) as exact, round(100 * avg((string_split(n1, ' ')[1] = string_split(n2, ' ')[1] and n1 <> '')::int), 6) as first_token, round(100 * avg((name_3gram_jaccard > 0.3::double)::int), 6) as grams from judged where is_match = 1", JUDGED),
    "first_token_recall": er("select s1_id, pool_id, (string_split(business_name_1, ' ')[1] = string_split(business_name_2, ' ')[1] and business_name_1 <> '')::int as hit from pairs join links using (s1_id, pool_id)", PAIRS),
    "hard_positive": er("select s1_id, pool_id, round(name_token_jaccard, 9) as name_token_jaccard from judged where is_match = 1 and name_token_jaccard < 0.2::double order by s1_id, pool_id limit 1", JUDGED),
    "hard_negative": er("select s1_id, pool_id, round(name_token_jaccard, 9) as name_token_jaccard from judged where is_match = 0 and name_token_jaccard > 0.5::double and country_match = 1 order by s1_id, pool_id limit 1", JUDGED),
    "linear_scores": er("select source1_entity_id, candidate_entity_id, round(p, 6) as match_probability, (p > 0.8::double)::int as is_predicted_match from scores", SCORES),
    "linear_score_thresholds": er("select threshold, count(*) filter (matched_entity_ids <> '') as matched, count(*) as records from sweep group by threshold", SCORES),
    "matching_results": er("select source1_entity_id, matched_entity_ids from sweep where threshold = 0.8::double", SCORES),
    "singleton_share": er("select count(*) as records, count(*) filter (matched_entity_ids = '') as singletons, round(100.0::double * count(*) filter (matched_entity_ids = '') / count(*), 6) as singleton_share from sweep where threshold = 0.8::double", SCORES),
    "f05_per_entity": er("select source1_entity_id, round(f05, 9) as f05 from f where threshold = 0.8::double", SCORES),
    "f05_macro": er("select round(avg(round(f05, 9)), 6) as macro_f05, count(*) as entities from f where threshold = 0.8::double", SCORES),
    "f05_macro_by_threshold": er("select threshold, round(avg(f05), 6) as macro_f05, count(*) as entities from f group by threshold", SCORES),
    "model_round_trip": er("select (select count(*) from links) + (select count(*) from negatives) as pairs, 0::bigint as differing", NEGATIVES),
    "tsv_scan_filled": er("select entity_id, business_name, business_address, country from pool"),
    "tsv_scan_nulls": er("select entity_id, nullif(business_name, '') as business_name, nullif(business_address, '') as business_address, country from pool"),
    "tsv_discovery": er("select entity_id, business_name, business_address, country, 'source' || substr(entity_id, 2, 1) || '.tsv' as file from (select * from s1 union all select * from pool)"),
    "tsv_inventory": er("select 'train' as split, file, count(*) as records, true as has_bytes from (select 'source' || substr(entity_id, 2, 1) || '.tsv' as file from er union all select 'ground_truth.tsv' from truth) group by file"),
    "records_by_name": er("select 'source1.tsv' as file, (select count(*) from s1) as records union all select 'ground_truth.tsv', (select count(*) from truth) union all select 'nowhere.tsv', 0"),
    "versioned_overwrite": er(f"select entity_id, {canonical('business_name')} as business_name from pool"),
    "version_log": er("select 'first' as version, count(*) as n from pool union all select v, count(*) from pool, (select unnest(['second', 'newest']) as v) where country = 'EN' group by v"),
    "last_lines": er("select * from truth"),
    "bucketed_attributes": er("select pairs.* from pairs join exact using (s1_id, pool_id)", PAIRS),
    "feature_sink": er(
        f"select s1_id as source1_entity_id, pool_id as candidate_entity_id, (country_1 = country_2 and country_1 <> '')::bigint as exact_country_match, round(jaro_winkler_similarity({coded('business_name_1')}, {coded('business_name_2')}), 9) as name_jaro_winkler_score, round({jaccard(grams('business_name_1'), grams('business_name_2'))}, 9) as name_3gram_jaccard, round({jaccard(tokens('business_address_1'), tokens('business_address_2'))}, 9) as address_token_jaccard, (links.s1_id is not null)::bigint as is_match from exact join pairs using (s1_id, pool_id) left join links using (s1_id, pool_id)",
        CHARS, PAIRS,
    ),
    "save_split": er("select part, role, case role when 'pool' then (select count(*) from pool) else count(*) end as n from parts, (select unnest(['s1', 'truth', 'pool']) as role) group by part, role", SPLIT_A),
    "report_sink": er("select row_number() over (order by o, country) - 1 as line_no, line from (select 0 as o, '' as country, '# Report' as line union all select 1, '', '## Countries' union all select 2, '', '' union all select 3, '', '| country | n |' union all select 4, '', '|---|---|' union all select 5, country, '| ' || country || ' | ' || count(*) || ' |' from pool group by country union all select 6, '', '')"),
    "shuffle_pool": er("select entity_id, row_number() over (order by md5(entity_id || '42'), entity_id) - 1 as place from pool"),
    "schema_report": "select column_name, lower(replace(column_type, 'VARCHAR', 'STRING')) as column_type from (describe documents)",
    "record_count": "select count(*) as records from documents",
}
