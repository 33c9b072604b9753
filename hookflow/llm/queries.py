"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookflow.llm import collocations, compression_bands, fill_in_middle, impact_topk, language_ppm, line_alignment, mixing, packing, pii, repeats, url_rules, warc
from hookflow.llm.common import table
from hookflow.llm.ngram_jaccard import jaccard_components


def op1_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = impact_topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return impact_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge(pages, url_rules.page_links(pages), url_rules.rule_table(spark))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_alignment.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("__kept").alias("text"), F.col("__total").alias("n_lines"), F.col("__removed").alias("n_removed"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ppm.identify(table(spark, sf_dir, "documents"))


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.quality(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored("output", "form")
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES = {
    "op1_impact_topk": op1_impact_topk,
    "op2_url_rules": op2_url_rules,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_line_alignment": op4_line_alignment,
    "op5_mixing": op5_mixing,
    "op6_warc_dictionary": op6_warc_dictionary,
    "op7_language_ppm": op7_language_ppm,
    "op8_compression_bands": op8_compression_bands,
    "op9_repeats": op9_repeats,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_pii": op12_pii,
    "op13_fill_in_middle": op13_fill_in_middle,
}

# Checks for DuckDB, where SQL can express the query over whole tables in reasonable time.
CHECKS = {
    "op1_impact_topk": """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.r, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.r <> c.r where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by r order by score desc, vec_id) as integer) as rank, vec_id, score from s
qualify rank <= 5""",
    "op2_url_rules": r"""
with recursive rules as (
  select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(action, h, p)
), raw as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages
), links as (
  select url as src, coalesce(nullif(trim(regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is')), ''),
    nullif(trim(regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?([^"''>]*)', 1, 'is')), '')) as dst from raw
), ends as (
  select page_id, url, null as src from raw union all select null, dst, src from links where contains(dst, '://')
), places as (
  select page_id, src, url, case when contains(url, '://') then substring(url, instr(url, '://') + 3) else '' end as rest from ends
), named as (
  select page_id, src, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) as query, url from places
), decided as (
  select page_id, src, url, n.host, n.path, n.host || n.path || n.query as place, max({'n': length(h || p), 'allow': action = 'allow', 'rule': h || p, 'action': action}) as best
  from named n left join rules r on (n.host = h or ends_with(n.host, '.' || h)) and starts_with(n.path, p) group by all
), edges as (
  select s.place as a, d.place as b from decided d join decided s on d.src = s.url and s.page_id is not null where s.host <> '' and d.host <> ''
), reach(a, b) as (
  select a, b from edges union select b, a from edges union select r.a, e.b from reach r join (select a, b from edges union select b, a from edges) e on r.b = e.a
), spread as (
  select distinct r.a as place from reach r join decided d on d.place = r.b where d.best.action = 'block'
)
select d.page_id, d.host, d.path, d.best.rule as rule, coalesce(d.best.action, case when s.place is not null then 'block' end, 'allow') as verdict
from raw p join (select distinct page_id, url, host, path, place, best from decided where src is null) d on p.page_id is not distinct from d.page_id and p.url = d.url left join spread s on d.place = s.place and d.host <> ''""",
    "op6_warc_dictionary": """
with p as (
  select page_id, encode(coalesce(html, '')) as body, sha1(coalesce(html, '')) as digest from pages
), g as (select digest, max(page_id) as best from p group by digest)
select p.page_id, cast(octet_length(body) as bigint) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(p.digest, cast(i // 8 * 10 + 1 as bigint), 10) as bigint) >> (35 - 5 * (i % 8))) & 31 as bigint) + 1, 1)), 'string_agg', '') as payload_digest,
  case when best is null or p.page_id = best then 'response' else 'revisit' end as record_type,
  case when best is null or p.page_id = best then null else best end as refers_to
from p join g on p.digest = g.digest""",
    "op11_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from words, range(1, 6) sizes(k)
), f as (
  select lang, k, phrase, cast(count(*) as hugeint) as f, split(phrase, ' ') as w from grams group by lang, k, phrase having count(*) >= 100 or k = 1
), totals as (
  select lang, sum(f) as n from f where k = 1 group by lang
), cuts as (
  select lang, phrase, w, k, f as a, unnest(range(1, k)) as j from f where k > 1
), scores as (
  select c.lang, c.phrase, c.w, c.k, c.a, l.f as l, r.f as r, n, cast(1000 as hugeint) * c.a * n // (l.f * r.f) as score
  from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:j], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[j + 1:c.k], ' ') join totals t on t.lang = c.lang
  qualify row_number() over (partition by c.lang, c.phrase order by score, j) = 1
), inner_sizes as (
  select lang, a, k, w, unnest(range(2, k)) as size from scores where k > 2
), inside as (
  select lang, array_to_string(w[i:i + size - 1], ' ') as phrase, max(a) as longer from (select *, unnest(range(1, k - size + 2)) as i from inner_sizes) group by all
)
select s.lang, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank, s.phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n,
  cast(score as bigint) as score from scores s left join inside i on i.lang = s.lang and i.phrase = s.phrase where coalesce(100 * longer < 100 * a, true) qualify rank <= 2000""",
    "op12_pii": r"""
with rules(p, kind, ord, pattern, near, proposal, checked, context) as (values
  ('email', 'email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'mail|contact|write|kontakt|correo|courriel', 60, 20, 20),
  ('ip', 'ip', 2, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', 'ip|host|server|address|adresse', 50, 30, 20),
  ('card', 'card', 3, '[0-9](?:[\x20-]?[0-9])+', 'card|visa|credit|amex|karte|carte|tarjeta', 30, 30, 30),
  ('phone', 'phone', 4, '\+[0-9][\x20().0-9-]+[0-9]', 'phone|tel|call|fax|mobil|handy|móvil|appel', 50, 30, 20),
  ('local', 'phone', 4, '[0-9(][\x20().0-9-]{5,22}[0-9]', 'phone|tel|call|fax|mobil|handy|móvil|appel', 30, 20, 30),
  ('iban', 'iban', 5, '[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)', 'iban|account|konto|compte|cuenta', 40, 40, 20),
  ('ssn', 'ssn', 6, '[0-9]{3}-[0-9]{2}-[0-9]{4}', 'ssn|social security', 30, 30, 30)
), docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), found as (
  select r, rules.*, regexp_extract_all(t, pattern) as m, string_split_regex(t, pattern) as g from docs, rules where regexp_matches(t, pattern)
), each as (
  select * exclude (m, g, pattern), unnest(m) as value, unnest(g[:-2]) as gap, unnest(list_transform(list_zip(g[2:], list_concat(m[2:], [''])), lambda z: (z[1] || z[2])[1])) as following,
    unnest(range(len(m))) as i from found
), placed as (
  select *, sum(length(gap) + length(value)) over (partition by r, p order by i rows unbounded preceding) as e,
    case when gap = '' and i > 0 then '0' else right(gap, 1) end as before, regexp_replace(value, '[^0-9]', '', 'g') as digits, replace(value, ' ', '') as bare from each
), checks as (
  select *, case p
    when 'email' then regexp_matches(value, '\.[A-Za-z]{2,}$')
    when 'ip' then len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(nullif(ltrim(x, '0'), '') as bigint), 0) > 255)) = 0
    when 'card' then length(digits) between 13 and 19 and list_sum(list_transform(range(length(digits)), lambda k:
      case when k % 2 = 0 then cast(digits[length(digits) - k] as bigint) else (2 * cast(digits[length(digits) - k] as bigint)) // 10 + (2 * cast(digits[length(digits) - k] as bigint)) % 10 end)) % 10 = 0
    when 'phone' then length(digits) between 8 and 15
    when 'local' then length(digits) between 7 and 12 and not regexp_matches(value, '^[0-9]+(?:\.[0-9]+){3}$')
    when 'iban' then length(bare) between 15 and 34 and list_reduce(list_concat([0::bigint], list_transform(string_split(bare[5:] || bare[:4], ''), lambda c: cast(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1 as bigint))),
      lambda a, v: (a * (case when v > 9 then 100 else 10 end) + v) % 97) = 1
    else not regexp_matches(value, '^(?:000|666|9)|-00-|0000$') end as valid from placed
), judged as (
  select *, p = 'email' or (p in ('ip', 'phone') and valid) or (p = 'card' and valid and length(digits) >= 16) as base,
    not regexp_matches(before, '[0-9A-Za-z+@._%-]') and not regexp_matches(following, '[0-9A-Za-z@]') as alone,
    regexp_matches(translate(right(gap, 40), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), near) as close from checks
), kept as (
  select *, kind || ':' || cast(e - length(value) as bigint) || ':' || cast(e as bigint) as name, cast(e - length(value) as bigint) as s from judged
  where base or (valid and alone and proposal + checked + (case when close then context else 0 end) >= 80)
), joined as (
  select r, count(*) filter (base and p = 'email') as n_email, count(*) filter (base and p = 'ip') as n_ip, count(*) filter (base and p = 'card') as n_card,
    count(*) filter (base and p = 'phone') as n_phone, string_agg(name, ',' order by ord, s) filter (base) as b, string_agg(name, ',' order by ord, s, e) as spans from kept group by r
)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from docs left join joined using (r)""",
    "op13_fill_in_middle": """
with drawn as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), numbers as (
  select *, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2, cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from drawn
), cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from numbers
), parts as (
  select *, substring(t, 1, a) as prefix, substring(t, a + 1, b - a) as middle, substring(t, b + 1) as suffix from cut
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256 from parts""",
}
