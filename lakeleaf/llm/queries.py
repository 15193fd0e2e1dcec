"""The queries of the ten operators with their production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeleaf.llm.bpe import bpe_digests
from lakeleaf.llm.common import table
from lakeleaf.llm.divergence import divergence
from lakeleaf.llm.exact_dedup import exact_dedup_in_batches
from lakeleaf.llm.fim import fill_in_middle_digests
from lakeleaf.llm import langid, secrets, toxicity
from lakeleaf.llm.html_text import extract
from lakeleaf.llm.line_dedup import line_digests
from lakeleaf.llm.minhash import near_classes
from lakeleaf.llm.mixing import Mixture, mix, word_count
from lakeleaf.llm.topk import top_k
from lakeleaf.llm.url_filter import Rule, url_filter

RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def vocabulary() -> str:
    """Place of the public vocabulary, which is never copied here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.language_id(docs, langid.train(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_folds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: Half of all words; thin leaves are repeated up to twice.
MIXTURE = Mixture(
    budget=(1, 2), epochs=2, seed=17, other=1,
    weights={"domain": {"web": 4, "books": 3, "wiki": 2, "code": 1}, "language": {"en": 5, "de": 2, "fr": 2, "es": 1}},
)


def domain_of() -> Column:
    """The tables name no domain: sources src0 to src4 stand for the web, 5 to 9 books, 10 to 14 wiki, 15 to 19 code."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "^src([0-9]{1,4})$", 1)
    number = F.when(number != "", number.cast("int"))
    return F.when(number < 5, "web").when(number < 10, "books").when(number < 15, "wiki").when(number < 20, "code").otherwise("other")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), MIXTURE, domain_of(), word_count(F.col("text")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_in_batches(table(spark, sf_dir, "documents"), 2)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables name no owner: a source stands for one, and its documents of one language for a repository."""
    return secrets.secret_digests(table(spark, sf_dir, "documents"), F.col("source"), F.to_json(F.struct("source", "lang")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_minhash, op2_bpe, op3_language_id, op4_top_k, op5_exact_dedup, op6_mixing, op7_url_filter, op8_line_dedup, op9_html_text, op10_toxicity, op11_fill_in_middle, op12_secrets, op13_divergence)
}

def _level(parent: str, name: str, weight: str) -> str:
    """SQL of one level of the budget tree (tables above and leaves): parent columns, name, budget."""
    keys, by = (f"{parent}, {name}", f"partition by {parent}") if parent else (name, "")
    join = f"join above using ({parent})" if parent else "cross join above"
    return f"""
        (with n as (select {keys}, sum(cap) as cap0, any_value({weight}) as weight from leaves group by {keys}),
         c as (select n.*, above.budget, case when weight > 0 then cap0 else 0 end::hugeint as cap from n {join}),
         o as (select *, coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0) as before, sum(weight) over (w rows between current row and unbounded following) as upon,
                      least(budget, sum(cap) over ({by})) as total from c window w as ({by} order by cap / greatest(weight, 1), {name})),
         f as (select *, cap * upon <= (total - before) * weight as is_full from o),
         t as (select *, sum(case when is_full then cap else 0 end) over ({by}) as taken, sum(case when is_full then 0 else weight end) over ({by}) as rest_weight from f)
         select {keys}, case when is_full then cap else ((total - taken) * weight) // greatest(rest_weight, 1) end as budget from t)
    """


def mixing_sql(documents: str = "documents") -> str:
    number = "try_cast(nullif(regexp_extract(coalesce(source, ''), '^src([0-9]{1,4})$', 1), '') as int)"
    weights = {level: "case " + level + " " + " ".join(f"when '{k}' then {v}" for k, v in MIXTURE.weights.get(level, {"": 1}).items()) + f" else {MIXTURE.other} end" for level in ("domain", "language", "source")}
    return f"""
        with d as (select doc_id, case when {number} < 5 then 'web' when {number} < 10 then 'books' when {number} < 15 then 'wiki' when {number} < 20 then 'code' else 'other' end as domain,
                          coalesce(lang, '') as language, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens from {documents}),
        leaves as (select domain, language, source, sum(n_tokens)::hugeint as tokens, sum(n_tokens)::hugeint * {MIXTURE.epochs} as cap from d group by all),
        b1 as (with above as (select (sum(tokens) * {MIXTURE.budget[0]}) // {MIXTURE.budget[1]} as budget from leaves) select * from {_level("", "domain", weights["domain"])}),
        b2 as (with above as (select * from b1) select * from {_level("domain", "language", weights["language"])}),
        b3 as (with above as (select * from b2) select * from {_level("domain, language", "source", weights["source"])}),
        l as (select leaves.*, budget, case when tokens > 0 then budget // tokens else 0 end as whole from leaves join b3 using (domain, language, source)),
        p as (select d.*, whole, budget - whole * tokens as rest, sum(n_tokens) over (partition by domain, language, source
                     order by md5('{MIXTURE.seed}:' || (whole + 1)::varchar || ':' || coalesce(doc_id::varchar, '')), doc_id) as running from d join l using (domain, language, source))
        select doc_id, domain, language, source, n_tokens, (whole + case when rest > 0 and running <= rest then 1 else 0 end)::int as copies from p
    """


def secrets_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = " union all ".join(
        f"select row_id, owner, {k} as kind, regexp_extract_all(text, {quoted(kind.pattern)}) as hits, regexp_extract_all(text, {quoted(kind.pattern)}, {kind.group}) as vals, "
        f"string_split_regex(text, {quoted(kind.pattern)}) as pieces, {kind.least} as least from d"
        for k, kind in enumerate(secrets.KINDS)
    )
    name = "case kind " + " ".join(f"when {k} then '{kind.name}'" for k, kind in enumerate(secrets.KINDS)) + " end"
    signs = "len(list_distinct(string_split(value, '')))"
    own = secrets.Settings()
    return f"""
        with d as (select row_number() over () as row_id, doc_id, coalesce(source, '') as owner, coalesce(text, '') as text from documents),
        h as (select * from ({found}) where len(hits) > 0),
        e as (select *, unnest(generate_series(1, len(hits))) as i from h),
        s as (select row_id, owner, kind, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::bigint as a, length(hits[i]) as long, vals[i] as value
              from e where length(vals[i]) >= least),
        k as (select *, a + long as z from s where kind < 3 or regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[a-z]') and {signs} >= {secrets.LEAST_SIGNS}),
        f as (select * from k where kind < 3 or not exists (select 1 from k b where b.row_id = k.row_id and b.kind < 3 and b.a < k.z and b.z > k.a)),
        o as (select value, count(distinct owner) as owners, bool_or(regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and {signs} >= {own.random}) as random from f group by value),
        v as (select f.*, case when owners >= {own.copied} then 'example' when owners = 1 and random then 'live' else 'unsure' end as verdict, {name} || ':' || a || ':' || z as span from f join o using (value)),
        g as (select row_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, string_agg(span, ',' order by a, kind, z) filter (kind < 3) as base,
                     string_agg(span, ',' order by a, kind, z) as spans, count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'example') as n_example from v where kind < 3 or verdict = 'live' group by row_id)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live,
               coalesce(n_example, 0) as n_example from d left join g using (row_id)
    """


SQL = {
    "op6_mixing": mixing_sql(),
    "op4_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
                   where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
        r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5
    """,
    "op5_exact_dedup": """
        with d as (select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256 from documents),
        r as (select *, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size, row_number() over w as place
              from d window w as (partition by text_sha256 order by points desc, doc_id nulls last))
        select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from r
    """,
    "op7_url_filter": """
        with rules(rule_host, rule_path, rule_verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        r as (select row_number() over () as row_id, page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
        u as (select row_id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
        m as (select u.row_id, arg_max({'rule': rule_host || rule_path, 'verdict': rule_verdict}, length(rule_host || rule_path)) as best
              from u join rules on (u.host = rule_host or ends_with(u.host, '.' || rule_host)) and starts_with(u.path, rule_path) group by u.row_id)
        select page_id, coalesce(host, '') as host, coalesce(path, '') as path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from u left join m using (row_id)
    """,
    "op11_fill_in_middle": """
        with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as units, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
        n as (select *, len(units)::bigint as n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) as h4 from d),
        c as (select *, least(h4[1] % (n + 1), h4[2] % (n + 1)) as a, greatest(h4[1] % (n + 1), h4[2] % (n + 1)) as b,
                     case when text = '' or regexp_matches(text, '<[PSM]>') or h4[3] % 100 >= 100 then 'plain' when h4[4] % 100 < 50 then 'spm' else 'psm' end as form from n),
        p as (select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:n], '') as suffix from c)
        select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
               sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
               sha256(text) as restored_sha256 from p
    """,
    "op12_secrets": secrets_sql(),
    "op13_divergence": """
        with d as (select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
        t as (select row_id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
        k as (select lang, term, count(*)::hugeint as lang_n from t group by all having count(distinct row_id) >= 3),
        v as (select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as total from k group by all),
        g as (select distinct lang, source from d),
        c as (select lang, source, term, count(*)::hugeint as n from t group by all),
        s as (select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n, k.lang_n, v.v, v.total, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source)::hugeint as whole
              from g join k using (lang) join v using (lang) left join c using (lang, source, term)),
        p as (select lang, source, term, n, (1 + (1000000000 * (n + 1)) // (whole + v)) as p, (1 + (1000000000 * (lang_n + 1)) // (total + v)) as q from s),
        f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b using (lang, term) where a.source <> b.source group by all),
        r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
                     left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
              union all select lang, source, 'term', term, (((p - q) * (p - q)) // q)::bigint from p where n > 0 and p > q),
        o as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r)
        select * from o where part = 'pair' or rank <= 200
    """,
}
