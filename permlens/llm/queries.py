"""The registered queries of this folder and the SQL each can be compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from permlens.llm import bpe, decontaminate, filter_audit, fingerprint, html_text, language, ngram_join, source_divergence, source_mix, substring, token_files, url_filter, warc
from permlens.llm.common import documents, table

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = f"""
with parts as (
  select page_id, coalesce(translate(regexp_extract(url, '^(.*?)://([^/?#]*)', 2, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path, row_number() over () as n
  from pages
),
rules(verdict, rule_host, rule_path) as (values {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}),
fits as (
  select n, verdict, rule_host || rule_path as rule, row_number() over (partition by n order by length(rule_host || rule_path) desc) as place
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join fits on parts.n = fits.n and place = 1
"""


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
parts as (select doc_id, unnest(case when len(words) >= 3 then list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))
                                     when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingle from w),
sets as (select distinct doc_id, shingle from parts),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
sized as (select * from sets join sizes using (doc_id)),
shared as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as m, any_value(b.n) as n, count(*) as common
           from sized a join sized b on a.shingle = b.shingle and a.doc_id < b.doc_id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n group by a.doc_id, b.doc_id),
links as (select x, y from shared where 100 * common >= 90 * (m + n - common)),
either as (select x, y from links union all select y, x from links),
reach(doc_id, seen) as (select doc_id, doc_id from documents union select r.doc_id, e.y from reach r join either e on r.seen = e.x)
select r.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(seen) as component_id from reach r left join sizes using (doc_id) group by r.doc_id
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, strlen(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d group by 1)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id > first then first end as refers_to
from d join f using (payload_digest)
"""


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(documents(spark, sf_dir))


OP3_SQL = r"""
with w as (select doc_id, row_number() over () as n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
starts as (select n, doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) as pos from w),
windows as (select n, doc_id, pos, sha256(array_to_string(words[pos:pos + 49], ' ')) as h from starts),
lowest as (select h, min(doc_id) as low from windows group by h),
gone as (select n, list(distinct p) as places from (select n, unnest(range(pos, pos + 50)) as p from windows join lowest using (h) where doc_id > low) group by n),
kept as (select doc_id, words, [x for x, i in words if not list_contains(coalesce(places, []), i)] as stay from w left join gone using (n))
select doc_id, len(words)::bigint as n_words, (len(words) - len(stay))::bigint as n_removed, sha256(array_to_string(stay, ' ')) as kept_sha256 from kept
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(documents(spark, sf_dir), tokenizer_path(), end_id=2))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path())


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(~language.held_out()))
    judged = language.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with w as (select coalesce(doc_id, 9223372036854775807) as id, doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
marks as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels where doc_id is not null group by doc_id),
f as (select part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
                    regexp_matches(t, '[#$%&*|]'), id > min(id) over (partition by t)] as fails,
             coalesce(good, false) as good, coalesce(toxic, false) as toxic
      from w left join marks using (doc_id)),
n as (select part, fails, count(*) as total, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by part, fails),
letters(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e
           where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps as (select filter_order, unnest(range(1, 6)) as step from orders),
own as (select filter_order, step, [ascii(x) - 64 for x in string_split(filter_order[:step - 1], '') if x <> ''] as earlier, ascii(filter_order[step]) - 64 as filter from steps),
judged as (select part, filter_order, step, filter, total, good, toxic, fails[filter] as failing, len([e for e in earlier if fails[e]]) > 0 as gone, len([x for x in fails if x]) as all_fails from n, own),
counted as (select part, filter_order, step, any_value(filter) as filter, sum(total) filter (not gone and not failing) as kept, sum(total) filter (not gone and failing) as removed,
                   sum(total) filter (gone and failing) as redundant, sum(total) filter (failing and all_fails = 1) as unique_fails,
                   sum(good) filter (not gone and failing) as good_lost, sum(toxic) filter (not gone and failing) as toxic_lost from judged group by all)
select part, filter_order, step::integer as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
       coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       coalesce(sum(removed) over (partition by part, filter), 0)::bigint as shapley
from counted
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergences(documents(spark, sf_dir))


OP12_SQL = r"""
with d as (select row_number() over () as n, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
t as (select n, lang, source, unnest(terms) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct n) >= 30),
v as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from d),
counts as (select lang, source, term, count(*) as c from t semi join kept using (lang, term) group by all),
cells as (select lang, source, term, coalesce(c, 0) as c from groups join kept using (lang) left join counts using (lang, source, term)),
p as (select lang, source, term, c, 1 + (1000000000::hugeint * (c + 5)) // (sum(c) over (partition by lang, source) + 5 * v) as p from cells join v using (lang)),
whole as (select lang, term, sum(c) as c from cells group by lang, term),
q as (select lang, term, 1 + (1000000000::hugeint * (c + 5)) // (sum(c) over (partition by lang) + 5 * v) as q from whole join v using (lang)),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b using (lang, term) group by all),
united as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
         from groups a join groups b using (lang) left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source where a.source <> b.source
         union all select lang, source, 'term', term, (p - q)::bigint from p join q using (lang, term) where c > 0 and p > q)
select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from united) where part = 'pair' or rank <= 50
"""


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken(source_mix.mixed(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = rf"""
with sized as (select doc_id, coalesce(doc_id, 9223372036854775807) as id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                      ('0x' || md5('mix:' || coalesce(doc_id, 9223372036854775807) || ':' || coalesce(text, ''))[:8])::bigint as draw from documents),
named as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as number from sized group by source),
weighed as (select *, [5, 2, 1][(number - 1) % 3 + 1] as weight, 3 * source_size as cap from named),
ladder as (select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0))::double / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
           from weighed window before as (order by cap / weight, number rows between unbounded preceding and 1 preceding)),
filled as (select *, cap <= weight * level as is_full from ladder),
final as (select *, (sum(source_size) over () - coalesce(sum(cap) filter (is_full) over (), 0))::bigint as wanted, (sum(weight) filter (not is_full) over ())::bigint as free from filled),
targets as (select *, case when is_full then cap::double else weight * (wanted::double / free) end as target, (select greatest(1, ceil(sum(size) / 2097152.0))::bigint from sized) as shards from final),
docs as (select s.*, number, source_size, target, is_full, wanted, draw % shards as shard from sized s join targets t on s.source is not distinct from t.source),
cells as (select number, shard, any_value(source_size) as source_size, any_value(target) as target, any_value(is_full) as is_full, any_value(wanted) as wanted, sum(size)::bigint as words,
                 ((sum(size) + 15) // 16)::bigint as blocks from docs group by number, shard having sum(size) > 0),
parties as (select number, any_value(target) as target, any_value(wanted) as wanted, 3 * sum(blocks) as most from cells where not is_full group by number),
ranked as (select number, wanted, row_number() over (order by target / (2 * k + 1) desc, number) as place from (select *, unnest(range(0, most::bigint)) as k from parties)),
seats as (select number, count(*) as seats from ranked where place <= round_even(wanted / 16.0, 0) group by number),
cell_ranked as (select number, shard, seats, row_number() over (partition by number order by words / (2 * k + 1) desc, shard) as place
                from (select *, unnest(range(0, 3 * blocks)) as k from cells where not is_full) join seats using (number)),
quotas as (select number, shard, count(*) as quota from cell_ranked where place <= seats group by number, shard),
granted as (select number, shard, blocks, case when is_full then 3 * blocks else coalesce(quota, 0) end as quota, ('0x' || md5('mix:' || number || '/' || shard)[:8])::bigint as luck,
                   [p for p in {list(source_mix.STRIDES)} if blocks % p <> 0] as strides from cells left join quotas using (number, shard)),
walks as (select number, shard, blocks, quota // blocks as passes, quota % blocks as spare, luck % blocks as first, strides[luck % len(strides) + 1] as stride from granted),
placed as (select *, sum(size) over (partition by number, shard order by draw, id, size rows unbounded preceding)::bigint as stop from docs),
spans as (select d.doc_id, d.size, d.source_size, d.target, coalesce(passes, 0) as passes, stop, stop - size as start, blocks, spare, first, stride from placed d left join walks using (number, shard))
select doc_id, size, source_size, target,
       (passes * size + case when size > 0 then coalesce(list_sum([least((b + 1) * 16, stop) - greatest(b * 16, start) for b in range(start // 16, (stop - 1) // 16 + 1) if (b * stride + first) % blocks < spare]), 0) else 0 end)::bigint as taken
from spans
"""


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_warc": op2_warc,
    "op3_substring": op3_substring,
    "op5_token_files": op5_token_files,
    "op6_html_text": op6_html_text,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op4_url_filter": op4_url_filter,
    "op8_decontaminate": op8_decontaminate,
    "op9_fingerprints": op9_fingerprints,
    "op10_language": op10_language,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_divergence": op12_source_divergence,
    "op13_source_mix": op13_source_mix,
}

SQL = {
    "op1_ngram_join": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op3_substring": OP3_SQL,
    "op4_url_filter": OP4_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_source_mix": OP13_SQL,
}
