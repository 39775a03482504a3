"""Shared SQL definitions (DuckDB dialect) that the compared queries are written over."""

from __future__ import annotations

import re

from permlens.functions.text import STOPWORDS
from permlens.sources.tables import AS_OF, PRINCIPALS, QUERY_PRINCIPALS

MARK = "chr(64976)"


def h(salt: str, key: str) -> str:
    return f"(('0x' || substr(md5('{salt}:' || {key}), 1, 8))::BIGINT)"


def one_of(salt: str, key: str, *values: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[({h(salt, key)} % {len(values)} + 1)::INT]"


def words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\S+'))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '\\A\\s+|\\s+\\z', '', 'g')"


def strip_end(text: str) -> str:
    return f"regexp_replace({text}, '\\s+\\z', '')"


def strip_start(text: str) -> str:
    return f"regexp_replace({text}, '\\A\\s+', '')"


def normalize(text: str) -> str:
    unified = f"regexp_replace({text}, '\\r\\n|\\r', chr(10), 'g')"
    return f"({strip(f"regexp_replace({unified}, '\\A' || chr(65279), '')")} || chr(10))"


def stem(w: str) -> str:
    return f"""(case when regexp_matches({w}, 'ies$') and not regexp_matches({w}, '[ea]ies$') then left({w}, len({w}) - 3) || 'y'
        when regexp_matches({w}, 'es$') and not regexp_matches({w}, '[aeo]es$') then left({w}, len({w}) - 1)
        when regexp_matches({w}, 's$') and not regexp_matches({w}, '[us]s$') then left({w}, len({w}) - 1) else {w} end)"""


STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def plain_words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def terms(text: str) -> str:
    return f"list_transform(list_filter({plain_words(text)}, lambda w: not list_contains({STOP_LIST}, w)), lambda w: {stem('w')})"


def sentence_parts(text: str) -> str:
    ended = f"regexp_replace({text}, '([.!?][\"'')\\]]{{0,2}}\\s+)', '\\1' || {MARK}, 'g')"
    marked = f"regexp_replace({ended}, '(\\n)([ \\t]*(?:[-*+]|\\d+[.)])[ \\t])', '\\1' || {MARK} || '\\2', 'g')"
    return f"list_filter(string_split({marked}, {MARK}), lambda s: s <> '')"


def rank(name: str) -> str:
    return f"(case {name} when 'internal' then 1 when 'confidential' then 2 when 'restricted' then 3 else 0 end)"


def authorized(p: str, d: str) -> str:
    return f"""({p}.tenant_id = {d}.tenant_id and {d}.classification_rank <= {p}.clearance_rank
        and (len({d}.allowed_departments) = 0 or list_contains({d}.allowed_departments, {p}.department))
        and (len({d}.required_projects) = 0 or list_has_any({d}.required_projects, {p}.projects)))"""


def in_scope(as_of: str, region: str, d: str) -> str:
    return f"""({as_of} is null or (({d}.valid_from is null or {d}.valid_from <= {as_of}) and ({d}.valid_to is null or {as_of} < {d}.valid_to)
        and (len({d}.applies_to_regions) = 0 or {region} is null or list_contains({d}.applies_to_regions, {region}))))"""


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def _text(value: str | None) -> str:
    return "null" if value is None else f"'{value}'"


def principal_rows(with_admins: bool) -> str:
    rows = ", ".join(
        f"('{s}', '{t}', {_text(d)}, {_list(p)}, {_text(c)}, {_text(r)}, '{role}')"
        for s, t, d, p, c, r, role in PRINCIPALS
        if with_admins or role == "query"
    )
    return f"""select subject, tenant_id, department::VARCHAR as department, projects, clearance::VARCHAR as clearance,
        region::VARCHAR as region, role, {rank('clearance')} as clearance_rank
        from (values {rows}) t(subject, tenant_id, department, projects, clearance, region, role)"""


LIST_BLOCK = """case when (i - 1) % 8 = 0 then repeat('#', ((i - 1) // 8 % 3 + 1)::INT) || ' Part ' || (i - 1) || chr(10) || chr(10) || line
    when (i - 1) % 8 = 3 then chr(10) || line
    when (i - 1) % 8 = 5 then '```' || chr(10) || '# kept verbatim' || chr(10) || line || chr(10) || '```'
    when (i - 1) % 8 = 6 then '- ' || line else line end"""

HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"


def _live(n: int) -> str:
    shallower = ", ".join([f"coalesce(h{m}.line_no, -1)" for m in range(1, n)] + ["-1", "-1"])
    return f"case when h{n}.line_no > greatest({shallower}) then h{n}.heading end"


def dedupe(table: str, rank_column: str, k: int) -> str:
    """Greedy removal of overlapping chunks in rank order, as a list fold."""
    row = "{'key': key, 'version_no': version_no, 'ordinal': ordinal, 'char_start': char_start, 'char_end': char_end, 'score': score}"
    return f"""
        select request_id, rank, x.key as key, x.version_no as version_no, x.ordinal as ordinal, x.char_start as char_start, x.char_end as char_end, x.score as score from (
            select request_id, unnest(kept) as x, generate_subscripts(kept, 1) as rank from (
                select request_id, list_reduce(list([{row}] order by {rank_column}), lambda acc, x: case when len(acc) >= {k} or len(list_filter(acc,
                    lambda y: y.key = x[1].key and y.version_no = x[1].version_no and y.char_start < x[1].char_end and x[1].char_start < y.char_end)) > 0
                    then acc else list_concat(acc, x) end) as kept
                from {table} group by request_id))"""


DEFINITIONS: dict[str, str] = {
    "principal": principal_rows(False),
    "principal_all": principal_rows(True),
    "manifest": f"""
        select doc_id, tenant_id, key, 'Title ' || key as title,
            case when format = 'markdown' then array_to_string(list_transform(string_split(text, chr(10)), lambda line, i: {LIST_BLOCK}), chr(10))
                else text end as content, format,
            case when c < 15 then null when c < 75 then 'internal' when c < 90 then 'confidential' else 'restricted' end as classification,
            case when {h('dept?', 'key')} % 100 < 15 then [{one_of('dept', 'key', 'engineering', 'support', 'sales')}] end as allowed_departments,
            case when tenant_id <> 'northstar' then null when p < 2 then ['atlas'] when p < 4 then ['borealis'] end as required_projects,
            case when r < 5 then ['EU'] when r < 10 then ['US'] end as applies_to_regions,
            case when v < 3 then timestamp '2025-01-01' when v < 5 then timestamp '2099-01-01' end as valid_from,
            case when v < 3 then timestamp '2026-01-01' end as valid_to,
            case when s < 2 then 'disabled' when s = 2 then 'deleted' else 'active' end as status,
            {h('ver', 'key')} % 20 = 0 as has_history, text
        from (select doc_id, text, 'doc-' || lpad(doc_id::VARCHAR, 7, '0') as key,
                case when {h('tenant', "'doc-' || lpad(doc_id::VARCHAR, 7, '0')")} % 100 < 10 then 'external' else 'northstar' end as tenant_id
            from documents) d,
            lateral (select case when {h('fmt', 'd.key')} % 2 = 0 then 'markdown' else 'text' end as format, {h('class', 'd.key')} % 100 as c,
                {h('proj', 'd.key')} % 100 as p, {h('region', 'd.key')} % 100 as r, {h('valid', 'd.key')} % 100 as v, {h('status', 'd.key')} % 100 as s) x""",
    "version": f"""
        select tenant_id, key, version_no, title, content, format, classification, {rank('classification')} as classification_rank,
            allowed_departments, required_projects, applies_to_regions, valid_from, valid_to, status
        from (
            select tenant_id, key, case when has_history then 2 else 1 end as version_no, title, content, format,
                coalesce(classification, 'public') as classification, coalesce(allowed_departments, []::VARCHAR[]) as allowed_departments,
                coalesce(required_projects, []::VARCHAR[]) as required_projects, coalesce(applies_to_regions, []::VARCHAR[]) as applies_to_regions,
                valid_from, valid_to, status from manifest
            union all
            select tenant_id, key, 1, title, content || chr(10) || chr(10) || 'Draft. Not reviewed.', format, 'internal', []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], null, null, status
            from manifest where has_history)""",
    "active_version": "select * from version where status = 'active' qualify row_number() over (partition by tenant_id, key order by version_no desc) = 1",
    "current_version": "select * from version qualify row_number() over (partition by tenant_id, key order by version_no desc) = 1",
    # chunking of current versions
    "doc_text": f"select tenant_id, key, version_no, format, {normalize('content')} as text from current_version",
    "line_row": f"""
        select *, sum(is_fence::INT) over (partition by key order by line_no) % 2 = 1 as in_fence,
            coalesce(sum(len(line) + 1) over (partition by key order by line_no rows between unbounded preceding and 1 preceding), 0)::BIGINT as char_start
        from (select *, format = 'markdown' and starts_with({strip('line')}, '```') as is_fence
            from (select tenant_id, key, version_no, format, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as line_no
                from (select *, string_split(text, chr(10)) as lines from doc_text)))""",
    "leveled": f"""
        select *, case when format = 'markdown' and not in_fence and not is_fence and regexp_matches(line, '{HEADING}')
                then len(regexp_extract(line, '{HEADING}', 1)) end as level, regexp_extract(line, '{HEADING}', 2) as heading
        from line_row""",
    "headed": "select *, count(level) over w as section_no, "
    + ", ".join(
        f"last_value(case when level = {n} then {{'line_no': line_no, 'heading': heading}} end ignore nulls) over w as h{n}" for n in range(1, 7)
    )
    + " from leveled window w as (partition by key order by line_no)",
    "headed_line": f"""
        select *, concat_ws(' > ', {", ".join(_live(n) for n in range(1, 7))}) as section_path,
            level is not null or ({strip('line')} = '' and not in_fence) as is_break from headed""",
    "paragraph": f"""
        select *, char_start + len(text) as char_end from (
            select tenant_id, key, version_no, island, min(section_no) as section_no, min(section_path) as section_path,
                min(char_start)::BIGINT as char_start, bool_or(is_fence) as atomic,
                {strip_end("string_agg(line, chr(10) order by line_no)")} as text
            from (select *, sum(is_break::INT) over (partition by key order by line_no) as island from headed_line)
            where not is_break group by all) where text <> ''""",
    "part": f"""
        select tenant_id, key, version_no, section_no, section_path,
            (char_start + coalesce(sum(len(part)) over (partition by key, island order by part_no rows between unbounded preceding and 1 preceding), 0))::BIGINT as char_start,
            {strip_end('part')} as part
        from (select *, unnest(parts) as part, generate_subscripts(parts, 1) as part_no
            from (select * exclude (text), case when atomic or {words('text')} <= 180 then [text] else {sentence_parts('text')} end as parts from paragraph))""",
    "cutting": f"""
        select key, section_no, section_path, char_start, part as rest, null::VARCHAR as piece, null::BIGINT as begins from part where len(part) > 2000
        union all
        select key, section_no, section_path,
            case when len(rest) > 2000 then char_start + cut + len(substr(rest, cut + 1)) - len({strip_start('substr(rest, cut + 1)')}) else char_start end,
            case when len(rest) > 2000 then {strip_start('substr(rest, cut + 1)')} else '' end,
            case when len(rest) > 2000 then {strip_end('left(rest, cut)')} else rest end, char_start
        from (select *, case when len(regexp_extract(left(rest, 2000), '(?s)^(.+\\n)', 1)) > 0 then len(regexp_extract(left(rest, 2000), '(?s)^(.+\\n)', 1))
                when len(regexp_extract(left(rest, 2000), '(?s)^(.+)\\s', 1)) > 0 then len(regexp_extract(left(rest, 2000), '(?s)^(.+)\\s', 1))
                else 2000 end as cut from cutting where rest <> '')""",
    "piece": """
        select key, section_no, section_path, char_start, char_start + len(part) as char_end, part as text, false as cut from part where len(part) <= 2000
        union all
        select key, section_no, section_path, begins, begins + len(piece), piece, true from cutting where piece is not null""",
    "sentence": f"""
        select *, sentence_start + len(sentence) as sentence_end from (
            select key, section_no, section_path, char_start, char_end, cut, sentence_no,
                (char_start + coalesce(sum(len(raw)) over (partition by key, char_start order by sentence_no rows between unbounded preceding and 1 preceding), 0))::BIGINT as sentence_start,
                {strip_end('raw')} as sentence
            from (select *, unnest(parts) as raw, generate_subscripts(parts, 1) - 1 as sentence_no
                from (select *, {sentence_parts('text')} as parts from piece)))""",
    "counted": f"""
        select *, {words('sentence')} as n_words,
            coalesce(sum({words('sentence')}) over (partition by key order by sentence_start rows between unbounded preceding and 1 preceding), 0)::BIGINT as words_before,
            case when sentence_no > 0 then sentence_start
                when regexp_matches(lag(sentence) over s, '[.!?]["'')\\]]{{0,2}}$') and lag(sentence_end) over s < sentence_start
                    then sentence_start + len(sentence) - len({strip_start('sentence')})
                when regexp_matches(sentence, '^[ \\t]*(?:[-*+]|\\d+[.)])[ \\t]') and lag(sentence_end) over s < sentence_start then sentence_start end as opens
        from sentence window s as (partition by key, section_no order by sentence_start)""",
    "measured": """
        select key, section_no, char_start, min(section_path) as section_path, max(char_end) as char_end, bool_or(cut) as cut,
            min(words_before) as words_before, max(words_before + n_words) as words_after,
            row_number() over (partition by key, section_no order by char_start) as piece_no
        from counted group by key, section_no, char_start""",
    "packing": """
        select key, section_no, piece_no as first_piece, char_start as start, words_before as words from measured where piece_no = 1
        union all
        select key, section_no, piece_no, case when repeats then opens else char_start end, case when repeats then opens_words else words_before end
        from (
            select n.*, o.opens, o.words_before as opens_words,
                o.opens is not null and not l.cut and not n.cut and o.opens > l.start and n.words_after - o.words_before <= 180 and n.char_end - o.opens <= 2000 as repeats
            from (select k.key, k.section_no, k.start, max(m.piece_no) as last_piece, arg_max(m.cut, m.piece_no) as cut
                from packing k join measured m on m.key = k.key and m.section_no = k.section_no and m.piece_no >= k.first_piece
                    and (m.piece_no = k.first_piece or (m.words_after - k.words <= 180 and m.char_end - k.start <= 2000))
                group by k.key, k.section_no, k.start) l
            join measured n on n.key = l.key and n.section_no = l.section_no and n.piece_no = l.last_piece + 1
            left join counted o on o.key = n.key and o.section_no = n.section_no and o.opens is not null
                and o.words_before >= n.words_before - 30 and o.words_before < n.words_before
            qualify row_number() over (partition by n.key, n.section_no, n.piece_no order by o.opens nulls last) = 1)""",
    "packed": """
        select k.key, k.section_no, k.start as char_start, max(m.char_end) as char_end, min(m.section_path) as section_path
        from packing k join measured m on m.key = k.key and m.section_no = k.section_no and m.piece_no >= k.first_piece
            and (m.piece_no = k.first_piece or (m.words_after - k.words <= 180 and m.char_end - k.start <= 2000))
        group by k.key, k.section_no, k.start""",
    "packed_chunk": f"""
        select t.tenant_id, t.key, t.version_no, (row_number() over (partition by t.key order by p.char_start, p.char_end) - 1)::BIGINT as ordinal,
            p.section_path, p.char_start::BIGINT as char_start, p.char_end::BIGINT as char_end, substr(t.text, p.char_start::BIGINT + 1, (p.char_end - p.char_start)::BIGINT) as content
        from packed p join doc_text t using (key)""",
    "fitting": f"""
        select key, ordinal, char_start, content as rest, room, null::VARCHAR as piece, null::BIGINT as begins
        from (select *, greatest(1, 382 - {words('section_path')}) as room from packed_chunk)
        where {words('content')} > room
        union all
        select key, ordinal, case when {words('rest')} > room then char_start + cut + len(substr(rest, cut + 1)) - len({strip_start('substr(rest, cut + 1)')}) else char_start end,
            case when {words('rest')} > room then {strip_start('substr(rest, cut + 1)')} else '' end, room,
            case when {words('rest')} > room then {strip_end('left(rest, cut)')} else rest end, char_start
        from (select *, case when len(regexp_extract(prefix, '(?s)^(.+\\n)', 1)) > 0 then len(regexp_extract(prefix, '(?s)^(.+\\n)', 1))
                when len(regexp_extract(prefix, '(?s)^(.+)\\s', 1)) > 0 then len(regexp_extract(prefix, '(?s)^(.+)\\s', 1)) else len(prefix) end as cut
            from (select *, regexp_extract(array_to_string(list_slice(regexp_extract_all(rest, '\\S+\\s*'), 1, room), ''), '(?s)^(.*\\S)', 1) as prefix
                from fitting where rest <> ''))""",
    "chunk": f"""
        select tenant_id, key, version_no, (row_number() over (partition by key order by ordinal, char_start) - 1)::BIGINT as ordinal, section_path,
            char_start, char_start + len(content) as char_end, content, {words('content')}::BIGINT as word_count
        from (
            select tenant_id, key, version_no, ordinal, section_path, char_start, content from packed_chunk where (key, ordinal) not in (select key, ordinal from fitting)
            union all
            select c.tenant_id, c.key, c.version_no, c.ordinal, c.section_path, f.begins, f.piece from fitting f join packed_chunk c using (key, ordinal) where f.piece is not null)""",
    # evaluation cases and requests
    "case_draw": f"""
        select *, parts[({h('line', 'key')} % greatest(len(parts), 1) + 1)::INT] as drawn, parts[({h('ask', 'key')} % greatest(len(parts), 1) + 1)::INT] as other_drawn
        from (select m.*, 'case-' || substr(key, 5, 7) as case_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)),
            lambda x: {strip('x')}), lambda x: len(x) > 0) as parts from manifest m)""",
    "case_text": f"""
        select *, coalesce(drawn, '') as quote, coalesce(other_drawn, '') as other, {one_of('who', 'case_id', *QUERY_PRINCIPALS)} as subject,
            case {h('kind', 'key')} % 3 when 0 then coalesce(drawn, '') when 1 then coalesce(other_drawn, '') || ' ' || coalesce(drawn, '') else coalesce(other_drawn, '') end as query,
            case when {h('asof', 'key')} % 2 = 0 then timestamp '{AS_OF}' end as as_of, case when {h('reg', 'key')} % 5 = 0 then 'US' end as asked_region
        from case_draw""",
    "case_decided": f"""
        select c.*, p.subject as principal, p.region as p_region, {authorized('p', 'v')} is true as allowed, {in_scope(f"coalesce(c.as_of, timestamp '{AS_OF}')", "coalesce(c.asked_region, p.region)", 'v')} is true as applies,
            v.version_no, case when c.quote = '' then 0 else len(string_split(t.text, c.quote)) - 1 end as found
        from case_text c join principal p using (subject) join current_version v on v.key = c.key join doc_text t on t.key = c.key""",
    "eval_case": f"""
        select case_id, case when s < 2 then 'dev' when s < 9 then 'test' else 'holdout' end as split, query, principal, answerable, key, version_no, quote,
            case when answerable then [quote] else []::VARCHAR[] end as expected_facts, not answerable as must_abstain,
            case when not allowed then [key] else []::VARCHAR[] end as unauthorized_documents,
            ['doc-' || lpad((doc_id + 1)::VARCHAR, 7, '0')] as hard_negative_documents,
            case when allowed and not applies then [key] when {h('oos', 'key')} % 10 = 0 then ['doc-' || lpad((doc_id + 1)::VARCHAR, 7, '0')] else []::VARCHAR[] end as out_of_scope_documents, as_of, asked_region as region,
            [(['lookup', 'paraphrase', 'multi'])[({h('tag', 'key')} % 3 + 1)::INT], case when not allowed then 'authorization-negative' when not applies then 'scope' else 'plain' end] as tags, doc_id
        from (select *, {h('split', 'key')} % 10 as s, allowed and applies and status = 'active' and len(quote) >= 10 and found = 1 as answerable from case_decided)""",
    "request": f"""
        select request_id, {one_of('who', 'request_id', *QUERY_PRINCIPALS)} as subject, query, timestamp '{AS_OF}' as as_of, null::VARCHAR as region
        from (select 'req-' || lpad(item_id::VARCHAR, 6, '0') as request_id, text as query from benchmark)
        union all select case_id, principal, query, as_of, region from eval_case""",
    "scoped_request": f"""
        select r.request_id, r.subject, r.query, coalesce(r.as_of, timestamp '{AS_OF}') as as_of, coalesce(r.region, p.region) as region, p.tenant_id, p.department, p.projects, p.clearance_rank
        from request r join principal p using (subject)""",
    "candidate": """
        select c.*, v.title, v.classification, v.classification_rank, v.allowed_departments, v.required_projects, v.applies_to_regions, v.valid_from, v.valid_to, v.format
        from chunk c join active_version v on c.tenant_id = v.tenant_id and c.key = v.key and c.version_no = v.version_no""",
    "allowed_pair": f"""
        select r.request_id, v.key from scoped_request r join active_version v on {authorized('r', 'v')} and {in_scope('r.as_of', 'r.region', 'v')}""",
    "chunk_term": f"""
        select tenant_id, key, version_no, ordinal, char_start, char_end, unnest(t) as term, generate_subscripts(t, 1) - 1 as pos, len(t) as n_terms
        from (select *, {terms("section_path || chr(10) || content")} as t from candidate)""",
    "posting": """
        select key, version_no, ordinal, char_start, char_end, term, n_terms, count(*)::BIGINT as tf from chunk_term group by all""",
    "request_term": f"select request_id, unnest({terms('query')}) as term from scoped_request",
    "sparse_score": """
        select request_id, key, version_no, ordinal, char_start, char_end, sum(tf)::BIGINT as matched
        from (select distinct request_id, term from request_term) q join posting using (term) join allowed_pair using (request_id, key) group by all""",
    "sparse_hit": """
        select * exclude (matched), matched * 0.1::DOUBLE as score, row_number() over (partition by request_id order by matched desc, key, version_no, ordinal) as rank
        from sparse_score qualify rank <= 50""",
    "chunk_size": f"select key, ordinal, len({terms("section_path || chr(10) || content")}) as n_terms from candidate",
    "request_size": "select request_id, count(*) as n, sum(n_terms) / count(*) as average from allowed_pair join chunk_size using (key) group by request_id",
    "asked_term": "select request_id, term, count(*) as asked from request_term group by all",
    "term_frequency": "select request_id, term, count(*) as df from asked_term join posting using (term) join allowed_pair using (request_id, key) group by all",
    "bm25_score": """
        select request_id, key, version_no, ordinal, char_start, char_end,
            round(sum(asked * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / average))), 9) as score
        from asked_term join term_frequency using (request_id, term) join request_size using (request_id) join posting using (term) join allowed_pair using (request_id, key)
        group by all""",
    "bm25_hit": """
        select *, row_number() over (partition by request_id order by score desc, key, version_no, ordinal) as rank from bm25_score where score > 0 qualify rank <= 10""",
    "chunk_bucket": f"""
        select key, version_no, ordinal, char_start, char_end, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 as bucket, count(*) as cnt
        from (select *, unnest({plain_words("section_path || chr(10) || content")}) as w from candidate) group by all""",
    "chunk_length": "select key, ordinal, sqrt(sum(cnt * cnt)) as length from chunk_bucket group by all",
    "request_bucket": f"""
        select request_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 as bucket, count(*) as q_cnt
        from (select request_id, unnest({plain_words('query')}) as w from scoped_request) group by all""",
    "request_length": "select request_id, sqrt(sum(q_cnt * q_cnt)) as q_length from request_bucket group by all",
    "dot": """
        select request_id, key, version_no, ordinal, char_start, char_end, sum(cnt * q_cnt) as dot
        from request_bucket join chunk_bucket using (bucket) join allowed_pair using (request_id, key) group by all""",
    "dense_pair": """
        select a.request_id, k.key, k.version_no, k.ordinal, k.char_start, k.char_end,
            round(coalesce(d.dot, 0) / (l.length * r.q_length), 9) as score
        from allowed_pair a join candidate k using (key) join request_length r using (request_id) join chunk_length l on l.key = k.key and l.ordinal = k.ordinal
        left join dot d on d.request_id = a.request_id and d.key = k.key and d.ordinal = k.ordinal""",
    "dense_hit": """
        select *, row_number() over (partition by request_id order by score desc, key, version_no, ordinal) as rank from dense_pair qualify rank <= 50""",
    "fused": """
        select *, row_number() over (partition by request_id order by score desc, key, version_no, char_start) as fused_rank from (
            select request_id, key, version_no, ordinal, coalesce(s.char_start, d.char_start) as char_start, coalesce(s.char_end, d.char_end) as char_end,
                s.rank as sparse_rank, d.rank as dense_rank, round(coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0), 9) as score
            from sparse_hit s full join dense_hit d using (request_id, key, version_no, ordinal))""",
    "pool": dedupe("fused", "fused_rank", 20),
    "reranked": f"""
        select p.*, row_number() over (partition by request_id order by rerank_score desc, fused_rank) as rank from (
            select p.request_id, p.key, p.version_no, p.ordinal, p.char_start, p.char_end, p.rank as fused_rank,
                round(case when len(q) = 0 then 0 else len(list_intersect(q, {plain_words('k.content')})) / len(q) end, 9) as rerank_score
            from pool p join candidate k on k.key = p.key and k.ordinal = p.ordinal
            join (select request_id, list_distinct({plain_words('query')}) as q from scoped_request) r on r.request_id = p.request_id) p""",
    "sparse_top": dedupe("sparse_hit", "rank", 10),
    "dense_top": dedupe("dense_hit", "rank", 10),
    "hybrid_top": dedupe("fused", "fused_rank", 10),
    "result": """
        select request_id, 'sparse-only' as strategy, rank, key, version_no, ordinal, char_start, char_end, score from sparse_top
        union all select request_id, 'dense-only', rank, key, version_no, ordinal, char_start, char_end, score from dense_top
        union all select request_id, 'hybrid-rrf', rank, key, version_no, ordinal, char_start, char_end, score from hybrid_top
        union all select request_id, 'hybrid-rrf-rerank', rank, key, version_no, ordinal, char_start, char_end, rerank_score from reranked where rank <= 10""",
}
_RECURSIVE = {"cutting", "packing", "fitting"}


def sql(query: str, **extra: str) -> str:
    """A statement with exactly the shared and given definitions it uses, in the order they are defined."""
    known = DEFINITIONS | extra
    names = re.compile(r"\b(?:from|join)\s+(" + "|".join(sorted(known, key=len, reverse=True)) + r")\b")
    ordered: list[str] = []

    def visit(text: str, owner: str | None) -> None:
        for name in names.findall(text):
            if name != owner and name not in ordered:
                visit(known[name], name)
                if name not in ordered:
                    ordered.append(name)

    visit(query, None)
    if not ordered:
        return query
    hint = lambda n: "" if n in _RECURSIVE else " materialized"
    return "with recursive " + ",\n".join(f"{n} as{hint(n)} ({known[n]})" for n in ordered) + "\n" + query

