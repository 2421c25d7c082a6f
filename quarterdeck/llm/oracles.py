"""Check statements in SQL of the queries that SQL can express. The others learn, tokenise or walk links; tests hold them against plain versions."""
from __future__ import annotations

_ESCAPED = "replace(replace(replace(replace(replace({0}, '~', '~~'), '<s>', '<~s>'), '</s>', '<~/s>'), '[INST]', '[~INST]'), '[/INST]', '[~/INST]')"
_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TERMS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

STATEMENTS: dict[str, str] = {
    "op4_chat_format": f"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        joined as (
            select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
                   coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '') as learned,
                   sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + length('<s>[INST]  [/INST]</s>')) as formatted_chars
            from turns group by conv_id)
        select conv_id, cast(n_turns as bigint) as n_turns, sha256(said) as turns_sha256, cast(length(learned) as bigint) as loss_chars,
               sha256(learned) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars
        from joined""",
    "op7_decontamination": f"""
        with docs as (select row_number() over () as k, doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
        items as (select cast(item_id as varchar) as item, {_WORDS.format("coalesce(text, '')")} as p from benchmark),
        windows as (
            select distinct item, least(len(p), 13) as n, array_to_string(p[i : i + least(len(p), 13) - 1], ' ') as win
            from (select item, p, unnest(generate_series(1, greatest(len(p) - 12, 1))) as i from items where len(p) > 0)),
        lengths as (select distinct n from windows),
        places as (select k, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from docs, lengths where len(w) >= n),
        found as (select p.k, p.i, p.n, x.item from places p join windows x on x.n = p.n and x.win = array_to_string(p.w[p.i : p.i + p.n - 1], ' ')),
        hits as (select k, count(distinct spot) as n_hit from (select k, unnest(generate_series(i, i + n - 1)) as spot from found) group by k),
        owners as (select k, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct k, item from found where item is not null) group by k)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from docs left join hits using (k) left join owners using (k)""",
    "op13_ranked_search": f"""
        with docs as (select row_number() over () as k, doc_id, {_TERMS.format("coalesce(text, '')")} as w from documents),
        items as (select row_number() over () as q, item_id, {_TERMS.format("coalesce(text, '')")} as w from benchmark),
        corpus as (select count(*) as c, cast(sum(len(w)) as bigint) as l from docs where len(w) > 0),
        held as (select k, doc_id, len(w) as n, term, count(*) as tf from (select k, doc_id, w, unnest(w) as term from docs) group by all),
        terms as (select term, cast(floor(1000 * ln((2 * c + 2) / (2 * count(*) + 1))) as bigint) as weight from held, corpus group by term, c),
        asked as (select distinct q, item_id, term from (select q, item_id, unnest(w) as term from items)),
        scores as (
            select q, item_id, k, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * c) // l)))) as bigint) as score
            from asked join terms using (term) join held using (term), corpus group by all)
        select item_id, cast(rank as integer) as rank, doc_id, score
        from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scores where score > 0) where rank <= 50""",
}
