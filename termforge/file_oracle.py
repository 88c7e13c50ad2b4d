"""The queries of ``file_queries`` in SQL over the tables themselves: what is written must come back as it was."""

from __future__ import annotations

from termforge import oracle as O
from termforge.functions.text import STOP_WORDS
from termforge.operators.registry import FEATURES

_NEWEST = "newest as (select docid, max(title) as title, max(headings) as headings, max(body) as body from docs where docid is not null group by docid)"
_QUERY_ROWS = "(select docno as query_id, max(text_raw) as query, max(relevant_id_doc) as relevant from queries where docno is not null group by docno)"
_RELEVANT_DOCS = f"with {O._CORPUS}, {O._QUERIES}, {O._RELEVANT}"
_DOC_ROWS = f"with {O._CORPUS}, f as (select doc_id, {O._DOC_TEXT} from corpus)"
_ROUNDED = ", ".join(f"round({n}::float::double, 3) as {n}" for n in O._DOC_NAMES)
_SEARCHED = f"with {O._SEARCH}, v as ({O._PAIR_VALUES})"
_STANDARD = r"[\p{L}\p{M}]+(?:[''’.][\p{L}\p{M}]+)*[\p{L}\p{M}\p{Nd}]*|\p{Nd}+(?:[.,]\p{Nd}+)*[\p{L}\p{M}\p{Nd}]*"
_NO_OPERATORS = rf"array_to_string(list_filter(regexp_split_to_array(regexp_replace(query, '{O._JS}+$', ''), '{O._JS}'), lambda x: x not in ('OR', 'AND', 'NOT', 'TO')), ' ')"
_LENGTHS = f"list_transform({O._words('body')}, lambda x: length(x))"
_FAMILIES = f"values_ as (select doc_id, coalesce(list_avg({_LENGTHS}), 0)::float as m, coalesce(list_max({_LENGTHS}), 0)::float as l, case when length(title) + length(body) = 0 then 0 else length(title) / (length(title) + length(body)) end::float as s from corpus)"
_CHECKS = ", ".join(f"{{'feature': '{n}', 'value': {c}::double, 'border': {b}::double}}" for n, c in (("doc_mean_word_length", "m"), ("doc_longest_word", "l"), ("doc_title_share", "s")) for b in (0.0, 5.5))
_BEST_DOCS = O.ORACLE["best_query_per_document"]
_MODEL_RANKS = f"""ranked as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as first, row_number() over (partition by query_id order by bm25 desc, doc_id) as second from (select s.query_id, s.doc_id, score, round(bm25::double, 4) as bm25 from scored s join v using (query_id, doc_id)) where score > -1000)"""
_SPLIT_VALUE = "('0x' || substring(md5('42|' || query || '|' || doc_id || '|' || label), 1, 12))::bigint::double / 281474976710656"

_TREES = "0.5 * ((case when doc_word_count > 120.5 then case when doc_special_character_count > 40.5 then 1.5 else 0.25 end else case when doc_special_character_count > 40.5 then 0.125 else -0.5 end end)::double + (case when doc_size_kbyte > 1 then -0.25 else 0.75 end)::double + 0.0625::double) + 0.25::double"
_RULE = O._NOUNS[O._NOUNS.index("w not in (") : O._NOUNS.rindex("))::double")]
_LEXICON = O._NOUNS.replace(_RULE, f"(w in ('bowls', 'being') or w not in ('bowls', 'cold', 'run', 'being', 'kilns') and {_RULE})").replace("::double", "")

ORACLE = {
    "tree_scores": f"{_DOC_ROWS}, r as (select doc_id, {_TREES} as raw from f) select doc_id, raw, round(1 / (1 + exp(-raw)), 9) as probability from r",
    "nouns_by_lexicon": f"with {O._QUERIES} select query_id, {_LEXICON} as nouns from qs",
    "corpus_shards_read": f"with {_NEWEST} select docid as doc_id, title, md5(body) as body_md5 from newest",
    "headings_read": f"with {_NEWEST} select docid as doc_id, md5(coalesce(headings, '') || chr(10) || coalesce(body, '')) as body_md5 from newest",
    "index_written": f"with {O._INDEX} select doc_id, sum(tf)::bigint as tokens, count(*) as terms from tfs group by doc_id",
    "index_lookup": f"with {O._CORPUS}, numbered as (select doc_id, title, row_number() over (order by doc_id) - 1 as n, max(doc_id) over () as m from corpus) select 'id' as by, doc_id, title from numbered where doc_id = m union all select 'ordinal', doc_id, title from numbered where n = 10",
    "queries_read": f"select query_id, query, coalesce(len(relevant), 0) as relevant from {_QUERY_ROWS} where query_id <> '' and query <> ''",
    "candidate_lines_read": f"{_RELEVANT_DOCS} select '1' as label, query_id, doc_id, title, md5(body) as body_md5 from relevant join corpus using (doc_id)",
    "ranked_lines_read": f"{_RELEVANT_DOCS} select '0' as label, query_id, doc_id, title, md5(body) as body_md5 from relevant join corpus using (doc_id)",
    "lines_numbered": f"with {O._QUERIES} select row_number() over (order by query_id) - 1 as line_no, query_id from qs",
    "relevance_read": f"{_RELEVANT_DOCS} select query_id, doc_id from relevant where query_id <> '' and doc_id <> ''",
    "model_read": """select * from (values (0, 0, 1.25::double, 'BM25Score', 1.5::double), (0, 1, 1.25, 'doc_word_count', 40.0), (1, 0, 0.75, 'ExactMatchCount', 1.0), (2, 0, 0.5, 'TitleExactMatchRatio', 0.3), (2, 1, 0.5, 'QueryWordCount', 2.0), (3, 0, 0.375, 'UnorderedWindow8', 0.0),
(4, 0, -0.625, 'doc_special_character_count', 60.0), (5, 0, -0.25, 'doc_size_kbyte', 1.1), (5, 1, -0.25, 'doc_has_url', -1.0)) as t(monomial, split, coefficient, feature, border)""",
    "dictionary_read": f"with {O._QUERIES} select distinct lower(upper(word)) as word from (select unnest({O._words('query')}) as word from qs)",
    "query_log_read": f"with {O._QUERIES}, w as (select query_id, unnest(list_distinct(regexp_split_to_array(regexp_replace(lower(query), '{O._JS}+$', ''), '{O._JS}+'))) as word from qs) select word, count(*) as n from w group by word",
    "vectors_text_read": f"{_DOC_ROWS} select doc_id, {', '.join(f'round(round({n}::float::double, 4)::float::double, 3) as {n}' for n in O._DOC_NAMES)} from f",
    "vectors_binary_read": f"{_DOC_ROWS} select doc_id, {_ROUNDED} from f",
    "vectors_inspected": f"with {O._CORPUS}, {O._QUERIES}, {O._PAIRS}, p as (select query_id || '|' || doc_id as id from pairs join qs using (query_id) join corpus using (doc_id)) select (select count(*) from p) as rows, 3 as width, id from p order by id limit 5",
    "candidates_json_read": f"with {O._CORPUS} select query_id, doc_id as doc_no, bm25, len({O._words('body')}) as words from ({_BEST_DOCS}) join corpus using (doc_id)",
    "sharded_read": f"with {O._CORPUS} select nullif(regexp_extract(doc_id, '^[^_]+_(\\d{{2}})_', 1), '')::int as shard, count(*) as rows from corpus group by 1",
    "by_query_read": f"with {O._PAIRS}, {O._QUERIES} select query_id, count(*) as rows, 'all' as read from pairs group by query_id union all select query_id, count(*), 'one' from pairs where query_id = (select min(query_id) from qs) group by query_id",
    "dataset_read": f"with {O._TRAINING} select split, label, count(*) as rows, count(distinct query) as queries, sum(len({O._words('query')}))::double as words from split group by split, label",
    "dataset_files": f"with {O._TRAINING} select '3,query_words,QueryWords' as name, 1::bigint as rows union all select split, count(*) from split group by split",
    "stream_rows_read": f"{_RELEVANT_DOCS} select '1' as label, query_id as query, doc_id, 3 as rank, len({O._words('body')})::double as words, len(regexp_extract_all(body, '[aeiouAEIOU]'))::double as vowels from relevant join corpus using (doc_id)",
    "text_body_read": "select '' as title, 'Old bees' || chr(10) || 'and new bees' || chr(10) as body, 5 as words",
    "streamed_features": O.ORACLE["document_text_features"],
    "predicate_counts": f"""{_SEARCHED}, t as (select list_filter(regexp_split_to_array(lower(title), '{O._WS}'), lambda x: x <> '') as t from corpus)
select (select count(distinct doc_id) from tfs where term in ('bowls', 'kilns', 'glazes')) as any_term, (select count(*) from t where len(list_intersect(['bowls', 'kilns', 'glazes'], t)) >= 1) as title_ratio, (select count(*) from t where len(list_intersect(['bowls', 'kilns', 'glazes'], t)) >= 1) as title_count,
 count(*) filter (b2 > 0 or b3 > 0) as any_ngram, count(*) filter (w4 > 0) as any_window4, count(*) filter (w8 > 0) as any_window8 from v""",
    "single_term_documents": f"with {O._INDEX} select doc_id, tf from tfs where term = 'bowls'",
    "hit_counts": f"with {O._SEARCH}, {O._SCORES}, h as (select count(*) as n from scored where score > -0.25) select 'exact' as how, n as hits, 'EQUAL_TO' as relation from h union all select 'limited', least(n, 5), case when n >= 5 then 'GREATER_THAN_OR_EQUAL_TO' else 'EQUAL_TO' end from h",
    "candidate_entries": f"with {O._SEARCH}, {O._SCORES}, h as (select doc_id, score::float as score, row_number() over (order by score::float desc, doc_id) - 1 as place, count(*) over () as found from scored where score > -0.25) select place, doc_id, score::double as score, found from h where place < 25",
    "compared_model_ranks": f"with {O._PAIR_ROWS}, {O._SCORES}, {O._RELEVANT}, {_MODEL_RANKS} select query_id, doc_id, coalesce(first, 3000) as first_rank, coalesce(second, 3000) as second_rank, coalesce(first, 3000) - coalesce(second, 3000) as difference from relevant left join ranked using (query_id, doc_id)",
    "pairs_above_both": f"with {O._RUNS} select run_id, count(*) as rows from runs where bm25 > 0.4::double and tfidf > 0.4::double and not isnan(tfidf) and not isnan(bm25) group by run_id",
    "live_documents": f"with {O._INDEX} select term, count(*) as df from tfs where doc_id not in (select docid from docs where site = 'mibralehub.test' and docid is not null) group by term",
    "mandatory_pairs": f"{_RELEVANT_DOCS} select query_id, doc_id, title from relevant join corpus using (doc_id)",
    "sorted_pairs": f"select query_id, doc_id, BM25Score from ({O.ORACLE['pair_feature_table']})",
    "split_by_rows": f"with {O._TRAINING} select source, label, query, doc_id, case when {_SPLIT_VALUE} < 0.95 then 'train' else 'valid' end as split from training",
    "limited_rows": f"with {O._CORPUS} select row_number() over (order by doc_id) - 1 as line_no, doc_id from corpus order by doc_id limit 500",
    "first_candidates": f"with {O._RUNS}, n as (select *, row_number() over (partition by run_id, query_id order by rank_no) as place from runs) select run_id, query_id, rank_no, doc_no from n where place <= 3",
    "nonzero_features": f"{_DOC_ROWS} select doc_id, ({' + '.join(f'(abs({n}::float) >= 0.0001)::int' for n in O._DOC_NAMES)}) as nonzero from f",
    "standard_analysis": f"with {O._QUERIES} select query_id, array_to_string(list_filter(regexp_extract_all(lower({_NO_OPERATORS}), '{_STANDARD}'), lambda x: x not in ({', '.join(map(repr, STOP_WORDS))})), '|') as tokens from qs",
    "json_fields": f"with {O._QUERIES} select query_id as docno, null::varchar as gone from qs",
    "family_values": f"with {O._CORPUS}, {_FAMILIES} select doc_id, round(m::double, 4) as doc_mean_word_length, round(l::double, 4) as doc_longest_word, round(s::double, 4) as doc_title_share from values_",
    "family_conditions": f"with {O._CORPUS}, {_FAMILIES}, x as (select unnest([{_CHECKS}]) as x from values_), y as (select x.feature as feature, x.value as value, x.border as border, unnest(['GT', 'LT', 'GE', 'LE']) as c from x) select feature, c as comparison, border, count(*) filter ({O._COMPARED}) as met, 0::bigint as differing from y group by all",
    "feature_names": "select * from (values " + ", ".join(f"({i}, '{n}', '{f}')" for i, (n, f) in enumerate(FEATURES)) + ") as t(place, name, family)",
}
