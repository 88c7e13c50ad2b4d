"""The core's queries in SQL over the same tables, for comparison. Single-precision steps are cast as in the engine."""

from __future__ import annotations

import re

from termforge.operators.query_features import NO_NOUN_ENDS, NO_NOUNS

_WS = r"[\s\x0b\x1c-\x1f\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]+"
_JS = r"[\s\x0b]"  # what the engine's \s matches


def _tokens(c: str) -> str:
    return f"flatten(list_transform(list_filter(regexp_split_to_array({c}, '{_WS}'), lambda x: x <> ''), lambda x: case when length(x) <= 255 then [x] else regexp_extract_all(x, '(?s).{{1,255}}') end))"


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({_trim(c)}, '{_JS}+'), lambda x: x <> '')"


def _ascii(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9\s\x0b]', ' ', 'g'), '{_JS}+'), lambda x: x <> '')"


def _special(c: str) -> str:
    return rf"(length(regexp_replace({c}, '[a-zA-Z0-9\s\x0b]+', '', 'g')) + len(regexp_extract_all({c}, '[\x{{10000}}-\x{{10FFFF}}]')))"


def _numbers(c: str) -> str:
    """Letters and digits beyond ASCII become a, other characters beyond ASCII a blank, as word borders take them."""
    plain = rf"regexp_replace(regexp_replace({c}, '[^\x00-\x7F\p{{L}}\p{{Nd}}]', ' ', 'g'), '[^\x00-\x7F]', 'a', 'g')"
    return rf"len(regexp_extract_all({plain}, '\b\d+(?:\.\d+)?\b'))"


def _paragraphs(c: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({_trim(c)}, '\n{_JS}*\n'), lambda x: {_trim('x')} <> ''))"


_CORPUS = "corpus as (select docid as doc_id, max(title) as title, max(body) as body from docs where docid <> '' group by docid having max(body) <> '' and max(title) is not null)"
_QUERIES = "qs as (select docno as query_id, coalesce(max(text_raw), '') as query, max(relevant_id_doc) as relevant from queries where docno is not null group by docno)"
_PAIRS = "pairs as (select distinct query_id, doc_no as doc_id from candidates where query_id is not null and doc_no is not null)"
_RELEVANT = "relevant as (select distinct query_id, unnest(relevant) as doc_id from qs)"
_TOKENS = f"toks as (select doc_id, {_tokens('body')} as t, {_tokens('title')} as tt from corpus)"
_TERMS = "flat as (select doc_id, unnest(t) as term from toks), tfs as (select doc_id, term, count(*) as tf from flat group by all), terms as (select term, count(*) as df, sum(tf)::bigint as ttf from tfs group by term)"
_STATS = "stats as (select count(*) as num_docs, count(*) filter (len(t) > 0) as doc_count, sum(len(t))::bigint as sum_ttf, (sum(len(t)) / count(*) filter (len(t) > 0))::float as average_length from toks)"
_CODED = "lens as (select doc_id, len(t) as n, greatest(len(t) - 24, 0) as o, greatest(length(bin(greatest(len(t) - 24, 0))) - 4, 0) as s from toks), coded as (select doc_id, case when n < 24 then n else 24 + ((o >> s) << s) end as l from lens)"
_BM25 = """(w - w / (1::float + tf::float * (1::float / (1.2::float * (0.25::float + (0.75::float * l::float) / average_length)))))"""
_IDF = "ln(1 + (doc_count - df + 0.5) / (df + 0.5))::float"
_TFIDF = "(case when df = 0 then ln(num_docs + 1.0) else ln((num_docs + 1.0) / (df + 1.0)) + 1.0 end)"
_INDEX = f"{_CORPUS}, {_TOKENS}, {_TERMS}, {_STATS}, {_CODED}"
_CLEAN = rf"array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(query, '[[:punct:]]+', ' ', 'g'), '{_JS}+$', ''), '{_JS}'), lambda x: x not in ('OR', 'AND', 'NOT', 'TO')), ' ')"
_HITS = f"""qterms as (select query_id, unnest({_tokens(_CLEAN)}) as term from qs), qtfs as (select query_id, term, count(*) as qtf from qterms group by all),
parts as (select query_id, doc_id, tf, l, average_length, qtf, df, num_docs, qtf::float * {_IDF} as w from qtfs join terms using (term) join tfs using (term) join coded using (doc_id) cross join stats),
hits as (select query_id, doc_id, sum({_BM25}::double)::float as bm25, sum(qtf * tf * {_TFIDF})::float as tfidf from parts group by all)"""
_RANKED = f"with {_INDEX}, {_QUERIES}, {_HITS}, ranked as (select *, row_number() over (partition by query_id order by bm25 desc, doc_id) as rank from hits)"

_DOC_TEXT = f"""len({_words('title')}) + len({_words('body')}) as doc_word_count, len(regexp_extract_all(body, '[aeiouAEIOU]')) as doc_vowel_count, {_special('title')} + {_special('body')} as doc_special_character_count,
{_numbers('title')} as doc_title_number_count, {_numbers('body')} as doc_body_number_count, {_paragraphs('body')} as doc_paragraph_count, (strlen(title || body)::float / 1024::float)::double as doc_size_kbyte,
regexp_matches(title || body, 'https?://|www\\.')::int::double as doc_has_url"""
_DOC_NAMES = "doc_word_count doc_vowel_count doc_special_character_count doc_title_number_count doc_body_number_count doc_paragraph_count doc_size_kbyte doc_has_url".split()
_DOUBLES = ", ".join(f"{n}::double as {n}" for n in _DOC_NAMES)
_UNICODE = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]+"


def _unique(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def _grams(c: str, n: int) -> str:
    return f"list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))"


def _windows(reach: int) -> str:
    return f"coalesce(list_sum(list_transform(h, lambda a: len(list_filter(h, lambda b: b.i > a.i and b.i <= a.i + {reach} and b.t <> a.t)))), 0)"


_PAIR_ROWS = f"""{_INDEX}, {_QUERIES}, {_PAIRS}, q as (select query_id, {_tokens('query')} as q from qs),
rows_ as (select query_id, doc_id, q, t, tt, list_filter(list_transform(t, lambda x, i: {{'i': i, 't': x}}), lambda x: list_contains(q, x.t)) as h from pairs join q using (query_id) join toks using (doc_id)),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest(q) as term from q) group by all),
sums as (select query_id, doc_id, sum({_BM25}::double)::float as bm25, sum(qtf * tf * {_TFIDF})::float as tfidf from
  (select query_id, doc_id, tf, l, average_length, qtf, df, num_docs, qtf::float * {_IDF} as w from pairs join qt using (query_id) join terms using (term) join tfs using (doc_id, term) join coded using (doc_id) cross join stats) group by all)"""
_PAIR_VALUES = f"""select query_id, doc_id, coalesce(bm25, 0) as bm25, coalesce(tfidf, 0) as tfidf, case when len(q) = 0 then 0 else len(list_intersect(q, t))::float / len(list_distinct(q))::float end as er, len(list_intersect(q, t)) as ec,
case when len(q) = 0 then 0 else len(list_intersect(q, tt))::float / len(list_distinct(q))::float end as tr, len(list_intersect(q, tt)) as tc,
len(list_filter({_grams('t', 2)}, lambda x: list_contains({_grams('q', 2)}, x))) as b2, len(list_filter({_grams('t', 3)}, lambda x: list_contains({_grams('q', 3)}, x))) as b3,
{_windows(5)} as w4, {_windows(9)} as w8, len(q) as qn from rows_ left join sums using (query_id, doc_id)"""

_SEARCH = _PAIR_ROWS.replace(_QUERIES, "qs as (select 'q' as query_id, 'bowls kilns glazes' as query)").replace(_PAIRS, "pairs as (select 'q' as query_id, doc_id from corpus)")
_MODEL = """-0.5::double + case when v.bm25 > 1.5 and doc_word_count > 40 then 1.25 else 0 end::double + case when v.ec > 1 then 0.75 else 0 end::double + case when v.tr > 0.3::double and qn > 2 then 0.5 else 0 end::double + case when v.w8 > 0 then 0.375 else 0 end::double
 + case when doc_special_character_count > 60 then -0.625 else 0 end::double + case when doc_size_kbyte > 1.1 and doc_has_url > -1 then -0.25 else 0 end::double"""
_SCORES = f"v as ({_PAIR_VALUES}), f as (select doc_id, {_DOC_TEXT} from corpus), scored as (select v.query_id, v.doc_id, {_MODEL} as score from v join f using (doc_id))"
_TRAINING = f"""{_QUERIES}, {_PAIRS}, {_RELEVANT}, training as (select 0 as source, '1' as label, query, doc_id from relevant join qs using (query_id) where query <> ''
 union all select 1, '0', query, doc_id from pairs p join qs using (query_id) where query <> '' and not exists (select 1 from relevant r where r.query_id = p.query_id and r.doc_id = p.doc_id)),
ordered as (select query, row_number() over (order by md5('42|' || query), query) as place, count(*) over () as total from (select distinct query from training)),
split as (select source, label, training.query, doc_id, case when place <= floor(total * 0.95) then 'train' else 'valid' end as split from training join ordered using (query))"""
_RUNS = "runs as (select run_id, query_id, rank_no, arg_max(doc_no, scored_at) as doc_no, max(bm25) as bm25, max(tfidf) as tfidf from candidates group by all)".replace("group by all", "group by run_id, query_id, rank_no")
_STOP = "('a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with')"
_STEM = "case when length(x) <= 3 then x when x like '%ies' then x[:-4] || 'y' when x like '%es' then x[:-3] when x like '%s' then x[:-2] when x like '%ing' then x[:-4] when x like '%ed' then x[:-3] else x end"


def _stems(c: str) -> str:
    return f"list_transform(list_filter({_ascii(c)}, lambda x: x not in {_STOP}), lambda x: {_STEM})"


def _set(c: str) -> str:
    return _ascii(f"replace({c}, '''', '')")


_LEGACY_PAIRS = f"""legacy as (select query_id, doc_id, list_distinct({_set('query')}) as qset, {_set('title')} as tset, {_set('body')} as bset, {_ascii('query')} as q, {_ascii('body')} as d, {_stems('query')} as qs_, {_stems('body')} as ds from pairs join qs using (query_id) join corpus using (doc_id))"""


def _among(q: str, d: str, n: int) -> str:
    return f"len(list_filter({_grams(d, n)}, lambda x: list_contains({_grams(q, n)}, x)))"


def _share(a: str, b: str) -> str:
    return f"case when {b} = 0 then -1 else round((({a})::float / ({b})::float)::double, 5) end"


ORACLE = {
    "corpus_documents": f"with {_CORPUS} select doc_id, len({_tokens('body')}) as body_tokens, nullif(regexp_extract(doc_id, '^[^_]+_(\\d{{2}})_', 1), '')::int as shard, row_number() over (order by doc_id) - 1 as doc_ord from corpus",
    "term_statistics": f"with {_CORPUS}, {_TOKENS}, {_TERMS} select term, df, ttf from terms",
    "collection_statistics": f"with {_CORPUS}, {_TOKENS}, {_STATS} select num_docs, doc_count, sum_ttf, round(average_length::double, 3) as average_length from stats",
    "document_text_features": f"with {_CORPUS}, f as (select doc_id, {_DOC_TEXT} from corpus) select doc_id, {_DOUBLES} from f",
    "document_feature_table": f"""with {_CORPUS}, {_QUERIES}, dict as (select distinct unnest({_words('lower(query)')}) as word from qs),
w as (select doc_id, 'tc' as kind, lower(unnest({_words('title')})) as word from corpus union all select doc_id, 'bc', lower(unnest({_words('body')})) from corpus
  union all select doc_id, 'r', unnest(regexp_extract_all(lower(title), '{_UNICODE}')) from corpus union all select doc_id, 'r', unnest(regexp_extract_all(lower(body), '{_UNICODE}')) from corpus),
c as (select doc_id, count(*) filter (kind = 'tc' and d.word is null) as tc, count(*) filter (kind = 'bc' and d.word is null) as bc, count(*) filter (kind = 'r' and d.word is null) as r, count(*) filter (kind = 'r') as a from w left join dict d using (word) group by doc_id),
f as (select doc_id, {_DOC_TEXT} from corpus)
select f.doc_id, {_DOUBLES}, coalesce(tc, 0)::double as doc_title_non_dictionary_count, coalesce(bc, 0)::double as doc_body_non_dictionary_count,
  case when coalesce(a, 0) = 0 then 0 else (r::float / a::float)::double end as doc_non_dictionary_ratio, coalesce(r, 0)::double as doc_non_dictionary_ratio_count from f left join c using (doc_id)""",
    "query_frequency_table": f"with {_QUERIES}, w as (select query_id, unnest(list_distinct(regexp_split_to_array(regexp_replace(lower(query), '{_JS}+$', ''), '{_JS}+'))) as word from qs) select word, count(*) as n from w group by word",
    "query_feature_table": rf"""with {_CORPUS}, {_QUERIES}, dict as (select distinct unnest({_words('lower(title)')}) as word from corpus),
freq as (select word, count(*) as n from (select query_id, unnest(list_distinct(regexp_split_to_array(regexp_replace(lower(query), '{_JS}+$', ''), '{_JS}+'))) as word from qs) group by word),
outside as (select query_id, count(*) as o from (select query_id, unnest(case when query = '' then [] when {_trim('query')} = '' then [''] else {_words('lower(query)')} end) as word from qs) w where not exists (select 1 from dict d where d.word = w.word) group by query_id),
rates as (select query_id, ln(1 + min(coalesce(n, 0)))::float as lo, ln(1 + max(coalesce(n, 0)))::float as hi, ln(1 + avg(coalesce(n, 0))::float::double)::float as mean from (select query_id, unnest(regexp_split_to_array(regexp_replace(lower(query), '{_JS}+$', ''), '{_JS}+')) as word from qs where {_trim('query')} <> '') left join freq using (word) group by query_id)
select query_id, len({_words('query')})::double as QueryWordCount, coalesce(o, 0)::double as QueryNonDictionaryCount, len(regexp_extract_all(query, '[aeiouAEIOU]'))::double as QueryVowelCount,
  len(regexp_extract_all(query, '[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]'))::double as QueryConsonantCount, {_special('query')}::double as QuerySpecialCharacterCount, {_numbers('query')}::double as QueryNumberCount,
  round(coalesce(lo, 0)::double, 5) as QueryMinLogFrequency, round(coalesce(hi, 0)::double, 5) as QueryMaxLogFrequency, round(coalesce(mean, 0)::double, 5) as QueryMeanLogFrequency from qs left join outside using (query_id) left join rates using (query_id)""",
    "pair_feature_table": f"with {_PAIR_ROWS}, v as ({_PAIR_VALUES}) select query_id, doc_id, round(bm25::double, 4) as BM25Score, round(tfidf::double, 4) as TFIDFScore, round(er::double, 4) as ExactMatchRatio, ec::double as ExactMatchCount, round(tr::double, 4) as TitleExactMatchRatio, tc::double as TitleExactMatchCount, b2::double as BigramCount, b3::double as TrigramCount, w4::double as UnorderedWindow4, w8::double as UnorderedWindow8 from v",
    "bm25_top10": f"{_RANKED} select query_id, doc_id, round(bm25::double, 4) as bm25, rank from ranked where rank <= 10",
    "bm25_top_scores": f"{_RANKED.replace(_CLEAN, 'query')} select qs.query_id, " + ", ".join(f"round(coalesce(max(bm25) filter (rank = {i}), 0)::double, 4) as BM25Top{i}Score" for i in (1, 2, 3)) + " from qs left join ranked using (query_id) group by qs.query_id",
    "bm25_candidates": f"{_RANKED} select query_id, doc_id, round(bm25::double, 4) as bm25, round(tfidf::double, 4) as tfidf, rank from ranked where rank <= 5000",
    "relevant_ranks": f"{_RANKED}, {_RELEVANT} select query_id, doc_id, coalesce(rank, 1201) as rank from relevant left join (select * from ranked where rank <= 1200) using (query_id, doc_id)",
    "compared_ranks": f"{_RANKED}, {_RELEVANT}, other as (select query_id, doc_id, row_number() over (partition by query_id order by tfidf desc, doc_id) as place from hits), both_ as (select query_id, doc_id, coalesce(case when rank < 3000 then rank end, 3000) as first_rank, coalesce(case when place < 3000 then place end, 3000) as second_rank from relevant left join ranked using (query_id, doc_id) left join other using (query_id, doc_id)) select *, first_rank - second_rank as difference from both_",
    "hard_negatives": f"""{_RANKED}, {_RELEVANT}, best as (select * from ranked where rank <= 5000), n as (select query_id, max(rank) as hits, case when max(rank) > 10 then 10 else 0 end as start from best group by query_id),
d as (select query_id, start + ('0x' || substring(md5('42|' || query_id || '|' || draw), 1, 12))::bigint % (hits - start) + 1 as rank from n cross join range(1, 11) r(draw))
select query_id, doc_id, rank - 1 as rank0 from d join best using (query_id, rank) where not exists (select 1 from relevant where relevant.query_id = d.query_id and relevant.doc_id = best.doc_id)""",
    "monomial_topk": f"with {_SEARCH}, {_SCORES} select doc_id, score, round(1 / (1 + exp(-score)), 9) as probability from scored where score > -0.25 order by greatest(0, score - -1.375)::float desc, doc_id limit 50",
    "monomial_first": f"with {_SEARCH}, {_SCORES} select doc_id, score from scored where score > 0 order by doc_id limit 20",
    "monomial_explained": f"with {_SEARCH}, {_SCORES}, a as (select doc_id, array_to_string(list_filter([case when bm25 > 1.5 and doc_word_count > 40 then '0' end, case when ec > 1 then '1' end, case when tr > 0.3::double and qn > 2 then '2' end, case when w8 > 0 then '3' end, case when doc_special_character_count > 60 then '4' end, case when doc_size_kbyte > 1.1 then '5' end], lambda x: x is not null), ',') as active from v join f using (doc_id)) select doc_id, score, active from scored join a using (doc_id)",
    "monomial_pairs": f"with {_PAIR_ROWS}, {_SCORES} select query_id, doc_id, score from scored where score > 0",
    "condition_check": f"with {_SEARCH}, {_SCORES}, x as (select unnest([{{'feature': 'BM25Score', 'border': 1.5::double, 'met': bm25 > 1.5}}, {{'feature': 'doc_word_count', 'border': 40.0, 'met': doc_word_count > 40}}, {{'feature': 'ExactMatchCount', 'border': 1.0, 'met': ec > 1}}, {{'feature': 'TitleExactMatchRatio', 'border': 0.3, 'met': tr > 0.3::double}}, {{'feature': 'UnorderedWindow8', 'border': 0.0, 'met': w8 > 0}}, {{'feature': 'doc_special_character_count', 'border': 60.0, 'met': doc_special_character_count > 60}}, {{'feature': 'doc_size_kbyte', 'border': 1.1, 'met': doc_size_kbyte > 1.1}}, {{'feature': 'doc_has_url', 'border': -1.0, 'met': doc_has_url > -1}}]) as x from v join f using (doc_id)) select x.feature as feature, x.border::double as border, count(*) filter (x.met) as met, 0::bigint as differing from x group by all",
    "dataset_split": f"with {_TRAINING} select source, label, query, doc_id, split from split",
    "dataset_manifest": f"with {_TRAINING} select source, split, count(*) as rows, count(distinct query) as queries, count(distinct doc_id) as documents from split group by source, split",
    "candidates_not_relevant": f"with {_QUERIES}, {_PAIRS}, {_RELEVANT} select query_id, count(*) as candidates from pairs anti join relevant using (query_id, doc_id) group by query_id",
    "query_cleaning": f"with {_QUERIES} select query_id, {_CLEAN} as cleaned, array_to_string({_tokens(_CLEAN)}, '|') as tokens, array_to_string({_stems('query')}, '|') as stems, array_to_string({_unique(_set('query'))}, '|') as word_set from qs",
    "shard_counts": "select nullif(regexp_extract(docid, '^[^_]+_(\\d{2})_', 1), '')::int as shard, count(*) as rows from docs group by 1",
    "sampled_evenly": f"with {_RUNS}, n as (select *, count(*) over (partition by run_id, query_id) as n, row_number() over (partition by run_id, query_id order by rank_no) - 1 as place from runs) select run_id, query_id, rank_no, doc_no from n where exists (select 1 from range(0, 5) r(i) where floor(i * greatest(n / 5.0::double, 1)) = place and i < n)",
    "sampled_head": f"with {_RUNS}, n as (select *, count(*) over (partition by run_id, query_id) as n, row_number() over (partition by run_id, query_id order by rank_no) as place from runs) select run_id, query_id, rank_no, doc_no from n where place <= greatest(1, least(n, round(n * 0.1)))",
    "best_query_per_document": "select doc_no as doc_id, query_id, round(bm25::double, 4) as bm25 from (select *, row_number() over (partition by doc_no order by bm25 desc, query_id) as place from candidates where bm25 is not null and not isnan(bm25)) where place = 1",
    "run_summary": f"with {_RUNS} select run_id, count(*) as rows, count(distinct query_id) as queries, count(*) filter (tfidf is null or isnan(tfidf)) as without_tfidf, round(avg(bm25::double), 6) as mean_bm25 from runs group by run_id",
    "legacy_document_table": f"with {_CORPUS} select doc_id, (len({_words('title')}) + len({_words('body')}))::double as legacy_doc_word_count, len(regexp_extract_all(body, '[aeiouAEIOU]'))::double as legacy_doc_vowel_count, ({_special('title')} + {_special('body')})::double as legacy_doc_special_character_count, {_paragraphs('body')}::double as legacy_doc_paragraph_count, {_numbers('title')}::double as legacy_doc_title_number_count, {_numbers('body')}::double as legacy_doc_body_number_count, (strlen(title || body)::float / 1024::float)::double as legacy_doc_size_kbyte, regexp_matches(title || ' ' || body, 'https?://|www\\.')::int::double as legacy_doc_has_url from corpus",
    "legacy_pair_table": f"""with {_CORPUS}, {_QUERIES}, {_PAIRS}, {_LEGACY_PAIRS} select query_id, doc_id, {_share('len(list_intersect(qset, tset))', 'len(qset)')} as legacy_title_match_ratio, len(list_intersect(qset, tset))::double as legacy_title_match_count,
{_share('len(list_intersect(qset, bset))', 'len(qset)')} as legacy_exact_match_ratio, len(list_intersect(qset, bset))::double as legacy_exact_match_count,
(case when len(q) = 0 then case when len(d) = 0 then 1 else 0 end else list_sum(list_transform(q, lambda x: len(list_filter(d, lambda y: y = x)))) end)::double as legacy_query_tf_sum,
{_among('q', 'd', 2)}::double as legacy_bigram_count, {_among('q', 'd', 3)}::double as legacy_trigram_count, {_among('qs_', 'ds', 2)}::double as legacy_stemmed_bigram_count, {_among('qs_', 'ds', 3)}::double as legacy_stemmed_trigram_count,
{_share(_among('qs_', 'ds', 2), 'len(ds)')} as legacy_stemmed_bigram_share, {_share(_among('qs_', 'ds', 3), 'len(ds)')} as legacy_stemmed_trigram_share from legacy""",
    "previews": rf"with {_CORPUS}, {_QUERIES}, {_RELEVANT}, p as (select query_id, doc_id, title, trim(regexp_replace(body, '{_JS}+', ' ', 'g')) as p from relevant join corpus using (doc_id)) select query_id, doc_id, title, case when length(p) > 80 then substring(p, 1, 80) || '…' else p end as preview from p",
}

_NOUNS = rf"len(list_filter(regexp_extract_all(lower(query), '[\p{{L}}\p{{M}}\p{{Nl}}\p{{No}}]+'), lambda w: regexp_full_match(w, '\p{{L}}+') and w not in ({', '.join(repr(w) for w in sorted(NO_NOUNS))}) and not regexp_matches(w, '({'|'.join(NO_NOUN_ENDS)})$')))::double"
ORACLE["query_feature_table_with_nouns"] = ORACLE["query_feature_table"].replace("as QueryNumberCount,", f"as QueryNumberCount, {_NOUNS} as QueryNounCount,")
_QUERY_NAMES = "QueryWordCount QueryNonDictionaryCount QueryVowelCount QueryConsonantCount QuerySpecialCharacterCount QueryNumberCount QueryNounCount QueryMinLogFrequency QueryMaxLogFrequency QueryMeanLogFrequency".split()
_ALL_NAMES = [*_QUERY_NAMES, *_DOC_NAMES, "doc_title_non_dictionary_count", "doc_body_non_dictionary_count", "doc_non_dictionary_ratio", "doc_non_dictionary_ratio_count", "BM25Score", "TFIDFScore", "ExactMatchRatio", "ExactMatchCount", "TitleExactMatchRatio", "TitleExactMatchCount", "BigramCount", "TrigramCount", "UnorderedWindow4", "UnorderedWindow8", "BM25Top1Score", "BM25Top2Score", "BM25Top3Score"]
_ALL_JOINED = f"""({ORACLE["pair_feature_table"]}) join ({ORACLE["query_feature_table_with_nouns"]}) using (query_id)
join ({ORACLE["bm25_top_scores"]}) using (query_id) join ({ORACLE["document_feature_table"]}) using (doc_id)"""
ORACLE["all_feature_table"] = f"""select query_id, doc_id, {", ".join(f'round({n}, {5 if "Log" in n else 4}) as {n}' for n in _ALL_NAMES)} from {_ALL_JOINED}"""
_RELEVANT_PAIRS = "pairs as (select distinct query_id, doc_id from (select query_id, unnest(relevant) as doc_id from qs))"
_ALL_RELEVANT = re.sub(r", [45]\) as ", ", 12) as ", _ALL_JOINED.replace(_PAIRS, _RELEVANT_PAIRS))  # values are compared, so digits are kept
_SPLITS = f"s as (select model_id, monomial_no, split_no, max(trained_coef) as trained_coef, {_trim('max(feature_name)')} as feature_name, max(border) as border from linear_monomials where upper(comparison) = 'GT' and model_id is not null and monomial_no is not null and split_no is not null group by model_id, monomial_no, split_no)"
_SIZES = f"sizes as (select model_id, monomial_no, count(*) as n, max(trained_coef) as c, count(*) filter (feature_name is null or feature_name not in ({', '.join(map(repr, _ALL_NAMES))})) as unknown from s group by all)"
ORACLE["model_table_scores"] = f"""with f as (select query_id, doc_id, {", ".join(f"{n}::double as {n}" for n in _ALL_NAMES)} from {_ALL_RELEVANT}), long as (unpivot f on {", ".join(_ALL_NAMES)} into name feature_name value value), {_SPLITS}, {_SIZES},
held as (select query_id, doc_id, s.model_id, s.monomial_no, count(*) as met from long join s using (feature_name) where value > border group by all)
select query_id, doc_id, held.model_id, round(sum(c), 6) as score from held join sizes using (model_id, monomial_no) where met = n and unknown = 0 group by all"""
ORACLE["model_table_rejected"] = f"with {_SPLITS}, {_SIZES} select model_id, monomial_no, unknown from sizes where unknown > 0"
_BORDERS = {"BM25Score": ("bm25", (0.0, 1.5)), "TFIDFScore": ("tfidf", (0.0, 4.0)), "TitleExactMatchCount": ("tc", (0.0,)), "BigramCount": ("b2", (0.0,)), "UnorderedWindow4": ("w4", (0.0,)), "UnorderedWindow8": ("w8", (0.0,))}
_COMPARED = "case c when 'GT' then value > border when 'LT' then value < border when 'GE' then value >= border else value <= border end"


def _struct(feature: str, value: str, border: float) -> str:
    return f"{{'feature': '{feature}', 'value': {value}::double, 'border': {border}::double}}"


def _compared(values: list[tuple[str, str, float]], source: str) -> str:
    return f"x as (select unnest([{', '.join(_struct(*v) for v in values)}]) as x from {source}), y as (select x.feature as feature, x.value as value, x.border as border, unnest(['GT', 'LT', 'GE', 'LE']) as c from x)"


ORACLE["feature_conditions"] = f"with {_SEARCH}, v as ({_PAIR_VALUES}), {_compared([(n, c, b) for n, (c, bs) in _BORDERS.items() for b in bs], 'v')} select feature, c as comparison, border, count(*) as documents from y where {_COMPARED} group by all"
_TOPS = ", ".join(f"coalesce(max(bm25) filter (rank = {i}), 0)::double as s{i}" for i in (1, 2, 3))
ORACLE["top_score_conditions"] = f"{_RANKED.replace(_CLEAN, 'query')}, tops as (select qs.query_id, {_TOPS} from qs left join ranked using (query_id) group by qs.query_id), {_compared([(f'BM25Top{i}Score', f's{i}', 2.5) for i in (1, 2, 3)], 'tops')} select feature, c as comparison, count(*) filter ({_COMPARED}) as queries from y group by all"
_CLASSIC = "classic as (select query_id, doc_id, sum(qtf * sqrt(tf) * idf * idf / sqrt(greatest(l, 1)))::float as classic from (select query_id, doc_id, qtf, tf, l, ln((num_docs + 1.0) / (df + 1.0)) + 1.0 as idf from pairs join qt using (query_id) join terms using (term) join tfs using (doc_id, term) join coded using (doc_id) cross join stats) group by all)"
_WHOLE = f"whole as (select query_id, doc_id, sum(qtf * c * {_TFIDF})::float as whole from (select query_id, doc_id, qtf, coalesce(df, 0) as df, num_docs, len(list_filter(t, lambda x: x = term)) + len(list_filter(tt, lambda x: x = term)) as c from pairs join qt using (query_id) join toks using (doc_id) left join terms using (term) cross join stats) group by all)"
ORACLE["legacy_score_table"] = f"with {_PAIR_ROWS}, {_CLASSIC}, {_WHOLE} select pairs.query_id, pairs.doc_id, round(coalesce(bm25, 0)::double, 3) as legacy_bm25, round(coalesce(classic, 0)::double, 3) as legacy_classic, round(coalesce(whole, 0)::double, 3) as legacy_tfidf from pairs join qs using (query_id) left join sums using (query_id, doc_id) left join classic using (query_id, doc_id) left join whole using (query_id, doc_id)"
_NOT_BLANK = ", ".join(f"case when {_trim('qs.query')} = '' then 0 else f.{n} end as legacy_{n}" for n in _QUERY_NAMES)
ORACLE["legacy_query_table"] = f"select f.query_id, {_NOT_BLANK} from ({ORACLE['query_feature_table_with_nouns']}) f join (select docno as query_id, coalesce(max(text_raw), '') as query from queries where docno is not null group by docno) qs using (query_id)"
ORACLE["legacy_dictionary_table"] = f"""with {_CORPUS}, {_QUERIES}, dict as (select distinct unnest({_words("lower(query)")}) as word from qs),
w as (select doc_id, 'tc' as kind, lower(unnest({_words("title")})) as word from corpus union all select doc_id, 'bc', lower(unnest({_words("body")})) from corpus union all select doc_id, 'r', unnest(regexp_extract_all(lower(title || ' ' || body), '{_UNICODE}')) from corpus),
c as (select doc_id, count(*) filter (kind = 'tc' and d.word is null) as tc, count(*) filter (kind = 'bc' and d.word is null) as bc, count(*) filter (kind = 'r' and d.word is null) as r, count(*) filter (kind = 'r') as a from w left join dict d using (word) group by doc_id)
select corpus.doc_id, coalesce(tc, 0)::double as legacy_title_non_dictionary_count, coalesce(bc, 0)::double as legacy_body_non_dictionary_count, case when coalesce(a, 0) = 0 then 0 else (r::float / a::float)::double end as legacy_non_dictionary_ratio, coalesce(r, 0)::double as legacy_non_dictionary_ratio_count from corpus left join c using (doc_id)"""
_BATCH = " join ".join(f"({ORACLE[n].replace(_PAIRS, _RELEVANT_PAIRS)})" + (" using (query_id, doc_id)" if i else "") for i, n in enumerate(("legacy_pair_table", "legacy_score_table", "relevant_ranks")))
ORACLE["legacy_batch_table"] = f"select query_id, doc_id, rank::bigint as legacy_rank, legacy_title_match_count, legacy_exact_match_count, legacy_query_tf_sum, legacy_bigram_count, legacy_bm25, legacy_classic from {_BATCH}"
_GRAM_WEIGHTS = f"""asked as (select query_id, q from q where len(list_distinct(q)) > 1), gs as (select query_id, 2 as n, unnest(list_distinct({_grams("q", 2)})) as gram from asked union all select query_id, 3, unnest(list_distinct({_grams("q", 3)})) from asked),
parts_ as (select n, gram, string_split(gram, ' ') as ts from (select distinct n, gram from gs)), dfs as (select n, gram, min(coalesce(df, 0)) as least, product(coalesce(df, 0)::float) as dfs from (select n, gram, unnest(ts) as term from parts_) left join terms using (term) group by all),
held as (select n, gram, count(*) as together from parts_ join toks on list_has_all(t, ts) group by all),
weights as (select n, gram, case when coalesce(together, 0) = 0 or least = 0 then 0 else greatest(0, ln(together * pow(num_docs, n - 1) / dfs)) end::float as weight from dfs left join held using (n, gram) cross join stats)"""
_GRAM_SUM = f"(select query_id, doc_id, sum(weight) filter (n = 2) as p2, sum(weight) filter (n = 3) as p3 from (select query_id, doc_id, 2 as n, unnest({_grams('t', 2)}) as gram from rows_ union all select query_id, doc_id, 3, unnest({_grams('t', 3)}) from rows_) join gs using (query_id, n, gram) join weights using (n, gram) group by all)"
ORACLE["legacy_window_table"] = f"with {_PAIR_ROWS}, {_GRAM_WEIGHTS}, v as (select query_id, doc_id, q, {_windows(5)} as w4, {_windows(9)} as w8 from rows_) select v.query_id, v.doc_id, round(coalesce(p2, 0)::float::double, 3) as legacy_bigram_pmi, round(coalesce(p3, 0)::float::double, 3) as legacy_trigram_pmi, case when len(list_distinct(q)) > 1 then w4 else 0 end::double as legacy_window4, case when len(list_distinct(q)) > 1 then w8 else 0 end::double as legacy_window8 from v left join {_GRAM_SUM} g using (query_id, doc_id)"
_WITH_TERM = f"pairs as (select distinct query_id, doc_id from (select query_id, unnest({_tokens('query')}) as term from qs) join tfs using (term))"
ORACLE["positional_table"] = f"with {_PAIR_ROWS.replace(_PAIRS, _WITH_TERM)}, v as ({_PAIR_VALUES}) select query_id, doc_id, b2::bigint as BigramCount, b3::bigint as TrigramCount, w4::bigint as UnorderedWindow4, w8::bigint as UnorderedWindow8 from v"
ORACLE["term_condition_counts"] = f"""with {_CORPUS}, {_TOKENS}, {_QUERIES}, {_PAIRS}, q as (select query_id, {_tokens('query')} as q from qs), r as (select query_id, len(list_distinct(q)) as n, len(list_intersect(q, t)) as m from pairs join q using (query_id) join toks using (doc_id))
select query_id, count(*) filter (n > 0 and m >= greatest(1, least(n, floor(n * 0.5) + 1))) as over_half, count(*) filter (n > 0 and m >= greatest(1, least(n, 2))) as over_one from r group by query_id"""
