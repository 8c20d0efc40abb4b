"""Text, number, date and JSON expressions and feature columns (FN, PRJ and the feature catalogue)."""

from __future__ import annotations

from .dialect import both

PLANS = {
    # FN-02, FN-03, FN-11: normal form, words and hash.
    "normalised": "select doc_id, @size(@words(text)) as n_words, @sha(@norm(text)) as sha from documents where text is not null",
    # FN-04: sentences, lines and paragraphs.
    "text_units": r"select doc_id, @size(@keep(@split(text, '\\n'), trim(_x) != '')) as n_lines, @size(@keep(@split(text, '\\n\\n+'), trim(_x) != '')) as n_paragraphs, @count_hits(text, '[.!?]( |\\n|$)') as n_sentences from documents where text is not null",
    # FN-05: a guess of the language from stop words.
    "language_guess": "with t as (select doc_id, lang, @words(text) as w from documents where text is not null), s as (select doc_id, lang, @size(w) as n, @size(@keep(w, _x in ('the', 'of', 'and', 'in', 'to', 'a', 'was', 'that'))) as k from t) select doc_id, lang, case when n = 0 then 'en' when @real(k) / n >= 0.12 then 'en' else 'other' end as guess from s",
    # FN-06: edit distance of neighbours.
    "edit_distance": "select a.p_partkey, @edits(a.p_name, b.p_name) as distance from part a join part b on b.p_partkey = a.p_partkey + 1",
    # FN-07: weighted length, URLs counting 23.
    "weighted_length": r"select page_id, length(url) as n, 23 * @count_hits(url, 'https?://[^ ]+') + length(@replace(url, 'https?://[^ ]+', '')) as weighted from pages",
    # FN-08: identities taken out.
    "identity_stripped": r"select doc_id, @sha(trim(@replace(@replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', ' '), '@[A-Za-z0-9_]+', ' '))) as sha from documents where text is not null",
    # FN-09: numbers with k, m and b.
    "metric_numbers": "with t as (select s_suppkey, @text(s_suppkey) || @at(@list('', 'k', 'm', '.5k'), 1 + s_suppkey % 4) as raw from supplier) select s_suppkey, @big(round(@number(@replace(raw, '[kmb]', ''), double) * case when raw like '%k' then 1000 when raw like '%m' then 1000000 else 1 end)) as n from t".replace("@at(@list('', 'k', 'm', '.5k'), 1 + s_suppkey % 4)", "@at(@list('', 'k', 'm', '.5k'), cast(1 + s_suppkey % 4 as int))"),
    # FN-10: dates in the first format that fits.
    "dates": "with t as (select o_orderkey, case o_orderkey % 3 when 0 then '2024-03-15' when 1 then '15/03/2024' else 'soon' end as raw from orders) select o_orderkey, @parsed_date(raw) as day from t",
    # FN-13: syllables by vowel groups and the reading grade.
    "reading_grade": r"with t as (select doc_id, @size(@words(text)) as w, greatest(1, @count_hits(text, '[.!?]( |\\n|$)')) as s, @count_hits(lower(text), '[aeiouy]+') as y from documents where text is not null and lang = 'en') select doc_id, case when w > 0 then round(0.39 * w / s + 11.8 * y / w - 15.59, 1) end as grade from t",
    # FN-14, FN-15: counts of rule hits by scope: text and first line.
    "rule_hits": r"select doc_id, @count_hits(lower(text), '\\b(in today.s|game.changer|the)\\b') as in_text, @count_hits(lower(@at(@split(text, '\\n'), 1)), '\\b(the|of)\\b') as in_line1 from documents where text is not null",
    # FN-16: specifics.
    "specifics": r"select doc_id, @count_hits(text, '[0-9]+') as numbers, @count_hits(text, '[$€£] ?[0-9]') as money, @count_hits(text, '(January|February|March|April|May|June|July|August)') as months, @count_hits(text, '`[^`]+`') as code from documents where text is not null",
    # FN-17: hosts and platforms of links.
    "link_hosts": r"select page_id, @host(url) as host, case when @hit(@host(url), '(^|\\.)linkedin\\.com$') then 'linkedin' when @hit(@host(url), '(^|\\.)(x|twitter)\\.com$') then 'x' end as platform from pages",
    # FN-18: what stands above the fold.
    "fold": r"select doc_id, length(@at(@split(substring(text, 1, 140), '\\n'), 1)) as line1, @hit(substring(text, 1, 140), '[.!?:;,]( |\\n|$)') as boundary from documents where text is not null",
    # FN-19 (exact part): whole quotes of six words or more found in the text they are said to be from.
    "quotes": """with b as (select item_id, @norm(text) as quote, @at(@grams(@words(text), 6), 1) as gram from benchmark where @size(@words(text)) >= 6),
w as (select doc_id, @words(text) as w from documents where text is not null), g as (select distinct doc_id, gram from w @explode(@grams(w, 6), gram) where gram in (select gram from b))
select d.doc_id, b.item_id from g join b on g.gram = b.gram join documents d on d.doc_id = g.doc_id where contains(@norm(d.text), b.quote)""",
    # FN-21: wrapper tags neutralised.
    "escaped": r"select page_id, @sha(@replace(html, '<(/?)(post|candidate|context)', '<x')) as sha from pages",
    # FN-22: opaque tokens.
    "tokens": "select c_custkey, substring(@sha(c_name || '|' || @text(c_nationkey)), 1, 8) as token from customer",
    # FN-23: fixes that pull apart.
    "conflicts": "select a.doc_id, (@hit(lower(a.text), 'shorten|the') and @hit(lower(b.text), 'expand|of')) as conflict from documents a join documents b on b.doc_id = a.doc_id + 1 where a.text is not null and b.text is not null",
    # FN-24: rounding of ratios.
    "rounding": "select l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 7) as unit from lineitem",
    # FN-26: parts of ids.
    "id_parts": r"with t as (select conv_id, turn, 'r' || @text(turn) || '-w' || @text(conv_id) || '-li' as cid from conversations) select conv_id, turn, @extract(cid, '^r([0-9]+)-w([0-9]+)-(li|x1|x)$', 1) as round, @extract(cid, '^r([0-9]+)-w([0-9]+)-(li|x1|x)$', 3) as platform from t",
    # PRJ-06 (part): fields of JSON documents.
    "json_fields": "select event_id, @json(props, k) as k, props is null as empty from events",
    # PRJ-05: text statistics.
    "text_stats": r"select doc_id, length(text) as chars, @size(@words(text)) as words, @size(@split(text, '\\n')) as lines, @size(@keep(@split(text, '\\n'), trim(_x) = '')) as blank_lines from documents where text is not null",
    # PRJ-04: slugs of names.
    "slugs": "select c_custkey, case when @hit(@replace(lower(c_name), '[^a-z0-9]+', '-'), '^[0-9]') then 'author-' else '' end || @replace(lower(c_name), '[^a-z0-9]+', '-') as slug from customer",
    # ST-06: items that no longer item of their row holds.
    "dominance": "with t as (select p_type, @gather_set(lower(p_name)) as names from part group by p_type) select p_type, @size(names) as n, @size(@keep(names, not @any(names, length(_y) > length(_x) and contains(_y, _x)))) as kept from t",
    # 2.11.2: line, sentence, point-of-view, punctuation and symbol features.
    "features": r"""with t as (select doc_id, lang, text, @words(text) as w, length(text) as n from documents where text is not null and length(text) > 0)
select doc_id, round(1000.0 * @count_hits(text, '\\.') / n, 4) as period, round(1000.0 * @count_hits(text, ',') / n, 4) as comma, round(1000.0 * @count_hits(text, '!') / n, 4) as exclaim, round(1000.0 * @count_hits(text, '[?]') / n, 4) as question, round(1000.0 * @count_hits(text, ':') / n, 4) as colon,
@count_hits(text, '#[A-Za-z]') as hashtags, @count_hits(text, 'https?://') as urls, @count_hits(text, '→') as arrows, @size(@distinct(w)) as types, case when @size(w) > 0 then round(@real(@size(@distinct(w))) / @size(w), 4) end as ttr,
case when lang = 'en' and @size(w) > 0 then round(100.0 * @size(@keep(w, _x in ('i', 'me', 'my'))) / @size(w), 4) end as i_per_100, case when lang = 'en' and @size(w) > 0 then round(100.0 * @size(@keep(w, _x in ('you', 'your'))) / @size(w), 4) end as you_per_100 from t""",
    # 2.11.2: relative frequencies of function words in long form.
    "function_words": "with t as (select doc_id, @words(text) as w from documents where text is not null and lang = 'en'), e as (select doc_id, @size(w) as n, word from t @explode(w, word)) select doc_id, word, round(@real(count(*)) / max(n), 5) as freq from e where word in ('the', 'of', 'and', 'in', 'to', 'that', 'was') group by doc_id, word",
    # 2.11.1 P1-P6, P18-P20: platform checks as columns.
    "platform_checks": r"select doc_id, length(text) <= 3000 as p1_length, @size(@words(text)) >= 8 as p_min_words, @count_hits(text, '#[A-Za-z]') <= 3 as p3_hashtags, not @hit(text, 'https?://') as p4_links, not @hit(text, '\\*\\*|^#|\\n#') as p5_markup, @count_hits(lower(text), '\\b(maybe|perhaps|possibly)\\b') < 3 as p18_hedges from documents where text is not null",
    # AG-02 and the relational shapes: revenue by nation and part brand.
    "star_join": "select n.n_name, p.p_brand, count(*) as n, @real(sum(cast(l.l_extendedprice * (1 - l.l_discount) as decimal(18, 4)))) as revenue from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join part p on l.l_partkey = p.p_partkey where p.p_size > 40 group by n.n_name, p.p_brand",
}

QUERIES, ORACLES = both(PLANS)
