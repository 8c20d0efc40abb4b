"""The opN queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_fm import repeated_words

    return repeated_words(documents(spark, sf_dir))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_bytes

    return repeated_bytes(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mkv import store_texts

    return store_texts(documents(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    from .seekable import token_files

    found = token_files(documents(spark, sf_dir), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import classified

    found = classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "lang", "n_predicted", "perplexity", "threshold", "keep")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bigru import identify

    return identify(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import audits, damaged

    return audits(*damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    from .pieces import encode_pieces

    return encode_pieces(documents(spark, sf_dir), public_tokenizers.path(model))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_substring, op3_suffix_array, op4_decontamination, op5_bpe, op6_media, op7_personal_data, op8_token_files, op9_quality, op10_language, op11_whitening, op12_conversations, op13_sentencepiece)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: DuckDB SQL for the operators that SQL can express in full.
ORACLES: dict[str, str] = {
    "op2_substring": r"""with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
h as (select doc_id, list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' '))) as hs from d where len(w) >= 20),
u as (select doc_id, unnest(hs) as g, generate_subscripts(hs, 1) as i from h),
e as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from u) q where k > 1),
c as (select distinct doc_id, i + j as spot from e, range(0, 20) as t(j)),
r as (select doc_id, list(spot) as gone from c group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed, sha256(array_to_string(list_filter(w, lambda x, k: not list_contains(coalesce(gone, []), k)), ' ')) as kept_sha256
from d left join r on d.doc_id = r.doc_id""",
    "op4_decontamination": f"""with d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) as w from documents),
b as (select item_id, w, least(10, len(w)) as n from (select item_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) as w from benchmark) q where len(w) > 0),
bw as (select distinct item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as g from b),
dn as (select doc_id, n, list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) as gs from d, (select distinct n from b) s where len(w) >= n),
dw as (select doc_id, n, unnest(gs) as g, generate_subscripts(gs, 1) as i from dn),
m as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
hit as (select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(i, i + n)) as spot from m) q group by doc_id),
its as (select doc_id, list_sort(list(distinct item_id::varchar)) as items from m group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(items), 0) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join its on d.doc_id = its.doc_id""",
    # Rows are edited one after another; nodes hold the least (cost, audit) of each state. At most two turns are inserted before a row: a third would come
    # back to a state. State 0: nothing yet, 1: a system turn, 2: the last turn is the user's, 3: the assistant's.
    "op12_conversations": r"""with recursive src as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
crc as (
    select list_transform(range(256), lambda b: list_reduce(list_prepend(b::ubigint, list_transform(range(8), lambda i: 0::ubigint)),
        lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) as t),
hit as (
    select src.*, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(k, ''), lambda c: unicode(c)::ubigint)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::int + 1])), 4294967295::ubigint) % 20 as f from src, crc),
damaged as (
    select conv_id, turn, case when f = 4 then 'user' else role end as role,
        case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when f = 3 then [1, 2] else [1] end) as copy
    from hit where f <> 0),
ordered as (
    select *, left(role, 1) as who, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body,
        row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
        row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth
    from damaged),
lines as (
    select *, case when body = '' then 'blank' when nth > 1 then 'duplicate' when right(body, 1) in ('.', '!', '?') then '' else 'truncated' end as fault,
        lag(who) over (partition by conv_id order by i) || who as pair
    from ordered),
sums as (
    select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
    from lines group by conv_id),
inserts(s, t, paid, letters, said) as (values
    (0, 0, 0, '', null), (1, 1, 0, '', null), (2, 2, 0, '', null), (3, 3, 0, '', null), (0, 2, 5, 'I', 'user:'), (1, 2, 5, 'I', 'user:'), (3, 2, 5, 'I', 'user:'),
    (2, 3, 5, 'I', 'assistant:'), (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:')),
edits(t, s, needs, role) as (values
    (0, 0, 'D', null), (1, 1, 'D', null), (2, 2, 'D', null), (3, 3, 'D', null), (0, 1, 's', null), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (3, 2, 'u', 'user'), (2, 3, 'a', 'assistant')),
nodes(conv_id, i, s, best) as (
    select distinct conv_id, 0::bigint, 0, {'cost': 0::bigint, 'audit': '', 'text': null::varchar} from src
    union all
    select n.conv_id, n.i + 1, e.s, min({
        'cost': n.best.cost + p.paid + case when e.needs = 'D' then 2 else (l.who <> e.needs)::bigint + 5 * (l.fault = 'truncated')::bigint end,
        'audit': n.best.audit || p.letters || case when e.needs = 'D' then 'D' when l.who = e.needs then 'K' else 'R' end,
        'text': nullif(concat_ws(chr(10), n.best.text, p.said, case when e.needs = 'D' then null when l.who = e.needs then l.role || ':' || l.text else e.role || ':' || l.text end), '')})
    from nodes n join lines l on l.conv_id is not distinct from n.conv_id and l.i = n.i + 1 join inserts p on p.s = n.s join edits e on e.t = p.t
    where e.needs = 'D' or (l.fault in ('', 'truncated') and (e.needs <> 's' or l.who = 's'))
    group by n.conv_id, n.i + 1, e.s),
ends as (
    select n.conv_id, min({'cost': n.best.cost + p.paid, 'audit': n.best.audit || p.letters, 'text': concat_ws(chr(10), n.best.text, p.said)}) as best
    from nodes n left join sums on sums.conv_id is not distinct from n.conv_id join inserts p on p.s = n.s
    where n.i = coalesce(sums.n, 0) and p.t in (0, 3) group by n.conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, e.best.cost as cost, e.best.audit as audit, sha256(coalesce(e.best.text, '')) as repaired_sha256
from ends e left join sums on sums.conv_id is not distinct from e.conv_id""",
}
