"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import ann, bpe, chat, licenses, mil, mixing, neardup, packing, perplexity, pii, trie, urls, whitening
from verdigris.llm.common import read_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_personal_data(read_table(spark, sf_dir, "documents", "doc_id", "text")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(read_table(spark, sf_dir, "pages", "page_id", "url"), urls.RULES, urls.labelled_urls())
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)
    return bpe.digest_columns(bpe.decode_documents(encoded.select("doc_id", "ids"), path))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chat.as_transcript(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    hmm = chat.fit_hmm(lines.filter(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 != 2))
    return chat.render_turns(chat.label_lines(lines.select("conv_id", "turn", "line", "text"), hmm))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    model = mil.fit_quality(mil.training_rows(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality")))
    scored = mil.score_quality(docs, model)
    out = F.coalesce(mil.held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= mil.PREDICT_FROM).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge_documents(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_trie(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_minhash": op2_minhash,
    "op3_urls": op3_urls,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_chat": op6_chat,
    "op7_ann": op7_ann,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_perplexity": op10_perplexity,
    "op11_whitening": op11_whitening,
    "op12_trie": op12_trie,
    "op13_licenses": op13_licenses,
}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP2_SQL = rf"""with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') w from documents),
 s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) sh from t),
 n as (select t.doc_id, count(s.sh) n from t left join s using (doc_id) group by t.doc_id),
 p as (select a.doc_id a, b.doc_id b, count(*) m from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
 l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 85 * (x.n + y.n - m)),
 e as (select a, b from l union all select b, a from l),
 c as (select doc_id, doc_id c from n union select e.b, c.c from c join e on e.a = c.doc_id)
 select n.doc_id, any_value(n.n) n_shingles, min(c.c) component_id, n.doc_id = min(c.c) kept from n join c using (doc_id) group by n.doc_id"""

_CORRECT = """g{n} as (select source, any_value(target) - sum(size * passes) gap from c{m} group by source),
 b{n} as (select source, key, size, i, change from (select c.source, key, size, i, sign(gap)::int change, row_number() over (partition by c.source order by abs(abs(gap) - size), u, key, size, sign(gap) * passes, sign(gap) * i) rn
  from c{m} c join g{n} g on c.source is not distinct from g.source where size > 0 and abs(abs(gap) - size) < abs(gap) and case when gap > 0 then passes < 3 else passes > 0 end) where rn = 1),
 c{n} as (select c.* exclude (passes), passes + coalesce(change, 0) passes from c{m} c left join b{n} b on c.source is not distinct from b.source and c.key is not distinct from b.key and c.size = b.size and c.i = b.i)"""
OP5_SQL = rf"""with d as (select doc_id as key, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
 k as (select *, ('0x' || substr(md5(concat_ws('-', '7', key, size)), 1, 13))::bigint u, row_number() over (partition by key, source, size) - 1 i from d),
 s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) rk from d group by source),
 w as (select *, (1 + (rk - 1) % 3)::double weight, case (rk - 1) % 3 when 0 then 0.6::double when 1 then 0::double else -0.6::double end slope, 3 * source_size::double cap from s),
 x as (select *, (sum(source_size) over () - coalesce(sum(cap) over o, 0)) / (sum(weight) over () - coalesce(sum(weight) over o, 0)) lvl from w window o as (order by cap / weight, rk rows between unbounded preceding and 1 preceding)),
 y as (select *, cap < lvl * weight capped from x),
 t as (select source, source_size, slope, case when capped then cap else weight * (select arg_min(lvl, cap / weight + rk * 0) from y where not capped) end target from y),
 p as (select k.*, t.* exclude (source), coalesce(sum(size) over (partition by k.source order by u, key nulls first, size, i rows between unbounded preceding and 1 preceding), 0) st from k join t on k.source is not distinct from t.source),
 c0 as (select *, (case when size > 0 then (st + size / 2 <= target)::int + (st + size / 2 + source_size <= target)::int + (st + size / 2 + 2 * source_size <= target)::int else 0 end) passes from p),
 {_CORRECT.format(n=1, m=0)},
 {_CORRECT.format(n=2, m=1)},
 z as (select *, least(st / target, 1) yy from c2)
 select key doc_id, size, source_size, target, size * passes taken, case when passes > 0 then round(2 * yy / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * yy)), 9) end as position from z"""

# crc32 byte by byte: eight shifts each, by the reversed polynomial
_CRC = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint)),
  lambda a, y: list_reduce(list_prepend(xor(a, y), list_transform(range(8), lambda i: 0::ubigint)), lambda z, i: case when z & 1 = 1 then xor(z >> 1, 3988292384::ubigint) else z >> 1 end)), 4294967295::ubigint)"""
OP12_SQL = f"""with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 j from conversations where conv_id is not null),
 n as (select conv_id, count(*) n from o group by conv_id),
 c as (select conv_id, n, conv_id - conv_id % 5 base, ({_CRC} % 9)::bigint h from n),
 r as (select c.conv_id, j pos, role, text from c join o on o.conv_id = c.base and j < h
  union all select c.conv_id, least(h, coalesce(b.n, 0)) + j - h, role, text from o join c using (conv_id) left join n b on b.conv_id = c.base where j >= h),
 t as (select c.conv_id, coalesce(list(sha256(length(role) || ':' || role || text) order by pos) filter (pos is not null), []) t, list(strlen(text) order by pos) b from c left join r using (conv_id) group by c.conv_id),
 p as (select conv_id, d, md5(array_to_string(t[1:d], ',')) k, md5(array_to_string(t[1:d - 1], ',')) above, d = len(t) ends, case when d > 0 then b[d] else 0 end bytes from (select *, unnest(range(len(t) + 1)) d from t)),
 v as (select d, k, min(conv_id) conv_id, any_value(above) above, count(*) n_convs, any_value(bytes) bytes, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) ends_sha256 from p group by d, k),
 f as (select d - 1 d, above k, count(*) n_children from v where d > 0 group by all),
 y as (select v.*, coalesce(n_children, 0) n_children from v left join f using (d, k)),
 s as (select p.d, p.k, count(*) filter (n_children = 0) n_leaves, sum((n_convs - 1) * y.bytes) saved_tokens from y join p on p.conv_id = y.conv_id and p.d <= y.d group by p.d, p.k)
 select y.conv_id, y.d depth, u.conv_id parent_conv_id, y.n_convs, y.n_children, n_leaves, saved_tokens::bigint saved_tokens, y.ends_sha256
 from y join s using (d, k) left join v u on u.d = y.d - 1 and u.k = y.above"""

ORACLES: dict[str, str] = {"op2_minhash": OP2_SQL, "op5_mixing": OP5_SQL, "op12_trie": OP12_SQL}
