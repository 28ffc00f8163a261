"""Registered queries over the driver's tables, with equivalent DuckDB SQL where SQL can express them.

`events` stands in for results of two runs (user = task, parity of event_id = side, errors fail, signups have no verdict),
`documents` and `benchmark` for a corpus and its questions, `labels` for two raters, `lineitem` for model usage, `conversations` for transcripts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import calculator, parsing, scoring, tables, text
from verdigris.operators import bootstrap, index, judging, negatives, pairing, quality, retrieval, sampling, similarity
from verdigris.operators import statistics as st
from verdigris.sources.scratch import Scratch
from verdigris.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED, RESAMPLES = 7, 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c, name):
    return F.round(c, 6).alias(name)


# --- runs and their comparison


def runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "events").select(F.col("user_id").alias("task_id"), (F.col("event_id") % 2).alias("side"), F.when(F.col("event_type") == "error", F.lit(False)).when(F.col("event_type") == "signup", F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("success"), F.col("event_id").alias("repeat"))
    return rows.filter("side = 0"), rows.filter("side = 1")


def deltas(spark: SparkSession, d: str) -> DataFrame:
    return pairing.deltas(pairing.paired(*runs(spark, d)))


ALL = """smp as (select user_id task_id, event_id % 2 side, case event_type when 'error' then cast(0 as double) when 'signup' then null else cast(1 as double) end ok, event_id from events),
 m as (select task_id, avg(case when side=0 then ok end) base, avg(case when side=1 then ok end) cand from smp group by task_id),
 d as (select cast(row_number() over (order by task_id) as bigint)-1 k, task_id, cand-base d from m where base is not null and cand is not null)"""
BOOT = f"""n as (select count(*) n from d),
 r as (select b.b, ('0x'||substr(md5('{SEED}-'||b.b||'-'||d.k),1,8))::BIGINT % (select n from n) k from (select unnest(range({RESAMPLES})) b) b cross join d),
 x as (select r.b, avg(d.d) m from r join d on d.k = r.k group by r.b)"""


@query(f"with {ALL} select task_id, 0 side, round(base,6) m from m where exists (select 1 from smp where smp.task_id=m.task_id and side=0) union all select task_id, 1, round(cand,6) from m where exists (select 1 from smp where smp.task_id=m.task_id and side=1)")
def q_task_means(spark, d):
    base, cand = (pairing.task_means(r).withColumn("side", F.lit(i)) for i, r in enumerate(runs(spark, d)))
    return base.unionByName(cand).select("task_id", "side", r6("m", "m"))


@query(f"with {ALL} select task_id, round(base,6) base, round(cand,6) cand, round(cand-base,6) d from m")
def q_paired_deltas(spark, d):
    return pairing.paired(*runs(spark, d)).select("task_id", r6("base", "base"), r6("cand", "cand"), r6("d", "d"))


@query(f"with {ALL} select task_id from m where base is null or cand is null")
def q_dropped_tasks(spark, d):
    return pairing.dropped(pairing.paired(*runs(spark, d)))


@query(f"with {ALL}, {BOOT} select round((select avg(d) from d),6) point, round(quantile_cont(m,0.025),6) lo, round(quantile_cont(m,0.975),6) hi from x")
def q_bootstrap_ci(spark, d):
    rows = deltas(spark, d)
    boot = st.resample_means(rows, RESAMPLES, SEED, "task_id", "d").agg(*st.quantiles("m"))
    return rows.agg(F.avg("d").alias("point")).crossJoin(boot).select(r6("point", "point"), r6("lo", "lo"), r6("hi", "hi"))


BUNDLE = f"""with {ALL}, {BOOT}, a as (select count(*) n, avg(d) delta, coalesce(stddev_samp(d),0) sd from d), q as (select quantile_cont(m,0.025) lo, quantile_cont(m,0.975) hi, avg(case when m<0 then 1.0 else 0.0 end) p_neg from x)
 select n, round(delta,6) delta, round(sd,6) sd, round(lo,6) lo, round(hi,6) hi, round(hi,6) upper, round(p_neg,6) p_neg, round({st.Z975 + st.Z80!r}*sd/sqrt(n),6) mde"""
TAIL = " from a cross join q"


def bundle(spark, d):
    return st.paired_bootstrap(deltas(spark, d), RESAMPLES, SEED)


BUNDLE_COLUMNS = ("delta", "sd", "lo", "hi", "upper", "p_neg", "mde")


@query(BUNDLE + TAIL)
def q_paired_bootstrap(spark, d):
    return bundle(spark, d).select("n", *(r6(c, c) for c in BUNDLE_COLUMNS))


@query(BUNDLE + ", case when delta*100 <= -2+1e-9 then case when hi<0 then 'block' else 'warn' end else 'pass' end verdict" + TAIL)
def q_gate_verdict(spark, d):
    return bundle(spark, d).select("n", *(r6(c, c) for c in BUNDLE_COLUMNS), st.gate(F.col("delta"), F.col("upper")).alias("verdict"))


TAGS = f"""with {ALL}, tags as (select distinct user_id task_id, event_type tag from events union select distinct user_id, 'h'||(hour(ts)%6) from events),
 td as (select tag, d.task_id, d.d, cast(row_number() over (partition by tag order by d.task_id) as bigint)-1 k, count(*) over (partition by tag) n from tags join d on d.task_id=tags.task_id)"""


def tags_of(spark, d):
    e = table(spark, d, "events")
    t = e.select(F.col("user_id").alias("task_id"), F.explode(F.array("event_type", F.concat(F.lit("h"), F.hour("ts") % 6))).alias("tag"))
    return t.groupBy("task_id").agg(F.collect_set("tag").alias("tags"))


@query(TAGS + " select tag, count(*) n, round(avg(d),6) delta from td group by tag")
def q_tag_deltas(spark, d):
    rows = pairing.tag_deltas(pairing.paired(*runs(spark, d)), tags_of(spark, d))
    return rows.groupBy("tag").agg(F.count("*").alias("n"), r6(F.avg("d"), "delta"))


@query(
    TAGS
    + f""", r as (select tag, b.b, ('0x'||substr(md5('{SEED}-'||b.b||'-'||td.k),1,8))::BIGINT % n k from td cross join (select unnest(range(300)) b) b),
 x as (select r.tag, r.b, avg(td.d) m from r join td on td.tag=r.tag and td.k=r.k group by r.tag, r.b),
 s as (select tag, quantile_cont(m,0.025) lo, quantile_cont(m,0.975) hi, avg(case when m>=0 then 1.0 else 0.0 end) p from x group by tag),
 a as (select tag, count(*) n, avg(d) delta from td group by tag), j as (select a.*, lo, hi, p, row_number() over (order by p, a.tag) rk, count(*) over () m from a join s on s.tag=a.tag),
 k as (select max(case when p <= 0.05*rk/m then rk end) k from j)
 select tag, n, round(delta,6) delta, round(lo,6) lo, round(hi,6) hi, round(p,6) p, coalesce(rk <= (select k from k), false) and delta < 0 flagged from j"""
)
def q_per_tag_bh(spark, d):
    rows = pairing.tag_deltas(pairing.paired(*runs(spark, d)), tags_of(spark, d))
    return st.per_tag(rows, 300, SEED).select("tag", "n", r6("delta", "delta"), r6("lo", "lo"), r6("hi", "hi"), r6("p", "p"), "flagged")


@query(f"with {ALL}, w as (select task_id, base, cand, cand-base d from m where base is not null and cand is not null order by cand-base, task_id limit 5) select task_id, round(base,6) base, round(cand,6) cand, round(d,6) d, (select min_by('e'||event_id, event_id) from smp where smp.task_id=w.task_id and side=1 and coalesce(ok,0)<>1) trace_id from w where d < 0")
def q_worst5(spark, d):
    base, cand = runs(spark, d)
    traced = cand.withColumn("trace_id", F.concat(F.lit("e"), F.col("repeat")))
    return pairing.worst(pairing.paired(base, cand), 5, traced).select("task_id", r6("base", "base"), r6("cand", "cand"), r6("d", "d"), "trace_id")


@query("select round(avg(case when event_type='error' then 1.0 else 0.0 end),6) fraction from events")
def q_judge_error_fraction(spark, d):
    rows = table(spark, d, "events").select((F.col("event_type") == "error").alias("judge_error"))
    return pairing.judge_error_fraction(rows).select(r6("fraction", "fraction"))


@query("with v as (select user_id, case when avg(value) > 45 then 'block' else 'pass' end verdict from events group by user_id) select count(*) runs, round(avg(case when verdict='block' then 1.0 else 0.0 end),6) rate, avg(case when verdict='block' then 1.0 else 0.0 end) <= 0.05 passed from v")
def q_false_block_rate(spark, d):
    v = table(spark, d, "events").groupBy("user_id").agg(F.when(F.avg("value") > 45, "block").otherwise("pass").alias("verdict"))
    return st.false_block_rate(v).select("runs", r6("rate", "rate"), "passed")


@query("with c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_extendedprice/1e6*50 cost from lineitem), s as (select *, coalesce(sum(cost) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding),0) spent from c) select l_orderkey, l_linenumber, round(spent,8) spent, spent >= 4 refused from s")
def q_running_cost_cap(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_extendedprice") / 1e6 * 50).alias("cost"))
    return pairing.running_cost(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "cost", 4.0).select("l_orderkey", "l_linenumber", F.round("spent", 8).alias("spent"), "refused")


@query(
    """with h as (select user_id, date_trunc('hour', ts) hr, count(*) calls, sum(coalesce(value,0)) cost from events where ts is not null and user_id is not null group by all),
 s as (select *, case when hr - lag(hr) over (partition by user_id order by hr) > interval 24 hour then 1 else 0 end fresh from h),
 g as (select *, sum(fresh) over (partition by user_id order by hr) g from s),
 t as (select *, coalesce(sum(cost) over (partition by user_id, g order by hr rows between unbounded preceding and 1 preceding),0) b from g)
 select user_id::varchar run_id, strftime(hr, '%Y-%m-%d %H') as "hour", calls, round(b,6) spent_before, round(b+cost,6) spent, round(b,6) >= 100 refused from t where hr + interval 1 hour <= (select max(ts) - interval 2 hour from events)"""
)
def q_hourly_cap(spark, d):
    """The spending of each user by hour, as a stream settles it: hours that the watermark has passed."""
    scratch = Scratch(spark, "hourly")
    # a pattern of one name, as a stream's path is a folder or a pattern
    arriving = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    calls = arriving.select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("cost"))
    with live.rocksdb(spark):
        live.append_once(live.hourly_spending(calls, 100.0), f"{scratch.root}/settled", f"{scratch.root}/progress")
    settled = live.appended(spark, f"{scratch.root}/settled", live.SETTLED)
    return settled.select("run_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "calls", r6("spent_before", "spent_before"), r6("spent", "spent"), (F.round("spent_before", 6) >= 100).alias("refused"))


# --- the bootstrap by Poisson counts

LO_HI = "round(quantile_cont({0},0.025),6) lo, round(quantile_cont({0},0.975),6) hi"


@query(f"with {ALL}, {bootstrap.counts_sql('d', 'task_id', RESAMPLES, SEED)}, x as (select b, sum(c*d)/sum(c) m from w group by b) select (select count(*) from d) n, round((select avg(d) from d),6) mean, {LO_HI.format('m')}, round(avg(case when m<0 then 1.0 else 0.0 end),6) p_neg from x")
def q_poisson_mean(spark, d):
    return bootstrap.mean_ci(deltas(spark, d), "d", "task_id", RESAMPLES, SEED).select("n", *(r6(c, c) for c in ("mean", "lo", "hi", "p_neg")))


@query(
    TAGS
    + f""", {bootstrap.counts_sql("(select tag, task_id, d from td)", "task_id", 300, SEED)}, x as (select tag, b, sum(c*d)/sum(c) m from w group by all having sum(c) > 0),
 s as (select tag, quantile_cont(m,0.025) lo, quantile_cont(m,0.975) hi, 1 - avg(case when m<0 then 1.0 else 0.0 end) p from x group by tag),
 j as (select a.*, lo, hi, p, row_number() over (order by p, a.tag) rk, count(*) over () m from (select tag, count(*) n, avg(d) delta from td group by tag) a join s on s.tag=a.tag),
 k as (select max(case when p <= 0.05*rk/m then rk end) k from j)
 select tag, n, round(delta,6) delta, round(lo,6) lo, round(hi,6) hi, round(p,6) p, coalesce(rk <= (select k from k), false) and delta < 0 flagged from j"""
)
def q_poisson_per_tag(spark, d):
    rows = pairing.tag_deltas(pairing.paired(*runs(spark, d)), tags_of(spark, d))
    return bootstrap.per_tag(rows, 300, SEED).select("tag", "n", r6("delta", "delta"), r6("lo", "lo"), r6("hi", "hi"), r6("p", "p"), "flagged")


# --- retrieval

BM25 = """with toks as (select doc_id, regexp_extract_all(lower(text),'[a-z0-9]+') t from documents),
 sz as (select count(*)::double n_docs, coalesce(sum(len(t)),0)/greatest(count(*),1) avg_len from toks),
 post as (select doc_id, len, term, count(*) tf from (select doc_id, len(t) len, unnest(t) term from toks) group by all),
 df as (select term, count(*) df from post group by term),
 q as (select item_id query_id, unnest(regexp_extract_all(lower(text),'[a-z0-9]+')) term from benchmark),
 qq as (select query_id, term, count(*) times from q group by all),
 s as (select query_id, doc_id, sum(times*ln(1+(n_docs-df+0.5)/(df+0.5))*tf*2.5/(tf+1.5*(1-0.75+0.75*len/avg_len))) score from qq join df using(term) cross join sz join post using(term) group by all),
 k as (select *, row_number() over (partition by query_id order by round(score,9) desc, doc_id) rank from s where score>0)"""


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25(spark, d):
    docs = table(spark, d, "documents")
    return index.kept(docs, "doc_id", "text").search(questions(spark, d)), docs.select("doc_id", F.col("text").alias("body"))


@query(BM25 + " select query_id, rank, doc_id, round(score,6) score from k where rank<=5")
def q_bm25_topk(spark, d):
    return bm25(spark, d)[0].select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", r6("score", "score"))


@query(BM25 + " select query_id, rank, doc_id, round(score,6) score from k where rank<=5")
def q_search_table(spark, d):
    """Search in SQL text: a table function over a question's blocks in each segment of the documents, then the best of all segments."""
    tables.register(spark)
    blocks = tables.question_blocks(index.kept(table(spark, d, "documents"), "doc_id", "text"), questions(spark, d), 5)
    return spark.sql(
        """with hits as (select * from search_docs(table(select * from {blocks}) partition by (query_id, block), 5)),
        ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from hits)
        select query_id, cast(rank as bigint) as rank, doc_id, round(score, 6) as score from ranked where rank <= 5""",
        blocks=blocks,
    )


@query(
    BM25
    + r""", h as (select k.query_id, k.doc_id, d.text body, b.text query from k join documents d on d.doc_id=k.doc_id join benchmark b on b.item_id=k.query_id where rank=1),
 p as (select query_id, doc_id, query, unnest(string_split(body, chr(10))) p, generate_subscripts(string_split(body, chr(10)),1) i from h),
 o as (select *, len(list_intersect(list_distinct(regexp_extract_all(lower(p),'[a-z0-9]+')), list_distinct(regexp_extract_all(lower(query),'[a-z0-9]+')))) o from p),
 f as (select *, row_number() over (partition by query_id order by o desc, i) rn from o)
 select query_id, doc_id, substr(trim(regexp_replace(p,'[\s\p{Z}]+',' ','g')),1,200) snippet from f where rn=1"""
)
def q_snippet(spark, d):
    hits, docs = bm25(spark, d)
    top = hits.filter("rank = 1").join(questions(spark, d), "query_id").join(docs, "doc_id")
    return top.select("query_id", "doc_id", retrieval.snippet(F.col("body"), F.col("query"), "\n").alias("snippet"))


@query("with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) rn from orders where o_orderdate <= timestamp '1998-01-01') select o_custkey, o_orderkey from r where rn=1")
def q_as_of(spark, d):
    rows = table(spark, d, "orders")
    return retrieval.current(rows, "o_custkey", "o_orderdate", F.lit("1998-01-01").cast("timestamp"), [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("with o as (select o_orderkey::varchar doc_id, strftime(o_orderdate,'%Y-%m-%d') effective_date, case when o_orderkey % 7 = 0 then (o_orderkey-1)::varchar end supersedes from orders), l as (select * from o where effective_date <= '1996-01-01') select doc_id from l where doc_id not in (select supersedes from l where supersedes is not null)")
def q_effective_documents(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_date"), F.when(F.col("o_orderkey") % 7 == 0, (F.col("o_orderkey") - 1).cast("string")).alias("supersedes"))
    return retrieval.effective(o, "1996-01-01").select("doc_id")


@query("with a as (select distinct l_orderkey*3 k from lineitem) select k::varchar doc_id, coalesce(o_orderpriority, 'error: no document '||k) as text from a left join orders on o_orderkey=k")
def q_get_documents(spark, d):
    asked = table(spark, d, "lineitem").select((F.col("l_orderkey") * 3).cast("string").alias("doc_id")).distinct()
    docs = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("text"))
    return retrieval.get_documents(asked, docs)


@query("with a as (select distinct l_orderkey*3 k from lineitem) select k::varchar doc_id, coalesce(o_orderpriority, 'error: no document '||k) as text from a left join orders on o_orderkey=k")
def q_get_doc_table(spark, d):
    """The same in SQL text: documents and requests dealt by id to a table function."""
    tables.register(spark)
    return spark.sql(
        """select doc_id, text from get_doc(table(
            select cast(o_orderkey as string) as doc_id, o_orderpriority as text, false as asked from {orders}
            union all select distinct cast(l_orderkey * 3 as string), cast(null as string), true from {lineitem}) partition by doc_id order by asked)""",
        orders=table(spark, d, "orders"),
        lineitem=table(spark, d, "lineitem"),
    )


@query(
    r"""with n as (select doc_id, doc_id % 2 side, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')),'[^\p{L}\p{N}_\s\p{Z}]','','g'),'[\s\p{Z}]+',' ','g')) n from documents),
 c as (select doc_id, side, n, string_split(n, '') c from n),
 g as (select distinct doc_id, side, unnest(case when length(n) < 5 then [n] else list_transform(generate_series(1, len(c) - 4), lambda i: c[i]||c[i+1]||c[i+2]||c[i+3]||c[i+4]) end) gram from c),
 r as (select *, count(*) over (partition by doc_id) k, count(*) over (partition by gram) f from g),
 p as (select doc_id, side, gram, k from (select *, row_number() over (partition by doc_id order by f, gram) rn from r where f > 0) where rn <= k - ceil(0.8 * k - 1e-9) + 1),
 x as (select distinct a.doc_id a, b.doc_id b, a.k ka, b.k kb from p a join p b using (gram) where a.side = 0 and b.side = 1 and least(a.k, b.k) >= 0.8 * greatest(a.k, b.k) - 1e-9),
 i as (select a, b, ka, kb, count(*) m from x join g u on u.doc_id = a join g v on v.doc_id = b and v.gram = u.gram group by all)
 select a, b, round(m / (ka + kb - m), 6) jaccard from i where m / (ka + kb - m) >= 0.8"""
)
def q_near_dup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return similarity.near_duplicates(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "doc_id", "text").select("a", "b", r6("jaccard", "jaccard"))


# --- checks of data

LANGS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.10, "it": 0.05}


@query("with w(lang, share) as (values ('en',0.55::double),('de',0.15),('fr',0.15),('es',0.10),('it',0.05)), h as (select lang, count(*) c from documents group by lang) select w.lang, coalesce(c,0) have, round_even(share*300,0)::bigint want, abs(coalesce(c,0)-round_even(share*300,0)) > 10 off from w left join h using(lang)")
def q_quota_check(spark, d):
    return quality.mix_report(table(spark, d, "documents"), "lang", LANGS, 300, 10)


@query("select o_custkey, count(*) n from orders group by o_custkey having count(*)>1")
def q_duplicate_ids(spark, d):
    return quality.duplicates(table(spark, d, "orders"), "o_custkey")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def q_fk_violations(spark, d):
    return quality.orphans(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "doc_id")


@query("with t as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by event_id) rn from events) select event_id, user_id, event_type from t where rn=1")
def q_first_occurrence(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.concat_ws("/", "user_id", "event_type"))
    return sampling.first_per(rows, "k", [F.col("event_id")], 1).select("event_id", "user_id", "event_type")


@query("with t as (select event_id, event_type, row_number() over (partition by event_type order by event_id) rn from events) select event_id, event_type from t where rn<=20")
def q_first_n_per_type(spark, d):
    return sampling.first_per(table(spark, d, "events"), "event_type", [F.col("event_id")], 20).select("event_id", "event_type")


@query("select doc_id from (select doc_id, row_number() over (order by md5('11-'||doc_id), doc_id) rn from labels) where rn <= (select round_even(0.2*count(*),0) from labels)")
def q_seeded_sample(spark, d):
    return sampling.sample(table(spark, d, "labels"), 0.2, 11, "doc_id").select("doc_id")


PICK = "list_position(list_transform(s, lambda x, i: {0}), list_max(list_transform(s, lambda x, i: {0})))"
MORE, LESS = PICK.format("case when a[i] < x then x - a[i] else -1 end"), PICK.format("case when a[i] > f[i] then a[i] else -1 end")


@query(
    f"""with recursive r as (select doc_id, lang, quality, row_number() over (partition by lang, quality order by md5('11-'||doc_id), doc_id) rn from documents join labels using(doc_id)),
 c as (select lang, quality, count(*) s from r group by all),
 o as (select list(lang order by lang nulls first, quality nulls first) l, list(quality order by lang nulls first, quality nulls first) q, list(s order by lang nulls first, quality nulls first) s, sum(s)::bigint t from c),
 p(l, q, s, f, n, a) as (select l, q, s, list_transform(s, lambda x: least(3, x)), least(60, t), list_transform(s, lambda x: least(x, greatest(3, round_even(least(60, t)*x/t, 0)::bigint))) from o
  union all select l, q, s, f, n, list_transform(a, lambda x, i: x + case when list_sum(a) > n then -(i = {LESS})::int else (i = {MORE})::int end) from p where list_sum(a) <> n),
 k as (select unnest(l) lang, unnest(q) quality, unnest(a) take from p where list_sum(a) = n)
 select doc_id, r.lang, r.quality from r join k on r.lang is not distinct from k.lang and r.quality is not distinct from k.quality where rn <= take"""
)
def q_stratified_sample(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return sampling.stratified_sample(rows, ["lang", "quality"], 60, 3, 11, "doc_id").select("doc_id", "lang", "quality")


@query("select lang, count(*) n, round(sum(1-quality)/count(*),6) rate, round((p+z*z/(2*n)) / (1+z*z/n) - z*sqrt(p*(1-p)/n+z*z/(4*n*n))/(1+z*z/n),6) lo, round((p+z*z/(2*n)) / (1+z*z/n) + z*sqrt(p*(1-p)/n+z*z/(4*n*n))/(1+z*z/n),6) hi from (select lang, quality, count(*) over (partition by lang)::double n, avg(1-quality) over (partition by lang)::double p, 1.959963984540054::double z from labels join documents using(doc_id)) group by lang, n, p, z".replace("count(*) n,", "n::bigint n,"))
def q_noise_floor(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    v = rows.select(F.col("lang").alias("split"), F.when(F.col("quality") == 1, "ok").otherwise("fixed").alias("verdict"))
    return quality.noise_floor(v).select(F.col("split").alias("lang"), "n", r6("rate", "rate"), r6("lo", "lo"), r6("hi", "hi"))


# --- agreement and bias

RATERS = "select quality=1 pred, toxic=0 truth, doc_id from labels"
COUNTS = f"with p as ({RATERS}), c as (select count_if(not pred and not truth)::double tn, count_if(pred and not truth)::double fp, count_if(not pred and truth)::double fn, count_if(pred and truth)::double tp from p), m as (select *, tn+fp+fn+tp n, (tp+tn)/(tn+fp+fn+tp) raw, (tp+fp)/(tn+fp+fn+tp) a, (tp+fn)/(tn+fp+fn+tp) b from c)"


def raters(spark, d):
    return table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("pred"), (F.col("toxic") == 0).alias("truth"))


@query(COUNTS + " select round(raw,6) raw, round((raw-(a*b+(1-a)*(1-b)))/(1-(a*b+(1-a)*(1-b))),6) kappa, round((raw-2*((a+b)/2)*(1-(a+b)/2))/(1-2*((a+b)/2)*(1-(a+b)/2)),6) ac1, round(2*raw-1,6) pabak, round(tp/(tp+fp),6) as precision, round(tp/(tp+fn),6) recall from m")
def q_agreement(spark, d):
    return st.agreement(raters(spark, d)).select(*(r6(c, c) for c in st.metrics()))


@query(f"with p as ({RATERS}) select count_if(not pred and not truth)::bigint tn, count_if(pred and not truth)::bigint fp, count_if(not pred and truth)::bigint fn, count_if(pred and truth)::bigint tp from p")
def q_confusion(spark, d):
    return st.agreement(raters(spark, d)).select("tn", "fp", "fn", "tp")


@query(
    f"""with p as ({RATERS}), k as (select cast(row_number() over (order by doc_id) as bigint)-1 k, count(*) over () n, pred, truth from p),
 r as (select b.b, ('0x'||substr(md5('{SEED}-'||b.b||'-'||k.k),1,8))::BIGINT % n k from k cross join (select unnest(range(200)) b) b),
 c as (select b, count_if(not pred and not truth)::double tn, count_if(pred and not truth)::double fp, count_if(not pred and truth)::double fn, count_if(pred and truth)::double tp from r join k using(k) group by b),
 m as (select *, (tp+tn)/(tn+fp+fn+tp) raw, (tp+fp)/(tn+fp+fn+tp) a, (tp+fn)/(tn+fp+fn+tp) t from c),
 x as (select (raw-(a*t+(1-a)*(1-t)))/(1-(a*t+(1-a)*(1-t))) kappa from m)
 select round(quantile_cont(kappa,0.025),6) lo, round(quantile_cont(kappa,0.975),6) hi from x"""
)
def q_kappa_ci(spark, d):
    return st.agreement_report(raters(spark, d), 200, SEED, "doc_id").filter("metric = 'kappa'").select(r6("lo", "lo"), r6("hi", "hi"))


METRICS = {"raw": "raw", "kappa": "(raw-(a*t+(1-a)*(1-t)))/(1-(a*t+(1-a)*(1-t)))", "ac1": "(raw-2*((a+t)/2)*(1-(a+t)/2))/(1-2*((a+t)/2)*(1-(a+t)/2))", "pabak": "2*raw-1", "precision": "tp/(tp+fp)", "recall": "tp/(tp+fn)"}


@query(
    f"""with p as ({RATERS}), {bootstrap.counts_sql("p", "doc_id", 200, SEED)},
 q as (select b, sum(c) filter (not pred and not truth) tn, sum(c) filter (pred and not truth) fp, sum(c) filter (not pred and truth) fn, sum(c) filter (pred and truth) tp from w group by b),
 z as (select coalesce(tn,0)::double tn, coalesce(fp,0)::double fp, coalesce(fn,0)::double fn, coalesce(tp,0)::double tp from q),
 m as (select *, (tp+tn)/(tn+fp+fn+tp) raw, (tp+fp)/(tn+fp+fn+tp) a, (tp+fn)/(tn+fp+fn+tp) t from z),
 u as ({" union all ".join(f"select '{n}' metric, {e} x from m" for n, e in METRICS.items())})
 select metric, {LO_HI.format("x")} from u where x is not null and not isnan(x) group by metric"""
)
def q_poisson_agreement(spark, d):
    return bootstrap.agreement_ci(raters(spark, d), "doc_id", 200, SEED).select("metric", r6("lo", "lo"), r6("hi", "hi"))


LENGTHS = "select doc_id, source g, ln(n_chars) x, quality::double y from documents join labels using(doc_id)"


def lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("g"), F.log("n_chars").alias("x")).join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("y"), F.col("toxic").alias("t")), "doc_id")


SUMS = "sum(n) n, sum(sx) sx, sum(sy) sy, sum(sxy) sxy, sum(sxx) sxx"
SLOPE = "(n*sxy-sx*sy)/(n*sxx-sx*sx)"


@query(
    f"""with l as ({LENGTHS}), s as (select g, cast(row_number() over (order by g) as bigint)-1 k, count(*) over () gs, count(*)::double n, sum(x) sx, sum(y) sy, sum(x*y) sxy, sum(x*x) sxx from l group by g),
 r as (select b.b, ('0x'||substr(md5('{SEED}-'||b.b||'-'||s.k),1,8))::BIGINT % gs k from s cross join (select unnest(range(500)) b) b),
 t as (select b, {SUMS} from r join s using(k) group by b), x as (select {SLOPE} s from t), p as (select {SLOPE} slope from (select {SUMS} from s))
 select round((select slope from p),6) slope, round(quantile_cont(s,0.025),6) lo, round(quantile_cont(s,0.975),6) hi from x"""
)
def q_slope_cluster(spark, d):
    return st.slope_ci(lengths(spark, d), 500, SEED).select(r6("slope", "slope"), r6("lo", "lo"), r6("hi", "hi"))


@query(
    f"""with l as (select * from ({LENGTHS}) where g is not null and x is not null and y is not null), {bootstrap.counts_sql("l", "g", 500, SEED)},
 t as (select b, sum(c)::double n, sum(c*x) sx, sum(c*y) sy, sum(c*x*y) sxy, sum(c*x*x) sxx from w group by b), x as (select case when n*sxx-sx*sx <> 0 then {SLOPE} end s from t)
 select round((select regr_slope(y,x) from l),6) slope, {LO_HI.format("s")} from x"""
)
def q_poisson_slope(spark, d):
    return bootstrap.slope_ci(lengths(spark, d), 500, SEED).select(r6("slope", "slope"), r6("lo", "lo"), r6("hi", "hi"))


@query(
    f"""with l as (select doc_id, ln(n_chars) x, quality::double y, toxic g from documents join labels using(doc_id)), {bootstrap.counts_sql("l", "doc_id", 200, SEED)},
 s as (select b, g, sum(c)::double n, sum(c*x) sx, sum(c*y) sy, sum(c*x*y) sxy, sum(c*x*x) sxx, sum(c*y*y) syy from w group by b, g having sum(c) > 0),
 t as (select b, sum(sxy-sx*sy/n) xy, sum(sxx-sx*sx/n) xx, sum(syy-sy*sy/n) yy from s group by b), r as (select case when xx>1e-9 and yy>1e-9 then xy/sqrt(xx*yy) else 0 end r from t)
 select {LO_HI.format("r")} from r"""
)
def q_poisson_partial_corr(spark, d):
    return bootstrap.partial_correlation_ci(lengths(spark, d), "x", "y", "t", "doc_id", 200, SEED).select(r6("lo", "lo"), r6("hi", "hi"))


@query("with l as (select ln(n_chars) x, quality::double y, toxic g from documents join labels using(doc_id)), c as (select x-avg(x) over (partition by g) x, y-avg(y) over (partition by g) y from l) select round(coalesce(sum(x*y)/nullif(sqrt(sum(x*x)*sum(y*y)),0),0),6) partial_corr from c")
def q_partial_corr(spark, d):
    return st.partial_correlation(lengths(spark, d), "x", "y", "t").select(r6("partial_corr", "partial_corr"))


@query("select doc_id, round(ln(length(text||' and more words follow here')::double/nullif(length(text),0))/ln(1.5),6) x from documents")
def q_length_x(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(text.length_x(F.concat("text", F.lit(" and more words follow here")), F.col("text")), "x"))


# --- scores

CASES = """select conv_id, turn, case conv_id % 9 when 0 then 'timeout' when 1 then 'error' else 'ok' end status, case turn % 4 when 0 then 'lookup' when 1 then 'unanswerable' when 2 then 'arithmetic' else 'multi_hop' end kind,
 case when turn % 4 = 1 then 'abstain' when turn % 3 = 0 then 'free_text' else 'numeric' end answer_kind, length(text) % 2 = 0 hit, case length(text) % 3 when 0 then null else (length(text)%3-1)/1.0 end recall,
 length(text) % 7 = 0 abstained, length(text) % 11 = 0 judge_error, length(text) % 5 < 4 correct, length(text) % 13 > 1 faithful, length(text) % 17 = 0 unjudged from conversations"""


def cases(spark, d):
    n, t = F.length("text"), F.col("turn")
    status = F.when(F.col("conv_id") % 9 == 0, "timeout").when(F.col("conv_id") % 9 == 1, "error").otherwise("ok")
    kind = F.when(t % 4 == 0, "lookup").when(t % 4 == 1, "unanswerable").when(t % 4 == 2, "arithmetic").otherwise("multi_hop")
    answer = F.when(t % 4 == 1, "abstain").when(t % 3 == 0, "free_text").otherwise("numeric")
    judge = F.when(n % 17 != 0, F.struct((n % 5 < 4).alias("correct"), (n % 13 > 1).alias("faithful")))
    return table(spark, d, "conversations").select("conv_id", "turn", status.alias("status"), kind.alias("kind"), answer.alias("answer_kind"), (n % 2 == 0).alias("hit"), F.when(n % 3 != 0, (n % 3 - 1).cast("double")).alias("recall"), (n % 7 == 0).alias("abstained"), (n % 11 == 0).alias("judge_error"), judge.alias("judge"))


@query(f"with c as ({CASES}) select conv_id, turn, case when status<>'ok' then false when kind='unanswerable' then abstained when abstained then false when answer_kind='free_text' and (judge_error or unjudged) then null when answer_kind='free_text' then correct and faithful and coalesce(recall,0)>0 else hit and coalesce(recall,0)>0 end success from c")
def q_success_rule(spark, d):
    c = cases(spark, d)
    return c.select("conv_id", "turn", scoring.task_success(F.col("status"), F.col("kind"), F.col("answer_kind"), F.col("hit"), F.col("recall"), F.col("abstained"), F.col("judge_error"), F.col("judge")).alias("success"))


@query("select conv_id, turn, case when conv_id%10=0 then 'error' when conv_id%10=1 then 'timeout' when conv_id%10=2 or length(text)%40 > 20 then 'limit' when turn%3=0 then 'format_error' else 'ok' end status from conversations")
def q_sample_status(spark, d):
    k = F.col("conv_id") % 10
    status = scoring.sample_status(F.when(k == 0, "x"), F.when(k == 1, "time").when(k == 2, "message"), F.length("text") % 40, F.when(F.col("turn") % 3 != 0, "y"), 20)
    return table(spark, d, "conversations").select("conv_id", "turn", status.alias("status"))


@query("with s as (select l_orderkey k, list_distinct(list(l_partkey%7)) cited, list_distinct(list(l_suppkey%5)) gold from lineitem group by l_orderkey), h as (select *, len(list_intersect(list_intersect(cited,gold),[0,1,2,3])) hits from s) select k, round(hits::double/nullif(len(cited),0),6) as precision, round(hits::double/nullif(len(gold),0),6) recall from h")
def q_citation_pr(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list((F.col("l_partkey") % 7).cast("long")).alias("cited"), F.collect_list((F.col("l_suppkey") % 5).cast("long")).alias("gold"))
    c = parsing.citation_scores(F.col("cited"), F.col("gold"), F.array(*(F.lit(i).cast("long") for i in range(4))))
    return rows.select("k", r6(c["precision"], "precision"), r6(c["recall"], "recall"))


@query(r"select doc_id, try_cast(replace(regexp_extract(replace(replace(replace(text,'$',''),'€',''),'£',''), '-?[0-9][0-9,]*(?:\.[0-9]+)?'),',','') as double) number from documents")
def q_first_number(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_number(F.col("text")).alias("number"))


@query("select p_partkey, abs(p_retailprice - (p_retailprice + (p_partkey%13-6)*0.002*p_retailprice)) <= greatest(0.005*abs(p_retailprice),0.01) ok from (select p_partkey, round(p_retailprice,2) p_retailprice from part)")
def q_numeric_match(spark, d):
    p = table(spark, d, "part").withColumn("ref", F.round("p_retailprice", 2))
    answer = F.concat(F.lit("It is $"), F.col("ref") + (F.col("p_partkey") % 13 - 6) * 0.002 * F.col("ref"), F.lit(" in all"))
    return p.select("p_partkey", text.match_answer(answer, F.col("ref").cast("string"), F.lit("numeric")).alias("ok"))


@query("select a.p_partkey, lower(a.p_name)=lower(b.p_name) ok from part a join part b on b.p_partkey = a.p_partkey - a.p_partkey%2")
def q_exact_match(spark, d):
    p = table(spark, d, "part")
    b = p.select((F.col("p_partkey")).alias("k"), F.upper("p_name").alias("ref"))
    return p.join(b, F.col("k") == F.col("p_partkey") - F.col("p_partkey") % 2).select("p_partkey", text.match_answer(F.concat(F.col("p_name"), F.lit(" ! ")), F.col("ref"), F.lit("exact")).alias("ok"))


@query("select doc_id, sha256(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ')) folded from documents")
def q_casefold(spark, d):
    """Case folding of whole texts; the languages of these tables have no other letters that lower case leaves."""
    return table(spark, d, "documents").select("doc_id", F.sha2(text.fold(F.col("text")).cast("binary"), 256).alias("folded"))


@query(r"select doc_id, array_to_string(list_sort(list_transform(regexp_extract_all(text,'[A-Z]{2,3}-[0-9]{3}|[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x,',',''))),' ') signature from documents")
def q_facts_signature(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.facts_signature(F.col("text")), " ").alias("signature"))


@query("select doc_id, len(regexp_extract_all(lower(text),'[a-z0-9]+'))::bigint n_tokens from documents")
def q_tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"select doc_id, md5(trim(regexp_replace(regexp_replace(lower(text),'[^\p{L}\p{N}_\s\p{Z}]','','g'),'[\s\p{Z}]+',' ','g'))) norm_md5 from documents")
def q_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize(F.col("text")).cast("binary")).alias("norm_md5"))


@query("select doc_id, 'sha256:'||sha256(text) hash from documents")
def q_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sha256(F.col("text")).alias("hash"))


# --- usage and cost

PRICES = [("R", 1.0, 5.0), ("N", 0.25, 1.25), ("default", 2.0, 8.0)]


@query("with p(m,i,o) as (values ('R',1.0::double,5.0::double),('N',0.25,1.25)) select l_returnflag model, round(sum(l_partkey*coalesce(i,2.0)+l_suppkey*coalesce(o,8.0))/1e6,6) cost_usd, sum(l_partkey)::bigint tokens_in, sum(l_suppkey)::bigint tokens_out from lineitem left join p on m=l_returnflag group by l_returnflag")
def q_cost_by_model(spark, d):
    usage = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.sum("l_partkey").alias("tokens_in"), F.sum("l_suppkey").alias("tokens_out"))
    prices = spark.createDataFrame(PRICES, "model string, input double, output double")
    return scoring.priced(usage, prices).select("model", r6("cost_usd", "cost_usd"), "tokens_in", "tokens_out")


# --- transcripts


def transcripts(spark, d):
    none = F.lit(None).cast("map<string,string>")
    call = F.struct(F.when(F.col("turn") % 3 == 0, "get_doc").otherwise("search_docs").alias("function"), F.when(F.col("turn") % 3 == 0, F.create_map(F.lit("doc_id"), F.concat(F.lit("D"), (F.length("text") % 4).cast("string")))).otherwise(none).alias("arguments"))
    m = F.struct("turn", F.when(F.col("role") == "system", "tool").otherwise(F.col("role")).alias("role"), F.array(call).alias("tool_calls"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m.alias("m")), lambda a, b: (a["turn"] - b["turn"]).cast("int")).alias("messages"))


@query("select conv_id, coalesce(string_agg(distinct 'D'||(length(text)%4), ',' order by 'D'||(length(text)%4)) filter (where turn%3=0),'') ids from conversations group by conv_id")
def q_fetched_ids(spark, d):
    return transcripts(spark, d).select("conv_id", F.array_join(F.array_sort(parsing.fetched_documents(F.col("messages"))), ",").alias("ids"))


@query("select conv_id, count_if(role='system')::bigint n_tools from conversations group by conv_id")
def q_tool_calls(spark, d):
    return transcripts(spark, d).select("conv_id", parsing.tool_messages(F.col("messages")).cast("long").alias("n_tools"))


@query("select conv_id, turn, case when turn%4=3 then null else 'D'||conv_id end answer, case when turn%4<>3 then turn%2=0 end abstain from conversations")
def q_parse_final(spark, d):
    t = F.col("turn")
    body = F.format_string('{"answer": "D%s", "citations": [], "abstain": %s}', F.col("conv_id"), F.when(t % 2 == 0, "true").otherwise("false"))
    body = F.when(t % 4 == 3, F.concat(F.substring_index(body, "}", 1), F.lit(', "more": 1}'))).otherwise(body)
    said = F.concat(F.lit('FINAL: {"answer": "old", "citations": [], "abstain": false}\nwords\n'), F.lit("FINAL: "), body, F.lit("\n"))
    f = parsing.parse_final(said)
    return table(spark, d, "conversations").select("conv_id", "turn", f["answer"].alias("answer"), f["abstain"].alias("abstain"))


@query("select conv_id, turn, case when turn%3<>2 then turn%2=0 end correct from conversations")
def q_parse_verdict(spark, d):
    t = F.col("turn")
    said = F.concat(F.lit("I think {"), F.format_string('"correct": %s, "faithful": true, "reason": "r"', F.when(t % 3 == 2, '"yes"').when(t % 2 == 0, "true").otherwise("false")), F.lit("} so."))
    return table(spark, d, "conversations").select("conv_id", "turn", parsing.parse_verdict(said)["correct"].alias("correct"))


@query("select o_orderkey, o_orderstatus verdict from orders")
def q_marker_round_trip(spark, d):
    m = parsing.marker(head_sha=F.col("o_orderkey").cast("string"), verdict=F.col("o_orderstatus"), run_id=F.lit("r"))
    read = parsing.parse_marker(F.concat(F.lit("text\n"), m, F.lit("\nmore")))
    return table(spark, d, "orders").select(read["head_sha"].cast("long").alias("o_orderkey"), read["verdict"].alias("verdict"))


# --- calibration


@query("with k as (select event_id, user_id example, event_type, row_number() over (partition by user_id order by event_id desc) rn from events), v as (select example, event_type <> 'error' pred from k where rn=1 and event_type<>'signup') select doc_id, pred, quality=1 truth from labels join v on example = doc_id")
def q_labels_with_verdicts(spark, d):
    key = table(spark, d, "events").select(F.col("user_id").alias("example_id"), F.col("event_id").alias("ord"), F.when(F.col("event_type") != "signup", F.col("event_type") != "error").alias("judge_pass"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("example_id"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("human_label"))
    return judging.labelled_verdicts(labels, key).select(F.col("example_id").alias("doc_id"), "pred", "truth")


def examples(spark, d):
    p = table(spark, d, "part")
    ref = F.concat(F.col("p_size").cast("string"), F.lit("; "), F.col("p_brand"))
    answer = F.concat(F.lit("It holds "), F.col("p_size").cast("string"), F.lit(" units; it is "), F.col("p_type"))
    return p.select(F.col("p_partkey").cast("string").alias("example_id"), ref.alias("reference"), answer.alias("answer"), F.array(F.lit("PRD-001")).alias("citations"), F.lit(None).cast("string").alias("synthetic"))


def no_docs(spark):
    return spark.createDataFrame([], "id string, text string, body string")


@query("select p_partkey||'~wrong_number' example_id, 'It holds '||(p_size+7)||' units; it is '||p_type answer from part")
def q_corrupt_number(spark, d):
    return judging.corrupted(examples(spark, d), no_docs(spark), "wrong_number", "").select("example_id", "answer")


@query("select p_partkey||'~dropped_fact' example_id, 'It holds '||p_size||' units' answer from part")
def q_corrupt_fact(spark, d):
    return judging.corrupted(examples(spark, d), no_docs(spark), "dropped_fact", "").select("example_id", "answer")


# Patterns of a fact, as in DuckDB.
FACTS_SQL = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Z]{{2,3}}-[0-9]{{3}}|[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')))"


def cited_examples(spark, d):
    """Answers about parts that cite a document by its id, and documents as a corpus."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("text").alias("body"))
    return examples(spark, d).withColumn("citations", F.array((F.col("example_id").cast("long") % 100).cast("string"))), docs


@query(
    f"""with ex as (select p_partkey::varchar example_id, (p_partkey % 100)::varchar cited, {FACTS_SQL.format("'It holds '||p_size||' units; it is '||p_type")} mine from part),
 docs as (select doc_id::varchar doc, {FACTS_SQL.format('text')} sig from documents where text is not null),
 {negatives.drawn_sql('ex', 'example_id', 'docs', 'doc', 'doc <> cited and not list_has_any(mine, sig)', 7)}
 select example_id||'~wrong_citation' example_id, doc citation from drawn"""
)
def q_wrong_citation(spark, d):
    rows, docs = cited_examples(spark, d)
    return judging.corrupted(rows, docs.filter("text is not null"), "wrong_citation", "", 7).select("example_id", F.col("citations")[0].alias("citation"))


@query(
    f"""with ex as (select p_partkey::varchar example_id, (p_partkey % 100)::varchar cited, coalesce(text, '') told, 'It holds '||p_size||' units; it is '||p_type answer from part left join documents on doc_id = p_partkey % 100),
 ln as (select doc_id::varchar doc, string_split(text, chr(10)) l from documents), un as (select doc, trim(unnest(l), ' ') claim, generate_subscripts(l, 1) i from ln),
 docs as (select doc, claim, doc||'#'||lpad((row_number() over (partition by doc order by i) - 1)::varchar, 9, '0') place from un where claim <> '' and not (starts_with(claim, '#') or starts_with(claim, 'This document') or starts_with(claim, 'Related documents') or starts_with(claim, 'Acme '))),
 {negatives.drawn_sql('ex', 'example_id', 'docs', 'place', 'doc <> cited and not contains(told, claim)', 7)}
 select example_id||'~unsupported_claim' example_id, answer||' '||claim answer from drawn"""
)
def q_unsupported_claim(spark, d):
    rows, docs = cited_examples(spark, d)
    return judging.corrupted(rows, docs, "unsupported_claim", "Acme ", 7).select("example_id", "answer")


@query("select p_partkey::varchar example_id, count(*) n from part cross join (values (0.5),(1.0)) group by p_partkey")
def q_pad(spark, d):
    """Two padded forms of every answer that reach their length."""
    rows = judging.perturbations(examples(spark, d)).join(examples(spark, d).select("example_id", "answer"), "example_id")
    return rows.filter(F.col("text").startswith(F.col("answer")) & (F.col("x") >= 0.99)).groupBy("example_id").agg(F.count("*").alias("n"))


# --- power


def grid(spark):
    return spark.range(1).select(F.explode(F.array(*(F.lit(float(x)) for x in (-8, -7, -6, -5, 0)))).alias("true_delta")).crossJoin(spark.createDataFrame([(0.28, 149), (0.45, 300)], "sd double, n long"))  # ten rows


PHI = "0.5*(1+(case when z<0 then -1 else 1 end)*(1-(t*(0.254829592+t*(-0.284496736+t*(1.421413741+t*(-1.453152027+t*1.061405429)))))*exp(-z*z/2)))"


@query(f"with g as (select d::double true_delta, sd::double sd, n from (values (-8),(-7),(-6),(-5),(0)) a(d) cross join (values (0.28,149),(0.45,300)) b(sd,n)), z as (select *, (-greatest(0.02, {st.Z975!r}*sd/sqrt(n)) - true_delta/100)/(sd/sqrt(n)) z from g), t as (select *, 1/(1+0.3275911*abs(z)/sqrt(2)) t from z) select true_delta, sd, n::bigint n, round({PHI},6) p from t")
def q_power_analytic(spark, d):
    return grid(spark).select("true_delta", "sd", "n", r6(st.analytic_block(F.col("true_delta"), F.col("sd"), F.col("n")), "p"))


@query(f"select sd::double sd, n::bigint n, round({st.Z975 + st.Z80!r}*sd/sqrt(n),6) mde from (values (0.28,149),(0.45,300)) b(sd,n)")
def q_mde(spark, d):
    return grid(spark).select("sd", "n", r6(st.mde(F.col("sd"), F.col("n")), "mde")).distinct()


@query()
def q_power_mc(spark, d):
    return st.power_table(st.simulated(spark, [-8, -5, 0], 0.28, 149, 200, 300))


@query("select p_partkey, case when p_size % 5 = 0 then 'error: division by zero' else format('{:.10g}', p_size * (p_partkey + 2) - round(p_retailprice, 2) / (p_size % 5)) end answer from part")
def q_safe_eval(spark, d):
    p = table(spark, d, "part")
    text_ = F.format_string("%s * (%s + 2) - %s / %s", "p_size", "p_partkey", F.round("p_retailprice", 2).cast("string"), F.col("p_size") % 5)
    return p.select("p_partkey", calculator.calculate(text_).alias("answer"))


@query("select p_partkey, case when p_size % 5 = 0 then null else format('{:.10g}', p_size * (p_partkey + 2) - round(p_retailprice, 2) / (p_size % 5)) end as value, case when p_size % 5 = 0 then 'division by zero' end as error from part")
def q_calculate_table(spark, d):
    tables.register(spark)
    return spark.sql(
        """select p_partkey, value, error from {part}, lateral calculate(concat(p_size, ' * (', p_partkey, ' + 2) - ', cast(round(p_retailprice, 2) as string), ' / ', p_size % 5))""",
        part=table(spark, d, "part"),
    )


@query("select n_name, rpad(repeat('█', least(greatest(floor(n_nationkey/25.0*20),0),20)::int),20,'░') bar from nation")
def q_bar(spark, d):
    return table(spark, d, "nation").select("n_name", text.bar(F.col("n_nationkey") / 25).alias("bar"))


# --- projections, predicates and the rest of the inventory


@query("select 'PRC-'||lpad((p_partkey%1000)::varchar,3,'0') id, 'pricing' kind from part")
def q_kind_of(spark, d):
    ident = F.concat(F.lit("PRC-"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))
    return table(spark, d, "part").select(ident.alias("id"), text.kind_of(ident).alias("kind"))


@query("select n_name, lower(string_split(n_name,' ')[1]) family from nation")
def q_model_family(spark, d):
    model = F.concat(F.lit("vendor/"), F.regexp_replace("n_name", " ", "-"), F.lit("-4-5"))
    return table(spark, d, "nation").select("n_name", text.model_family(model).alias("family"))


@query("select p_partkey, '# '||p_name||chr(10)||chr(10)||'Holds '||p_size||' units.' body from part")
def q_render_document(spark, d):
    from verdigris.sources.files import render_documents

    p = table(spark, d, "part")
    fact = F.struct(F.lit(0).alias("ord"), F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value"), F.lit("Holds {value} units.").alias("text"))
    docs = p.select("p_partkey", F.concat(F.lit("PRD-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.lit("2024-01-01").alias("effective_date"), F.lit(None).cast("string").alias("supersedes"), F.array(fact).alias("facts"), F.array().cast("array<string>").alias("refs"))
    lines = F.filter(F.split("text", "\n"), lambda x: (x != "") & (F.startswith(x, F.lit("# ")) | F.startswith(x, F.lit("Holds "))))
    return render_documents(docs, "Acme").select("p_partkey", F.array_join(lines, "\n\n").alias("body"))


@query("select format('dev-{:04d}', row_number() over (order by p_partkey)) id, p_partkey from part")
def q_sequential_ids(spark, d):
    return quality.numbered(table(spark, d, "part"), "p_partkey", "dev", 0).select("id", "p_partkey")


@query("select l_orderkey, array_to_string(list_concat(['lookup'], list_sort(list(distinct l_shipmode))),',') tags from (select l_orderkey, case l_linenumber%3 when 0 then 'hr' when 1 then 'org' else 'product' end l_shipmode from lineitem) group by l_orderkey")
def q_tags_of_gold(spark, d):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "hr").when(F.col("l_linenumber") % 3 == 1, "org").otherwise("product")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(kind)).alias("k"))
    return g.select("l_orderkey", F.array_join(F.concat(F.array(F.lit("lookup")), "k"), ",").alias("tags"))


@query("select doc_id, len(list_filter(list_transform(string_split(text,chr(10)), lambda x: trim(x)), lambda x: x <> '' and not starts_with(x,'The') and not starts_with(x,'Licensed')))::bigint n from documents")
def q_fact_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.fact_sentences(F.col("text"), ["The", "Licensed"])).cast("long").alias("n"))


@query(r"with p as (select doc_id, text answer, substr(text,1,(length(text)*(doc_id%7)//10)::int) compressed from documents), f as (select *, list_sort(regexp_extract_all(answer,'[A-Z]{2,3}-[0-9]{3}|[0-9][0-9,]*(?:\.[0-9]+)?')) a, list_sort(regexp_extract_all(compressed,'[A-Z]{2,3}-[0-9]{3}|[0-9][0-9,]*(?:\.[0-9]+)?')) b from p) select doc_id from f where length(compressed) <= 0.7*length(answer) and list_transform(a, lambda x: replace(x,',','')) = list_transform(b, lambda x: replace(x,',',''))")
def q_kept_compressions(spark, d):
    part = F.expr("(length(text) * (doc_id % 7)) div 10").cast("int")
    pairs = table(spark, d, "documents").select("doc_id", F.col("text").alias("answer"), F.substr("text", F.lit(1), part).alias("compressed"))
    return judging.kept_compressions(pairs).select("doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where quality=1)")
def q_to_label(spark, d):
    done = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("example_id"))
    return judging.to_label(table(spark, d, "documents").select(F.col("doc_id").alias("example_id")), done).select(F.col("example_id").alias("doc_id"))


@query("with n as (select doc_id, trim(regexp_replace(regexp_replace(lower(text),'[^\\p{L}\\p{N}_\\s\\p{Z}]','','g'),'[\\s\\p{Z}]+',' ','g')) n from documents), c as (select doc_id, string_split(n, '') c from n) select doc_id, case when len(c)<5 then 1 else len(list_distinct(list_transform(generate_series(1,len(c)-4), lambda i: c[i]||c[i+1]||c[i+2]||c[i+3]||c[i+4]))) end::bigint shingles from c")
def q_shingles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.shingles(text.normalize(F.col("text")))).cast("long").alias("shingles"))


@query("with s as (select user_id, event_id, row_number() over (partition by user_id order by md5('3-'||event_id), event_id) rn from events) select user_id, event_id from s where rn <= 3")
def q_shuffled_choice(spark, d):
    return sampling.first_per(table(spark, d, "events"), "user_id", [sampling.hash_order(3, "event_id"), F.col("event_id")], 3).select("user_id", "event_id")


@query("select o_custkey, bool_or(o_orderpriority like '1-%' or o_orderstatus = 'P') gated from orders group by o_custkey")
def q_any_gated(spark, d):
    hit = F.startswith("o_orderpriority", F.lit("1-")) | (F.col("o_orderstatus") == "P")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(hit).alias("gated"))


@query("select lang, source, count(*) n from documents group by rollup(lang, source)")
def q_mix_rollup(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


@query(
    f"""with l as (select doc_id, cast(row_number() over (order by doc_id) as bigint)-1 k, count(*) over () n, ln(n_chars) x, quality::double y, toxic g from documents join labels using(doc_id)),
 r as (select b.b, ('0x'||substr(md5('{SEED}-'||b.b||'-'||l.k),1,8))::BIGINT % n k from l cross join (select unnest(range(100)) b) b),
 s as (select b, g, covar_pop(x,y)*count(*) xy, var_pop(x)*count(*) xx, var_pop(y)*count(*) yy from r join l using(k) group by b, g),
 t as (select b, case when sum(xx)>1e-18 and sum(yy)>1e-18 then sum(xy)/sqrt(sum(xx)*sum(yy)) else 0 end r from s group by b)
 select round(quantile_cont(r,0.025),6) lo, round(quantile_cont(r,0.975),6) hi from t"""
)
def q_partial_corr_ci(spark, d):
    return st.partial_correlation_ci(lengths(spark, d), "x", "y", "t", "doc_id", 100, SEED).select(r6("lo", "lo"), r6("hi", "hi"))


@query("with a as (select l_returnflag, l_linestatus, l_quantity x, l_extendedprice y from lineitem) select l_returnflag, l_linestatus, round(regr_slope(y,x),4) slope from a group by all")
def q_ols_slope(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"))


@query("select user_id, event_type, count(*) n, round(avg(value),6) avg_value from events where event_type in ('click','view','error') group by all having count(*) >= 2")
def q_counts_by_type(spark, d):
    rows = table(spark, d, "events").filter(F.col("event_type").isin("click", "view", "error"))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), r6(F.avg("value"), "avg_value")).filter("n >= 2")


@query(BM25 + " select query_id, string_agg(doc_id||' | t'||doc_id||' | s', chr(10) order by rank) \"text\" from k where rank<=5 group by query_id")
def q_hit_lines(spark, d):
    hits = bm25(spark, d)[0].withColumn("title", F.concat(F.lit("t"), F.col("doc_id").cast("string"))).withColumn("snippet", F.lit("s"))
    return retrieval.hit_lines(hits)


@query()
def q_bootstrap_numpy(spark, d):
    rows = pairing.tag_deltas(pairing.paired(*runs(spark, d)), tags_of(spark, d))
    return st.bootstrap_by_group(rows, "tag", "d", "task_id", 2000, SEED)


@query("select doc_id, round(avg(x),6) margin from (select doc_id, unnest([quality, toxic]) x from labels) group by doc_id")
def q_variants_cross_product(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.explode(F.array("quality", "toxic")).alias("x"))
    return rows.groupBy("doc_id").agg(r6(F.avg("x"), "margin"))
