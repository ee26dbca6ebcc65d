"""Inputs that several queries share, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strand.operators.passages import split_passages, with_part


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as one part of dated items: (part, pos, doc_id, created, ts, vec)."""
    created = F.to_timestamp(F.lit("2000-01-01")) + F.make_dt_interval(F.col("vec_id"))
    return table(spark, sf_dir, "embeddings").select(
        F.lit(0).alias("part"), F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("doc_id"), created.alias("created"),
        (F.col("vec_id") * 86400.0).alias("ts"), F.col("embedding").alias("vec"), "label",
    )


#: Items of a part where a query has several.
PART_SIZE = 250


def parted(spark: SparkSession, sf_dir: str, size: int = PART_SIZE) -> DataFrame:
    """The items in parts of ``size`` positions, as a collection is split before threads are looked for."""
    return with_part(items(spark, sf_dir), size)


ITEMS = """items as (
  select 0 as part, vec_id as pos, vec_id::varchar as doc_id, timestamp '2000-01-01' + to_days(vec_id::int) as created,
    vec_id * 86400.0::double as ts, embedding::double[] as vec, label from embeddings
)"""

#: All pairs of items under a distance; {d} is an expression over a, b and span.
EDGES = """edges as (
  select a.part, a.pos as src, b.pos as dst, round({d}, 9) as d from items a join items b on a.part = b.part and a.pos < b.pos,
    (select max(ts) - min(ts) as span from items) where round({d}, 9) < 0.7
)"""
PLAIN = "1 - list_cosine_similarity(a.vec, b.vec)"
DECAYED = "1 - list_cosine_similarity(a.vec, b.vec) * exp(-10.0 * abs(a.ts - b.ts) / span)"

#: Nearest-parent communities of edges: forest, first components, cut, communities.
NPC = """forest as (select dst, min((d, src)) as m from edges group by dst),
f as (select m[2] as src, dst, m[1] as d from forest),
up as (
  select dst as node, src as anc, 1 as depth from f
  union all select up.node, f.src, depth + 1 from up join f on f.dst = up.anc
),
roots as (select node, arg_max(anc, depth) as root from up group by node),
th as (
  select root, 1.5 * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) * quantile_cont(d, 0.75) as th from f join roots on node = dst group by root
),
rk as (select root, d, row_number() over (partition by root order by d) - 1 as i, count(*) over (partition by root) as n from f join roots on node = dst),
lim as (
  select rk.root, max(case when i = floor((n - 1) * th / 100) then d end) + max((n - 1) * th / 100 - floor((n - 1) * th / 100))
    * (max(case when i = ceil((n - 1) * th / 100) then d end) - max(case when i = floor((n - 1) * th / 100) then d end)) as lim
  from rk join th using (root) group by rk.root
),
deg as (select src as node, count(*) as children from f group by src),
cut as (
  select f.* from f join roots on roots.node = f.dst join lim using (root) join deg on deg.node = f.dst where f.d > lim and children > 1
),
kept as (select * from f where dst not in (select dst from cut)),
up2 as (
  select dst as node, src as anc, 1 as depth from kept
  union all select up2.node, kept.src, depth + 1 from up2 join kept on kept.dst = up2.anc
),
nodes as (select src as node from edges union select dst from edges),
comm as (
  select n.node, coalesce(r.root, n.node) as comm from nodes n left join (select node, arg_max(anc, depth) as root from up2 group by node) r using (node)
),
members as (
  select comm as thread_id, row_number() over (partition by comm order by created, doc_id) - 1 as ord, pos, doc_id, created, vec, label
  from comm join items on items.pos = comm.node
)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_passages(table(spark, sf_dir, "documents"))


LINES = """lines as (
  select doc_id as source_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as idx, unnest(string_split(text, chr(10))) as text
  from documents where text is not null
)"""
PASSAGES = LINES + r""",
passages as (
  select source_id, idx::int as idx, source_id || '_' || idx as doc_id, text from (
    select *, case when regexp_replace(text, '^\s+|\s+$', '', 'g') = '' then 0
      else len(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) end as words from lines
  ) where words between 10 and 500
)"""
#: Distinct words of passages that few passages share: what entities are to threads.
TOKENS = r"""tokens as (
  select doc_id as doc, t as term from (select doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) as t from passages) where t <> ''
)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    return passages(spark, sf_dir).select(F.col("doc_id").alias("doc"), words.alias("term")).filter("term <> ''")


def passage_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same terms as an array a passage: (doc, terms)."""
    return passages(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: t != "").alias("terms")).filter(F.size("terms") > 0)


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as passages and parts as their entities: (doc, entity), distinct."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("entity")).distinct()


BIPARTITE = "incidence as (select distinct l_orderkey as doc, l_partkey as entity from lineitem)"
