"""Queries on scalar functions: strings, dates, numbers, vectors, arrays."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strand.functions import dates as D
from strand.functions import text as T
from strand.functions import vectors as V
from strand.queries.tables import ITEMS, items, table
from strand.queries.tables import passages as passages_of
from strand.queries.tables import PASSAGES
from strand.registry import register

_P = f"with {PASSAGES}"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


@register("STR01_squeeze", "select doc_id, length(regexp_replace(text, ' +', ' ', 'g'))::bigint as chars from documents")
def str01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.squeeze(F.col("text"))).cast("long").alias("chars"))


@register("STR02_tokenizers", f"""{_P}, w as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as a, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as b,
  list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as c from passages)
select doc_id, len(a)::bigint as words, len(list_filter(b, lambda x: not list_contains({_STOP}, x)))::bigint as lower_words, array_to_string(list_filter(c, lambda x: not list_contains({_STOP}, x)), ' ') as plain from w""")
def str02(spark, sf_dir):
    t = F.col("text")
    return passages_of(spark, sf_dir).select("doc_id", F.size(T.tokens(t)).cast("long").alias("words"), F.size(T.lower_tokens(t)).cast("long").alias("lower_words"), F.array_join(T.plain_tokens(t), " ").alias("plain"))


@register("STR03_separator", "select p_partkey, string_split(p_name || '~|~' || p_brand, '~|~')[2] as second, array_to_string([p_name, p_brand], '~|~') as joined from part")
def str03(spark, sf_dir):
    joined = F.concat_ws("~|~", "p_name", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.split(joined, r"~\|~")[1].alias("second"), joined.alias("joined"))


@register("STR04_comment_cleanup", "select p_partkey, replace(regexp_replace(regexp_replace(p_name || ' :  Other Reason:' || p_brand, '\\s*:\\s*', ': ', 'g'), ' +', ' ', 'g'), 'Other Reason', 'OtherReason') as text from part")
def str04(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_comment(F.concat("p_name", F.lit(" :  Other Reason:"), "p_brand")).alias("text"))


@register("STR05_comment_fields", "select p_partkey, p_type as type, 'a|b, c' as exemption, p_name as note from part")
def str05(spark, sf_dir):
    text = F.concat(F.lit("Type: "), "p_type", F.lit("\nExemption: a\nExemption: b, c\nNote : "), "p_name")
    fields = T.comment_fields(text)
    part = table(spark, sf_dir, "part").select("p_partkey", fields.alias("f"))
    return part.select("p_partkey", F.col("f")["type"].alias("type"), F.col("f")["exemption"].alias("exemption"), F.col("f")["note"].alias("note"))


@register("STR06_around_marker", "select p_partkey, split_part(p_name, 'a', 1) as before, case when strpos(p_name, 'a') > 0 then substr(p_name, strpos(p_name, 'a') + 1) end as after, string_split(p_name, ' ')[1] as first, string_split(p_name, ' ')[-1] as last from part")
def str06(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.before(n, "a").alias("before"), T.after(n, "a").alias("after"), T.first_word(n).alias("first"), T.last_word(n).alias("last"))


@register("STR07_highlight", "select p_partkey, replace(p_name, string_split(p_name, ' ')[1], '<b>' || string_split(p_name, ' ')[1] || '</b>') as html from part")
def str07(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.highlight(F.col("p_name"), T.first_word(F.col("p_name"))).alias("html"))


@register("VIZ01_print_thread", "select conv_id, string_agg('[' || turn || '] ' || replace(role || ': ' || text, role, '<b>' || role || '</b>'), chr(10) order by turn) as text from conversations group by conv_id")
def viz01(spark, sf_dir):
    """A conversation as one printable text: time line, marked role, text."""
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), T.highlight(F.concat("role", F.lit(": "), "text"), F.col("role")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))


@register("STR10_token_normalise", "select c_custkey, regexp_replace(lower(c_name), '[0-9]', '0', 'g') as token from customer")
def str10(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalise_token(F.col("c_name")).alias("token"))


@register("DAT01_extract_dates")
def dat01(spark, sf_dir):
    text = F.concat_ws(" ", F.lit("On"), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("at 5pm, not in 2010 or May, then"), F.date_format("o_orderdate", "MMM d, yyyy"))
    found = D.dates_in(text, F.to_date(F.lit("2020-05-13")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(found).alias("d")).select("o_orderkey", "d.span", "d.ts")


@register("DAT01_single_pattern", "select o_orderkey, strptime(regexp_extract(strftime(o_orderdate, 'On %d/%m/%Y it was'), '([0-9]{2}/[0-9]{2}/[0-9]{4})', 1), '%d/%m/%Y')::timestamp as ts from orders")
def dat01_single(spark, sf_dir):
    text = F.concat(F.lit("On "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" it was"))
    m = lambda k: F.regexp_extract(text, "([0-9]{2})/([0-9]{2})/([0-9]{4})", k).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.make_date(m(3), m(2), m(1)).cast("timestamp").alias("ts"))


@register("DAT02_number_words", "select n_nationkey, (20 + n_nationkey % 10)::bigint as n from nation")
def dat02(spark, sf_dir):
    units = F.array(*[F.lit(w) for w in "zero one two three four five six seven eight nine".split()])
    text = F.concat(F.lit("Twenty-"), F.get(units, (F.col("n_nationkey") % 10).cast("int")))
    return table(spark, sf_dir, "nation").select("n_nationkey", D.number_words(text).cast("long").alias("n"))


@register("DAT03_hour_24", "select o_orderkey, ((o_orderkey % 12 + 1) % 12 + case when o_orderkey % 2 = 0 then 12 else 0 end)::bigint as hour from orders")
def dat03(spark, sf_dir):
    half = F.when(F.col("o_orderkey") % 2 == 0, "pm").otherwise("am")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.hour_24(F.col("o_orderkey") % 12 + 1, half).cast("long").alias("hour"))


_DAY = "o_orderdate::date"


@register("DAT04_quarter_date", f"select o_orderkey, date_trunc('quarter', {_DAY})::date as first from orders")
def dat04(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.quarter_date(F.year(d), F.quarter(d)).alias("first"))


@register("DAT05_relative_weekday", f"""with w as (select o_orderkey, {_DAY} as d, (isodow({_DAY}) - 1)::int as wd from orders)
select o_orderkey, d - wd + 2 as this, d + case when (2 - wd + 7) % 7 = 0 then 7 else (2 - wd + 7) % 7 end as next, d - case when (wd - 2 + 7) % 7 = 0 then 7 else (wd - 2 + 7) % 7 end as last from w""")
def dat05(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[D.relative_weekday(d, F.lit(2), w).alias(w) for w in ("this", "next", "last")])


@register("DAT06_relative_unit", f"""with w as (select o_orderkey, {_DAY} as d from orders), m as (select *, make_date(year(d), greatest(1, least(12, month(d) + 2)), 1) as f from w)
select o_orderkey, d + 21 as weeks, (f + (least(day(d), day(last_day(f))) - 1)::int)::date as months from m""")
def dat06(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.relative_unit(d, F.lit(3), "week").alias("weeks"), D.relative_unit(d, F.lit(2), "month").alias("months"))


@register("DAT07_adverbs", f"select o_orderkey, {_DAY} + 1 as tomorrow, {_DAY} - 1 as yesterday from orders")
def dat07(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.adverb_date(d, F.lit("tomorrow")).alias("tomorrow"), D.adverb_date(d, F.lit("yesterday")).alias("yesterday"))


@register("DAT08_durations", f"select o_orderkey, {_DAY} - 14 as ago, {_DAY} + 30 as later from orders")
def dat08(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.duration_date(d, F.lit(2), F.lit("weeks"), F.lit("ago")).alias("ago"), D.duration_date(d, F.lit(1), F.lit("month"), F.lit("later")).alias("later")
    )


@register("DAT09_date_assembly", f"with w as (select o_orderkey, {_DAY} as d, make_date(year({_DAY}), 2, 1) as f from orders) select o_orderkey, (f + (least(day(d), day(last_day(f))) - 1)::int)::date as feb from w")
def dat09(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.assembled(F.lit(None).cast("int"), F.lit(2), F.lit(None).cast("int"), d).alias("feb"))


@register("DAT10_excel_date", "select o_orderkey, date '1899-12-30' + (40000 + o_orderkey % 1000)::int as d from orders")
def dat10(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", D.excel_date(40000 + F.col("o_orderkey") % 1000).alias("d"))


@register("DAT11_fractional_days", "select user_id, (floor(epoch(max(ts)) - epoch(min(ts))) / 86400.0)::double as days from events group by user_id")
def dat11(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("user_id", D.days_between(F.col("a"), F.col("b")).alias("days"))


@register("DAT12_date_fallback", f"select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then {_DAY} end, case when o_orderkey % 3 = 1 then {_DAY} + 1 end, date '2000-01-01') as created from orders")
def dat12(spark, sf_dir):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.when(k == 0, d), F.when(k == 1, F.date_add(d, 1)), F.to_date(F.lit("2000-01-01"))).alias("created"))


@register("DAT13_date_score", """with c as (select o_orderkey, o_custkey, o_orderdate::date as d, (row_number() over (partition by o_custkey order by o_orderkey) - 1) as i, count(*) over (partition by o_custkey) as n,
  (max(o_orderdate::date) over (partition by o_custkey)) as pub from orders), s as (
  select c.*, (select count(*) from orders o where o.o_custkey = c.o_custkey and o.o_orderkey <> c.o_orderkey and abs(date_diff('day', o.o_orderdate::date, c.d)) <= 31) as near from c)
select o_orderkey, round(0.24 * (1 - i / n) + 0.16 * (near / n) + 0.4 * (1 - least(date_diff('day', d, pub), 365) / 365.0) + 0.2 * 1.0, 9) as score from s""")
def dat13(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    c = o.withColumns({"i": F.row_number().over(w.orderBy("o_orderkey")) - 1, "n": F.count("*").over(w), "pub": F.max("d").over(w)})
    # dates of the same customer within a month: a range join by customer
    other = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("other"), F.col("d").alias("e"))
    near = c.join(other, (F.col("o_custkey") == F.col("k")) & (F.col("o_orderkey") != F.col("other")) & (F.abs(F.datediff("d", "e")) <= 31)).groupBy("o_orderkey").agg(F.count("*").alias("near"))
    s = c.join(near, "o_orderkey", "left").withColumn("near", F.coalesce("near", F.lit(0)))
    score = V.weighted(V.DATE_WEIGHTS, 1 - F.col("i") / F.col("n"), F.col("near") / F.col("n"), F.lit(0.0), 1 - F.least(F.datediff("pub", "d"), F.lit(365)) / 365, F.lit(1.0))
    return s.select("o_orderkey", F.round(score, 9).alias("score"))


@register("VEC02_time_decay", f"with {ITEMS}, t as (select max(ts) - min(ts) as span from items) select pos, round(exp(-10.0 * ts / span), 9) as decay from items, t")
def vec02(spark, sf_dir):
    rows = items(spark, sf_dir)
    span = rows.agg((F.max("ts") - F.min("ts")).alias("span"))
    return rows.crossJoin(F.broadcast(span)).select("pos", F.round(V.time_decay(F.col("ts"), F.col("span"), 10.0), 9).alias("decay"))


@register("VEC04_entity_weight", """with p as (select l_orderkey, l_linenumber, (l_quantity / 100.0)::double as d, l_linenumber % 4 as n, case when l_linenumber % 3 > 0 then 4 + 2 * (l_linenumber % 3) end as path from lineitem)
select l_orderkey, l_linenumber, round(case when n > 0 then 1 - (1 - d) * 0.5 * (1 + (1 - exp(-0.1 * n / 5))) else 1 - (1 - d) * 0.5 * exp(-0.1 * (coalesce(path, 10) / 2) / 5) end, 9) as w from p""")
def vec04(spark, sf_dir):
    n = F.col("l_linenumber")
    path = F.when(n % 3 > 0, 4 + 2 * (n % 3))
    w = V.entity_distance((F.col("l_quantity") / 100).cast("double"), n % 4, path, 0.1, 5, 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(w, 9).alias("w"))


@register("VEC05_hac_affinities", f"""with {ITEMS}, t as (select max(ts) - min(ts) as span from items), s as (select a.pos as src, b.pos as dst, list_cosine_similarity(a.vec, b.vec) * exp(-10.0 * abs(a.ts - b.ts) / span) as s from items a join items b on a.pos < b.pos, t)
select src, dst, round(case when 1 - s > 0.7 then 1.0 else 1 - s * 0.5 * exp(-0.1 * 5 / 5) end, 6) as d from s""")
def vec05(spark, sf_dir):
    from strand.operators.cluster import hac_distance
    from strand.operators.graph import expression_edges

    rows = items(spark, sf_dir)
    span = rows.agg((F.max("ts") - F.min("ts")).alias("span")).first()["span"]
    pairs = expression_edges(rows, 10.0)
    decay = F.exp(-10.0 * (F.col("dst") - F.col("src")) * 86400.0 / span)
    s = (1 - F.col("d")) * decay
    return pairs.select("src", "dst", F.round(hac_distance(s, F.lit(0), F.lit(None).cast("int"), 0.7, 0.1, 5, 5), 6).alias("d"))


@register("VEC08_distance_bins", "select l_orderkey, l_linenumber, case when d < 5 then d when d < 8 then 5 when d < 16 then 6 when d < 32 then 7 when d < 64 then 8 else 9 end::int as bin, least(d, 64) / 64.0::double as share from (select l_orderkey, l_linenumber, (l_partkey % 100)::int as d from lineitem)")
def vec08(spark, sf_dir):
    d = (F.col("l_partkey") % 100).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.distance_bin(d).alias("bin"), V.distance_share(d).alias("share"))


_GEO = "select n_nationkey as k, -60.0 + n_nationkey * 5 as s, -58.5 + n_nationkey * 5 as n, -100.0 + n_nationkey * 7 as w, -98.0 + n_nationkey * 7 as e from nation"
_KM = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 1.0)))"
_AREA = f"({_KM.format(a='s', b='n', c='w', d='w')}) * ({_KM.format(a='s', b='s', c='w', d='e')})"


def _boxes(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("k"), (k * 5 - 60.0).alias("s"), (k * 5 - 58.5).alias("n"), (k * 7 - 100.0).alias("w"), (k * 7 - 98.0).alias("e"))


@register("VEC10_box_area", f"with g as ({_GEO}) select k, round({_AREA}, 3) as km2 from g")
def vec10(spark, sf_dir):
    return _boxes(spark, sf_dir).select("k", F.round(V.box_area_km2(F.col("s"), F.col("n"), F.col("w"), F.col("e")), 3).alias("km2"))


@register("VEC11_place_score", f"""with g as ({_GEO}), a as (select k, ln({_AREA}) as la from g), m as (select min(la) as lo, max(la) as hi, count(*) as c from a)
select k, round(0.37 * (1 - k / c) + 0.3 * ((k % 5) / 5.0) + 0.3 * ((k % 2)::double) + 0.03 * (1 - (la - lo) / (hi - lo)), 9) as score from a, m""")
def vec11(spark, sf_dir):
    a = _boxes(spark, sf_dir).select("k", F.log(V.box_area_km2(F.col("s"), F.col("n"), F.col("w"), F.col("e"))).alias("la"))
    m = a.agg(F.min("la").alias("lo"), F.max("la").alias("hi"), F.count("*").alias("c"))
    score = V.weighted(V.PLACE_WEIGHTS, 1 - F.col("k") / F.col("c"), (F.col("k") % 5) / 5, (F.col("k") % 2).cast("double"), 1 - (F.col("la") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return a.crossJoin(F.broadcast(m)).select("k", F.round(score, 9).alias("score"))


@register("VEC14_sigmoid", "select c_custkey, round(1 / (1 + exp(-greatest(least(c_acctbal::double / 100, 20.0), -20.0))), 9) as p from customer")
def vec14(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(V.sigmoid(F.col("c_acctbal").cast("double") / 100), 9).alias("p"))


@register("ARR03_json_extents", """select event_id, (json_extract_string('{"extents":[{"startPara":' || (event_id % 9) || ',"endPara":' || (event_id % 9 + 2) || '}]}', '$.extents[0].startPara'))::bigint as start from events""")
def arr03(spark, sf_dir):
    k = F.col("event_id") % 9
    text = F.concat(F.lit('{"extents":[{"startPara":'), k.cast("string"), F.lit(',"endPara":'), (k + 2).cast("string"), F.lit("}]}"))
    parsed = F.from_json(text, "extents array<struct<startPara:long,endPara:long>>")
    return table(spark, sf_dir, "events").select("event_id", parsed["extents"][0]["startPara"].alias("start"))


@register("ARR04_mention_json", """select conv_id, turn, '{"text":"' || role || '","start":' || turn || ',"end":' || (turn + 1) || '}' as mention from conversations""")
def arr04(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.to_json(F.struct(F.col("role").alias("text"), F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"))).alias("mention"))


@register("ARR05_padding", "with c as (select vec_id, label, embedding[1:(vec_id % 60 + 1)]::double[] as v from embeddings) select vec_id, (max(len(v)) over (partition by label))::int as length, round(list_sum(v), 6) as total from c")
def arr05(spark, sf_dir):
    """Embeddings cut to different lengths, padded with zeros to the longest of their label."""
    from pyspark.sql import Window

    cut = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", F.lit(1), (F.col("vec_id") % 60 + 1).cast("int")).alias("v"))
    longest = F.max(F.size("v")).over(Window.partitionBy("label"))
    padded = F.concat(F.col("v").cast("array<double>"), F.array_repeat(F.lit(0.0), longest - F.size("v")))
    return cut.select("vec_id", F.size(padded).alias("length"), F.round(F.aggregate(padded, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("ARR06_one_hot", "select p_partkey, array_to_string(list_transform(range(0, 5), lambda i: (i = p_size % 5)::int), '') as hot from part")
def arr06(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(V.one_hot(F.col("p_size") % 5, 5), "").alias("hot"))


@register("ARR01_entity_flatten", "select distinct o_orderkey as doc, unnest([o_orderstatus, o_orderpriority]) as entity from orders")
def arr01(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    flat = o.select(F.col("o_orderkey").alias("doc"), F.explode(F.create_map(F.lit("who"), F.array("o_orderstatus"), F.lit("where"), F.array("o_orderpriority"))).alias("question", "names"))
    return flat.select("doc", F.explode("names").alias("entity")).distinct()


@register("ARR02_inverted_threads", "select l_partkey as doc, string_agg(distinct l_orderkey::varchar, ',' order by l_orderkey::varchar) as threads from lineitem group by l_partkey")
def arr02(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("doc")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_orderkey").cast("string"))), ",").alias("threads"))
