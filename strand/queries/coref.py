"""Queries on mentions, pairs, decisions, clusters, metrics and training rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strand.operators import coref as op
from strand.plans.cut import materialize
from strand.queries.tables import table
from strand.registry import register

#: Words of conversations as mentions: capitalised words and pronouns, in word order.
_IS_MENTION = f"(regexp_matches(word, '^[A-Z]') or lower(word) in ({', '.join(repr(p) for p in op.PRONOUNS)}))"
_M = rf"""with u as (select conv_id as doc, turn as sent, role as speaker, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from conversations),
t as (select doc, sent, speaker, unnest(w) as word, unnest(range(0, len(w))) as tok from u),
m as (select doc, (row_number() over (partition by doc order by sent, tok) - 1)::int as i, sent, tok as start, tok + 1 as "end", speaker, word as root, word as text, lower(word) as content, count(*) over (partition by doc) as n from t where {_IS_MENTION})"""


def tokens_of(spark, sf_dir):
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    u = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("sent"), F.col("role").alias("speaker"), words.alias("w"))
    return u.select("doc", "sent", "speaker", F.posexplode("w").alias("tok", "word"))


def mentions_of(spark, sf_dir):
    rows = tokens_of(spark, sf_dir).filter(F.rlike("word", F.lit("^[A-Z]")) | F.lower("word").isin(*op.PRONOUNS)).select(
        "doc", "sent", F.col("tok").alias("start"), (F.col("tok") + 1).alias("end"), "speaker", F.col("word").alias("root"), F.col("word").alias("text"), F.array(F.lower("word")).alias("words")
    )
    return materialize(op.with_ordinals(rows, "sent", "start"), "mentions")


@register("WIN11_mention_ordinal", f"{_M} select doc, i, round(i / n, 9) as location from m")
def win11(spark, sf_dir):
    return mentions_of(spark, sf_dir).select("doc", "i", F.round("location", 9).alias("location"))


@register("SRT06_mention_order", f"{_M} select doc, string_agg(text, ' ' order by i) as texts from m group by doc")
def srt06(spark, sf_dir):
    rows = mentions_of(spark, sf_dir)
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("texts"))


@register("NLP07_mention_type", f"""{_M} select doc, i, case when regexp_matches(lower(text), '\\b(and|or)\\b|,') then 'LIST' when lower(text) in ({", ".join(repr(p) for p in op.PRONOUNS)}) then 'PRONOMINAL' when regexp_matches(text, '^[A-Z]') then 'PROPER' else 'NOMINAL' end as type from m""")
def nlp07(spark, sf_dir):
    tag = F.when(F.rlike("text", F.lit("^[A-Z]")), "NNP").otherwise("NN")
    return mentions_of(spark, sf_dir).select("doc", "i", op.mention_type(tag, F.col("text")).alias("type"))


_PAIRS = _M + """, pairs as (
  select a.doc, a.i as ant, b.i as men from m a join m b on a.doc = b.doc and a.i < b.i and (b.i - a.i <= 10 or (a.content = b.content and b.i - a.i <= 60))
)"""


def pairs_of(spark, sf_dir):
    return op.candidate_pairs(mentions_of(spark, sf_dir), 10, 60)


@register("JOIN10_candidate_pairs", f"{_PAIRS} select doc, ant, men from pairs")
def join10(spark, sf_dir):
    return pairs_of(spark, sf_dir)


_BIN = "case when {d} < 5 then {d} when {d} < 8 then 5 when {d} < 16 then 6 when {d} < 32 then 7 when {d} < 64 then 8 else 9 end::int"
_FEAT = _PAIRS + f""", feat as (
  select p.doc, ant, men, (a.speaker = b.speaker)::int as same_speaker, (lower(a.root) = lower(b.root))::int as heads_agree, (lower(a.text) = lower(b.text))::int as exact, (a.content = b.content)::int as relaxed,
    {_BIN.format(d='(b.sent - a.sent)')} as sent_bin, {_BIN.format(d='(men - ant - 1)')} as mention_bin, (b.start < a."end")::int as overlap
  from pairs p join m a on a.doc = p.doc and a.i = ant join m b on b.doc = p.doc and b.i = men
)"""


def features_of(spark, sf_dir):
    m = mentions_of(spark, sf_dir)
    return op.pair_features(op.candidate_pairs(m, 10, 60), m)


@register("COR03_pair_features", f"{_FEAT} select * from feat")
def cor03(spark, sf_dir):
    return features_of(spark, sf_dir).drop("sent_share")


@register("COR04_match_predicates", f"{_FEAT} select doc, sum(heads_agree)::bigint as heads, sum(exact)::bigint as exact, sum(relaxed)::bigint as relaxed, sum(overlap)::bigint as overlap from feat group by doc")
def cor04(spark, sf_dir):
    return features_of(spark, sf_dir).groupBy("doc").agg(F.sum("heads_agree").alias("heads"), F.sum("exact").alias("exact"), F.sum("relaxed").alias("relaxed"), F.sum("overlap").alias("overlap"))


@register("JOIN17_feature_gather", f"{_PAIRS} select p.doc, ant, men, a.text as ant_text, b.text as men_text from pairs p join m a on a.doc = p.doc and a.i = ant join m b on b.doc = p.doc and b.i = men")
def join17(spark, sf_dir):
    m = mentions_of(spark, sf_dir)
    a, b = m.select("doc", F.col("i").alias("ant"), F.col("text").alias("ant_text")), m.select("doc", F.col("i").alias("men"), F.col("text").alias("men_text"))
    return op.candidate_pairs(m, 10, 60).join(a, ["doc", "ant"]).join(b, ["doc", "men"])


@register("COR02_mention_features", f"{_M} select doc, i, {_BIN.format(d='length(text)')} as length_bin, round(i / n, 9) as location, exists (select 1 from m o where o.doc = m.doc and o.sent = m.sent and o.i <> m.i and o.start <= m.start and m.\"end\" <= o.\"end\") as nested from m")
def cor02(spark, sf_dir):
    from strand.functions.vectors import distance_bin

    m = mentions_of(spark, sf_dir)
    return nested(m).select("doc", "i", distance_bin(F.length("text")).alias("length_bin"), F.round("location", 9).alias("location"), "nested")


def nested(m):
    """``m`` with whether another mention of its sentence contains it; the range join is by document and sentence."""
    o = m.select(F.col("doc").alias("d"), F.col("sent").alias("s"), F.col("i").alias("j"), F.col("start").alias("a"), F.col("end").alias("b"))
    inside = m.join(o, (F.col("doc") == F.col("d")) & (F.col("sent") == F.col("s")) & (F.col("i") != F.col("j")) & (F.col("a") <= F.col("start")) & (F.col("end") <= F.col("b")), "left_semi").select("doc", "i", F.lit(True).alias("nested"))
    return m.join(inside, ["doc", "i"], "left").withColumn("nested", F.coalesce("nested", F.lit(False)))


@register("JOIN12_nested_mentions", f"""{_M}, w as (select *, start - start % 6 as a, start - start % 6 + 5 as b from m) select doc, i from w where exists (select 1 from w o where o.doc = w.doc and o.sent = w.sent and o.i <> w.i and o.a <= w.start and w."end" <= o.b and o.start % 6 = 0)""")
def join12(spark, sf_dir):
    m = mentions_of(spark, sf_dir)
    wide = m.filter("start % 6 = 0").select(F.col("doc").alias("d"), F.col("sent").alias("s"), F.col("i").alias("j"), F.col("start").alias("a"), (F.col("start") + 5).alias("b"))
    return m.join(wide, (F.col("doc") == F.col("d")) & (F.col("sent") == F.col("s")) & (F.col("i") != F.col("j")) & (F.col("a") <= F.col("start")) & (F.col("end") <= F.col("b")), "left_semi").select("doc", "i")


#: A fixed linear scorer, exact in binary, with ties broken by the antecedent.
_W = {"same_speaker": 0.25, "heads_agree": 2.0, "exact": 1.0, "relaxed": 0.5, "mention_bin": -0.125}
_SCORE = _FEAT + """, sc as (select doc, ant, men, -1.0 + 0.25 * same_speaker + 2.0 * heads_agree + 1.0 * exact + 0.5 * relaxed - 0.125 * mention_bin as score from feat),
best as (select doc, men, max((score, ant)) as b from sc group by all), anted as (select doc, men, b[2]::int as ant from best where b[1] > 0)"""


def scores_of(spark, sf_dir):
    return features_of(spark, sf_dir).select("doc", "ant", "men", op.linear_score(_W, -1.0).alias("score"))


def antecedents_of(spark, sf_dir):
    singles = mentions_of(spark, sf_dir).select("doc", F.col("i").alias("men"), F.lit(0.0).alias("self"))
    return op.best_antecedents(scores_of(spark, sf_dir), singles)


@register("AGG16_best_antecedent", f"{_SCORE} select doc, men, ant from anted")
def agg16(spark, sf_dir):
    return antecedents_of(spark, sf_dir)


@register("TRN07_batch_inference", f"{_SCORE} select doc, count(*)::bigint as linked from anted group by doc")
def trn07(spark, sf_dir):
    return antecedents_of(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("linked"))


_CLUSTERS = _SCORE.replace("with u as", "with recursive u as", 1) + """, up as (select doc, men as node, ant as anc, 1 as depth from anted union all select up.doc, up.node, a.ant, depth + 1 from up join anted a on a.doc = up.doc and a.men = up.anc),
cl as (select doc, node, arg_max(anc, depth) as cluster from up group by all), cm as (select doc, node as i, cluster from cl union select doc, cluster, cluster from cl)"""


def clusters_of(spark, sf_dir):
    from strand.operators.graph import pointer_roots

    forest = antecedents_of(spark, sf_dir).select(F.col("doc").alias("part"), F.col("ant").alias("src"), F.col("men").alias("dst"))
    return pointer_roots(forest).select(F.col("part").alias("doc"), F.col("node").alias("i"), F.col("root").alias("cluster"))


@register("COR06_clusters", f"{_CLUSTERS} select doc, i, cluster from cm")
def cor06(spark, sf_dir):
    return clusters_of(spark, sf_dir)


@register("COR08_accessors", f"{_CLUSTERS} select t.doc, t.sent, t.tok::int as tok, cm.cluster is not null as in_coref from t left join m on m.doc = t.doc and m.sent = t.sent and m.start <= t.tok and t.tok < m.\"end\" left join cm on cm.doc = m.doc and cm.i = m.i")
def cor08(spark, sf_dir):
    m = mentions_of(spark, sf_dir).join(clusters_of(spark, sf_dir), ["doc", "i"]).select("doc", "sent", F.col("start").alias("tok"), F.lit(True).alias("in_coref"))
    return tokens_of(spark, sf_dir).join(m, ["doc", "sent", "tok"], "left").select("doc", "sent", "tok", F.coalesce("in_coref", F.lit(False)).alias("in_coref"))


@register("COR10_representative", f"""{_CLUSTERS}, ty as (select cm.*, m.text, case when regexp_matches(lower(text), '\\b(and|or)\\b|,') then 4 when lower(text) in ({", ".join(repr(p) for p in op.PRONOUNS)}) then 3 when regexp_matches(text, '^[A-Z]') then 1 else 2 end as rank from cm join m on m.doc = cm.doc and m.i = cm.i)
select doc, cluster, arg_min(i, (rank, -length(text), i)) as i from ty group by all""")
def cor10(spark, sf_dir):
    tag = F.when(F.rlike("text", F.lit("^[A-Z]")), "NNP").otherwise("NN")
    m = mentions_of(spark, sf_dir).withColumn("type", op.mention_type(tag, F.col("text")))
    return op.most_representative(m.join(clusters_of(spark, sf_dir), ["doc", "i"]))


def _turn_words(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("doc"), "role", F.posexplode(F.split("text", " ")).alias("tok", "word"))


_TURNS = "t as (select conv_id || '-' || turn as doc, role as main, unnest(string_split(text, ' ')) as word, unnest(range(0, len(string_split(text, ' ')))) as tok from conversations)"


@register("STR08_resolved_text", f"with {_TURNS} select doc, string_agg(case when tok % 4 = 0 then main else word end, ' ' order by tok) as text from t where tok % 4 <> 1 group by doc")
def str08(spark, sf_dir):
    """Mentions of two words, every fourth word on, replaced by their main text."""
    rows = _turn_words(spark, sf_dir)
    spans = rows.filter("tok % 4 = 0").select("doc", F.col("tok").alias("start"), (F.col("tok") + 2).alias("end"), F.col("role").alias("main"))
    return op.resolved_text(rows.select("doc", "tok", "word"), spans)


@register("STR09_resolved_utterances", f"with {_TURNS} select doc, string_agg(case when tok = 0 then main else word end, ' ' order by tok) as text from t group by doc")
def str09(spark, sf_dir):
    rows = _turn_words(spark, sf_dir)
    spans = rows.filter("tok = 0").select("doc", F.col("tok").alias("start"), (F.col("tok") + 1).alias("end"), F.col("role").alias("main"))
    return op.resolved_text(rows.select("doc", "tok", "word"), spans)


@register("FLT11_mention_predicate", """select c_custkey from customer where (tag in ('NN', 'NNP', 'NNPS', 'NNS', 'PRP', 'PRP$', 'DT', 'IN') or (dep in ('nsubj', 'dobj', 'iobj', 'pobj') and tag not in ('CC', 'TO'))) and lower(word) not in ('i', 'me', 'my', 'you', 'your')""".replace("from customer", "from (select c_custkey, ['NN', 'IN', 'PRP', 'VB', 'DT'][c_custkey % 5 + 1] as tag, ['nsubj', 'det', 'pobj'][c_custkey % 3 + 1] as dep, ['I', 'house', 'Your', 'it'][c_custkey % 4 + 1] as word from customer)"))
def flt11(spark, sf_dir):
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col("c_custkey") % n).cast("int"))
    tag, dep, word = pick(["NN", "IN", "PRP", "VB", "DT"], 5), pick(["nsubj", "det", "pobj"], 3), pick(["I", "house", "Your", "it"], 4)
    return table(spark, sf_dir, "customer").filter(op.mention_allowed(tag, dep, word)).select("c_custkey")


@register("FLT12_entity_whitelist", "select p_partkey from part where split_part(p_type, ' ', 1) in ('ECONOMY', 'STANDARD')")
def flt12(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.split("p_type", " ")[0].isin("ECONOMY", "STANDARD")).select("p_partkey")


@register("FLT14_cluster_blacklist", f"""{_CLUSTERS}, c as (select cm.doc, cm.cluster, bool_or(lower(m.text) in ('the', 'a', 'of', 'it')) as barred from cm join m on m.doc = cm.doc and m.i = cm.i group by all)
select doc, cluster, (row_number() over (partition by doc order by cluster) - 1)::int as key from c where not barred""")
def flt14(spark, sf_dir):
    """Clusters without those that hold a listed text, numbered anew from 0."""
    m = mentions_of(spark, sf_dir).join(clusters_of(spark, sf_dir), ["doc", "i"])
    barred = m.filter(F.lower("text").isin("the", "a", "of", "it")).select("doc", "cluster").distinct()
    left = m.join(barred, ["doc", "cluster"], "left_anti").select("doc", "cluster").distinct()
    return left.withColumn("key", F.row_number().over(Window.partitionBy("doc").orderBy("cluster")) - 1)


@register("FLT15_last_utterances", f"{_M} select doc, i from m where sent >= (select max(sent) from m m2 where m2.doc = m.doc) - 1")
def flt15(spark, sf_dir):
    m = mentions_of(spark, sf_dir)
    last = m.groupBy("doc").agg(F.max("sent").alias("last"))
    return m.join(last, "doc").filter("sent >= last - 1").select("doc", "i")


@register("JOIN11_gold_labels", f"{_M}, g as (select doc, sent, start, length(text) as label from m where i % 2 = 0) select m.doc, m.i, coalesce(g.label, -1)::int as label from m left join g using (doc, sent, start)")
def join11(spark, sf_dir):
    m = mentions_of(spark, sf_dir)
    gold = m.filter("i % 2 = 0").select("doc", "sent", "start", F.length("text").alias("label"))
    return m.join(gold, ["doc", "sent", "start"], "left").select("doc", "i", F.coalesce("label", F.lit(-1)).alias("label"))


@register("TRN06_undetected_gold", f"{_M}, g as (select doc, sent, tok as start from t where tok % 2 = 0) select g.doc, count(*)::bigint as missed from g where not exists (select 1 from m where m.doc = g.doc and m.sent = g.sent and m.start = g.start) group by g.doc")
def trn06(spark, sf_dir):
    gold = tokens_of(spark, sf_dir).filter("tok % 2 = 0").select("doc", "sent", F.col("tok").alias("start"))
    return gold.join(mentions_of(spark, sf_dir), ["doc", "sent", "start"], "left_anti").groupBy("doc").agg(F.count("*").alias("missed"))


@register("TRN04_gold_pairs", f"{_PAIRS} select p.doc, ant, men, (a.content = b.content)::int as gold, (not exists (select 1 from pairs q join m c on c.doc = q.doc and c.i = q.ant where q.doc = p.doc and q.men = p.men and c.content = b.content))::int as single from pairs p join m a on a.doc = p.doc and a.i = ant join m b on b.doc = p.doc and b.i = men")
def trn04(spark, sf_dir):
    gold = features_of(spark, sf_dir).select("doc", "ant", "men", F.col("relaxed").alias("gold"))
    any_gold = F.max("gold").over(Window.partitionBy("doc", "men"))
    return gold.withColumn("single", 1 - any_gold)


@register("WIN12_pair_offsets", f"{_PAIRS}, c as (select doc, men, count(*) as pairs from pairs group by all) select doc, men, pairs::bigint as pairs, coalesce(sum(pairs) over (partition by doc order by men rows between unbounded preceding and 1 preceding), 0)::bigint as first from c")
def win12(spark, sf_dir):
    counts = pairs_of(spark, sf_dir).groupBy("doc", "men").agg(F.count("*").alias("pairs"))
    before = Window.partitionBy("doc").orderBy("men").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("pairs").over(before), F.lit(0)))


@register("WIN09_context_frames", """with t as (select conv_id || '-' || turn as doc, string_split(text, ' ') as w from conversations), p as (select doc, w, unnest(range(1, len(w) + 1)) as i from t)
select doc, (i - 1)::int as i, array_to_string(w[greatest(i - 5, 1):i - 1], ' ') as "left", array_to_string(w[i + 1:i + 5], ' ') as "right" from p""")
def win09(spark, sf_dir):
    w = F.split("text", " ")
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc"), w.alias("w"), F.posexplode(w).alias("i", "word"))
    left = F.slice("w", F.greatest(F.col("i") - 4, F.lit(1)), F.least(F.col("i"), F.lit(5)))
    right = F.slice("w", F.col("i") + 2, F.lit(5))
    return rows.select("doc", "i", F.array_join(left, " ").alias("left"), F.array_join(right, " ").alias("right"))


@register("TRN01_training_rows", f"{_FEAT} select doc, ant, men, (case when relaxed = 1 then 0.8 when max(relaxed) over (partition by doc, men) = 1 then 1.0 else 0.4 end)::double as cost from feat")
def trn01(spark, sf_dir):
    """Pairs with features, gold label and cost: 1 for a wrong link, 0.4 for a false one, 0.8 for a missed."""
    f = features_of(spark, sf_dir)
    linked = F.max("relaxed").over(Window.partitionBy("doc", "men"))
    return f.withColumn("cost", F.when(F.col("relaxed") == 1, 0.8).when(linked == 1, 1.0).otherwise(0.4)).select("doc", "ant", "men", "cost")


@register("TRN02_losses", f"""{_SCORE}, x as (select s.doc, s.men, s.ant, s.score, f.relaxed as gold, 1 / (1 + exp(-s.score)) as p from sc s join feat f using (doc, ant, men)),
per as (select doc, men, sum(case when gold = 1 then -ln(greatest(p, 1e-12)) else -ln(greatest(1 - p, 1e-12)) end) as every, -ln(greatest(coalesce(max(case when gold = 1 then p end), 1.0), 1e-12)) - ln(greatest(1 - coalesce(max(case when gold = 0 then p end), 0.0), 1e-12)) as top, max(case when gold = 1 then score end) as best from x group by all),
sl as (select x.doc, x.men, max(case when x.gold = 1 then 0.8 else 1.0 end * (1 + x.score - per.best)) as slack from x join per on per.doc = x.doc and per.men = x.men where per.best is not null group by all)
select round(sum(every), 4) as all_pairs, round(sum(top), 4) as top_pairs, round((select sum(greatest(slack, 0.0)) from sl), 4) as slack from per""")
def trn02(spark, sf_dir):
    gold = features_of(spark, sf_dir).select("doc", "ant", "men", F.col("relaxed").alias("gold"))
    rows = scores_of(spark, sf_dir).join(gold, ["doc", "ant", "men"]).withColumn("cost", F.when(F.col("gold") == 1, 0.8).otherwise(1.0))
    return op.ranking_losses(rows).select(*[F.round(c, 4).alias(c) for c in ("all_pairs", "top_pairs", "slack")])


@register("JOIN19_speaker_match", "select distinct c.conv_id, c.turn, s.role as speaker from conversations c join (select distinct role from conversations) s on c.role = s.role or list_contains(string_split(lower(c.text), ' '), lower(s.role))")
def join19(spark, sf_dir):
    """A speaker is met by id or by a word of the text: two equi-joins and a union."""
    c = table(spark, sf_dir, "conversations")
    speakers = c.select(F.col("role").alias("speaker")).distinct()
    by_id = c.join(speakers, F.col("role") == F.col("speaker")).select("conv_id", "turn", "speaker")
    words = c.select("conv_id", "turn", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return by_id.union(words.join(speakers, F.col("word") == F.lower("speaker")).select("conv_id", "turn", "speaker")).distinct()


_VOCAB = "v as (select split_part(p_name, ' ', 1) as word, min(p_partkey) as id from part group by 1), s as (select split_part(p_name, ' ', 2) as word, min(p_partkey) as id from part group by 1)"


@register("JOIN18_embedding_fallback", f"with {_VOCAB} select p_partkey, coalesce(v.id, s.id, -1) as id from part p left join v on v.word = split_part(p.p_brand, '#', 1) left join s on s.word = split_part(p.p_name, ' ', 2)")
def join18(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = lambda k: part.groupBy(F.split("p_name", " ")[k].alias(f"w{k}")).agg(F.min("p_partkey").alias(f"id{k}"))
    rows = part.select("p_partkey", F.split("p_brand", "#")[0].alias("brand"), F.split("p_name", " ")[1].alias("second"))
    return rows.join(first(0), F.col("brand") == F.col("w0"), "left").join(first(1), F.col("second") == F.col("w1"), "left").select("p_partkey", F.coalesce("id0", "id1", F.lit(-1)).alias("id"))


@register("JOIN20_out_of_vocabulary", f"with {_VOCAB}, w as (select distinct unnest(string_split(p_name, ' ')) as word from part) select word from w where word not in (select word from v)")
def join20(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    known = part.select(F.split("p_name", " ")[0].alias("word")).distinct()
    return part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct().join(known, "word", "left_anti")


@register("JOIN15_token_alignment", """with c as (select conv_id, turn, text, string_split(text, ' ') as w from conversations), a as (select conv_id, turn, unnest(w) as x, unnest(range(0, len(w))) as i from c),
o as (select *, coalesce(sum(length(x) + 1) over (partition by conv_id, turn order by i rows between unbounded preceding and 1 preceding), 0) as b from a)
select p.conv_id, p.turn, p.i::int as coarse, (q.i)::int as fine from o p join o q on p.conv_id = q.conv_id and p.turn = q.turn and p.i % 2 = 0 and q.b < p.b + length(p.x) + 3 and p.b < q.b + length(q.x)""")
def join15(spark, sf_dir):
    """Tokens of two splits of a text aligned by overlapping character ranges."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "x"))
    before = Window.partitionBy("conv_id", "turn").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    o = materialize(rows.withColumn("b", F.coalesce(F.sum(F.length("x") + 1).over(before), F.lit(0))).withColumn("e", F.col("b") + F.length("x")), "offsets")
    p = o.filter("i % 2 = 0").select("conv_id", "turn", F.col("i").alias("coarse"), "b", (F.col("e") + 3).alias("e"))
    return op.overlapping(p, o.select("conv_id", "turn", F.col("i").alias("fine"), "b", "e"), ["conv_id", "turn"]).select("conv_id", "turn", "coarse", "fine")


_BOX = "b as (select c_custkey as k, c_nationkey as g, c_custkey % 50 as x, c_custkey % 50 + c_custkey % 7 + 1 as y from customer)"


def _boxed(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_nationkey").alias("g"), (k % 50).alias("x"), (k % 50 + k % 7 + 1).alias("y"))


def _classes_within(b):
    """(g, x, y, ox, oy, n): the different ranges of a group, each with those that hold it and how many rows have them."""
    sizes = materialize(b.groupBy("g", "x", "y").agg(F.count("*").alias("n")), "ranges")  # equal ranges are compared once
    return sizes.drop("n").join(sizes.withColumnsRenamed({"x": "ox", "y": "oy"}), "g").filter("ox <= x and y <= oy")


@register("JOIN13_box_entailment", f"with {_BOX} select a.k, count(*)::bigint as within from b a join b o on a.g = o.g and a.k <> o.k and o.x <= a.x and a.y <= o.y group by a.k")
def join13(spark, sf_dir):
    """How many others hold each: sums over the different ranges that do, less the rows of its own key among them."""
    b = _boxed(spark, sf_dir).filter("k is not null")
    holding = _classes_within(b).groupBy("g", "x", "y").agg(F.sum("n").alias("n"))
    own = b.join(b.select("g", "k", F.col("x").alias("ox"), F.col("y").alias("oy")), ["g", "k"]).filter("ox <= x and y <= oy").groupBy("k").agg(F.count("*").alias("own"))
    within = b.join(holding, ["g", "x", "y"]).groupBy("k").agg(F.sum("n").alias("n")).join(own, "k")
    return within.select("k", (F.col("n") - F.col("own")).alias("within")).filter("within > 0")


@register("JOIN14_interval_entailment", f"with {_BOX} select a.k, o.k as other from b a join b o on a.g = o.g and a.k <> o.k and o.x <= a.x and a.y <= o.y where abs(a.x - o.x) <= 2")
def join14(spark, sf_dir):
    """The pairs of ranges that qualify are found first, so rows meet only those that they are paired with."""
    b = _boxed(spark, sf_dir)
    near = _classes_within(b).filter("abs(x - ox) <= 2").select("g", "x", "y", "ox", "oy")
    left = b.join(near, ["g", "x", "y"]).select("k", "g", "ox", "oy")
    return left.join(b.select(F.col("k").alias("other"), "g", F.col("x").alias("ox"), F.col("y").alias("oy")), ["g", "ox", "oy"]).filter("k <> other").select("k", "other")


@register("COR13_entity_of_span", f"{_M}, e as (select doc, sent, start, start + 4 as stop, 'E' || (start % 5) as label from m where start % 6 = 0) select m.doc, m.i, min(e.label) as label from m left join e on e.doc = m.doc and e.sent = m.sent and e.start <= m.start and m.\"end\" <= e.stop group by all")
def cor13(spark, sf_dir):
    m = mentions_of(spark, sf_dir)
    e = m.filter("start % 6 = 0").select("doc", "sent", F.col("start").alias("a"), (F.col("start") + 4).alias("b"), F.concat(F.lit("E"), (F.col("start") % 5).cast("string")).alias("label"))
    hit = m.join(e, ["doc", "sent"]).filter(F.col("a") <= F.col("start")).filter(F.col("end") <= F.col("b")).groupBy("doc", "i").agg(F.min("label").alias("label"))
    return m.join(hit, ["doc", "i"], "left").select("doc", "i", "label")


@register("AGG13_average_embedding", "with e as (select label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as k from embeddings) select label, k::int as k, round(avg(x), 6) as mean from e group by all")
def agg13(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@register("AGG14_document_embedding", "with e as (select label, vec_id % 4 as u, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as k from embeddings), m as (select label, u, k, avg(x) as x from e group by all) select label, k::int as k, round(avg(x), 6) as mean from m group by label, k")
def agg14(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 4).alias("u"), F.posexplode("embedding").alias("k", "x"))
    return rows.groupBy("label", "u", "k").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label", "k").agg(F.round(F.avg("x"), 6).alias("mean"))


@register("COR11_rare_words", "with e as (select vec_id % 37 as word, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as k from embeddings) select word, k::int as k, round(avg(x), 6) as x from e group by all")
def cor11(spark, sf_dir):
    """A rare word's vector: the mean of those of the words it is explained by."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 37).alias("word"), F.posexplode("embedding").alias("k", "x"))
    return rows.groupBy("word", "k").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


@register("COR12_mention_embedding")
def cor12(spark, sf_dir):
    """Own, previous and next vector of an item with the mean of the five before it, joined into one."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = F.col("embedding").cast("array<double>")
    zero = F.array_repeat(F.lit(0.0), 64)
    frame = F.collect_list(v).over(w.rowsBetween(-5, -1))
    mean = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(F.size(frame) > 0, F.aggregate(frame, F.lit(0.0), lambda s, x: s + F.get(x, k)) / F.size(frame)).otherwise(0.0))
    joined = F.concat(v, F.coalesce(F.lag(v).over(w), zero), F.coalesce(F.lead(v).over(w), zero), mean)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(joined).alias("dims"))


_KR = """with r as (select l_orderkey as c, l_linenumber, min(l_partkey % 5) as k, min(l_suppkey % 4) as r from lineitem group by all),
kk as (select c, l_linenumber as m, k from r), rr as (select c, l_linenumber as m, r from r where l_linenumber % 4 <> 3),
ov as (select kk.c, k, r, count(*) as s from kk join rr on kk.c = rr.c and kk.m = rr.m group by all), ks as (select c, k, count(*) as n from kk group by all), rs as (select c, r, count(*) as n from rr group by all)"""


def key_response(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.groupBy(F.col("l_orderkey").cast("string").alias("case"), F.col("l_linenumber").alias("mention")).agg(F.min(F.col("l_partkey") % 5).alias("k"), F.min(F.col("l_suppkey") % 4).alias("r"))
    key = rows.select("case", "mention", F.col("k").alias("cluster"))
    return key, rows.filter("mention % 4 <> 3").select("case", "mention", F.col("r").alias("cluster"))


@register("AGG17_muc", f'{_KR}, p as (select ks.c, ks.k, max(ks.n) - count(ov.r) - (max(ks.n) - coalesce(sum(s), 0)) as kept, max(ks.n) - 1 as links from ks left join ov on ov.c = ks.c and ov.k = ks.k group by all) select c::varchar as "case", sum(kept)::double as rn, sum(links)::double as rd from p group by c')
def agg17_muc(spark, sf_dir):
    return op.muc(*key_response(spark, sf_dir))


@register("AGG17_b_cubed", f'{_KR}, h as (select ov.c, sum(s * s / n) as rn from ov join ks on ks.c = ov.c and ks.k = ov.k group by ov.c), d as (select c, sum(n)::double as rd from ks group by c) select d.c::varchar as "case", round(coalesce(rn, 0), 9) as rn, rd from d left join h using (c)')
def agg17_b3(spark, sf_dir):
    return op.b_cubed(*key_response(spark, sf_dir)).select("case", F.round("rn", 9).alias("rn"), "rd")


@register("AGG17_ceaf")
def agg17_ceaf(spark, sf_dir):
    return op.ceaf(*key_response(spark, sf_dir), entity=True)


@register("AGG17_blanc", f"""{_KR}, k as (select c, sum(n * (n - 1) / 2) as kc, sum(n) * (sum(n) - 1) / 2 as ka from ks group by c), x as (select c, sum(n * (n - 1) / 2) as rc, sum(n) * (sum(n) - 1) / 2 as ra from rs group by c),
b as (select c, sum(s * (s - 1) / 2) as bc, sum(s) * (sum(s) - 1) / 2 as ba from ov group by c), ik as (select c, sum(s * (s - 1) / 2) as ik from (select c, k, sum(s) as s from ov group by c, k) group by c), ir as (select c, sum(s * (s - 1) / 2) as ir from (select c, r, sum(s) as s from ov group by c, r) group by c),
j as (select k.c, kc, ka - kc as kn, rc, ra - rc as rn, coalesce(bc, 0) as bc, coalesce(ba, 0) - coalesce(ik, 0) - coalesce(ir, 0) + coalesce(bc, 0) as bn from k join x using (c) left join b using (c) left join ik using (c) left join ir using (c)),
s as (select *, case when kc > 0 then bc / kc else 0 end as r_c, case when kn > 0 then bn / kn else 0 end as r_n from j)
select c::varchar as "case", round(case when kc = 0 then r_n when kn = 0 then r_c else (r_c + r_n) / 2 end, 9) as recall from s""")
def agg17_blanc(spark, sf_dir):
    return op.blanc(*key_response(spark, sf_dir)).select("case", F.round("recall", 9).alias("recall"))


@register("AGG18_conll_f1")
def agg18(spark, sf_dir):
    """Mean F1 of MUC, B cubed and entity CEAF over all cases: sums of numerators over sums of denominators."""
    key, response = key_response(spark, sf_dir)
    f1 = lambda r, p: 2 * r * p / (r + p) if r + p else 0.0
    scores = []
    for metric in (op.muc, op.b_cubed):
        r, p = (metric(*x).agg(F.sum("rn"), F.sum("rd")).first() for x in ((key, response), (response, key)))
        scores.append(f1(r[0] / r[1], p[0] / p[1]))
    c = op.ceaf(key, response, entity=True).agg(F.sum("total"), F.sum("recall_of"), F.sum("precision_of")).first()
    scores.append(f1(c[0] / c[1], c[0] / c[2]))
    return spark.createDataFrame([(round(sum(scores) / 3, 9),)], "conll_f1 double")


@register("AGG19_mention_identification", f"{_KR}, b as (select count(*) as n from kk join rr on kk.c = rr.c and kk.m = rr.m) select round((select n from b) / (select count(*) from kk), 9) as recall, round((select n from b) / (select count(*) from rr), 9) as precision")
def agg19(spark, sf_dir):
    key, response = key_response(spark, sf_dir)
    both = key.select("case", "mention", F.lit(1).alias("k")).join(response.select("case", "mention", F.lit(1).alias("r")), ["case", "mention"], "full")
    hit = F.sum(F.col("k") * F.col("r"))
    return both.agg(F.round(hit / F.sum("k"), 9).alias("recall"), F.round(hit / F.sum("r"), 9).alias("precision"))


_MAIN = f"""{_CLUSTERS}, g as (select cm.doc, cm.i, cm.cluster, m.text from cm join m on m.doc = cm.doc and m.i = cm.i),
r as (select doc, cluster, arg_min(text, (-length(text), i)) as main from g group by all), answer as (select g.doc, g.i, g.cluster, r.main from g join r on r.doc = g.doc and r.cluster = g.cluster)"""


@register("COR07_coref_pipeline", f"{_MAIN} select doc, i, cluster, main from answer")
def cor07(spark, sf_dir):
    """Mentions, pairs, scores, decisions and clusters in one call: mentions with their cluster's main text."""
    m = mentions_of(spark, sf_dir).withColumn("type", F.lit("NOMINAL"))
    grouped = materialize(m.join(clusters_of(spark, sf_dir), ["doc", "i"]), "coref")
    main = op.most_representative(grouped).join(m.select("doc", "i", F.col("text").alias("main")), ["doc", "i"]).drop("i")
    return grouped.join(main, ["doc", "cluster"]).select("doc", "i", "cluster", "main")


@register("SRC24_rest_answer", f"""{_MAIN} select doc, '[' || string_agg('{{"i":' || i || ',"cluster":' || cluster || ',"main":' || to_json(main) || '}}', ',' order by i) || ']' as answer from answer group by doc""")
def src24(spark, sf_dir):
    """What a service would answer for each document, as JSON: mentions and clusters."""
    rows = cor07(spark, sf_dir)
    return rows.groupBy("doc").agg(F.to_json(F.array_sort(F.collect_list(F.struct("i", "cluster", "main")))).alias("answer"))


@register("AGG22_distinct_trajectories", "select distinct string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey) as path from lineitem group by l_orderkey")
def agg22(spark, sf_dir):
    path = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(path, ",").alias("path")).select("path").distinct()


@register("AGG15_candidate_frequency", "select l_partkey as place, count(*)::bigint as n, min(l_linenumber) as first from lineitem group by l_partkey")
def agg15(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("place")).agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first"))


@register("SRT05_candidate_order", "select l_orderkey, string_agg(l_linenumber::varchar, ',' order by l_extendedprice desc, l_linenumber) as best from lineitem group by l_orderkey")
def srt05(spark, sf_dir):
    order = F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), "l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(order, lambda x: x["l_linenumber"].cast("string")), ",").alias("best"))


@register("TOP03_top_answer", "select l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) as best from lineitem group by l_orderkey")
def top03(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("best"))


_NER = "n as (select l_orderkey as doc, l_linenumber as tok, case l_suppkey % 3 when 0 then 'O' when 1 then 'PERSON' else 'LOCATION' end as ner, l_partkey as word from (select l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey, min(l_partkey) as l_partkey from lineitem group by 1, 2))"


def _tagged(spark, sf_dir):
    s = F.col("l_suppkey") % 3
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    return rows.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("tok"), F.when(s == 0, "O").when(s == 1, "PERSON").otherwise("LOCATION").alias("ner"), F.col("l_partkey").alias("word"))


@register("WIN07_entity_runs", f"with {_NER}, g as (select *, row_number() over (partition by doc order by tok) - row_number() over (partition by doc, ner order by tok) as run from n) select doc, ner, string_agg(word::varchar, ' ' order by tok) as entity from g where ner in ('PERSON', 'LOCATION') group by doc, ner, run")
def win07(spark, sf_dir):
    run = F.row_number().over(Window.partitionBy("doc").orderBy("tok")) - F.row_number().over(Window.partitionBy("doc", "ner").orderBy("tok"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("tok", "word"))), lambda x: x["word"].cast("string"))
    return _tagged(spark, sf_dir).withColumn("run", run).filter(F.col("ner").isin("PERSON", "LOCATION")).groupBy("doc", "ner", "run").agg(F.array_join(words, " ").alias("entity")).drop("run")


@register("WIN08_timex_groups", "select l_orderkey as sent, l_suppkey % 3 as tid, string_agg(l_linenumber::varchar, ',' order by l_linenumber) as tokens from lineitem group by all")
def win08(spark, sf_dir):
    toks = F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sent"), (F.col("l_suppkey") % 3).alias("tid")).agg(F.array_join(toks, ",").alias("tokens"))


@register("PRJ05_valid_entity", f"with {_NER} select doc, bool_or(ner <> 'O') as valid from n group by doc")
def prj05(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy("doc").agg(F.collect_list(F.struct("tok", "ner")).alias("t")).select("doc", F.exists("t", lambda x: x["ner"] != "O").alias("valid"))


#: Entity classes of fine labels (fixed values); anything else is O.
NER_CLASSES = {"PERSON": "PERSON", "NORP": "MISC", "FAC": "LOCATION", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "DATE": "DATE", "TIME": "TIME", "MONEY": "MONEY", "PERCENT": "PERCENT"}


@register("PRJ04_ner_mapping", "select n_nationkey, ['PERSON', 'LOCATION', 'ORGANIZATION', 'O'][n_nationkey % 4 + 1] as class from nation")
def prj04(spark, sf_dir):
    fine = F.get(F.array(*map(F.lit, ["PERSON", "GPE", "ORG", "WORK"])), (F.col("n_nationkey") % 4).cast("int"))
    classes = F.create_map(*[F.lit(x) for kv in NER_CLASSES.items() for x in kv])
    return table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(F.element_at(classes, fine), F.lit("O")).alias("class"))
