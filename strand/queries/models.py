"""Queries on clustering, sampling, documents, annotation, whole runs and streams."""

from __future__ import annotations

import datetime as dt
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strand.operators import cluster, fivew, graph, sdpp, threads
from strand.params import HyperParams
from strand.plans import runs
from strand.plans.cut import materialize, shared_dir
from strand.queries.tables import ITEMS, PART_SIZE, items, parted, table
from strand.queries.tables import passages as passages_of
from strand import registry
from strand.queries import threads as _threads  # noqa: F401  registers what is merged below
from strand.queries.coref import _FEAT
from strand.registry import register
from strand.sources import documents as D
from strand.sources import stored as S
from strand.streaming import jobs

P = HyperParams()
BASE = dt.date(2020, 5, 13)


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/strand/{name}-{uuid.uuid4().hex}"


def _clusters(spark, sf_dir):
    return cluster.complete(graph.blocked_edges(items(spark, sf_dir), P.weight_threshold))


@register("CLU01_hac")
def clu01(spark, sf_dir):
    return _clusters(spark, sf_dir)


@register("CLU02_hac_threads")
def clu02(spark, sf_dir):
    labels = _clusters(spark, sf_dir).select(F.lit(0).alias("part"), "node", F.col("label").alias("comm"))
    return threads.thread_members(labels, items(spark, sf_dir)).select("thread_id", "ord", "doc_id", "created")


_PARTED = f"""{ITEMS}, parted as (select (pos // {PART_SIZE})::int as part, pos, vec from items)"""


@register("CLU03_seqint_run", f"with {_PARTED} select part, ((count(*) // 5) * 1)::bigint as threads, count(*)::bigint as members from parted group by part")
def clu03(spark, sf_dir):
    """Threads by ward linkage, size // 5 of them in each part; every item is in one."""
    found = runs.seqint(parted(spark, sf_dir), P, clusters_per_item=5)
    return found.groupBy("part").agg(F.count("*").alias("threads"), F.sum("length").alias("members"))


@register("CLU04_hint_run")
def clu04(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("part", (F.col("pos") % 2).cast("int"))
    incidence = rows.select(F.col("pos").alias("doc"), F.col("label").alias("entity"))
    return runs.hint(rows, P, incidence=incidence).select("part", "thread_id", "length", F.round("sim", 6).alias("sim"))


@register("SMP01_k_sdpp")
def smp01(spark, sf_dir):
    return sdpp.k_sdpp(parted(spark, sf_dir), 3, 4, 3)


#: What any sample of sequences must be, whatever was drawn: three epochs of up to four sequences of three items, forward in position.
_SAMPLED = f"with {_PARTED} select distinct part, 3::bigint as length, true as forward from parted"


@register("SMP05_sampled_threads", _SAMPLED)
def smp05(spark, sf_dir):
    paths = sdpp.distinct_paths(sdpp.k_sdpp(parted(spark, sf_dir), 3, 4, 3))
    forward = F.forall(F.sequence(F.lit(1), F.size("nodes") - 1), lambda k: F.get("nodes", k) > F.get("nodes", k - 1))
    return paths.groupBy("part").agg(F.max(F.size("nodes")).cast("long").alias("length"), F.min(forward).alias("forward"))


@register("SMP06_sampled_evaluation", f"with {_PARTED} select distinct part, 3::bigint as length, true as scored from parted")
def smp06(spark, sf_dir):
    found = runs.dpp(parted(spark, sf_dir), epochs=3, k=4, length=3)
    return found.groupBy("part").agg(F.max("length").alias("length"), F.min(F.col("sim").between(-1, 1)).alias("scored"))


def _by_part(spark, sf_dir, one, schema: str):
    return parted(spark, sf_dir).select("part", "pos", "vec").groupBy("part").applyInPandas(one, schema)


@register("SMP02_belief_propagation", f"""with {_PARTED}, s as (
  select a.part, a.pos as i, b.pos as j, list_cosine_similarity(a.vec, b.vec) as c from parted a join parted b on a.part = b.part
), f as (select part, i, sum(case when c > 0.2 then c else 0 end) + max(case when i = j and c > 0.2 then c else 0 end) as first from s group by all)
select s.part, round(sum(case when s.j > s.i and c > 0.2 then f.first * c else 0 end), 3) as z, 2.0::double as marginal_sum from s join f on f.part = s.part and f.i = s.i group by s.part""")
def smp02(spark, sf_dir):
    """Partition sum of all sequences of two items and the sum of their marginals, of each part's model."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        _, model, _ = sdpp.part_model(rows, 2)
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "z": [model.partition()], "marginal_sum": [float(model.marginals().sum())]})

    return _by_part(spark, sf_dir, one, "part int, z double, marginal_sum double").select("part", F.round("z", 3).alias("z"), F.round("marginal_sum", 9).alias("marginal_sum"))


@register("SMP03_dpp_sampling", f"with {_PARTED} select distinct part, form, 8::bigint as items, 8::bigint as own from parted, (values ('primal'), ('dual')) f(form)")
def smp03(spark, sf_dir):
    """Subsets of eight items of each part by the kernel and by its dual: as many different items, all of the part."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        part, v = int(rows["part"].iloc[0]), np.stack(rows["vec"].to_numpy()).astype(float)
        rng = np.random.default_rng(part)
        values, vectors = sdpp.decompose(v @ v.T)
        chosen = [("primal", x) for x in sdpp.sample_dpp(values, vectors, rng, 8)] + [("dual", x) for x in sdpp.sample_dual(v, rng, 8)]
        return pd.DataFrame({"part": part, "form": [f for f, _ in chosen], "pos": rows["pos"].to_numpy()[[x for _, x in chosen]]})

    found = _by_part(spark, sf_dir, one, "part int, form string, pos long")
    own = (F.floor(F.col("pos") / PART_SIZE) == F.col("part")).cast("long")
    return found.groupBy("part", "form").agg(F.countDistinct("pos").alias("items"), F.sum(own).alias("own"))


@register("SMP04_sample_k", f"with {_PARTED} select distinct part, 4::bigint as size from parted")
def smp04(spark, sf_dir):
    """Eigenvectors chosen for samples of four, of each part's kernel: four different ones."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["vec"].to_numpy()).astype(float)
        part = int(rows["part"].iloc[0])
        chosen = sdpp.sample_k(sdpp.decompose(v.T @ v)[0], 4, np.random.default_rng(part))
        return pd.DataFrame({"part": [part], "size": [len(set(chosen.tolist()))]})

    return _by_part(spark, sf_dir, one, "part int, size long")


@register("VEC12_symmetric_polynomials", """with x as (select l_orderkey as k, (l_quantity::int % 5)::double as x from lineitem), p as (select k, sum(x) as p1, sum(x * x) as p2, sum(x * x * x) as p3 from x group by k)
select k as l_orderkey, p1 as e1, (p1 * p1 - p2) / 2 as e2, round((p1 * p1 * p1 - 3 * p1 * p2 + 2 * p3) / 6, 6) as e3 from p""")
def vec12(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_quantity").cast("int") % 5).cast("double")).alias("x"))

    @F.pandas_udf("array<double>")
    def sums(values: pd.Series) -> pd.Series:
        return pd.Series([sdpp.elementary_symmetric(np.asarray(x), 3)[1:, -1].tolist() for x in values])

    return rows.select("l_orderkey", sums("x").alias("e")).select("l_orderkey", *[F.round(F.get("e", F.lit(k)), 6).alias(f"e{k + 1}") for k in range(3)])


@register("VEC13_kernel_decomposition", f"with {_PARTED} select part, max(len(vec))::int as dims, round(sum(list_sum(list_transform(vec, lambda x: x * x))), 3) as trace, true as exact from parted group by part")
def vec13(spark, sf_dir):
    """The dual kernel of each part: its dims, the sum of its eigenvalues, and whether they give the kernel back."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["vec"].to_numpy()).astype(float)
        values, vectors = sdpp.decompose(v.T @ v)
        error = float(np.abs(vectors * values @ vectors.T - v.T @ v).max())
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "dims": [len(values)], "trace": [round(float(values.sum()), 3)], "exact": [error < 1e-8]})

    return _by_part(spark, sf_dir, one, "part int, dims int, trace double, exact boolean")


def _docx(spark, sf_dir):
    """A word file for each customer: three paragraphs, and a comment on the first two for every other one."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), "c_name", "c_mktsegment", (F.col("c_custkey") % 2 == 0).alias("noted"))

    def make(batches):
        for batch in batches:
            files = [D.make_docx([name, "a & b", segment], [(0, 1, f"Type: {segment}")] if noted else []) for name, segment, noted in zip(batch["c_name"], batch["c_mktsegment"], batch["noted"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": files})

    return rows.mapInPandas(make, "doc_id string, content binary")


@register("SRC01_docx_scan", "select n_name || '#w' as doc_id, 2::bigint as paragraphs from nation")
def src01(spark, sf_dir):
    """Word files in folders below one, a file of metadata beside each: the former are found and read, the latter left out."""
    path = _folder(spark, "scan")
    for r in table(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect():  # 25 rows, as files
        for end in ("", "meta"):
            S.put_bytes(spark, f"{path}/{r['n_regionkey']}/{r['n_name']}#wc{end}.docx", D.make_docx([r["n_name"], f"Region {r['n_regionkey']}"]))
    files = D.read_docx(spark, path, "*#wc*.docx", "*#wcmeta.docx").withColumn("doc_id", F.regexp_replace("doc_id", "c$", ""))
    return D.docx_paragraphs(files).groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


@register("SRC19_cached_download", "select n_nationkey, n_name from nation")
def src19(spark, sf_dir):
    """A file by its address from the cache: the second call finds the copy of the first, a changed file is another entry."""
    path, cache = _folder(spark, "remote"), _folder(spark, "cache")
    rows = table(spark, sf_dir, "nation").select(F.concat_ws("|", "n_nationkey", "n_name").alias("value"))
    S.put_bytes(spark, f"{path}/names.txt", b"0|OLD\n")
    old = S.cached_path(spark, f"{path}/names.txt", cache)
    S.put_bytes(spark, f"{path}/names.txt", "\n".join(r["value"] for r in rows.collect()).encode())  # 25 rows, as a file
    found = S.cached_path(spark, f"{path}/names.txt", cache)
    if found == old or S.cached_path(spark, f"{path}/names.txt", cache) != found or S.entry_source(spark, found)[0] != f"{path}/names.txt":
        raise RuntimeError("the cache gave another copy than the address and its version name")
    parts = F.split("value", r"\|")
    return spark.read.text(found).select(parts[0].cast("int").alias("n_nationkey"), parts[1].alias("n_name"))


@register("SRC22_mock_data", "select doc_id, date '2000-01-01' + (('0x' || substr(md5(doc_id), 1, 8))::bigint % 3650)::int as created, (('0x' || substr(md5(doc_id), 9, 8))::bigint % 2 = 0)::int as label from (select doc_id::varchar as doc_id from documents)")
def src22(spark, sf_dir):
    return S.mock_labels(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id")))


@register("SRC02_docx_paragraphs", "select c_custkey::varchar as doc_id, idx, case idx when 0 then c_name when 1 then 'a & b' else c_mktsegment end as text, null::varchar as error from customer, (values (0), (1), (2)) i(idx)")
def src02(spark, sf_dir):
    return D.docx_paragraphs(_docx(spark, sf_dir))


@register("SRC03_docx_comments", """select c_custkey::varchar as doc_id, '[{"extents":[{"startPara":0,"endPara":1}],"author":"a","text":"Type: ' || c_mktsegment || '"}]' as json from customer where c_custkey % 2 = 0""")
def src03(spark, sf_dir):
    return D.annotations_json(D.docx_comments(_docx(spark, sf_dir)))


@register("SRC04_comment_scan", "select c_custkey::varchar as doc_id, '0' as comment_id, 'a' as author, 'Type: ' || c_mktsegment as text from customer where c_custkey % 2 = 0")
def src04(spark, sf_dir):
    return D.docx_comments(_docx(spark, sf_dir)).select("doc_id", "comment_id", "author", "text")


@register("SRC05_comment_ranges", "select c_custkey::varchar as doc_id, '0' as comment_id, idx, case idx when 0 then c_name else 'a & b' end as text from customer, (values (0), (1)) i(idx) where c_custkey % 2 = 0")
def src05(spark, sf_dir):
    """The paragraphs that each comment spans."""
    files = materialize(_docx(spark, sf_dir), "word-files")
    notes = D.docx_comments(files).select("doc_id", "comment_id", F.explode(F.sequence("start", "end")).alias("idx"))
    return notes.join(D.docx_paragraphs(files), ["doc_id", "idx"]).select("doc_id", "comment_id", "idx", "text")


def _conll(spark, sf_dir):
    """Conversations as corpus tokens: every fifth word an entity named by its length."""
    words = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.lit("000").alias("part"), F.col("turn").cast("int").alias("utt"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("tok", "word"))
    return words.withColumn("coref", F.when(F.col("tok") % 5 == 0, F.concat(F.lit("("), F.length("word").cast("string"), F.lit(")"))).otherwise("-"))


@register("SRC15_conll_scan", """select conv_id::varchar as doc, turn::int as utt, count(*)::bigint as tokens from (select conv_id, turn, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as w from conversations) group by all""")
def src15(spark, sf_dir):
    path = _folder(spark, "conll")
    D.write_conll(_conll(spark, sf_dir), path)
    return D.read_conll(spark, path).groupBy("doc", "utt").agg(F.count("*").alias("tokens"))


_CORPUS = r"""with t as (select conv_id::varchar as doc, turn::int as utt, unnest(w) as word, unnest(range(0, len(w)))::int as tok from (select conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from conversations))"""


@register("SRC16_corpus_scan", f"""{_CORPUS} select doc, '000' as part, utt, length(word)::varchar as label, tok as start, tok as "end" from t where tok % 5 = 0""")
def src16(spark, sf_dir):
    path = _folder(spark, "conll")
    D.write_conll(_conll(spark, sf_dir), path)
    return D.conll_mentions(D.read_conll(spark, path))


@register("SRC17_response_file", f"""{_CORPUS} select '#begin document (' || doc || '); part 000' as value from (select distinct doc from t) union all select '#end document' from (select distinct doc from t)
union all select '' from (select distinct doc, utt from t) union all select concat_ws(chr(9), doc, '000', tok, word, case when tok % 5 = 0 then '(' || length(word) || ')' else '-' end) from t""")
def src17(spark, sf_dir):
    path = _folder(spark, "response")
    D.write_conll(_conll(spark, sf_dir), path)
    return spark.read.text(path)


@register("SRC18_feature_tables", f"{_FEAT} select doc, ant, men, exact from feat")
def src18(spark, sf_dir):
    from strand.queries.coref import features_of

    path = _folder(spark, "features")
    features_of(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path).select("doc", "ant", "men", "exact")


@register("SRC23_embedding_file", "select vec_id::varchar as word, 64::int as dims from embeddings")
def src23(spark, sf_dir):
    path = _folder(spark, "vectors")
    rows = table(spark, sf_dir, "embeddings")
    rows.select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("value")).write.text(path)
    return D.read_embeddings(spark, path).select("word", F.size("vec").alias("dims"))


@register("SRC25_merged_results", f"select *, 'first wins' as run from ({registry.oracle_sql()['AGG02_evaluation']}) union all by name select *, 'all threads' as run from ({registry.oracle_sql()['AGG20_evaluation_all_threads']})")
def src25(spark, sf_dir):
    from strand.queries.threads import _rounded, labelled_members

    own = labelled_members(spark, sf_dir)  # found once, evaluated twice
    return _rounded(threads.evaluation(own)).withColumn("run", F.lit("first wins")).unionByName(_rounded(threads.evaluation(own, unique=False)).withColumn("run", F.lit("all threads")))


_MLP = """with e as (select vec_id, embedding::double[] as x from embeddings), h as (
  select vec_id, list_transform(range(0, 16), lambda j: greatest(0.0, (j % 3 - 1) / 4.0 + list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * ((i * 7 + j * 3) % 11 - 5) / 8.0)))) as h from e
) select vec_id, round(0.5 + list_sum(list_transform(range(0, 16), lambda j: h[j + 1] * ((j * 5) % 7 - 3) / 4.0)), 4) as score from h"""


def _layers():
    i, j = np.arange(64)[:, None], np.arange(16)[None, :]
    return [(((i * 7 + j * 3) % 11 - 5) / 8, (np.arange(16) % 3 - 1) / 4), ((((np.arange(16) * 5) % 7 - 3) / 4)[:, None], np.array([0.5]))]


@register("COR05_mlp_scores", _MLP)
def cor05(spark, sf_dir):
    from strand.operators import coref

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return coref.mlp_scores(rows, _layers()).select("vec_id", F.round("score", 4).alias("score"))


@register("SRC21_model_files", _MLP)
def src21(spark, sf_dir):
    """The scorer and its vectors written, read back and used: the scores of the model that never was a file."""
    from strand.operators import coref

    path = _folder(spark, "model")
    S.save_model(spark, path, _layers(), table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), {"greedyness": 0.5})
    layers, vectors, _ = S.load_model(spark, path)
    return coref.mlp_scores(vectors, layers).select("vec_id", F.round("score", 4).alias("score"))


@register("TRN03_training", "select stage, 4::bigint as epochs, true as falls from (values ('all_pairs'), ('top_pairs'), ('ranking')) s(stage)")
def trn03(spark, sf_dir):
    """Three stages of training on all pairs of conversations; within each the loss ends below its start."""
    from strand.operators import training
    from strand.queries.coref import features_of

    names = ("same_speaker", "exact", "mention_bin", "sent_bin")
    rows = materialize(training.training_rows(features_of(spark, sf_dir).withColumn("gold", F.col("relaxed")), names), "training-rows")
    found = training.train_scorer(rows, names, {"all_pairs": 4, "top_pairs": 4, "ranking": 4})
    seen = spark.createDataFrame(found.history, "stage string, epoch int, loss double, rate double")
    return seen.groupBy("stage").agg(F.count("*").alias("epochs"), (F.min("loss") <= F.min_by("loss", "epoch")).alias("falls"))


@register("TRN05_corpus_features", f"""{_CORPUS}, m as (select doc, (row_number() over (partition by doc order by utt, tok) - 1)::int as i, lower(word) as content, length(word) as label from t where tok % 5 = 0)
select a.doc, a.i as ant, b.i as men, (a.content = b.content)::int as exact, (a.label = b.label)::int as gold from m a join m b on a.doc = b.doc and a.i < b.i and (b.i - a.i <= 10 or (a.content = b.content and b.i - a.i <= 30))""")
def trn05(spark, sf_dir):
    """Corpus tokens to mentions to pairs to labelled features, one composition."""
    from strand.operators import coref

    tokens = _conll(spark, sf_dir)
    spans = D.conll_mentions(tokens).join(tokens.select("doc", "utt", F.col("tok").alias("start"), "word"), ["doc", "utt", "start"])
    rows = spans.select("doc", F.col("utt").alias("sent"), "start", (F.col("end") + 1).alias("end"), F.lit("s").alias("speaker"), F.col("word").alias("root"), F.col("word").alias("text"), F.array(F.lower("word")).alias("words"), "label")
    m = materialize(coref.with_ordinals(rows, "sent", "start"), "corpus-mentions")
    gold = m.select("doc", "i", "label")
    feats = coref.pair_features(coref.candidate_pairs(m, 10, 30), m)
    return feats.join(gold.select("doc", F.col("i").alias("ant"), F.col("label").alias("la")), ["doc", "ant"]).join(gold.select("doc", F.col("i").alias("men"), F.col("label").alias("lm")), ["doc", "men"]).select("doc", "ant", "men", "exact", (F.col("la") == F.col("lm")).cast("int").alias("gold"))


def _some(spark, sf_dir):
    return passages_of(spark, sf_dir).select("doc_id", "text")


@register("NLP01_answer_run")
def nlp01(spark, sf_dir):
    """Answers in batches that can be resumed: what is there already isn't extracted again."""
    rows, path = _some(spark, sf_dir), _folder(spark, "answers")
    half = F.col("doc_id").endswith("1")
    fivew.answers(rows.filter(half), BASE).write.parquet(path)
    done = spark.read.parquet(path)
    fivew.answers(rows.join(done.select("doc_id"), "doc_id", "left_anti"), BASE).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@register("NLP02_annotate_extract")
def nlp02(spark, sf_dir):
    return fivew.answers(_some(spark, sf_dir), BASE)


@register("NLP03_master_extractor")
def nlp03(spark, sf_dir):
    found = fivew.answers(_some(spark, sf_dir), BASE)
    return found.select([F.sum((F.col(q) != "").cast("long")).alias(q) for q in fivew.QUESTIONS])


@register("NLP04_environment_extractor", "select o_orderkey::varchar as doc_id, question, 0 as rank, case question when 'where' then n_name else o_orderdate::date::varchar end as answer from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey, (values ('where'), ('when')) q(question)")
def nlp04(spark, sf_dir):
    """Where and when of sentences that name a place twice and two neighbouring days: one answer each."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    day = F.to_date("o_orderdate")
    text = F.format_string("It was ordered on %s in %s and on %s it was paid in %s too.", F.date_format(day, "d MMMM yyyy"), F.col("n_name"), F.date_format(F.date_add(day, 1), "d MMMM yyyy"), F.col("n_name"))
    return fivew.environment(rows.select(F.col("o_orderkey").cast("string").alias("doc_id"), text.alias("text")), BASE).drop("score")


@register("NLP06_constituents", "select conv_id || '-' || turn as doc_id, true as whole from conversations where text is not null")
def nlp06(spark, sf_dir):
    """A tree for each sentence; the trees' leaves are the text's tokens, in order."""
    rows = table(spark, sf_dir, "conversations").filter("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    trees = fivew.constituents(rows)
    order = F.transform(F.array_sort(F.collect_list(F.struct("sent", "tree"))), lambda x: x["tree"])
    leaves = F.flatten(F.transform(order, lambda t: F.regexp_extract_all(t, F.lit(r"\([^ ()]+ ([^ ()]+)\)"), F.lit(1))))
    words = fivew.token_rows(rows).select("doc_id", F.transform("tokens", lambda t: F.when(t["word"] == "(", "-LRB-").when(t["word"] == ")", "-RRB-").otherwise(t["word"])).alias("words"))
    return trees.groupBy("doc_id").agg(leaves.alias("leaves")).join(words, "doc_id").select("doc_id", (F.col("leaves") == F.col("words")).alias("whole"))


@register("NLP05_token_builder")
def nlp05(spark, sf_dir):
    return fivew.token_rows(_some(spark, sf_dir)).select("doc_id", F.explode("tokens").alias("t")).select("doc_id", "t.*")


@register("COR01_mention_spans")
def cor01(spark, sf_dir):
    return fivew.mention_spans(fivew.token_rows(_some(spark, sf_dir)))


def _stream(spark, df, name: str, files: int = 3):
    path = _folder(spark, name)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@register("STM01_ledger_stream", "select doc_id, length(text)::bigint as n from documents where text is not null")
def stm01(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    out = _folder(spark, "ledger")
    size = lambda df: df.select("doc_id", F.length("text").cast("long").alias("n"))
    for run in ("first", "again"):  # the second run finds every id in the ledger
        jobs.ledger_stream(_stream(spark, rows, "feed"), size, out, _folder(spark, f"offsets-{run}")).awaitTermination()
    return spark.read.parquet(out)


@register("STM02_growing_graph", registry.oracle_sql()["GRF05_npc_communities"])
def stm02(spark, sf_dir):
    out = _folder(spark, "growing")
    jobs.growing_graph(_stream(spark, items(spark, sf_dir).select("part", "pos", "vec"), "items"), out, _folder(spark, "offsets")).awaitTermination()
    return jobs.communities(spark, out).select("node", "comm")


_LINKED = r"""with w as (select conv_id, turn, unnest(list_distinct(list_filter(list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: regexp_matches(x, '^\p{Lu}')), lambda x: trim(x, '.,;:!?')), lambda x: x <> ''))) as word from conversations)
select conv_id, turn, word, lag(turn) over (partition by conv_id, word order by turn) as antecedent_turn from w"""


@register("STM03_dialogue_stream", _LINKED)
def stm03(spark, sf_dir):
    """Utterances of a stream resolved against the turns kept in state; one file, so the order is the turns'."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = _folder(spark, "dialogue")
    query = jobs.resolve_dialogue(_stream(spark, rows, "utterances", 1)).writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "offsets")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


@register("COR09_dialogue_resolution", _LINKED)
def cor09(spark, sf_dir):
    """The same by one batch call."""
    return jobs.resolve_dialogue(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
