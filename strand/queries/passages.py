"""Queries on passages, sections, projections, filters and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strand.functions import text as T
from strand.operators import passages as op
from strand.plans.cut import materialize, shared_dir
from strand.queries.tables import LINES, PASSAGES, table
from strand.queries.tables import passages as passages_of
from strand.registry import register

_P = f"with {PASSAGES}"


def lines_of(spark, sf_dir):
    return op.split_passages(table(spark, sf_dir, "documents"), None, None)


@register("FLT01_passage_length", f"{_P} select doc_id, length(text)::bigint as chars from passages")
def flt01(spark, sf_dir):
    return passages_of(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("chars"))


@register("PRJ01_passage_id", f"{_P} select source_id, idx::int as idx, doc_id from passages")
def prj01(spark, sf_dir):
    return passages_of(spark, sf_dir).select("source_id", "idx", "doc_id")


@register("PRJ02_ascii_text")
def prj02(spark, sf_dir):
    return passages_of(spark, sf_dir).select("doc_id", T.to_ascii(F.col("text")).alias("text"))


@register("STR11_accent_fold")
def str11(spark, sf_dir):
    return passages_of(spark, sf_dir).select("doc_id", F.lower(T.to_ascii(F.col("text"))).alias("text"))


_DONE = "done as (select doc_id from passages where source_id % 3 = 0)"


@register("FLT02_unprocessed", f"{_P}, {_DONE} select doc_id from passages where doc_id not in (select doc_id from done)")
def flt02(spark, sf_dir):
    rows = passages_of(spark, sf_dir)
    return op.unprocessed(rows, rows.filter("source_id % 3 = 0")).select("doc_id")


@register("JOIN03_anti_join", f"{_P}, {_DONE} select source_id, count(*)::bigint as left_over from passages where doc_id not in (select doc_id from done) group by source_id")
def join03(spark, sf_dir):
    return flt02(spark, sf_dir).select(F.substring_index("doc_id", "_", 1).cast("long").alias("source_id")).groupBy("source_id").agg(F.count("*").alias("left_over"))


@register("JOIN02_semi_join", f"{_P}, {_DONE} select doc_id, row_number() over (order by source_id, idx) - 1 as pos from passages where doc_id in (select doc_id from done)")
def join02(spark, sf_dir):
    rows = passages_of(spark, sf_dir)
    kept = rows.join(rows.filter("source_id % 3 = 0").select("doc_id"), "doc_id", "left_semi")
    return op.with_position(kept, None, "source_id", "idx").select("doc_id", "pos")


@register("FLT03_length_guard", "select doc_id from documents where coalesce(len(string_split_regex(trim(text), '\\s+')), 0) > 2000 or length(text) > 99980")
def flt03(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.filter((F.size(F.split(F.trim("text"), r"\s+")) > 2000) | (F.length("text") > 99980)).select("doc_id")


_ANSWERS = """answers as (
  select p_partkey, split_part(p_name, ' ', 1) as who, case when p_size % 2 = 0 then p_brand else '' end as what, '' as "when",
    case when p_size % 3 = 0 then p_type else '' end as "where", '' as why, p_brand as how from part
)"""


@register("PRJ03_pseudo_passage", f"""with {_ANSWERS} select p_partkey, array_to_string(list_filter([who, what, "when", "where", why, how], lambda x: x <> ''), '. ') as text from answers""")
def prj03(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(
        "p_partkey", F.split("p_name", " ")[0].alias("who"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("what"), F.lit("").alias("when"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("").alias("where"), F.lit("").alias("why"), F.col("p_brand").alias("how"),
    )
    return rows.select("p_partkey", op.pseudo_passage("who", "what", "when", "where", "why", "how").alias("text"))


@register("PRJ06_data_split", "select doc_id, text from documents where doc_id % 2 = 0")
def prj06(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", "text")


@register("PRJ07_thread_pattern", "select p_partkey, emb || case when p_size % 2 = 0 then '_time' else '' end || case when p_size % 3 = 0 then '_ent' else '' end || '_npc' as name from (select p_partkey, p_size, case when p_partkey % 2 = 0 then 'tfidf' else 'lsa' end as emb from part)")
def prj07(spark, sf_dir):
    """Names of runs, one a part, from its options."""
    from strand.params import thread_pattern

    names = F.create_map(*[x for e in ("tfidf", "lsa") for t in (True, False) for n in (True, False) for x in (F.lit(f"{e}{t}{n}".lower()), F.lit(thread_pattern(e, t, n)))])
    emb = F.when(F.col("p_partkey") % 2 == 0, "tfidf").otherwise("lsa")
    key = F.concat(emb, (F.col("p_size") % 2 == 0).cast("string"), (F.col("p_size") % 3 == 0).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, key).alias("name"))


_SPEAKERS = """select conv_id, turn, case when turn % 5 = 0 then role else ((turn + 1) % 2)::varchar end as speaker from conversations"""


@register("PRJ08_default_speakers", _SPEAKERS)
def prj08(spark, sf_dir):
    named = F.when(F.col("turn") % 5 == 0, F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(named, ((F.col("turn") + 1) % 2).cast("string")).alias("speaker"))


@register("WIN06_row_position", f"{_P}, r as (select doc_id, row_number() over (order by source_id, idx) - 1 as pos from passages) select doc_id, pos, (pos // 1000)::int as part from r")
def win06(spark, sf_dir):
    return op.with_part(op.with_position(passages_of(spark, sf_dir), None, "source_id", "idx"), 1000).select("doc_id", "pos", "part")


@register("SRC12_parts", f"{_P}, r as (select row_number() over (order by source_id, idx) - 1 as pos from passages) select (pos // 1000)::int as part, min(pos) as start, max(pos) + 1 as \"end\" from r group by 1")
def src12(spark, sf_dir):
    return op.parts_table(op.with_part(op.with_position(passages_of(spark, sf_dir), None, "source_id", "idx"), 1000))


@register("SRT01_passage_order", f"{_P}, r as (select doc_id, row_number() over (order by source_id, doc_id) - 1 as pos from passages) select doc_id, pos from r")
def srt01(spark, sf_dir):
    return op.with_position(passages_of(spark, sf_dir), None, "source_id", "doc_id").select("doc_id", "pos")


@register("JOIN07_aligned_lookup", f"{_P}, r as (select doc_id, source_id, row_number() over (order by source_id, idx) - 1 as pos from passages) select r.pos, r.doc_id, d.lang from r join documents d on d.doc_id = r.source_id")
def join07(spark, sf_dir):
    rows = op.with_position(passages_of(spark, sf_dir), None, "source_id", "idx")
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "lang")
    return rows.join(langs, "source_id").select("pos", "doc_id", "lang")


@register("JOIN08_positional_zip", f"{_P}, a as (select row_number() over (order by source_id, idx) - 1 as pos, doc_id from passages), b as (select row_number() over (order by vec_id) - 1 as pos, vec_id from embeddings) select pos, doc_id, vec_id from a join b using (pos)")
def join08(spark, sf_dir):
    left = op.with_position(passages_of(spark, sf_dir), None, "source_id", "idx").select("pos", "doc_id")
    right = op.with_position(table(spark, sf_dir, "embeddings").select("vec_id"), None, "vec_id")
    return left.join(right, "pos").select("pos", "doc_id", "vec_id")


#: Lines of documents as those of a paragraph file: every fourth line is blank, line 2 ends the attributes.
_CCD = f"""with {LINES}, ccd as (
  select source_id as doc_id, idx::int as idx, case when idx = 0 then 'Document Date: ' || (date '2000-01-01' + source_id::int)::varchar when idx = 2 then 'END' when idx % 4 = 3 then ' ' else text end as text from lines
)"""


def ccd_lines(spark, sf_dir):
    date = F.concat(F.lit("Document Date: "), F.date_add(F.to_date(F.lit("2000-01-01")), F.col("source_id").cast("int")).cast("string"))
    text = F.when(F.col("idx") == 0, date).when(F.col("idx") == 2, "END").when(F.col("idx") % 4 == 3, " ").otherwise(F.col("text"))
    return lines_of(spark, sf_dir).select(F.col("source_id").alias("doc_id"), "idx", text.alias("text"))


_BODY = _CCD + """, body as (
  select doc_id, idx, text, (select max(replace(c2.text, 'Document Date: ', '')) from ccd c2 where c2.doc_id = ccd.doc_id and c2.text like 'Document Date:%') as created_text
  from ccd where idx > 2
)"""
_ISLANDS = _BODY + r""", m as (
  select *, trim(text) = '' as blank, sum((trim(text) = '')::int) over (partition by doc_id order by idx) as gap, sum((trim(text) = '')::int) over (partition by doc_id) as gaps from body
), isl as (
  select doc_id, gap, min(idx) as first_idx, max(idx) as last_idx, trim(regexp_replace(string_agg(text, '' order by idx), ' +', ' ', 'g')) as text from m where not blank and gap < gaps group by doc_id, gap
), numbered as (select doc_id, (row_number() over (partition by doc_id order by gap) - 1)::int as island, first_idx, last_idx, text from isl)"""


@register("WIN02_section_flag", _BODY + " select doc_id, idx, created_text from body")
def win02(spark, sf_dir):
    return op.sections(ccd_lines(spark, sf_dir)).select("doc_id", "idx", "created_text")


@register("WIN01_line_islands", _ISLANDS + " select doc_id, island, first_idx, last_idx, text from numbered")
def win01(spark, sf_dir):
    return op.islands(op.sections(ccd_lines(spark, sf_dir)))


@register("SRC06_document_text", _BODY + " select doc_id, string_agg(text, '' order by idx) as text from body group by doc_id")
def src06(spark, sf_dir):
    body = op.sections(ccd_lines(spark, sf_dir))
    order = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return body.groupBy("doc_id").agg(F.array_join(F.transform(order, lambda x: x["text"]), "").alias("text"))


_EXTENTS = "extents as (select doc_id, 5 as start, 7 as \"end\" from documents where doc_id % 2 = 0)"


def _extents(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", F.lit(5).alias("start"), F.lit(7).alias("end"))


@register("JOIN09_interval_join", _ISLANDS + f', {_EXTENTS} select distinct n.doc_id, n.island from numbered n join extents e on e.doc_id = n.doc_id and n.first_idx <= e."end" and e.start <= n.last_idx')
def join09(spark, sf_dir):
    return op.labelled(op.islands(op.sections(ccd_lines(spark, sf_dir))), _extents(spark, sf_dir)).filter("label = 1").select("doc_id", "island")


@register("SRC07_labelled_passages", _ISLANDS + f', {_EXTENTS} select n.doc_id, n.island, n.text, exists (select 1 from extents e where e.doc_id = n.doc_id and n.first_idx <= e."end" and e.start <= n.last_idx)::int as label from numbered n')
def src07(spark, sf_dir):
    return op.labelled(op.islands(op.sections(ccd_lines(spark, sf_dir))), _extents(spark, sf_dir)).select("doc_id", "island", "text", "label")


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/strand/io-{name}-{uuid.uuid4().hex}"


@register("SRC08_jsonl", "select doc_id, lang, source from documents")
def src08(spark, sf_dir):
    from strand.sources import files

    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return files.round_trip_jsonl(rows, _folder(spark, "jsonl"))


@register("SRC09_dict_dump", "select key, arg_max(value, n) as value from (select source as key, lang as value, doc_id as n from documents) group by key")
def src09(spark, sf_dir):
    from strand.sources import files

    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("lang").alias("value"), F.col("doc_id").alias("n"))
    path = _folder(spark, "dict")
    files.append_dict(rows.filter("n % 2 = 0"), path)
    files.append_dict(rows.filter("n % 2 = 1"), path)
    return files.read_dict_dump(spark, path, "key string, value string, n long", "key", "n").select("key", "value")


@register("SRC10_text_lines", "select unnest(string_split(text, chr(10))) as line from documents where text is not null")
def src10(spark, sf_dir):
    from strand.sources import files

    path = _folder(spark, "text")
    files.write_lines(table(spark, sf_dir, "documents").filter("text is not null").select("text"), path)
    return files.read_lines(spark, path).withColumnRenamed("value", "line")


@register("SRC11_key_value", "select p_partkey::varchar as key, p_name as value from part")
def src11(spark, sf_dir):
    from strand.sources import files

    path = _folder(spark, "kv")
    files.write_pairs(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("value")), path)
    return files.read_pairs(spark, path)


@register("SRC20_text_set", "select distinct lang as value from documents")
def src20(spark, sf_dir):
    from strand.sources import files

    path = _folder(spark, "set")
    files.write_lines(table(spark, sf_dir, "documents").select("lang"), path)
    return files.read_set(spark, path)


@register("SRC14_matrix_tables", "select 1::int as part, vec_id as pos from embeddings where vec_id % 4 = 1")
def src14(spark, sf_dir):
    """Vectors as a table partitioned by part, read back with only the wanted part's files."""
    path = _folder(spark, "matrix")
    table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).cast("int").alias("part"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec")).write.partitionBy("part").parquet(path)
    return spark.read.parquet(path).filter("part = 1").select("part", "pos")


@register("SRC26_sentence_listing", f"with {LINES} select '#begin ' || source_id as value from (select distinct source_id from lines) union all select '#end' from (select distinct source_id from lines) union all select text from lines")
def src26(spark, sf_dir):
    from strand.sources import files

    rows = lines_of(spark, sf_dir)
    path = _folder(spark, "sentences")
    files.write_framed(rows.select(F.col("source_id").alias("doc"), F.col("idx").alias("ord"), "text"), path)
    return files.read_lines(spark, path)


@register("SRC13_config", "select n_nationkey, n_nationkey::double as alpha, 0.2::double as gamma, '/data/threads/emb_' || n_name as path from nation")
def src13(spark, sf_dir):
    """A configuration file for each nation: written, read back, overridden; unknown keys and empty overrides change nothing."""
    from dataclasses import asdict

    from strand.params import HyperParams, Paths

    path = _folder(spark, "config")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").cast("double").alias("alpha"), F.col("n_name").alias("unknown"))).alias("params"), "n_name")
    rows.write.json(path)
    out = []
    for r in spark.read.json(path).collect():  # 25 files' worth
        own = asdict(HyperParams.from_json(r["params"]).with_overrides(gamma=0.2, max_common_ent=None))
        out.append((r["n_nationkey"], float(own["alpha"]), float(own["gamma"]), Paths("/data").of("threads", emb=r["n_name"], time=None)))
    return spark.createDataFrame(out, "n_nationkey long, alpha double, gamma double, path string")


@register("STM05_memo_table", "select lang, count(*)::bigint as docs from documents group by lang")
def stm05(spark, sf_dir):
    from strand.plans.cut import memo

    path = _folder(spark, "memo")
    build = lambda: table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"))
    memo(spark, path, build)
    return memo(spark, path, lambda: build().filter("false"))


@register("AGG21_vocabulary_counter", f"{_P}, t as (select unnest(string_split_regex(text, '\\s+')) as word from passages) select word, count(*)::bigint as n from t where word <> '' group by word")
def agg21(spark, sf_dir):
    return passages_of(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@register("SET02_span_union", "select doc_id, n_chars from documents where doc_id % 2 = 0 union select doc_id, n_chars from documents where doc_id % 3 = 0")
def set02(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.filter("doc_id % 2 = 0").union(docs.filter("doc_id % 3 = 0")).distinct()


@register("SET03_word_overlap", f"{_P} select source_id, list_has_any(string_split(min(text), ' '), string_split(max(text), ' ')) as shares from passages group by source_id")
def set03(spark, sf_dir):
    return passages_of(spark, sf_dir).groupBy("source_id").agg(F.arrays_overlap(F.split(F.min("text"), " "), F.split(F.max("text"), " ")).alias("shares"))


@register("SET04_symmetric_difference", f"{_P}, w as (select source_id, string_split(min(text), ' ') as a, string_split(max(text), ' ') as b from passages group by source_id) select source_id, len(list_distinct(list_filter(a, lambda x: not list_contains(b, x))))::bigint as only_a, len(list_distinct(list_filter(b, lambda x: not list_contains(a, x))))::bigint as only_b from w")
def set04(spark, sf_dir):
    rows = passages_of(spark, sf_dir).groupBy("source_id").agg(F.split(F.min("text"), " ").alias("a"), F.split(F.max("text"), " ").alias("b"))
    return rows.select("source_id", F.size(F.array_except("a", "b")).cast("long").alias("only_a"), F.size(F.array_except("b", "a")).cast("long").alias("only_b"))


@register("STM04_batched_pipe", "select doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))::bigint as words from documents")
def stm04(spark, sf_dir):
    """An iterator function over mini-batches of 128 rows: how many rows each document's batch had."""
    import pandas as pd

    def pipe(batches):
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.iloc[lo : lo + 128]
                yield pd.DataFrame({"doc_id": part["doc_id"], "words": part["text"].fillna("").str.split().str.len()})

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(pipe, "doc_id long, words long")


@register("WIN14_length_batches", "select doc_id, source, floor((sum(n_chars) over (partition by source order by n_chars, doc_id) - 1) / 20000)::int as batch from documents")
def win14(spark, sf_dir):
    """Documents sorted by size within a source and cut where the running size passes the batch size."""
    running = F.sum("n_chars").over(Window.partitionBy("source").orderBy("n_chars", "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.floor((running - 1) / 20000).cast("int").alias("batch"))
