"""Queries over the derived inputs, by name; their DuckDB counterparts are in `oracles`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import replies, text
from dialoom.operators import pairs, segment, stats
from dialoom.operators.ledger import Ledger
from dialoom.operators.long_blocks import long_blocks
from dialoom.operators.responders import ReplayResponder, RuleResponder, prompt_key
from dialoom.plans import fixtures, pipeline
from dialoom.plans.config import Config, load_config
from dialoom.sources import documents, jsonl
from dialoom.sources.paged import TextPages, paged_source
from dialoom.streaming import blocks as streaming

Query = Callable[[SparkSession, str], DataFrame]


def layout_paragraphs(spark, sf_dir):
    return documents.layout_paragraphs(fixtures.layout(spark, sf_dir)).select("doc_id", F.col("blk_no").cast("long").alias("blk_no"), "text")


def document_text(spark, sf_dir):
    return documents.joined_parts(fixtures.line_parts(spark, sf_dir))


def layout_text(spark, sf_dir):
    return documents.document_text(fixtures.layout(spark, sf_dir))


def paragraph_split(spark, sf_dir):
    spaced = documents.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" \n\n\u3000"), F.replace("text", F.lit("\n"), F.lit("\n\n \n\n")), F.lit("\n \nend")).alias("text"))
    return spaced.select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("para_no", "text")).withColumn("para_no", F.col("para_no").cast("long"))


def page_text(spark, sf_dir):
    return documents.page_text(fixtures.layout(spark, sf_dir)).select("doc_id", F.col("page_no").cast("long").alias("page_no"), "page_text")


def document_info(spark, sf_dir):
    """Figures of documents by the library's own facts: pages, layout blocks, paragraphs and characters."""
    blocks = fixtures.layout(spark, sf_dir).withColumn("page_count", F.lit(1))
    facts = documents.document_facts(blocks).select("doc_id", F.col("pages").cast("long").alias("page_count"))
    filled = documents.layout_paragraphs(blocks).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_paragraphs"))
    sizes = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.char_length("text")).alias("n_chars"))
    return facts.join(sizes, "doc_id").join(filled, "doc_id", "left").select("doc_id", "page_count", "n_blocks", F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), "n_chars")


def _blocks(max_size: int, min_size: int, interview: bool = False) -> Query:
    def query(spark, sf_dir):
        parts = fixtures.transcript_parts(spark, sf_dir) if interview else fixtures.line_parts(spark, sf_dir)
        return segment.blocks(parts, "parts", ["doc_id"], max_size=max_size, min_size=min_size)

    return query


#: Blocks of transcripts that most queries start from.
interview_blocks = _blocks(600, 100, True)


def blocks_dropped(spark, sf_dir):
    return _blocks(1500, 0)(spark, sf_dir).where(F.char_length("block") < 100)


def blocks_long(spark, sf_dir):
    """The same blocks from paragraph rows, a document dealt over segments of sixteen."""
    paras = fixtures.line_parts(spark, sf_dir).select("doc_id", F.posexplode("parts").alias("para_no", "text"))
    return long_blocks(paras, segment_rows=16)


def normalize_markers(spark, sf_dir):
    padded = F.concat("para", F.lit("\n \n\t\n\n"), F.lit("阶段:"), "para")
    return fixtures.transcript(spark, sf_dir).select("doc_id", "turn", text.normalize_markers(padded).alias("text"))


def has_qa(spark, sf_dir):
    return interview_blocks(spark, sf_dir).select("doc_id", "seg_no", text.has_qa(F.col("block")).alias("has_qa"))


def has_qa_parts(spark, sf_dir):
    block = F.concat(F.when(F.col("seg_no") % 3 == 0, "听说").otherwise(""), "block")
    return interview_blocks(spark, sf_dir).select(
        "doc_id", "seg_no", text.asks_directly(block).alias("direct"), text.asks_indirectly(block).alias("indirect"), text.answers(block).alias("answer"))


def sample_prefix(spark, sf_dir):
    return segment.index_blocks(segment.sample_prefix(interview_blocks(spark, sf_dir), 0.5))


def _filtered(spark, sf_dir):
    config = Config(max_block_size=600, min_block_size=100, enable_qa_filter=True, extract_ratio=0.5)
    return pipeline.surviving_blocks(fixtures.transcript_parts(spark, sf_dir), config)


def filter_then_sample(spark, sf_dir):
    return _filtered(spark, sf_dir)


def prompts(spark, sf_dir):
    asked = pipeline.prompts(_filtered(spark, sf_dir))
    return asked.select("doc_id", "block_idx", F.sha2("prompt", 256).alias("prompt_sha256"), F.char_length("prompt").cast("long").alias("prompt_chars"))


def fenced_json(spark, sf_dir):
    found = fixtures.responses(spark, sf_dir).where("response is not null")
    return found.select("doc_id", "block_idx", F.posexplode(replies.fenced(F.col("response"))).alias("part_no", "part")).withColumn("part_no", F.col("part_no").cast("long"))


def brace_objects(spark, sf_dir):
    return replies.brace_objects(fixtures.responses(spark, sf_dir), "response", ["doc_id", "block_idx"])


def parsed_pairs(spark, sf_dir):
    found = fixtures.responses(spark, sf_dir).select("doc_id", "block_idx", F.posexplode(replies.pairs_of(F.col("response"))).alias("pair_idx", "p"))
    return found.select("doc_id", "block_idx", F.col("pair_idx").cast("long").alias("pair_idx"), "p.question", "p.answer")


def strict_pairs(spark, sf_dir):
    sure = fixtures.responses(spark, sf_dir).where(replies.strict_json(F.col("response")))
    found = sure.select("doc_id", "block_idx", F.posexplode(replies.strict_pairs(F.col("response"))).alias("pair_idx", "p"))
    return found.select("doc_id", "block_idx", F.col("pair_idx").cast("long").alias("pair_idx"), "p.question", "p.answer")


def _questions(spark, sf_dir):
    q = F.col("text")
    shapes = ["网友：", "问：Q: ", "张三：", " 网友: ", "投资者 甲:", ""]
    lead = F.element_at(F.array(*map(F.lit, shapes)), (F.col("conv_id") % 6 + 1).cast("int"))
    return documents.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(lead, q, F.lit(" ")).alias("question"))


def _clean(prefixes=None) -> Query:
    def query(spark, sf_dir):
        return _questions(spark, sf_dir).select("conv_id", "turn", text.clean_question(F.col("question"), prefixes).alias("cleaned"))

    return query


def clean_fallback(spark, sf_dir):
    return _clean(["nobody"])(spark, sf_dir)


def _results(spark, sf_dir):
    return pairs.block_results(fixtures.responses(spark, sf_dir))


def block_results(spark, sf_dir):
    return _results(spark, sf_dir).select("doc_id", "block_idx", "success", "error", "qa_count")


def qa_records(spark, sf_dir):
    return pairs.qa_records(_results(spark, sf_dir))


def pair_numbers(spark, sf_dir):
    return pairs.number_pairs(pairs.qa_records(_results(spark, sf_dir))).select("doc_id", "block_idx", "pair_idx", "pair_no")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


def run_stats(spark, sf_dir):
    every = documents.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    found = stats.run_stats(_results(spark, sf_dir), every)
    # Nullable whole numbers as doubles: engines hand them to clients differently.
    return _rounded(found.withColumns({c: F.col(c).cast("double") for c in found.columns if c.startswith(("min_", "max_"))}))


def extraction_quality(spark, sf_dir):
    every = documents.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return _rounded(stats.extraction_quality(pairs.qa_records(_results(spark, sf_dir)), every))


def _in_batches(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """What three batches of blocks leave, one after the other."""
    path = _scratch(spark, name)
    for k, own in enumerate(("block_idx % 3 = 0", "block_idx % 3 = 1", "block_idx % 3 = 2")):
        made = stats.partial_stats(df.where(own)) if name == "stats" else stats.question_sets(df.where(own))
        made.write.parquet(f"{path}/batch={k}")
    return spark.read.parquet(path).drop("batch")


def merged_stats(spark, sf_dir):
    every = documents.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    found = stats.finished_stats(stats.merged_stats(_in_batches(_results(spark, sf_dir), spark, "stats")), every)
    return _rounded(found.withColumns({c: F.col(c).cast("double") for c in found.columns if c.startswith(("min_", "max_"))}))


def merged_quality(spark, sf_dir):
    every = documents.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    results = _results(spark, sf_dir)
    sums, sets = _in_batches(results, spark, "stats"), _in_batches(pairs.qa_records(results), spark, "questions")
    return _rounded(stats.finished_quality(stats.merged_stats(sums), sets, every))


def stream_pair_numbers(spark, sf_dir):
    """Pairs that arrive in three writes, in block order, numbered from a document's kept state."""
    path = _scratch(spark, "stream")
    pairs.qa_records(_results(spark, sf_dir)).select("doc_id", "block_idx", "pair_idx").write.parquet(f"{path}/records")
    # From here on replies are not parsed again.
    records = spark.read.parquet(f"{path}/records")
    for own in ("block_idx < 3", "block_idx between 3 and 5", "block_idx > 5"):
        records.where(own).write.mode("append").parquet(f"{path}/in")
    before = spark.conf.get(streaming.STATE_STORE[0])
    spark.conf.set(*streaming.STATE_STORE)
    try:
        arriving = spark.readStream.schema(records.schema).parquet(f"{path}/in")
        sink = streaming.number_stream(arriving).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check")
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(streaming.STATE_STORE[0], before)
    return spark.read.parquet(f"{path}/out")


def text_quality(spark, sf_dir):
    # Three characters for each 30, 60 or 90 of the turn, so both verdicts occur at any length.
    mixed = F.concat(F.repeat(F.lit("中文字"), F.floor(F.char_length("para") / (30 * (F.col("turn") % 3 + 1))).cast("int")), "para")
    rows = fixtures.transcript(spark, sf_dir).withColumn("para", mixed)
    return rows.select("doc_id", "turn", text.chinese_count(F.col("para")).alias("chinese"), text.good_text(F.col("para")).alias("good"))


def error_log(spark, sf_dir):
    return pairs.error_log(_results(spark, sf_dir))


def success_log(spark, sf_dir):
    return pairs.success_log(_results(spark, sf_dir))


def _replayed(spark, sf_dir, config: Config) -> pipeline.Run:
    """The whole chain with recorded replies: two of three prompts have one."""
    parts = fixtures.transcript_parts(spark, sf_dir)
    asked = pipeline.prompts(pipeline.surviving_blocks(parts, config))
    answer = F.to_json(F.array(F.struct(F.concat(F.lit("问："), F.substring("block", 1, 20)).alias("question"), F.substring("block", 21, 40).alias("answer"))))
    known = asked.where("(doc_id + block_idx) % 3 <> 0").select(prompt_key(F.col("prompt")).alias("prompt_key"), answer.alias("response"))
    return pipeline.plan(parts, ReplayResponder(known), config)


def replay_pipeline(spark, sf_dir):
    run = _replayed(spark, sf_dir, Config(max_block_size=600, min_block_size=100, enable_qa_filter=True))
    return run.results.select("doc_id", "block_idx", "success", "error", "qa_count", F.col("qa_pairs")[0]["question"].alias("question"), F.col("qa_pairs")[0]["answer"].alias("answer"))


def llm_pipeline(spark, sf_dir):
    reply = RuleResponder(lambda p: F.to_json(F.array(F.struct(F.substring_index(p, "\n", -1).alias("question"), F.sha2(p, 256).alias("answer")))))
    config = Config(max_block_size=600, min_block_size=100)
    return pipeline.plan(fixtures.transcript_parts(spark, sf_dir), reply, config).records


def resumed_run(spark, sf_dir):
    """Records of a run that was cut off after one of its four chunks and called again."""
    reply = RuleResponder(lambda p: F.to_json(F.array(F.struct(F.substring_index(p, "\n", -1).alias("question"), F.sha2(p, 256).alias("answer")))))
    config, path = Config(max_block_size=600, min_block_size=100), _scratch(spark, "resumed")
    parts = fixtures.transcript_parts(spark, sf_dir)
    asks = pipeline.questions(pipeline.surviving_blocks(parts, config))
    ledger = Ledger(spark, f"{path}/replies")
    ledger.answer(asks, reply, ["doc_id", "block_idx"], chunk_rows=1, max_chunks=4, stop_after=1)
    return pipeline.plan(parts, reply, config, path, resume=True).records


def _paged(spark, sf_dir):
    """The documents as text files of some hundred pages each, a page a document, read by page ranges."""
    path = _scratch(spark, "paged")
    docs = documents.table(spark, sf_dir, "documents").where("text is not null")
    pages = docs.select(F.concat("text", F.lit("\f")).alias("value"), (F.col("doc_id") % 10).alias("file"), "doc_id")
    pages.repartition(10, "file").sortWithinPartitions("file", "doc_id").select("value", "file").write.partitionBy("file").option("lineSep", "\n").text(path)
    spark.dataSource.register(paged_source(TextPages, "paged_text"))
    found = spark.read.format("paged_text").option("splitBytes", 65536).option("pathGlobFilter", "*.txt").load(path)
    return found.withColumn("file", F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long"))


def paged_files(spark, sf_dir):
    blocks = _paged(spark, sf_dir)
    # A page ends with a form feed, so what the writer puts after it leads the next page.
    found = blocks.where("text <> ''")
    return found.select("file", F.col("page_no").cast("long").alias("page_no"), "text", F.col("page_count").cast("long").alias("page_count"))


def file_info(spark, sf_dir):
    about = documents.file_info(_paged(spark, sf_dir))
    file = F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long").alias("file")
    return about.select(file, F.col("page_count").cast("long").alias("page_count"), "file_size", "is_encrypted", "is_pdf")


def _scratch(spark: SparkSession, name: str) -> str:
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="dialoom-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def jsonl_roundtrip(spark, sf_dir):
    path = _scratch(spark, "jsonl")
    jsonl.save(qa_records(spark, sf_dir).select("question", "answer", "source_text"), path)
    return jsonl.load(spark, path).where("valid").select("item.question", "item.answer", "item.source_text")


def jsonl_append(spark, sf_dir):
    path = _scratch(spark, "appended")
    records = qa_records(spark, sf_dir).select("doc_id", "question", "answer")
    jsonl.save(records.where("doc_id % 2 = 0"), path)
    jsonl.save(records.where("doc_id % 2 = 1"), path, append=True)
    return jsonl.load(spark, path, "doc_id long, question string, answer string").select("item.doc_id", "item.question", "item.answer")


def file_size(spark, sf_dir):
    """Bytes of a text file of ids, one a line."""
    path = _scratch(spark, "sizes")
    documents.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("value")).write.option("compression", "none").text(path)
    return spark.range(1).select(F.lit(jsonl.file_size(spark, path)).cast("long").alias("bytes"))


def config_layers(spark, sf_dir):
    """Settings that suit the conversations, by name: sizes from their turns go to a YAML file, the share of answers to a variable; an unknown key is there, too."""
    import os
    import tempfile

    turns = documents.table(spark, sf_dir, "conversations")
    n = turns.agg(F.max(F.char_length("text")).alias("most"), F.count_distinct("conv_id").alias("chats"), F.count_if(F.col("role") == "assistant").alias("answers"), F.count(F.lit(1)).alias("turns")).first()
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "c.yaml")
        with open(path, "w", encoding="utf-8") as out:
            out.write(f"max_block_size: {n['most']}\nunknown: 1\nextract_ratio: 0.5\noutput_dir: chats-{n['chats']}\n")
        merged = load_config(path, {"EXTRACT_RATIO": str(n["answers"] * 100 // n["turns"] / 100), "ENABLE_QA_FILTER": "Yes"})
    names = ("max_block_size", "min_block_size", "extract_ratio", "enable_qa_filter", "output_dir", "log_level")
    return spark.createDataFrame([(n, str(getattr(merged, n))) for n in names] + [("known_prefixes", ",".join(merged.known_prefixes))], "name string, value string")


def _lines(spark, sf_dir) -> str:
    """A text file of blank, bad, scalar, array and object lines."""
    path = _scratch(spark, "lines")
    shape, text_ = F.col("turn") % 5, F.to_json(F.struct(F.col("text").alias("question")))
    rows = documents.table(spark, sf_dir, "conversations")
    rows.select(F.when(shape == 0, " \t").when(shape == 1, "not json").when(shape == 2, "7").when(shape == 3, F.concat(F.lit(" ["), text_, F.lit("] "))).otherwise(text_).alias("value")).write.text(path)
    return path


def jsonl_count(spark, sf_dir):
    return jsonl.lines(spark, _lines(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


def jsonl_observed(spark, sf_dir):
    """Lines, blank and bad ones, and the rows of the same pass over the file."""
    rows, counts = jsonl.load_whole(spark, _lines(spark, sf_dir), "question string")
    one = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid"), F.count("item").alias("items"))
    return one.select(*[F.lit(counts[c]).cast("long").alias(c) for c in ("lines", "blank", "bad")], "rows", "valid", "items")


def jsonl_items(spark, sf_dir):
    return jsonl.load(spark, _lines(spark, sf_dir)).select("value", "valid", F.col("item.question").alias("question"))


QUERIES: dict[str, Query] = {
    "layout_paragraphs": layout_paragraphs, "document_text": document_text, "page_text": page_text, "document_info": document_info,
    "blocks_default": _blocks(1500, 100), "blocks_small": _blocks(300, 50), "blocks_interview": _blocks(2000, 50, True), "blocks_dropped": blocks_dropped, "blocks_long": blocks_long,
    "normalize_markers": normalize_markers, "has_qa": has_qa, "has_qa_parts": has_qa_parts, "sample_prefix": sample_prefix, "filter_then_sample": filter_then_sample,
    "prompts": prompts, "fenced_json": fenced_json, "brace_objects": brace_objects, "parsed_pairs": parsed_pairs, "strict_pairs": strict_pairs,
    "clean_known": _clean(), "clean_fallback": clean_fallback, "clean_custom": _clean(["张三", "投资者 甲"]),
    "block_results": block_results, "qa_records": qa_records, "pair_numbers": pair_numbers, "run_stats": run_stats, "extraction_quality": extraction_quality,
    "text_quality": text_quality, "error_log": error_log, "success_log": success_log, "replay_pipeline": replay_pipeline, "llm_pipeline": llm_pipeline,
    "jsonl_roundtrip": jsonl_roundtrip, "jsonl_count": jsonl_count, "jsonl_items": jsonl_items,
    "layout_text": layout_text, "paragraph_split": paragraph_split, "jsonl_append": jsonl_append, "file_size": file_size, "config_layers": config_layers,
    "jsonl_observed": jsonl_observed, "resumed_run": resumed_run, "paged_files": paged_files, "file_info": file_info,
    "merged_stats": merged_stats, "merged_quality": merged_quality, "stream_pair_numbers": stream_pair_numbers,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the whole chain over transcripts, with recorded replies."""
    config = replace(Config(), max_block_size=600, enable_qa_filter=True, extract_ratio=0.5)
    return _rounded(_replayed(spark, sf_dir, config).stats)
