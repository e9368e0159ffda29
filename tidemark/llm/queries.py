"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import (
    bytepairs,
    decontaminate,
    embeddings,
    licenses,
    lines,
    mixing,
    prefix_trie,
    quality,
    simhash,
    spelling,
    tokens,
    toolcalls,
    urls,
)
from tidemark.llm.registry import query, table
from tidemark.session import scratch_folder


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op2_line_dedup", lines.LINE_DEDUP_SQL)
def op2(spark, sf_dir):
    cut = lines.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        F.col("line_count").alias("n_lines"),
        F.col("dropped_count").alias("n_dropped"),
        F.sha2(F.col("kept_text"), 256).alias("kept_sha256"),
    )


@query("op6_source_mixing")
def op6(spark, sf_dir):
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.taken.select("doc_id", "size", "source_size", "target", "taken")


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query("op7_url_filter", urls.URL_SQL)
def op7(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op3_token_planes")
def op3(spark, sf_dir):
    import public_tokenizers

    path = scratch_folder(spark, "token-files")
    tokens.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    back = tokens.read_token_files(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op8_embedding_near_dedup")
def op8(spark, sf_dir):
    return embeddings.link_embeddings(table(spark, sf_dir, "embeddings"))


@query("op9_benchmark_decontamination")
def op9(spark, sf_dir):
    return decontaminate.find_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window_words=5
    )


def grades(labels):
    """Ratings from 0: poor text, readable but toxic text, good text."""
    return labels.select(
        "doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade")
    )


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, grades(table(spark, sf_dir, "labels")))
    return quality.score_quality(docs, model, least_grade=2).select(
        "doc_id", "expected_grade", "tail_probability", "selected"
    )


CHAT_TOOLS = {
    "answer": {
        "type": "object",
        "required": ["prompt", "turn"],
        "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    }
}


@query("op4_tool_call_linking")
def op4(spark, sf_dir):
    """A user turn calls the assistant, whose next turn is the result; it builds on the user turn two before.

    Turns of any other role are carried as messages without a call; a null turn has no identifier and links nothing.
    """
    rows = table(spark, sf_dir, "conversations")
    # null where the turn is null
    name = lambda turn: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("-"), turn.cast("string"))
    calls = rows.where(F.col("role") == "user").select(
        "conv_id",
        name(F.col("turn")).alias("call_id"),
        F.when(F.col("turn") >= 2, name(F.col("turn") - 2)).alias("parent_id"),
        F.lit("answer").alias("name"),
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn")).alias("arguments"),
        F.col("turn").alias("position"),
    )
    results = rows.where(F.col("role") == "assistant").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"), F.col("turn").alias("position")
    )
    other = rows.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).select(
        "conv_id", F.col("turn").alias("position"), "role", F.col("text").alias("content")
    )
    return toolcalls.carry_messages(toolcalls.link_tool_calls(calls, results, CHAT_TOOLS), other)


@query("op5_license_scan")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs, licenses.train_licenses(docs))


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    words = spelling.count_words(table(spark, sf_dir, "documents"))
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def rebuilt_turns(turns):
    """Turns of conversations that share beginnings: the first h of conversation c - c % 5, then the own ones behind h.

    h is crc32 of the decimal id, modulo 9.  ``turns``: of ``numbered_turns``.
    """
    shared = F.crc32(F.col("conv_id").cast("string")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    begins = turns.where("place <= 8")
    lengths = begins.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("length"))
    convs = turns.select("conv_id", base.alias("base"), shared.alias("h")).distinct()
    convs = convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("length", F.lit(0))))
    first = convs.select("conv_id", "base", "taken").join(begins.withColumnRenamed("conv_id", "base"), "base")
    first = first.where(F.col("place") <= F.col("taken")).select("conv_id", "place", "role", "text")
    own = turns.where(F.col("place") > shared).join(convs.select("conv_id", "h", "taken"), "conv_id")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "role", "text")
    return first.unionByName(own), convs.select("conv_id")


@query("op12_prefix_trie")
def op12(spark, sf_dir):
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*rebuilt_turns(turns))


@query("op13_byte_pairs")
def op13(spark, sf_dir):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bytepairs.encode_texts(table(spark, sf_dir, "documents"), ranks)
    return bytepairs.decode_texts(encoded, ranks).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
