"""The registered query of each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyworks.llm import chat_format, media_columns, oracles, prefix_bpe, quality_rules, repair_store, secret_scan, simhash_dedup, source_mix, token_rollup, url_filters
from plyworks.llm.common import OWN, materialize, read_table, shared_dir, text_of

#: Production parameters of the queries.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/"))
LISTED_HOSTS = ("cheap-pills.example.com", "free-bets.example.com", "adult-x.example.net", "spam-farm.example.org", "casino-win.example.com", "ads-track.example.com", "spam-farm.example.com")
#: The canonical URL of every so-many-th page is listed too.
LISTED_PAGES = 10
EXTRA_TURNS = "</s>[INST] ok [/INST]"


def _own(*names: str):
    return [F.col(OWN + x).alias(x) for x in names]


def op1_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules with all listed hosts and a list of canonical URLs: that of every LISTED_PAGES-th page, so it grows with the pages."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    entries = url_filters.rules(*URL_RULES) + [url_filters.Entry("listed", host, "", "block") for host in LISTED_HOSTS]
    listed = url_filters.url_entries(pages.where(F.col("page_id") % LISTED_PAGES == 0), "block")
    out = url_filters.judge(pages, url_filters.entry_table(spark, entries).unionByName(listed))
    rule = F.when(F.col(OWN + "kind") == "rule", F.col(OWN + "rule")).alias("rule")
    return out.select("page_id", *_own("host", "path"), rule, *_own("kind", "verdict"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(OWN + "fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *_own("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = secret_scan.scan(docs, F.concat_ws("/", "source", "lang"), F.col("source"), keep=["doc_id"])
    spans, kinds = F.col(OWN + "spans"), [d.kind for d in secret_scan.BASE]
    of = lambda kind: lambda s: s["kind"] == kind
    count = lambda test: F.size(F.filter(spans, test)).cast("long")
    return found.select(
        "doc_id",
        *(count(of(k)).alias(f"n_{k}") for k in kinds),
        F.sha2(secret_scan.listed(F.filter(spans, lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"),
        secret_scan.listed(spans).alias("spans"),
        count(lambda s: ~s["copied"]).alias("n_live"),
        count(lambda s: s["copied"]).alias("n_copied"),
    )


def _event_log(turns: DataFrame) -> DataFrame:
    """How each row of turns came about: it begins with a draft, which is regenerated (assistant) or edited away, and its text is streamed in two deltas, the first of them delivered twice."""
    text, head = F.coalesce("text", F.lit("")), 16
    event = lambda at, kind, said: F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), said.alias("text"))
    again = F.when(F.col("role") == "assistant", "regenerate").otherwise("edit")
    first = F.substring(text, 1, head)
    steps = F.array(event(0, "message", F.substring(text, 1, 4)), F.struct(F.lit(1).alias("at"), again.alias("kind"), F.lit("").alias("text")), event(2, "delta", first), event(2, "delta", first), event(3, "delta", F.substring(text, F.lit(head + 1), F.length(text))))
    rows = turns.withColumn("msg", F.monotonically_increasing_id()).select("conv_id", "turn", "msg", "role", F.explode(steps).alias("e"))
    return rows.select("conv_id", (F.coalesce("turn", F.lit(-(1 << 40))) * 4 + F.col("e.at")).alias("seq"), "msg", "e.kind", "role", "e.text")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(EXTRA_TURNS).alias("text")) for i, r in enumerate(("user", "assistant"))))))
    log = _event_log(stored.unionByName(extra))
    read = chat_format.parse(chat_format.format_log(log))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return repair_store.read_shards(repair_store.write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op7_tokenizer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come, all are revised (each loses its first word), and those labelled toxic go. Batches are sent again, before and after they are compacted. Both tokenizers count beside built-in functions."""
    import public_tokenizers as p

    real = {"word_bpe_49k/1": token_rollup.word_counter(p.path("word_bpe_49k.json")), "byte_bpe_50k/1": token_rollup.byte_counter(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)}
    counters, revision = token_rollup.native_counters() | real, F.regexp_replace("text", r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    docs = token_rollup.counted_together(docs, {"first": F.col("text"), "revised": revision}, counters).drop("text")
    docs = materialize(docs, "token-counts")
    toxic = read_table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    old, none = [F.col("source").alias("old_source"), F.col("lang").alias("old_lang")], F.lit(None)
    came = docs.select(F.lit("insert").alias("op"), "source", "lang", F.col("first").alias("counts"), none.cast("string").alias("old_source"), none.cast("string").alias("old_lang"), none.cast("map<string,bigint>").alias("old_counts"))
    revised = docs.select(F.lit("revise").alias("op"), "source", "lang", F.col("revised").alias("counts"), *old, F.col("first").alias("old_counts"))
    went = docs.join(toxic, "doc_id", "left_semi").select(F.lit("delete").alias("op"), none.cast("string").alias("source"), none.cast("string").alias("lang"), none.cast("map<string,bigint>").alias("counts"), *old, F.col("revised").alias("old_counts"))
    store = token_rollup.Rollups(spark, f"{shared_dir(spark)}/plyworks/rollups-{uuid.uuid4().hex}")
    for batch, changes in (("came", came), ("revised", revised), ("came", came), ("went", went)):
        store.commit(batch, changes)
    store.compact()
    store.commit("went", went)
    return store.totals()


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, taken = source_mix.mix(read_table(spark, sf_dir, "documents"), F.array("source"))
    sources = plan.bounded([(s, plan.sizes[s], float(t)) for s, t in plan.targets.items()], "source string, source_size bigint, target double")
    joined = taken.join(sources, taken["pattern"][0].eqNullSafe(sources["source"]))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col(OWN + "copies")).alias("taken"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature tells the number of pairs and two hashes of their array."""
    found = media_columns.decode(media_columns.store_documents(read_table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.size("fingerprints"), F.hex(F.xxhash64("fingerprints")), F.hex(F.xxhash64(F.lit(1), "fingerprints"))).alias("feature")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature)


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    return prefix_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def queries():
    return {f.__name__: f for f in (op1_url_lists, op2_simhash_dedup, op3_quality_rules, op4_secret_scan, op5_chat_format, op6_repair_store, op8_source_mix, op9_media_columns, op10_prefix_bpe)}


def rollup_queries():
    """Rows for each source, language and tokenizer, which SQL has no form for; tests hold them against brute force."""
    return {"op7_tokenizer_rollup": op7_tokenizer_rollup}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
