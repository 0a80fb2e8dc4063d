"""One registered query per operator, each over its whole table, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetry.llm import bpe, chat, decontam, langid, markup, maxent, packing, periodic, ranked, rules, secret, simhash, stock

RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        RUNS[name] = run
        if sql:
            CHECKS[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_vocabulary() -> str:
    """Place of the word-end vocabulary; looked up here only, as the files are no part of this package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_decontaminate", r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
  bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') k FROM
      (SELECT item_id, w, least(len(w), 10) l, unnest(range(1, len(w) - least(len(w), 10) + 2)) i FROM b WHERE len(w) > 0)),
  dw AS (SELECT rid, i, l, array_to_string(w[i:i + l - 1], ' ') k FROM
      (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
  m AS (SELECT rid, i, l, item_id FROM dw JOIN bw USING (l, k)),
  h AS (SELECT rid, count(DISTINCT p) n_hit FROM (SELECT rid, unnest(range(i, i + l)) p FROM m) GROUP BY rid),
  t AS (SELECT rid, count(*) n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) s
      FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  coalesce(s, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hits = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hits.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


@query("op2_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learned = rules.fit(rules.labelled(docs, table(spark, folder, "labels")))
    out = rules.judged(docs.select("doc_id", "text"), learned)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


@query("op4_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, folder, "documents"), word_vocabulary(), keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_simhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def remainder(parts: int):
    """crc32 of the id as text, modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts, F.lit(-1))


@query("op3_markup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    found = markup.extract(pages, keep=["page_id", "url"], learned=markup.learn(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op5_secrets")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret.scan(docs, secret.train(docs), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    shown = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


@query("op6_chat", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e AS (SELECT *, length(regexp_replace(r, '[\\|>]', '..', 'g')) + length(regexp_replace(t, '[\\|>]', '..', 'g')) n FROM c)
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) loss_sha256,
  CAST(sum(n + 13) AS BIGINT) formatted_chars
FROM e GROUP BY conv_id
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    out = chat.conversations(chat.chain(rows))
    turns, loss = chat.read_back(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    read = out.select(F.col("tree").alias("conv_id"), turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").alias("n"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("n").cast("long").alias("formatted_chars"))


@query("op7_langid")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(docs.where(remainder(4) != 2))
    found = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


@query("op9_maxent")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model, scored = maxent.fit_and_score(docs.where(remainder(5) != 1), docs)
    return scored.select("doc_id", (remainder(5) == 1).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


@query("op10_pack")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return packing.pack(packing.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"]))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; in a tenth of the documents, by the hash of the id, the words from some place on
    repeat the words there with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("w"))
    cut = cut.withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    part = lambda start, length: F.slice("w", start.cast("int"), length.cast("int"))
    again = F.flatten(F.array_repeat(part(F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    new = F.slice(F.concat(part(F.lit(1), F.col("a")), again), F.lit(1), F.col("n").cast("int"))
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.with_runs(planted_repeats(table(spark, folder, "documents")), keep=["doc_id"])
    higher = lambda a, b: a["length"] * b["period"] < b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(higher(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_words", "n_runs", "best.start", "best.length", "best.period",
                      F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op13_cutting_stock")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    coded = stock.encoded(table(spark, folder, "documents"), word_vocabulary(), end=2)
    return stock.pieces(coded).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op12_ranked_search", r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t FROM documents),
  b AS (SELECT row_number() OVER () qid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t FROM benchmark),
  q AS (SELECT qid, w, count(*) c FROM (SELECT qid, unnest(t) w FROM b) GROUP BY qid, w),
  s AS (SELECT count(*) FILTER (len(t) > 0) nd, CAST(sum(len(t)) AS BIGINT) l FROM d),
  p AS (SELECT rid, w, count(*) tf FROM (SELECT rid, unnest(t) w FROM d) GROUP BY rid, w),
  f AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) g
      FROM (SELECT w, count(*) df FROM p GROUP BY w), s),
  m AS (SELECT rid, doc_id, 25 + (75 * len(t) * nd) // l m FROM d, s),
  r AS (SELECT qid, rid, CAST(sum(c * g * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) score
      FROM q JOIN f USING (w) JOIN p USING (w) JOIN m USING (rid) GROUP BY qid, rid),
  o AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, rid) rank
      FROM r JOIN m USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) rank, doc_id, score FROM o JOIN b USING (qid) WHERE rank <= 10
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)
