"""The training-data queries of ``__spark_entry__``, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarc.llm.common import hex_digest, table


def op1_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratarc.llm.passages import dedup_passages

    cut = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda a, s: a + s.length)
    return cut.select(
        "doc_id",
        (F.octet_length("kept_bytes") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratarc.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratarc.llm.brown import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratarc.llm.toxicity import fit, held_out, score_documents

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text", "lang"), model).drop("text")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        (F.col("score") >= F.col("threshold")).alias("rejected"),
    )


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratarc.llm.wrappers import extract_pages

    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op9_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratarc.llm.leaks import leaked_items

    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("bm25_share", 4).alias("bm25_share"), F.round("overlap", 6).alias("overlap"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stratarc.llm.pieces import sentencepiece_round_trip

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    coded = sentencepiece_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), model, keep_text=False)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        hex_digest(F.concat_ws(",", F.col("token_ids").cast("array<string>"))).alias("ids_sha256"),
        hex_digest(F.col("decoded_text")).alias("decoded_sha256"),
    )


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratarc.llm.shards import histogram_shards

    docs = table(spark, sf_dir, "documents")
    # the text itself is needed for hash and size only
    narrow = docs.select("doc_id", "text")
    placed = histogram_shards(narrow.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))), 8, carry=("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratarc.llm.rules import apply_policy, mask, rule_ledger

    ledger = rule_ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    ledger = ledger.withColumn("base_failed", F.col("fail_bits").bitwiseAND(mask("base")) != 0)
    return apply_policy(ledger, "v2").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "n_lines", "n_stutter"
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, row_number() OVER () AS k, t, w, ls FROM d
), win AS (
  SELECT k, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM g WHERE len(w) >= 5)
), hit AS (
  SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT k, CAST(sum(coalesce(least(5, nxt - i), 5)) AS BIGINT) AS r FROM hit GROUP BY k
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(r, 0) AS n_repeat_words,
         CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS BIGINT) AS n_stutter
  FROM g LEFT JOIN rep USING (k)
), b AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 100 * n_stutter > 30 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept,
       fail_bits, n_lines, n_stutter FROM b
"""


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratarc.llm.chats import format_trees, linear_tree, loss_text, turns_of

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, n AS turn, r AS role FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(n, r)").withColumn("text", F.lit(said))
    made = format_trees(linear_tree(rows.unionByName(extra)))
    turns, loss = turns_of(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss_spans"))
    return made.select(
        F.col("tree").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        hex_digest(F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        hex_digest(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS et,
    replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c'), chr(10), '\n') AS er FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('### ' || er || ': ' || et || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratarc.llm.heavylight import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stratarc.llm.alignment import align_documents

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return align_documents(table(spark, sf_dir, "documents"), a.read(), b.read()).withColumnRenamed("id", "doc_id")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratarc.llm.manifest import manifest

    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], changed=(tampered, {"text": lower}))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return made.select(
        F.col("id").alias("doc_id"), text("leaf"), text("subroot"), text("root"), "proof_sha256", text("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _op13_sql(depth: int = 8, crown: int = 4) -> str:
    """depth, crown: levels unrolled in a language's tree and above the languages (8 ** depth rows, 8 ** crown languages)."""
    coded = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(coded, ("doc_id", "source", "lang", "n_chars"))) + f" || {coded(text)})"
    ctes = [
        # CRC-32 of the decimal id, bit by bit
        "ids AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))",
        "low AS (SELECT d.*, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small, coalesce(crc % 3 = 0, false) AS hit FROM documents d LEFT JOIN ids USING (doc_id))",
        f"lv AS (SELECT doc_id, coalesce('+' || lang, '') AS g, {leaf('text')} AS leaf, CASE WHEN hit THEN {leaf('small')} ELSE {leaf('text')} END AS other FROM low)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos FROM lv)",
        "t0 AS (SELECT g, pos, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM n0)",
    ]
    ctes.append("f0 AS (SELECT doc_id, g, leaf, pos AS spot, other AS x, '' AS proof FROM n0)")

    def levels(t: str, f: str, k: int) -> None:
        for i in range(k):
            ctes.append(f"r{t}{i} AS (SELECT g, pos // 8 AS p, string_agg(d, '' ORDER BY pos) AS kids FROM {t}{i} WHERE n > 1 GROUP BY ALL)")
            ctes.append(f"{t}{i + 1} AS (SELECT g, p AS pos, sha256(kids) AS d, count(*) OVER (PARTITION BY g) AS n FROM r{t}{i} UNION ALL SELECT g, pos, d, n FROM {t}{i} WHERE n = 1)")
            ctes.append(
                f"{f}{i + 1} AS (SELECT f.* EXCLUDE (spot, x, proof), spot // 8 AS spot, CASE WHEN kids IS NULL THEN x ELSE sha256(left(kids, 64 * (spot % 8)) || x || substr(kids, 64 * (spot % 8) + 65)) END AS x, "
                f"CASE WHEN kids IS NULL THEN proof ELSE proof || left(kids, 64 * (spot % 8)) || substr(kids, 64 * (spot % 8) + 65) END AS proof FROM {f}{i} f LEFT JOIN r{t}{i} r ON f.g = r.g AND f.spot // 8 = r.p)"
            )

    levels("t", "f", depth)
    ctes.append(f"u0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, d, count(*) OVER () AS n, g AS name FROM t{depth})")
    ctes.append(f"h0 AS (SELECT f.doc_id, '' AS g, f.leaf, u.d AS subroot, u.pos AS spot, f.x, f.proof FROM f{depth} f JOIN u0 u ON f.g = u.name)")
    levels("u", "h", crown)
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = d AS verified FROM h{crown} CROSS JOIN u{crown}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bwt_dedup": op1_bwt_dedup,
        "op2_simhash": op2_simhash,
        "op3_rule_ledger": op3_rule_ledger,
        "op4_brown": op4_brown,
        "op5_toxicity": op5_toxicity,
        "op6_reply_trees": op6_reply_trees,
        "op7_histogram_sort": op7_histogram_sort,
        "op8_wrapper_induction": op8_wrapper_induction,
        "op9_bm25_leaks": op9_bm25_leaks,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_jaccard_join": op11_jaccard_join,
        "op12_alignment": op12_alignment,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_rule_ledger": OP3_SQL, "op6_reply_trees": OP6_SQL, "op13_merkle": _op13_sql()}
