"""The thin queries over the corpus operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import html_extract, licenses, linededup, mixing, packing, periodic, ppm_bytes, resampling, rules, search, simhash, vectors, wordpiece
from rostrum.llm.common import SPACE, let
from rostrum.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    shards = F.transform("mix_pieces", lambda x: x["shard"])
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), shards.alias("shards"))


def op2_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, asked).withColumn("score", F.round("score", 6))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_bytes.score(table(spark, sf_dir, "documents"), held="pmod(crc32(cast(doc_id as string)), 7) = 2")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = {"rule_words": "n_words", "rule_chars": "word_chars", "rule_symbols": "n_symbols", "rule_dup_lines": "n_dup_lines", "rule_repeats": "n_repeat_words", "rule_base_failed": "base_failed", "rule_kept": "kept"}
    return out.select("doc_id", *[F.col(a).alias(b) for a, b in names.items()])


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("dsir_weight").alias("log_weight"), F.col("dsir_key").alias("sample_key"), F.col("dsir_kept").alias("kept"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = vectors.train(table(spark, sf_dir, "embeddings"))
    out = vectors.encode(books)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs, where a tenth of the texts, by a checksum of their id, repeat a stretch of their words to the end."""
    words = F.filter(F.split("text", SPACE), lambda x: x != "")
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(w: Column) -> Column:
        n, g = F.size(w), F.floor(draw / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.transform(w, lambda word, i: F.when(i < x["a"], word).otherwise(F.get(w, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))))

    text = let(words, lambda w: F.when(F.size(w) > 0, F.array_join(planted(w), " ")).otherwise(""))
    return docs.withColumn("text", F.when(draw % 10 == 0, text).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.collapse(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    runs = F.col("runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.select("doc_id", F.size(runs).cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("longest.start"), F.col("longest.length"), -F.col("longest.period")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_bm25_search, op3_ppm, op4_license_scan, op5_quality_rules, op6_html_text, op7_token_counts, op8_packing, op9_importance_resampling, op10_simhash, op11_line_dedup, op12_vector_codes, op13_periodic_runs)}

TOKENS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))"
ORACLES: dict[str, str] = {
    "op2_bm25_search": f"""
with bags as (select doc_id, w, count(*) as c from (select doc_id, {TOKENS} as w from documents) group by doc_id, w),
     sizes as (select doc_id, sum(c) as n from bags group by doc_id),
     stats as (select count(*) as docs, (select sum(n) from sizes) / count(*) as mean from documents),
     idf as (select w, ln(1 + (docs - df + 0.5) / (df + 0.5)) as idf from (select w, count(*) as df from bags group by w), stats),
     pairs as (select q.doc_id as query_id, d.doc_id, round(sum(q.c * idf * d.c * 2.2 / (d.c + 1.2 * (0.25 + 0.75 * n / mean))), 9) as score
               from bags q join bags d using (w) join idf using (w) join sizes s on s.doc_id = d.doc_id, stats
               where q.doc_id % 50 = 0 group by q.doc_id, d.doc_id),
     ranked as (select query_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, doc_id, score from pairs)
select query_id, rank, doc_id, round(score, 6) as score from ranked where rank <= 10""",
    "op11_line_dedup": r"""
with lines as (select doc_id, i as pos, l as line, translate(trim(l, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
               from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents), unnest(a) with ordinality as u(l, i)),
     common as (select k, max(doc_id) as last from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3)
select doc_id, count(*) as n_lines, count(*) filter (where last is not null and doc_id <> last) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where last is null or doc_id = last), '')) as kept_sha256
from lines left join common using (k) group by doc_id""",
    "op12_vector_codes": f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
              where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     parts as (select vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as w from kept, range(16) as r(p)),
     first as (select vec_id, row_number() over (order by vec_id) - 1 as e from (select vec_id from kept order by vec_id limit 64)),
     c0 as (select p, e, w as c from parts join first using (vec_id)),
     {{0}},
     coded as (select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a2 group by vec_id, label),
     books as (select sha256(string_agg(cast(x as varchar), ',' order by p, e, i)) as codebooks_sha256 from (select p, e, i, x from c2, unnest(c) with ordinality as u(x, i)))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded, books""",
}

ASSIGN = """a{k} as (select vec_id, label, p, w, d, e from (select vec_id, label, p, w, e, d, row_number() over (partition by vec_id, p order by d, e) as r from (
       select vec_id, label, p, w, e, list_sum(list_transform(list_zip(w, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as d from parts join c{k} using (p))) where r = 1)"""
MOVE = """s{k} as (select p, e, list(cast(floor(m) as bigint) order by i) as c from (select p, e, i, sum(x) / count(*) as m from a{k}, unnest(w) with ordinality as u(x, i) group by p, e, i) group by p, e),
     c{n} as (select p, e, coalesce(s.c, c{k}.c) as c from c{k} left join s{k} s using (p, e))"""
STEPS = ", ".join([ASSIGN.format(k=0), MOVE.format(k=0, n=1), ASSIGN.format(k=1), MOVE.format(k=1, n=2), ASSIGN.format(k=2)])
ORACLES["op12_vector_codes"] = ORACLES["op12_vector_codes"].format(STEPS)
