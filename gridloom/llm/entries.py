"""The queries opN_<name> and pipeline, and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, infill, language, mixing, ngram_join, periods, permutation_index, quality, sharding, sstable, toxicity, warc
from .common import cut, held_out, table

SHARDS = {f"shard-{i:03d}": 1 for i in range(256)}
DIGESTS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
RANKS, TOKENIZER, END_ID = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", 2


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign(docs, ["doc_id"], SHARDS).select("doc_id", "slot", "shard")


def _classified(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _classified(quality.score(docs, model), 0.3)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = fingerprints.with_fingerprint(docs)
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    following = F.coalesce("next_text", F.lit(""))
    edited = F.concat(F.col("text").substr(F.lit(1), n - part), following.substr(F.lit(1), part))
    rows = fingerprints.with_next(known, "doc_id", {"next_text": "text", "next_fingerprint": "fingerprint"}).withColumn("edited", edited)
    rows = fingerprints.with_fingerprint(rows, "edited", "edited_fingerprint")
    own = (F.col("text"), F.col("fingerprint"))
    found = cut(
        rows.select(
            "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
            fingerprints.likeness(*own, F.col("edited"), F.col("edited_fingerprint")).alias("near_edited"),
            F.coalesce(fingerprints.likeness(*own, F.col("next_text"), F.col("next_fingerprint")), F.lit(0.0)).alias("near_next"),
        )
    )
    groups = fingerprints.exact_groups(docs, fingerprints=found).groupBy("doc_id", "fingerprint").agg(F.min("group_id").alias("group_id")).alias("g")
    same = F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.fingerprint") == F.col("g.fingerprint"))
    return found.alias("r").join(groups, same).select("r.*", "group_id")


def _encoded(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    return bpe.encode(docs, path, public_tokenizers.PATTERN, carry=carry, decoded="bytes").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"), *carry
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages"))).withColumn("__record", warc.record_bytes())
    return records.withColumns({"record_bytes": F.octet_length("__record").cast("long"), "record_sha256": F.sha2("__record", 256)}).drop("__record", "content")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = sstable.write(docs, lambda: sstable.tokenizer_encoder(path, match_added=True), end_id=END_ID)
    return sstable.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation_index.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, period=262_144).select("doc_id", "source", "block", "place", "slot", "release", "due", "in_mix")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = infill.restore(infill.transform(docs))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


#: What lies between words.
_BLANK = r"[\x20\x09-\x0D]+"


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth text, by the hash of its id, with its words from some place on replaced by their first few, again and again."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", _BLANK), lambda w: w != "")
    odd = docs.withColumns({"__h": h, "__words": F.when(h % 10 == 0, words)})
    n, g = F.size("__words"), F.floor(F.col("__h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("__words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.concat(F.slice("__words", F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return odd.withColumn("text", F.when((F.col("__h") % 10 == 0) & (n > 0), F.array_join(planted, " ")).otherwise(F.col("text"))).drop("__h", "__words")


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = periods.find(_with_planted_periods(docs))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    every = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = lambda c: F.col(f"strongest.{c}").alias(c)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best("start"), best("length"), best("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(every.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_sharding, op2_quality, op3_fingerprints, op4_byte_bpe, op5_toxicity, op6_warc, op7_ngram_join, op8_sstable, op9_permutation_index, op10_mixing,
        op11_infill, op12_periods, op13_language, pipeline,
    )
    return {f.__name__: f for f in named}


def _uuid(expr: str) -> str:
    h = f"md5({expr})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _warc_sql() -> str:
    text = r"regexp_replace(page, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?(?:{warc.BLOCK_TAGS})\b[^>]*>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for a, b in warc.ENTITIES:
        text = f"replace({text}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    text = rf"regexp_replace({text}, '[ \t\r\f]+', ' ', 'g')"
    text = rf"regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g')"
    text = rf"regexp_replace({text}, '^[ \n]+|[ \n]+$', '', 'g')"
    crlf = "chr(13) || chr(10)"
    digest = "'sha256:' || sha256({})"
    value = {
        "warc_type": "t", "record_id": "i", "refers_to": "rid", "concurrent_to": "o", "target_uri": "url", "warc_date": f"'{warc.DATE}'", "block_digest": digest.format("body"), "payload_digest": digest.format("body"),
        "source_status": "'200'", "source_content_type": "'text/html; charset=UTF-8'", "source_payload_digest": digest.format("page"), "content_type": "c", "content_length": "strlen(body)",
    }
    head = " || ".join(f"'{name}: ' || {value[column]} || {crlf}" for name, column in warc.HEADERS)
    fields = rf"""'title: ' || regexp_replace(regexp_extract(page, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g') || {crlf} || 'language: '
      || regexp_extract(page, '(?i)<html[^>]*\blang="([^"]*)"', 1) || {crlf} || 'outlinks: ' || len(regexp_extract_all(page, '(?i)<a\s[^>]*href='))
      || {crlf} || 'http-status: 200' || {crlf} || 'source-content-type: text/html; charset=UTF-8' || {crlf} || 'source-payload-digest: sha256:' || sha256(page) || {crlf}
      || 'source-header: Content-Type: text/html; charset=UTF-8' || {crlf} || 'source-header: Content-Length: ' || strlen(page) || {crlf}"""
    return f"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS page, {_uuid("'response|' || coalesce(page_id::VARCHAR, 'null') || '|' || coalesce(url, 'null')")} AS rid FROM pages),
    ids AS (SELECT *, {_uuid("'metadata|' || rid")} AS mid, {_uuid("'conversion|' || rid")} AS cid FROM p),
    r AS (
      SELECT page_id, url, page, rid, 'metadata' AS t, mid AS i, cid AS o, 'application/warc-fields' AS c, {fields} AS body FROM ids
      UNION ALL SELECT page_id, url, page, rid, 'conversion', cid, mid, 'text/plain; charset=UTF-8', {text} FROM ids)
    SELECT page_id, t AS warc_type, i AS record_id, rid AS refers_to, o AS concurrent_to, url AS target_uri, '{warc.DATE}' AS warc_date, c AS content_type,
      strlen(body)::BIGINT AS content_length, 'sha256:' || sha256(body) AS block_digest, 'sha256:' || sha256(body) AS payload_digest,
      '200' AS source_status, 'text/html; charset=UTF-8' AS source_content_type, 'sha256:' || sha256(page) AS source_payload_digest,
      strlen(record)::BIGINT AS record_bytes, sha256(record) AS record_sha256
    FROM (SELECT *, 'WARC/1.1' || {crlf} || {head} || {crlf} || body || {crlf} || {crlf} AS record FROM r)"""


#: Shingles, a join of documents that share one, and closure over the links. Quick on small tables alone.
NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * n_both >= 80 * (nx.n + ny.n - n_both)),
e AS (SELECT x, y FROM linked UNION SELECT y, x FROM linked),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach r ON r.x = w.doc_id GROUP BY ALL"""


INFILL_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c"""

#: crc32 bit by bit; equal words of a document a period apart; islands of them. Quick on small tables alone.
PERIODS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_transform(range(length(doc_id::VARCHAR) * 9), lambda i: CASE WHEN i % 9 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 9 + 1)::INT, 1))::BIGINT ELSE -1::BIGINT END) AS steps FROM documents),
c AS (
  SELECT r, doc_id, ws, len(ws) AS n,
    xor(list_reduce([4294967295::BIGINT] || steps, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM d),
p AS (
  SELECT r, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN
      list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1 END]) ELSE ws END AS ws
  FROM (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM c)),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM p),
e AS (SELECT x.r, y.i - x.i AS q, x.i AS i FROM w x JOIN w y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND (y.i - x.i) * 3 <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM e),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    list({'s': start + period, 'e': start + length}) AS gone FROM runs GROUP BY r),
best AS (SELECT r, start, length, period FROM runs a WHERE NOT EXISTS (
  SELECT 1 FROM runs b WHERE a.r = b.r AND (b.length * a.period > a.length * b.period OR b.length * a.period = a.length * b.period AND (b.start, b.period) < (a.start, a.period)))),
kept AS (
  SELECT w.r, string_agg(w.w, ' ' ORDER BY w.i) AS t FROM w LEFT JOIN listed USING (r)
  WHERE listed.r IS NULL OR NOT list_bool_or(list_transform(gone, lambda x: w.i >= x.s AND w.i < x.e)) GROUP BY w.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM p LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op6_warc": _warc_sql(), "op7_ngram_join": NGRAM_SQL, "op11_infill": INFILL_SQL, "op12_periods": PERIODS_SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
