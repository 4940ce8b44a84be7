"""Canonical exact digests of documents, by DataFrame and SQL functions only.

A text's canonical form is its NFKC normalisation, case-folded, normalised
again, with runs of white space folded to one space and none at either end.
Its fingerprint is 128 bits wide: two xxhash64 digests with different salts.
Equal canonical forms have equal fingerprints; where fingerprints are equal,
the canonical bytes are compared, so that a collision joins nothing.

Normalisation and folding are ICU's, which Spark ships, called by the SQL
function java_method.

Defined cases: a null text counts as empty; empty texts share one fingerprint;
a row with a null id takes part, and has no next document; repeated rows get
equal rows; empty tables give empty results; input columns with a result's name
are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

#: White space of Unicode, as NFKC leaves it.
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _compose(text: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def _fold(text: Column) -> Column:
    return F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC, white space folding.

    Texts of ASCII alone need no normalisation, and lower() folds their case.
    """
    t = F.coalesce(text, F.lit(""))
    plain = ~t.rlike(r"[^\x00-\x7F]")
    folded = F.when(plain, F.lower(t)).otherwise(_compose(_fold(_compose(t))))
    return F.trim(F.regexp_replace(folded, _SPACE, " "))


def wide_hash(canon: Column) -> Column:
    """32 hex digits of two salted xxhash64 digests."""
    parts = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(salt), canon))), 16, "0") for salt in ("first", "second")]
    return F.concat(*parts)


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text. The canonical form is a column first, so that it is made once for both halves of the hash."""
    return df.withColumn("__canon", canonical(F.col(text))).withColumn(out, wide_hash(F.col("__canon"))).drop("__canon")


def likeness(text: Column, fingerprint: Column, other: Column, other_fingerprint: Column) -> Column:
    """1 if two texts have the same canonical bytes, else 0; bytes are made and compared where fingerprints agree."""
    return F.when(fingerprint == other_fingerprint, (canonical(text) == canonical(other)).cast("double")).otherwise(F.lit(0.0))


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", fingerprints: DataFrame | None = None, max_bits: int = 1 << 27) -> DataFrame:
    """(doc_id, fingerprint, group_id): the smallest id of the documents with the same canonical bytes.

    ``fingerprints`` are the rows' (doc_id, fingerprint) where they are known
    already. Only documents whose fingerprint others share are made canonical
    and compared by bytes. A bitmap of their hashed ids, broadcast, keeps the
    others out of that shuffle: eight bits for each, in maps of 32,768 and at
    most ``max_bits`` (16 MB); those that it lets pass cost time and change
    nothing. Copies meet as one text a task, as the grouping adds up before it
    shuffles. Rows then find their group by the fingerprint, without their
    text; groups of over a thousandth of all copies, of which there are fewer
    than 1,000, are broadcast to them. Where different texts have one
    fingerprint, the rows of it find their group by their bytes.
    """
    per = 32768  # bits of one bitmap of bitmap_construct_agg
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = with_fingerprint(docs).drop("text") if fingerprints is None else fingerprints.select("doc_id", "fingerprint")
    known = known if fingerprints is not None else cut(known)
    shared = cut(known.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    copies = int(shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    common = (F.col("n") > 1) & (F.col("n") * 1000 > copies)  # fewer than 1,000 fingerprints
    bits = min(max_bits, max(per, 1 << (8 * copies).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    often = shared.where(common).select("fingerprint", F.lit(True).alias("__often"))
    met = known.join(F.broadcast(often), "fingerprint", "left")
    seldom = met.where("__often is null").join(shared.where(~common), "fingerprint", "left_semi")
    maps = (
        met.where("__often").unionByName(seldom)
        .select(bit.alias("__bit"))
        .groupBy(F.floor(F.col("__bit") / per).alias("__map"))
        .agg(F.expr(f"bitmap_construct_agg(__bit % {per})").alias("__bits"))
    )

    def flagged(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumns({"__map": F.floor(bit / per), "__pos": (bit % per).cast("int")})
            .join(F.broadcast(maps), "__map", "left")
            .withColumn("__byte", F.expr("cast(conv(hex(substring(__bits, cast(__pos div 8 as int) + 1, 1)), 16, 10) as int)"))
            .withColumn("__maybe", F.coalesce(F.expr("getbit(__byte, __pos % 8) = 1"), F.lit(False)))
        )

    rest = flagged(known).where(~F.col("__maybe")).select("doc_id", "fingerprint", F.col("doc_id").alias("group_id"))
    checked = flagged(docs).where("__maybe").select("doc_id", canonical(F.col("text")).alias("__canon")).withColumn("fingerprint", wide_hash(F.col("__canon")))
    texts = checked.groupBy("fingerprint", "__canon").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    groups = cut(texts.groupBy("fingerprint").agg(F.min("group_id").alias("group_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_texts")))
    hot = groups.where(common & (F.col("n_texts") == 1)).select("fingerprint", F.col("group_id").alias("__group"), F.lit(True).alias("__hot"))
    maybe = flagged(known).where("__maybe").select("doc_id", "fingerprint").join(F.broadcast(hot), "fingerprint", "left")
    told = maybe.where("__hot").select("doc_id", "fingerprint", F.col("__group").alias("group_id"))
    others = groups.where(~common & (F.col("n_texts") == 1)).select("fingerprint", "group_id")
    out = rest.unionByName(told).unionByName(maybe.where("__hot is null").join(others, "fingerprint").select("doc_id", "fingerprint", "group_id"))
    collided = groups.where("n_texts > 1").select("fingerprint")
    if collided.limit(1).count():
        apart = checked.join(collided, "fingerprint", "left_semi").join(texts.drop("n"), ["fingerprint", "__canon"])
        out = out.unionByName(apart.select("doc_id", "fingerprint", "group_id"))
    return out


def with_next(df: DataFrame, doc_id: str, columns: Mapping[str, str], buckets: int | None = None) -> DataFrame:
    """Add ``columns`` (new name: column) of the next document by ascending id, after the last those of the first.

    Rows are dealt to ranges of ids between quantiles, which are ids that
    occur; the document that begins a range also goes, marked, to the range
    before, so that each range finds its last row's successor by itself and no
    task sees all rows. Of rows with one id, the order is by the columns. Rows
    with a null id have no next document: null.
    """
    spark = df.sparkSession
    n = buckets or 8 * shuffle_partitions(spark)
    rows = df.where(F.col(doc_id).isNotNull())
    found = rows.agg(F.min(doc_id).alias("first"), F.percentile_approx(doc_id, [i / n for i in range(1, n)], 20 * n).alias("cuts")).first()
    cuts = sorted({found["first"], *(found["cuts"] or [])} - {None})
    none = df.where(F.col(doc_id).isNull()).withColumns({name: F.lit(None).cast(df.schema[c].dataType) for name, c in columns.items()})
    if not cuts:
        return none
    starts = spark.createDataFrame([(c, (i - 1) % len(cuts)) for i, c in enumerate(cuts)], "__start long, __before long")
    dealt = rows.join(F.broadcast(starts), F.col(doc_id) == F.col("__start"), "left")
    dealt = dealt.withColumn("__bucket", _position(F.col(doc_id), cuts))
    dealt = dealt.withColumn(
        "__copies",
        F.when(F.col("__start").isNull(), F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("mark"))))
        .otherwise(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("mark")), F.struct(F.col("__before").alias("b"), F.lit(True).alias("mark")))),
    )
    placed = dealt.select(*df.columns, F.explode("__copies").alias("__to")).select(*df.columns, "__to.b", "__to.mark")
    order = Window.partitionBy("b").orderBy("mark", doc_id, *columns.values())
    next_rows = placed.withColumns({name: F.lead(c).over(order) for name, c in columns.items()}).where(~F.col("mark")).drop("b", "mark")
    return next_rows.unionByName(none)


def _position(x: Column, cuts: list[int]) -> Column:
    """Index of the last cut that is not above x: a search of two steps over rows of cuts."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    rows = F.array(*[F.array(*[F.lit(c).cast("long") for c in g]) for g in groups])
    at = F.size(F.filter(heads, lambda b: b <= x))
    return ((at - 1) * step + F.size(F.filter(F.element_at(rows, at), lambda b: b <= x)) - 1).cast("long")
