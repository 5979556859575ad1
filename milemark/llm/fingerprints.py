"""Document fingerprints: a threshold-scaled sketch of word shingles, mergeable, for containment of very unequal documents.

Everything is column functions; no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from milemark.llm import common

# Words in a shingle; hashes are the first 16 hex digits of its MD5, and every hash below LIMIT (an eighth of all) stays.
WORDS = 5
LIMIT = "2000000000000000"
# A document with fewer hashes below the limit keeps this many of its smallest ones, so that short texts have a sketch too.
LEAST = 16
ALL = "g"  # above every hash
BUCKET_BYTES = 64 << 20
# Bounds that come to the driver and go out with the plan: two numbers each.
MAX_BUCKETS = 1 << 16
# Rows alike in id and text above this number (and above a 10,000th of all rows, so at most 10,000 such groups).
MANY_COPIES = 10_000
COPIES_AT_ONCE = 1_000


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashes(text: Column, words: int = WORDS) -> Column:
    """A hash for each run of ``words`` words, repeats included; fewer words make one of all, none none."""

    def of(w: Column) -> Column:
        each = F.transform(w, lambda _, i: F.substring(F.md5(F.array_join(F.slice(w, i + 1, F.lit(words)), " ")), 1, 16))
        return F.slice(each, F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))

    return _bind(F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0)), of)


def retain(found: Column, limit: str = LIMIT, least: int = LEAST) -> Column:
    """The sketch of a set of hashes: all below ``limit``, or the ``least`` smallest if those are fewer; sorted."""

    def of(s: Column) -> Column:
        low = F.filter(s, lambda h: h < limit)
        return _bind(low, lambda x: F.when(F.size(x) >= least, F.sort_array(x)).otherwise(F.slice(F.sort_array(s), 1, least)))

    return _bind(F.array_distinct(found), of)


def sketch(text: Column, words: int = WORDS, limit: str = LIMIT, least: int = LEAST) -> Column:
    """The retained hashes of a text; a null text is empty and has none."""
    return retain(hashes(F.coalesce(text, F.lit("")), words), limit, least)


def merge(a: Column, b: Column, limit: str = LIMIT, least: int = LEAST) -> Column:
    """The sketch of the union of two sets of shingles, from their sketches alone; exact."""
    return retain(F.concat(a, b), limit, least)


def _upto(s: Column, limit: str, least: int) -> Column:
    """Up to which hash a sketch has every one of its set."""
    below = f"{int(limit, 16) - 1:016x}"
    last = F.element_at(s, -1)
    return F.when(F.size(s) < least, ALL).when(last < limit, below).otherwise(last)


def containment(a: Column, b: Column, limit: str = LIMIT, least: int = LEAST) -> Column:
    """Which share of the shingles of ``a`` ``b`` has too, estimated on the hashes of which both sketches know all.

    Two empty sketches: 1, one of them or no hash to go by: 0. The sketches of equal sets give 1.
    """

    def of(upto: Column) -> Column:
        return _bind(
            F.filter(a, lambda h: h <= upto),
            lambda k: F.when(F.size(k) > 0, F.size(F.array_intersect(k, b)) / F.size(k)).otherwise(0.0),
        )

    some = _bind(F.least(_upto(a, limit, least), _upto(b, limit, least)), of)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(some)


def jaccard(a: Column, b: Column, limit: str = LIMIT, least: int = LEAST) -> Column:
    """Shared shingles to all shingles of both, estimated like ``containment``; 1 for two empty sketches."""

    def of(upto: Column) -> Column:
        known = F.filter(F.array_union(a, b), lambda h: h <= upto)
        return _bind(known, lambda k: F.size(F.array_intersect(F.array_intersect(a, b), k)) / F.greatest(F.size(k), F.lit(1)))

    some = _bind(F.least(_upto(a, limit, least), _upto(b, limit, least)), of)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(some)


def _bounds(keys: DataFrame, buckets: int) -> list[tuple[int | None, int]]:
    """The first key of each range of the order, about equal in rows; keys that stand in the table."""
    order = [F.desc_nulls_last("_id"), F.desc("_h")]
    ranged = keys.repartitionByRange(buckets, *order).withColumn("_p", F.spark_partition_id())
    firsts = ranged.groupBy("_p").agg(F.max(F.struct("_id", "_h")).alias("first")).select("first.*")
    return [(r["_id"], r["_h"]) for r in firsts.collect()]


def _numbers(values: list[int | None]) -> Column:
    """A constant array, written as one text so that the plan holds one value and not thousands."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast("array<bigint>")


def _bucket(ids: Column, hs: Column, n: int) -> Column:
    """In which of the sorted ranges a key lies: halving, by steps of falling powers of two."""
    own = F.struct(F.col("_id"), F.col("_h"))

    def step(at: Column, size: Column) -> Column:
        to = at + size
        here = F.struct(F.get(ids, to).alias("_id"), F.get(hs, to).alias("_h"))
        return F.when((to < n) & (here >= own), to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)]), F.lit(0), step)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _text, _s`` (sketch) of every row, and ``_next, _next_s`` of the row that follows.

    Rows are in descending order of the id, null ids last, those of one id by XXH64 of the text; after the last row
    comes the first. Null texts are empty. Texts are exchanged once, by ranges of that order with about ``BUCKET_BYTES``
    of text; the first row of a range is dealt to the range before it as well. Ranges are cut at keys of the table.
    Rows alike in id and text follow one another; where they are very many, one of them is dealt out with their number.
    """
    asked = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    asked = asked.withColumn("_h", F.xxhash64("_text"))
    keys = common.stored(asked.select("_id", "_h", F.octet_length("_text").cast("long").alias("_bytes")))
    rows, size = keys.agg(F.count("*"), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    most = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _bounds(keys, max(1, min(MAX_BUCKETS, max(2 * most, size // BUCKET_BYTES), rows)))
    found.sort(key=lambda k: (k[0] is not None, k[0] or 0, k[1]), reverse=True)
    n = len(found)
    ids, hs = _numbers([k[0] for k in found]), _numbers([k[1] for k in found])

    # At most 10,000 rows, so it may be broadcast whatever the table's size.
    copies = keys.groupBy("_id", "_h").agg(F.count("*").alias("_n")).where(F.col("_n") > max(MANY_COPIES, rows // 10_000))
    copies = common.stored(copies.select(F.col("_id").alias("_i"), F.col("_h").alias("_k"), "_n"))
    one = F.lit(1).cast("long")
    if copies.isEmpty():
        dealt = asked.withColumn("_n", one)
    else:
        same = asked["_id"].eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_k"))
        counted = asked.join(F.broadcast(copies), same, "left").drop("_i", "_k")
        many = counted.where("_n is not null").groupBy("_id", "_h").agg(F.first("_text").alias("_text"), F.first("_n").alias("_n"))
        dealt = counted.where("_n is null").withColumn("_n", one).unionByName(many)
    dealt = dealt.withColumn("_s", sketch(F.col("_text"))).withColumn("_b", _bucket(ids, hs, n))
    place = lambda b, guest: F.struct(b.alias("_b"), F.lit(guest).alias("_guest"))
    first = F.col("_id").eqNullSafe(F.get(ids, F.col("_b"))) & (F.col("_h") == F.get(hs, F.col("_b")))
    here, before = place(F.col("_b"), False), place(F.pmod(F.col("_b") - 1, F.lit(n)), True)
    places = F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here)))
    dealt = dealt.withColumn("_place", places).select("_id", "_h", "_text", "_s", "_n", "_place.*")
    order = Window.partitionBy("_b").orderBy("_guest", F.desc_nulls_last("_id"), F.desc("_h"))
    paired = dealt.withColumns({"_next": F.lead("_text").over(order), "_next_s": F.lead("_s").over(order)}).where("not _guest")
    out = ["_id", "_text", "_s", "_next", "_next_s"]
    lone = paired.where("_n = 1").select(*out, one.alias("_times"))
    if copies.isEmpty():
        return lone
    # Of many rows that are alike the last one is followed by the next document, all others by their like.
    some = paired.where("_n > 1")
    last = some.select(*out, one.alias("_times"))
    others = some.select("_id", "_text", "_s", F.col("_text").alias("_next"), F.col("_s").alias("_next_s"), (F.col("_n") - 1).alias("_times"))
    return lone.unionByName(last).unionByName(others)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint`` and ``edited_fingerprint`` (the sorted
    hashes of the sketch, 16 hex digits each), ``near_edited`` and ``near_next`` (which share of the document's shingles
    the edited text and the next document have), ``jaccard_edited`` and ``jaccard_next``.

    The edited text is the text with its last half (rounded down) replaced by as many code points from the start of the
    next document, see ``with_next``. A null text is empty: an empty fingerprint, likeness 1 to another empty one and 0 to
    all others. Repeated rows give repeated rows, an empty table none; a single document is its own next. Other columns
    are not read.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("_text", F.col("n_chars").cast("int") - half), F.left("_next", half))
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("_text").cast("long"))
    rows = rows.select("_id", "n_chars", "_s", "_next_s", "_times", edited.alias("_edited"))
    rows = rows.select("*", sketch(F.col("_edited")).alias("_edited_s"))
    s, e, x = F.col("_s"), F.col("_edited_s"), F.col("_next_s")
    out = rows.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        F.array_join(s, "").alias("fingerprint"), F.array_join(e, "").alias("edited_fingerprint"),
        containment(s, e).alias("near_edited"), containment(s, x).alias("near_next"),
        jaccard(s, e).alias("jaccard_edited"), jaccard(s, x).alias("jaccard_next"), "_times",
    )
    lone, many = out.where("_times = 1").drop("_times"), out.where("_times > 1")
    # Copies are written out in two steps, so that neither an array nor a task holds all of them.
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / COPIES_AT_ONCE)))
    some = many.withColumn("_step", steps).withColumn("_left", F.least(F.col("_times") - F.col("_step") * COPIES_AT_ONCE, F.lit(COPIES_AT_ONCE)))
    some = some.repartition(F.xxhash64(id_col, "fingerprint", "_step"))
    each = F.explode(F.array_repeat(F.lit(True), F.col("_left").cast("int")))
    return lone.unionByName(some.withColumn("_each", each).select(*lone.columns))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = rf"""
WITH o AS (
    SELECT doc_id, coalesce(text, '') AS t,
           coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS x
    FROM documents WINDOW w AS (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), c AS (
    SELECT row_number() OVER () AS r, doc_id, length(t) AS n_chars, t, x, left(t, length(t) - length(t) // 2) || left(x, length(t) // 2) AS e FROM o
), v AS (
    SELECT r, k, regexp_extract_all(t, '{common.WORD}') AS w
    FROM (SELECT r, 't' AS k, t FROM c UNION ALL SELECT r, 'e', e FROM c UNION ALL SELECT r, 'x', x FROM c)
), h AS (
    SELECT r, k, list_sort(list_distinct(list_transform(
               range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - {WORDS - 2}, 2) END),
               lambda i: substr(md5(array_to_string(w[i:i + {WORDS - 1}], ' ')), 1, 16)))) AS h
    FROM v
), s AS (
    SELECT r, k, CASE WHEN len(list_filter(h, lambda y: y < '{LIMIT}')) >= {LEAST}
                      THEN list_filter(h, lambda y: y < '{LIMIT}') ELSE h[1:{LEAST}] END AS s
    FROM h
), u AS (
    SELECT r, k, s, CASE WHEN len(s) < {LEAST} THEN '{ALL}' WHEN s[-1] < '{LIMIT}' THEN '{int(LIMIT, 16) - 1:016x}' ELSE s[-1] END AS upto FROM s
), p AS (
    SELECT c.doc_id, c.n_chars, sha256(c.e) AS edited_sha256, a.s AS s, b.s AS e, x.s AS x, least(a.upto, b.upto) AS ue, least(a.upto, x.upto) AS ux
    FROM c JOIN u a ON c.r = a.r AND a.k = 't' JOIN u b ON c.r = b.r AND b.k = 'e' JOIN u x ON c.r = x.r AND x.k = 'x'
), q AS (
    SELECT *, len(list_filter(s, lambda y: y <= ue)) AS own_e, len(list_filter(list_intersect(s, e), lambda y: y <= ue)) AS both_e,
           len(list_filter(list_distinct(s || e), lambda y: y <= ue)) AS all_e,
           len(list_filter(s, lambda y: y <= ux)) AS own_x, len(list_filter(list_intersect(s, x), lambda y: y <= ux)) AS both_x,
           len(list_filter(list_distinct(s || x), lambda y: y <= ux)) AS all_x
    FROM p
)
SELECT doc_id, n_chars, edited_sha256, array_to_string(s, '') AS fingerprint, array_to_string(e, '') AS edited_fingerprint,
       CASE WHEN len(s) + len(e) = 0 THEN 1.0 WHEN len(s) = 0 OR len(e) = 0 OR own_e = 0 THEN 0.0 ELSE both_e / own_e END::DOUBLE AS near_edited,
       CASE WHEN len(s) + len(x) = 0 THEN 1.0 WHEN len(s) = 0 OR len(x) = 0 OR own_x = 0 THEN 0.0 ELSE both_x / own_x END::DOUBLE AS near_next,
       CASE WHEN len(s) + len(e) = 0 THEN 1.0 WHEN len(s) = 0 OR len(e) = 0 THEN 0.0 ELSE both_e / greatest(all_e, 1) END::DOUBLE AS jaccard_edited,
       CASE WHEN len(s) + len(x) = 0 THEN 1.0 WHEN len(s) = 0 OR len(x) = 0 THEN 0.0 ELSE both_x / greatest(all_x, 1) END::DOUBLE AS jaccard_next
FROM q
"""
