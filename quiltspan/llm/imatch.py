"""Document fingerprints by I-Match: hashes of the sorted terms that a text shares with randomised lexicon subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: The band of the lexicon: terms in MIN_DF texts or more, and in one of MAX_SHARE texts or fewer (an idf of ln(64)).
MIN_DF, MAX_SHARE = 2, 64
#: A text with fewer terms in the band is hashed by all of its terms.
LEAST_TERMS = 8
#: A text takes the density at which some TERMS of its terms are left, and the next DEPTHS - 1; each has 64 subsets.
DEPTHS, TERMS = 3, 64
#: Texts with more copies than one in so many rows count once in document frequencies; fewer than so many are such.
HEAVY = 10_000
#: Rows of a bucket in which neighbours meet, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 5_000, 65_536
#: A term meets the lexicon by so many bits of its digest, of which the highest _PART go into hashes; the highest _SLOT
#: of these tell its subset.
_KEY, _PART, _SLOT = 40, 32, 6


def terms_of(text: Column) -> Column:
    """The distinct lower-cased words of a text. Other white space is made blanks first: splitting at one character
    needs no regular expression."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.array_distinct(F.split(F.lower(text), " ")), "")


def _bit_length(x: Column) -> Column:
    return F.when(x <= 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def _level(terms: Column) -> Column:
    """The number of halvings that leave TERMS of so many terms or fewer."""
    return _bit_length(F.floor((F.size(terms) - 1) / F.lit(TERMS)).cast("long"))


def _below(level: Column) -> Column:
    """MD5 digests below this are those of one in 2^level terms: the lexicon subsets of a level lie within them."""
    return F.when(level == 0, F.lit("g")).otherwise(F.lower(F.lpad(F.hex(F.call_function("shiftright", F.lit(1 << 32).cast("long"), level)), 8, "0")))


def lexicon(docs: DataFrame) -> DataFrame:
    """term_key of every term in the band. Document frequencies are counted over all texts; a text of which more than
    one in HEAVY rows is a copy counts once, as otherwise its terms would look common (there are fewer than HEAVY
    such texts, so that they may be broadcast)."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("same", F.xxhash64("text"))
    total = docs.count()
    copies = texts.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HEAVY > total)
    heavy = cut(copies.select("same"), "imatch-heavy")
    once = texts.join(F.broadcast(heavy), "same", "left_semi").groupBy("same").agg(F.first("text").alias("text")).select("text")
    others = texts.join(F.broadcast(heavy), "same", "left_anti").select("text")
    counted = others.select(F.explode(terms_of(F.col("text"))).alias("term")).union(once.select(F.explode(terms_of(F.col("text"))).alias("term")))
    n_texts = others.count() + once.count()
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.where((F.col("df") >= MIN_DF) & (F.col("df") * MAX_SHARE <= max(n_texts, MIN_DF * MAX_SHARE))).select(_key(F.md5("term")).alias("term_key"))


def _key(md5: Column) -> Column:
    return F.shiftright(F.conv(F.substring(md5, 9, 15), 16, 10).cast("long"), 60 - _KEY)


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text, rid, next_text, next_rid: each row with the next one by doc_id (null last, equal ones by text),
    after the last the first. rid numbers the rows.

    The order is cut in buckets of about ``bucket_rows`` rows by bounds from a bounded sample of its keys. A bucket
    also gets the first row of the next one, so that each row's successor stands beside it and texts are shuffled
    once. Rows that are equal in doc_id and text are interchangeable, and share a bucket.
    """
    sign = F.lit(-(1 << 63)).cast("long")
    digest = F.md5("text")
    skey = F.when(F.col("doc_id").isNull(), F.concat(F.lit("g"), digest)).otherwise(F.concat(F.lower(F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(sign)), 16, "0")), digest))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("skey", skey)
    buckets = min(MOST_BUCKETS, max(1, -(-docs.count() // bucket_rows)))
    sample = sorted(r[0] for r in base.select("skey").orderBy(F.xxhash64("skey")).limit(16 * buckets).collect())
    bounds = sample[16::16] or ["~"]
    # binary search: the number of bounds that are not above the key
    steps = len(bounds).bit_length()
    search = f"aggregate(sequence({steps - 1}, 0, -1), 0, (at, i) -> if(at + shiftleft(1, i) <= {len(bounds)} AND element_at(__bounds, least(at + shiftleft(1, i), {len(bounds)})) <= skey, at + shiftleft(1, i), at))"
    base = base.withColumn("__bounds", F.array(*[F.lit(b) for b in bounds])).withColumn("bucket", F.expr(search)).drop("__bounds")
    base = base.withColumn("home", F.col("bucket")).withColumn("visitor", F.lit(False))
    order = Window.orderBy("bucket")  # over one row for each bucket
    firsts = base.groupBy("bucket").agg(F.min("skey").alias("first_key"))
    to = firsts.select("first_key", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    visitors = base.join(F.broadcast(to), base["skey"] == F.col("first_key"))
    base = base.union(visitors.select("doc_id", "text", "skey", F.col("to").alias("bucket"), "home", F.lit(True).alias("visitor")))
    w = Window.partitionBy("bucket").orderBy("visitor", "skey")
    number = F.shiftleft(F.col("bucket").cast("long"), 32) + F.row_number().over(w)
    rows = base.select("doc_id", "text", "visitor", number.alias("rid"), F.lead("text").over(w).alias("next_text"), F.lead("visitor").over(w).alias("to_next"), F.lead("home").over(w).alias("next_home"))
    next_rid = F.when(F.col("to_next"), F.shiftleft(F.col("next_home").cast("long"), 32) + 1).otherwise(F.col("rid") + 1)
    return rows.where(~F.col("visitor")).select("doc_id", "text", "rid", "next_text", next_rid.alias("next_rid"))


def _sampled(terms: str, below: Column) -> Column:
    return F.filter(terms, lambda t: F.md5(t) < below)


def _packed() -> Column:
    """A term as one number: key, level, whose it is (1: the text's, 2: the edited text's), in the band or not."""
    return F.shiftleft(F.shiftright("key", _KEY - _PART), 9) + F.col("level").cast("long") * 8 + F.col("sides") * 2 + F.coalesce(F.col("in_band"), F.lit(0))


def _used(terms: str, bit: int) -> Column:
    """The terms of a text, in order of their keys, that its hashes are made of."""
    mine = F.filter(terms, lambda t: t.bitwiseAND(F.lit(2 * bit)) != 0)
    band = F.filter(mine, lambda t: t.bitwiseAND(F.lit(1)) != 0)
    return F.when(F.size(band) >= LEAST_TERMS, band).otherwise(mine)


def _prints(used: str, level: str) -> Column:
    """One number for each density and subset with a term of the text: level, subset, and 16 bits of the hash of the
    subset's terms. Terms come in order of their keys, and so by subset: each subset's keys are joined to one string."""
    by_density = []
    for depth in range(DEPTHS):
        by_density.append(_hashed(_at_least(used, F.col(level) + depth), F.col(level) + depth))
    return F.concat(*by_density)


def _at_least(used: str, level: Column) -> Column:
    return F.filter(used, lambda t: F.shiftright(t, 3).bitwiseAND(F.lit(63)) >= level)


def _hashed(kept: Column, level: Column) -> Column:
    slot = lambda t: F.shiftright(t, 9 + _PART - _SLOT)
    before = F.concat(F.array(F.lit(-1).cast("long")), kept)
    marked = F.zip_with(
        kept,
        F.slice(before, F.lit(1), F.size(kept)),
        lambda t, p: F.concat(F.when(slot(t) == slot(p), F.lit(",")).otherwise(F.concat(F.lit(";"), F.lpad(slot(t).cast("string"), 2, "0"))), F.shiftright(t, 9).cast("string")),
    )
    subsets = F.filter(F.split(F.array_join(marked, ""), ";"), lambda x: x != "")
    digest = lambda x: F.conv(F.substring(F.md5(x.substr(F.lit(3), F.length(x))), 1, 4), 16, 10).cast("int")
    return F.transform(subsets, lambda x: level * (1 << 24) + F.substring(x, 1, 2).cast("int") * (1 << 16) + digest(x))


def likeness(a: str, b: str) -> Column:
    """The share of equal hashes among the subsets with a term of either text, over the densities that both have; 1 if
    all terms are equal, 0 without a common hash. a and b: names of columns x_prints, x_level and x_full."""
    low, high = F.greatest(f"{a}_level", f"{b}_level"), F.least(f"{a}_level", f"{b}_level") + (DEPTHS - 1)
    x, y = (F.filter(f"{c}_prints", lambda e: F.shiftright(e, 24).between(low, high)) for c in (a, b))
    subset = lambda e: F.shiftright(e, 16)
    seen = F.size(x) + F.size(y) - F.size(F.array_intersect(F.transform(x, subset), F.transform(y, subset)))
    equal = F.size(F.array_intersect(x, y))
    return F.when(F.col(f"{a}_full") == F.col(f"{b}_full"), F.lit(1.0)).when(seen == 0, F.lit(0.0)).otherwise(equal.cast("double") / seen)


def _text(side: str) -> Column:
    hex8 = lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))
    return F.concat(hex8(F.col(f"{side}_full")), F.array_join(F.transform(f"{side}_prints", hex8), ""))


def fingerprints(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The lexicon is a band of document frequencies. Its subsets are drawn by the terms' digests: at each density (one
    in 2^level terms) the terms left fall in 64 subsets, and a subset's hash is that of the text's sorted terms
    in it. A text has the hashes of the DEPTHS densities that suit its number of terms, so that long texts need no
    more terms than short ones, and hashes of few terms tell texts that share a part. A fingerprint is 8 digits of the
    hash of all its distinct terms (as when no lexicon restricts them), then 8 for each subset with a term of the text:
    two each for level and subset, four for the hash.

    Null and empty texts have no terms and one fingerprint. Rows with equal texts have equal fingerprints; equal rows
    each have their own. Null doc_ids come last in the order, by text. Long texts are read whole. A single row is its
    own next one. An empty table gives no rows. Other columns may have any names.
    """
    rows = with_next(docs, bucket_rows)
    half = F.floor(F.char_length("text") / F.lit(2)).cast("int")
    rows = rows.withColumn("half", half).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.char_length("text") - F.col("half")), F.col("next_text").substr(F.lit(1), F.col("half"))))
    rows = rows.select("rid", "next_rid", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"), terms_of(F.col("text")).alias("own"), terms_of(F.col("edited")).alias("new"))
    for side in ("own", "new"):
        full = F.conv(F.substring(F.md5(F.array_join(F.array_sort(side), " ")), 1, 8), 16, 10).cast("long")
        rows = rows.withColumns({f"{side}_level": _level(F.col(side)), f"{side}_full": full})
        rows = rows.withColumn(f"{side}_below", _below(F.col(f"{side}_level")))
        below = F.col(f"{side}_below")
        rows = rows.withColumn(side, _sampled(side, below))
    level = lambda md5: F.lit(32) - _bit_length(F.conv(F.substring(md5, 1, 8), 16, 10).cast("long"))
    both = F.transform(
        F.array_union("own", "new"),
        lambda t: F.struct(
            _key(F.md5(t)).alias("key"), level(F.md5(t)).cast("int").alias("level"), (F.array_contains("own", t).cast("int") + F.array_contains("new", t).cast("int") * 2).alias("sides")
        ),
    )
    # the first row of a document holds what is known of it, under a key of no term
    header = F.array(F.struct((-F.col("rid")).alias("key"), F.lit(0).alias("level"), F.lit(0).alias("sides")))
    about = F.struct("next_rid", "doc_id", "n_chars", "sha", "own_level", "own_full", "new_level", "new_full")
    sent = rows.select("rid", about.alias("about"), F.explode(F.concat(header, both)).alias("t")).select("rid", F.when(F.col("t.sides") == 0, F.col("about")).alias("about"), "t.*")
    band = cut(lexicon(docs), "imatch-lexicon", free=True).withColumn("in_band", F.lit(1))
    known = sent.join(band, sent["key"] == F.col("term_key"), "left")
    term = F.when(F.col("sides") > 0, _packed())
    grouped = known.groupBy("rid").agg(F.first("about", ignorenulls=True).alias("about"), F.array_sort(F.collect_list(term)).alias("terms")).select("rid", "about.*", "terms")
    for side, bit in (("own", 1), ("new", 2)):
        # asked for twice, so that the plan keeps it as a column of its own
        grouped = grouped.withColumn("used", _used("terms", bit))
        grouped = grouped.withColumn(f"{side}_prints", F.when(F.size("used") >= 0, _prints("used", f"{side}_level"))).drop("used")
    done = cut(grouped.drop("terms").withColumn("near_edited", likeness("own", "new")), "imatch-prints", free=True)
    following = done.select(F.col("rid").alias("of"), *(F.col(f"own_{x}").alias(f"next_{x}") for x in ("prints", "level", "full")))
    out = done.join(following, done["next_rid"] == following["of"])
    return out.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), _text("own").alias("fingerprint"), _text("new").alias("edited_fingerprint"), "near_edited", likeness("own", "next").alias("near_next"))


def op11_imatch_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS r, count(*) OVER () AS total, doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT a.r, b.r AS next_r, a.doc_id, a.text, length(a.text) AS n_chars, left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited
      FROM d AS a JOIN d AS b ON b.r = CASE WHEN a.r = a.total THEN 1 ELSE a.r + 1 END),
copies AS (SELECT text, CASE WHEN count(*) * 10000 > any_value(total) THEN 1 ELSE count(*) END AS times FROM d GROUP BY text),
counts AS (SELECT term, sum(times) AS df FROM (SELECT times, unnest(list_distinct(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'))) AS term FROM copies) AS c GROUP BY term),
lexicon AS (SELECT term FROM counts WHERE df >= 2 AND df * 64 <= greatest((SELECT sum(times) FROM copies), 128)),
texts AS (SELECT r, 1 AS side, text FROM e UNION ALL SELECT r, 2, edited FROM e),
lists AS (SELECT r, side, list_distinct(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS terms FROM texts),
levels AS (SELECT r, side, terms, CASE WHEN (len(terms) - 1) // 64 <= 0 THEN 0 ELSE length(bin((len(terms) - 1) // 64)) END AS level,
           left(md5(coalesce(array_to_string(list_sort(terms), ' '), '')), 8) AS full_hash FROM lists),
words AS (SELECT r, side, level, unnest(terms) AS term FROM levels),
hashed AS (SELECT r, side, level, term, CAST('0x' || substr(md5(term), 9, 15) AS BIGINT) >> 28 AS key, CAST('0x' || left(md5(term), 8) AS BIGINT) AS head FROM words),
sampled AS (SELECT h.*, lexicon.term IS NOT NULL AS in_band, 32 - CASE WHEN head = 0 THEN 0 ELSE length(bin(head)) END AS depth FROM hashed AS h LEFT JOIN lexicon USING (term) WHERE head < 4294967296 >> level),
used AS (SELECT * FROM (SELECT *, count(*) FILTER (in_band) OVER (PARTITION BY r, side) AS n_band FROM sampled) AS s WHERE in_band OR n_band < 8),
slots AS (SELECT r, side, level + i AS at, key >> 26 AS slot, left(md5(string_agg(CAST(key AS VARCHAR), ',' ORDER BY key)), 4) AS hash
          FROM used, (SELECT unnest([0, 1, 2]) AS i) AS depths WHERE depth >= level + i GROUP BY r, side, level + i, key >> 26),
numbers AS (SELECT unnest(range(64)) AS slot),
prints AS (SELECT l.r, l.side, any_value(l.level) AS level, any_value(full_hash) AS full_hash,
           any_value(full_hash) || coalesce(string_agg(printf('%02x%02x', slots.at, slots.slot) || hash, '' ORDER BY slots.at, slots.slot), '') AS print
           FROM levels AS l LEFT JOIN slots ON slots.r = l.r AND slots.side = l.side GROUP BY l.r, l.side),
wanted AS (SELECT r, r AS other, 2 AS other_side FROM e UNION ALL SELECT r, next_r, 1 FROM e),
compared AS (SELECT w.r, other_side, count(*) FILTER (a.hash = b.hash) AS same, count(*) AS seen
  FROM wanted AS w CROSS JOIN (SELECT unnest(range(0, 40)) AS at) AS heights CROSS JOIN numbers
  JOIN prints AS p ON p.r = w.r AND p.side = 1 AND heights.at BETWEEN p.level AND p.level + 2 JOIN prints AS q ON q.r = other AND q.side = other_side AND heights.at BETWEEN q.level AND q.level + 2
  LEFT JOIN slots AS a ON a.r = w.r AND a.side = 1 AND a.at = heights.at AND a.slot = numbers.slot LEFT JOIN slots AS b ON b.r = other AND b.side = other_side AND b.at = heights.at AND b.slot = numbers.slot
  WHERE a.hash IS NOT NULL OR b.hash IS NOT NULL GROUP BY w.r, other_side),
near AS (SELECT w.r, w.other_side, CASE WHEN p.full_hash = q.full_hash THEN 1.0 ELSE coalesce(same / CAST(seen AS DOUBLE), 0.0) END AS near
  FROM wanted AS w JOIN prints AS p ON p.r = w.r AND p.side = 1 JOIN prints AS q ON q.r = w.other AND q.side = w.other_side LEFT JOIN compared AS c ON c.r = w.r AND c.other_side = w.other_side)
SELECT e.doc_id, n_chars, sha256(edited) AS edited_sha256, p.print AS fingerprint, q.print AS edited_fingerprint, CAST(x.near AS DOUBLE) AS near_edited, CAST(y.near AS DOUBLE) AS near_next
FROM e JOIN prints AS p ON p.r = e.r AND p.side = 1 JOIN prints AS q ON q.r = e.r AND q.side = 2 JOIN near AS x ON x.r = e.r AND x.other_side = 2 JOIN near AS y ON y.r = e.r AND y.other_side = 1
"""
