"""Document fingerprints (operator 12), in DataFrame functions only: one-permutation MinHash with optimal densification.

A text's shingles are its windows of five words (``[^\\x20\\x09-\\x0D]+``; a text of one to four words is one shingle).  Each
shingle is hashed once to 64 bits; the upper 8 bits name one of 256 bins, and a bin keeps its least hash: sorted hashes are
grouped by bin, so that is the first of each run.  An empty bin borrows from the bin that its own fixed sequence of pseudo
random tries first finds filled, independently of the other empty bins (optimal densification); after ``TRIES`` tries it takes
the filled bin that ranks least by a hash of both bins, which always exists.  Of each bin the low 4 bits are stored (of its
hash mixed with the bin's number), 16 bins to a long, written as 256 hexadecimal digits.

Likeness of two fingerprints: the share of equal bins, less the chance 1/16 that differing bins agree (bias correction), cut
to 0..1.  The standard error is below 0.04.

Neighbours.  ``with_next`` finds the next document by id without one sorted task: ids are cut into buckets (quantiles, then
equal widths within one), texts are dealt by bucket once, and a window looks ahead within each bucket; only the first rows of
buckets travel on, to the last row of the bucket before, first within a quantile, then among the at most ``QUANTILES``
quantiles.

Cases: null and empty texts and texts of white space have no shingles, the empty fingerprint, likeness 1 with each other and 0
with others; equal texts have equal fingerprints; documents with the same id go by their text; null ids come first; a single
document is its own next; an empty table gives no rows; extra columns are not read; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcquarry.llm.common import discard, stored

SPACE = r" \t\n\u000b\u000c\r"
BINS, BITS, TRIES = 256, 4, 8
PER_LONG = 64 // BITS
#: Buckets of ids hold about so many documents; at most so many quantiles are asked for, in two steps of 64.
BUCKET, QUANTILES = 512, 4096
BIN_OF = "shiftright({}, 56)"  # -128 to 127


def words(text: str) -> str:
    trimmed = f"trim(BOTH '{SPACE}' FROM {text})"
    return f"CASE WHEN {trimmed} = '' THEN CAST(array() AS array<string>) ELSE split({trimmed}, '[\\\\x20\\\\x09-\\\\x0D]+') END"


def windows(w: str) -> str:
    """Hashes of the windows of five words, in order; none for fewer words."""
    each = ", ".join(f"get({w}, i + {k})" for k in range(5))
    return f"CASE WHEN size({w}) >= 5 THEN transform(sequence(0, size({w}) - 5), i -> xxhash64({each})) ELSE CAST(array() AS array<bigint>) END"


def or_whole(hashes: str, w: str) -> str:
    """``hashes``, or for one to four words the hash of all of them."""
    return f"CASE WHEN size({w}) BETWEEN 1 AND 4 THEN array(xxhash64({w})) ELSE {hashes} END"


def edited_windows(df: DataFrame) -> DataFrame:
    """Adds ``_ew``, the words of the end of the edited text, and ``_eh``, hashes of all its windows.

    Windows of whole words before the cut are those of the text (``_h`` of the words ``_w`` of ``_t``).  Only the last four
    words there, what is left of a word at the cut, and ``_donor`` are split and hashed.  ``_cut`` is the length that stays.
    """
    df = df.withColumn("_gone", F.expr(words("substring(_t, _cut + 1, length(_t))")))
    df = df.withColumn("_open", F.expr(f"_cut > 0 AND trim(BOTH '{SPACE}' FROM substring(_t, _cut, 1)) <> ''"))
    df = df.withColumn("_inside", F.expr(f"_open AND trim(BOTH '{SPACE}' FROM substring(_t, _cut + 1, 1)) <> ''"))
    df = df.withColumn("_whole", F.expr("size(_w) - size(_gone) - CASE WHEN _open AND NOT _inside THEN 1 ELSE 0 END"))
    piece = "CASE WHEN _inside THEN substring(_w[_whole], 1, length(_w[_whole]) - length(_gone[0])) WHEN _open THEN _w[_whole] ELSE '' END"
    end = f"concat(array_join(slice(_w, greatest(_whole - 3, 1), least(_whole, 4)), ' '), ' ', {piece}, _donor)"
    df = df.withColumn("_end", F.expr(end)).withColumn("_ew", F.expr(words("_end")))
    hashes = f"CASE WHEN _whole > 4 THEN concat(slice(_h, 1, _whole - 4), {windows('_ew')}) ELSE {or_whole(windows('_ew'), '_ew')} END"
    return df.withColumn("_eh", F.expr(hashes))


def firsts(hashes: str) -> Column:
    """The least hash of each filled bin, in order of bins, of sorted hashes."""
    return F.expr(f"filter({hashes}, (x, i) -> i = 0 OR {BIN_OF.format('x')} <> {BIN_OF.format(f'{hashes}[i - 1]')})")


def with_gaps(least: str) -> Column:
    """The ``least`` hashes in an array of all bins, null where a bin is empty."""
    bin_at = lambda i: f"CAST({BIN_OF.format(f'get({least}, {i})')} AS int)"
    none = "CAST(NULL AS bigint)"
    run = f"concat(array(get({least}, i)), array_repeat({none}, coalesce({bin_at('i + 1')}, {BINS // 2}) - {bin_at('i')} - 1))"
    return F.expr(f"concat(array_repeat({none}, {bin_at('0')} + {BINS // 2}), flatten(transform(sequence(0, size({least}) - 1), i -> {run})))")


def low_bits(least: str, own: str) -> Column:
    """The stored bits of all bins: of their ``own`` hashes, borrowed from other bins where there is none.

    A hash is mixed with the bin that stores it, so that bins that borrow the same hash still agree by chance one by one.
    """
    tries = ", ".join(f"get({own}, CAST(xxhash64(b, {t}) & {BINS - 1} AS int))" for t in range(TRIES))
    ranked = f"array_min(transform({least}, x -> struct(xxhash64(b, {BIN_OF.format('x')}) AS r, x AS x))).x"
    return F.expr(f"transform({own}, (x, b) -> xxhash64(coalesce(x, {tries}, {ranked}), b) & {(1 << BITS) - 1})")


def packed(bits: str) -> Column:
    """``bits`` of the bins, 16 to a long; null without shingles."""
    longs = BINS // PER_LONG
    one = f"aggregate(slice({bits}, 16 * g + 1, 16), 0L, (a, x) -> shiftleft(a, {BITS}) | x)"
    return F.expr(f"CASE WHEN {bits} IS NOT NULL THEN transform(sequence(0, {longs - 1}), g -> {one}) END")


def with_fingerprint(df: DataFrame, hashes: str, to: str) -> DataFrame:
    """``df`` with a column ``to``: array<long> of the column ``hashes`` of a text's shingles, null where it has none.

    The steps are columns of their own, so that each is worked out once.
    """
    kept = df.columns
    df = df.withColumn("_sorted", F.sort_array(hashes)).withColumn("_least", firsts("_sorted"))
    df = df.withColumn("_own", F.when(F.size("_least") > 0, with_gaps("_least")))
    return df.withColumn("_bits", low_bits("_least", "_own")).withColumn(to, packed("_bits")).select(*kept, to)


def fingerprint_of(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with the fingerprint of its column ``text`` as ``to``."""
    kept = df.columns
    df = df.withColumn("_w", F.expr(words(f"coalesce({text}, '')"))).withColumn("_h", F.expr(or_whole(windows("_w"), "_w")))
    return with_fingerprint(df, "_h", to).select(*kept, to)


def written(fingerprint: str) -> Column:
    return F.coalesce(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two texts, from their fingerprints."""
    differs = "bit_count((d | shiftrightunsigned(d, 1) | shiftrightunsigned(d, 2) | shiftrightunsigned(d, 3)) & 1229782938247303441)"  # 0x1111...
    apart = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x ^ y), 0, (n, d) -> n + {differs})")
    chance = 1 / (1 << BITS)
    estimate = (1 - apart / BINS - chance) / (1 - chance)
    same = F.col(a).isNull() & F.col(b).isNull()
    return F.when(same, 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), estimate))


def bucketed(docs: DataFrame, key: str) -> DataFrame:
    """Adds ``_q`` and ``_b``: ranges of ``key`` in ascending order, each with about ``BUCKET`` documents; null keys are -1."""
    n, least, most = docs.agg(F.count(key), F.min(key), F.max(key)).first()
    if not n:
        return docs.withColumns({"_q": F.lit(-1), "_b": F.lit(0).cast("long")})
    parts = max(1, min(QUANTILES, n // BUCKET))
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [1.0], 20 * QUANTILES)).first()[0] if parts > 1 else []
    starts = [least, *sorted({c for c in cuts if c > least})]  # at most QUANTILES numbers, whatever the table holds
    width = [max(1, (end - start) // max(1, n // len(starts) // BUCKET)) for start, end in zip(starts, [*starts[1:], most + 1])]
    coarse = starts[::64]
    # a bucket is found in two steps of at most 64 comparisons
    down = F.expr(f"size(filter(array({', '.join(f'{x}L' for x in coarse)}), x -> x <= {key})) - 1")
    fine = F.array(*(F.array(*(F.lit(x).cast("long") for x in starts[k : k + 64])) for k in range(0, len(starts), 64)))
    docs = docs.withColumn("_c", F.when(F.col(key).isNotNull(), down))
    docs = docs.withColumn("_q", F.coalesce(F.col("_c") * 64 + F.size(F.filter(F.get(fine, "_c"), lambda x: x <= F.col(key))) - 1, F.lit(-1)))
    of = lambda values: F.get(F.array(*(F.lit(x).cast("long") for x in values)), F.col("_q"))
    return docs.withColumn("_b", F.coalesce(F.expr("0L") + F.floor((F.col(key) - of(starts)) / of(width)), F.lit(0).cast("long"))).drop("_c")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has its last quarter (rounded down) replaced by as many first code points of the next document, or all it
    has; the next document is that of the next id, of the last one the first.
    """
    d = bucketed(docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("_t")), key)

    # one exchange of texts; the windows are of one bucket
    order = Window.partitionBy("_q", "_b").orderBy(F.col(key), F.col("_t"))
    d = d.repartition("_q", "_b").withColumn("_next", F.lead("_t").over(order)).withColumn("_at", F.row_number().over(order))
    whole = F.col("_next").isNotNull()

    def edited(df: DataFrame) -> DataFrame:
        """Adds the edited text's columns, from ``_t``, its words and hashes, and ``_next``."""
        n = F.length("_t")
        quarter = F.floor(n / 4).cast("int")
        df = df.withColumn("n_chars", n.cast("long")).withColumn("_cut", n - quarter).withColumn("_donor", F.expr("substring(_next, 1, length(_t) - _cut)"))
        df = df.withColumn("edited_sha256", F.sha2(F.expr("concat(substring(_t, 1, _cut), _donor)"), 256))
        return with_fingerprint(edited_windows(df), "_eh", "_g").withColumn("near_edited", likeness("_f", "_g"))

    d = d.withColumn("_w", F.expr(words("_t"))).withColumn("_h", F.expr(or_whole(windows("_w"), "_w")))
    done = edited(with_fingerprint(d, "_h", "_f"))
    # texts stay only in the first and last rows of buckets; then a row is short and knows its next one's fingerprint
    done = done.select(key, "_q", "_b", "_at", F.when((F.col("_at") == 1) | ~whole, F.col("_t")).alias("_t"), whole.alias("_known"), "_f", "_g", "n_chars", "edited_sha256", "near_edited")
    after = Window.partitionBy("_q", "_b").orderBy("_at")
    first = stored(done.withColumn("_nf", F.lead("_f").over(after)).withColumn("near_next", likeness("_f", "_nf")).drop("_nf"), "fingerprints")

    heads = first.where("_at = 1").select("_q", "_b", F.struct("_t", "_f").alias("_head"))
    within = Window.partitionBy("_q").orderBy("_b")
    heads = heads.withColumn("_follows", F.lead("_head").over(within)).withColumn("_k", F.row_number().over(within))
    heads = stored(heads, "heads")
    leads = heads.where("_k = 1").select("_q", F.col("_head").alias("_lead"))  # at most one for each quantile
    turn = Window.orderBy("_q")
    leads = leads.withColumn("_after", F.coalesce(F.lead("_lead").over(turn), F.first("_lead").over(turn))).drop("_lead")
    links = heads.join(leads, "_q").select("_q", "_b", F.coalesce("_follows", "_after").alias("_link"))
    tails = first.where("NOT _known").select("_q", "_b", key, "_t", "_f").join(links, ["_q", "_b"]).withColumn("_next", F.col("_link._t")).withColumn("_nf", F.col("_link._f"))
    tails = tails.withColumn("_w", F.expr(words("_t"))).withColumn("_h", F.expr(or_whole(windows("_w"), "_w")))
    tails = edited(tails).withColumn("near_next", likeness("_f", "_nf"))
    result = [key, "n_chars", "edited_sha256", "_f", "_g", "near_edited", "near_next"]
    both = first.where("_known").select(*result).unionByName(tails.select(*result))
    out = both.select(key, "n_chars", "edited_sha256", written("_f").alias("fingerprint"), written("_g").alias("edited_fingerprint"), "near_edited", "near_next")
    out = stored(out, "fingerprinted")
    discard(first, heads)
    return out
