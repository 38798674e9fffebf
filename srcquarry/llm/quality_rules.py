"""Quality rules (operator 4), in DataFrame functions only: counts of repetition and symbols, then distribution divergence.

For each document two histograms are made: how its characters fall into classes, and how often the common words of its
language occur.  The references are the same histograms summed over all documents of the language.  The Jensen-Shannon
distance (base 2, 0 to 1) of each histogram to its reference decides: a document far from its language is not kept.  Each
histogram first gets ``prior`` counts shaped like the reference, so that short documents lie near it, and a document with
fewer words than the guard, or without a language that has a reference, is never rejected by distance.

Windows of five words are compared by 64-bit hashes within one document.

Cases: null and empty texts have no words and fail the base rule; a language is matched in lower case; a missing ``lang``
column, extra columns, repeated rows and an empty table are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcquarry.llm.common import stored

#: Frequent words of each language, most frequent first.
COMMON = {
    "en": "the of and to in is that it for was with as on be by this".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im nicht".split(),
    "es": "de la que el en y los se del las un por con no una para".split(),
}
#: Character classes that are counted by pattern; the rest of the characters in words are plain letters.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "point": "[.,;:!?'\"()-]", "symbol": "[#*$%&|<>]", "other": r"[+/=@\\^_`~{}\[\]]"}
SPACE = r" \t\n\u000b\u000c\r"
K = len(COMMON["en"])


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = 10) -> DataFrame:
    """One narrow row for each document: base counts and both histograms, in one pass and without a shuffle."""
    language = F.lower(F.col(lang)) if lang in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col(key).cast("long").alias(key), language.alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    trimmed = F.expr(f"trim(BOTH '{SPACE}' FROM _t)")
    d = d.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    d = d.withColumn("_h", F.expr("CASE WHEN size(_w) >= 5 THEN transform(sequence(0, size(_w) - 5), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4])) ELSE CAST(array() AS array<bigint>) END"))
    # only documents with a repeated window pay for sorting
    d = d.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> struct(x AS x, i AS i))) END"))
    d = d.withColumn("_p", F.expr("CASE WHEN _s IS NOT NULL THEN sort_array(transform(filter(_s, (e, k) -> e.x = get(_s, k - 1).x OR e.x = get(_s, k + 1).x), e -> e.i)) END"))
    lines = F.expr(r"filter(split(_t, '\n'), x -> trim(BOTH '" + SPACE + "' FROM x) <> '')")
    # what is neither a plain letter nor white space, so that each class is counted in a short string
    odd = F.regexp_replace("_t", r"[a-z\x20\x09-\x0D\x{80}-\x{10FFFF}]+", "")
    covered = F.expr("aggregate(_p, struct(0L AS n, -9L AS last), (a, x) -> struct(a.n + least(5L, x - a.last) AS n, CAST(x AS bigint) AS last), a -> a.n)")
    language_words = F.lit(None).cast("array<string>")
    for language, words in COMMON.items():
        language_words = F.when(F.col("_lang") == language, F.array(*map(F.lit, words))).otherwise(language_words)
    common = F.transform(language_words, lambda c: (F.size("_w") - F.size(F.array_remove("_w", c))).cast("long"))
    d = d.withColumn("_l", lines).select(key, "_lang", "_t", "_w", "_l", F.coalesce(covered, F.lit(0)).alias("n_repeat_words"), odd.alias("_odd"), common.alias("_c"))
    count = lambda pattern: F.regexp_count("_odd", F.lit(pattern)).cast("long")

    n_words = F.size("_w").cast("long")
    return d.select(
        key,
        "_lang",
        n_words.alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.size("_l") - F.size(F.array_distinct("_l")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        ((n_words < min_words) | (100 * F.col("n_repeat_words") > 20 * n_words)).alias("base_failed"),
        *(count(p).alias(f"c_{c}") for c, p in CLASSES.items()),
        (F.octet_length("_t") - F.length("_t")).cast("long").alias("c_wide"),
        *(F.coalesce(F.get("_c", F.lit(k)), F.lit(0)).cast("long").alias(f"w_{k}") for k in range(K)),
    ).withColumn("n_symbols", F.col("c_symbol"))


def histograms() -> dict[str, list[Column]]:
    named = [F.col(f"c_{c}") for c in (*CLASSES, "wide")]
    plain = F.greatest(F.col("word_chars") - sum(named[1:], named[0]), F.lit(0))
    words = [F.col(f"w_{k}") for k in range(K)]
    return {"chars": [*named, plain], "words": [*words, F.greatest(F.col("n_words") - sum(words[1:], words[0]), F.lit(0))]}


def references(feats: DataFrame) -> dict[str, dict[str, list[float]]]:
    """For each language in ``COMMON``, so for a fixed number, the histograms of all its documents as shares."""
    sums = [F.sum(c).cast("double").alias(f"{h}_{i}") for h, cols in histograms().items() for i, c in enumerate(cols)]
    out = {}
    for r in feats.where(F.col("_lang").isin(*COMMON)).groupBy("_lang").agg(*sums).collect():
        out[r._lang] = {h: [(r[f"{h}_{i}"] + 0.5) / (sum(r[f"{h}_{j}"] + 0.5 for j in range(len(cols)))) for i in range(len(cols))] for h, cols in histograms().items()}
    return out


def distance(cols: list[Column], refs: dict[str, list[float]], prior: float) -> Column:
    """Jensen-Shannon distance of each row's counts to its language's reference; null without one."""

    def share(i: int) -> Column:
        q = F.lit(None).cast("double")
        for lang, r in refs.items():
            q = F.when(F.col("_lang") == lang, F.lit(float(r[i]))).otherwise(q)
        return q

    total = sum(cols[1:], cols[0]) + F.lit(float(prior))
    terms = []
    for i, c in enumerate(cols):
        q = share(i)
        p = (c + q * prior) / total
        terms.append(p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q)))
    return F.sqrt(F.greatest(sum(terms[1:], terms[0]) / 2, F.lit(0.0)))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_chars: float = 0.32, max_words: float = 0.22, guard: int = 50, prior: float = 20.0) -> DataFrame:
    """(key, n_words, base counts, base_failed, kept, chars_distance, words_distance)."""
    feats = stored(features(docs, key, text, lang), "quality")
    refs = references(feats)
    h = histograms()
    far = lambda name, limit: F.coalesce(F.col(name) > limit, F.lit(False)) & (F.col("n_words") >= guard)
    return (
        feats.withColumn("chars_distance", distance(h["chars"], {k: v["chars"] for k, v in refs.items()}, prior))
        .withColumn("words_distance", distance(h["words"], {k: v["words"] for k, v in refs.items()}, prior))
        .withColumn("kept", ~F.col("base_failed") & ~far("chars_distance", max_chars) & ~far("words_distance", max_words))
        .select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_distance", "words_distance")
    )
