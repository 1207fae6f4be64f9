"""Quality rules by distribution divergence.

A document's character-class histogram and common-word histogram are compared with those of its language by
Jensen-Shannon distance. The language references are counted over the whole corpus (documents that pass the base
rules), so they take one extra aggregation and stay a table of one row a language. Built-in functions only.

Defined results: null or empty text has no words and fails the base rules; a language outside the parameter list (null
included) is compared with the pooled reference; a distance is not judged where the text is shorter than its guard;
repeated rows are judged row by row; other columns pass through untouched and may have any names but those added here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
}
CHAR_CLASSES = ("lower", "upper", "digit", "symbol", "other")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACES = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class QualityRules:
    """Limits: a text is rejected beyond max_char_distance or max_word_distance, where it is at least as long as the guard."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_char_distance: float = 0.25
    min_chars: int = 200
    max_word_distance: float = 0.23
    min_judged_words: int = 100
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: how many words lie in a three-word window that the text has twice or more.

    Windows are compared by 64-bit hash and found by sorting, so a text of n words takes n log n steps. Each array is a
    column of its own: inside a lambda an inlined expression would be computed again for every element.
    """
    docs = docs.withColumn("_last", F.size("_words") - 3)
    hashes = F.transform(
        F.sequence(F.lit(0), F.col("_last")),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    docs = docs.withColumn("_hashes", F.when(F.col("_last") >= 1, hashes))
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    windows = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    docs = docs.withColumn("_windows", F.when(twice, F.sort_array(windows)))
    marked = F.transform(
        "_windows",
        lambda w, k: F.when(
            (w["h"] == F.get(F.col("_windows"), k - 1)["h"]) | (w["h"] == F.get(F.col("_windows"), k + 1)["h"]), w["i"]
        ),
    )
    docs = docs.withColumn("_starts", F.array_compact(marked))
    later = F.array_union(F.transform("_starts", lambda i: i + 1), F.transform("_starts", lambda i: i + 2))
    covered = F.when(F.size("_starts") > 0, F.size(F.array_union("_starts", later)))
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def with_base(docs: DataFrame, rules: QualityRules, text: str = "text") -> DataFrame:
    """Adds _words, _solid, _rest (no lower-case letters) and the base columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumns({"_words": words_of(F.col(text)), "_solid": F.regexp_replace(t, SPACES, ""), "_lines": lines})
    out = out.withColumns({"_rest": F.regexp_replace("_solid", "\\p{Ll}+", "")})
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length("_solid").cast("long"),
            "n_symbols": F.length(F.regexp_replace("_rest", "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    return out


def histograms(docs: DataFrame, rules: QualityRules, lang: str = "lang") -> DataFrame:
    """Adds _lang, _chars (one count a class) and _common (one count a common word, then all other words)."""
    key = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    known = sorted(rules.common_words)
    docs = docs.withColumns(
        {
            "_lang": F.when(key.isin(known), key).otherwise(F.lit("")),
            "_upper": F.length("_rest") - F.length(F.regexp_replace("_rest", "\\p{Lu}+", "")),
            "_digit": F.length("_rest") - F.length(F.regexp_replace("_rest", "\\p{Nd}+", "")),
        }
    )
    width = max(len(ws) for ws in rules.common_words.values())
    every = sorted({w for ws in rules.common_words.values() for w in ws})
    lists = [x for k in known for x in (F.lit(k), F.array(*[F.lit(w) for w in rules.common_words[k]]))]
    docs = docs.withColumns(
        {
            "_found": F.filter("_words", lambda w: w.isin(every)),
            "_wanted": F.coalesce(F.try_element_at(F.create_map(*lists), F.col("_lang")), F.array_repeat(F.lit(None).cast("string"), width)),
        }
    )
    # a transform over the list, not one expression a word: generated methods over 8 kB are never compiled by the JVM
    number = F.transform("_wanted", lambda w: (F.size("_found") - F.coalesce(F.size(F.array_remove("_found", w)), F.size("_found"))).cast("double"))
    docs = docs.withColumn("_counted", number)
    rest = F.size("_words") - F.aggregate("_counted", F.lit(0.0), lambda a, b: a + b)
    lower = F.length("_solid") - F.length("_rest")
    other = F.length("_rest") - F.col("_upper") - F.col("_digit") - F.col("n_symbols")
    return docs.withColumns(
        {
            "_common": F.concat("_counted", F.array(rest.cast("double"))),
            "_chars": F.array(*[c.cast("double") for c in (lower, F.col("_upper"), F.col("_digit"), F.col("n_symbols"), other)]),
        }
    )


def references(counted: DataFrame, rules: QualityRules) -> dict[str, tuple[list[float], list[float]]]:
    """Summed histograms by language over all documents long enough to be judged; '' pools every language. One row a language of the parameter list reaches the driver."""
    n = max(len(ws) for ws in rules.common_words.values()) + 1
    sums = [F.sum(F.get("_chars", F.lit(i))).alias(f"c{i}") for i in range(len(CHAR_CLASSES))]
    sums += [F.sum(F.get("_common", F.lit(i))).alias(f"w{i}") for i in range(n)]
    rows = counted.where(F.col("n_words") >= rules.min_words).groupBy("_lang").agg(*sums).collect()
    out = {}
    for r in rows:
        out[r["_lang"]] = ([r[f"c{i}"] or 0.0 for i in range(len(CHAR_CLASSES))], [r[f"w{i}"] or 0.0 for i in range(n)])
    if out:
        out[""] = ([sum(v[0][i] for v in out.values()) for i in range(len(CHAR_CLASSES))], out.get("", ([], [0.0] * n))[1])
    return out


def divergence(observed: Column, reference: list[float], size: int) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram column from fixed shares; 0 where either has no mass."""
    total = sum(reference)
    if not total:
        return F.lit(0.0)
    mass = F.aggregate(observed, F.lit(0.0), lambda a, b: a + b)
    parts = []
    for i in range(size):
        q = reference[i] / total
        p = F.try_divide(F.get(observed, F.lit(i)), mass)
        m = (p + F.lit(q)) / 2
        parts.append(F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)))
        if q > 0:
            parts.append(F.lit(q) * F.log2(F.lit(q) / m))
    total_col = parts[0]
    for x in parts[1:]:
        total_col = total_col + x
    return F.when(mass > 0, F.sqrt(F.greatest(total_col / 2, F.lit(0.0)))).otherwise(F.lit(0.0))


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance and kept."""
    own = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    packed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    text, lang = own[text], own.get(lang)
    if lang is None:
        packed, lang = packed.withColumn("_no_lang", F.lit(None).cast("string")), "_no_lang"
    based = histograms(with_base(packed, rules, text), rules, lang)
    known = references(histograms(with_base(packed.select(text, lang), rules, text), rules, lang), rules)
    n = max(len(ws) for ws in rules.common_words.values()) + 1
    char_d = F.lit(0.0)
    word_d = F.lit(0.0)
    for k, (chars, words) in sorted(known.items()):
        char_d = F.when(F.col("_lang") == k, divergence(F.col("_chars"), chars, len(CHAR_CLASSES))).otherwise(char_d)
        if k:
            word_d = F.when(F.col("_lang") == k, divergence(F.col("_common"), words, n)).otherwise(word_d)
    out = with_repeats(based).withColumns({"char_distance": char_d, "word_distance": word_d})
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    bad_chars = (F.col("word_chars") >= rules.min_chars) & (F.col("char_distance") > rules.max_char_distance)
    bad_words = (F.col("n_words") >= rules.min_judged_words) & (F.col("word_distance") > rules.max_word_distance)
    out = out.withColumn("kept", ~F.col("base_failed") & ~bad_chars & ~bad_words)
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    return out.select(*[F.col(n).alias(c) for c, n in own.items() if c not in added], *added)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are kept, with their own columns only."""
    own = [f"_own_{i}" for i in range(len(docs.columns))]
    back = {n: c for n, c in zip(own, docs.columns, strict=True)}
    t, la = own[docs.columns.index(text)], own[docs.columns.index(lang)] if lang in docs.columns else lang
    # a predicate on a verdict would be pushed down with everything it is made of written into it, over and over; past a
    # column that differs at each run the optimizer pushes nothing
    judged = judge(docs.toDF(*own), rules, t, la).withColumn("_wall", F.rand())
    return judged.where("kept and _wall >= 0").select(*[F.col(n).alias(c) for n, c in back.items()])


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    return judge(docs).select(*[F.round(c, 6).alias(c) if c.endswith("_distance") else F.col(c) for c in columns])


def oracle_op9(rules: QualityRules = QualityRules()) -> str:
    """The query in DuckDB SQL."""
    known = sorted(rules.common_words)
    width = max(len(ws) for ws in rules.common_words.values())
    words = "[" + ", ".join("[" + ", ".join(f"'{w}'" for w in rules.common_words[k]) + "]" for k in known) + "]"
    langs = "[" + ", ".join(f"'{k}'" for k in known) + "]"
    wsums = "[" + ", ".join(f"sum(c[{i}])" for i in range(1, width + 2)) + "]"
    csums = "[" + ", ".join(f"sum(h[{i}])" for i in range(1, len(CHAR_CLASSES) + 1)) + "]"

    def distance(p: str, q: str) -> str:
        sp, sq = f"list_sum({p})", f"list_sum({q})"
        m = f"(({p})[i] / {sp} + ({q})[i] / {sq}) / 2"
        part = lambda x, s: f"case when ({x})[i] > 0 then ({x})[i] / {s} * log2(({x})[i] / {s} / ({m})) else 0.0 end"
        return f"case when {sp} > 0 and {sq} > 0 then sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(p, sp)} + {part(q, sq)})) / 2)) else 0.0 end"

    return f"""
with a as (select doc_id, coalesce(text, '') as t, case when list_contains({langs}, lang) then lang else '' end as lang from documents),
b as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws, regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g') as solid,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from a),
c0 as (select *, len(ws) as n_words, length(solid) as word_chars, length(regexp_replace(solid, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  length(regexp_replace(solid, '[^\\p{{Ll}}]', '', 'g')) as n_lower, length(regexp_replace(solid, '[^\\p{{Lu}}]', '', 'g')) as n_upper, length(regexp_replace(solid, '[^\\p{{Nd}}]', '', 'g')) as n_digit,
  ({words})[list_position({langs}, lang)] as wanted from b),
w as (select doc_id, unnest(range(len(ws) - 2)) as i, unnest(list_transform(range(1, len(ws) - 1), lambda j: array_to_string(ws[j:j + 2], ' '))) as g from c0 where len(ws) >= 3),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as k from w) where k > 1),
r as (select doc_id, count(distinct i + j) as n_repeat_words from twice, range(3) q(j) group by doc_id),
d as (select c0.*, coalesce(n_repeat_words, 0) as n_repeat_words, [n_lower, n_upper, n_digit, n_symbols, word_chars - n_lower - n_upper - n_digit - n_symbols]::double[] as h,
  list_transform(coalesce(wanted, []), lambda x: len(list_filter(ws, lambda y: y = x)))::double[] as found from c0 left join r using (doc_id)),
e as (select *, list_append(case when len(found) > 0 then found else list_transform(range({width}), lambda i: 0.0) end, len(ws) - coalesce(list_sum(found), 0.0))::double[] as c from d),
own as (select lang, {csums} as rh, {wsums} as rc from e where n_words >= {rules.min_words} group by lang), pooled as (select {csums} as rh from e where n_words >= {rules.min_words}),
f as (select e.*, case when e.lang = '' then pooled.rh else own.rh end as rh, own.rc from e left join own on own.lang = e.lang cross join pooled),
g as (select *, case when rh is null then 0.0 else {distance("h", "rh")} end as char_distance, case when lang = '' or rc is null then 0.0 else {distance("c", "rc")} end as word_distance,
  n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed from f)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  round(char_distance, 6) as char_distance, round(word_distance, 6) as word_distance,
  not base_failed and not (word_chars >= {rules.min_chars} and char_distance > {rules.max_char_distance}) and not (n_words >= {rules.min_judged_words} and word_distance > {rules.max_word_distance}) as kept from g
"""
