"""Style features of a text as built-in expressions, one struct for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
WORD = r"[A-Za-z0-9][A-Za-z0-9'’\-]*"
SENTENCE_END = r"(?<=[.!?…])\s+|\n{2,}|\n(?=[A-Z0-9\"'(])"
FIRST, SECOND, PLURAL = ("i", "me", "my", "mine", "i'm", "i've", "i'd", "i'll"), ("you", "your", "yours", "you're", "you've"), ("we", "us", "our", "ours", "we're", "we've")

S_FORMS = ("it's", "that's", "what's", "there's", "here's", "he's", "she's", "let's", "who's", "where's", "how's", "when's", "everything's", "nothing's", "something's")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END, -1), F.trim), lambda s: s != "")


def quantile(values: Column, q: float) -> Column:
    """Of an array of numbers, by interpolation; null for none."""
    ordered, n = F.array_sort(values), F.size(values)
    at = (n - 1) * q
    low = F.try_element_at(ordered, F.floor(at).cast("int") + 1)
    high = F.try_element_at(ordered, F.ceil(at).cast("int") + 1)
    return F.when(n > 0, low + (high - low) * (at - F.floor(at)))


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def _share(part: Column, whole: Column, per: float = 1.0, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(per * part / whole, digits)).otherwise(0.0)


def features(posts: DataFrame, text: str = "text") -> DataFrame:
    """posts with size, line_words, sent_words, hook, pov, punct_per_1k, letter_case, symbols, lexicon and other (2.11.2, the English-only word lists apart).

    Null is the empty text, whose shares are zero; line ends are LF first and outer ones go. Other columns of posts stay, whatever their names; those named
    as a group are replaced.
    """
    t = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), r"\A\n+|\n+\z", "")
    groups_ = ("size", "line_words", "sent_words", "hook", "pov", "punct_per_1k", "letter_case", "symbols", "lexicon", "other")
    own = [c for c in posts.columns if c not in groups_]
    df = posts.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("post") if own else F.lit(None).alias("post"), t.alias("ft")).withColumn("fl", F.split("ft", "\n", -1)).withColumn("fn", F.filter("fl", lambda x: F.trim(x) != ""))
    df = df.withColumn("fw", words(F.col("ft"))).withColumn("fs", sentences(F.col("ft"))).withColumn("fp", F.filter(F.split("ft", r"\n\s*\n", -1), lambda p: F.trim(p) != ""))
    counted = lambda c: F.transform(c, lambda x: F.size(words(x)).cast("double"))
    df = df.withColumn("lw", counted(F.col("fn"))).withColumn("sw0", counted(F.col("fs"))).withColumn("sw", F.when(F.exists("sw0", lambda x: x > 0), F.filter("sw0", lambda x: x > 0)).otherwise(F.col("sw0")))
    df = df.withColumn("low", F.transform("fw", F.lower))
    n_words, n_chars, x, low = F.size("fw"), F.length("ft"), F.col("ft"), F.col("low")
    lines = F.transform("fp", lambda p: F.size(F.filter(F.split(p, "\n"), lambda y: F.trim(y) != "")))
    run = F.aggregate(lines, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), lambda a, k: F.struct(F.when(k == 1, a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["best"], F.when(k == 1, a["now"] + 1).otherwise(0)).alias("best")), lambda a: a["best"])
    df = df.withColumn("mean", _mean(F.col("sw")))  # a column: inside the lambda below it would be summed again for every sentence
    mean, n = F.col("mean"), F.size("sw")
    sd = F.when(n > 0, F.sqrt(F.aggregate("sw", F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean)) / n))
    of = lambda names: F.size(F.filter(low, lambda w: w.isin(*names)))
    hits = lambda p: F.regexp_count(x, F.lit(p))
    first = F.coalesce(F.try_element_at("fn", F.lit(1)), F.lit(""))
    head = lambda k: F.when(n_chars <= k, F.lit(True)).otherwise(F.substring(x, 1, k).rlike(r"[.!?…][\"')\]]?\s*$") | F.substring(x, k + 1, 1).eqNullSafe("\n"))
    df = df.withColumns({"i": of(FIRST), "you": of(SECOND), "we": of(PLURAL)})
    i, you, we = F.col("i"), F.col("you"), F.col("we")
    ranked = F.array_sort(F.array(*(F.struct((-c).alias("less"), F.lit(name).alias("name")) for c, name in ((i, "first_singular"), (you, "second"), (we, "first_plural")))))
    dominant = F.when(i + you + we == 0, "third").when((ranked[1]["less"] < 0) & (-ranked[0]["less"] < -1.25 * ranked[1]["less"]), "mixed").otherwise(ranked[0]["name"])
    marks = {"period": r"(?<![.0-9])\.(?![.0-9])|(?<=[0-9])\.(?![.0-9])", "comma": ",", "exclaim": "!", "question": r"\?", "colon": ":", "semicolon": ";", "em_dash": "—", "en_dash": "–", "ellipsis": r"…|\.{3,}", "paren": r"\(", "quote": "[\"“”]"}
    tokens = F.filter("fw", lambda w: F.length(w) >= 2)
    groups = [
        F.struct(n_chars.alias("n_chars"), n_words.alias("n_words"), F.size("fn").alias("n_lines"), (F.size("fl") - F.size("fn")).alias("n_blank"), F.size("fs").alias("n_sentences")).alias("size"),
        F.struct(*(F.round(quantile(F.col("lw"), q), 4).alias(k) for k, q in (("median", 0.5), ("q1", 0.25), ("q3", 0.75), ("max", 1.0))), _share(F.size(F.filter("lw", lambda y: y <= 4)), F.size("lw")).alias("pct_le4"), _share(F.size(F.filter("lw", lambda y: y == 1)), F.size("lw")).alias("pct_one_word"), run.alias("max_run_single_line_paras"), F.array_join(F.transform("fp", lambda p: F.size(sentences(p)).cast("string")), "/").alias("rhythm")).alias("line_words"),
        F.struct(F.round(mean, 4).alias("mean"), F.round(sd, 4).alias("sd"), F.when(mean > 0, F.round(sd / mean, 4)).alias("cv"), F.array_max("sw").alias("max"), _share(F.size(F.filter("sw", lambda y: y <= 5)), n).alias("pct_le5")).alias("sent_words"),
        F.struct(F.length(first).alias("line1_chars"), F.size(words(first)).alias("line1_words"), F.length(F.regexp_extract(x, r"\A(.*?)(\n\s*\n|\z)", 1)).alias("chars_before_blank"), head(140).alias("cut140_ends_sentence"), head(210).alias("cut210_ends_sentence"), F.rtrim(first).endswith("?").alias("is_question")).alias("hook"),
        F.struct(_share(i, n_words, 100).alias("i_per100"), _share(you, n_words, 100).alias("you_per100"), _share(we, n_words, 100).alias("we_per100"), dominant.alias("dominant")).alias("pov"),
        F.struct(*(_share(hits(p), n_chars, 1000).alias(k) for k, p in marks.items())).alias("punct_per_1k"),
        F.struct(_share(F.size(F.filter(tokens, lambda w: w.rlike("[A-Z]") & (F.upper(w) == w))), F.size(tokens)).alias("pct_allcaps_tokens"), _share(F.size(F.filter("fs", lambda s: F.substring(s, 1, 1).rlike(r"\p{Ll}"))), F.size("fs")).alias("pct_lower_initial_sentences")).alias("letter_case"),
        F.struct(hits(r"(?<![\w&])#[A-Za-z]\w*").alias("hashtags"), hits(r"(?<!\w)@[A-Za-z0-9_.]{2,}").alias("mentions"), hits(r"(?i)https?://\S+|www\.\S+").alias("urls"), hits(r"(?m)^\s*(?:[-*•–]|\d+[.)])\s+").alias("bullets"), hits("[→⇒➜]|->").alias("arrows")).alias("symbols"),
        F.struct(_share(F.size(F.array_distinct(low)), n_words).alias("ttr"), F.round(_mean(F.transform("fw", lambda w: F.length(w).cast("double"))), 4).alias("mean_word_len"), _share(F.size(F.filter("fw", lambda w: F.length(w) >= 9)), n_words).alias("pct_long_words"), _share(F.size(F.filter(low, lambda w: w.rlike("^[a-z]+['’](t|re|ve|ll|d|m)$") | F.translate(w, "’", "'").isin(*S_FORMS))), n_words).alias("contraction_rate"), hits(r"\$\s?\d").alias("dollar_figures")).alias("lexicon"),
        F.struct(F.size(F.filter("fs", lambda s: s.endswith("?"))).alias("questions"), _share(F.size(F.filter("fp", lambda p: F.size(sentences(p)) == 1)), F.size("fp")).alias("pct_single_sentence_paras")).alias("other"),
    ]
    return df.select("post", *groups).select(*(F.col(f"post.`{c}`") for c in own), *groups_)
