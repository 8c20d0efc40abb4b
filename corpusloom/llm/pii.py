"""Personal data by fixed shapes and by bootstrapped contexts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stage, stage, unused_names

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"  # a kind that has seeds but no base shape

# The shapes, with runs taken whole and begun only where a run begins (or where the last match ended), so that no
# text costs more than linear time; the matches are those of the plain forms.
_LOCAL = r"A-Za-z0-9._%+-"
SHAPES = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){2}+\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier: a word with a digit or an at sign, with the words behind it that begin like a number. Quotes, brackets and markup end it.
_INSIDE = r"[^\s\"'`<>{}\[\]|#*]"
_PLAIN = r"[^\s\"'`<>{}\[\]|#*0-9@]"
CANDIDATE = rf"(?:\G|(?<!{_INSIDE})){_PLAIN}*+[0-9@]{_INSIDE}*+(?:\x20{_PLAIN}{{0,3}}+[0-9]{_INSIDE}*+)*+"

#: A seed of a secret: 32 or more hexadecimal digits, some of them letters and some not.
HEX = "^(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+$"
#: What may stand around an identifier without being part of it.
BEFORE, BEHIND = "\"'`*_<[{(", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

ROUNDS = 3
CONFIDENT = 0.75
SUPPORT = 5  # distinct instances behind a pattern
DIGITS = 5  # of an identifier that only its context shows
LONG = 16  # characters of a secret that only its context shows; it needs a digit
BLOCK = 1024  # characters of a text that are cut together


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.try_cast("int") * 2).otherwise(d.try_cast("int")))
    return F.aggregate(F.transform(each, lambda d: F.when(d > 9, d - 9).otherwise(d)), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """If a match of a shape counts."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    n = F.length(_digits(match))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", n.between(14, 19) & _luhn(_digits(match))).otherwise(n.between(10, 15))


def _found(text: Column, pattern: str) -> Column:
    """An array of (gap, match, rest): the characters since the last match, the match, and those up to the next. Empty for a null text."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array(F.lit(None).cast("string"))
    return F.arrays_zip(gaps.alias("gap"), F.concat(matches, none).alias("match"), F.concat(F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), none).alias("rest"))


def _placed(rows: DataFrame, *by: str) -> DataFrame:
    """start and end (exclusive) of exploded matches, from the lengths of what stands before them."""
    order = Window.partitionBy("doc_id", "h", *by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap_n") + F.length("match")).over(order)
    return rows.withColumn("end", end.cast("long")).withColumn("start", (F.col("end") - F.length("match")).cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and h, a hash of the text: rows equal in doc_id and h have equal spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("h", F.xxhash64("text"))


def _sized(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap_n"), x["match"].alias("match"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end) of the shapes in keyed() documents, rows equal in id and text once."""
    some = docs.where(F.col("text").rlike("[0-9@]"))
    needs = {"email": F.contains("text", F.lit("@")), "ip": F.contains("text", F.lit(".")), "card": F.lit(True), "phone": F.contains("text", F.lit("+"))}
    arrays = [F.when(needs[k], F.transform(_found(F.col("text"), SHAPES[k]), _sized(k))) for k in KINDS]
    listed = some.select("doc_id", "h", F.explode(F.array(*arrays)).alias("rows")).select("doc_id", "h", F.posexplode("rows").alias("pos", "row"))
    rows = listed.select("doc_id", "h", "pos", "row.*").where("match is not null").dropDuplicates(["doc_id", "h", "kind", "pos"])
    return _placed(rows, "kind").where(valid(F.col("kind"), F.col("match"))).select("doc_id", "h", "kind", "start", "end")


def _contexts(gap: Column, rest: Column) -> Column:
    """The lexical patterns around a match: one and two words on either side, and the nearest of both sides."""
    words = lambda c: F.filter(F.split(F.translate(F.lower(c), "\"'`", ""), r"\s+"), lambda w: w != "")
    left, right = words(gap), words(F.coalesce(rest, F.lit("")))
    last = lambda n: F.when(F.size(left) >= n, F.array_join(F.slice(left, -n, n), " "))
    first = lambda n: F.when(F.size(right) >= n, F.array_join(F.slice(right, 1, n), " "))
    made = [F.concat(F.lit("L1 "), last(1)), F.concat(F.lit("L2 "), last(2)), F.concat(F.lit("R1 "), first(1)), F.concat(F.lit("R2 "), first(2)), F.concat(F.lit("LR "), last(1), F.lit(" _ "), first(1))]
    return F.array_compact(F.array(*made))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, start, end, token, patterns, kind): identifiers and might-be ones with the contexts around them; kind is null where nothing seeds the token."""
    some = docs.where(F.col("text").rlike("[0-9@]"))
    rows = some.select("doc_id", "h", F.posexplode(_found(F.col("text"), CANDIDATE)).alias("pos", "row")).where("row.match is not null").dropDuplicates(["doc_id", "h", "pos"])
    placed = _placed(rows.select("doc_id", "h", "pos", F.length("row.gap").alias("gap_n"), F.col("row.match").alias("match"), _contexts(F.col("row.gap"), F.col("row.rest")).alias("patterns")))
    open_ = F.ltrim(F.col("match"), F.lit(BEFORE))
    out = placed.withColumn("start", F.col("start") + F.length("match") - F.length(open_)).withColumn("token", F.rtrim(open_, F.lit(BEHIND)))
    t, n = F.col("token"), F.length(_digits(F.col("token")))
    is_ip = t.rlike(SHAPES["ip"]) & valid(F.lit("ip"), F.regexp_extract(t, SHAPES["ip"], 0))
    is_card = t.rlike(f"^{SHAPES['card']}$") & n.between(14, 19) & _luhn(_digits(t))
    kind = F.when(t.rlike(SHAPES["email"]), "email").when(is_ip, "ip").when(t.rlike(SHAPES["phone"]) & n.between(10, 15), "phone").when(is_card, "card").when(t.rlike(HEX), SECRET)
    out = out.withColumn("end", F.col("start") + F.length("token")).withColumn("kind", kind)
    return out.where("token != ''").select("doc_id", "h", "start", "end", "token", "patterns", "kind")


def confident_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind) that the graph of patterns and instances makes confident, from candidates().

    Seeds have confidence 1 for their kind. A pattern's confidence for a kind is the sum of its instances' over one
    more than their number, if the sum is SUPPORT or more; an instance's is that of the noisy-or of its patterns'.
    Links are distinct (pattern, instance) pairs, summed before they are shuffled; each round is written down.
    """
    each = found.select("token", "kind", F.explode("patterns").alias("pattern"))
    links = stage(each.groupBy("pattern", "token").agg(F.min("kind").alias("kind")), "links")
    seeds = links.where("kind is not null").groupBy("token", "kind").agg(F.lit(1.0).alias("conf"))
    sizes = links.groupBy("pattern").agg(F.count("*").alias("n"))
    known, patterns = seeds, None
    for _ in range(rounds):
        sums = links.select("pattern", "token").join(known, "token").groupBy("pattern", "kind").agg(F.sum("conf").alias("s")).where(F.col("s") >= SUPPORT)
        scored = sums.join(sizes, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("conf")).where(F.col("conf") >= CONFIDENT)
        last, patterns = patterns, stage(scored, "patterns")
        if last is not None:
            drop_stage(last)
        new = links.where("kind is null").select("pattern", "token").join(patterns, "pattern").groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("conf"))
        known = seeds.union(new)
    drop_stage(links)
    return patterns.groupBy("pattern").agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"), F.max("conf").alias("conf"))


def all_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, base) of keyed() documents: the shapes' spans and those that contexts add."""
    base = stage(base_spans(docs), "base")
    found = stage(candidates(docs), "candidates")
    patterns = confident_patterns(found)
    unseen = found.where("kind is null").drop("kind").withColumns({"digits": F.length(_digits(F.col("token"))), "size": F.length("token")})
    seen = unseen.withColumn("pattern", F.explode("patterns")).join(patterns, "pattern")
    seen = seen.where((F.col("digits") >= DIGITS) | ((F.col("kind") == SECRET) & (F.col("size") >= LONG) & ~F.contains("token", F.lit(" "))))
    named = seen.groupBy("doc_id", "h", "start", "end").agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"))
    by_context = _apart(named, base)
    secrets = found.where(F.col("kind") == SECRET).select("doc_id", "h", "start", "end", "kind")
    new = by_context.unionByName(secrets).select("doc_id", "h", "kind", "start", "end").join(base, ["doc_id", "h", "kind", "start", "end"], "left_anti")
    return base.withColumn("base", F.lit(True)).unionByName(new.withColumn("base", F.lit(False)))


def _apart(new: DataFrame, base: DataFrame) -> DataFrame:
    """The rows of new (doc_id, h, kind, start, end) that share no character with a row of base: base rows' reach before them and their beginnings behind."""
    rows = new.withColumn("old", F.lit(False)).unionByName(base.select("doc_id", "h", "kind", "start", "end").withColumn("old", F.lit(True)))
    order = Window.partitionBy("doc_id", "h").orderBy("start", "old", "end", "kind")
    reach = F.max(F.when(F.col("old"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("doc_id", "h").orderBy(F.desc("start"), F.desc("old"), F.desc("end"), F.desc("kind"))  # a frame that ends with the group costs its square
    next_ = F.min(F.when(F.col("old"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    told = rows.withColumns({"reach": reach, "next": next_}).where("not old")
    return told.where("coalesce(reach <= start, true) and coalesce(next >= end, true)").select("doc_id", "h", "start", "end", "kind")


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), kind)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (of the shapes), base_sha256, spans (all), n_found (that contexts added).

    Every expression is a DataFrame function. Only documents with a digit or an at sign are searched, and of them only
    matches with their places are shuffled, not texts. Candidates that hold a shape, and hexadecimal secrets, seed the
    contexts: one and two words on either side are patterns, patterns and instances score each other for three rounds,
    and confident patterns name candidates of five digits or more (a secret: of 16 characters) that nothing seeds and that
    share no character with a shape. Secrets and what contexts name are added to spans under their kind. Null is the empty text, which has no span; very long texts and tokens cost linear
    time; spans of rows equal in id and text are found once and given to each; extra columns are not looked at.
    """
    rows = keyed(docs)
    spans = all_spans(rows).withColumn("span", F.struct("start", _rank(F.col("kind")).alias("rank"), "end", "kind"))
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    by_doc = spans.groupBy("doc_id", "h").agg(*counts, F.collect_list(F.when(F.col("base"), F.col("span"))).alias("own"), F.collect_list("span").alias("all"), F.count_if(~F.col("base")).alias("n_found"))
    by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), *(f"n_{k}" for k in KINDS), _joined(F.col("own")).alias("base"), _joined(F.col("all")).alias("spans"), "n_found")
    out = rows.select("doc_id", "h").join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *map(zero, (f"n_{k}" for k in KINDS)), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_found"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; spans that touch or overlap are one, under the kind of the first.

    Null texts stay null, empty ones empty; rows equal in id and text are masked alike; other columns stay, whatever their names.
    """
    rows = keyed(docs)
    spans = all_spans(rows).withColumn("rank", _rank(F.col("kind")))
    order = Window.partitionBy("doc_id", "h").orderBy("start", "rank", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))).withColumn("island", F.sum("fresh").over(order))
    merged = spans.groupBy("doc_id", "h", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "rank")).alias("kind"))
    before = F.lag("end", 1, 0).over(Window.partitionBy("doc_id", "h").orderBy("start"))
    id_, hash_, cuts = unused_names(docs, "pii_id", "pii_hash", "pii_cuts")
    cut = merged.withColumn("from", before).groupBy(F.col("doc_id").alias(id_), F.col("h").alias(hash_)).agg(F.array_sort(F.collect_list(F.struct("start", "from", "end", "kind"))).alias(cuts))
    joined = docs.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(hash_)), "left")
    # A substring is sought from the text's beginning, so texts are cut in blocks first: a piece costs its own length and a block at most.
    (blocks,) = unused_names(joined, "pii_blocks")
    joined = joined.withColumn(blocks, F.when(F.col(cuts).isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def between(low: Column, high: Column) -> Column:
        first = F.floor(low / BLOCK).cast("int")
        near = F.array_join(F.slice(F.col(blocks), first + 1, F.greatest(F.floor((high - 1) / BLOCK).cast("int") - first + 1, F.lit(0))), "")
        return F.substring(near, (low - first * BLOCK + 1).cast("int"), (high - low).cast("int"))

    pieces = F.transform(cuts, lambda c: F.concat(between(c["from"], c["start"]), F.lit("["), F.upper(c["kind"]), F.lit("]")))
    tail = between(F.element_at(cuts, -1)["end"], F.length("text").cast("long"))
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
