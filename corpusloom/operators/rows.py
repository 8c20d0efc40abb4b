"""From raw rows to posts: header synonyms, cleaning, platforms, media, validation, splits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .closure import follow

# The canonical fields with their headers, first matches first.
SYNONYMS = {
    "author": ("author", "name", "poster", "creator", "author name", "full name", "display name", "writer", "by"),
    "handle": ("handle", "username", "user name", "user", "author handle", "x handle", "twitter handle", "screen name"),
    "text": ("text", "content", "post", "body", "caption", "post text", "post body", "message", "post content"),
    "platform": ("platform", "network", "channel", "source platform", "site"),
    "media": ("media", "image", "picture", "video", "attachment", "file", "images", "attachments", "photo", "media url", "url media", "image url", "video url", "media path", "files"),
    "media_description": ("media description", "description", "alt", "media notes", "alt text", "image description", "media note"),
    "transcript": ("transcript", "video transcript", "speech"),
    "posted_at": ("posted at", "date", "posted", "published", "published at", "timestamp", "created at", "created", "post date", "time"),
    "url": ("url", "link", "permalink", "post url", "post link", "href"),
    "likes": ("likes", "reactions", "like count", "favorites", "favourites", "hearts"),
    "comments": ("comments", "replies", "comment count", "reply count"),
    "reposts": ("reposts", "shares", "retweets", "repost count", "share count", "reshares"),
    "views": ("views", "impressions", "view count", "plays"),
    "engagement": ("engagement", "metrics", "stats"),
    "lang": ("lang", "language"),
    "context": ("context", "quoted post", "quoted text", "post context", "surrounding context", "thread context"),
    "mode": ("mode", "post mode"),
}
ALIASES = {"linkedin": "linkedin", "li": "linkedin", "linked in": "linkedin", "linkedin.com": "linkedin", "x": "x", "twitter": "x", "tw": "x", "x twitter": "x", "twitter x": "x", "x.com": "x", "twitter.com": "x", "x (twitter)": "x", "twitter (x)": "x"}
HOSTS = {"linkedin.com": "linkedin", "x.com": "x", "twitter.com": "x"}
SHORT = 280
COUNTS = ("likes", "comments", "reposts", "views")


def header_form(name: str) -> str:
    return re.sub(r"[\s_\-]+", " ", name.replace("﻿", "").strip().lower())


def map_headers(columns: list[str], override: dict[str, str] | None = None) -> tuple[dict[str, str], list[str]]:
    """PRJ-01: {canonical field: column} and the columns that no field takes. Each field takes the free column of its first synonym that has one."""
    mapping = {k: v for k, v in (override or {}).items() if v in columns}
    free = {}
    for c in columns:
        if c not in mapping.values():
            free.setdefault(header_form(c), c)
    for field, names in SYNONYMS.items():
        hit = next((n for n in names if n in free), None)
        if field not in mapping and hit is not None:
            mapping[field] = free.pop(hit)
    return mapping, [c for c in columns if c not in mapping.values()]


def clean_text(text: Column | str) -> Column:
    """Line ends as LF, without outer line ends and blanks at the end."""
    lf = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lf, r"\A\n+", ""), r"\s+\z", "")


def count_of(text: Column) -> Column:
    """A number with thousands marks or k, m, b behind it, as a long; null if it is none."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"[,\s+]", "")
    number = F.regexp_extract(plain, r"^([0-9]+(?:\.[0-9]+)?)[kmb]?$", 1).try_cast("double")
    unit = F.regexp_extract(plain, r"([kmb])$", 1)
    return F.round(number * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)).cast("long")


def host_platform(url: Column) -> Column:
    host = F.lower(F.expr("try_parse_url(trim(url), 'HOST')")) if isinstance(url, str) else F.lower(F.call_function("try_parse_url", F.trim(url), F.lit("HOST")))
    return F.coalesce(*(F.when((host == h) | host.endswith(f".{h}"), F.lit(p)) for h, p in HOSTS.items()))


def platform_of(named: Column, url: Column, text: Column, default: str | None = None) -> Column:
    """PRJ-03: the named platform, else that of the address, else the default, else x for a short text of one line."""
    form = F.regexp_replace(F.trim(F.lower(named)), r"[\s_\-]+", " ")
    alias = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(alias, form), host_platform(url), F.lit(default).cast("string"), F.when((F.length(text) <= SHORT) & ~F.contains(text, F.lit("\n")), "x"))


def media_list(raw: Column, description: Column) -> Column:
    """References split at semicolons and line ends, each with the description."""
    refs = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "[;\n]"), F.trim), lambda x: x != "")
    return F.transform(refs, lambda x: F.struct(x.alias("path_or_url"), F.nullif(F.trim(description), F.lit("")).alias("description")))


def normalise_rows(raw: DataFrame, override: dict[str, str] | None = None, platform: str | None = None) -> DataFrame:
    """PRJ-02: rows under canonical names: blanks are null, texts are cleaned, counts are numbers, media a list, platforms inferred."""
    mapping, _ = map_headers(raw.columns, override)
    get = lambda f: F.nullif(F.trim(F.col(f"`{mapping[f]}`").cast("string")), F.lit("")) if f in mapping else F.lit(None).cast("string")
    text = clean_text(F.col(f"`{mapping['text']}`").cast("string") if "text" in mapping else F.lit(""))
    plain = [get(f).alias(f) for f in ("author", "handle", "posted_at", "url", "transcript", "lang", "context", "mode")]
    counts = F.struct(*(count_of(get(f)).alias(f) for f in COUNTS)).alias("engagement")
    return raw.select(*plain, F.nullif(text, F.lit("")).alias("text"), platform_of(get("platform"), get("url"), text, platform).alias("platform"), counts, media_list(get("media"), get("media_description")).alias("media"))


def media_status(ref: Column, consent: bool, refused: tuple[str, ...], listed: tuple[str, ...]) -> Column:
    """PRJ-07: refused and listed hosts by name or suffix, other addresses by consent, local paths as they are."""
    host = F.lower(F.call_function("try_parse_url", F.trim(ref), F.lit("HOST")))
    on = lambda names: reduce(Column.__or__, [(host == h) | host.endswith(f".{h}") for h in names], F.lit(False))
    return F.when(~ref.rlike("^https?://"), "local").when(on(refused), "refused").when(on(listed), "not_fetched").otherwise("fetch" if consent else "listed")


def row_problems(rows: DataFrame, required: tuple[str, ...] = ("text", "author", "platform")) -> DataFrame:
    """FLT-01: rows with problems (an array of the required fields that they lack)."""
    lack = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in required)))
    return rows.withColumn("problems", lack)


def accepted_batch(rows: DataFrame, required: tuple[str, ...] = ("text", "author", "platform")) -> DataFrame:
    """FLT-01: all rows if none has a problem, else none."""
    checked = row_problems(rows, required)
    bad = checked.agg(F.count_if(F.size("problems") > 0).alias("bad"))
    return checked.drop("problems").join(F.broadcast(bad), F.col("bad") == 0).drop("bad")


def assign_splits(posts: DataFrame, modulo: int = 4, per_platform: int = 4, never: tuple[str, ...] = ()) -> DataFrame:
    """WN-13: posts (post_id, sha, platform, author, own, link) with split.

    Own posts are `self`; others are held out by their hash, except the never-held authors. A linked post has the split of the post at the end of its chain
    of links; an own post ends a chain, and so does one whose link names no post. Posts on a circle of links keep their own. A platform with too few held-out
    posts takes its train posts of the least hash.
    """
    held_never = F.col("author").isin(*never) if never else F.lit(False)
    first = F.when(F.col("own"), "self").when(held_never, "train")
    first = first.otherwise(F.when(F.conv(F.substring("sha", 1, 8), 16, 10).cast("long") % modulo == 0, "heldout").otherwise("train"))
    links = posts.where(~F.col("own")).select(F.col("post_id").alias("id"), F.col("link").alias("next"))
    known = links.join(posts.select(F.col("post_id").alias("next")), "next", "left_semi")
    ends = follow(known).where("depth > 0").select(F.col("id").alias("post_id"), "root")
    named = posts.select(F.col("post_id").alias("root"), first.alias("root_split"))
    rows = posts.join(ends, "post_id", "left").join(named, "root", "left").withColumn("split", F.coalesce("root_split", first)).drop("root", "root_split")
    # the least hashes of a platform are found before the shuffle, as their number is a constant
    free = rows.where((F.col("split") == "train") & F.col("link").isNull() & ~F.coalesce(held_never, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("platform").orderBy("sha", "post_id"))
    spare = free.select("post_id", "platform", "sha").withColumn("place", place).where(F.col("place") <= per_platform)
    held = rows.groupBy("platform").agg(F.count_if(F.col("split") == "heldout").alias("held"))
    moved = spare.join(held, "platform").where(F.col("place") <= per_platform - F.col("held")).select("post_id", F.lit(True).alias("moved"))
    return rows.join(moved, "post_id", "left").withColumn("split", F.when(F.col("moved"), "heldout").otherwise(F.col("split"))).drop("moved").select(*posts.columns, "split")
