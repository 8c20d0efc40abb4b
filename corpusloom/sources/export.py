"""SRC-08: a creator export, three levels deep, as one row for each text that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canon import slugify

_ASSET = "asset_id:string,role:string,kind:string,generated:boolean,download_status:string,local_path:string,width:bigint,height:bigint,duration_seconds:double,page_number:bigint"
_BLOCK = "role:string,eligible_for_feed_creator_style:boolean,exact_text:string,published_at:struct<date:string>,source_url:string,asset_ids:array<string>,author:struct<name:string>"
_POST = (
    "ref:string,classification:string,is_self_repost:boolean,chronology:struct<timestamp:struct<date:string>>,source_links:struct<post_url:string>,"
    f"engagement:struct<total_reactions:bigint,comments:bigint,shares:bigint>,assets:array<struct<{_ASSET}>>,text_blocks:array<struct<{_BLOCK}>>"
)
SCHEMA = f"creator_groups array<struct<creator:struct<creator_key:string,display_name:string>,posts:array<struct<{_POST}>>>>"

# The roles of files that were part of a post as it appeared.
ORIGINALS = ("primary_image", "primary_video", "document_pdf", "article_preview")
VERIFIED, QUOTED, COMMENT = "downloaded_and_verified", "quoted_original", "creator_commentary"


def _note(asset: Column, quoted: Column) -> Column:
    """What a file is and how large, never what it means."""
    kind = F.regexp_replace(F.coalesce(F.nullif(asset["role"], F.lit("")), asset["kind"], F.lit("media")), "_", " ")
    bits = [
        kind,
        F.when(quoted, "belongs to the quoted post, not to the comment"),
        F.when((asset["width"] > 0) & (asset["height"] > 0), F.concat(asset["width"], F.lit("x"), asset["height"])),
        F.when((asset["duration_seconds"] > 0) & (asset["kind"] == "video"), F.concat(F.bround(asset["duration_seconds"], 0).cast("long"), F.lit("s"))),
        F.when(asset["page_number"] > 0, F.concat(F.lit("page "), asset["page_number"])),
    ]
    return F.array_join(F.array_compact(F.array(*bits)), ", ")


def _media(block: Column, post: Column, quoted_block: Column) -> Column:
    """The originals of a block in its order; a comment without files of its own has those of the post that it quotes."""
    own = F.coalesce(block["asset_ids"], F.array().cast("array<string>"))
    borrowed = (F.size(own) == 0) & (block["role"] == COMMENT) & quoted_block.isNotNull()
    ids = F.when(borrowed, F.coalesce(quoted_block["asset_ids"], F.array().cast("array<string>"))).otherwise(own)
    assets = F.coalesce(post["assets"], F.array().cast(f"array<struct<{_ASSET}>>"))
    named = F.transform(ids, lambda i: F.try_element_at(F.filter(assets, lambda a: a["asset_id"] == i), F.lit(-1)))
    good = F.filter(named, lambda a: a["role"].isin(*ORIGINALS) & ~F.coalesce(a["generated"], F.lit(False)) & (a["download_status"] == VERIFIED) & (F.coalesce(a["local_path"], F.lit("")) != ""))
    return F.transform(good, lambda a: F.struct(a["local_path"].alias("path_or_url"), _note(a, borrowed).alias("description")))


def _context(block: Column, post: Column, quoted_block: Column) -> Column:
    """What a reader saw beside the text: the quoted post, or that the creator shared it again."""
    who = F.coalesce(F.nullif(quoted_block["author"]["name"], F.lit("")), F.lit("someone else"))
    said = F.trim(F.coalesce(quoted_block["exact_text"], F.lit("")))
    quote = F.concat(F.lit("This post is a comment on someone else's post, shown above it in the feed. The quoted post, by "), who, F.lit(", reads:\n"), said)
    missing = "This is a comment on a quoted post; the quoted post was not captured."
    comment = (post["classification"] == "quote") & (block["role"] == COMMENT)
    return F.when(comment & quoted_block.isNull(), missing).when(comment, quote).when(post["is_self_repost"], "The creator re-shared this post of their own; the text is theirs.")


def read_export(spark: SparkSession, path: str, only: list[str] | None = None, lang: str | None = "en") -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of the JSON files of an export: a row for each text block that is eligible and not blank, and (ref, reason) of the blank ones.

    only names creators by key or slug. A block's date comes before its post's. Assets are joined by id inside the post's own arrays, so nothing is shuffled;
    of the file only the fields of SCHEMA are parsed. A file without groups has no rows, and one that is no JSON is an error.
    """
    groups = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path, multiLine=True).select(F.explode("creator_groups").alias("g"))
    key = F.coalesce(F.col("g.creator.creator_key"), F.lit(""))
    named = groups.select(key.alias("key"), F.coalesce(F.nullif(F.col("g.creator.display_name"), F.lit("")), key).alias("author"), "g.posts")
    if only:
        named = named.where(F.col("key").isin(*only) | slugify("author").isin(*only))
    posts = named.select("author", F.explode("posts").alias("post"))
    blocks = posts.select("author", "post", F.explode("post.text_blocks").alias("block")).where("block.eligible_for_feed_creator_style")
    quoted = F.try_element_at(F.filter("post.text_blocks", lambda b: b["role"] == QUOTED), F.lit(1))
    post, block = F.col("post"), F.col("block")
    full = blocks.select(
        "author",
        F.lit("linkedin").alias("platform"),
        F.lit(lang).cast("string").alias("lang"),
        F.coalesce(block["exact_text"], F.lit("")).alias("text"),
        F.coalesce(block["published_at"]["date"], post["chronology"]["timestamp"]["date"]).alias("posted_at"),
        F.coalesce(F.nullif(block["source_url"], F.lit("")), post["source_links"]["post_url"]).alias("url"),
        F.struct(post["engagement"]["total_reactions"].alias("likes"), post["engagement"]["comments"].alias("comments"), post["engagement"]["shares"].alias("reposts")).alias("engagement"),
        _media(block, post, quoted).alias("media"),
        _context(block, post, quoted).alias("context"),
        F.coalesce(post["ref"], F.lit("?")).alias("ref"),
        F.coalesce(post["classification"], F.lit("original")).alias("classification"),
    )
    blank = ~F.col("text").rlike(r"\S")
    return full.where(~blank), full.where(blank).select("ref", F.lit("empty text").alias("reason"))


def missing_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, path) of media that are not among files (path): warnings, not errors."""
    named = rows.select("ref", F.explode("media.path_or_url").alias("path"))
    return named.join(files.select("path"), "path", "left_anti").select("ref", "path").distinct()
