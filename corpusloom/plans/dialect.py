"""Queries written once for two engines: the places where their SQL differs are @name(arguments)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> (Spark SQL, DuckDB SQL); {0}, {1} and so on are the arguments, {all} all of them.
FORMS = {
    "sha": ("sha2({0}, 256)", "sha256({0})"),
    "replace": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "hit": ("({0} rlike {1})", "regexp_matches({0}, {1})"),
    "count_hits": ("regexp_count({0}, {1})", "len(regexp_extract_all({0}, {1}))"),
    "hits": ("regexp_extract_all({0}, {1}, 0)", "regexp_extract_all({0}, {1})"),
    "extract": ("regexp_extract({0}, {1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "size": ("size({0})", "len({0})"),
    "list": ("array({all})", "[{all}]"),
    "explode": ("lateral view explode({0}) _e as {1}", ", unnest({0}) as _e({1})"),
    "slice": ("slice({0}, {1}, {2})", "({0})[({1}):({1}) + ({2}) - 1]"),
    "join": ("array_join({0}, {1})", "array_to_string({0}, {1})"),
    "split": ("split({0}, {1}, -1)", "regexp_split_to_array({0}, {1})"),
    "keep": ("filter({0}, _x -> {1})", "list_filter({0}, lambda _x: {1})"),
    "map": ("transform({0}, _x -> {1})", "list_transform({0}, lambda _x: {1})"),
    "steps": ("(case when {1} >= {0} then sequence({0}, {1}) else array() end)", "range({0}, {1} + 1)"),
    "greatest_of": ("array_max({0})", "list_max({0})"),
    "any": ("exists({0}, _y -> {1})", "(len(list_filter({0}, lambda _y: {1})) > 0)"),
    "distinct": ("array_distinct({0})", "list_distinct({0})"),
    "common": ("size(array_intersect({0}, {1}))", "len(list_intersect({0}, {1}))"),
    "overlap": ("arrays_overlap({0}, {1})", "list_has_any({0}, {1})"),
    "has": ("array_contains({0}, {1})", "list_contains({0}, {1})"),
    "gather": ("array_sort(collect_list({0}))", "list_sort(list({0}))"),
    "gather_set": ("array_sort(collect_set({0}))", "list_sort(list(distinct {0}))"),
    "quantile": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "number": ("try_cast({0} as {1})", "try_cast({0} as {1})"),
    "hex_number": ("cast(conv({0}, 16, 10) as bigint)", "('0x' || {0})::bigint"),
    "seconds": ("unix_timestamp(cast({0} as timestamp))", "floor(epoch({0}))::bigint"),
    "days": ("datediff({0}, {1})", "date_diff('day', {1}::date, {0}::date)"),
    "parsed_date": ("coalesce(try_to_date({0}, 'yyyy-MM-dd'), try_to_date({0}, 'dd/MM/yyyy'), try_to_date({0}, 'MMM d, yyyy'))", "coalesce(try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%d/%m/%Y'), try_strptime({0}, '%b %-d, %Y'))::date"),
    "edits": ("levenshtein({0}, {1})", "levenshtein({0}, {1})"),
    "fold": ("aggregate({0}, {1}, (_a, _x) -> {2})", "list_reduce(list_prepend({1}, {0}), lambda _a, _x: {2})"),
    "json": ("get_json_object({0}, '$.{1}')", "json_extract_string({0}, '$.{1}')"),
    "text": ("cast({0} as string)", "cast({0} as varchar)"),
    "big": ("cast({0} as bigint)", "cast({0} as bigint)"),
    "real": ("cast({0} as double)", "cast({0} as double)"),
    "host": ("parse_url({0}, 'HOST')", "regexp_extract({0}, '^[a-z]+://([^/:?#]+)', 1)"),
    "idiv": ("(({0}) div ({1}))", "(({0}) // ({1}))"),
    "dot": ("aggregate(zip_with({0}, {1}, (_p, _q) -> cast(_p as double) * _q), cast(0 as double), (_a, _x) -> _a + _x)", "list_dot_product({0}::double[], {1}::double[])"),
    "at": ("element_at({0}, {1})", "({0})[{1}]"),
    # A sequence of words; n-grams of a sequence; normalised text.
    "norm": ("trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' '))", "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"),
    "words": ("filter(split(regexp_replace(lower({0}), '[^a-z0-9]+', ' '), ' '), _w -> _w != '')", "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda _w: _w != '')"),
    "grams": ("(case when size({0}) >= {1} then array_distinct(transform(sequence(1, size({0}) - {1} + 1), _i -> array_join(slice({0}, _i, {1}), ' '))) else array() end)", "list_distinct(list_transform(range(1, len({0}) - {1} + 2), lambda _i: array_to_string(({0})[_i:_i + {1} - 1], ' ')))"),
    "placed_grams": ("(case when size({0}) >= {1} then transform(sequence(1, size({0}) - {1} + 1), _i -> struct(_i as at, array_join(slice({0}, _i, {1}), ' ') as gram)) else array() end)", "list_transform(range(1, len({0}) - {1} + 2), lambda _i: {{'at': _i, 'gram': array_to_string(({0})[_i:_i + {1} - 1], ' ')}})"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The comma-separated arguments from the place behind an opening bracket, and the place behind its closing one."""
    out, depth, start, quoted = [], 0, at, False
    while True:
        c = text[at]
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "([":
            depth += 1
        elif not quoted and c in ")]":
            if not depth:
                out.append(text[start:at].strip())
                return out, at + 1
            depth -= 1
        elif not quoted and not depth and c == ",":
            out.append(text[start:at].strip())
            start = at + 1
        at += 1


def _rounded(sql: str) -> str:
    """round(x, k) as DuckDB computes it, on the scaled double; Spark's own rounds the shortest decimal of x, which is another at a tie."""
    at = 0
    while m := re.compile(r"(?<![\w@])round\(").search(sql, at):
        args, end = _arguments(sql, m.end())
        at = m.end()
        if len(args) == 2:
            by = f"1e{int(args[1])}D"
            sql = f"{sql[: m.start()]}(round(({args[0]}) * {by}) / {by}){sql[end:]}"
            at = m.start() + len("(round(")
    return sql


def render(sql: str, duck: bool) -> str:
    """The SQL of one engine."""
    while m := re.search(r"@([a-z_]+)\(", sql):
        args, end = _arguments(sql, m.end())
        sql = sql[: m.start()] + FORMS[m[1]][duck].format(*args, all=", ".join(args)) + sql[end:]
    if not duck:
        sql = _rounded(sql)
    # Numbers with a point are doubles in both. Spark reads a backslash in a string as an escape, DuckDB does not.
    parts = sql.split("'")
    parts[::2] = [re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1::double" if duck else r"\1D", x) for x in parts[::2]]
    sql = "'".join(parts)
    return sql.replace("\\\\", "\\") if duck else sql


def spark_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query function of (spark, sf_dir) for SQL whose tables are the driver's."""
    used = [t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", sql)]
    text = render(sql, False)
    for t in used:
        text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", text)
    # Braces that are not table names are none of spark.sql's.
    text = re.sub(r"\{(?!(?:%s)\})" % "|".join(used or ["_"]), "{{", text) if used else text
    return lambda spark, sf_dir: spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def both(plans: dict[str, str]) -> tuple[dict[str, Callable], dict[str, str]]:
    return {k: spark_query(v) for k, v in plans.items()}, {k: render(v, True) for k, v in plans.items()}
