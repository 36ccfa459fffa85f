"""Queries whose SQL serves both Spark and DuckDB.

A statement names tables as {table} and, where the engines differ, functions as NAME(...) in capitals
from the list below. Spark binds the tables as DataFrames; DuckDB sees them as views.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from larkspur.storage import table

_WORD = r"[^\x20\x09-\x0D]+"
# function: (Spark, DuckDB); {0} is the first argument
DIALECT = {
    "WORDS": (rf"regexp_extract_all({{0}}, r'{_WORD}', 0)", rf"regexp_extract_all({{0}}, '{_WORD}')"),
    "EACH": ("LATERAL explode({0})", "LATERAL unnest({0})"),
    "SECONDS": ("unix_seconds(CAST({0} AS TIMESTAMP))", "CAST(floor(epoch({0})) AS BIGINT)"),
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
    "JSON_K": ("get_json_object({0}, '$.k')", "json_extract_string({0}, '$.k')"),
    "SIZE": ("size({0})", "len({0})"),
    "DISTINCT_ITEMS": ("array_distinct({0})", "list_distinct({0})"),
    "SORTED_ITEMS": ("array_sort({0})", "list_sort({0})"),
    "COMMON": ("array_intersect({0}, {1})", "list_intersect({0}, {1})"),
    "HAS": ("array_contains({0}, {1})", "list_contains({0}, {1})"),
    "JOINED": ("array_join({0}, {1})", "array_to_string({0}, {1})"),
    "COLLECT": ("collect_list({0})", "list({0})"),
    "COLLECT_SET": ("collect_set({0})", "list(DISTINCT {0})"),
    "REPLACE_ALL": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "EXTRACT": ("regexp_extract({0}, {1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "MATCHES": ("({0} rlike {1})", "regexp_matches({0}, {1})"),
    "TRY_DOUBLE": ("try_cast({0} AS double)", "TRY_CAST({0} AS DOUBLE)"),
    "PERCENTILE": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "HEX_BYTE": ("CAST(conv({0}, 16, 10) AS double)", "CAST(('0x' || {0}) AS INTEGER)::DOUBLE"),
    "BITS": ("bit_count({0})", "CAST(bit_count({0}) AS INTEGER)"),
    "XOR": ("({0} ^ {1})", "xor({0}, {1})"),
    "HALF_EVEN": ("bround({0})", "round_even({0}, 0)"),
    "DAYS_BEFORE": ("({0} - make_dt_interval({1}))", "({0} - to_days({1}))"),
    "ITEM": ("element_at({0}, {1})", "list_extract({0}, {1})"),
    "LENGTHS_1": ("left({0}, {1})", "left({0}, {1})"),
    "DOT": ("aggregate(zip_with({0}, {1}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)", "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"),
    "RANGE_LIST": ("sequence({0}, {1})", "generate_series({0}, {1})"),
}
_CALL = re.compile(r"\b(" + "|".join(DIALECT) + r")\(")


def _arguments(sql: str, at: int) -> tuple[list[str], int]:
    """Top-level arguments of the call whose bracket opens just before `at`, and where it ends."""
    depth, quoted, start, out = 0, False, at, []
    for k in range(at, len(sql)):
        c = sql[k]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            if c == ")" and depth == 0:
                return [*out, sql[start:k].strip()], k + 1
            depth -= 1
        elif c == "," and depth == 0:
            out.append(sql[start:k].strip())
            start = k + 1
    raise ValueError("unclosed call in: " + sql[at - 20 : at + 40])


def translate(sql: str, engine: int) -> str:
    found = _CALL.search(sql)
    while found:
        args, end = _arguments(sql, found.end())
        body = DIALECT[found[1]][engine]
        for k, arg in enumerate(args):
            body = body.replace(f"{{{k}}}", arg)
        sql = sql[: found.start()] + body + sql[end:]
        found = _CALL.search(sql)
    return sql


class Catalogue:
    """Named queries with one statement for both engines, or a Spark function beside DuckDB SQL."""

    def __init__(self):
        self.QUERIES: dict[str, Callable] = {}
        self.ORACLES: dict[str, str] = {}
        self.COVERS: dict[str, str] = {}

    def sql(self, name: str, covers: str, statement: str) -> None:
        tables = sorted(set(re.findall(r"\{([a-z]\w+)\}", statement)))
        spark_sql = translate(statement, 0)

        def run(spark, sf_dir):
            return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in tables})

        self.QUERIES[name] = run
        self.ORACLES[name] = re.sub(r"\{([a-z]\w+)\}", r"\1", translate(statement, 1))
        self.COVERS[name] = covers

    def query(self, name: str, covers: str, oracle: str | None = None):
        def add(f):
            self.QUERIES[name] = f
            if oracle:
                self.ORACLES[name] = re.sub(r"\{([a-z]\w+)\}", r"\1", translate(oracle, 1))
            self.COVERS[name] = covers
            return f

        return add
