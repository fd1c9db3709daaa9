"""Text formats of the wire: JSON moves, query strings, status documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_rows(df: DataFrame, keep: list[str], fields: dict[str, Column]) -> DataFrame:
    """Select ``keep`` and the computed fields, each computed once per row.

    The fields pass through ``inline``: filters on them are not copied below it,
    where every use would repeat the whole parsing expression.
    """
    row = F.struct(*[c.alias(name) for name, c in fields.items()])
    return df.select(*keep, F.inline(F.array(row)))


_OTHER_CASE = r"""\\|"(X|Y|U[iI][dD]|u(I[dD]|iD))\""""
"""What every record has in which a field is not written in lower case; few others do."""


def parse_moves(df: DataFrame) -> DataFrame:
    """Parse ``body`` into ``x,y,uid`` plus ``code`` (0 accepted, -1 rejected).

    Absent and null fields are 0, unknown fields are ignored and the case of field
    names does not matter: of several spellings of a field the last one that is not
    null counts.  A string, a fraction, an exponent, a boolean or an over-long integer
    under any spelling rejects the record, as does anything that is neither an object
    nor null.  A repeated key also rejects (unless the session sets
    ``spark.sql.variant.allowDuplicateKeys``).
    """
    fields = ("x", "y", "uid")
    keep = [c for c in df.columns if c != "body"]
    parsed = df.withColumn("_v", F.expr("try_parse_json(body)"))

    def found(f: str) -> str:
        """Type and value of a field, under all of its spellings in their order.  Only records
        with another than the plain spelling need their list of names."""

        def typed(v: str, path: str) -> str:
            whole = f"try_variant_get({v}, '{path}', 'variant')"
            return f"named_struct('t', schema_of_variant({whole}), 'n', try_variant_get({v}, '{path}', 'bigint'))"

        return (
            f"case when _m is null then array({typed('_v', '$.' + f)}) else"
            f" transform(filter(_names, k -> lower(k) = '{f}'), k -> {typed('_m[k]', '$')}) end as _{f}"
        )

    odd = F.col("body").rlike(_OTHER_CASE)
    split = parsed.select(
        *keep, "_v", F.expr("schema_of_variant(_v)").alias("_top"),
        F.when(odd, F.expr("json_object_keys(body)")).alias("_names"),
        F.when(odd, F.expr("try_cast(_v as map<string, variant>)")).alias("_m"),
    ).selectExpr(*keep, "_top", *map(found, fields))
    ok = F.coalesce(F.col("_top").startswith("OBJECT<") | (F.col("_top") == "VOID"), F.lit(False))
    for f in fields:
        ok = ok & F.forall(
            f"_{f}",
            lambda e: F.coalesce(e["t"], F.lit("VOID")).isin("VOID") | ((e["t"] == "BIGINT") & e["n"].isNotNull()),
        )

    def last(f: str) -> Column:
        known = F.filter(F.transform(f"_{f}", lambda e: e["n"]), lambda n: n.isNotNull())
        return F.coalesce(F.try_element_at(known, F.lit(-1)), F.lit(0).cast("long"))

    judged = split.withColumn("_ok", ok)
    return _as_rows(
        judged,
        keep,
        {"code": F.when(F.col("_ok"), 0).otherwise(-1).cast("long")}
        | {f: F.when(F.col("_ok"), last(f)) for f in fields},
    )


def parse_rect_requests(df: DataFrame) -> DataFrame:
    """Parse ``qs`` into ``x1,y1,x2,y2`` plus ``code`` and ``msg``.

    ``msg`` is the first failing check in the order x1, x2, y1, y2 (present, then an
    integer of optional sign and decimal digits), ``x1<x2``, ``y1<y2``.  The first
    value of a repeated key counts.  The bounds are NULL unless the request passes.
    """
    keep = [c for c in df.columns if c != "qs"]
    bad_escape = "%(?![0-9A-Fa-f]{2}).{0,2}"
    checks = {
        "x1": "x1 not int",
        "x2": "x2 should be int",
        "y1": "y1 should be int",
        "y2": "y2 should be int",
    }
    def coded(text: Column) -> Column:
        return text.contains("%") | text.contains("+")

    def plain(text: Column) -> Column:
        return F.when(coded(text), F.try_url_decode(text)).otherwise(text)

    def plain_key(pair: Column) -> Column:
        cut = F.split(pair, "=", 2)
        value = F.when(F.size(cut) > 1, F.concat(F.lit("="), cut[1])).otherwise(F.lit(""))
        return F.concat(F.coalesce(F.try_url_decode(cut[0]), F.lit("?")), value)

    query = F.coalesce("qs", F.lit(""))
    keys_plain = F.array_join(F.transform(F.split(query, "&"), plain_key), "&")
    ready = df.withColumn("_q", F.when(coded(query), keys_plain).otherwise(query))
    # The first "key=value" or bare "key" of each name, NULL if absent.
    found = ready.withColumns(
        {f"_h_{n}": F.regexp_substr("_q", F.lit(f"(?:^|&){n}(?:=[^&]*|(?=&|$))")) for n in checks}
    )
    texts = found.withColumns(
        {f"_t_{n}": plain(F.expr(f"substr(_h_{n}, instr(_h_{n}, '=') + 1)")) for n in checks}
    )
    numbers = texts.withColumns(
        {
            f"_n_{n}": F.when(
                F.col(f"_t_{n}").rlike("^[+-]?[0-9]+$"), F.col(f"_t_{n}").try_cast("bigint")
            )
            for n in checks
        }
    )

    def number(name: str) -> Column:
        return F.col(f"_n_{name}")

    msg = F.when(F.col("qs").contains(";"), F.lit("invalid semicolon separator in query")).when(
        F.col("qs").contains("%") & F.col("qs").rlike(bad_escape),
        F.concat(F.lit('invalid URL escape "'), F.regexp_extract("qs", bad_escape, 0), F.lit('"')),
    )
    for name, wrong in checks.items():
        msg = msg.when(F.col(f"_h_{name}").isNull(), F.lit(f"no {name}"))
        msg = msg.when(number(name).isNull(), F.lit(wrong))
    msg = msg.when(number("x1") >= number("x2"), F.lit("x1<x2"))
    msg = msg.when(number("y1") >= number("y2"), F.lit("y1<y2"))
    judged = numbers.withColumn("_m", msg)
    good = F.col("_m").isNull()
    return _as_rows(
        judged,
        keep,
        {
            "code": F.when(good, 0).otherwise(-1).cast("long"),
            "msg": F.coalesce("_m", F.lit("OK")),
        }
        | {n: F.when(good, number(n)) for n in ("x1", "y1", "x2", "y2")},
    )


def envelope(df: DataFrame, code: str = "code", msg: str = "msg") -> DataFrame:
    """Add ``body``: the status document ``{"code":..,"msg":..,"data":[]}``."""
    doc = F.struct(
        F.col(code).alias("code"),
        F.col(msg).alias("msg"),
        F.array().cast("array<struct<x:bigint,y:bigint,uid:bigint>>").alias("data"),
    )
    return df.withColumn("body", F.to_json(doc))
