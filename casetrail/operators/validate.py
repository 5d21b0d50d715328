"""The gate: is a raw JSON record well formed, and could it have happened?

`validate` adds to every message
    record_id  the record's own id (trimmed)
    model      the typed fields, strings trimmed, defaults filled in
    reasons    why it is refused; one schema reason, or every plausibility reason in order
    verdict    ok, rejected, or poison (passes the gate but holds a NUL, which stores refuse)

Only the first schema error counts: fields in declaration order, unknown fields last. Numbers are
not accepted as text. Beyond JSON types, a number, boolean, date or time may be written as text,
and a time may be an epoch number (seconds, or milliseconds when beyond 2e10).
Nothing depends on the wall clock: `now` is an argument.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions.dates import age_on, instant, own_date, parse_date, parse_timestamp
from casetrail.functions.text import normalise_phone
from casetrail.schemas import SOURCES, Field, Source

EARLIEST = datetime(2015, 1, 1)
MAX_TRANSFER = 1_000_000.0

# Fixed value: the characters with the Unicode property White_Space.
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
               "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# Error texts of the record models, and words read as booleans.
REQUIRED = "Field required"
NOT_TEXT = "Input should be a valid string"
NOT_LIST = "Input should be a valid list"
NOT_NUMBER = "Input should be a valid number"
NOT_BOOLEAN = "Input should be a valid boolean"
NOT_DATE = "Input should be a valid date"
NOT_TIME = "Input should be a valid datetime"
NOT_POSITIVE = "Input should be greater than 0"
NOT_RECORD = "Input should be a valid dictionary"
UNKNOWN = "Extra inputs are not permitted"
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "off", "f", "false", "n", "no"]
TRANSFER_LIMIT_NAME = "R1m"
POISON = "processing error after 3 attempts: text holds a NUL character"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The checks of a field are SQL text: one expression per field instead of dozens of small ones.
def _get(field: Field, as_type: str) -> str:
    return f"try_variant_get(_v, '$.{field.name}', '{as_type}')"


def _text(field: Field) -> str:
    return f"btrim({_get(field, 'string')}, {_quoted(WHITE_SPACE)})"


def _json_type(field: Field) -> Column:
    """STRING, BIGINT, DECIMAL(p,s), ..., VOID for an explicit null; SQL null when absent."""
    return F.expr(f"schema_of_variant({_get(field, 'variant')})")


def _value(field: Field) -> Column:
    """The typed value; null when it cannot be read."""
    kind = f"_t_{field.name}"
    is_text, is_number = f"{kind} = 'STRING'", f"{kind} rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"
    if field.type == "string":
        return F.expr(f"CASE WHEN {is_text} THEN {_text(field)} END")
    if field.type == "array<string>":
        return F.expr(f"CASE WHEN startswith({kind}, 'ARRAY') THEN transform({_get(field, 'array<string>')}, "
                      f"x -> btrim(x, {_quoted(WHITE_SPACE)})) END")
    if field.type == "double":
        return F.expr(f"CASE WHEN {is_text} THEN try_cast({_text(field)} AS double) "
                      f"WHEN {is_number} OR {kind} = 'BOOLEAN' THEN {_get(field, 'double')} END")
    if field.type == "boolean":
        word, number = f"lower({_get(field, 'string')})", _get(field, "double")
        yes, no = (", ".join(map(_quoted, words)) for words in (TRUE_WORDS, FALSE_WORDS))
        return F.expr(f"CASE WHEN {kind} = 'BOOLEAN' THEN {_get(field, 'boolean')} "
                      f"WHEN {is_text} AND {word} IN ({yes}) THEN true WHEN {is_text} AND {word} IN ({no}) THEN false "
                      f"WHEN {is_number} AND {number} IN (0, 1) THEN {number} = 1 END")
    if field.type == "date":
        return F.when(F.expr(is_text), parse_date(F.expr(_text(field))))
    number = _get(field, "double")
    micros = f"CAST({number} * CASE WHEN abs({number}) > 2e10 THEN 1000 ELSE 1000000 END AS bigint)"
    return F.when(F.expr(is_text), parse_timestamp(F.expr(_text(field)))).when(
        F.expr(is_number), F.expr(f"timestamp_micros({micros})"))


def _field_error(field: Field) -> str:
    """First thing wrong with a field, else null."""
    kind, value = f"_t_{field.name}", f"_f_{field.name}"
    wrong = {"string": NOT_TEXT, "array<string>": NOT_LIST, "double": NOT_NUMBER,
             "boolean": NOT_BOOLEAN, "date": NOT_DATE, "timestamp": NOT_TIME}[field.type]
    checks: list[tuple[str, str]] = []
    if field.required:
        checks.append((f"{kind} IS NULL", REQUIRED))
    unreadable = f"{kind} IS NOT NULL AND {value} IS NULL"
    checks.append((f"{unreadable} AND {kind} <> 'VOID'" if field.nullable else unreadable, wrong))
    if field.min_len is not None:
        checks.append((f"length({value}) < {field.min_len}",
                       f"String should have at least {field.min_len} characters"))
    if field.max_len is not None:
        checks.append((f"length({value}) > {field.max_len}",
                       f"String should have at most {field.max_len} characters"))
    if field.pattern:
        checks.append((f"NOT {value} rlike {_quoted(field.pattern)}",
                       f"String should match pattern '{field.pattern}'"))
    if field.choices:
        *most, last = [f"'{c}'" for c in field.choices]
        checks.append((f"{value} NOT IN ({', '.join(map(_quoted, field.choices))})",
                       f"Input should be {', '.join(most)} or {last}"))
    if field.positive:
        # In Spark NaN is greater than every number.
        checks.append((f"NOT {value} > 0 OR isnan({value})", NOT_POSITIVE))
    cases = [f"WHEN {test} THEN {_quoted(f'schema: {field.name}: {says}')}" for test, says in checks]
    if field.type == "array<string>":
        texts = (f"transform({_get(field, 'array<variant>')}, "
                 "e -> coalesce(schema_of_variant(e), 'VOID') = 'STRING')")
        cases.append(f"WHEN array_position({texts}, false) > 0 THEN concat('schema: {field.name}.', "
                     f"CAST(array_position({texts}, false) - 1 AS string), {_quoted(f': {NOT_TEXT}')})")
    return f"CASE {' '.join(cases)} END"


def _plausibility(spec: Source, now: datetime, earliest: datetime, limit: float) -> Column:
    at = F.col(f"_f_{spec.time_field}") if spec.time_field else None
    reasons: list[Column] = []
    if at is not None:
        latest = instant(now) + F.expr("INTERVAL 1 DAY")
        reasons += [
            F.when(at > latest, F.lit(f"{spec.time_field} is in the future")),
            F.when(at < instant(earliest),
                   F.lit(f"{spec.time_field} is before {earliest.year}")),
        ]
    if spec.name == "kyc":
        opened_text = F.expr("try_variant_get(_v, '$.opened_at', 'string')")
        age = age_on(F.col("_f_date_of_birth"),
                     F.coalesce(own_date(F.trim(opened_text)), at.cast("date")))
        reasons += [
            F.when(normalise_phone(F.col("_f_phone")).isNull(),
                   F.lit("phone is not a valid South African mobile number")),
            F.when(~age.between(16, 110),
                   F.format_string("customer age %d at opening is implausible", age)),
        ]
    if spec.name == "transactions":
        amount = F.col("_f_amount_zar")
        reasons += [
            F.when(F.col("_f_from_account") == F.col("_f_to_account"),
                   F.lit("account sends money to itself")),
            F.when(amount > limit, F.format_string(
                f"amount %.2f exceeds the {TRANSFER_LIMIT_NAME} single-transfer limit", amount)),
        ]
    if not reasons:
        return F.array().cast("array<string>")
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def _model(spec: Source) -> Column:
    out = []
    for field in spec.fields:
        value = F.col(f"_f_{field.name}")
        if field.name == "amount_zar":
            # From the written number, not from its binary neighbour.
            value = F.expr(f"try_cast({_get(field, 'string')} AS decimal(14,2))")
        elif not field.required and not field.nullable:
            empty = F.lit("") if field.type == "string" else F.array().cast(field.type)
            value = F.coalesce(value, empty)
        out.append(value.alias(field.name))
    return F.struct(*out)


def _holds_nul(spec: Source) -> Column:
    tests = [f"contains(_f_{f.name}, char(0))" for f in spec.fields if f.type == "string"]
    tests += [f"exists(_f_{f.name}, x -> contains(x, char(0)))" for f in spec.fields if f.type == "array<string>"]
    return F.expr(" OR ".join(f"coalesce({t}, false)" for t in tests))


def validate(raw: DataFrame, source: str, now: datetime, earliest: datetime = EARLIEST,
             max_transfer: float = MAX_TRANSFER, value: str = "value",
             patterns: dict[str, str] | None = None) -> DataFrame:
    """Check every message of one source; see the module text for the added columns.

    `patterns` replaces id formats by field name, for id ranges that outgrew the fixed digits.
    """
    spec = SOURCES[source]
    if patterns:
        spec = replace(spec, fields=tuple(
            replace(f, pattern=patterns.get(f.name, f.pattern)) for f in spec.fields))
    keep = [F.col(c) for c in raw.columns]
    parsed = raw.select(*keep, F.try_parse_json(value).alias("_v"))
    typed = parsed.select(*keep, "_v", *[_json_type(f).alias(f"_t_{f.name}") for f in spec.fields])
    read = typed.select("*", *[_value(f).alias(f"_f_{f.name}") for f in spec.fields])

    known = ", ".join(_quoted(f.name) for f in spec.fields)
    unknown = f"array_except(json_object_keys({value}), array({known}))[0]"
    errors = [f"CASE WHEN NOT coalesce(startswith(schema_of_variant(_v), 'OBJECT'), false) "
              f"THEN {_quoted(f'schema: record: {NOT_RECORD}')} END"]
    errors += [_field_error(f) for f in spec.fields]
    errors += [f"CASE WHEN size(array_except(json_object_keys({value}), array({known}))) > 0 "
               f"THEN concat('schema: ', {unknown}, {_quoted(f': {UNKNOWN}')}) END"]
    judged = read.select("*", F.expr(f"coalesce({', '.join(errors)})").alias("_schema_error"))

    reasons = F.when(F.col("_schema_error").isNotNull(), F.array("_schema_error")).otherwise(
        _plausibility(spec, now, earliest, max_transfer))
    reasoned = judged.select("*", reasons.alias("_reasons"))
    verdict = F.when(F.size("_reasons") > 0, "rejected").when(_holds_nul(spec), "poison").otherwise("ok")
    done = reasoned.select("*", verdict.alias("verdict")).select(
        *keep,
        F.col(f"_f_{spec.id_field}").alias("record_id"),
        F.when(F.col("verdict") != "rejected", _model(spec)).alias("model"),
        F.when(F.col("verdict") == "poison", F.array(F.lit(POISON)))
         .otherwise(F.col("_reasons")).alias("reasons"),
        "verdict",
    )
    # A filter on the verdict must not be pushed below: it would repeat all checks inside itself.
    return done.select(*keep, F.inline(F.array(F.struct("record_id", "model", "reasons", "verdict"))))


def validate_record(spark, source: str, record_json: str, now: datetime, **bounds) -> DataFrame:
    """One record, as a one-row answer."""
    return validate(spark.createDataFrame([(record_json,)], "value string"), source, now, **bounds)


def dead_letters(judged: DataFrame, at: datetime | None = None) -> DataFrame:
    """Quarantine rows for everything refused; the record is kept as it came."""
    when = instant(at) if at else F.current_timestamp()
    return judged.filter(F.col("verdict") != "ok").select(
        F.col("verdict").alias("kind"), "source", "reasons", F.col("value").alias("record"),
        "topic", "partition", "offset", "key", when.alias("dead_lettered_at"))
