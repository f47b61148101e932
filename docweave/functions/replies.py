"""Model replies: JSON text to a checked, fully defaulted struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLASS, DOC_DATA, NAMED_ITEM, SKIP_CALL_NAME, TYPED_ITEM, empty_items
from .lets import let

OK = "ok"
NO_FUNCTION_CALL = "no_function_call"
UNEXPECTED_FUNCTION = "unexpected_function"
SKIPPED = "skipped"
INVALID_ARGUMENTS = "invalid_arguments"
EMPTY_DESCRIPTION = "empty_description"
GENERATION_ERROR = "generation_error"
TOO_MANY_TOKENS = "too_many_tokens"
RATE_LIMITED = "rate_limited"

_CALL = "$.choices[0].message.function_call"


def strict_json_object(text: Column) -> Column:
    """The variant in ``text``, or NULL unless it is exactly one JSON object.

    Spark's JSON functions ignore whatever follows the first value. Here the text is
    read as the first of two array elements; the second, a digest of the text, is only
    found in place if nothing but one value precedes it.
    """
    mark = F.md5(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(', "'), mark, F.lit('"]')))

    def checked(array: Column) -> Column:
        whole = F.try_variant_get(array, "$[1]", "string") == mark
        first = F.try_variant_get(array, "$[0]", "variant")
        return F.when(whole & _type_of(first).startswith("OBJECT"), first)

    return let(wrapped, checked)


def _type_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text_or_missing(value: Column, name: str) -> Column:
    kind = _type_of(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.coalesce(kind == "STRING", F.lit(True))


def _list(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "array<variant>")


def _valid_list(value: Column, name: str, fields: tuple[str, ...]) -> Column:
    kind = _type_of(F.try_variant_get(value, f"$.{name}", "variant"))

    def valid_item(item: Column) -> Column:
        good = F.coalesce(_type_of(item), F.lit("VOID")).startswith("OBJECT")
        for field in fields:
            good &= _text_or_missing(item, field)
        return good

    return kind.isNull() | (
        kind.startswith("ARRAY") & F.coalesce(F.forall(_list(value, name), valid_item), F.lit(False))
    )


# Type of a reply with only known fields of the right type, as Spark prints it.
_ITEMS = r"ARRAY<(?:VOID|OBJECT<(?:(?:assumed_type|description|name): STRING(?:, )?)*>)>"
_PLAIN = (
    rf"^OBJECT<(?:description: STRING(?:, )?)?(?:exceptions: {_ITEMS}(?:, )?)?"
    rf"(?:parameters: {_ITEMS}(?:, )?)?(?:return_values: {_ITEMS})?>$"
)
_TYPED, _NAMED = ("name", "description", "assumed_type"), ("name", "description")
_LISTS = [
    ("parameters", _TYPED, TYPED_ITEM),
    ("return_values", _TYPED, TYPED_ITEM),
    ("exceptions", _NAMED, NAMED_ITEM),
]


def _valid(value: Column, is_class: Column) -> Column:
    lists = F.lit(True)
    for name, fields, _ in _LISTS:
        lists &= _valid_list(value, name, fields)
    return _text_or_missing(value, "description") & (is_class | lists)


def _with_defaults(data: Column, is_class: Column) -> Column:
    def items(name: str, fields: tuple[str, ...], item: str) -> Column:
        filled = F.transform(
            data[name],
            lambda it: F.struct(*[F.coalesce(it[f], F.lit("")).alias(f) for f in fields]),
        )
        return F.when(is_class | data[name].isNull(), empty_items(item)).otherwise(filled).alias(name)

    return F.struct(
        F.coalesce(data["description"], F.lit("")).alias("description"),
        *[items(*one) for one in _LISTS],
    )


def parse_arguments(arguments: Column, definition_type: Column) -> Column:
    """Reply struct with defaults, NULL if the arguments are not valid.

    Missing fields become ``""`` or ``[]``, unknown fields are ignored, and a field of
    another JSON type (``null`` included) makes the whole reply invalid. A class keeps
    its description only.
    """
    is_class = definition_type == CLASS

    def build(value: Column) -> Column:
        # Most replies are plain; the others are checked field by field.
        plain = _type_of(value).rlike(_PLAIN) & ~F.contains(arguments, F.lit("null"))
        valid = F.when(plain, F.lit(True)).otherwise(_valid(value, is_class))
        data = let(
            F.try_variant_get(value, "$", DOC_DATA), lambda data: _with_defaults(data, is_class)
        )
        return F.when(value.isNotNull() & valid, data)

    return let(strict_json_object(arguments), build)


def read_reply(reply: Column, call_name: Column) -> Column:
    """``STRUCT<status, arguments>`` of a whole chat reply."""

    def build(value: Column) -> Column:
        call = F.try_variant_get(value, _CALL, "variant")
        name = F.try_variant_get(value, f"{_CALL}.name", "string")
        arguments = F.try_variant_get(value, f"{_CALL}.arguments", "variant")
        status = (
            F.when(call.isNull(), NO_FUNCTION_CALL)
            .when(name == SKIP_CALL_NAME, SKIPPED)
            .when(F.coalesce(name != call_name, F.lit(True)), UNEXPECTED_FUNCTION)
            .when(F.coalesce(_type_of(arguments) != "STRING", F.lit(True)), INVALID_ARGUMENTS)
            .otherwise(OK)
        )
        text = F.try_variant_get(value, f"{_CALL}.arguments", "string")
        return F.struct(status.alias("status"), F.when(status == OK, text).alias("arguments"))

    return let(F.try_parse_json(reply), build)
