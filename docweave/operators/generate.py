"""The generator stage: the user's callable, run once per distinct request."""

from __future__ import annotations

import dataclasses
import functools
import gc
import inspect
import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.prompt import prompt_messages
from ..functions.text import token_count as estimated_tokens
from ..functions.replies import (
    GENERATION_ERROR,
    INVALID_ARGUMENTS,
    OK,
    RATE_LIMITED,
    TOO_MANY_TOKENS,
    parse_arguments,
    read_reply,
)
from ..schema import (
    CLASS,
    DEFAULT_MODEL,
    DOC_DATA,
    FUNCTION,
    FUNCTION_CALL_NAMES,
    LANGUAGES,
    TOO_MANY_TOKENS_CODE,
    ClassDoc,
    FunctionDoc,
    ParameterDoc,
    ReturnDoc,
    function_declaration,
)
from .answers import checked_answer
from .lookups import validate_types
from .throttle import RATE_LIMIT_CODE, Pace, RateLimit, paced

Generator = Callable[..., Any]

_CHECKED_DDL = f"cache_key STRING, data {DOC_DATA}, status STRING, error STRING"
#: Rows of one batch of answers.
ANSWERS = 1024


class TooManyTokens(Exception):
    """Raise this from a generator when a definition does not fit its model."""

    code = TOO_MANY_TOKENS_CODE


def _record(value: Any) -> dict:
    """A record within a record, for the JSON encoder."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {field.name: getattr(value, field.name) for field in dataclasses.fields(value)}
    raise TypeError(f"Object of type {type(value).__name__} is not JSON serializable")


_JSON = json.JSONEncoder(ensure_ascii=False, default=_record)


def _as_json(data: Any) -> str:
    if dataclasses.is_dataclass(data):
        return _JSON.encode(data) if not isinstance(data, type) else json.dumps(dataclasses.asdict(data))
    if hasattr(data, "model_dump"):
        data = data.model_dump()
    elif hasattr(data, "dict") and not isinstance(data, Mapping):
        data = data.dict()
    if not isinstance(data, Mapping):
        raise TypeError(f"generator returned {type(data).__name__}")
    return json.dumps(dict(data), ensure_ascii=False)


def _takes(func: Callable, name: str) -> bool:
    """Whether a callable can be given an argument of this name."""
    try:
        known = inspect.signature(func).parameters.values()
    except (TypeError, ValueError):
        return False
    return any(p.name == name or p.kind is p.VAR_KEYWORD for p in known)


def call_generator(func: Generator, request: dict) -> dict:
    """One guarded call. Text is taken for a whole chat reply, anything else for its data."""
    answer = {
        "cache_key": request["cache_key"],
        "definition_type": request["definition_type"],
        "raw": None,
        "is_reply": False,
        "status": OK,
        "error": None,
    }
    try:
        result = func(
            language=request["language"],
            definition=request["definition"],
            definition_type=request["definition_type"],
            temperature=request["temperature"],
            **({"model": request["model"]} if request.get("model") and _takes(func, "model") else {}),
        )
        answer["is_reply"] = isinstance(result, str)
        answer["raw"] = result if isinstance(result, str) else _as_json(result)
        if not isinstance(result, (str, Mapping)):  # a record's own type decides what it holds
            answer["definition_type"] = FUNCTION if hasattr(result, "parameters") else CLASS
    except Exception as exc:  # one failing definition must not fail the others
        known = {TOO_MANY_TOKENS_CODE: TOO_MANY_TOKENS, RATE_LIMIT_CODE: RATE_LIMITED}
        answer["status"] = known.get(getattr(exc, "code", None), GENERATION_ERROR)
        answer["error"] = f"{type(exc).__name__}: {exc}"
        answer["retry_after"] = float(getattr(exc, "retry_after", 0) or 0)
    return answer


def _refused(answer: dict) -> float | None:
    return answer["retry_after"] if answer["status"] == RATE_LIMITED else None


def generate(
    requests: DataFrame,
    func: Generator,
    max_workers: int | None,
    limit: RateLimit | None = None,
    token_count: Callable[[Column], Column] = estimated_tokens,
) -> DataFrame:
    """``(cache_key, data, status, error)`` of every request.

    ``max_workers`` partitions, so at most that many calls at the same time; fewer if ``limit`` allows
    fewer calls in a minute. They are dealt by an expression that no other exchange has: by
    the key itself, Spark would keep only the exchange of the step before and merge its small
    partitions. Write the result down before using it twice: each evaluation calls the
    generator again. With a limit, calls keep to it and refused ones are tried again. Without
    ``max_workers`` (and limit), requests are called in the partitions that the caller has put them into.
    """
    tasks = max_workers if limit is None else max(1, min(max_workers, int(limit.calls_per_minute)))

    schema = to_arrow_schema(StructType.fromDDL(_CHECKED_DDL))

    def checked(answers: Iterable[dict]) -> Iterator[pa.RecordBatch]:
        rows = ({"cache_key": answer["cache_key"], **checked_answer(answer)} for answer in answers)
        while chunk := list(islice(rows, ANSWERS)):
            yield pa.RecordBatch.from_pylist(chunk, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()  # what the worker has loaded need not be searched for cycles again
        rows = (request for batch in batches for request in batch.to_pylist())
        if limit is None:
            yield from checked(call_generator(func, request) for request in rows)
        else:
            yield from checked(paced(rows, lambda r: call_generator(func, r), _refused, limit, Pace(limit, tasks)))

    wanted = ["cache_key", "language", "definition", "definition_type", "temperature"]
    refused = None
    if "model" in requests.columns:
        # Larger than every model's limit: an answer without a call.
        refused = requests.where("model IS NULL").select(
            "cache_key",
            F.lit(None).cast(DOC_DATA).alias("data"),
            F.lit(TOO_MANY_TOKENS).alias("status"),
            F.lit("no model takes a text of this length").alias("error"),
        )
        requests = requests.where("model IS NOT NULL")
        wanted.append("model")
    if limit is not None and limit.tokens_per_minute:
        requests = requests.withColumn("tokens", token_count(F.col("definition")))
        wanted.append("tokens")
    dealt = requests.select(*wanted)
    if tasks is not None:
        dealt = dealt.repartition(tasks, F.xxhash64("cache_key", F.lit("call")))
    answers = dealt.mapInArrow(run, _CHECKED_DDL)
    return answers if refused is None else answers.unionByName(refused)


@functools.cache
def _answer_columns() -> tuple[Column, Column, Column]:
    """Reply, data and status; built once, they are the costly part of planning."""
    reply = F.when(F.col("is_reply"), read_reply(F.col("raw"), F.col("call_name")))
    arguments = F.when(F.col("is_reply"), F.col("reply.arguments")).otherwise(F.col("raw"))
    data = parse_arguments(arguments, F.col("definition_type"))
    status = (
        F.when(F.col("status") != OK, F.col("status"))
        .when(F.col("type_status") != OK, F.col("type_status"))
        .when(F.col("is_reply") & (F.col("reply.status") != OK), F.col("reply.status"))
        .when(F.col("data").isNull(), INVALID_ARGUMENTS)
        .otherwise(OK)
    )
    return reply, data, status


def check_answers(raw: DataFrame) -> DataFrame:
    """As ``checked_answer``, for a table of answers: validate replies and arguments; only a fully valid answer gets the status ``ok``."""
    reply, data, status = _answer_columns()
    read = validate_types(raw).withColumn("reply", reply).withColumn("data", data)
    return read.withColumn("status", status).select(
        "cache_key",
        F.when(F.col("status") == OK, F.col("data")).alias("data"),
        "status",
        F.when(F.col("status") != OK, F.coalesce("error", "raw")).alias("error"),
    )


def chat_generator(complete: Callable[..., str], model: str = DEFAULT_MODEL) -> Generator:
    """A generator over a chat model.

    ``complete(model, messages, temperature, function_name)`` returns the reply's JSON text;
    Spark checks it. If it has a parameter ``function``, it also gets the declaration of that
    function: name and parameter schema. A job with ``models`` chooses the model for each request;
    otherwise it is the one given here. Raise ``TooManyTokens`` (or an error with the same
    ``code``) if the model refuses a request for its length.
    """
    languages = {name: shown for name, shown, _ in LANGUAGES}
    names = dict(FUNCTION_CALL_NAMES)
    declared = {name: function_declaration(name) for name in names} if _takes(complete, "function") else None
    usual = model

    def generator(
        language: str, definition: str, definition_type: str, temperature: float, model: str = usual
    ) -> str:
        return complete(
            model=model,
            messages=prompt_messages(languages[language], definition_type, definition),
            temperature=temperature,
            function_name=names[definition_type],
            **({"function": declared[definition_type]} if declared else {}),
        )

    return generator


def first_word(text: str) -> str:
    found = re.search(r"\w+", text, re.ASCII)
    return found.group(0) if found else ""


def offline_generator(
    language: str, definition: str, definition_type: str, temperature: float
) -> FunctionDoc | ClassDoc:
    """A stand-in for a model: it describes what can be seen in the text."""
    count = len(definition.split("\n"))
    name = re.search(r"(?:def|class)\s+(\w+)", definition, re.ASCII)
    word = name.group(1) if name else first_word(definition)
    description = f"This {definition_type} is {word} with {count} lines."
    if definition_type == "class":
        return ClassDoc(description)
    header = re.search(r"def\s+\w+\(([^)]*)\)", definition, re.ASCII)
    names = re.findall(r"\w+", header.group(1), re.ASCII) if header else []
    returns = [ReturnDoc("", "The result.", "")] if "return " in definition else []
    return FunctionDoc(description, [ParameterDoc(n, f"The {n}.", "") for n in names], returns)
