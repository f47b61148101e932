"""Every operator as a query over the test tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DocumentationConfig
from ..functions.models import over_budget, route_model
from ..functions.prompt import build_messages
from ..functions.render import (
    DocstringStyle,
    EarlyStyle,
    GoogleStyle,
    NumpyStyle,
    docstring_indent,
    quote_docstring,
)
from ..functions.replies import EMPTY_DESCRIPTION, OK, TOO_MANY_TOKENS, parse_arguments, read_reply
from ..functions.text import (
    capitalize_first,
    indent_lines,
    output_path,
    postprocess,
    remove_stock_prefix,
    strip_blank_lines,
    tidy_description,
    token_count,
)
from ..operators.cache import AnswerCache, compact_cache
from ..operators.checks import failed_outputs
from ..operators.extract import (
    explode_definitions,
    parse_modules,
    register_table_function,
    undocumented,
)
from ..operators.generate import TooManyTokens, first_word, generate, offline_generator
from ..operators.lookups import lookup_language, validate_types
from ..operators.references import reachable, references
from ..operators.requests import (
    cache_misses,
    distinct_requests,
    hot_keys,
    join_by_key,
    with_request,
)
from ..operators.splice import edit_of, rewritten_code
from ..operators.sql import register_definitions_table, register_generator
from ..operators.throttle import RateLimit, RateLimited
from ..schema import DOC_DATA, FUNCTION_CALL_NAMES, ClassDoc, function_declaration
from ..sources.code_files import decode_sources, read_sources, register_source, write_sources
from ..sources.files import make_folder
from ..sources.globs import require_paths, set_difference, source_paths
from ..streaming.versions import newest_versions, use_rocksdb
from ..workspace import new_run_folder
from .corpus import corpus, linked_corpus, text_corpus
from .document import Run, document_files, document_sources

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _config(**options) -> DocumentationConfig:
    return DocumentationConfig(generate_docstring_func=offline_generator, **options)


def _slices(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _module_paths(spark: SparkSession, sf_dir: str, extra: list[Column]) -> DataFrame:
    number = F.floor(F.col("p_partkey") / 8).cast("bigint").cast("string")
    path = F.concat(F.lit("src/m"), F.lpad(number, 12, "0"), F.lit(".py"))
    return _read(spark, sf_dir, "part").select(path.alias("path"), *extra)


def _size_50_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _module_paths(spark, sf_dir, [F.col("p_size")]).where("p_size = 50").select("path")


def _with_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus; modules that hold a part of size 50 end in a syntax error."""
    broken = _size_50_paths(spark, sf_dir).distinct().withColumn("broken", F.lit(True))
    code = F.when(F.col("broken"), F.concat("code", F.lit("def (\n"))).otherwise(F.col("code"))
    return corpus(spark, sf_dir).join(broken, "path", "left").select("path", code.alias("code"))


def _definitions(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    return explode_definitions(parse_modules(corpus(spark, sf_dir)), text)


# Sources and file sets


def file_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    included = _module_paths(spark, sf_dir, [])
    return set_difference(included, _size_50_paths(spark, sf_dir)).orderBy("path")


def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(
        "path",
        F.size(F.split("code", "\n", -1)).cast("bigint").alias("n_lines"),
        F.length("code").cast("bigint").alias("n_chars"),
    )


def _publish_corpus(spark: SparkSession, sf_dir: str, folders: bool = False) -> str:
    """Write the corpus as real files below a new folder, size-50 modules as ``skip_*.py``; with
    ``folders``, in ten folders by the last digit of their number."""
    _, folder = new_run_folder(spark)
    make_folder(folder)
    for digit in range(10 if folders else 0):
        make_folder(f"{folder}/d{digit}")
    skipped = _size_50_paths(spark, sf_dir).distinct().withColumn("skipped", F.lit(True))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    shown = F.when(F.col("skipped"), F.concat(F.lit("skip_"), name)).otherwise(
        F.concat(F.lit("__"), name)
    )
    files = corpus(spark, sf_dir).join(skipped, "path", "left")
    below = F.concat(F.lit("d"), F.substring("path", -4, 1), F.lit("/")) if folders else F.lit("")
    target = F.concat(F.lit(f"{folder}/"), below, shown)
    done = write_sources(files.withColumn("written_path", target))
    failed = done.where("error IS NOT NULL").count()
    if failed:
        raise RuntimeError(f"{failed} corpus files could not be written")
    return folder


def scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _publish_corpus(spark, sf_dir)
    paths = require_paths(source_paths(spark, [f"{folder}/*.py"], [f"{folder}/skip_*"]))
    files = decode_sources(read_sources(paths))
    return files.select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"),
        F.length("code").cast("bigint").alias("n_chars"),
        F.md5("code").alias("digest"),
    )


def document_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _publish_corpus(spark, sf_dir)
    config = _config(include_rules=[f"{folder}/*.py"], exclude_rules=[f"{folder}/skip_*"])
    written = document_sources(spark, config).table("published").where("error IS NULL")
    files = decode_sources(read_sources(written.select(F.col("written_path").alias("path"))))
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "code")


# Extraction


def extract_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _definitions(spark, sf_dir, text=True).select(
        "path", "name", "kind", "is_async", "depth", "line", "end_line", "has_docstring",
        "single_line", "definition",
    )


def has_docstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _definitions(spark, sf_dir).select("path", "name", "has_docstring")


def undocumented_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return undocumented(_definitions(spark, sf_dir), skip_init=False).select("path", "name")


def undocumented_skip_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return undocumented(_definitions(spark, sf_dir)).select("path", "name")


def definitions_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _definitions(spark, sf_dir).groupBy("definition_type").agg(F.count("*").alias("n"))


def single_line_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _definitions(spark, sf_dir).where("single_line").select("path", "name", "line")


def definition_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _definitions(spark, sf_dir).select("path", "name", "depth", "level")


def validate_definition_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("lang") == "en", "function").when(F.col("lang") == "fr", "class")
    ).otherwise(F.col("lang"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", kind.alias("definition_type"))
    return validate_types(rows).select("doc_id", "definition_type", "call_name", "type_status")


def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.when(F.col("role") == "user", "python").otherwise(F.col("role"))
    rows = _read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", language.alias("language")
    )
    return lookup_language(rows).select(
        "conv_id", "turn", "language", "stylized_name", "language_status"
    )


# Text


def strip_blank_lines_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.concat(F.lit("\n \t\n  "), F.replace("text", F.lit("\n"), F.lit("\n \n\n")), F.lit("\n\n"))
    return _read(spark, sf_dir, "documents").select(
        "doc_id", strip_blank_lines(spaced).alias("definition")
    )


def _prefixed(text: Column, by: Column, values: list[str]) -> Column:
    first, second, third = values
    return (
        F.when(by == first, F.concat(F.lit("This function "), text))
        .when(by == second, F.concat(F.lit("This method "), text))
        .when(by == third, F.concat(F.lit("This class "), text))
        .otherwise(text)
    )


def remove_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = _prefixed(F.col("text"), F.col("lang"), ["en", "fr", "es"])
    return _read(spark, sf_dir, "documents").select(
        "doc_id", remove_stock_prefix(described).alias("description")
    )


def capitalize_first_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" \t"), F.lower("text"), F.lit("\n"))
    return _read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", capitalize_first(padded).alias("description")
    )


def reject_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = F.when(F.col("role") == "user", F.lit("This method \n ")).otherwise(F.col("text"))
    status = F.when(tidy_description(described) == "", EMPTY_DESCRIPTION).otherwise(OK)
    return _read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", status.alias("status")
    )


def postprocess_docstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = _prefixed(F.col("text"), F.col("lang"), ["de", "en", "es"])
    data = F.named_struct(
        F.lit("description"), described,
        F.lit("parameters"), F.array(F.named_struct(
            F.lit("name"), F.col("lang"), F.lit("description"), F.col("source"),
            F.lit("assumed_type"), F.lit("str"),
        )),
        F.lit("return_values"), F.array(),
        F.lit("exceptions"), F.array(),
    ).cast(DOC_DATA)
    done = _read(spark, sf_dir, "documents").select("doc_id", postprocess(data).alias("data"))
    return done.select(
        "doc_id", "data.description", F.col("data.parameters")[0]["name"].alias("parameter")
    )


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _module_paths(spark, sf_dir, []).distinct().select(
        "path",
        output_path(F.col("path")).alias("written_path"),
        output_path(F.col("path"), inplace=True).alias("inplace_path"),
    )


def token_count_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(
        "doc_id", token_count(F.col("text")).cast("bigint").alias("tokens")
    )


# Requests, cache, generator, replies


def build_prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "function").otherwise("class")
    messages = build_messages(F.lit("Python"), kind, F.col("text"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", messages.alias("messages"))
    return rows.select(
        "doc_id",
        F.size("messages").alias("n_messages"),
        F.col("messages")[0]["role"].alias("first_role"),
        F.col("messages")[0]["content"].alias("system_text"),
        F.col("messages")[1]["role"].alias("second_role"),
        F.col("messages")[1]["content"].alias("user_text"),
    )


def _document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "function").otherwise("class")
    rows = _read(spark, sf_dir, "documents").select(
        "doc_id", strip_blank_lines(F.col("text")).alias("definition"), kind.alias("definition_type")
    )
    return with_request(rows, "python", 0.25)


def _stored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, cleaned and hashed once."""
    _, folder = new_run_folder(spark)
    rows = _document_requests(spark, sf_dir)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def generate_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = distinct_requests(_stored_requests(spark, sf_dir), "doc_id")
    answers = generate(requests, offline_generator, _slices(spark))
    return answers.select(
        "cache_key", "status", F.col("data.description").alias("description")
    )


def _labelled_cache(rows: DataFrame, sf_dir: str) -> DataFrame:
    """A cache that already holds the definitions of all labelled documents."""
    labels = _read(rows.sparkSession, sf_dir, "labels").select("doc_id", "quality")
    labelled = rows.select("doc_id", "cache_key").join(labels, "doc_id")
    return labelled.groupBy("cache_key").agg(F.max("quality").alias("quality"))


def cache_misses_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored_requests(spark, sf_dir)
    return cache_misses(distinct_requests(rows, "doc_id"), _labelled_cache(rows, sf_dir)).select(
        "cache_key", "definition_type", "uses"
    )


def cache_hit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, folder = new_run_folder(spark)
    keyed = _document_requests(spark, sf_dir).select("doc_id", "cache_key")
    keyed.write.parquet(folder)  # keys are dear, and used four times
    rows = spark.read.schema(keyed.schema).parquet(folder)
    labels = _read(spark, sf_dir, "labels").select("doc_id", "quality")
    cache = rows.join(labels, "doc_id").groupBy("cache_key").agg(F.max("quality").alias("quality"))
    uses = rows.groupBy("cache_key").agg(F.count("*").alias("uses"))
    hot = hot_keys(uses, rows.count(), _slices(spark))
    joined = join_by_key(rows, cache, hot, F.col("doc_id"))
    return joined.select("doc_id", "cache_key", "quality", F.col("quality").isNotNull().alias("hit"))


def _event_arguments() -> Column:
    """Arguments of many shapes, chosen by the event's type and value."""
    kind, n = F.col("event_type"), F.get_json_object("props", "$.k")
    high = F.col("value") >= 10
    good = F.format_string(
        '{"description": "Counts %s.", "parameters": [{"name": "k"}, '
        '{"description": "d", "assumed_type": "int"}], "extra": 1}',
        n,
    )
    return (
        F.when((kind == "view") & high, good)
        .when(kind == "view", F.lit("{}"))
        .when((kind == "click") & high, F.concat(good, F.lit(" trailing")))
        .when(kind == "click", F.concat(good, F.lit("] x")))
        .when((kind == "error") & high, F.format_string('{"description": %s}', n))
        .when(kind == "error", F.lit('{"description": null}'))
        .when((kind == "purchase") & high, F.lit('{"parameters": {"name": "k"}}'))
        .when(kind == "purchase", F.lit('{"exceptions": [{"name": 5}]}'))
        .when(high, F.concat(F.lit("["), good, F.lit("]")))
        .otherwise(F.lit('{"description": '))
    )


def parse_reply_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = parse_arguments(_event_arguments(), F.lit("function"))
    rows = _read(spark, sf_dir, "events").select("event_id", data.alias("data"))
    return rows.select(
        "event_id",
        F.col("data").isNotNull().alias("valid"),
        F.col("data.description").alias("description"),
        F.when(F.col("data").isNotNull(), F.size("data.parameters")).alias("n_parameters"),
        F.get("data.parameters", F.lit(0))["name"].alias("first_name"),
        F.get("data.parameters", F.lit(1))["name"].alias("second_name"),
        F.get("data.parameters", F.lit(1))["assumed_type"].alias("second_type"),
    )


def reply_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, high = F.col("event_type"), F.col("value") >= 10
    name = (
        F.when(kind == "click", "respond_with_something_else")
        .when(kind == "signup", "skip_function")
        .otherwise("respond_with_structured_docstring_data_for_function")
    )
    reply = (
        F.when(kind == "error", F.lit('{"choices": [{"message": {"role": "assistant", "content": "no"}}]}'))
        .when((kind == "purchase") & high, F.lit("not json"))
        .when(kind == "purchase", F.format_string(
            '{"choices": [{"message": {"function_call": {"name": "%s", "arguments": {}}}}]}', name))
        .otherwise(F.format_string(
            '{"choices": [{"message": {"function_call": {"name": "%s", "arguments": "%s"}}}]}',
            name, F.replace("props", F.lit('"'), F.lit('\\"'))))
    )
    read = read_reply(reply, F.lit("respond_with_structured_docstring_data_for_function"))
    rows = _read(spark, sf_dir, "events").select("event_id", read.alias("read"))
    return rows.select("event_id", "read.status", "read.arguments")


def over_budget_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_count(F.col("text"))
    status = F.when(over_budget(tokens), TOO_MANY_TOKENS).otherwise(OK)
    return _read(spark, sf_dir, "documents").select(
        "doc_id", tokens.cast("bigint").alias("tokens"), status.alias("status")
    )


def route_model_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(
        "doc_id", route_model(token_count(F.col("text"))).alias("model")
    )


def failing_generator(language: str, definition: str, definition_type: str, temperature: float):
    """Fails for long texts and for those that start with a capital A or E."""
    if len(definition) > 4096:
        raise TooManyTokens(f"{len(definition)} characters")
    if first_word(definition)[:1] in ("A", "E"):
        raise ValueError(f"cannot describe {first_word(definition)}")
    return offline_generator(language, definition, definition_type, temperature)


def generation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = distinct_requests(_stored_requests(spark, sf_dir), "doc_id")
    answers = generate(requests, failing_generator, _slices(spark))
    return answers.where(F.col("status") != OK).select("cache_key", "status", "error")


# Rendering


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply struct for every order line: as many parameters as its line number."""

    def item(i: Column) -> Column:
        return F.named_struct(
            F.lit("name"), F.when(i == F.lit(3), "").otherwise(F.concat(F.lit("p"), i.cast("string"))),
            F.lit("description"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(".")),
            F.lit("assumed_type"), F.when(i == F.lit(2), "").otherwise("int"),
        )

    number = F.col("l_linenumber")
    first = item(number)
    none = F.array()
    data = F.named_struct(
        F.lit("description"), F.concat(F.lit("Line of order "), F.col("l_orderkey").cast("string"), F.lit(".")),
        F.lit("parameters"), F.transform(F.sequence(F.lit(1), number), item),
        F.lit("return_values"), F.when(F.col("l_linestatus") == "O", F.array(first)).otherwise(none),
        F.lit("exceptions"), F.when(
            F.col("l_returnflag") == "R",
            F.array(F.named_struct(F.lit("name"), first["name"], F.lit("description"), first["description"])),
        ).otherwise(none),
    ).cast(DOC_DATA)
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", data.alias("data"))


def _rendered(style: DocstringStyle) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _line_items(spark, sf_dir).select(
            "l_orderkey",
            "l_linenumber",
            style.render(F.col("data"), F.lit("  ")).alias("docstring"),
        )

    return query


def render_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_items(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        EarlyStyle("google_v0").render(F.col("data"), F.lit("  ")).alias("google"),
        EarlyStyle("numpy_v0").render(F.col("data"), F.lit("  ")).alias("numpy"),
    )


def indent_docstring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    suite = F.col("l_linestatus") == "F"
    indent = docstring_indent(suite, F.lit("  "), number - 1, number)
    text = GoogleStyle().render(F.col("data"), F.lit("  "))
    rendered = _line_items(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", text.alias("text"), indent.alias("indent")
    )
    return rendered.select(
        "l_orderkey", "l_linenumber", indent_lines(F.col("text"), F.col("indent")).alias("docstring")
    )


def quote_docstring_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('\\d "'), F.col("text"), F.lit('"""'))
    return _read(spark, sf_dir, "documents").select(
        "doc_id",
        quote_docstring(text, '"""').alias("triple"),
        quote_docstring(text, "'").alias("single"),
    )


# Splicing and whole jobs


def _spliced(suite: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        wanted = F.filter("defs", lambda d: (d["suite"] == F.lit(suite)) & (d["level"] >= 0))
        edits = F.transform(
            wanted, lambda d: edit_of(d, F.concat(F.lit('"""Doc of '), d["name"], F.lit('."""')))
        )
        parsed = parse_modules(corpus(spark, sf_dir)).withColumn("edits", edits)
        code = rewritten_code(F.col("code"), F.col("spans"), F.col("edits"))
        return parsed.select("path", code.alias("code"))

    return query


def _run(spark: SparkSession, sf_dir: str) -> Run:
    return document_files(corpus(spark, sf_dir), _config())


def rewrite_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).outputs()


def rewrite_sources_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir, "orders", "o_orderkey")
    return document_files(files, _config()).outputs()


def rendered_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which definitions lack a docstring, and what would it say?"""
    return _run(spark, sf_dir).docstrings().select("path", F.col("d.name").alias("name"), "docstring")


def failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = document_files(_with_broken(spark, sf_dir), _config()).errors()
    return errors.select("path", "stage")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(_with_broken(spark, sf_dir), _config()).summary()


def result_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(_with_broken(spark, sf_dir), _config()).mapping()


def empty_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outputs against a listing without the size-50 modules."""
    outputs = corpus(spark, sf_dir).withColumn("written_path", output_path(F.col("path")))
    written = outputs.select(F.col("written_path").alias("path"))
    missing = _size_50_paths(spark, sf_dir).select(output_path(F.col("path")).alias("path"))
    return failed_outputs(outputs, set_difference(written, missing))


def duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus; size-50 modules come twice, and every fifth module in two versions."""
    files = corpus(spark, sf_dir)
    again = files.join(_size_50_paths(spark, sf_dir).distinct(), "path", "left_semi")
    changed = files.where(F.substring("path", 6, 12).cast("bigint") % 5 == 0).select(
        "path", F.concat("code", F.lit("# changed\n")).alias("code")
    )
    run = document_files(files.unionByName(again).unionByName(changed), _config())
    done = run.outputs().select("path", F.lit("ok").alias("stage"), "code")
    return done.unionByName(run.errors().select("path", "stage", F.lit(None).cast("string").alias("code")))


def write_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as files; where size-50 modules would be written there are folders already."""
    folder = _publish_corpus(spark, sf_dir)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    blocked = F.concat(F.lit(f"{folder}/modified_skip_"), name)

    def block(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                make_folder(path)
            yield batch

    paths = _size_50_paths(spark, sf_dir).distinct().select(blocked.alias("path"))
    paths.mapInArrow(block, "path STRING").write.format("noop").mode("overwrite").save()
    include = [f"{folder}/__*.py", f"{folder}/skip_*.py"]
    run = document_sources(spark, _config(include_rules=include))
    file = F.regexp_extract("path", "([^/]+)$", 1).alias("file")
    one = F.lit(1).cast("bigint").alias("n")
    files = run.summary().where("stage = 'file'")
    return (
        run.mapping().select(F.lit("mapping").alias("kind"), file, F.lit("ok").alias("status"), one)
        .unionByName(run.errors().select(F.lit("error").alias("kind"), file, F.col("stage").alias("status"), one))
        .unionByName(files.select(F.lit("summary").alias("kind"), F.lit("").alias("file"), "status", "n"))
    )


def inplace_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus documented in place. Before the results are written, somebody changes the size-50
    modules: those stay as they are by then."""
    folder = _publish_corpus(spark, sf_dir)
    config = _config(include_rules=[f"{folder}/*.py"], inplace=True)
    run = document_sources(spark, config, publish=False)
    changed = read_sources(source_paths(spark, [f"{folder}/skip_*.py"], []))
    edited = F.concat(F.col("content").cast("string"), F.lit("# changed\n")).alias("code")
    edits = write_sources(changed.select("path", F.col("path").alias("written_path"), edited))
    edits.write.format("noop").mode("overwrite").save()
    run.publish()
    file = F.regexp_extract("path", "([^/]+)$", 1).alias("file")
    one = F.lit(1).cast("bigint").alias("n")
    now = decode_sources(read_sources(run.table("paths")))
    return (
        run.mapping().select(F.lit("mapping").alias("kind"), file, F.lit("ok").alias("status"), one)
        .unionByName(run.errors().select(F.lit("error").alias("kind"), file, F.col("stage").alias("status"), one))
        .unionByName(run.summary().where("stage = 'file'").select(F.lit("summary").alias("kind"), F.lit("").alias("file"), "status", "n"))
        .unionByName(now.select(F.lit("code").alias("kind"), file, F.md5("code").alias("status"), one))
    )


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of their user's file, arriving out of order in three batches of a stream that is
    started anew for each: which were news, which came too late?"""
    _, folder = new_run_folder(spark)
    # Microseconds since 1970 by the interval, which no time zone changes.
    since = F.expr("cast(ts AS timestamp_ntz) - TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    minutes = (F.extract(F.lit("DAY"), since) * 24 + F.extract(F.lit("HOUR"), since)) * 60 + F.extract(F.lit("MINUTE"), since)
    seconds = (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("bigint")
    version = (minutes.cast("bigint") * 60_000_000 + seconds) * 1000 + F.col("event_id") % 1000
    rows = _read(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("path"),
        F.col("event_id").cast("string").alias("code"),
        version.alias("written"),
        F.col("event_id"),
    )
    schema = rows.drop("event_id").schema
    use_rocksdb(spark)
    for batch in range(3):
        arrived = rows.where(F.col("event_id") % 3 == batch).drop("event_id")
        arrived.write.mode("append").parquet(f"{folder}/arrived")
        news = newest_versions(spark.readStream.schema(schema).parquet(f"{folder}/arrived"), "written")
        query = (
            news.writeStream.format("parquet")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start(f"{folder}/judged")
        )
        query.awaitTermination()
    judged = spark.read.schema(news.schema).parquet(f"{folder}/judged")
    return judged.select("path", "version", "status", F.col("code").alias("news"))


def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of one folder of many, by a filter on the path: the other folders are not listed."""
    folder = _publish_corpus(spark, sf_dir, folders=True)
    register_source(spark)
    files = spark.read.format("code_files").load(f"{folder}/*/*.py")
    name = F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file")
    return files.where(F.col("path").startswith(f"{folder}/d3/")).select(
        name, F.octet_length("content").cast("bigint").alias("n_bytes")
    )


#: Texts that this worker was asked for before.
_ASKED: set[str] = set()


def refusing_generator(language: str, definition: str, definition_type: str, temperature: float):
    """Refuses the first call for every third text by its length, and all calls for texts from A to E."""
    word = first_word(definition)
    if "A" <= word[:1] <= "E":
        raise RateLimited("come back later")
    if len(definition) % 3 == 0 and definition not in _ASKED:
        _ASKED.add(definition)
        raise RateLimited("slow down", retry_after=0.001)
    return ClassDoc(f"was asked about {word}.")


def throttled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as definitions for a service that refuses calls: tried again within the rate, or given up."""
    rows = _stored_requests(spark, sf_dir)
    limit = RateLimit(
        calls_per_minute=60_000_000, tokens_per_minute=60_000_000_000, attempts=3, first_delay=0.001, longest_delay=0.01
    )
    answers = generate(distinct_requests(rows, "doc_id"), refusing_generator, _slices(spark), limit)
    return answers.select("cache_key", "status", F.col("data.description").alias("description"), "error")


def cached_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one cache: the same code, and no call in the second."""
    _, cache = new_run_folder(spark)
    first = document_files(corpus(spark, sf_dir), _config(cache_path=cache))
    second = document_files(corpus(spark, sf_dir), _config(cache_path=cache))
    asked = second.table("requests").join(second.table("hits"), ["cache_key", "level"], "left_anti")
    calls = asked.agg(F.count("*").alias("calls"))
    before = first.outputs().select("path", F.col("code").alias("before"))
    same = second.outputs().join(before, "path").select("path", (F.col("code") == F.col("before")).alias("same"))
    return same.join(F.broadcast(calls))


def compacted_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two jobs fill a cache, each for a half of the corpus; the whole corpus is documented from it before
    and after its segments are merged: the same code, and no calls."""
    _, cache = new_run_folder(spark)
    config = _config(cache_path=cache, cache_segments=100, cache_buckets=_slices(spark))
    for half in range(2):
        document_files(corpus(spark, sf_dir).where(F.pmod(F.xxhash64("path"), F.lit(2)) == half), config)
    before = document_files(corpus(spark, sf_dir), config)
    kept = AnswerCache(spark, cache)
    several = len(kept.segments()) > 1
    compact_cache(spark, cache)
    merged = several and len(kept.segments()) == 1
    after = document_files(corpus(spark, sf_dir), config)

    def calls(run: Run) -> Column:
        asked = run.table("requests").join(run.table("hits"), ["cache_key", "level"], "left_anti")
        return F.lit(asked.count()).alias("calls")

    old = before.outputs().select("path", F.col("code").alias("old"))
    return after.outputs().join(old, "path").select(
        "path", (F.col("code") == F.col("old")).alias("same"), (calls(before) + calls(after)).alias("calls"),
        F.lit(merged).alias("merged"),
    )


def function_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is told to call for a document taken as a definition."""
    kind = F.when(F.col("lang") == "en", "function").otherwise("class")
    declared = {name: function_declaration(name) for name, _ in FUNCTION_CALL_NAMES}

    def of(part) -> Column:
        chosen = F.lit(None).cast("string")
        for name, declaration in declared.items():
            chosen = F.when(F.col("definition_type") == name, part(declaration)).otherwise(chosen)
        return chosen

    rows = _read(spark, sf_dir, "documents").select("doc_id", kind.alias("definition_type"))
    return rows.select(
        "doc_id",
        of(lambda d: F.lit(d["name"])).alias("name"),
        of(lambda d: F.lit(json.dumps(d["parameters"], sort_keys=True))).alias("parameters"),
    )


def model_naming_generator(language, definition, definition_type, temperature, model):
    return ClassDoc(f"was made by {model}.")


def routed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests go to the smallest model that takes them; larger ones are never sent."""
    rows = _stored_requests(spark, sf_dir)
    model = route_model(token_count(F.col("definition")), [("small", 200), ("large", 800)])
    requests = distinct_requests(rows.withColumn("model", model), "doc_id")
    answers = generate(requests, model_naming_generator, _slices(spark))
    return answers.select("cache_key", "status", F.col("data.description").alias("description"))


def extract_definitions_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over modules of which some are broken."""
    register_table_function(spark)
    modules = _with_broken(spark, sf_dir)
    return spark.sql(
        "SELECT path, name, kind, line, error IS NOT NULL AS broken "
        "FROM {modules}, LATERAL extract_definitions(code)",
        modules=modules,
    )


def extract_definitions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Arrow table function over a whole table of modules, of which some are broken."""
    register_definitions_table(spark)
    return spark.sql(
        "SELECT path, name, kind, line, error IS NOT NULL AS broken FROM extract_definitions_table(TABLE({modules}))",
        modules=_with_broken(spark, sf_dir),
    )


def generate_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator as a SQL function, over all documents."""
    register_generator(spark, offline_generator)
    return spark.sql(
        "SELECT doc_id, answer.status, answer.data.description FROM (SELECT doc_id, "
        "generate_docstring(language, definition, definition_type, temperature) AS answer FROM {requests})",
        requests=_document_requests(spark, sf_dir),
    )


def referenced_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who refers to whom within three hops, by name."""
    found = references(linked_corpus(spark, sf_dir), roots=["src"])
    names = found.symbols
    callers = names.select(F.col("def_id").alias("caller"), F.col("symbol").alias("caller_name"))
    callees = names.select(F.col("def_id").alias("callee"), F.col("symbol").alias("callee_name"))
    return reachable(found, hops=3).join(callers, "caller").join(callees, "callee").select("caller_name", "callee_name", "hops")


def constant_generator(language, definition, definition_type, temperature):
    return ClassDoc("documents it.")


def extract_definitions_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_definitions(parse_modules(text_corpus(spark, sf_dir)), text=False).select(
        "path", "name", "kind", "depth", "level", "line", "end_line", "has_docstring"
    )


def rewrite_sources_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = DocumentationConfig(generate_docstring_func=constant_generator)
    return document_files(text_corpus(spark, sf_dir), config).outputs().select("path", "code")


QUERIES: dict[str, Query] = {
    "duplicate_paths": duplicate_paths,
    "write_failures": write_failures,
    "inplace_conflicts": inplace_conflicts,
    "throttled_requests": throttled_requests,
    "newest_events": newest_events,
    "pruned_scan": pruned_scan,
    "cached_rerun": cached_rerun,
    "compacted_cache": compacted_cache,
    "function_declarations": function_declarations,
    "routed_requests": routed_requests,
    "extract_definitions_sql": extract_definitions_sql,
    "extract_definitions_text": extract_definitions_text,
    "extract_definitions_table": extract_definitions_table,
    "generate_sql": generate_sql,
    "referenced_definitions": referenced_definitions,
    "rewrite_sources_text": rewrite_sources_text,
    "file_set_difference": file_set_difference,
    "source_stats": source_stats,
    "scan_sources": scan_sources,
    "extract_definitions": extract_definitions,
    "has_docstring": has_docstring,
    "undocumented": undocumented_all,
    "undocumented_skip_init": undocumented_skip_init,
    "definitions_by_type": definitions_by_type,
    "validate_types": validate_definition_types,
    "language_lookup": language_lookup,
    "single_line_defs": single_line_defs,
    "definition_depths": definition_depths,
    "strip_blank_lines": strip_blank_lines_documents,
    "remove_prefix": remove_prefix,
    "capitalize_first": capitalize_first_letter,
    "reject_empty": reject_empty,
    "postprocess_docstring": postprocess_docstring,
    "output_path": output_paths,
    "token_count_estimate": token_count_estimate,
    "build_messages": build_prompt_messages,
    "generate_docstrings": generate_docstrings,
    "cache_misses": cache_misses_documents,
    "cache_hit_join": cache_hit_join,
    "reply_status": reply_status,
    "parse_arguments": parse_reply_arguments,
    "over_budget": over_budget_documents,
    "route_model": route_model_documents,
    "generation_errors": generation_errors,
    "render_google": _rendered(GoogleStyle()),
    "render_numpy": _rendered(NumpyStyle()),
    "render_prototype": render_prototype,
    "indent_docstring": indent_docstring_lines,
    "quote_docstring": quote_docstring_documents,
    "splice_multiline": _spliced(suite=False),
    "splice_one_line": _spliced(suite=True),
    "rendered_docstrings": rendered_docstrings,
    "rewrite_sources": rewrite_sources,
    "rewrite_sources_orders": rewrite_sources_orders,
    "document_published": document_published,
    "failed_files": failed_files,
    "run_summary": run_summary,
    "result_mapping": result_mapping,
    "empty_outputs": empty_outputs,
}
