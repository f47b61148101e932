"""The documentation job: source files in, documented source files out.

Inner definitions are documented before the ones around them, because the outer text
shown to the generator includes the inner docstrings. ``level`` 0 holds every definition
with nothing undocumented inside, level 1 those around them, and so on; within a level
all definitions of all files are independent. A file is parsed once. Each level reads
only files that still have work, and writes only small rows (docstrings), never code.
"""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DocumentationConfig
from ..functions.lets import let
from ..functions.models import route_model
from ..functions.render import DocstringStyle, docstring_indent, quote_docstring
from ..functions.replies import EMPTY_DESCRIPTION, OK
from ..functions.text import (
    indent_lines,
    normalise_code,
    output_path,
    postprocess,
    strip_blank_lines,
)
from ..operators.cache import AnswerCache, Segment
from ..operators.extract import definition_id, parse_modules
from ..operators.generate import generate
from ..operators.requests import (
    cache_misses,
    distinct_keys,
    hot_keys,
    join_by_key,
    with_request,
)
from ..operators.splice import apply_edits, definition_text, edit_of, line_slots, rewritten_code
from ..schema import DOC_DATA
from ..sources.code_files import decode_sources, read_sources, write_sources
from ..sources.globs import require_paths, source_paths
from ..workspace import (
    drop_folder,
    file_sizes,
    list_folder,
    new_run_folder,
    read_small_file,
    shared_folder,
    write_small_file,
)

REQUEST_COLUMNS = ["cache_key", "language", "definition", "definition_type", "temperature", "model"]
MADE_DDL = f"cache_key STRING, data {DOC_DATA}, status STRING, error STRING"
#: Of a run's tables: texts take a half to two thirds of what they take by default.
COMPRESSION = "zstd"
#: Files in a run's folder: its outputs are staged; they are all written.
STAGED, PUBLISHED = "staged.json", "published.json"


@dataclass
class Run:
    """Tables of one finished job; every method reads what the job has written."""

    spark: SparkSession
    config: DocumentationConfig
    run_id: str
    folder: str
    levels: int
    published: bool = False
    cache: AnswerCache | None = None
    #: The cache's segments when the job began; what it makes itself is read from its own tables.
    segments: list[Segment] = field(default_factory=list)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def save(self, name: str, rows: DataFrame) -> DataFrame:
        """Write rows down and go on from there: nothing upstream is computed again.

        Definitions are bucketed by path, with as many in a file as a task is to call for.
        """
        written = rows.write.format("parquet").option("compression", COMPRESSION)
        if name.startswith("definitions/"):
            (
                written.bucketBy(_slices(self.spark), "path")
                .option("maxRecordsPerFile", self.config.calls_per_task)
                .option("path", f"{self.folder}/{name}")
                .saveAsTable(_bucketed_name(self, name))
            )
        else:
            written.save(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def parsed(self) -> DataFrame:
        """Modules with their definitions; ``rounds`` is -1 for files that failed."""
        return self.table("parsed")

    def definitions(self) -> DataFrame:
        """Documented or skipped definitions with the text the generator was given."""
        return self._by_level("definitions")

    def docstrings(self) -> DataFrame:
        """Reply struct, quoted docstring, status and error of each definition."""
        return self._by_level("docstrings")

    def _by_level(self, name: str) -> DataFrame:
        return self.table(name).drop("level")

    def outputs(self) -> DataFrame:
        """``(path, written_path, code)`` of every file that could be processed."""
        return self.table("outputs").drop("digest")

    def errors(self) -> DataFrame:
        """``(path, def_id, stage, error)`` of files and definitions left out.

        Stages are ``read``, ``parse``, ``generate`` and ``write``.
        """
        whole_file = F.lit(None).cast("string").alias("def_id")
        parsing = self.parsed().where("rounds < 0").select("path", whole_file, "stage", "error")
        if self.published:
            unwritten = self.table("published").where("error IS NOT NULL")
            parsing = parsing.unionByName(
                unwritten.select("path", whole_file, F.lit("write").alias("stage"), "error")
            )
        if not self.levels:
            return parsing
        failed = self.docstrings().where(F.col("status") != OK).select(
            "path", "def_id", F.lit("generate").alias("stage"),
            F.coalesce("error", "status").alias("error"),
        )
        return parsing.unionByName(failed)

    def mapping(self) -> DataFrame:
        """Original path to written path; files that failed or were not written are missing."""
        done = self.table("published").where("error IS NULL") if self.published else self.outputs()
        return done.select("path", "written_path")

    def found(self) -> DataFrame:
        """``(n)``: how many files the job was given."""
        return self.parsed().agg(F.count("*").alias("n"))

    def drop(self) -> None:
        """Delete the run's intermediate tables (not the cache, nor what was published)."""
        drop_folder(self.spark, self.folder)

    def summary(self) -> DataFrame:
        """``(stage, status, n)``: files by outcome, definitions by status."""
        file = F.lit("file").alias("stage")
        failed = self.parsed().where("rounds < 0").select(file, F.lit("failed").alias("status"))
        if self.published:
            outcome = F.when(F.col("error").isNull(), OK).otherwise("failed")
            done = self.table("published").select(file, outcome.alias("status"))
        else:
            done = self.parsed().where("rounds >= 0").select(file, F.lit(OK).alias("status"))
        files = failed.unionByName(done)
        if self.levels:
            files = files.unionByName(
                self.docstrings().select(F.lit("definition").alias("stage"), "status")
            )
        return files.groupBy("stage", "status").agg(F.count("*").alias("n"))

    def publish(self, parts_per_wave: int = 512) -> DataFrame:
        """Write the staged outputs to their paths: ``(path, written_path, error)``.

        A wave is some of the staged files; what it has done is committed before the next begins, and
        is not done again when a lost job goes on. In place, a file that is not as it was read
        is left alone and becomes an error, unless it has the new text already.
        """
        staged = f"{self.folder}/outputs"
        parts = sorted(name for name in list_folder(self.spark, staged) if name.startswith("part-"))
        kept = self.spark.read.schema(self.table("outputs").schema)
        for wave, at in enumerate(range(0, len(parts), parts_per_wave)):
            folder = f"{self.folder}/published/wave={wave}"
            if "_SUCCESS" not in list_folder(self.spark, folder):
                rows = kept.parquet(*[f"{staged}/{name}" for name in parts[at : at + parts_per_wave]])
                write_sources(rows).write.mode("overwrite").parquet(folder)
        self.published = True
        write_small_file(self.spark, f"{self.folder}/{PUBLISHED}", "{}", replace=True)
        return self.table("published").drop("wave")


def document_sources(spark: SparkSession, config: DocumentationConfig, publish: bool = True) -> Run:
    """Document every file the rules select and write the results beside (or over) them.

    Without ``publish`` they are only staged; ``Run.publish`` writes them."""
    run = _new_run(spark, config)
    found = source_paths(spark, config.include_rules, config.exclude_rules, config.recursive)
    paths = require_paths(run.save("paths", found))
    # Placed by path before the contents are read, so only the paths are shuffled.
    placed = paths.repartition(_slices(spark), "path")
    files = decode_sources(read_sources(placed, placed=True), digest=config.inplace)
    _document(run, files.withColumnRenamed("error", "read_error"))
    state = {"run_id": run.run_id, "levels": run.levels}
    write_small_file(spark, f"{run.folder}/{STAGED}", json.dumps(state))
    if publish:
        run.publish()
    return run


def unpublished_runs(spark: SparkSession) -> list[str]:
    """Folders of jobs that have staged their outputs, but not written them all."""
    folder = f"{shared_folder(spark)}/docweave"
    found = []
    for name in sorted(list_folder(spark, folder)):
        there = list_folder(spark, f"{folder}/{name}")
        if STAGED in there and PUBLISHED not in there:
            found.append(f"{folder}/{name}")
    return found


def resume_publish(spark: SparkSession, config: DocumentationConfig, folder: str, parts_per_wave: int = 512) -> Run:
    """Go on with a job that was lost while it wrote its files (one of ``unpublished_runs``).

    Nothing is generated or rendered again. Use the config, and ``parts_per_wave``, of the lost job."""
    state = json.loads(read_small_file(spark, f"{folder}/{STAGED}"))
    run = Run(spark, config, state["run_id"], folder, state["levels"])
    run.publish(parts_per_wave)
    return run


def document_files(files: DataFrame, config: DocumentationConfig) -> Run:
    """Document a table ``(path, code)`` of modules.

    Equal rows are one file. A path with different texts, or none at all, becomes an error, and
    none of its texts goes further.
    """
    run = _new_run(files.sparkSession, config)
    files = _one_per_path(run, files.select("path", "code"))
    _document(run, files.repartition(_slices(run.spark), "path"))
    return run


def _one_per_path(run: Run, files: DataFrame) -> DataFrame:
    """``(path, code, read_error)`` with distinct paths.

    Usually paths are counted, none is repeated, and that is all. Copies of a repeated path are
    combined before they are shuffled, so a frequent one does not gather in one task.
    """
    no_error = F.lit(None).cast("string").alias("read_error")
    counts = files.groupBy("path").agg(F.count("*").alias("copies"))
    repeated = run.save("repeated", counts.where("copies > 1 OR path IS NULL"))
    if repeated.isEmpty():
        return files.select("path", "code", no_error)
    listed = repeated.select("path")
    single = files.where("path IS NOT NULL").join(listed, "path", "left_anti")
    versions = (
        files.join(listed, "path", "left_semi")
        .groupBy("path", F.xxhash64("code").alias("version"))
        .agg(F.first("code").alias("code"))
        .groupBy("path")
        .agg(F.first("code").alias("code"), F.count("*").alias("versions"))
    )
    several = F.format_string("%d different files have this path", "versions")
    combined = versions.select(
        "path",
        F.when(F.col("versions") == 1, F.col("code")).alias("code"),
        F.when(F.col("versions") > 1, several).alias("read_error"),
    )
    pathless = repeated.where("path IS NULL").select(
        "path", F.lit(None).cast("string").alias("code"), F.lit("a file without a path").alias("read_error")
    )
    return single.select("path", "code", no_error).unionByName(combined).unionByName(pathless)


def _new_run(spark: SparkSession, config: DocumentationConfig) -> Run:
    run_id, folder = new_run_folder(spark)
    return Run(spark, config, run_id, folder, 0)


def _document(run: Run, files: DataFrame) -> None:
    config = run.config
    if config.cache_path is not None:
        run.cache = AnswerCache(run.spark, config.cache_path, config.cache_buckets, config.cache_segments)
        run.segments = run.cache.segments()
    try:
        _write_parsed(run, files)
        run.levels = max(_bucketed(run).agg(F.max("rounds")).first()[0] or 0, 0)
        for level in range(run.levels):
            _document_level(run, level)
        run.save("outputs", _outputs(run))
    finally:  # the names only; the tables' files stay
        for name in ("parsed", *(f"definitions/level={level}" for level in range(run.levels))):
            run.spark.sql(f"DROP TABLE IF EXISTS {_bucketed_name(run, name)}")
        if run.cache is not None:
            run.cache.close()


def _bucketed_name(run: Run, name: str) -> str:
    return f"spark_catalog.default.docweave_{re.sub(r'\W', '_', name)}_{run.run_id}"


def _bucketed(run: Run, name: str = "parsed") -> DataFrame:
    """Parsed modules, or definitions, as a bucketed table: joins by path leave them where they are."""
    return run.spark.table(_bucketed_name(run, name))


def _slices(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _write_parsed(run: Run, files: DataFrame) -> None:
    """Parse once. Bucketed by path, so code never moves again; split by rounds needed."""
    files = files.withColumn("code", normalise_code(F.col("code")))
    parsed = parse_modules(files, run.config.skip_init_methods)
    parsed = parsed.withColumns({
        "error": F.coalesce("read_error", "error"),
        "stage": F.when(F.col("read_error").isNotNull(), "read").otherwise("parse"),
    }).drop("read_error")
    deepest = F.coalesce(F.array_max(F.transform("defs", lambda d: d["level"])), F.lit(-1)) + 1
    parsed = parsed.withColumn("rounds", F.when(F.col("error").isNull(), deepest).otherwise(-1))
    (
        parsed.write.format("parquet")
        .partitionBy("rounds")
        .bucketBy(_slices(run.spark), "path")
        .option("compression", COMPRESSION)
        .option("path", f"{run.folder}/parsed")
        .saveAsTable(_bucketed_name(run, "parsed"))
    )


def _document_level(run: Run, level: int) -> None:
    config, at = run.config, f"level={level}"
    texts = with_request(_candidates(run, level), config.language, config.temperature)
    if config.models is not None:
        tokens = config.token_count(F.col("definition"))
        texts = texts.withColumn("model", route_model(tokens, config.models))
    total = Observation()
    candidates = run.save(f"definitions/{at}", texts.observe(total, F.count("*").alias("n")))

    distinct = Observation()
    keys = distinct_keys(candidates, "def_id").observe(distinct, F.count("*").alias("n"))
    requests = run.save(f"requests/{at}", keys)
    answers = _answers(run, requests, distinct.get["n"], total.get["n"], level)

    hot = hot_keys(requests, total.get["n"], _slices(run.spark))
    placed = candidates.drop("definition", "language", "temperature", "model")
    answered = join_by_key(placed, answers, hot, F.col("def_id"))
    run.save(f"docstrings/{at}", _docstrings(answered, config))


@functools.cache
def _texts(with_edits: bool) -> Column:
    """Definitions of the level ``at``, each with its source text as it is by then.

    Large columns like this one are built once: planning them costs more than a small job.
    """
    slots: Column = line_slots(F.col("code"), F.col("spans"))
    if with_edits:
        original = slots
        slots = let(original, lambda s: apply_edits(s, F.col("edits")))
    return let(
        slots,
        lambda s: F.transform(
            F.filter("defs", lambda d: d["level"] == F.col("at")),
            lambda d: F.struct(d.alias("d"), definition_text(s, d).alias("text")),
        ),
    )


def _candidates(run: Run, level: int) -> DataFrame:
    """Definitions of one level with their cleaned text."""
    modules = _bucketed(run).where(F.col("rounds") > level).withColumn("at", F.lit(level))
    if level:
        modules = modules.join(_edits(run, level), "path", "left")
    rows = modules.select("path", "rounds", "indent", F.explode(_texts(level > 0)).alias("x"))
    return rows.select(
        "path",
        "rounds",
        "indent",
        definition_id(F.col("path"), F.col("x.d")).alias("def_id"),
        F.col("x.d.name").alias("name"),
        F.col("x.d.kind").alias("definition_type"),
        F.col("x.d").alias("d"),
        strip_blank_lines(F.col("x.text")).alias("definition"),
    )


def _edits(run: Run, level: int | None = None) -> DataFrame:
    """``(path, edits)``: docstrings below a level for files with work left there, or all.

    A file's edits are gathered in one row; its code is one value already.
    """
    done = run.table("docstrings").where(F.col("status") == OK)
    if level is not None:
        done = done.where((F.col("level") < level) & (F.col("rounds") > level))
    edits = done.select("path", edit_of(F.col("d"), F.col("docstring")).alias("edit"))
    return (
        edits.repartition(_slices(run.spark), "path")
        .groupBy("path")
        .agg(F.array_sort(F.collect_list("edit")).alias("edits"))
    )


def _answers(run: Run, requests: DataFrame, count: int, total: int, level: int) -> DataFrame:
    """``(cache_key, data, status, error)``: one answer per requested key (``count`` of ``total`` rows).

    What neither an earlier level nor the cache has answered is found once, by keys; its texts stay
    in the parts that the paths have. Each wave reads parts of its own, calls the generator and commits. So
    neither the cache nor the requests are listed or read again from wave to wave. The cache stays in
    its buckets: only keys are brought to it.
    """
    answers = f"{run.folder}/answers"
    made = run.spark.read.schema(MADE_DDL).parquet
    known = []
    if level:
        earlier = run.spark.read.schema(f"{MADE_DDL}, level INT").parquet(answers)
        earlier = earlier.where((F.col("level") < level) & (F.col("status") == OK))
        known.append(earlier.join(requests.select("cache_key"), "cache_key", "left_semi").select("cache_key", "data"))
    if run.cache is not None and run.segments:
        known.append(run.cache.lookup(requests, run.segments))
    own = f"{answers}/level={level}"
    if not known:
        folder = _texts_to_call(run, requests, level, copies=count < total)
        _call(run, folder, count, own)
        return made(f"{own}/*")
    found = Observation()
    everything = functools.reduce(DataFrame.unionByName, known).observe(found, F.count("*").alias("n"))
    hits = run.save(f"hits/level={level}", everything)
    if found.get["n"] == 0:
        _call(run, _texts_to_call(run, requests, level, copies=count < total), count, own)
    else:
        misses = run.save(f"missing/level={level}", cache_misses(requests, hits))
        if misses.isEmpty():  # leaves the folder that is read next
            run.save(f"answers/level={level}/wave=0", run.spark.createDataFrame([], MADE_DDL))
        else:
            _call(run, _texts_to_call(run, misses, level, copies=True), count, own)
    kept = hits.select("cache_key", "data", F.lit(OK).alias("status"), F.lit(None).cast("string").alias("error"))
    return made(f"{own}/*").unionByName(kept)


def _texts_to_call(run: Run, requests: DataFrame, level: int, copies: bool) -> str:
    """The folder with one text for each of ``requests``, at most ``calls_per_task`` in a file.

    Without ``copies`` it is that of the definitions. Otherwise one row of each key is written anew; keys
    and paths move to find it, texts do not.
    """
    definitions = _bucketed(run, f"definitions/level={level}").withColumn("pick", F.xxhash64("def_id"))
    if not copies:
        return f"{run.folder}/definitions/level={level}"
    found = definitions.select("cache_key", "pick", "path").join(
        requests.select("cache_key", "pick").hint("shuffle_hash"), ["cache_key", "pick"], "left_semi"
    )
    picked = found.repartition(_slices(run.spark), "path").groupBy("path").agg(F.collect_list("pick").alias("picks"))
    folder = f"{run.folder}/misses/level={level}"
    (
        definitions.join(picked, "path")
        .where(F.array_contains("picks", F.col("pick")))
        .select([name for name in REQUEST_COLUMNS if name in definitions.columns])
        .write.option("compression", COMPRESSION)
        .option("maxRecordsPerFile", run.config.calls_per_task)
        .parquet(folder)
    )
    return folder


def _call(run: Run, folder: str, count: int, own: str) -> None:
    """Generate for the texts in ``folder`` (at most ``count``) and commit the answers, wave by wave.

    A wave is as many files as hold, by their bytes, ``max_workers * calls_per_task`` texts. They are
    called where they are read, unless a limit of rates has to know its tasks.
    """
    config = run.config
    limits, workers = {}, None
    if config.rate_limit is not None:
        limits, workers = {"limit": config.rate_limit, "token_count": config.token_count}, config.max_workers
    files = {name: size for name, size in file_sizes(run.spark, folder).items() if name.startswith("part-")}
    share = sum(files.values()) * config.max_workers * config.calls_per_task / max(count, 1)
    waves: list[list[str]] = []
    held = 0.0
    for name, size in sorted(files.items()):
        if not waves or held + size > share:
            waves.append([])
            held = 0.0
        waves[-1].append(f"{folder}/{name}")
        held += size
    schema = run.spark.read.parquet(folder).schema
    for number, names in enumerate(waves):
        part = run.spark.read.schema(schema).parquet(*names)
        part = part.select([name for name in REQUEST_COLUMNS if name in part.columns]).coalesce(config.max_workers)
        answers = generate(part, config.generate_docstring_func, workers, **limits)
        answers = run.save(f"{own.removeprefix(run.folder)[1:]}/wave={number}", answers.select("cache_key", "data", "status", "error"))
        if run.cache is not None:
            run.cache.commit(answers.where(F.col("status") == OK))


@functools.cache
def _docstring_columns(style: DocstringStyle, quote: str) -> tuple[Column, Column, Column, Column]:
    """Tidied data, status, rendered text and quoted docstring, each from those before."""
    empty = (F.col("status") == OK) & (F.col("data.description") == "")
    d = F.col("d")
    indent = docstring_indent(d["suite"], F.col("indent"), d["col"], d["body_col"])
    quoted = quote_docstring(indent_lines(F.col("rendered"), indent), quote)
    return (
        postprocess(F.col("data")),
        F.when(empty, EMPTY_DESCRIPTION).otherwise(F.col("status")),
        style.render_typed(F.col("data"), F.col("indent"), F.col("definition_type")),
        F.when(F.col("status") == OK, quoted),
    )


def _docstrings(answered: DataFrame, config: DocumentationConfig) -> DataFrame:
    data, status, rendered, docstring = _docstring_columns(
        config.docstring_builder, config.quote_style
    )
    return (
        answered.withColumn("data", data)
        .withColumns({"status": status, "rendered": rendered})
        .select(
            "path",
            "rounds",
            "def_id",
            "definition_type",
            "d",
            "data",
            docstring.alias("docstring"),
            "status",
            "error",
        )
    )


@functools.cache
def _new_code() -> Column:
    return rewritten_code(F.col("code"), F.col("spans"), F.col("edits"))


def _outputs(run: Run) -> DataFrame:
    kept = ["digest"] if "digest" in _bucketed(run).columns else []
    parsed = _bucketed(run).where("rounds >= 0").select("path", "code", "spans", "rounds", *kept)
    written = output_path(F.col("path"), run.config.inplace).alias("written_path")
    unchanged = parsed.where("rounds = 0").select("path", written, "code", *kept)
    if not run.levels:
        return unchanged
    changed = (
        parsed.where("rounds > 0")
        .join(_edits(run), "path", "left")
        .select("path", written, _new_code().alias("code"), *kept)
    )
    return changed.unionByName(unchanged)
