"""Document large bodies of Python source with Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions travel to the executors whole, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])

from .config import DocumentationConfig, DocumentationError  # noqa: E402
from .functions.render import (  # noqa: E402
    DocstringStyle,
    EarlyStyle,
    GoogleStyle,
    NumpyStyle,
    PythonStyle,
)
from .operators.cache import compact_cache  # noqa: E402
from .operators.extract import register_table_function  # noqa: E402
from .operators.generate import TooManyTokens, chat_generator, offline_generator  # noqa: E402
from .operators.references import reachable, reference_context, references  # noqa: E402
from .operators.sql import register_definitions_table, register_generator  # noqa: E402
from .operators.throttle import RateLimit, RateLimited  # noqa: E402
from .plans.document import (  # noqa: E402
    Run,
    document_files,
    document_sources,
    resume_publish,
    unpublished_runs,
)
from .schema import ClassDoc, ExceptionDoc, FunctionDoc, ParameterDoc, ReturnDoc  # noqa: E402
from .sources.code_files import CodeFiles, register_source  # noqa: E402

__all__ = [
    "ClassDoc",
    "CodeFiles",
    "DocstringStyle",
    "DocumentationConfig",
    "DocumentationError",
    "EarlyStyle",
    "ExceptionDoc",
    "FunctionDoc",
    "GoogleStyle",
    "NumpyStyle",
    "ParameterDoc",
    "PythonStyle",
    "ReturnDoc",
    "RateLimit",
    "RateLimited",
    "Run",
    "TooManyTokens",
    "chat_generator",
    "compact_cache",
    "document_files",
    "document_sources",
    "offline_generator",
    "reachable",
    "reference_context",
    "references",
    "register_definitions_table",
    "register_generator",
    "register_source",
    "register_table_function",
    "resume_publish",
    "unpublished_runs",
]
