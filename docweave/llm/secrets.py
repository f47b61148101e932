"""Secret scan: candidates by pattern, false positives removed by a random forest, in columns only.

Candidates are values of any characters, from 6 on, that are assigned to a name with a secret word in it;
passwords in the user part of a URL; dotted tokens, whole; and runs of at least 16 letters, digits and
signs of keys. Their features are length, the changes between kinds of characters, how much a
dictionary covers, signs of a path or URL, and the words before and after. The forest is trained on labelled
findings (secrets under assignments, in URLs and with known prefixes; against long words, checksums, paths,
identifiers, settings and placeholders) and keeps candidates from `threshold` on.

Positions count code points from 0, end exclusive. Null and empty texts have no candidates; repeated
rows are scanned each; an empty table gives an empty result. A text with very many candidates takes time
in proportion to them (sums of lengths are made block by block).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A name is read to its end before the sign after it is looked for, so that long runs cost one pass.
_NAME = r"[A-Za-z0-9_.-]"
_SECRET_NAME = rf"(?<!{_NAME})(?={_NAME}*?(?i:token|secret|passw|pwd|pass|api[_.-]?key|access[_.-]?key|private|credential|bearer|auth)){_NAME}*+"
_ASSIGNMENT = rf"{_SECRET_NAME}[\"']?\s*+(?:=>|:=|[=:])\s*+"
_VALUES = r"(?:\"[^\s\"]{6,}(?=\")|'[^\s']{6,}(?=')|[^\s\"'<>]{5,}[^\s\"'<>.,;:!?)\]}])"
_USER = r"://[^\s/@:\"'<>]*+:"
CANDIDATE = (
    rf"{_ASSIGNMENT}{_VALUES}|{_USER}[^\s/@\"'<>]{{3,}}(?=@)"
    r"|[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]{10,}+){2,}|[A-Za-z0-9+/_-]{16,}={0,2}"
)
#: What stands before the value in a match.
_CONTEXT = rf"^(?:{_ASSIGNMENT}[\"']?|{_USER})"
#: Candidates whose lengths are summed up at a time.
SUMMED = 256
#: Characters before and after a candidate that are looked at.
NEAR_CHARS = 48
TREES, DEPTH, TRAIN_ROWS, THRESHOLD = 20, 10, 12_000, 0.5

# Words and word parts of the dictionary, longer ones first in the pattern.
DICTIONARY = (
    "account address about after again their there these thing think where which while would with "
    "that this from have image article content index page static public user name value default "
    "example placeholder changeme insert replace your here test data file path html http https www "
    "tion ment ing ent ence ness able ible over under inter the and for are was not you all can her "
    "one our out day get has him his how man new now old see two way who did its let put say she too "
    "use ion ate ver con pro com per pre res sti ist est ers ter tor ted nte rea and ein ich sch und "
    "der die das den gen ung keit heit lich que les des une pour eau eux los las ado ido ción"
).split()
# Frequent pairs of letters, for long words that no dictionary has.
PAIRS = (
    "th er an in on re nd ou ha ti es en ed to it st ea at le sh wh or ng ly be ie ch ge un ei ra co la mi da qu "
    "ue no sa lo ma di pe ro se te ve is ic al ne de"
).split()
SECRET_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private|credential|bearer|auth)"
OTHER_WORDS = r"(?i)(commit|sha-?\d|sha\b|md5|checksum|digest|hash|uuid|guid|revision|etag|image|integrity)"
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|sk_live_|sk_test_|sk-|xox[bp]-|AIza|glpat-|eyJ)"

_PARTS = "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"


def _share(text: Column, kinds: str) -> Column:
    """The share of characters of these kinds."""
    return 1 - F.char_length(F.regexp_replace(text, kinds, "")) / F.char_length(text)


def features(found: Column, before: Column, after: Column) -> dict[str, Column]:
    kinds = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"),
        "[^aB1]", "-",
    )
    changes = F.char_length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    size = F.char_length(found)
    flag = lambda condition: condition.cast("double")
    return {
        "length": size.cast("double"),
        "changes": changes / size,
        "digits": _share(found, "[0-9]"),
        "upper": _share(found, "[A-Z]"),
        "signs": _share(found, "[A-Za-z0-9]"),
        "vowels": _share(found, "(?i)[aeiou]"),
        "distinct": F.size(F.array_distinct(F.split(found, ""))) / F.least(size, F.lit(40)),
        "dictionary": _share(F.lower(found), _PARTS),
        "hex": flag(found.rlike("^[0-9a-f]+$")),
        "uuid": flag(found.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "prefix": flag(found.rlike(PREFIXES)),
        "slashes": _share(found, "/"),
        "kinds": sum((flag(found.rlike(kind)) for kind in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0.0)),
        "repeats": _share(found, r"(.)\1+"),
        "code": flag(found.rlike(r"[({\[$]|^[a-z]+(\.[a-z_]+)+$|^[%<{]")),
        "dots": F.char_length(found) - F.char_length(F.replace(found, F.lit("."), F.lit(""))).cast("double"),
        "in_url": flag(before.rlike(r"://[^\s/@:]*:$") & after.rlike("^@")),
        "name_like": flag(found.rlike(r"^[A-Za-z]?[a-z]+([_-][a-z]+)*$|^[A-Z]+(_[A-Z]+)*$")),
        "path_before": flag(before.rlike(r"(://|[./\\?&])[^\s]*$")),
        "path_after": flag(after.rlike(r"^[./?&]\w")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        "secret_word": flag(before.rlike(SECRET_WORDS)),
        "other_word": flag(F.concat_ws(" ", before, after).rlike(OTHER_WORDS)),
    }


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """before, found, after, label: findings of 24 kinds with the verdict that each has."""

    def number(salt: int, below: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(below))

    def one_of(salt: int, *choices: str) -> Column:
        return F.element_at(F.array(*map(F.lit, choices)), (number(salt, len(choices)) + 1).cast("int"))

    noise = F.concat(*[F.base64(F.unhex(F.sha2(F.concat_ws("-", "id", F.lit(i)), 256))) for i in range(2)])
    letters = F.regexp_replace(noise, "[+/=]", "")
    text_hex = F.sha2(F.concat_ws("/", F.lit("hex"), "id"), 256)
    parts = [one_of(100 + i, *DICTIONARY) for i in range(8)]
    word, joint = F.concat(*parts), one_of(12, "-", "/", "_")
    pair = one_of(1, "token", "secret", "password", "api_key", "access_key", "auth_token", "private_key", "API-KEY")
    assign = F.concat(pair, one_of(2, ' = "', "=", ": ", "='", '": "', " = "))
    prose = F.concat_ws(" ", one_of(3, *DICTIONARY), one_of(4, *DICTIONARY), one_of(5, *DICTIONARY))
    hex_size = one_of(6, "32", "40", "64").cast("int")
    kind = number(7, 24)
    coined = F.substring(
        F.concat(*[one_of(200 + i, *PAIRS) for i in range(14)]), F.lit(1), (number(19, 12) + 16).cast("int")
    )
    # Short passwords: a word changed and mixed with digits and signs, or drawn from all characters.
    spoilt = F.translate(F.concat(one_of(20, *DICTIONARY), one_of(21, *PAIRS), one_of(22, *PAIRS)), "aeiost", "4310$7")
    sign = one_of(23, "&", "!", "-", "_", "#", "@1", "%", "*", "+", "?x")
    digits = (number(24, 9990) + 10).cast("string")
    mixed = F.translate(F.substring(noise, F.lit(1), (number(25, 9) + 7).cast("int")), "+/=", "&!#")
    password = (
        F.when(number(26, 4) == 0, mixed)
        .when(number(26, 4) == 1, F.concat(F.initcap(spoilt), sign, digits))
        .when(number(26, 4) == 2, F.concat(one_of(27, *DICTIONARY), one_of(28, *PAIRS), sign, digits))
        .otherwise(F.concat(spoilt, digits, sign, one_of(29, *PAIRS)))
    )
    dotted = F.concat(
        F.lit("eyJ"), F.substring(letters, F.lit(1), F.lit(24)), F.lit("."), F.substring(letters, F.lit(20), F.lit(40)),
        F.lit("."), F.substring(letters, F.lit(40), F.lit(30)),
    )
    setting = one_of(
        30, "required", "string", "optional", "boolean", "undefined", "********", "xxxxxxxx", "changeme", "example",
        "${PASSWORD}", "{{secret}}", "<password>", "%PASSWORD%", "$TOKEN_VALUE", "os.environ", "process.env", "getpass()",
        "config.password", "self.token", "settings.secret_key", "input()", "your-password", "your_token", "password",
        "PASSWORD", "null_value", "request.headers", "hidden", "str(value)", "default", "None),", "Optional[str]",
    )
    plain = F.concat(one_of(31, *DICTIONARY), one_of(32, *DICTIONARY), one_of(33, *PAIRS), one_of(34, *PAIRS))
    host = F.concat_ws(".", *[F.concat(part, coined) for part in parts[:2]], F.concat(parts[2], F.lit("organisation")))
    # Written into columns first, behind an exchange: as one expression all this is too long to compile.
    pieces = {
        "noise": noise, "letters": letters, "text_hex": text_hex, "word": word, "joint": joint, "pair": pair,
        "assign": assign, "prose": prose, "coined": coined, "password": password, "dotted": dotted, "setting": setting,
        "plain": plain, "host": host, **{f"part{i}": part for i, part in enumerate(parts)},
    }
    base = spark.range(rows).select("id", *[column.alias(name) for name, column in pieces.items()])
    base = base.repartition(8, "id")
    noise, letters, text_hex, word, joint, pair, assign, prose, coined, password, dotted, setting, plain, host, *parts = map(
        F.col, pieces
    )
    close = F.when(assign.rlike("\"$"), '"').when(assign.rlike("'$"), "'").otherwise("")
    found = (
        F.when(kind.isin(14, 15, 16), password)
        .when(kind == 17, password)
        .when(kind == 18, dotted)
        .when(kind.isin(19, 20), setting)
        .when(kind == 21, F.when(number(35, 2) == 0, plain).otherwise(F.initcap(plain)))
        .when(kind == 22, one_of(36, "password", "pass", "changeme", "secret", "<password>", "${PASSWORD}", "xxxx", "PASSWORD", "***"))
        .when(kind == 23, host)
        .when(kind <= 1, F.substring(text_hex, F.lit(1), hex_size))
        .when(kind <= 3, F.substring(noise, F.lit(1), (number(8, 30) + 20).cast("int")))
        .when(kind == 4, F.concat(one_of(9, "AKIA", "ghp_", "sk_live_", "AIza", "glpat-"), F.substring(letters, F.lit(1), (number(10, 20) + 16).cast("int"))))
        .when(kind == 5, F.substring(letters, F.lit(1), (number(11, 24) + 16).cast("int")))
        .when(kind == 6, F.concat(F.lit("averylongstart"), word))
        .when(kind == 7, F.concat(F.initcap(word), word))
        .when(kind == 8, F.substring(text_hex, F.lit(1), hex_size))
        .when(kind == 9, F.concat(parts[0], *[piece for part in parts[1:] for piece in (joint, part)]))
        .when(kind == 10, F.concat_ws("-", *[F.substring(text_hex, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
        .when(kind == 12, coined)
        .when(kind == 13, F.initcap(coined))
        .otherwise(one_of(13, "xxxxxxxxxxxxxxxxxxxxxxxx", "your_api_key_goes_here", "replace-this-value-here", "changemechangeme", "00000000000000000000"))
    )
    left = (
        F.when(kind.isin(14, 15, 16, 19, 20, 21), F.concat_ws(" ", prose, F.concat(one_of(37, "", "DB_", "my-", "app."), assign)))
        .when(kind.isin(17, 22), F.concat(prose, one_of(38, " postgres", " https", " mysql", " amqp"), F.lit("://"), one_of(39, *DICTIONARY), F.lit(":")))
        .when(kind == 18, F.concat_ws(" ", prose, F.when(number(40, 2) == 0, assign).otherwise("Bearer ")))
        .when(kind == 23, F.concat(prose, F.lit(" ")))
        .when(kind.isin(4, 5) & (number(14, 3) > 0) | (kind <= 3), F.concat_ws(" ", prose, assign))
        .when(kind == 5, F.concat(pair, F.lit(" is ")))
        .when(kind == 8, F.concat_ws(" ", prose, one_of(15, "commit ", "sha256:", "md5: ", "checksum = ", "etag=\"", "revision ")))
        .when(kind == 9, one_of(16, "https://example.org/", "see /usr/share/", "<a href=\"/", "images/"))
        .when(kind == 10, one_of(17, "id=", "uuid: ", "request ", "guid="))
        .when(kind == 11, assign)
        .otherwise(F.concat(prose, F.lit(" ")))
    )
    right = F.when(kind.isin(17, 22), F.concat(F.lit("@"), one_of(41, *DICTIONARY), F.lit(".example"))).when(left.rlike("[\"']$"), close).otherwise(F.concat(one_of(18, " ", ". ", ", ", "\n"), prose))
    return base.select(
        left.alias("before"), found.alias("found"), right.alias("after"),
        F.when((kind <= 5) | kind.between(14, 18), 1.0).otherwise(0.0).alias("label"),
    )


def train(findings: DataFrame) -> PipelineModel:
    """A forest over the features of findings (before, found, after, label)."""
    named = features(F.col("found"), F.col("before"), F.col("after"))
    table = findings.select("label", *[column.alias(name) for name, column in named.items()])
    assembler = VectorAssembler(inputCols=list(named), outputCol="features")
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", seed=3, maxBins=64
    )
    fitted: RandomForestClassificationModel = forest.fit(assembler.transform(table))
    # A copy leaves out the training summary, which would take the session along to the executors
    # and fails to once the session has been used for observations.
    return PipelineModel([assembler, fitted.copy()])


def candidates(rows: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, start, end, found, before, after: every candidate of every whole text."""
    held = rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(CANDIDATE))
    held = held.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
        F.split("text", CANDIDATE).alias("gaps"),
    )
    # Ends of the candidates: gaps and candidates take turns. Each block of them is summed up, then
    # put behind the blocks before it, so that the array is copied once a block.
    lengths = F.zip_with(
        F.slice("gaps", F.lit(1), F.size("found")), "found",
        lambda gap, one: (F.char_length(gap) + F.char_length(one)).cast("bigint"),
    )
    held = held.withColumn("lengths", lengths)
    blocks = F.transform(
        F.sequence(F.lit(1), F.size("found"), F.lit(SUMMED)), lambda at: F.slice("lengths", at, F.lit(SUMMED))
    )
    nothing = F.array().cast("array<bigint>")

    def behind(done: Column, block: Column) -> Column:
        first = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("bigint"))
        summed = F.aggregate(
            block, nothing,
            lambda ends, n: F.array_append(ends, F.coalesce(F.try_element_at(ends, F.lit(-1)), first) + n),
        )
        return F.concat(done, summed)

    listed = held.withColumn("ends", F.aggregate(blocks, nothing, behind)).select(
        "doc_id", "found", "gaps", "ends", F.explode(F.sequence(F.lit(1), F.size("found"))).alias("i")
    )
    end = F.element_at("ends", F.col("i"))
    matched = F.element_at("found", F.col("i"))
    listed = listed.select(
        "doc_id",
        end.alias("end"),
        matched.alias("matched"),
        F.regexp_extract(matched, _CONTEXT, 0).alias("context"),
        F.right(F.element_at("gaps", F.col("i")), F.lit(NEAR_CHARS)).alias("before"),
        F.left(F.element_at("gaps", F.col("i") + 1), F.lit(NEAR_CHARS)).alias("after"),
    )
    found = F.substring("matched", F.char_length("context") + 1, F.char_length("matched"))
    return listed.select(
        "doc_id",
        (F.col("end") - F.char_length(found)).alias("start"),
        "end",
        found.alias("found"),
        F.right(F.concat("before", "context"), F.lit(NEAR_CHARS)).alias("before"),
        "after",
    )


def scan(rows: DataFrame, model: PipelineModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end, found and score of the candidates that the forest keeps."""
    listed = candidates(rows, text)
    named = features(F.col("found"), F.col("before"), F.col("after"))
    table = listed.select("doc_id", "start", "end", "found", *[c.alias(name) for name, c in named.items()])
    scored = model.transform(table)
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "start", "end", "found", score.alias("score")).where(F.col("score") >= threshold)
