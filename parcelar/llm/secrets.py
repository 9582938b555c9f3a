"""Secret scan with a random forest against false positives, DataFrame operations only.

A regular expression proposes candidates in each whole text: private key blocks, values assigned to a name
such as password or token, and long runs of token characters.  A random forest of measures of the candidate
(length, character classes and the transitions between them, dictionary coverage), its path and its
neighbouring words decides which are secrets.  The forest is fitted on labelled findings, by default on
synthetic ones made by rule, and runs in the JVM; a fitted one can be saved, loaded and passed in.

Texts are read once.  What is shuffled is one slim row per candidate, to number positions in its text.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, documents

#: Names whose assigned value is a candidate.
NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential)s?"
ASSIGNED = rf"(?i:{NAMES})[\"']?\s{{0,3}}[:=]{{1,2}}\s{{0,3}}[\"']?[^\s\"'<>]+"
RUN = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}"
BLOCK = "-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----"
CANDIDATE = f"{BLOCK}|{ASSIGNED}|{RUN}"
#: Characters of context on each side that a candidate's measures look at.
CONTEXT = 48
#: Probability from which a candidate is a secret.
CUT = 0.5
#: Labelled findings that are made by rule, and shape of the forest.
FINDINGS, TREES, DEPTH, SEED = 8_500, 24, 8, 42

# Frequent words and word parts of English, German, French and Spanish, the dictionary
# whose coverage tells prose from random characters.
DICTIONARY = (
    "the and that with from this for are was not you your have here name user pass word change example test sample "
    "section chapter page file path index value data http https www com org net html json true false null none default "
    "tion ment ing ness able ible ous ies ers est ent ant ter ver der die das und ist nicht ein eine sch ung heit keit lich "
    "les des une dans pour avec que est sur qui aux eur eux elle con para por los las una del como ado ada cion mente"
).split()
_CUE = rf"(?i)(?:{NAMES}|bearer|login|key)\W{{0,6}}$"
_OTHER = r"(?i)(?:commit|revision|sha-?\d*|md5|checksum|digest|hash|uuid|guid|id|version|isbn|order|number|phone|card|invoice)\W{0,3}$"
_TESTS = r"(?i)(?:^|/)(?:tests?|examples?|fixtures?|mocks?|samples?|demos?|docs?)(?:/|$)"

# Beginnings that issuers give to their keys, and values that stand for another one.
_PREFIX = r"^(?:[A-Za-z_]{0,40}=)?(?:AKIA|ASIA|gh[opsur]_|github_pat_|xox[abeoprs]-|sk_live_|rk_live_|AIza|glpat-|npm_|SG\.|hf_|ya29\.)"
_STANDS = r"(?i)[${(\[]|^(?:none|null|nil|true|false|string|str|int|undefined|n/a|todo|changeme|secret|password)\W*$|^[*.xX_-]+$|^<"

MEASURES = (
    "length", "runs", "digits", "upper", "marks", "distinct", "hex", "numeric", "dictionary", "cue", "assigned", "quoted", "other", "tests", "piece",
    "prefix", "stands", "vowels", "humps", "block",
)


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def with_measures(found: DataFrame) -> DataFrame:
    """Adds the forest's measures to rows with value, before, after and path."""
    value = F.regexp_replace("value", r"([_+/=-])\1{3,}", "")  # rules of one mark say nothing
    pieces = F.filter(F.split(value, "[^A-Za-z0-9]+"), lambda p: p.rlike("[0-9]") & p.rlike("[A-Za-z]"))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    size = F.greatest(F.length(value), F.lit(1))
    letters = F.greatest(F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.lit(1))
    measures = {
        "length": F.least(F.length(value), F.lit(200)).cast("double"),
        "runs": F.length(classes) / size,
        "digits": _share(value, "[^0-9]"),
        "upper": _share(value, "[^A-Z]"),
        "marks": _share(value, "[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(F.substring(value, 1, 200), ""))) / F.least(size, F.lit(200)),
        "hex": _flag(value.rlike("^[0-9a-fA-F]+$")),
        "numeric": _flag(value.rlike("^[0-9 ._-]+$")),
        "dictionary": 1 - _share(F.lower(value), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))),
        "cue": _flag(F.col("before").rlike(_CUE)),
        "assigned": _flag(F.col("before").rlike(r"[:=]\s{0,3}[\"']?$")),
        "quoted": _flag(F.col("after").rlike("^[\"']")),
        "other": _flag(F.col("before").rlike(_OTHER)),
        "tests": _flag(F.col("path").rlike(_TESTS)),
        "piece": F.coalesce(F.least(F.array_max(F.transform(pieces, F.length)), F.lit(200)), F.lit(0)).cast("double"),
        "prefix": _flag(F.col("value").rlike(_PREFIX)),
        "stands": _flag(F.col("value").rlike(_STANDS)),
        "vowels": F.length(F.regexp_replace(value, "[^aeiouAEIOU]", "")) / letters,
        "humps": F.regexp_count(value, F.lit("[A-Z][a-z]{2,}")) / size,
        "block": _flag(F.col("value").rlike("^-----BEGIN")),
    }
    return found.withColumns(measures)


def labelled_findings(spark: SparkSession, count: int = FINDINGS) -> DataFrame:
    """Synthetic labelled findings: value, before, after, path, label (1: a secret).

    Row ``i`` depends on ``i`` alone: its random characters are SHA-256 digests, its kind is its remainder by the number of kinds.
    A fifth of all kinds lies under test paths or on hosts that sound like them, secrets too, so a path alone
    vetoes nothing: only repeated patterns count as dummies there, and as secrets elsewhere.
    """
    rows = spark.range(0, count, 1, 4).select(
        "id",
        F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("r"),
    )
    rows = rows.withColumn("b", F.translate(F.base64(F.unhex("h")), "=", "x"))
    words = F.split(F.lit(" ".join(DICTIONARY)), " ")

    def word(salt: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(DICTIONARY))) + 1).cast("int"))

    hexes = F.when(F.col("r") % 3 == 0, F.upper("h")).otherwise(F.col("h"))
    cues = F.array(*map(F.lit, ("token", "password", "secret", "api_key", "passwd", "Access-Key", "TOKEN", "credential")))
    cue = F.element_at(cues, (F.col("r") % 8 + 1).cast("int"))
    others = F.array(*map(F.lit, ("commit", "sha1", "md5", "checksum", "digest", "uuid", "id", "revision")))
    other = F.element_at(others, (F.col("r") % 8 + 1).cast("int"))
    sign = F.element_at(F.array(*map(F.lit, (' = "', ": ", "=", ' = \''))), (F.col("r") % 4 + 1).cast("int"))
    closing = F.element_at(F.array(*map(F.lit, ('"', " ", "\n", "'"))), (F.col("r") % 4 + 1).cast("int"))
    digits = F.translate("h", "abcdef", "123456")
    prose = F.concat(word(1), F.lit(" "), word(2), F.lit(" "))
    compound = F.concat_ws("-", word(3), word(4), word(5), (F.col("r") % 90 + 10).cast("string"), word(6))
    holder = F.concat_ws("_", F.lit("your"), word(7), word(8))
    uuid = F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12))
    key = F.when(F.col("r") % 2 == 0, F.concat(F.lit("AKIA"), F.upper(F.substring("h", 1, 16)))).otherwise(F.concat(F.lit("ghp_"), F.substring(F.translate("b", "+/", "ab"), 1, 36)))
    rule = F.repeat(F.element_at(F.array(*map(F.lit, "=-_+/")), (F.col("r") % 5 + 1).cast("int")), (F.col("r") % 100 + 16).cast("int"))
    way = F.element_at(F.array(*map(F.lit, "/-_")), (F.col("r") % 3 + 1).cast("int"))
    slug = F.array_join(F.slice(F.array(*map(word, range(9, 39))), F.lit(1), (F.col("r") % 23 + 8).cast("int")), "/")
    slug = F.when(F.col("r") % 3 == 0, slug).when(F.col("r") % 3 == 1, F.translate(slug, "/", "-")).otherwise(F.translate(slug, "/", "_"))
    long_word = F.substring(F.translate("h", "0123456789abcdef", "ebakiletonusiran"), F.lit(1), (F.col("r") % 20 + 16).cast("int"))
    letters = F.translate("b", "0123456789+/", "qZxWvKjYpBgH")
    short = F.when(F.col("r") % 2 == 0, F.substring("b", 1, 7)).otherwise(F.concat(F.substring(F.lower(letters), 1, 4), F.substring(digits, 1, 3)))
    bare = F.substring(F.lower(letters), F.lit(1), (F.col("r") % 24 + 10).cast("int"))
    issued = F.element_at(F.array(*map(F.lit, ("xoxb-", "sk_live_", "AIza", "npm_", "glpat-", "SG."))), (F.col("r") % 6 + 1).cast("int"))
    spoken = F.translate("h", "0123456789abcdef", "ebakiletonusiran")

    def said(at: int) -> Column:
        """A word that can be spoken but isn't in the dictionary."""
        return F.substring(spoken, F.lit(at), (F.col("r") % 5 + 5).cast("int"))

    stands = F.element_at(
        F.array(
            F.concat(F.lit("${"), F.upper(word(41)), F.lit("_"), F.upper(word(42)), F.lit("}")), F.lit("None"), F.lit("null"), F.lit("********"), F.lit("xxxxxxxx"), F.lit("string"),
            F.concat(F.lit("os."), word(41), F.lit("["), word(42)), F.concat(word(41), F.lit("."), word(42), F.lit("()")), F.lit("changeme"),
        ),
        (F.col("r") % 9 + 1).cast("int"),
    )
    humps = F.array_join(F.transform(F.slice(F.array(*map(word, range(43, 51))), F.lit(1), (F.col("r") % 5 + 4).cast("int")), lambda w: F.initcap(w)), "")
    digest = F.concat(F.element_at(F.array(*map(F.lit, ("sha256-", "sha512-", "sha384-", "sha1="))), (F.col("r") % 4 + 1).cast("int")), F.col("b"), F.when(F.col("r") % 2 == 0, F.col("b")).otherwise(""))
    named = F.concat(F.upper(word(51)), F.lit("_"), F.element_at(F.array(*map(F.lit, ("TOKEN=", "PASSWORD=", "SECRET=", "KEY="))), (F.col("r") % 4 + 1).cast("int")), F.substring(F.translate("b", "+/", "ab"), 1, 30))
    other_named = F.concat(F.element_at(F.array(*map(F.lit, ("revision=", "commit=", "ACCOUNT_NUMBER_", "order_id="))), (F.col("r") % 4 + 1).cast("int")), F.when(F.col("r") % 4 < 2, F.substring("h", 1, 40)).otherwise(F.substring(digits, 1, 16)))
    block = F.concat(F.lit("-----BEGIN "), F.element_at(F.array(*map(F.lit, ("", "RSA ", "EC ", "OPENSSH "))), (F.col("r") % 4 + 1).cast("int")), F.lit("PRIVATE KEY-----\n"), F.array_join(F.array_repeat("b", (F.col("r") % 15 + 1).cast("int")), "\n"), F.lit("\n-----END PRIVATE KEY-----"))
    kinds = [  # value, before, after, label
        (F.substring(hexes, 1, 40), F.concat(prose, cue, sign), closing, 1),
        (F.substring(hexes, 1, 32), F.concat(prose, cue, sign), closing, 1),
        (F.substring("b", 1, 40), F.concat(prose, cue, sign), closing, 1),
        (F.concat(F.lit("ghp_"), F.substring(F.translate("b", "+/", "ab"), 1, 36)), prose, F.lit(" "), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring("h", 1, 16))), F.concat(prose, F.lit("key ")), F.lit(" "), 1),
        (F.substring("b", 1, 12), F.concat(prose, cue, sign), closing, 1),
        (hexes, F.concat(prose, cue, sign), closing, 1),
        (F.substring(digits, 1, 16), prose, F.lit(" "), 0),
        (F.substring("h", 1, 40), F.concat(prose, other, F.lit(" ")), F.lit(" "), 0),
        (compound, prose, F.lit(" "), 0),
        (uuid, F.concat(prose, other, F.lit(": ")), F.lit(" "), 0),
        (holder, F.concat(prose, cue, sign), closing, 0),
        (F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 13)), prose, F.lit(","), 0),
        (F.repeat(F.substring("h", 1, 4), 10), F.concat(prose, cue, sign), closing, 0),  # a dummy in a test path, a secret elsewhere
        (F.concat(rule, key), prose, F.lit(" "), 1),
        (F.concat(slug, way, key), prose, F.lit(" "), 1),
        (F.substring(letters, 1, 40), prose, F.lit(" "), 1),
        (short, F.concat(prose, cue, sign), closing, 1),
        (F.when(F.col("r") % 3 == 0, F.initcap(long_word)).when(F.col("r") % 3 == 1, F.upper(long_word)).otherwise(long_word), prose, F.lit(" "), 0),
        (slug, prose, F.lit(" "), 0),
        (rule, prose, F.lit("\n"), 0),
        (word(40), F.concat(prose, cue, sign), closing, 0),
        (F.concat(slug, way, F.lit("v"), F.substring(digits, 1, 1), way, F.lit("20"), F.substring(digits, 2, 2)), prose, F.lit(" "), 0),
        (bare, F.concat(prose, cue, sign), closing, 1),
        (F.concat(issued, F.when(F.col("r") % 2 == 0, F.substring(letters, 1, 30)).otherwise(F.substring(F.translate("b", "+/", "ab"), 1, 30))), prose, F.lit(" "), 1),
        (stands, F.concat(prose, cue, sign), closing, 0),
        (humps, prose, F.lit(" "), 0),
        (digest, prose, F.lit(" "), 0),
        (named, prose, F.lit(" "), 1),
        (other_named, prose, F.lit(" "), 0),
        (block, prose, F.lit("\n"), 1),
        (F.when(F.col("r") % 2 == 0, F.concat(F.lit("${"), F.upper(said(1)), F.lit("_"), F.upper(said(9)), F.lit("}"))).otherwise(F.concat(said(3), F.lit("."), said(12), F.lit("["))), F.concat(prose, cue, sign), closing, 0),
        (F.concat(*(F.initcap(said(k)) for k in (2, 11, 20, 29))), prose, F.lit(" "), 0),
        (F.substring(F.translate(F.concat("b", "b"), "+/", "ab"), F.lit(1), (F.col("r") % 60 + 20).cast("int")), prose, F.lit(" "), 1),
    ]
    rows = rows.withColumn("kind", F.pmod(F.col("id"), F.lit(len(kinds))))
    plain = F.concat(F.lit("src"), (F.col("r") % 20).cast("string"))
    alike = F.array(*map(F.lit, ("tests/fixtures/config", "latest-news.org", "https://contest.example.com/docs/page", "examples/app", "demo.example.org", "test")))
    near_tests = F.element_at(alike, (F.floor(F.col("r") / 5) % 6 + 1).cast("int"))
    dummy = (F.col("kind") == 13) & (F.col("r") % 2 == 0)
    pick = lambda n: F.coalesce(*(F.when(F.col("kind") == i, k[n] if n < 3 else F.lit(float(k[n]))) for i, k in enumerate(kinds)))
    return rows.select(
        pick(0).alias("value"),
        pick(1).alias("before"),
        pick(2).alias("after"),
        F.when(dummy, F.lit("tests/fixtures/config")).when((F.col("kind") != 13) & (F.col("r") % 5 == 0), near_tests).otherwise(plain).alias("path"),
        F.when((F.col("kind") == 13) & ~dummy, F.lit(1.0))
        .otherwise(pick(3))
        .alias("label"),
    )


def fit_forest(findings: DataFrame) -> PipelineModel:
    """The forest for labelled findings (value, before, after, path, label)."""
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    stages = [VectorAssembler(inputCols=list(MEASURES), outputCol="features"), forest]
    measured = checkpoint(with_measures(findings).select(*MEASURES, "label"))  # each level of the trees reads them
    return Pipeline(stages=stages).fit(measured)


_FITTED: dict[str, PipelineModel] = {}


def default_forest(spark: SparkSession) -> PipelineModel:
    """The forest for :func:`labelled_findings`, fitted once in an application."""
    name = spark.sparkContext.applicationId
    if name not in _FITTED:
        _FITTED.clear()
        _FITTED[name] = fit_forest(labelled_findings(spark))
    return _FITTED[name]


def candidates(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """One row per candidate: doc_id, k1 (hash of id and text), uid (of the row), path, start, value, before, after."""
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"),
        F.monotonically_increasing_id().alias("uid"),
        F.col(path).cast("string").alias("path"),
        F.col(text).alias("text"),
    ).where(F.col("text").rlike(CANDIDATE))
    piece = lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(CONTEXT)).alias("end"), F.left(p, F.lit(2)).alias("start"))
    cut = slim.select(
        "doc_id", "k1", "uid", "path",
        F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("hits"),
        F.transform(F.split("text", CANDIDATE, -1), piece).alias("gaps"),
    )
    rows = cut.select(
        "doc_id", "k1", "uid", "path",
        F.posexplode(F.transform("hits", lambda h, i: F.struct(h.alias("hit"), F.get("gaps", i).alias("gap"), F.get("gaps", i + 1)["start"].alias("after")))),
    )
    before = Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    value = F.regexp_extract("col.hit", r"^(?i:" + NAMES + r")[\"']?\s{0,3}[:=]{1,2}\s{0,3}[\"']?([^\s\"'<>]+)$", 1)
    rows = rows.withColumn("value", F.when(value == "", F.col("col.hit")).otherwise(value))
    shift = F.length("col.hit") - F.length("value")
    earlier = F.coalesce(F.sum(F.col("col.gap.n") + F.length("col.hit")).over(before), F.lit(0))
    return rows.select(
        "doc_id", "k1", "uid", "path",
        (earlier + F.col("col.gap.n") + shift).cast("int").alias("start"),
        "value",
        F.concat("col.gap.end", F.expr("left(col.hit, length(col.hit) - length(value))")).alias("before"),
        F.col("col.after").alias("after"),
    )


def scan_secrets(
    docs: DataFrame,
    findings: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str = "source",
    cut: float = CUT,
    model: PipelineModel | None = None,
) -> DataFrame:
    """One row per candidate: doc_id, k1, start, length, value, probability, secret.

    ``start`` and ``length`` are in code points.  ``findings`` are labelled findings to fit the forest on; ``model``
    is one that :func:`fit_forest` has given, which can be saved and loaded.
    A null or empty text has no candidates; a null path counts as no test path; null ids stay null;
    repeated rows each give their candidates; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    if model is None:
        model = default_forest(docs.sparkSession) if findings is None else fit_forest(findings)
    found = with_measures(candidates(docs, doc_id, text, path))
    scored = model.transform(found)
    return scored.select(
        "doc_id",
        "k1",
        "start",
        F.length("value").alias("length"),
        "value",
        F.round(vector_to_array("probability")[1], 6).alias("probability"),
        (vector_to_array("probability")[1] >= cut).alias("secret"),
    )


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", model: PipelineModel | None = None) -> DataFrame:
    """``documents`` with every secret in ``text`` replaced by ``mask``; all rows and columns stay, whatever their names.

    A null or empty text stays as it is; rows with equal id and text are masked alike, each by all findings of
    them (their paths may differ); an empty table stays empty.
    """
    found = scan_secrets(docs, model=model).where("secret").groupBy("doc_id", "k1")
    spans = found.agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"))
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("a.doc_id", "a.text") == F.col("b.k1"))
    begin = "IF(i = 0, 0, b.spans[i - 1].start + b.spans[i - 1].length)"
    pieces = f"transform(b.spans, (s, i) -> substring(a.text, {begin} + 1, s.start - {begin}))"
    tail = "substring(a.text, b.spans[size(b.spans) - 1].start + b.spans[size(b.spans) - 1].length + 1)"
    clean = F.when(F.col("b.spans").isNull(), F.col("a.text")).otherwise(F.array_join(F.expr(f"concat({pieces}, array({tail}))"), mask))
    columns = ((clean if c == "text" else F.col(f"a.`{c}`")).alias(c) for c in docs.columns)
    return docs.alias("a").join(spans.alias("b"), on, "left").select(*columns)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "start", "length", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "probability", "secret")
