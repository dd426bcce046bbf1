"""Secret scan with a random forest against false positives, in DataFrame functions only.

Candidates are what is assigned to a named secret, or quoted after its name, up to the end of the value or the
closing quote, whatever its length and characters; PEM private keys as one block; what has the form of a key that
providers issue; and runs of at least ``min_length`` characters of ``[A-Za-z0-9+/_-]`` with a digit.
Each is described by its length, the shares of its kinds of characters, the changes from one
kind to the next, its variety, how much of it is covered by words of ``dictionary``, whether it
is (in) a path, and by what stands next to it: the assignment or quote before and after, words
that name a secret in front of it, and the length of the word before.  A random forest, trained
from labelled findings, scores them; findings under 0.5 are false positives.

Training takes at most ``max_train`` labelled findings, the first by a hash.  Where findings come
without labels, ``rule_labels`` gives them: private keys, formats that providers issue and direct assignments
to a named secret are true (but not words of letters after a colon without quotes, empty values as ``null``, and
calls and references), everything else that looks alike (card and order numbers, hashes,
identifiers) is not.

Null and empty texts have no findings; repeated rows give repeated findings; ties don't occur, as
every finding has its own place; extra columns are not read; an empty table gives no rows.  If
training findings are of one label only, every finding gets that label.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialise

# What providers issue, and how secrets are named.
ISSUED = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^(sk|pk|rk)[-_](live|test)?[-_]?[A-Za-z0-9]{20,}$|^AIza[A-Za-z0-9_-]{35}$"
ISSUED_ANYWHERE = r"(?<![A-Za-z0-9])(?:" + ISSUED.replace("^", "").replace("$", "") + r")(?![A-Za-z0-9])"
PEM = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----|[A-Za-z0-9+/=\s]*)"
NAMED = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth)"
DICTIONARY = ("the and for with that this from have access account admin auth client code config content credential data date "
              "default example file group header home host http https image index key link list local login name number order "
              "page password path private product public query root secret server service session source storage table "
              "test text time title token user value version").split()


def _class(min_length: int) -> str:
    # the cheap looks behind come first: few places have a separator before them
    name = NAMED.replace("(?i)(", "(?i:", 1) + r"[\"']?[ \t]{0,4}"
    quoted = "|".join(rf"(?<={q})(?<={name}(?:[=:][ \t]{{0,4}})?{q})[^{q}\n]+(?={q})" for q in "\"'")
    # up to white space, a quote or the next parameter, without punctuation before that: no group is repeated
    plain = rf"(?<=[=:\s])(?<=[=:][ \t]{{0,4}})(?<={name}[=:][ \t]{{0,4}})[^\s\"'&=:]" \
            r"[^\s\"']*?(?<![,;.)\]}])(?=[,;.)\]}]*+(?:&\w+=|[\s\"']|\z))"
    return rf"{PEM}|{quoted}|{plain}|{ISSUED_ANYWHERE}|{_runs(min_length)}"


def _runs(min_length: int) -> str:
    return rf"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{{{min_length},}}"


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


#: Running totals go by spans of so many steps, so that their cost grows little faster than the steps.
_SPAN = 256


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda n, x: n + x)


def _totals(steps: Column, span: int) -> Column:
    """Sums of the steps before each span."""
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / span).cast("int")), lambda b: _sum(F.slice(steps, b * span + 1, span)))
    return F.transform(spans, lambda _, b: _sum(F.slice(spans, 1, b)))


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12) -> DataFrame:
    """Id, ``position`` (characters before it), ``value``, ``before`` and ``after`` of every candidate."""
    pattern = _class(min_length)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    # everything of a text is computed once, and only small pieces are exploded
    found = rows.select(id_col, F.regexp_extract_all("text", F.lit(pattern), 0).alias("all"), F.split("text", pattern).alias("parts"))
    found = found.where(F.size("all") > 0)
    found = found.select(id_col, "all", "parts", F.transform("all", lambda x, k: F.length(x) + F.length(F.get("parts", k))).alias("steps"))
    found = found.select("*", _totals(F.col("steps"), _SPAN).alias("wide"))
    piece = F.transform("all", lambda value, k: F.struct(
        (F.get("wide", F.floor(k / _SPAN).cast("int")) + _sum(F.slice("steps", k - k % _SPAN + 1, k % _SPAN + 1)) - F.length(value)).cast("long").alias("position"),
        value.alias("value"), F.right(F.get("parts", k), F.lit(48)).alias("before"), F.left(F.get("parts", k + 1), F.lit(16)).alias("after")))
    return found.select(id_col, F.explode(piece).alias("x")).select(id_col, "x.*")


FEATURES = ["length", "digits", "uppers", "lowers", "changes", "variety", "hexadecimal", "covered", "path", "assigned",
            "quoted", "named", "named_near", "word_before"]


def describe(found: DataFrame, dictionary: list[str] = DICTIONARY) -> DataFrame:
    """``found`` with the columns ``FEATURES``."""
    v, n = F.col("value"), F.length("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[B-Z]", "A"), "[0-9]", "0"), "[+/_-]", "/")
    runs = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(kinds, "a+", "a"), "A+", "A"), "0+", "0"), "/+", "/"))
    last = F.regexp_extract("before", r"(\S+)\s*$", 1)
    columns = {
        "length": n, "digits": 1 - _without(v, "[0-9]") / n, "uppers": 1 - _without(v, "[A-Z]") / n, "lowers": 1 - _without(v, "[a-z]") / n,
        "changes": (runs - 1) / n, "variety": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hexadecimal": v.rlike("^[0-9a-f]+$"), "covered": 1 - _without(F.lower(v), "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))) / n,
        "path": v.contains("/") | F.col("before").rlike(r"[/.\\]$"), "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$"),
        "quoted": F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']"), "named": F.col("before").rlike(NAMED + r"\W*$"),
        "named_near": F.col("before").rlike(NAMED), "word_before": F.length(last)}
    return found.withColumns({k: c.cast("double") for k, c in columns.items()})


def rule_labels() -> Column:
    """True findings by format or assignment."""
    value, before = F.col("value"), F.col("before")
    assigned = before.rlike(NAMED + r"[\"']?\s*[=:]\s*[\"']?$") | before.rlike(NAMED + r"[\"']?[ \t]{0,4}[\"']$")
    word = before.rlike(r":\s*$") & value.rlike(r"^\p{L}+$")
    empty = value.rlike(r"(?i)^(none|null|nil|true|false|undefined)$") | (
        ~before.rlike(r"[\"']$") & value.rlike(r"^[A-Za-z_][\w.]*[(\[]|^\$[{(]?\w+[)}]?$"))
    return (value.rlike(ISSUED) | value.rlike("^" + PEM) | (assigned & ~word & ~empty)).cast("double")


def train(labelled: DataFrame, *, max_train: int = 20000, trees: int = 40, depth: int = 8):
    """Forest from described findings with a ``label``; or the one label that there is."""
    order = F.xxhash64("value", "before", "after")
    sample = labelled.select("label", *FEATURES, order.alias("turn")).orderBy("turn", *FEATURES).limit(max_train)
    # written once: the fit reads it several times
    sample = materialise(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("label", "features"), "secrets-train")
    labels = [r[0] for r in sample.select("label").distinct().collect()]
    if len(labels) < 2:
        return labels[0] if labels else 0.0
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(sample)


def score(found: DataFrame, model) -> DataFrame:
    """Described findings with ``score`` (0 to 1) and ``secret`` (at least 0.5)."""
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, *, train_on: Column, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12,
         max_train: int = 20000, labels: DataFrame | None = None) -> DataFrame:
    """Every candidate: id, ``position``, ``value``, ``label`` of the rules, ``score`` and ``secret``.

    ``train_on``: rows whose findings may train; ``labels``: id, ``position`` and ``label`` of labelled
    findings (default: ``rule_labels``)."""
    found = materialise(describe(candidates(docs, id_col=id_col, text_col=text_col, min_length=min_length))
                        .withColumn("label", rule_labels()), "secrets-found")
    known = found.where(train_on)
    if labels is not None:
        known = known.drop("label").join(labels.select(id_col, "position", F.col("label").cast("double")), [id_col, "position"])
    return score(found, train(known, max_train=max_train)).select(
        id_col, "position", "value", F.col("label").cast("int").alias("label"), "score", "secret")
