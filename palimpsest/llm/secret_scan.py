"""Secret scan in DataFrame and SQL functions: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more key characters with a digit, or any value that is assigned to a secret's name. Its
features are its length and character classes; the shares of the transitions between character classes, and how likely
its characters follow each other in the text around all candidates; the share that dictionary words cover, the
dictionary being the words that LEAST_DOCS documents have; its path and the words around it, as categories. A random
forest of Spark ML, trained from labelled findings, gives the probability that it is a secret.

Where no findings are labelled by hand, names and published key formats label them: a value that is assigned to a
secret's name, or has the form of an issued key, counts as a secret, any other candidate does not. Names and the
assignment belong to no feature, so the forest does not see what most labels come from. A fifth of the documents is
kept out of training, to measure on.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_filter, pass_filter, remainder, stored

#: Names in front of a value that is meant to be secret.
NAMES = "token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|auth|credentials?|bearer"
#: Published forms of issued keys (cloud access keys, repository, chat and payment tokens, signed tokens).
FORMATS = "^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]*)$"
#: Key characters. One or two '=' may end a run; inside, it parts a name from its value.
_KEY = r"A-Za-z0-9_+/.\-"
_ASSIGNED = rf"(?i:(?<![A-Za-z])(?:{NAMES}))[\"']?[ \t]?[=:][ \t]?[\"']?"
# the short look-behind spares the long one at most places
CANDIDATE = rf"(?<=[=:][ \t]?[\"']?)(?<={_ASSIGNED})[^\s\"'`,;<>(){{}}\[\]]+|(?<![{_KEY}])[{_KEY}]{{16,}}={{0,2}}"
#: Context in code points that features look at.
BEFORE, AFTER = 64, 32
#: At most so many labelled findings are fitted (the bound of the training sample).
SAMPLE = 20_000
TREES, DEPTH, SEED = 24, 6, 5
#: Words of three letters or more that so many documents have, whole, are the dictionary.
LEAST_DOCS = 5
#: Documents with this remainder of crc32 are not trained on.
DIVISOR, HELD_OUT = 5, 0
#: Buckets of a categorical feature.
BUCKETS = 32

#: Classes of characters: digits, letters of hexadecimal numbers, other lower-case letters, upper-case letters, the rest.
CLASSES = {"d": "[0-9]", "h": "[a-f]", "l": "[g-z]", "u": "[A-Z]"}
TRANSITIONS = [x + y for x in "dhlus" for y in "dhlus"]
NUMBERS = ["n_chars", "digits", "upper", "lower", "distinct", "longest_word", "longest_digits", "hexadecimal", "slashes", "dots", "covered", "likelihood", *(f"t_{t}" for t in TRANSITIONS)]
CATEGORIES = ["path", "word_before", "word_after"]


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """A row for each candidate: doc_id, start, end (code points), body, before, after (its surroundings), path.

    Without a column ``path`` the path is null. Only candidates and their surroundings are shuffled, never texts.
    """
    where = docs[path].cast("string") if path in docs.columns else F.lit(None).cast("string")
    part = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], where.alias("path"))
    part = part.filter(F.col("text").rlike("[0-9=:]")).withColumn("row", F.monotonically_increasing_id())
    part = part.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).withColumn("between", F.split("text", CANDIDATE, -1))
    each = F.expr(f"transform(found, (c, k) -> named_struct('k', k, 'body', c, 'gap', length(between[k]), 'gap_end', right(between[k], {BEFORE}), 'after', left(between[k + 1], {AFTER})))")
    # outer, then a filter: a plain explode would add a filter that computes the arrays again
    rows = part.select("doc_id", "path", "row", F.explode_outer(each).alias("c")).filter("c IS NOT NULL").select("doc_id", "path", "row", "c.*")
    upto = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("body")).over(upto)
    rows = rows.withColumn("end", end.cast("long")).withColumnRenamed("gap_end", "before")
    rows = rows.filter(F.col("body").rlike("[0-9]") | _named())
    return rows.select("doc_id", (F.col("end") - F.length("body")).alias("start"), "end", "body", "before", "after", "path")


def _named() -> Column:
    return F.col("before").rlike(f"{_ASSIGNED}$")


def _pairs(text: Column) -> Column:
    """The neighbouring characters of a text, as an array of structs."""
    spelt = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(F.arrays_zip(F.slice(spelt, 1, F.greatest(F.size(spelt) - 1, F.lit(0))).alias("a"), F.slice(spelt, 2, F.greatest(F.size(spelt) - 1, F.lit(0))).alias("b")), lambda p: p)


def _plain(c: Column) -> Column:
    """Letters in lower case and digits as they are, anything else as a blank: 37 characters."""
    return F.when(c.rlike("[A-Za-z0-9]"), F.lower(c)).otherwise(F.lit(" "))


def _class(c: Column) -> Column:
    out = F.lit("s")
    for name, pattern in CLASSES.items():
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def dictionary(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Those of ``words`` (column word) that stand alone in LEAST_DOCS rows of ``docs`` or more, in any case."""
    alone = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(?<![A-Za-z0-9])[a-z]{3,}(?![A-Za-z0-9])"), F.lit(0)))
    each = docs.select(F.explode_outer(alone).alias("word")).filter("word IS NOT NULL")
    each = pass_filter(each, key_filter(words, "word"), F.col("word"))
    known = each.groupBy("word").agg(F.count("*").alias("docs")).filter(F.col("docs") >= LEAST_DOCS).select("word")
    return known.join(words.select(F.col("word").alias("_w")).distinct(), F.col("word") == F.col("_w"), "left_semi")


def lexical(docs: DataFrame, found: DataFrame) -> DataFrame:
    """body, covered, likelihood and the shares of transitions of each distinct candidate. Stored.

    How likely one character follows another comes from the text around all candidates (with one added to each of
    the 37 x 37 counts).
    """
    bodies = stored(found.select("body").distinct(), "bodies")
    around = F.concat_ws(" ", "before", "after")
    pairs = found.select(F.explode(_pairs(around)).alias("p")).select(_plain(F.col("p.a")).alias("a"), _plain(F.col("p.b")).alias("b"))
    pairs = stored(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")  # 37 x 37 rows at most
    first = pairs.groupBy(F.col("a").alias("_fa")).agg(F.sum("n").alias("n_first"))
    both = pairs.select(F.col("a").alias("_pa"), F.col("b").alias("_pb"), "n")
    own = bodies.select("body", F.explode(_pairs(F.col("body"))).alias("p"))
    own = own.select("body", _plain(F.col("p.a")).alias("a"), _plain(F.col("p.b")).alias("b"), F.concat(_class(F.col("p.a")), _class(F.col("p.b"))).alias("t"))
    own = own.groupBy("body", "a", "b", "t").agg(F.count("*").alias("k"))
    own = own.join(both, (F.col("a") == F.col("_pa")) & (F.col("b") == F.col("_pb")), "left").join(first, F.col("a") == F.col("_fa"), "left")
    log = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("n_first", F.lit(0)) + 37))
    shares = [(F.sum(F.when(F.col("t") == t, F.col("k")).otherwise(0)) / F.sum("k")).alias(f"t_{t}") for t in TRANSITIONS]
    chained = own.groupBy("body").agg(F.round(F.sum(F.col("k") * log) / F.sum("k"), 9).alias("likelihood"), *shares).withColumnRenamed("body", "_b")
    words = bodies.select("body", F.explode(F.regexp_extract_all(F.lower("body"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    known = stored(dictionary(docs, words.select("word").distinct()).withColumnRenamed("word", "_w"), "dictionary")
    covered = words.join(known, F.col("word") == F.col("_w")).groupBy(F.col("body").alias("_c")).agg((F.sum(F.length("word"))).alias("known"))
    out = bodies.join(chained, F.col("body") == F.col("_b"), "left").join(covered, F.col("body") == F.col("_c"), "left")
    return stored(out.select("body", (F.coalesce("known", F.lit(0)) / F.length("body")).alias("covered"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ["likelihood", *(f"t_{t}" for t in TRANSITIONS)])), "lexical")


def described(found: DataFrame, lex: DataFrame) -> DataFrame:
    """Adds f_ and each name in NUMBERS (double) and CATEGORIES (text)."""

    def share(pattern: str):
        return F.expr(f"(length(body) - length(regexp_replace(body, '{pattern}', ''))) / length(body)")

    def longest(pattern: str):
        return F.expr(f"coalesce(array_max(transform(regexp_extract_all(body, '{pattern}', 0), x -> length(x))), 0)")

    def bucket(text: Column):
        return F.concat(F.lit("b"), F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(BUCKETS)).cast("string"))

    # neighbouring words: what assigns the value is not among them
    free = F.regexp_replace("before", f"{_ASSIGNED}$", " ")
    columns = {
        "n_chars": F.length("body"), "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "hexadecimal": share("[0-9a-fA-F]"),
        "distinct": F.expr("size(array_distinct(filter(split(body, ''), c -> c <> ''))) / length(body)"),
        "longest_word": longest("[A-Za-z]+"), "longest_digits": longest("[0-9]+"), "slashes": share("/"), "dots": share("[.]"),
        **{n: F.col(f"_l_{n}") for n in NUMBERS[NUMBERS.index("covered") :]},
    }
    words = {"path": F.col("path"), "word_before": F.lower(F.regexp_extract(free, "([A-Za-z]+)[^A-Za-z]*$", 1)), "word_after": F.lower(F.regexp_extract("after", "^[^A-Za-z]*([A-Za-z]+)", 1))}
    named = lex.select(*(F.col(c).alias(f"_l_{c}") for c in lex.columns))
    joined = found.join(named, F.col("body") == F.col("_l_body"), "left")
    return joined.select(*found.columns, *(F.coalesce(columns[n].cast("double"), F.lit(0.0)).alias(f"f_{n}") for n in NUMBERS), *(bucket(words[n]).alias(f"f_{n}") for n in CATEGORIES))


def name_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where none are given by hand: 1 for a value assigned to a secret's name or of a published form,
    else 0; held-out documents left out."""
    return found.filter(remainder(F.col("doc_id"), DIVISOR) != HELD_OUT).withColumn("label", (_named() | F.col("body").rlike(FORMATS)).cast("int"))


def train(labelled: DataFrame, lex: DataFrame, sample: int = SAMPLE) -> PipelineModel | None:
    """A forest from labelled findings (the columns of candidates() and label), at most ``sample`` drawn by hash.

    None if there are not both labels. The sample is one small table in a fixed order, so the forest is repeatable.
    """
    drawn = labelled.filter("label IS NOT NULL").orderBy(F.xxhash64("doc_id", "start", "body"), "doc_id", "start", "body").limit(sample)
    order = [F.xxhash64("doc_id", "start", "body"), "doc_id", "start", "body"]
    drawn = stored(described(drawn, lex).withColumn("label", F.col("label").cast("double")).coalesce(1).sortWithinPartitions(*order), "findings")
    if drawn.select("label").distinct().count() < 2:
        return None
    index = StringIndexer(inputCols=[f"f_{n}" for n in CATEGORIES], outputCols=[f"i_{n}" for n in CATEGORIES], handleInvalid="keep")
    assembler = VectorAssembler(inputCols=[*(f"f_{n}" for n in NUMBERS), *(f"i_{n}" for n in CATEGORIES)], outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED)
    return Pipeline(stages=[index, assembler, forest]).fit(drawn)


def scored(found: DataFrame, lex: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds score (probability of a secret; null without a model) and is_secret (no model removes nothing)."""
    if model is None:
        return found.withColumn("score", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
    out = model.transform(described(found, lex)).withColumn("score", F.round(vector_to_array("_probability")[1], 9))
    return out.select(*found.columns, "score", (F.col("score") >= 0.5).alias("is_secret"))


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """A row for each candidate: doc_id, start, end, masked (its first characters), score, is_secret, held_out.

    ``labelled``: findings with the columns of candidates() and label; without it name_labels() of the documents' own.
    ``held_out`` says whether name_labels() left the document out. Null and empty texts have no candidates; texts and
    candidates of any length are read whole; null ids and paths are allowed; repeated rows are scanned one by one and
    score alike; extra columns are not read; an empty table gives an empty one.
    """
    found = stored(candidates(docs, path), "candidates")
    labels = name_labels(found) if labelled is None else labelled.select(*found.columns, "label")
    lex = lexical(docs.select(docs["text"]), found if labelled is None else found.unionAll(labels.drop("label")))
    out = scored(found, lex, train(labels, lex))
    return out.select("doc_id", "start", "end", F.concat(F.left("body", F.lit(4)), F.lit("...")).alias("masked"), "score", "is_secret", (remainder(F.col("doc_id"), DIVISOR) == HELD_OUT).alias("held_out"))
