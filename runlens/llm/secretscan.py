"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are found anywhere in a text.  What a name is assigned by ``=`` or ``:`` is
one from ``GIVEN`` characters up, whatever they are: it ends at white space, at a quote,
or where a separator begins the next assignment.  Elsewhere every run of secret-like
characters is one from ``LEAST`` up.  A token between white space has any number of
them, told apart by ``at``.  Their features are the length, the character
transitions (mean log probability of the letter pairs under the corpus' own
words, changes between character kinds, variety), the share of the characters in
dictionary words (words of the corpus found in enough places), path marks, and
the neighbouring words (how often each word stands beside labelled secrets).

The forest is trained on labelled findings.  ``label_findings`` makes labels from
sure signs only: a provider's key format, or a value assigned to a credential's
name, is a secret; placeholders, and outside such places addresses, paths,
numbers and words without a digit, are not; the rest has no label and is not learned from.
Other labels can be given instead.

Word counts, letter pairs and neighbours are counted over all documents that
may be learned from; only the forest is fitted on a sample, of at most
``SAMPLE`` findings of each label, in hash order.

Only DataFrame functions and the JVM's forest are used.  Defined results: null and empty texts have no candidates; repeated rows repeat their
findings; when one of the labels is missing, every candidate scores the
share of positive labels (0 without labels); other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

LEAST = 12  # characters of a candidate without a name
GIVEN = 6  # characters of a value assigned to a name
SAMPLE = 20_000  # labelled findings of each label that the forest is fitted on
KNOWN = 20  # places in which a dictionary word stands
TREES, DEPTH, SEED = 40, 8, 11
_SPACE = r"[\x20\x09-\x0D]+"
_RUN = rf"[A-Za-z0-9+/_~.@%=-]{{{LEAST},}}+"
_WORD, _QUOTE, _OTHER = r"[A-Za-z_][A-Za-z0-9_.-]{0,63}+", r"\\?[\"'`]?", r"[^\s\"'`]"
_ASSIGNED = rf"(?<![A-Za-z0-9_.-])[.-]*+({_WORD}){_QUOTE}[=:]++>?{_QUOTE}(?!//)({_OTHER}{{{GIVEN},}}+)"
#: A separator in front of an assignment.
_NEXT = rf"([&,;|?#{{}}\[(\\])(?={_QUOTE}[.-]*+{_WORD}{_QUOTE}[=:])"
#: Key formats that providers publish, and names that credentials are assigned to.
FORMATS = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^sk-[A-Za-z0-9_-]{20,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[0-9A-Za-z_-]{35}$|^glpat-[A-Za-z0-9_-]{20}$|^eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\.[A-Za-z0-9_=.+/-]*$"
NAMES = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
PLACEHOLDER = r"(?i)example|placeholder|changeme|xxxx|your[_-]|dummy|sample|\*\*\*"
NUMBERS = ["length", "digits", "uppers", "lowers", "symbols", "variety", "hexlike", "kind_changes", "case_changes", "vowels", "pairs", "coverage", "slashes", "dots", "ats", "assigned", "before_risk", "name_risk", "after_risk"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos (of the token), at (among the token's candidates), value, name (assigned to, or null), before, after (neighbouring words, lower case)."""
    tokens = F.split(F.trim(F.col("text")), _SPACE)
    word = lambda i: F.coalesce(F.get("t", i), F.lit(""))

    def may_hold(i):
        token, n = word(i), F.length(word(i))
        return (n >= GIVEN) & (F.substring(word(i - 1), -1, 1).isin("=", ":", ">") | ((n >= LEAST) & token.rlike(_RUN)) | (token.rlike("[=:]") & token.rlike(_ASSIGNED)))

    held = F.filter(F.sequence(F.lit(0), F.size("t") - 1), may_hold)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") >= GIVEN).select("doc_id", tokens.alias("t"))
    found = rows.select("doc_id", F.explode(F.transform(held, lambda i: F.struct(
        i.alias("pos"), word(i).alias("token"), word(i - 1).alias("b1"), word(i - 2).alias("b2"), word(i + 1).alias("after")))).alias("c"))
    found = found.select("doc_id", "c.*", F.regexp_replace("c.token", _NEXT, "$1 ").alias("parted"))
    found = found.withColumns({"names": F.regexp_extract_all("parted", F.lit(_ASSIGNED), F.lit(1)), "values": F.regexp_extract_all("parted", F.lit(_ASSIGNED), F.lit(2))})
    own = lambda name, value: F.struct(name.cast("string").alias("name"), value.alias("value"))
    ended = lambda v: F.regexp_replace(v, r"[.=%,;:)\]}>&|\\-]+$", "")
    # assigned inside the token, or to the token by the ones before it
    inside = F.transform("values", lambda v, i: own(F.get("names", i), ended(v)))
    ahead = F.nullif(F.regexp_extract("b1", rf"({_WORD}){_QUOTE}[=:]+>?$", 1), F.lit(""))
    name = F.when(F.col("b1").isin("=", ":", ":=", "=>"), F.col("b2")).otherwise(ahead)
    apart = own(name, ended(F.regexp_extract("token", rf"^[\"'`(<\[{{\\]*({_OTHER}{{{GIVEN},}}+)", 1)))
    given = F.when(F.size("values") > 0, inside).when(name.isNotNull(), F.array(apart)).otherwise(inside)
    found = found.withColumn("given", F.filter(given, lambda c: F.length(c["value"]) >= GIVEN))
    runs = F.transform(F.regexp_extract_all("token", F.lit(_RUN), F.lit(0)), lambda v: F.regexp_replace(F.regexp_replace(v, r"[.=%-]+$", ""), rf"^[.-]*{_WORD}=+", ""))
    runs = F.filter(runs, lambda v: (F.length(v) >= LEAST) & ~F.array_contains(F.col("given.value"), v))
    found = found.select("*", F.posexplode(F.concat("given", F.transform(runs, lambda v: own(F.lit(None), v)))).alias("at", "one"))
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")
    before = F.when(F.col("b1").rlike(r"^[=:]+>?$"), F.col("b2")).otherwise(F.col("b1"))
    return found.select("doc_id", "pos", "at", F.col("one.value").alias("value"), plain(F.col("one.name")).alias("name"), plain(before).alias("before"), plain(F.col("after")).alias("after"))


def words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): lower-case runs of letters, over all texts."""
    runs = F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+"))
    return docs.select(runs.alias("word")).where(F.length("word").between(2, 40)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def letter_pairs(counts: DataFrame) -> DataFrame:
    """(pair, lp): log probability of a letter given the one before (a to z), over all words."""
    ascii_words = counts.where(F.col("word").rlike("^[a-z]+$"))
    pairs = ascii_words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    table = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    lead = table.groupBy(F.substring("pair", 1, 1).alias("lead")).agg(F.sum("n").alias("total"))
    return table.join(lead, F.substring("pair", 1, 1) == F.col("lead")).select("pair", F.log((F.col("n") + 0.5) / (F.col("total") + 13)).alias("lp"))


def label_findings(found: DataFrame) -> Column:
    """1.0 for a secret, 0.0 for none, null where nothing is sure."""
    value = F.col("value")
    empty = value.rlike(PLACEHOLDER)
    sure = value.rlike(FORMATS) | (F.col("name").rlike(NAMES) & value.rlike("[0-9]"))
    clean = value.rlike(r"^[A-Za-z]+([._/-][A-Za-z]+)*$|@|^[A-Za-z]*://|^[0-9.-]+$") & ~F.coalesce(F.col("name").rlike(NAMES), F.lit(False))
    return F.when(empty, 0.0).when(F.coalesce(sure, F.lit(False)), 1.0).when(clean | ~value.rlike("[0-9]"), 0.0)


def _risk(table: DataFrame, column: str) -> DataFrame:
    """(word, risk): smoothed log odds of the label beside each word."""
    own = table.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias(f"{column}_word"))
    return own.agg(F.log((F.sum("label") + 0.5) / (F.sum(1 - F.col("label")) + 0.5)).alias(f"{column}_risk"))


def features(found: DataFrame, counts: DataFrame, labelled: DataFrame) -> DataFrame:
    """``found`` with the columns ``NUMBERS``; ``found`` holds a unique ``fid``."""
    value, n = F.col("value"), F.length("value")
    share = lambda p: F.regexp_count("value", F.lit(p)) / n
    f = found.withColumns({
        "length": n.cast("double"), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "symbols": share("[^A-Za-z0-9]"),
        "variety": F.size(F.array_distinct(F.split(value, ""))) / n, "hexlike": share("[0-9a-f]"), "vowels": share("[aeiouAEIOU]"),
        "kind_changes": F.regexp_count("value", F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) / n,
        "case_changes": F.regexp_count("value", F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / n,
        "slashes": share("/"), "dots": share(r"\."), "ats": share("@"), "assigned": F.col("name").isNotNull().cast("double"),
    })
    # letter pairs and words of the candidates are looked up by joins: the tables may be of any size
    lower = F.lower("value")
    pair = f.select("fid", F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(lower, i, F.lit(2)))).alias("pair"))
    mean = pair.join(letter_pairs(counts), "pair", "left").groupBy("fid").agg(F.avg(F.coalesce("lp", F.lit(-8.0))).alias("pairs"))
    run = f.select("fid", "length", F.explode(F.regexp_extract_all(lower, F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    known = run.join(counts.where(F.col("n") >= KNOWN).select("word"), "word").groupBy("fid").agg((F.sum(F.length("word")) / F.first("length")).alias("coverage"))
    f = f.join(mean, "fid", "left").join(known, "fid", "left")
    for c in ("before", "name", "after"):
        risk = _risk(labelled, c)
        f = f.join(risk, F.col(c) == risk[f"{c}_word"], "left").drop(f"{c}_word")
    return f.fillna(0.0, subset=NUMBERS)


def fit(rows: DataFrame):
    """The forest, or the share of positive labels where a label is missing; ``rows``: NUMBERS, label, fid."""
    order = F.xxhash64("value", "before", "after")
    some = [rows.where(F.col("label") == x).orderBy(order, "fid").limit(SAMPLE) for x in (0.0, 1.0)]
    sample = materialise(some[0].unionByName(some[1]).select(*NUMBERS, "label"), "sample")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return 1.0 if 1.0 in n else 0.0
    frame = VectorAssembler(inputCols=NUMBERS, outputCol="features").transform(sample.orderBy(*NUMBERS, "label").coalesce(1))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(frame)


def scan(docs: DataFrame, learn: Column | None = None, label=label_findings, threshold: float = 0.5) -> DataFrame:
    """doc_id, pos, at, value, label, score, secret per candidate.

    ``learn``: a condition on doc_id, of the documents that may be learned from (all);
    ``label``: candidates -> their label column.
    """
    own = docs.select("doc_id", "text")
    learn = F.lit(True) if learn is None else learn
    found = candidates(own)
    found = found.withColumn("fid", F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "pos", "value", F.coalesce("name", F.lit("")), "before", "after"))))
    found = materialise(found.withColumns({"label": label(found), "learned": F.coalesce(learn, F.lit(False))}), "found")
    counts = materialise(words(own.where(learn)), "words")
    unique = found.dropDuplicates(["fid"])
    rows = materialise(features(unique, counts, found.where("learned and label is not null")).select("fid", "value", "before", "after", "label", "learned", *NUMBERS), "features")
    model = fit(rows.where("learned and label is not null"))
    if isinstance(model, float):
        scored = rows.select("fid", F.lit(model).alias("score"))
    else:
        frame = VectorAssembler(inputCols=NUMBERS, outputCol="features").transform(rows)
        scored = model.transform(frame).select("fid", vector_to_array("probability")[1].alias("score"))
    out = found.select("doc_id", "pos", "at", "value", "label", "fid").join(scored, "fid")
    return out.select("doc_id", "pos", "at", "value", "label", "score", (F.col("score") >= threshold).alias("secret"))
