"""Secret scans: candidates from one pattern, judged by a random forest trained on labelled findings.

Everything is DataFrame and SQL functions: the pattern, the features, and the forest of pyspark.ml, which runs in
the JVM. A candidate is a maximal run of at least 12 characters of ``[A-Za-z0-9+/_=.-]`` with a digit; names and ``=`` that lead such a run
(``api_key=...``, ``?token=...``) are not part of it. After a credential name and ``=``, ``:`` or ``=>`` a candidate is any value of at least ``SHORTEST``
characters, to the next space or quote, without quotes also to the next of ``,;&<>()[]{}``. A credential name that is assigned to is none. Its features:

* length, share of hexadecimal characters, digits and upper case;
* transitions between character classes (vowel, consonant, upper case, digit, symbol), all 25 rates;
* dictionary coverage: the share made of the ``WORDS`` most common words of the whole corpus, three to eight letters long;
* path: depth, length, and whether it names tests or examples (the ``source`` of a document stands for its path);
* neighbouring words: assignment, quotes, a credential word close before, common words on both sides.

Labelled findings are candidates with a boolean ``label``. At most ``sample`` of each label train the forest (those of the
smallest hash); it then scores every candidate. Where no reviewed findings are given, ``provisional_labels`` marks those
assigned to a credential name and leaves all others as false positives.

Defined results: null and empty texts have no candidates; repeated rows report their findings each; with only one label among the
findings the label decides and the score is 0 or 1; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from itertools import product

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import pin, thinned

RUN = "A-Za-z0-9+/_=.\\-"
NAMES = "token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth"
ASSIGNED = f"(?i)(?:{NAMES})[\"']?\\s*(?:=|:|=>)\\s*[\"']?$"
SHORTEST = 6
#: a credential name with what assigns to it, right before; the looks at one and few characters only spare the costly one
_NAMED = f"(?<=[=:>\\s\"'])(?<=[=:>]\\s{{0,16}}[\"']?)(?<=(?i:{NAMES})[\"']?\\s{{0,16}}(?:=>|=|:)\\s{{0,16}}"
_VALUE = f"{_NAMED}[\"'])[^\\s\"']{{{SHORTEST},}}+|{_NAMED})(?![=:>])[^\\s\"',;&<>()\\[\\]{{}}]{{{SHORTEST},}}+"
_PART = "[A-Za-z0-9+/_.\\-]"
_RUN = (f"(?:(?<![{RUN}])|(?<={_PART}=))(?!{_PART}++=(?!=)[{RUN}]{{12}})(?!{_PART}++(?<=(?i:{NAMES}))[\"']?\\s*+[=:])"
        f"(?=[{RUN}&&[^0-9]]*+[0-9])[{RUN}]{{12,}}+")
CANDIDATE = f"{_VALUE}|{_RUN}"
#: what any text with a candidate has
LIKELY = f"[0-9]|(?i:{NAMES})[\"']?\\s*[=:]"
WORDS, SAMPLE = 1000, 10_000
TREES, DEPTH, SEED = 20, 6, 17
BEFORE, AFTER = 60, 40


def dictionary(documents: DataFrame, words: int = WORDS) -> list[str]:
    """The most common short words of all texts; a fixed number of them."""
    every = documents.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("word"))
    rows = (every.where("length(word) BETWEEN 3 AND 8").groupBy("word").count()
            .orderBy(F.desc("count"), "word").limit(words).collect())
    return [r["word"] for r in rows]


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, path, nth, start, value, before, after); start in code points from 0."""
    path = F.col("source").cast("string") if "source" in documents.columns else F.lit("")
    found = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"),
                              F.col("text").cast("string").alias("text"))
             .where(F.rlike("text", F.lit(LIKELY)))  # far cheaper than the pattern, and none can match without
             .withColumn("hits", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where("size(hits) > 0")
             .withColumn("gaps", F.split("text", CANDIDATE, -1)).drop("text"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    places = F.transform("hits", lambda value, i: F.struct(
        i.alias("nth"), (total(F.slice("gaps", F.lit(1), i + 1)) + total(F.slice("hits", F.lit(1), i))).alias("start"), value.alias("value"),
        F.right(F.get("gaps", i), F.lit(BEFORE)).alias("before"), F.left(F.get("gaps", i + 1), F.lit(AFTER)).alias("after")))
    return found.select("doc_id", "path", F.inline(places))


def provisional_labels(found: DataFrame) -> DataFrame:
    return found.withColumn("label", F.rlike("before", F.lit(ASSIGNED)))


def _classes(value: Column) -> Column:
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    to = "".join("v" if x in "aeiouy" else "c" for x in lower) + "U" * 26 + "0" * 10 + "s" * 6
    return F.regexp_replace(F.translate(value, lower + upper + digits + "+/_=.-", to), "[^vcU0s]", "s")


def features(found: DataFrame, words: list[str]) -> tuple[DataFrame, list[str]]:
    value, before, after, path = (F.col(c) for c in ("value", "before", "after", "path"))
    size = F.length(value).cast("double")
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    listed = "|".join(sorted(words, key=lambda w: (-len(w), w))) or "(?!)"
    common = "(?i)\\b(?:" + ("|".join(sorted(words[:100])) or "(?!)") + ")\\b"
    made = {
        "f_length": size,
        "f_hex": count(value, "[0-9a-fA-F]") / size, "f_digit": count(value, "[0-9]") / size, "f_upper": count(value, "[A-Z]") / size,
        "f_dictionary": 1 - F.length(F.regexp_replace(F.lower(value), listed, "")) / size,
        "f_depth": count(path, "/"), "f_path_length": F.length(path).cast("double"),
        "f_path_test": F.rlike(path, F.lit("(?i)test|example|sample|mock|fixture")).cast("double"),
        "f_assigned": F.rlike(before, F.lit("[=:]\\s*[\"']?$")).cast("double"),
        "f_quoted": (F.rlike(before, F.lit("[\"']$")) & F.rlike(after, F.lit("^[\"']"))).cast("double"),
        "f_named": F.rlike(before, F.lit(f"(?i)(?:{NAMES})(?:\\W+\\w+)?\\W*$")).cast("double"),
        "f_at": F.rlike(before, F.lit("[@:]//?$|@$")).cast("double") + F.rlike(after, F.lit("^@")).cast("double"),
        "f_words_before": count(before, common), "f_words_after": count(after, common),
    }
    steps = {f"f_{a}{b}": count(F.col("classes"), f"(?={a}{b})") / size for a, b in product("vcU0s", repeat=2)}
    return found.withColumn("classes", _classes(value)).withColumns(made | steps).drop("classes"), [*made, *steps]


def train(findings: DataFrame, words: list[str], sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """A forest from findings with a boolean label, or None when only one label occurs."""
    key = F.xxhash64("doc_id", "nth", "value")
    sides = [findings.where(F.col("label") == x) for x in (True, False)]
    chosen = [thinned(side, key, sample, side.count()).orderBy(key, "doc_id", "nth", "value").limit(sample) for side in sides]
    rows, names = features(chosen[0].unionByName(chosen[1]), words)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows).withColumn("label", F.col("label").cast("double"))
    if data.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(data.select("features", "label"))


def secret_scan(documents: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Every candidate with its score and verdict. ``findings`` has the columns of ``candidates`` and a label."""
    words = dictionary(documents)
    found = pin(candidates(documents))  # small, and read several times
    labelled = provisional_labels(found) if findings is None else findings
    model = train(labelled, words, sample)
    plain = [F.col(c) for c in ("doc_id", "nth", "start", "value")]
    if model is None:
        scored = provisional_labels(found).select(*plain, F.col("label").cast("double").alias("score"))
    else:
        rows, names = features(found, words)
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
        scored = model.transform(vectors).select(*plain, F.round(vector_to_array("probability")[1], 9).alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= 0.5)


def digest(documents: DataFrame) -> DataFrame:
    return secret_scan(documents).select("doc_id", F.col("nth").alias("finding"), F.col("start").cast("long").alias("start"),
                                         F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
