"""Secret scans with a random forest that removes false positives.

Every long run of letters, digits and ``+/_-`` with a digit in it is a candidate.
Its length, character transitions, dictionary coverage, path and neighbouring
words go to a random forest trained on labelled findings. The trained trees are
written out as column expressions, so a scan is one pass over the rows without a
shuffle; only the dictionary, the most frequent words of all texts, is counted
beforehand. Built-in functions alone are used, in training as well.

A null or empty text has no findings, a null path none of the path's signs.
Repeated rows are scanned each on its own. Columns that are added replace
columns of the same name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A candidate, and words whose neighbourhood speaks for or against a secret.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
SECRET_WORDS = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential)"
HASH_WORDS = r"(?i)(commit|sha-?\d+|md5|checksum|digest|etag|revision|hash|uuid|\bid\b|integrity|image/|base64)"
SAMPLE_WORDS = r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]|xxxx|fake|redacted|todo)"
TEST_PATHS = r"(?i)(^|[/_.-])(tests?|spec|examples?|samples?|fixtures?|docs?|mock)([/_.-]|$)"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|ri|ro|ic|ne|ea|ra|ce|ch|ie|ei|un|ge|el|la|os|ue"
TURNS = "(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"

#: Characters of the text around a finding that has another one before it in its word.
CONTEXT = 300

#: Bounds of what is fitted: words of the dictionary, and labelled findings of the training set.
DICTIONARY_WORDS = 2000
LABELLED_FINDINGS = 4000
TREES, DEPTH, SEED = 20, 6, 11


def dictionary(df: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of three letters or more, over all texts; ties go to the word that sorts first."""
    found = df.select(F.explode(F.split(F.lower(text_col), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(3, 12))
    counts = found.groupBy("word").count().orderBy(F.desc("count"), "word").limit(words)
    return [r["word"] for r in counts.collect()]


def features(value: Column, before: Column, after: Column, path: Column, known: list[str]) -> dict[str, Column]:
    size = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    parts = F.filter(F.split(F.lower(value), "[^a-z]+"), lambda p: F.length(p) >= 3)
    book = F.array(*[F.lit(w) for w in known]) if known else F.array().cast("array<string>")
    covered = F.aggregate(F.filter(parts, lambda p: F.array_contains(book, p)), F.lit(0), lambda a, p: a + F.length(p))
    return {
        "length": size,
        "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "signs": share("[^A-Za-z0-9]"),
        "turns": share(TURNS), "pairs": F.regexp_count(F.lower(value), F.lit(PAIRS)) / size,
        "variety": F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(32.0)),
        "hex": flag(value.rlike("^[0-9a-fA-F-]+$")), "number": flag(value.rlike("^[0-9-]+$")),
        "uuid": flag(value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "covered": covered / size,
        "test_path": flag(path.rlike(TEST_PATHS)),
        "secret_word": flag(before.rlike(SECRET_WORDS)), "assigned": flag(before.rlike(r"[=:]\s*[\"'`(]?\s*$|(?i)bearer\s*$")),
        "quoted": flag(before.rlike("[\"'`]$")), "hash_word": flag(before.rlike(HASH_WORDS)),
        "sample_word": flag(F.concat_ws(" ", before, value, after).rlike(SAMPLE_WORDS)),
    }


def labelled(spark: SparkSession, known: list[str], rows: int = LABELLED_FINDINGS) -> DataFrame:
    """Labelled findings (before, value, after, path, label) of the usual kinds, made by rule."""
    base = spark.range(rows).withColumn("r", F.xxhash64("id"))
    pick = lambda options, salt: F.element_at(F.array(*map(F.lit, options)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))).cast("int") + 1)
    words = [*(known[:200] or ["word"]), "value", "list", "name", "size", "index", "page"]
    random_hex = F.sha2(F.col("r").cast("string"), 256)
    random_64 = F.translate(F.base64(F.unhex(random_hex)), "+/=", "Ab9")
    key = pick(["token", "TOKEN", "api_key", "apiKey", "secret", "client_secret", "password", "auth_token", "ACCESS_KEY"], "k")
    opens = pick([' = "', " = '", ": ", '="', "=", ': "', " = "], "o")
    length = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(25)).cast("int") + 20
    word = lambda salt: pick(words, salt)
    number = F.translate(F.substring(random_hex, 1, 16), "abcdef", "172839")
    quiet = F.concat_ws(" ", word("a"), word("b"), F.lit(""))
    name = F.concat_ws("_", word("c"), word("d"), word("e"), F.pmod("r", F.lit(100)).cast("string"))
    upper = lambda c: F.when(F.pmod("r", F.lit(5)) == 0, F.upper(c)).otherwise(c)
    kinds = [
        (F.concat_ws(" ", word("a"), F.concat(key, opens)), upper(F.substring(random_hex, 1, 40)), 1),
        (F.concat_ws(" ", word("a"), F.concat(key, opens)), F.substr(random_64, F.lit(1), length), 1),
        (F.concat(key, opens), F.substr(random_hex, F.lit(1), length), 1),
        (F.concat_ws(" ", word("a"), F.lit("Authorization: Bearer ")), random_64, 1),
        (quiet, number, 0),
        (F.concat(pick(["commit", "sha256:", "md5", "etag:", "revision", "checksum =", "id ="], "h"), F.lit(" ")), F.substr(random_hex, F.lit(1), length), 0),
        (F.concat(word("a"), pick([" = ", "(", " ", ": "], "p")), name, 0),
        (F.concat(key, opens), F.concat(pick(["your_api_key_goes_here_", "example_token_value_", "xxxxxxxxxxxxxxxxxxxx", "changeme_placeholder_"], "s"), F.pmod("r", F.lit(9)).cast("string")), 0),
        (quiet, F.substr(random_hex, F.lit(1), length), 0),
        (F.concat_ws(" ", word("a"), F.lit("/static/")), F.concat_ws("/", word("c"), word("d"), F.concat(word("e"), F.pmod("r", F.lit(1000)).cast("string"), F.lit("-build-output"))), 0),
        (F.concat(key, opens), name, 0),
        (quiet, F.concat(word("c"), word("d"), word("e"), F.pmod("r", F.lit(1000)).cast("string"), word("f")), 0),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    chosen = lambda at: F.coalesce(*[F.when(kind == n, k[at]) for n, k in enumerate(kinds)])
    test = F.pmod("r", F.lit(7)) == 0
    label = F.coalesce(*[F.when(kind == n, F.lit(k[2])) for n, k in enumerate(kinds)])
    made = base.select(
        chosen(0).alias("before"), chosen(1).alias("value"), word("g").alias("after"), label.cast("double").alias("label"),
        F.when(test, F.lit("tests/data/config.py")).otherwise(pick(["src0", "src7", "app/config.py", "deploy/env.sh"], "q")).alias("path"),
    )
    return made.where(F.length("value") >= 16)


def train(findings: DataFrame, known: list[str]):
    """A forest over labelled findings (before, value, after, path, label); returns its trees as nested tuples."""
    columns = features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), known)
    rows = findings.select("label", *[c.alias(n) for n, c in columns.items()])
    rows = VectorAssembler(inputCols=list(columns), outputCol="vector").transform(rows)
    forest = RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)
    return [_tree(t._java_obj.rootNode()) for t in forest.trees]


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        counts = list(node.impurityStats().stats())
        return counts[1] / sum(counts)
    cut = node.split()
    return cut.featureIndex(), cut.threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def chance(trees: list, values: list[Column]) -> Column:
    """The forest's mean vote for a secret, as one expression."""

    def walk(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        return F.when(values[node[0]] <= node[1], walk(node[2])).otherwise(walk(node[3]))

    total = walk(trees[0])
    for tree in trees[1:]:
        total = total + walk(tree)
    return total / len(trees)


def findings_of(text: Column, path: Column, trees: list, known: list[str]) -> Column:
    """Array of (at, value, before, after, chance) of a text; ``at`` counts words from 0.

    A word may hold several findings; for those after its first, ``before`` begins
    within the last ``CONTEXT`` characters, and ``after`` is what follows in the word.
    """
    words = F.split(text, r"\s+")
    word = lambda all_, at: F.coalesce(F.get(all_, at), F.lit(""))
    numbered = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    hits = F.filter(numbered, lambda h: h["word"].rlike(CANDIDATE))

    def parsed(h: Column) -> Column:
        whole = h["word"]
        values = F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0))
        return F.struct(h["at"].alias("at"), values.alias("values"), F.split(whole, CANDIDATE).alias("between"))

    def cut(h: Column, value: Column, n: Column) -> Column:
        at, values, between = h["at"], h["values"], h["between"]
        words_before = F.concat(word(words, at - 3), F.lit(" "), word(words, at - 2), F.lit(" "), word(words, at - 1), F.lit(" "))
        start = F.greatest(n - 3, F.lit(0))
        near = F.zip_with(F.slice(between, start + 1, n - start), F.slice(values, start + 1, n - start), lambda b, v: F.concat(b, v))
        inside = F.concat(F.when(n <= 3, words_before).otherwise(""), F.concat_ws("", near), F.get(between, n))
        before = F.when(n == 0, F.concat(words_before, F.get(between, n))).otherwise(F.right(inside, F.lit(CONTEXT)))
        last = F.concat_ws(" ", word(words, at + 1), word(words, at + 2))
        inside = F.concat(F.get(between, n + 1), word(values, n + 1), word(between, n + 2))
        after = F.when(n + 1 == F.size(values), last).otherwise(F.left(inside, F.lit(CONTEXT)))
        return F.struct(at.alias("at"), value.alias("value"), before.alias("before"), after.alias("after"))

    def cuts(h: Column) -> Column:
        return F.transform(h["values"], lambda value, n: cut(h, value, n))

    def marked(c: Column) -> Column:
        found = list(features(c["value"], c["before"], c["after"], path, known).values())
        vector = F.array(*found)
        score = F.transform(F.array(vector), lambda v: chance(trees, [v[n] for n in range(len(found))]))[0]
        return F.struct(*[c[n].alias(n) for n in ("at", "value", "before", "after")], score.alias("chance"))

    found = F.transform(F.flatten(F.transform(F.transform(hits, parsed), cuts)), marked)
    kind = "array<struct<at:int,value:string,before:string,after:string,chance:double>>"
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.array()).cast(kind)


def scan(df: DataFrame, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``df`` with the column findings; those with a chance over one half are taken for secrets."""
    known = dictionary(df, text_col)
    trees = train(labelled(df.sparkSession, known), known)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    return df.withColumn("findings", findings_of(F.col(text_col), path, trees, known))


def redact(df: DataFrame, text_col: str = "text", path_col: str | None = "source", mark: str = "<secret>") -> DataFrame:
    """``df`` with the secrets in its texts replaced by ``mark``."""
    secrets = F.transform(F.filter("findings", lambda f: f["chance"] > 0.5), lambda f: F.struct((-F.length(f["value"])).alias("size"), f["value"].alias("value")))
    # The longest first, as a secret may be part of another.
    clean = F.aggregate(F.array_sort(F.array_distinct(secrets)), F.col(text_col), lambda text, s: F.replace(text, s["value"], F.lit(mark)))
    return scan(df, text_col, path_col).withColumn(text_col, clean).select(*df.columns)
