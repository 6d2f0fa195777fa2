"""Secrets in texts: patterns propose candidates, a random forest on their features removes the false ones."""

from __future__ import annotations

from itertools import groupby

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, located, part, sliced, table

#: Code points of context on each side.
REACH = 32
#: Labelled findings of each class that the forest is fitted on, at most; made-up ones of each form.
FINDINGS, MADE = 6000, 250
TREES, DEPTH, SEED = 30, 8, 7
THRESHOLD = 0.5
#: A value of letters alone, seen in so many different surroundings without a secret's name before it, is wording.
SURROUNDINGS = 5

NAMED = r"(?i:token|secret|passw(?:or)?d|pwd|credential|bearer|auth|(?:api|access|private|client)[_-]?key)"
ASSIGNED = r"[=:]\s*[\"'`]?$"
HARMLESS = r"(?i)(?:sha\d*|md5|commit|checksum|digest|uuid|revision|example|sample|card|order|invoice)"
#: A name of a secret, what assigns it, and a value of 6 characters or more.
_NAME = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9_.-]{{0,24}}?{NAMED}[A-Za-z0-9_.-]{{0,16}}[\"'`]?[ \t]*[=:][ \t]*[\"'`]?"
_VALUE = r"[^\s\"'`,;<>(){}\[\]]{6,}+"
#: Runs of 16 and more of the characters that keys, tokens and hashes are written in.
_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: What stands for a password before the host of an address.
_USER, _PASSWORD = r"://[^\s/:@]{0,64}+:", r"[^\s/@]{4,}+"
CANDIDATE = f"{_USER}{_PASSWORD}(?=@)|{_NAME}{_VALUE}|{_RUN}"
#: The most frequent words of the corpus that its dictionary takes, and their length.
WORDS, WORD = 2000, r"(?<![\p{L}\p{N}_+/=-])\p{Ll}{3,12}+(?![\p{L}\p{N}_+/=-])"
#: Parts of names and prose that random strings lack; what the corpus uses comes on top.
DICTIONARY = (
    "the and for with that this from have not you all was are name file data test user value type class index list page image style "
    "key time date text line code http html main home node item path size color width block version number string table "
    "ing tion ment ent der und sch ung eur que les des con ado ara ión ter her ere est ver ein ich ati ous ble"
).split()

FEATURES = ["length", "vowels", "dots", "digits", "uppers", "symbols", "hex", "distinct", "changes", "words", "path", "named", "assigned", "quoted", "harmless"]


def _tree(words: list[str]) -> str:
    """A pattern for the longest of words at a place, with their beginnings shared; words hold letters only."""
    rest = sorted({w for w in words if w})
    if not rest:
        return ""
    branches = [head + _tree([w[1:] for w in group]) for head, group in groupby(rest, key=lambda w: w[0])]
    return f"(?:{'|'.join(branches)})" + ("?" if "" in words else "")


def dictionary(docs: DataFrame, found: DataFrame) -> list[str]:
    """DICTIONARY and the WORDS most frequent words of docs (key, text), ties by code point; at most WORDS rows reach the driver.

    What stands in a found value (value, before) after a secret's name or in an address is left out, so that a shared password is no word for being shared.
    """
    runs = lambda c, pattern: F.explode(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))).alias("word")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = found.where(F.col("before").rlike(f"{NAMED}.{{0,24}}{ASSIGNED}") | F.col("before").rlike(f"{_USER}$"))
    counted = docs.select(runs(text, WORD)).groupBy("word").agg(F.count("*").alias("n"))
    top = counted.join(kept.select(runs(F.col("value"), r"\p{Ll}{3,}+")).distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(WORDS)
    return sorted({*DICTIONARY, *(r["word"] for r in top.collect())})


def features(value: Column, before: Column, after: Column, known: list[str] = DICTIONARY) -> dict[str, Column]:
    """The numbers that the forest sees; shares are of the candidate's length. known: the words of the dictionary."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    left = F.regexp_replace(F.lower(value), _tree(known), "")
    return {
        "length": F.least(n, F.lit(200.0)), "vowels": share("(?i)[aeiou]"), "dots": share("[.:]"),
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "symbols": share("[^A-Za-z0-9]"), "hex": share("[0-9a-f]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
        "changes": share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "words": 1 - F.length(left) / n,
        "path": flag(value.contains("/") | before.rlike(r"[/\\.]$|://\S*$") | after.rlike(r"^[/\\.][a-z]")),
        "named": flag(before.rlike(NAMED)), "assigned": flag(before.rlike(ASSIGNED)),
        "quoted": flag(before.rlike("[\"'`]\\z") & after.rlike("^[\"'`]")), "harmless": flag(before.rlike(HARMLESS)),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """docs (key, text) -> key, start, end, value, before, after: a row for each candidate, with its neighbouring words.

    A candidate is a password of 4 and more characters in an address, what is assigned to a secret's name, from 6 characters on, or else a run of 16 and
    more key characters.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def rows(slices: Column) -> Column:
        def row(m: Column) -> Column:
            inner = F.when(m["text"].startswith("://"), F.regexp_extract(m["text"], f"^{_USER}({_PASSWORD})$", 1)).otherwise(F.regexp_extract(m["text"], f"^{_NAME}({_VALUE})$", 1))
            value = F.when(inner != "", inner).otherwise(m["text"])
            start = m["end"] - F.length(value)
            return F.struct(
                start.alias("start"), m["end"].alias("end"), value.alias("value"),
                part(slices, F.greatest(start - REACH, F.lit(0)), start).alias("before"), part(slices, m["end"], m["end"] + REACH).alias("after"),
            )

        return F.transform(located(text, CANDIDATE), row)

    return docs.select("key", F.explode(let(sliced(text), rows)).alias("c")).select("key", "c.*")


def planted(spark: SparkSession, seed: int = 0, forms: int = MADE, known: list[str] = DICTIONARY) -> DataFrame:
    """(value, before, after, label): made-up findings whose labels are known because they were made so, forms of each kind, of words of known.

    Secrets: digests, keys and passwords, assigned or not. Others: digests that surroundings name as such, names, paths, dates, card numbers,
    placeholders, and code or prose that is assigned to a secret's name. Both kinds come in the same surroundings as well, and in addresses.
    """
    i = F.col("i")
    base = spark.range(forms).select(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")).alias("i"))
    num = lambda k, n: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(n)).cast("int")
    pick = lambda k, xs: F.get(F.array(*map(F.lit, xs)), num(k, len(xs)))
    word = lambda k: F.get(F.split(F.lit(" ".join(known)), " "), num(k, len(known)))
    raw = lambda k: F.base64(F.unhex(F.sha2(F.concat(i, F.lit(k)), 256)))
    secret_name = pick("n", ["token", "api_key", "secret", "password", "AWS_SECRET_ACCESS_KEY", "client-key", "db_passwd", "access_key", "auth_token"])
    sign = pick("s", [" = ", "=", ": ", ":", " : "])
    quote = pick("q", ['"', "'", "", "`"])
    named = F.concat(pick("p", ["", "export ", "the ", "  ", "final "]), secret_name, sign, quote)
    plain = F.concat(word("b"), F.lit(" "), word("c"), F.lit(" "))
    after = pick("a", [" ", "\n", " and ", ", "])
    secrets = [
        F.sha1(F.concat(i, F.lit("h"))), raw("r"), F.upper(F.substring(F.regexp_replace(raw("u"), "[^A-Za-z0-9]", "Q"), 1, 20)),
        F.substring(F.regexp_replace(raw("m"), "[^A-Za-z0-9]", "x"), 1, 32), F.md5(F.concat(i, F.lit("d"))),
        F.concat(F.initcap(word("w")), pick("y", ["!", "@", "#", "$", "_", "-"]), num("z", 9000).cast("string"), word("v")),
        F.substring(raw("t"), 1, 12),
    ]
    wording = [
        F.concat_ws("_", *map(word, "123456")), F.concat(word("1"), F.initcap(word("2")), F.initcap(word("3")), F.initcap(word("4")), F.initcap(word("5")), F.initcap(word("6"))),
        F.concat_ws("/", *map(word, "123456"), i), F.concat(F.lit("2024-01-"), (num("d", 20) + 10).cast("string"), F.lit("-"), word("1"), F.lit("-"), word("2")),
        F.lpad((F.xxhash64(i).bitwiseAND(2**52 - 1)).cast("string"), 16, "4"), F.concat_ws("-", *map(word, "1234567")),
    ]
    filler = [
        pick("f", ["changeme", "xxxxxxxx", "required", "optional", "undefined", "********", "os.environ", "getpass", "string", "your-token-here", "<redacted>", "placeholder", "disabled", "request.form"]),
        F.concat(word("1"), word("2"), word("3")), F.concat(word("1"), F.lit("."), word("2"), word("3")), F.concat_ws("_", word("1"), word("2"), word("3")),
    ]
    digest = pick("g", ["commit ", "sha1: ", "md5 ", "checksum: ", "revision ", "digest = ", "uuid "])
    kinds = [(v, named, F.concat(quote, after), 1) for v in secrets] + [(v, plain, after, 1) for v in secrets[1:4]]
    kinds += [(v, plain, after, 0) for v in wording] + [(v, named, F.concat(quote, after), 0) for v in [*filler, *wording[:2]]]
    kinds += [(v, F.concat(plain, digest), after, 0) for v in (secrets[0], secrets[4])]
    address = F.concat(plain, pick("h", ["postgres", "https", "redis", "amqp", "mysql"]), F.lit("://"), word("o"), F.lit(":"))
    kinds += [(v, address, F.lit("@host"), 1) for v in (secrets[3], secrets[5], secrets[6])] + [(v, address, F.lit("@host"), 0) for v in filler[:2]]
    kinds += [(wording[2], F.lit("https://"), F.lit(".html"), 0), (wording[4], F.lit("card "), after, 0)]
    each = F.explode(F.array(*[F.struct(v.alias("value"), b.alias("before"), a.alias("after"), F.lit(y).alias("label")) for v, b, a, y in kinds]))
    return base.select(each.alias("c")).select("c.*")


def labelled_findings(found: DataFrame, known: list[str] = DICTIONARY) -> DataFrame:
    """(value, before, after, label): planted findings, and found values (key, value, before, after) that are wording of the corpus.

    Wording has no digit, stands in several surroundings and never follows a secret's name. How often a value is copied is no ground for a
    label: a secret that leaks into many documents stays one.
    """
    plain = found.where(F.col("value").rlike("^[A-Za-z_/-]+$")).groupBy("value").agg(
        F.count_distinct("before", "after").alias("kinds"), F.bool_or(F.col("before").rlike(NAMED)).alias("named"), F.min(F.struct("before", "after")).alias("one")
    )
    own = plain.where((F.col("kinds") >= SURROUNDINGS) & ~F.col("named")).select("value", "one.before", "one.after", F.lit(0).alias("label"))
    return own.union(planted(found.sparkSession, known=known))


def fit_forest(labelled: DataFrame, known: list[str] = DICTIONARY) -> RandomForestClassificationModel:
    """A forest from labelled findings (value, before, after, label 0 or 1): of each class the FINDINGS of smallest hash, so that reruns agree."""
    rows = labelled.where("label in (0, 1)")
    sample = None
    for y in (0, 1):
        own = rows.where(F.col("label") == y).orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after").limit(FINDINGS)
        sample = own if sample is None else sample.union(own)
    data = sample.select(F.col("label").cast("double").alias("label"), *[c.alias(k) for k, c in features(F.col("value"), F.col("before"), F.col("after"), known).items()])
    data = cut(data.repartition(1).sortWithinPartitions("label", *FEATURES))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs (id, text) -> id, n_candidates, n_secrets, spans (secret:start:end, in code points), scores.

    labelled: findings that people have judged (value, before, after, label); without, those of labelled_findings. Null and empty
    texts: no candidates. Repeated rows, and rows alike in id and text: the same result for each. Long texts are searched whole. Candidates with equal
    scores keep the order of the text. Only id and text are read, so other columns can have any name. Empty input: no rows.
    """
    keyed = docs.select("id", "text", F.xxhash64("id", "text").alias("key"))
    found = cut(candidates(keyed.select("key", "text")).distinct())
    known = dictionary(docs, found)
    model = fit_forest(labelled if labelled is not None else labelled_findings(found, known), known)
    rated = found.select("key", "start", "end", *[c.alias(k) for k, c in features(F.col("value"), F.col("before"), F.col("after"), known).items()])
    rated = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rated))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 4)
    per = rated.select("key", "start", "end", score.alias("score")).groupBy("key").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("score") >= THRESHOLD, F.struct("start", "end", "score")))).alias("s")
    )
    joined = keyed.select("id", "key").join(per, "key", "left")
    some = F.coalesce("s", F.lit([]).cast("array<struct<start:int,end:int,score:double>>"))
    return joined.select(
        "id", F.coalesce("n", F.lit(0)).alias("n_candidates"), F.size(some).cast("long").alias("n_secrets"),
        F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.lit("secret"), s["start"], s["end"])), ",").alias("spans"),
        F.array_join(F.transform(some, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op10_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return scan_secrets(docs).withColumnRenamed("id", "doc_id")
