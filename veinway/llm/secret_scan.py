"""Secret scans whose false positives a random forest removes, on DataFrame functions only.

Candidates are private-key blocks, values behind a credential's name, passwords in URLs, signed
tokens, and runs of key-like characters. Every occurrence is judged with its own surroundings:
length, character transitions, dictionary coverage, path characters and neighbouring words are
native columns, and a forest trained on labelled findings tells secrets from checksums,
identifiers, numbers and long words. A candidate is a secret if one of its occurrences is.
"""

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinway.llm.common import pinned
from veinway.llm.near_dedup import row_key

#: Marks around candidates: two code points that are no characters; in a text they count as U+FFFD.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
NAME = r"(?:passw\w{0,12}|passwd|pwd|token|secret|(?:api|access|private|secret)[_-]?key|auth\w{0,12}|credentials?)"
#: What stands before a value, the value; before a password in a URL, the password; a private key. No length is too long.
NAMED = (
    rf"((?i:{NAME})[\"']?\s{{0,3}}(?:=>|[:=])\s{{0,3}}[\"']?)([^\s\"'<>,;(){{}}]{{8,}}+)"
    r"|(://[^\s:@/]++:)([^\s@/]{4,}+)(?=@)"
    r"|(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+-----END [A-Z ]{0,20}PRIVATE KEY-----)"
)
#: Signed tokens; runs with a digit; long runs with a capital inside.
RUNS = (
    r"(?<![A-Za-z0-9+/_.-])(?:eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{12,}={0,2}"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z][a-z+/_-]*[A-Z])[A-Za-z+/_-]{24,}={0,2}"
)
#: Words that make a string look like a name rather than a key.
DICTIONARY = (
    "account address admin backup branch build button cache chapter class client code column commit company config content count "
    "create customer data date default delete demo document event example field file filter format function group header image index "
    "input invoice item label level line link list local login main manager message model module name node number object option order "
    "output page param part path picture place plan point print product project query read record region release report request result "
    "root sample section server service session setting source start state status step store string style summary system table target "
    "task template test text time title type update user value version video view window word"
).split()
#: Names before a credential, and words beside strings that are none.
CREDENTIAL = r"(?i)(?:passw\w*|passwd|pwd|token|secret|key|auth\w*|bearer|credential\w*)[\"']?\s{0,3}[:=]?\s{0,3}[\"']?$"
HARMLESS = r"(?i)(?:commit|sha\d*|md5|checksum|digest|hash|uuid|guid|id|version|etag|build|isbn|card|order|ref|revision|file|example)\b[\"']?\s{0,3}[:=#]?\s{0,3}[\"']?$"
FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "letter_digit", "digit_letter", "lower_upper", "upper_lower", "same", "distinct",
    "hex_only", "digits_only", "vowel_pairs", "dictionary", "path", "named", "assigned", "quoted", "in_url", "harmless", "key_prefix",
]


def candidates(docs: DataFrame, by: list[str]) -> DataFrame:
    """(by, row, candidate, at, start, before, after): one row per occurrence of a candidate.

    `at` counts the candidates of a row of docs from 1; start, right in the first row of a candidate,
    is its place in code points from 0. Null and empty texts have no candidates; a document that is given
    twice has its candidates twice.
    """
    text = F.regexp_replace(F.translate("text", OPEN + CLOSE, "\ufffd\ufffd"), NAMED, f"$1$3{OPEN}$2$4$5{CLOSE}")
    # what is marked stays so, and gets an empty mark behind it, which goes again
    text = F.replace(F.regexp_replace(text, f"({OPEN}[^{CLOSE}]*{CLOSE})|({RUNS})", f"$1{OPEN}$2{CLOSE}"), F.lit(OPEN + CLOSE), F.lit(""))
    found = docs.select(*by, F.monotonically_increasing_id().alias("row"), text.alias("marked")).filter(F.contains("marked", F.lit(OPEN)))
    parts = F.split("marked", OPEN)
    each = F.arrays_zip(F.slice("parts", F.lit(2), F.size("parts") - 1), F.col("parts"), F.slice("parts", F.lit(3), F.greatest(F.size("parts") - 2, F.lit(0))))
    found = found.withColumn("parts", parts).select(*by, "row", "marked", F.posexplode(each).alias("at", "p")).filter("p.`0` IS NOT NULL")
    own, before, following = (F.col(f"p.`{c}`") for c in ("0", "parts", "2"))
    candidate = F.substring_index(own, CLOSE, 1)
    after = F.concat(F.substring_index(own, CLOSE, -1), F.coalesce(F.replace(following, F.lit(CLOSE), F.lit("")), F.lit("")))
    return found.select(
        *by, "row", candidate.alias("candidate"), (F.col("at") + 1).alias("at"),
        (F.position(F.concat(F.lit(OPEN), candidate, F.lit(CLOSE)), F.col("marked")) - 1 - 2 * F.col("at")).cast("long").alias("start"),
        F.right(F.replace(before, F.lit(CLOSE), F.lit("")), F.lit(40)).alias("before"), F.left(after, F.lit(20)).alias("after"),
    )


def with_features(found: DataFrame) -> DataFrame:
    """Adds the columns of FEATURES to rows with candidate, before and after."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    length = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / length
    flag = lambda test: test.cast("double")
    lower = F.lower(c)
    words = "|".join(DICTIONARY)
    values: dict[str, Column] = {
        "length": length,
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "others": share("[^A-Za-z0-9]"),
        "letter_digit": share("(?<=[A-Za-z])(?=[0-9])"), "digit_letter": share("(?<=[0-9])(?=[A-Za-z])"),
        "lower_upper": share("(?<=[a-z])(?=[A-Z])"), "upper_lower": share("(?<=[A-Z])(?=[a-z])"), "same": share(r"(.)(?=\1)"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / length,
        "hex_only": flag(lower.rlike("^[0-9a-f]+$")), "digits_only": flag(c.rlike("^[0-9_+/-]+$")),
        "vowel_pairs": F.regexp_count(lower, F.lit("[aeiou][b-df-hj-np-tv-z]")) / length,
        "dictionary": 1 - F.length(F.regexp_replace(lower, words, "")) / length,
        "path": flag(before.rlike(r"[/\\.][\w.-]*$|://\S*$") | after.rlike(r"^[/\\]|^\.[A-Za-z]")),
        "named": flag(before.rlike(CREDENTIAL)), "assigned": flag(before.rlike(r"[:=]\s{0,3}[\"']?$")),
        "in_url": flag(before.rlike(r"://[^\s:@/]+:$") & after.rlike("^@")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")), "harmless": flag(before.rlike(HARMLESS)),
        "key_prefix": flag(c.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk-|sk_|xox[abpr]-|glpat-|AIza)[A-Za-z0-9_-]{12,}$|^-----BEGIN|^eyJ[\\w-]+\\.[\\w-]+|^SG\\.")),
    }
    return found.withColumns(values)


def labelled_findings(spark: SparkSession, n: int = 12000) -> DataFrame:
    """(candidate, before, after, label): made findings, half of them secrets, the same for every call.

    Each kind comes in its usual surroundings and some in neutral ones: keys that are known by
    their prefix and values assigned to a credential's name are secrets; checksums, commit ids,
    paths, card numbers, dates, identifiers and long words are not.
    """
    rows = spark.range(n).withColumn("a", F.sha2(F.concat(F.lit("a"), "id"), 512)).withColumn("b", F.sha2(F.concat(F.lit("b"), "id"), 512))
    hexes = lambda k: F.substring("a", 1, k)
    upper = F.translate("a", "0123456789abcdef", "A2B3CDE4FG5HJ6KM")
    mixed = F.translate(F.base64(F.unhex("a")), "+/=", "xyz")
    letters = F.translate("b", "0123456789abcdef", "aeionrtsldhcumwy")
    numbers = F.translate("b", "abcdef", "172839")
    word = lambda i, k: F.substring(letters, i, k)
    plain = F.concat(word(60, 6), F.lit(" "), word(70, 3), F.lit(" "), word(80, 7), F.lit(" "))
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("b"), F.lit(len(xs))) + 1).cast("int"))
    dictionary = lambda i: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64("a", F.lit(i)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    names = pick('password=', 'token = "', "secret: ", 'api_key="', "passwd = ", 'auth_token="', "pwd=", "access_key = '")
    closed = F.when(names.rlike('"$'), '" ').when(names.rlike("'$"), "' ").otherwise(" ")
    kinds = [
        # (secret, candidate, before, after)
        (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), plain, F.lit(" ")),
        (1, F.concat(pick("ghp_", "xoxb-", "sk_"), F.substring(mixed, 1, 36)), plain, F.lit(" ")),
        (1, hexes(40), F.concat(plain, names), closed),
        (1, hexes(18), F.concat(plain, names), closed),
        (1, F.substring(mixed, 1, 32), F.concat(plain, names), closed),
        (1, F.concat(F.substring(mixed, 1, 22), F.lit("==")), F.concat(plain, names), closed),
        (1, F.concat(word(1, 4), pick("!", "#", "$", "%"), F.substring(mixed, 1, 5), F.substring(numbers, 1, 2)), F.concat(plain, names), closed),
        (1, F.concat(F.lit("eyJ"), F.substring(mixed, 1, 33), F.lit("."), F.substring(mixed, 5, 40), F.lit("."), F.substring(mixed, 9, 43)), F.concat(plain, pick("Bearer ", "", "token: ", "jwt ")), F.lit(" ")),
        (1, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed, F.lit("\n-----END RSA PRIVATE KEY-----")), plain, F.lit("\n")),
        (1, F.concat(word(1, 3), F.substring(mixed, 1, 7)), F.concat(plain, pick("postgres", "https", "amqp"), F.lit("://"), word(9, 5), F.lit(":")), F.concat(F.lit("@"), word(20, 6), F.lit(".example"))),
        (1, F.concat(word(1, 6), dictionary(1), word(30, 5), dictionary(2), word(40, 4)), F.concat(plain, names), closed),
        (1, hexes(128), F.concat(plain, names), closed),
        (1, F.repeat(F.substring(mixed, 1, 48), 6), F.concat(plain, names), closed),
        (0, F.left(F.concat(dictionary(3), word(1, 6)), F.lit(11)), F.concat(plain, names), closed),
        (0, hexes(40), F.concat(plain, pick("commit ", "sha1: ", "revision ", "digest=", "etag: ")), F.lit(" ")),
        (0, hexes(64), F.concat(plain, pick("sha256:", "checksum ", "hash = ", "digest: ")), F.lit(" ")),
        (0, hexes(32), F.concat(plain, pick("/files/", "img/", "https://host.example/", "cache/")), pick(".png", ".html", "/", " ")),
        (0, F.substring(numbers, 1, 16), plain, F.lit(" ")),
        (0, F.concat(word(1, 11), F.substring(numbers, 1, 2)), plain, F.lit(" ")),
        (0, F.concat_ws("_", dictionary(1), dictionary(2), F.substring(numbers, 1, 4)), plain, F.lit(" ")),
        (0, F.concat(F.lit("20"), F.substring(numbers, 1, 2), F.lit("-0"), F.substring(numbers, 3, 1), F.lit("-1"), F.substring(numbers, 4, 1), F.lit("-"), dictionary(3)), plain, pick(" ", ".log")),
        (0, F.concat(F.substring("a", 1, 8), F.lit("-"), F.substring("a", 9, 4), F.lit("-4"), F.substring("a", 13, 3), F.lit("-a"), F.substring("a", 16, 3), F.lit("-"), F.substring("a", 19, 12)), F.concat(plain, pick("id ", "uuid: ", "", "request ")), F.lit(" ")),
        (0, F.concat_ws("-", dictionary(4), dictionary(5), dictionary(6)), F.concat(plain, pick("token: ", "key = ", "password: ", "")), F.lit(" ")),
        (0, word(1, 14), plain, F.lit(" ")),
        (0, F.concat(F.initcap(word(1, 12)), F.initcap(word(20, 14))), plain, F.lit(" ")),
        (0, F.concat_ws(".", dictionary(7), dictionary(8), dictionary(9)), F.concat(plain, names), closed),
        (0, F.concat(F.lit("${"), F.upper(dictionary(1)), F.lit("_"), F.upper(dictionary(2)), F.lit("}")), F.concat(plain, names), closed),
    ]
    secret = sum(k[0] for k in kinds)
    kind = F.when(F.col("id") % 2 == 0, F.pmod(F.col("id") / 2, F.lit(secret))).otherwise(secret + F.pmod(F.floor(F.col("id") / 2), F.lit(len(kinds) - secret))).cast("int")
    rows = rows.withColumn("kind", kind)
    column = lambda i: F.element_at(F.array(*[F.lit(k[i]) if i == 0 else k[i] for k in kinds]), F.col("kind") + 1)
    return rows.select("id", "kind", column(1).alias("candidate"), column(2).alias("before"), column(3).alias("after"), column(0).alias("label"))


def forest(findings: DataFrame, trees: int = 30, depth: int = 7, most: int = 20000):
    """The fitted model; at most `most` labelled findings are used, those with the smallest hash."""
    bounded = findings.filter(F.col("label").isNotNull()).orderBy(F.xxhash64("candidate", "before")).limit(most)
    rows = pinned(with_features(bounded).select(*FEATURES, F.col("label").cast("double").alias("label")))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return Pipeline(stages=[assembler, RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5)]).fit(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """One row per document and distinct candidate: doc_id (or what `by` names), candidate, start, length, occurrences, probability, is_secret.

    probability is the largest of its occurrences'. `findings` are labelled findings (candidate,
    before, after, label); by default the made ones. Null and empty texts and an empty table give no
    rows; null doc_ids are carried; rows that repeat a document repeat its findings.
    """
    by = by or ["doc_id"]
    model = forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    scored = model.transform(with_features(candidates(docs, by)))
    probability = F.round(vector_to_array("probability")[1], 6)
    found = scored.groupBy("row", *by, "candidate").agg(
        F.min(F.struct("at", "start")).alias("first"), F.count("*").cast("int").alias("occurrences"), F.max(probability).alias("probability")
    )
    return found.select(
        *by, "candidate", F.col("first.start").alias("start"), F.length("candidate").alias("length"), "occurrences", "probability", (F.col("probability") >= threshold).alias("is_secret")
    )


def redact(docs: DataFrame, findings: DataFrame | None = None, mask: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """The documents with every confirmed secret replaced in the text; n_chars follows. All rows stay, in their columns and types.

    Secrets are found and masked in each row's own text: rows with a null or repeated doc_id do not
    share them.
    """
    found = scan(docs.select(row_key().alias("key"), "text"), findings, threshold, ["key"])
    secrets = found.filter("is_secret").groupBy("key").agg(F.array_sort(F.collect_set(F.struct(-F.length("candidate"), "candidate"))).alias("secrets"))
    joined = docs.select(F.struct("*").alias("row"), row_key().alias("key")).join(secrets, "key", "left")
    cleaned = F.aggregate("secrets", F.col("row.text"), lambda text, s: F.replace(text, s["candidate"], F.lit(mask)))
    changed = F.col("secrets").isNotNull()
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns["text"] = F.when(changed, cleaned).otherwise(columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length(cleaned).cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return joined.select(*[value.alias(c) for c, value in columns.items()])
