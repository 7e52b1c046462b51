"""What source text says of classes: what they extend, contain, make and import, what they call that nobody knows, and their query methods."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veinway.lineage import pinned

# Names and packages that say nothing about the code's own classes.
PLAIN_MADE = ["String", "Integer", "Long", "Double", "Float", "Boolean", "Object", "ArrayList", "HashMap", "HashSet", "LinkedList", "TreeMap", "Optional"]
FOREIGN = r"^(?:java|javax|jakarta|org\.springframework|org\.apache|com\.fasterxml|lombok|org\.slf4j|org\.junit|org\.mockito)\."
PRIMITIVE = ["String", "Integer", "Long", "Boolean", "Double", "Float", "Object", "List", "Map", "Set", "Optional", "void", "int", "long", "boolean", "double", "float", "byte", "char", "short"]
INFRASTRUCTURE = ["log", "logger", "LOG", "LOGGER", "this", "super", "System", "Math", "Objects", "Optional", "String", "Arrays", "Collections", "CompletableFuture", "ResponseEntity"]
QUERY_VERB = r"(?i)^(?:find|get|fetch|count|list|search|load|query|select|read|exists|retrieve)"
REPOSITORY_FILE = r"(?i)(?:Repository|Repo|Dao|Store|Finder)\.(?:java|kt|py|ts|js)$"
REPOSITORY_TYPES = "JpaRepository|CrudRepository|PagingAndSortingRepository|Repository|MongoRepository|ElasticsearchRepository"
FAR, DERIVED_CONFIDENCE, EVIDENCE = 2, 0.90, 80

STATEMENT = r"(?!(?:return|throw|new|else|assert|yield|if|for|while|switch|catch|synchronized)\b)"
CLASS = r"\b(?:class|interface|enum)\s+\w+(?:\s+extends\s+[\w<>,\s.]+?)?(?:\s+implements\s+[\w<>,\s.]+?)?\s*\{"
METHOD = (
    r"(?:(?m:^)|(?<=\{))[ \t]*+(?:@\w+(?:\([^)]*\))?\s+)*+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?:<[^>;{}()]*>\s+)?"
    rf"{STATEMENT}[\w.]+(?:<[^;{{}}()=]*>)?(?:\[\])*\s+{STATEMENT}\w+\s*\([^)]*\)(?:\s*throws\s+[\w,\s.]+)?\s*[{{;]"
)
ABSTRACT = rf"(?m:^)[ \t]*+(?:(?:public|protected|private|default)\s+)?(?:<[^>]+>\s+)?{STATEMENT}[\w<>\[\]]+\s+\w+\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*;"
QUERY = r"(?i:@Query\s*\(\s*(?:value\s*=\s*)?[\"'][^\"']+[\"'])"
STUBS = [r"@abstractmethod\s+def\s+(\w+)\s*\(([^)]*)\)", r"def\s+(\w+)\s*\(([^)]*)\)[^:]*:\s*\.\.\."]


def last_part(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.]*)$", 1)


def _names(listed: Column) -> Column:
    """The last parts of a comma-separated list of types, without what stands in angle brackets."""
    bare = F.regexp_replace(F.regexp_replace(listed, r"<[^<>]*>", ""), r"<[^>]*>", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: last_part(F.trim(x))), lambda x: x != "")


def declarations(units: DataFrame) -> DataFrame:
    """(file_path, pos, kind, name, extends, implements, until): classes and methods of Java units (file_path, content), numbered by their place among a file's declarations and braces.

    A class ends (until) with the brace that closes the one it opens, or not at all (null). Openings
    and closings of one depth alternate, so the closing one is the next of the same depth.
    """
    java = units.filter(F.col("file_path").rlike(r"\.(?:java|kt)$") & (F.trim("content") != ""))
    each = java.select("file_path", F.posexplode(F.regexp_extract_all("content", F.lit(f"{CLASS}|{METHOD}|[{{}}]"), F.lit(0))).alias("pos", "token"))
    opens, closes = F.col("token").endswith("{"), F.col("token") == "}"
    by_place = Window.partitionBy("file_path").orderBy("pos")
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(by_place) + F.when(closes, 1).otherwise(0)
    levels = each.withColumn("depth", depth).withColumn("braced", opens | closes)
    until = F.lead("pos").over(Window.partitionBy("file_path", "braced", "depth").orderBy("pos"))
    head = rf"^{CLASS}$"
    found = levels.withColumn("until", until).filter(F.length("token") > 1).withColumn("kind", F.when(F.col("token").rlike(head), "class").otherwise("method"))
    is_class, token = F.col("kind") == "class", F.col("token")
    part = lambda word: F.when(is_class, _names(F.regexp_extract(token, rf"\s{word}\s+([\w<>,\s.]+?)(?:\s+implements\s|\s*\{{)", 1)))
    name = F.when(is_class, F.regexp_extract(token, r"^\w+\s+(\w+)", 1)).otherwise(F.regexp_extract(token, r"(\w+)\s*\([^()]*\)(?:\s*throws\s+[\w,\s.]+)?\s*[{;]$", 1))
    return found.select("file_path", "pos", "kind", name.alias("name"), part("extends").alias("extends"), part("implements").alias("implements"), F.when(is_class, F.col("until")).alias("until"))


def structural_edges(units: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, etype, dst, src_type, dst_type, confidence, evidence): EXTENDS, IMPLEMENTS, CONTAINS, INSTANTIATES and IMPORTS of Java units (file_path, content).

    A class contains the methods and constructors between its braces, those of inner classes too. What
    a file makes and imports is its first class's doing; plain types and other people's packages are
    left out. Types come from the entities (name, entity_type), the least of several, else from the kind
    of edge. Of equal edges the surest stays, then the least evidence. Braces in strings and comments
    count like others; statements are no methods. Units without a class or a text give nothing.
    """
    all_of = pinned(declarations(units))
    classes = all_of.filter("kind = 'class'")
    said = lambda etype, column, word, other: classes.select(F.col("name").alias("src"), F.lit(etype).alias("etype"), F.explode(column).alias("dst"), F.lit(other).alias("other"), F.lit(1.0).alias("confidence"), F.lit(word).alias("word"))
    typed = said("EXTENDS", "extends", "extends", "Class").unionAll(said("IMPLEMENTS", "implements", "implements", "Interface"))
    typed = typed.withColumn("evidence", F.concat(F.lit("class "), "src", F.lit(" "), "word", F.lit(" "), "dst")).drop("word")
    c, m = classes.alias("c"), all_of.filter("kind = 'method'").alias("m")
    inside = F.expr("c.file_path = m.file_path AND m.pos > c.pos AND (c.until IS NULL OR m.pos < c.until)")
    held = c.join(m, inside).select(F.col("c.name").alias("src"), F.lit("CONTAINS").alias("etype"), F.col("m.name").alias("dst"), F.lit("Function").alias("other"), F.lit(1.0).alias("confidence"), F.concat("c.name", F.lit("::"), "m.name").alias("evidence"))
    first = classes.groupBy("file_path").agg(F.min(F.struct("pos", "name")).alias("first")).select("file_path", F.col("first.name").alias("src"))
    own = units.select("file_path", "content").join(first, "file_path")
    made = own.select("src", F.explode(F.regexp_extract_all("content", F.lit(r"\bnew\s+([A-Z]\w+)\s*[(<]"), F.lit(1))).alias("dst")).filter(~F.col("dst").isin(PLAIN_MADE))
    made = made.select("src", F.lit("INSTANTIATES").alias("etype"), "dst", F.lit("Class").alias("other"), F.lit(0.9).alias("confidence"), F.concat(F.lit("new "), "dst", F.lit("(...)")).alias("evidence"))
    taken = own.select("src", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+);"), F.lit(1))).alias("path")).filter(~F.col("path").rlike(FOREIGN))
    taken = taken.select("src", F.lit("IMPORTS").alias("etype"), last_part(F.col("path")).alias("dst"), F.lit("Class").alias("other"), F.lit(0.85).alias("confidence"), F.concat(F.lit("import "), "path").alias("evidence"))
    best = F.min(F.struct((-F.col("confidence")).alias("less"), F.left("evidence", F.lit(120)).alias("evidence"), "other")).alias("best")
    one = typed.unionByName(held).unionByName(made).unionByName(taken).groupBy("src", "etype", "dst").agg(best)
    kinds = entities.groupBy("name").agg(F.min("entity_type").alias("kind"))
    named = one.join(kinds.select(F.col("name").alias("src"), F.col("kind").alias("src_kind")), "src", "left").join(kinds.select(F.col("name").alias("dst"), F.col("kind").alias("dst_kind")), "dst", "left")
    return named.select(
        "src", "etype", "dst", F.coalesce("src_kind", F.lit("Class")).alias("src_type"), F.coalesce("dst_kind", "best.other").alias("dst_type"), (-F.col("best.less")).alias("confidence"), F.col("best.evidence").alias("evidence")
    )


def distances(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, hops): the least number of edges (src, dst) from any start (id), for all that can be reached; a start has 0."""
    steps = pinned(edges.select("src", "dst").dropna().distinct())
    found = level = pinned(starts.select(F.col("id").alias("node")).dropna().distinct().withColumn("hops", F.lit(0)))
    while not level.isEmpty():
        reached = level.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        level = pinned(reached.join(found, "node", "left_anti"))
        found = found.unionAll(level)
    return found


def unresolved(entities: DataFrame, edges: DataFrame, fields: DataFrame, most_hops: int = 3) -> DataFrame:
    """(type_hint, receiver, method, evidence, hops): types that the entities (n, external_id, name, entity_type, snippet) call or lead to, and that are none of them.

    A receiver's type is that of the field (field, type) of its name, the least of several, else its name
    with a capital. Each type is given once, by its last part: from the first call in the order of n and of
    the text, one hop beyond the calling entity; an entity that no ApiEndpoint reaches counts as 2 hops
    away, entities at most_hops or more are not read. Types that are only ends of edges have one hop and
    no receiver. A bracket on a later line is drawn up to its name; what follows it stays on its line.
    """
    known = entities.select(last_part(F.col("name")).alias("short")).dropna().distinct()
    hops = distances(edges, entities.filter("entity_type = 'ApiEndpoint'").select(F.col("external_id").alias("id")))
    away = F.coalesce("hops", F.lit(FAR))
    read = entities.filter("snippet <> ''").join(hops, F.col("external_id") == F.col("node"), "left").withColumn("hops", away).filter(F.col("hops") < most_hops)
    drawn = F.regexp_replace("snippet", r"(\w\.\w+)[^\S\n]*\n\s*\(", "$1(\n")
    lines = read.select("n", "hops", F.posexplode(F.split(drawn, "\n")).alias("line", "said"))
    call = F.lit(r"\b(\w+)\.(\w+)\s*\(")
    pairs = F.arrays_zip(F.regexp_extract_all("said", call, F.lit(1)).alias("receiver"), F.regexp_extract_all("said", call, F.lit(2)).alias("method"))
    calls = lines.select("n", "hops", "line", F.left(F.trim("said"), F.lit(EVIDENCE)).alias("evidence"), F.posexplode(pairs).alias("at", "call"))
    calls = calls.select("n", "line", "at", (F.col("hops") + 1).alias("hops"), "evidence", "call.receiver", "call.method").filter(~F.col("receiver").isin(INFRASTRUCTURE))
    index = fields.groupBy(F.col("field").alias("receiver")).agg(F.min("type").alias("type"))
    guess = F.concat(F.upper(F.left("receiver", F.lit(1))), F.substring("receiver", 2, 1 << 30))
    hinted = calls.join(index, "receiver", "left").withColumn("type_hint", F.coalesce(F.nullif("type", F.lit("")), guess)).withColumn("short", last_part(F.col("type_hint")))
    first = F.min(F.struct("n", "line", "at", "type_hint", "receiver", "method", "evidence", "hops")).alias("first")
    called = pinned(hinted.filter(~F.col("short").isin(PRIMITIVE)).groupBy("short").agg(first).join(known, "short", "left_anti"))
    ends = edges.select(last_part(F.substring_index("dst", "::", -1)).alias("short")).dropna().distinct()
    ends = ends.join(known, "short", "left_anti").join(called.select("short"), "short", "left_anti")
    led = ends.select(F.col("short").alias("type_hint"), F.lit("").alias("receiver"), F.lit("").alias("method"), F.concat(F.lit("CALLS edge target: "), "short").alias("evidence"), F.lit(1).alias("hops"))
    return called.select("first.type_hint", "first.receiver", "first.method", "first.evidence", "first.hops").unionAll(led)


def derived_queries(units: DataFrame) -> DataFrame:
    """(file_path, name, signature, query_text, confidence): methods of repositories that are named like queries, of units (file_path, content).

    Java and Kotlin: methods without a body, in a file that is called like a repository or that declares one;
    their query is the last @Query since the method or brace before. Python: abstract methods and stubs in
    files that are called so, without a query. The name is the file's with the method's; statements are no methods.
    """
    stem = F.regexp_extract("file_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    rows = units.filter(F.col("content") != "").select("file_path", "content", stem.alias("stem"), F.col("file_path").rlike(REPOSITORY_FILE).alias("called"))
    declares = F.col("content").rlike(rf"(?i)\binterface\s+\w+\s+extends\s+[\w,<>\s]*(?:{REPOSITORY_TYPES})")
    java = rows.filter(F.col("file_path").rlike(r"\.(?:java|kt)$") & (F.col("called") | declares))
    each = java.select("file_path", "stem", F.posexplode(F.regexp_extract_all("content", F.lit(f"{QUERY}|{ABSTRACT}|[{{}}]"), F.lit(0))).alias("pos", "token"))
    is_query = F.col("token").rlike("(?i)^@Query")
    before = Window.partitionBy("file_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.withColumn("part", F.coalesce(F.sum((~is_query).cast("int")).over(before), F.lit(0)))
    text = F.when(is_query, F.trim(F.regexp_extract("token", r"[\"']([^\"']+)[\"']$", 1)))
    near = F.last(text, ignorenulls=True).over(Window.partitionBy("file_path", "part").orderBy("pos"))
    signature = F.regexp_replace(F.trim(F.regexp_replace("token", r"^\s+", "")), r"\s*;$", "")
    found = parts.withColumn("query_text", near).filter(~is_query & F.col("token").endswith(";"))
    methods = found.select("file_path", "stem", F.regexp_extract("token", r"(\w+)\s*\([^()]*\)", 1).alias("method"), signature.alias("signature"), "query_text")
    python = rows.filter(F.col("file_path").endswith(".py") & F.col("called"))
    for pattern in STUBS:
        names, given = (F.regexp_extract_all("content", F.lit(pattern), F.lit(i)) for i in (1, 2))
        stubs = python.select("file_path", "stem", F.explode(F.arrays_zip(names.alias("method"), given.alias("given"))).alias("s"))
        methods = methods.unionByName(stubs.select("file_path", "stem", "s.method", F.concat(F.lit("def "), "s.method", F.lit("("), "s.given", F.lit(")")).alias("signature"), F.lit(None).cast("string").alias("query_text")))
    named = methods.filter(F.col("method").rlike(QUERY_VERB)).withColumn("name", F.concat("stem", F.lit("."), "method"))
    return named.select("file_path", "name", "signature", "query_text", F.lit(DERIVED_CONFIDENCE).alias("confidence")).distinct()
