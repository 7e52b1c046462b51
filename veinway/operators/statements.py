"""What SQL statements do: their type, tables, columns, and which source columns each result column comes from.

A small reader turns a statement into facts, one row each: which column of which scope comes from which
column of which source. Names are looked up where they stand (aliases, common table expressions and their
shadowing). All else is done by Spark over the facts of all statements: columns without a qualifier and
stars are settled against known columns, and lineage is followed through subqueries, views and
inserts to stored tables, level by level.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veinway.lineage import pinned

TOKENS = re.compile(
    r"""(?s)\s+|--[^\n]*|/\*.*?\*/|(?P<text>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`|\[\w[^\]]*\])"""
    r"""|(?P<word>[A-Za-z_]\w*)|(?P<number>\d+(?:\.\d+)?)|(?P<mark>\?|:[A-Za-z_]\w*)|(?P<sign>::|<=|>=|<>|!=|\|\||.)"""
)
AFTER_SOURCE = set("on using join inner left right full cross natural outer where group order having limit offset fetch window union intersect except qualify set when returning".split())
NOT_COLUMNS = AFTER_SOURCE | set(
    "select distinct all as and or not in is null like ilike between case then else end exists from by asc desc over partition rows range unbounded preceding"
    " following current row true false cast interval nulls first last filter within any some escape current_date current_timestamp with".split()
)
TYPES = "select insert update delete create drop alter merge truncate call".split()


class Reader:
    """Reads one statement. `facts` are (owner, name, via, column, several): owners are scopes 's0', 's1', ... and
    tables 't:name'; a name or column '*' stands for all; `several` marks one of several sources that may be meant."""

    def __init__(self, sql: str):
        self.tokens: list[tuple[str, str]] = []
        for m in TOKENS.finditer(sql):
            if m.lastgroup == "quoted":
                self.tokens.append(("name", m[0][1:-1].lower()))
            elif m.lastgroup:
                self.tokens.append((m.lastgroup, m[0].lower()))
        self.at, self.scopes, self.facts = 0, 0, []
        self.tables: dict[str, None] = {}
        self.columns: dict[str, None] = {}

    def peek(self, ahead: int = 0) -> str:
        """The token as a keyword or sign; '' for quoted names, strings and the end."""
        kind, value = self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("", "")
        return value if kind in ("word", "sign") else ""

    def take(self, *words: str) -> bool:
        if self.peek() in words:
            self.at += 1
            return True
        return False

    def is_name(self, at: int) -> bool:
        return at < len(self.tokens) and self.tokens[at][0] in ("word", "name")

    def path(self) -> list[str]:
        """name(.name)*, and a star at its end."""
        parts = [self.tokens[self.at][1]]
        self.at += 1
        while self.peek() == "." and (self.is_name(self.at + 1) or self.peek(1) == "*"):
            parts.append(self.tokens[self.at + 1][1])
            self.at += 2
        return parts

    def skip(self) -> None:
        """Behind the bracket that closes the one at hand."""
        depth = 0
        while self.at < len(self.tokens):
            depth += {"(": 1, ")": -1}.get(self.peek(), 0)
            self.at += 1
            if depth <= 0:
                return

    def names(self) -> list[str]:
        """(a, b, c) if it is there."""
        found = []
        if self.peek() == "(" and self.peek(1) not in ("select", "with", "values", "("):
            end = self.at + 1
            self.skip()
            found = [v for k, v in self.tokens[end : self.at - 1] if k in ("word", "name")]
        return found

    def query(self, named: dict[str, str], outer: list[dict]) -> tuple[str, list[str]]:
        """(scope, its column names, '*' for a star) of a query with its WITH clause."""
        named = dict(named)
        if self.take("with"):
            recursive = self.take("recursive")
            while self.is_name(self.at):
                name = self.path()[-1]
                columns = self.names()
                self.take("as")
                if not self.take("materialized") and self.take("not"):
                    self.at += 1
                alias = self.new()
                self.take("(")
                scope, own = self.query(named | {name: alias} if recursive else named, outer)
                self.take(")")
                self.renamed(alias, scope, own, columns)
                named[name] = alias
                if not self.take(","):
                    break
        first, names = self.term(named, outer)
        others = []
        while self.take("union", "intersect", "except"):
            self.take("all", "distinct")
            others.append(self.term(named, outer))
        scope = first
        if others:
            scope = self.new()
            for part, own in [(first, names), *others]:
                self.renamed(scope, part, own, names)
        while self.at < len(self.tokens) and self.peek() not in (")", ";"):  # ORDER BY, LIMIT
            self.skip() if self.peek() == "(" else self.step()
        return scope, names

    def step(self) -> None:
        self.at += 1

    def new(self) -> str:
        self.scopes += 1
        return f"s{self.scopes}"

    def renamed(self, owner: str, scope: str, own: list[str], names: list[str]) -> None:
        """owner's columns are those of scope, by position, or by name where a star is among them."""
        if "*" in own or not own:
            self.facts.append((owner, "*", scope, "*", False))
        else:
            self.facts += [(owner, names[i] if i < len(names) else own[i], scope, own[i], False) for i in range(len(own))]

    def term(self, named: dict[str, str], outer: list[dict]) -> tuple[str, list[str]]:
        if self.take("("):
            found = self.query(named, outer)
            self.take(")")
            return found
        scope = self.new()
        if not self.take("select"):  # VALUES or what is not known
            while self.at < len(self.tokens) and self.peek() not in (")", ";", "union", "intersect", "except"):
                self.skip() if self.peek() == "(" else self.step()
            return scope, []
        self.take("all", "distinct")
        items, start = [], self.at
        stops = ("from", "where", "group", "having", "order", "limit", "union", "intersect", "except", "qualify", "window", "fetch", "offset", ")", ";")
        while self.at < len(self.tokens) and self.peek() not in stops:
            if self.peek() == ",":
                items.append((start, self.at))
                start = self.at + 1
            self.skip() if self.peek() == "(" else self.step()
        items.append((start, self.at))
        sources = self.sources(named, outer) if self.take("from") else {}
        rest = self.at
        names = [self.item(scope, a, b, i, sources, named, outer) for i, (a, b) in enumerate(items)]
        self.at = rest
        self.references(named, [sources, *outer], ("order", "limit", "union", "intersect", "except", ")", ";"))
        return scope, names

    def sources(self, named: dict[str, str], outer: list[dict]) -> dict[str, str]:
        """alias -> owner of the FROM items."""
        found: dict[str, str] = {}
        while self.at < len(self.tokens):
            self.take("lateral", "only")
            if self.peek() == "(" and self.peek(1) in ("select", "with", "(", "values"):
                self.at += 1
                owner, own = self.query(named, [found, *outer])
                self.take(")")
            elif self.take("("):  # a join in brackets
                found |= self.sources(named, outer)
                self.take(")")
                owner, own = "", []
            elif self.is_name(self.at):
                path, own = self.path(), []
                if self.peek() == "(":  # a function
                    self.skip()
                    owner = self.new()
                elif len(path) == 1 and path[0] in named:
                    owner = named[path[0]]
                else:
                    owner = "t:" + path[-1]
                    self.tables[path[-1]] = None
            else:
                break
            alias = "" if owner == "" or own else path[-1] if owner.startswith("t:") or owner in named.values() else ""
            if self.take("as") or (self.is_name(self.at) and self.peek() not in AFTER_SOURCE):
                alias = self.path()[-1]
                if columns := self.names():
                    again = self.new()
                    self.renamed(again, owner, own or columns, columns)
                    owner = again
            if owner:
                found[alias or f"({len(found)})"] = owner
            while self.peek() in ("inner", "left", "right", "full", "cross", "natural", "outer", "semi", "anti"):
                self.at += 1
            if self.take("join", ","):
                continue
            if self.peek() == "on":
                self.references(named, [found, *outer], ("join", "inner", "left", "right", "full", "cross", "natural", "where", "group", "order", "having", "limit", "union", "intersect", "except", ")", ";", ","))
            elif self.take("using"):
                self.skip()
            while self.peek() in ("inner", "left", "right", "full", "cross", "natural", "outer"):
                self.at += 1
            if not self.take("join", ","):
                break
        return found

    def item(self, scope: str, start: int, end: int, i: int, sources: dict[str, str], named: dict[str, str], outer: list[dict]) -> str:
        """Facts of one result column; returns its name."""
        name, stop = "", end
        if end - start >= 2 and self.is_name(end - 1):
            before = self.tokens[end - 2]
            if before == ("word", "as"):
                name, stop = self.tokens[end - 1][1], end - 2
            elif before[0] in ("name", "text", "number") or before[1] in (")", "end", "]") or (before[0] == "word" and before[1] not in NOT_COLUMNS):
                if self.tokens[end - 1][1] not in NOT_COLUMNS:
                    name, stop = self.tokens[end - 1][1], end - 1
        self.at = start
        found = self.references(named, [sources, *outer], (), stop)
        if not name:
            one = {column for _, column, _, inner in found if not inner}
            name = one.pop() if len(one) == 1 and (stop - start <= 3 and self.is_name(start) or "*" in one) else f"column{i + 1}"
        self.facts += [(scope, "*" if column == "*" and not inner else name, via, column, several) for via, column, several, inner in found]
        if not found:
            self.facts.append((scope, name, "", "", False))
        return name

    def references(self, named: dict[str, str], scopes: list[dict], stops: tuple[str, ...], end: int | None = None) -> list[tuple[str, str, bool, bool]]:
        """(via, column, several, from a subquery) of the columns up to a stop word or place."""
        found: list[tuple[str, str, bool, bool]] = []
        end = len(self.tokens) if end is None else end
        depth = 0
        while self.at < end and not (depth == 0 and self.peek() in stops):
            word = self.peek()
            if word == "(" and self.peek(1) in ("select", "with"):
                self.at += 1
                scope, own = self.query(named, scopes)
                found += [(scope, c, False, True) for c in own[:1]]
                self.take(")")
            elif word == "*" and self.at + 1 >= end and (self.at == 0 or self.peek(-1) in ("select", ",", "distinct", "all")):
                found += [(owner, "*", len(scopes[0]) > 1, False) for owner in scopes[0].values()]
                self.at += 1
            elif self.is_name(self.at) and (word not in NOT_COLUMNS or self.tokens[self.at][0] == "name"):
                if self.peek(-1) == "::" or (self.peek(-1) == "as" and depth):  # a type
                    self.at += 1
                    continue
                path = self.path()
                if self.peek() == "(":
                    continue
                if path[-1] != "*":
                    self.columns[path[-1]] = None
                if len(path) > 1:
                    owner = next((s[path[-2]] for s in scopes if path[-2] in s), "")
                    found.append((owner, path[-1], False, False))
                elif len(scopes[0]) == 1 and len(scopes) == 1:
                    found.append((next(iter(scopes[0].values())), path[0], False, False))
                else:
                    found += [(owner, path[0], True, False) for s in scopes[:1] for owner in s.values()]
            else:
                depth += {"(": 1, ")": -1}.get(word, 0)
                self.at += 1
        return found


def read(sql: str) -> tuple[str, str | None, list[str], list[str], list[tuple[str, str, str, str, bool]]]:
    """(type, table that the statement fills, tables, columns, facts). Its own result has the owner 's0'."""
    r = Reader(sql)
    first, target, columns = r.peek(), None, []
    kind = "SELECT" if first in ("with", "select", "(") else first.upper() if first in TYPES else "OTHER"
    while r.at < len(r.tokens) and r.peek() not in ("select", "with") and not (r.peek() == "(" and r.peek(1) in ("select", "with")):
        if r.peek() in ("into", "view", "table", "update", "from", "join", "using") and target != "":
            word = r.peek()
            r.at += 1
            while r.take("if", "not", "exists", "overwrite", "only"):
                pass
            if r.is_name(r.at):
                name = r.path()[-1]
                r.tables[name] = None
                if word in ("into", "view", "table", "update") and target is None and kind in ("INSERT", "CREATE", "MERGE"):
                    target, columns = name, r.names()
        elif kind in ("UPDATE", "DELETE") and r.is_name(r.at) and r.peek() not in NOT_COLUMNS | {"update", "delete"}:
            path = r.path()
            r.columns |= {} if r.peek() == "(" else {path[-1]: None}
        else:
            r.at += 1
    if r.at < len(r.tokens):
        scope, own = r.query({}, [])
        r.renamed("s0", scope, own, columns)
    return kind, target, list(r.tables), list(r.columns), r.facts


FACTS = "array<struct<owner:string,name:string,via:string,column:string,several:boolean>>"
FACT = pa.struct([("owner", pa.string()), ("name", pa.string()), ("via", pa.string()), ("column", pa.string()), ("several", pa.bool_())])
READ = {"kind": pa.string(), "target": pa.string(), "tables": pa.list_(pa.string()), "columns": pa.list_(pa.string()), "facts": pa.list_(FACT)}


def read_once(texts: pa.Array) -> tuple[dict[str, pa.Array], pa.Array]:
    """What `read` says of each different text, and `tier`; and which of these each of the texts is."""
    coded = texts.fill_null("").dictionary_encode()
    different = coded.dictionary.to_pylist()
    rows = list(zip(*map(read, different), strict=True)) or [()] * len(READ)
    rows[-1] = [[dict(zip(("owner", "name", "via", "column", "several"), f, strict=True)) for f in facts] for facts in rows[-1]]
    said = {name: pa.array(values, kind) for (name, kind), values in zip(READ.items(), rows, strict=True)}
    said["tier"] = pa.array(["prepared_statement" if re.search(r"\?|:[a-zA-Z_]\w*", t) else "literal_string" for t in different], pa.string())
    return said, coded.indices


def parsed(statements: DataFrame, key: str = "stmt_id", sql: str = "sql") -> DataFrame:
    """(key, kind, target, tables, columns, facts, tier) of each statement. A null text is of kind OTHER and has no facts.

    tier is `prepared_statement` where the text has placeholders (? or :name), else `literal_string`. Of
    equal texts in an Arrow batch one is read.
    """
    key_type = statements.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, which = read_once(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(values.take(which) for values in said.values())], [key, *said])

    return statements.select(key, sql).mapInArrow(each, f"`{key}` {key_type}, kind string, target string, tables array<string>, columns array<string>, facts {FACTS}, tier string")


def first_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text_id, target, facts) for (key, sql): equal texts of a batch have one text_id; only the first of them has a target and facts."""
    task, done = TaskContext.get(), 0
    for batch in batches:
        said, which = read_once(batch.column(1))
        ids = pa.array([f"{task.partitionId() if task else 0}.{done + i}" for i in range(len(said["facts"]))], pa.string())
        done += len(ids)
        firsts = np.zeros(len(which), bool)
        firsts[np.unique(which.to_numpy(), return_index=True)[1]] = True
        only = pa.array(which.to_numpy(), pa.int32(), mask=~firsts)
        yield pa.RecordBatch.from_arrays([batch.column(0), ids.take(which), said["target"].take(only), said["facts"].take(only)], [batch.schema.names[0], "text_id", "target", "facts"])


def column_lineage(statements: DataFrame, catalog: DataFrame | None = None, key: str = "stmt_id", sql: str = "sql") -> DataFrame:
    """(key, output, table, column): the stored columns from which each result column of each statement is made.

    Views and tables that a statement fills are followed to what fills them, in any number of statements;
    a cycle ends where it closes. `catalog` (table, column) settles columns without a qualifier and
    stars over several sources: a source that is known to have the column is preferred to one whose
    columns are not known. A star over a table without known columns stays '*'. A result that is
    made of no column has no row. Lineage is followed once for equal texts of an Arrow batch.
    """
    key_type = statements.schema[key].dataType.simpleString()
    read_all = pinned(statements.select(key, sql).mapInArrow(first_of_texts, f"`{key}` {key_type}, text_id string, target string, facts {FACTS}"))
    part = F.concat(F.col("text_id"), F.lit("#"))
    owner = lambda c: F.when(F.col(c).startswith("t:") | (F.col(c) == ""), F.col(c)).otherwise(F.concat(part, F.col(c)))
    facts = read_all.select("text_id", F.explode("facts").alias("f")).select("text_id", "f.*")
    facts = facts.select(owner("owner").alias("owner"), "name", owner("via").alias("via"), F.col("column").alias("via_column"), "several").filter("via <> ''")
    fills = read_all.filter("target IS NOT NULL").select(F.concat(F.lit("t:"), "target").alias("owner"), F.lit("*").alias("name"), F.concat(part, F.lit("s0")).alias("via"), F.lit("*").alias("via_column"), F.lit(False).alias("several"))
    edges = pinned(facts.unionByName(fills).distinct())
    known = edges.filter("name <> '*'").select("owner", "name")
    if catalog is not None:
        known = known.unionByName(catalog.select(F.concat(F.lit("t:"), F.lower("table")).alias("owner"), F.lower("column").alias("name")))
    known = pinned(known.distinct())
    shut = known.select("owner").distinct().join(edges.filter("name = '*'").select("owner").distinct(), "owner", "left_anti")
    edges = pinned(edges.join(shut.select(F.col("owner").alias("via"), F.lit(True).alias("shut")), "via", "left").withColumnRenamed("name", "edge_name"))
    filled = edges.filter(F.col("owner").startswith("t:")).select("owner").distinct()

    stored = None if catalog is None else pinned(catalog.select(F.concat(F.lit("t:"), F.lower("table")).alias("owner"), F.lower("column").alias("stored_name")).distinct().join(filled, "owner", "left_anti"))

    def expanded(rows: DataFrame) -> DataFrame:
        """A star over a stored table becomes its columns, where they are known."""
        if stored is None:
            return rows
        met = rows.join(stored, (rows.owner == stored.owner) & (rows.name == "*"), "left").drop(stored.owner)
        named = lambda c: F.when(F.col(c) == "*", F.coalesce("stored_name", c)).otherwise(F.col(c))
        return met.select("root", named("output").alias("output"), "owner", F.coalesce("stored_name", "name").alias("name"))

    tops = edges.filter(F.col("owner").endswith("#s0")).select(F.col("owner").alias("root"), F.col("edge_name").alias("output"), "owner", F.col("edge_name").alias("name"))
    frontier = visited = pinned(tops.distinct())
    ends = []
    while True:
        met = frontier.join(edges, "owner").filter("edge_name = name OR edge_name = '*' OR name = '*'")
        met = met.withColumns({
            "to_name": F.when(F.col("via_column") == "*", F.when(F.col("name") == "*", F.col("edge_name")).otherwise(F.col("name"))).otherwise(F.col("via_column")),
            "to_output": F.when(F.col("output") == "*", F.col("edge_name")).otherwise(F.col("output")),
            "star": (F.col("edge_name") == "*") & (F.col("name") != "*"),
        })
        met = met.join(known.select(F.col("owner").alias("via"), F.col("name").alias("to_name"), F.lit(True).alias("has")), ["via", "to_name"], "left")
        # of a name's edges the named ones count, else stars; where several sources may be meant, those known to have the column, else those that may
        unsure = F.col("several") | F.col("star")
        rank = F.when(~unsure | F.col("has") | (F.col("to_name") == "*"), 0).when(F.col("shut").isNull(), 1).otherwise(2)
        group = Window.partitionBy("root", "output", "owner", "name")
        met = met.withColumn("rank", rank).filter("rank < 2").withColumn("any_named", F.max(~F.col("star")).over(group)).filter("NOT (star AND any_named)")
        met = met.withColumn("best", F.min("rank").over(Window.partitionBy("root", "output", "owner", "name", "edge_name", "via_column"))).filter(~unsure | (F.col("rank") == F.col("best")))
        reached = expanded(met.select("root", F.col("to_output").alias("output"), F.col("via").alias("owner"), F.col("to_name").alias("name"))).distinct()
        frontier = pinned(reached.join(visited, ["root", "output", "owner", "name"], "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionAll(frontier)
        ends.append(frontier.filter(F.col("owner").startswith("t:")).join(filled, "owner", "left_anti"))
    roots = read_all.select(key, F.concat(part, F.lit("s0")).alias("root"))
    leaf: DataFrame | None = None
    for e in ends:
        leaf = e if leaf is None else leaf.unionAll(e)
    if leaf is None:
        leaf = visited.limit(0)
    table: Column = F.substring("owner", 3, 1_000_000)
    return leaf.join(roots, "root").select(key, "output", table.alias("table"), F.col("name").alias("column")).distinct()
