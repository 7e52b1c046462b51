"""Personal data, retention, audit chains and drift states."""

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns, days and transitions that results depend on.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]",
    "phone": r"\+?[0-9]{0,2} ?\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "card": r"\b[0-9]{13,16}\b",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "api_key": r"\b(AKIA[0-9A-Z]{16}|[0-9a-f]{40})\b",
}
RETENTION_DAYS = {"permanent": None, "business_indefinite": 2555, "operational": 365, "transient": 90, "pii": 30, "secret": 0}
TRANSITIONS = [
    ("open", "acknowledged"), ("open", "in_flight"), ("open", "waived"), ("open", "resolved"), ("acknowledged", "in_flight"), ("acknowledged", "resolved"),
    ("acknowledged", "waived"), ("in_flight", "resolved"), ("in_flight", "open"), ("resolved", "open"), ("waived", "open"),
]
GENESIS = "0" * 64


def pii_findings(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, kind, value, occurrences, confidence) of each distinct finding; cards must pass the Luhn check, private addresses count half."""

    def of(kind: str) -> Column:
        values = F.regexp_extract_all(F.col(text), F.lit(f"({PII_PATTERNS[kind]})"), F.lit(1))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    every = F.concat(*map(of, PII_PATTERNS))
    found = df.select(F.col(id_column), F.explode(every).alias("f")).select(id_column, "f.kind", "f.value")
    private = F.col("value").rlike(r"^(10\.|192\.168\.|127\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    kept = found.filter((F.col("kind") != "card") | F.expr("luhn_check(value)"))
    return kept.groupBy(id_column, "kind", "value").agg(F.count("*").alias("occurrences")).withColumn(
        "confidence", F.when((F.col("kind") == "ipv4") & private, 0.5).otherwise(0.9)
    )


def redact_kind(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, PII_PATTERNS[kind], f"[REDACTED:{kind}]")


def redact_all(text: Column) -> Column:
    for kind in ("api_key", "email", "phone", "ssn", "card", "ipv4"):
        text = redact_kind(text, kind)
    return text


def ttl_class(kinds: Column, source_class: Column) -> Column:
    """Secrets first, then personal data, then what the source is; all else is permanent."""
    return (
        F.when(F.array_contains(kinds, "api_key"), "secret").when(F.size(kinds) > 0, "pii")
        .when(source_class.isin("transient", "operational", "business_indefinite"), source_class).otherwise("permanent")
    )


def ttl_sweep(entities: DataFrame, as_of: Column) -> DataFrame:
    """Adds expires_at and action for (ttl_class, created_at): secrets and personal data are redacted, transient rows deleted, others tombstoned."""
    days = F.create_map(*[x for k, v in RETENTION_DAYS.items() for x in (F.lit(k), F.lit(v).cast("int"))])[F.col("ttl_class")]
    expires = F.col("created_at") + F.make_dt_interval(days)
    action = (
        F.when(F.col("expires_at").isNull() | (F.col("expires_at") > as_of), "skip").when(F.col("ttl_class").isin("secret", "pii"), "redact")
        .when(F.col("ttl_class") == "transient", "delete").otherwise("tombstone")
    )
    return entities.withColumn("expires_at", expires).withColumn("action", action)


def audit_chain(entries: DataFrame, chain: list[str], seq: str, payload: Column) -> DataFrame:
    """Adds prev_hash and self_hash: an entry's hash covers its seq, its payload and the hash before it, 64 zeros at first.

    A chain is hashed in order, so it lies in one partition; one entry at a time is held. Null payloads count as empty.
    """
    return _folded(entries, chain, seq, payload, stored=False)


def verify_chain(stored: DataFrame, chain: list[str], seq: str, payload: Column) -> DataFrame:
    """(chain, entries, first_bad): the first seq whose hash or link is not what all entries before it give; null where all is well.

    A link is held against the stored hash before it, so a rewritten entry is bad even if its own hash was made anew:
    the next one's link then differs.
    """
    checked = _folded(stored, chain, seq, payload, stored=True)
    return checked.groupBy(*chain).agg(F.count("*").alias("entries"), F.min(F.when(F.col("bad"), F.col(seq))).alias("first_bad"))


def _folded(rows: DataFrame, chain: list[str], seq: str, payload: Column, stored: bool) -> DataFrame:
    """Reads every chain in order and adds its hashes, or with `stored` whether those that are there are right."""
    keys = [f"_k{i}" for i in range(len(chain))]
    ordered = rows.withColumns({k: F.col(c) for k, c in zip(keys, chain, strict=True)}).withColumn("_text", F.concat_ws("|", F.col(seq).cast("string"), payload))
    ordered = ordered.repartition(*chain).sortWithinPartitions(*chain, seq)
    kept = [seq, *chain] if stored else rows.columns
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    added = "bad boolean" if stored else "prev_hash string, self_hash string"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, before = None, GENESIS
        for batch in batches:
            out = []
            texts = zip(batch["_text"], *([batch["prev_hash"], batch["self_hash"]] if stored else []), strict=True)
            for key, (text, *found) in zip(batch[keys].astype(str).itertuples(index=False, name=None), texts, strict=True):
                if key != last:
                    last, before = key, GENESIS
                own = hashlib.sha256(f"{found[0] if stored else before}|{text}".encode()).hexdigest()
                out.append(found != [before, own] if stored else (before, own))
                before = found[1] if stored else own
            frame = batch[kept].reset_index(drop=True)
            yield frame.assign(bad=out) if stored else frame.assign(prev_hash=[x for x, _ in out], self_hash=[x for _, x in out])

    return ordered.mapInPandas(fold, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", {added}")


def illegal_transitions(moves: DataFrame) -> DataFrame:
    """Moves (from_state, to_state) that the state machine does not know."""
    known = moves.sparkSession.createDataFrame(TRANSITIONS, "from_state string, to_state string")
    return moves.join(F.broadcast(known), ["from_state", "to_state"], "left_anti")


def drift_domains(items: DataFrame, with_waived: bool = False) -> DataFrame:
    """Per domain: items, score, critical items, oldest age, days of work in progress. Items without a domain are 'unattributed'.

    Waived items count only on demand; an item without a state counts.
    """
    from veinway.functions.scores import drift_score

    items = items if with_waived else items.filter(~F.col("state").eqNullSafe("waived"))
    domains = F.when(F.size("domains") > 0, F.col("domains")).otherwise(F.array(F.lit("unattributed")))
    each = items.select(F.explode(domains).alias("domain"), "severity", "state", "age_days", "remediation_days")
    return each.groupBy("domain").agg(
        F.count("*").alias("items"), F.round(F.sum(drift_score(F.col("severity"), F.col("age_days"))), 2).alias("score"),
        F.count_if(F.col("severity") == "critical").alias("critical"), F.max("age_days").alias("oldest"),
        F.round(F.sum(F.when(F.col("state") == "in_flight", F.col("remediation_days")).otherwise(0.0)), 2).alias("in_flight_days"),
    )


def drift_changes(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, change): found again is bumped, new is opened, gone is resolved."""
    a, b = before.select(key).distinct().withColumn("_was", F.lit(True)), now.select(key).distinct().withColumn("_is", F.lit(True))
    change = F.when(F.col("_was").isNull(), "opened").when(F.col("_is").isNull(), "resolved").otherwise("bumped")
    return a.join(b, key, "full").select(key, change.alias("change"))


def compacted(turns: DataFrame, by: str, at: str, tokens: str, least_turns: int = 12, budget: int = 0, first: int = 2, last: int = 10) -> DataFrame:
    """Long conversations keep their first and last turns; one marker row (is_marker) stands for the turns between."""
    w = Window.partitionBy(by)
    r = turns.withColumns({
        "_n": F.count("*").over(w), "_t": F.sum(tokens).over(w), "_up": F.row_number().over(w.orderBy(at)), "_down": F.row_number().over(w.orderBy(F.desc(at))),
    })
    long = (F.col("_n") >= least_turns) & (F.col("_t") > budget) & (F.col("_n") > first + last)
    middle = long & (F.col("_up") > first) & (F.col("_down") > last)
    kept = r.filter(~middle).select(by, at, F.lit(False).alias("is_marker"), F.lit(1).cast("long").alias("turns"))
    marker = r.filter(middle).groupBy(by).agg(F.min(at).alias(at), F.count("*").alias("turns")).select(by, at, F.lit(True).alias("is_marker"), "turns")
    return kept.unionByName(marker)
