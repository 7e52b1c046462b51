"""Personal data with its place in the text: patterns, checked numbers and names of a dictionary."""

import ipaddress
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a finding, in this order.
PATTERNS = {
    "email": r"(?<![.\w@])[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}(?!\w)",
    "phone": r"(?<!\d)(?:(?:\+?1[\s\-.]?)?[\(\[]?\d{3}[\)\]]?[\s\-.]\d{3}[\s\-.]\d{4}|\+[1-9]\d{6,14})(?!\d)",
    "ssn": r"(?<!\d)(?!000|666|9\d\d)[0-9]{3}[\s\-]?(?!00)[0-9]{2}[\s\-]?(?!0000)[0-9]{4}(?!\d)",
    "credit_card": r"(?<!\d)(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}(?:\d{3})?(?!\d)",
    "ip_address": r"(?<![.\d])(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?![\d.])",
    "api_key": r"sk-ant-api\d{2}-[A-Za-z0-9\-_]{16,}|sk-[A-Za-z0-9]{32,}|AKIA[0-9A-Z]{16}|(?:github|gh)_(?:pat_)?[A-Za-z0-9_]{20,}|sk-proj-[A-Za-z0-9\-_]{20,}"
    r"|glpat-[A-Za-z0-9\-_]{20,}|xoxb-[0-9]+-[A-Za-z0-9\-]+|xoxp-[0-9]+-[A-Za-z0-9\-]+"
    # a run that is not followed by a quote, space or end fails wherever it is entered: it is entered at its start alone, or behind a key that was taken off it
    r"|(?:(?<![A-Za-z0-9])|(?<=AKIA[0-9A-Z]{16}))[A-Za-z0-9]{32,}+(?=[\"'\s]|$)",
    "ipv6": r"(?<![:\w.])(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?![:\w])",
}
NAME = r"\b[A-Z][a-z]{1,20}\b"
PRIVATE = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")]
CONFIDENCE = {"credit_card": 0.99, "private address": 0.5, "personal_name": 0.7}
FINDING = "struct<kind:string,start:int,end:int,confidence:double,detector:string>"


def luhn(digits: str) -> bool:
    """The check sum of 13 to 19 digits."""
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and total % 10 == 0


def confidence(kind: str, value: str) -> float | None:
    """How sure a match of a pattern is; None where a check tells that it is none."""
    if kind == "credit_card":
        return CONFIDENCE[kind] if luhn(re.sub(r"\D", "", value)) else None
    if kind == "api_key" and len(value) < 20:
        return None
    if kind == "ip_address":
        address = ipaddress.ip_address(".".join(str(int(x)) for x in value.split(".")))
        return CONFIDENCE["private address"] if any(address in n for n in PRIVATE) else 0.95
    if kind == "ipv6":
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return None
        return 0.95 if value.strip(":") else None
    return 0.95


class Inside:
    """Does a place lie inside one of the spans? They are swept once into a union of intervals."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def __contains__(self, place: int) -> bool:
        at = bisect_right(self.starts, place) - 1
        return at >= 0 and place < self.ends[at]


def automaton(names: list[str]) -> Callable[[str], list[tuple[int, int]]]:
    """A search for all of the names at once: (start, end) of those that stand alone as words."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for name in names:
        machine.add_word(name, len(name))
    if not names:
        return lambda text: []
    machine.make_automaton()
    inner = lambda c: c.isalnum() or c == "_"

    def search(text: str) -> list[tuple[int, int]]:
        found = ((last + 1 - size, last + 1) for last, size in machine.iter(text))
        return [(a, b) for a, b in found if not (a and inner(text[a - 1])) and not (b < len(text) and inner(text[b]))]

    return search


def pattern_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, confidence) of all patterns, in their order, then by place."""
    found = []
    for kind, pattern in _COMPILED.items():
        for m in pattern.finditer(text):
            sure = confidence(kind, m[0])
            if sure is not None:
                found.append((kind, m.start(), m.end(), sure))
    return found


_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}


def _spans(text: Column, search: Callable[[], Callable[[str], list[tuple[int, int]]]]) -> Column:
    built: list = []  # a task builds its search once

    @F.arrow_udf(f"array<{FINDING}>")
    def scan(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(search())
        find, out = built[0], []
        for t in texts:
            body = t.as_py() or ""
            found = [(*f, "regex") for f in pattern_spans(body)]
            taken = Inside([(a, b) for _, a, b, _, _ in found])
            found += [("personal_name", a, b, CONFIDENCE["personal_name"], "dictionary") for a, b in find(body) if a not in taken]
            out.append([dict(zip(("kind", "start", "end", "confidence", "detector"), f, strict=True)) for f in found])
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("detector", pa.string())])
        return pa.array(out, pa.list_(kind))

    return scan(text)


def pii_spans(df: DataFrame, id_column: str, text: str, names: DataFrame | None = None, most_names: int = 200_000) -> DataFrame:
    """(id, kind, value, start, end, confidence, detector) of each finding; places count code points from 0.

    Patterns may overlap each other. A word of the dictionary `names` (name; entries other than one
    capitalised word of 2 to 21 letters are left out) is a finding unless it begins inside a
    pattern's. Up to `most_names` names go to every task as one automaton that reads a text once;
    of more, a task picks the capitalised words and they are joined to the names. Null
    and empty texts have no findings, repeated rows have theirs as often as they are there.
    """
    wanted = None if names is None else names.select(F.col("name")).filter(F.col("name").rlike(r"^[A-Z][a-z]{1,20}$")).distinct()
    known = [] if wanted is None else [r.name for r in wanted.limit(most_names + 1).collect()]
    joined = len(known) > most_names
    words = re.compile(NAME)
    search = (lambda: lambda t: [m.span() for m in words.finditer(t)]) if joined else (lambda: automaton(known))
    rows = df.select(id_column, F.col(text).alias("_text")).withColumn("_found", F.explode(_spans(F.col("_text"), search)))
    value = F.substring(F.col("_text"), F.col("_found.start") + 1, F.col("_found.end") - F.col("_found.start"))
    found = rows.select(id_column, value.alias("value"), "_found.*").select(id_column, "kind", "value", "start", "end", "confidence", "detector")
    if not joined:
        return found
    named = found.filter("kind = 'personal_name'").join(wanted.withColumnRenamed("name", "value"), "value", "left_semi")
    return found.filter("kind <> 'personal_name'").unionByName(named)


#: A batch's texts are Python strings so many bytes at a time.
SLICE_BYTES = 1 << 20


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about SLICE_BYTES, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield texts.slice(first, last - first)
        first = last


def redacted(text: Column) -> Column:
    """The text with `[REDACTED:kind]` in the place of every pattern's finding; of overlapping ones the first, then longest, counts. Null stays null."""

    def mask(body: str | None) -> str | None:
        if body is None:
            return None
        parts, at = [], 0
        for kind, start, end, _ in sorted(pattern_spans(body), key=lambda f: (f[1], -f[2])):
            if start >= at:
                parts += [body[at:start], f"[REDACTED:{kind}]"]
                at = end
        return "".join([*parts, body[at:]])

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([mask(t.as_py()) for t in some], pa.string()) for some in slices(texts)] or [pa.array([], pa.string())])

    return masked(text)
