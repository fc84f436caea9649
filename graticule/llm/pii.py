"""Personal data by fixed patterns and by contexts bootstrapped from them (operator 10).

What the fixed patterns find seeds a graph of lexical contexts and instances: an instance is a token that looks
like an identifier (some digits, or an at sign), a context is the two words before it, or the word before and the
word after. Spark scores the graph in turns until no context is added: a context by its instances believed to be of
one kind against those that contradict it, an instance by the contexts it stands in. Contexts that stay sure, with enough different
instances, mark the identifier-like tokens beside them that the fixed patterns miss.

The graph is built from all documents; only contexts above the threshold leave Spark, and they are matched in
blocks of bounded size in a last pass over the texts, which needs no join by document.

Words of a context and tokens may be of any length; in the graph, ones of over ``LONG`` characters go by their digest.

Defined results: null and empty texts have no spans; texts of any length are read whole; a marked token never
overlaps a base span; of contexts that tie, a token takes the kind listed first; repeated rows each get their row, and
in the graph an instance counts once a context; an empty table gives an empty result; other columns pass through
unread, but ones with the names of the results, or named as ``into``, are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import materialize, small_batches, unused

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. An address is found from its at sign, which reads long texts in one go.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

LEAST_DIGITS, LONG = 5, 64
SUPPORT, SURE = 5, 0.9
BLOCK = 200_000

SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SPANS = T.ArrayType(SPAN)


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    if "." in text:
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_EDGES = ".,;:!?()[]\"'|"


def _named(word: str) -> str:
    """A word in lower case, or its digest where it is long."""
    word = word.lower()
    return word if len(word) <= LONG else f"#{hashlib.sha256(word.encode()).hexdigest()}"


def _word(text: str, at: int, step: int) -> tuple[str, int]:
    """The next word from ``at`` on (step 1) or before it (step -1), without edges, and where it ends."""
    n = len(text)
    look = at if step > 0 else at - 1
    while 0 <= look < n and text[look].isspace():
        look += step
    first = look
    while 0 <= look < n and not text[look].isspace():
        look += step
    word = text[first:look] if step > 0 else text[look + 1 : first + 1]
    return _named(word.strip(_EDGES)) if word.strip(_EDGES) else "", look if step > 0 else look + 1


def _context(text: str, start: int, end: int) -> list[str]:
    """The contexts of a place: two words before, or one before and one after."""
    one, at = _word(text, start, -1)
    two, _ = _word(text, at, -1)
    after, _ = _word(text, end, 1)
    return [c for c, use in ((f"{two} {one} _", one and two), (f"{one} _ {after}", one and after)) if use]


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens that look like identifiers and touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    k, done, n = 0, 0, len(text)
    for m in re.finditer(r"[0-9@]", text):
        at = m.start()
        if at < done:
            continue
        start = end = at
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < n and not text[end].isspace():
            end += 1
        done = end
        while start < end and not (text[start].isalnum() or text[start] in "_@+"):
            start += 1
        while end > start and not (text[end - 1].isalnum() or text[end - 1] == "_"):
            end -= 1
        token = text[start:end]
        if not token or sum(c.isdigit() for c in token) < LEAST_DIGITS and "@" not in token[1:-1]:
            continue
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        yield start, end


def occurrences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(context, instance, kind) of each base span (its kind) and candidate (-1) in every text."""

    def run(batches):
        for batch in batches:
            rows: list[tuple[str, str, int]] = []
            for text in batch.column("_text").to_pylist():
                if not text or "@" not in text and not DIGIT.search(text):
                    continue
                base = base_spans(text)
                for kind, a, b in base + [(-1, a, b) for a, b in candidates(text, base)]:
                    rows += [(c, _named(text[a:b]), kind) for c in _context(text, a, b)]
            if rows:
                c, i, k = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(k, pa.int32())], names=["context", "instance", "kind"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "context string, instance string, kind int")


def learn_contexts(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """(context, kind) of the contexts that mark identifiers: at least ``support`` instances are believed to be of the kind, and ``sure`` of those that tell.

    Against a kind tell instances believed to be of other kinds only, and unseen ones that stand in a poor context, one
    of whose instances some, but less than 1 - ``sure``, are believed. Other unseen instances tell nothing. Turns go on until none adds a context.
    """
    edges = materialize(occurrences(docs, text_col).groupBy("context", "instance").agg(F.max("kind").alias("kind"), F.count("*").alias("n")), "contexts")
    # contexts with one instance can never reach the support
    wide = edges.groupBy("context").agg(F.count("*").alias("width")).where(F.col("width") >= support).select("context")
    edges = materialize(edges.join(wide, "context"), "contexts")
    base = edges.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("belief")).distinct()
    believed, seen = base, None
    while True:
        met = edges.select("context", "instance").join(believed, "instance", "left")
        each = materialize(met.groupBy("context", "instance").agg(F.count("kind").alias("kinds")), "believed-edges")
        rich = each.groupBy("context").agg(F.count("*").alias("all"), F.count_if(F.col("kinds") > 0).alias("known"))
        poor = rich.where((F.col("known") > 0) & (F.col("known") < (1 - sure) * F.col("all"))).select("context")
        against = each.where("kinds = 0").select("context", "instance").join(each.join(poor, "context").where("kinds = 0").select("instance").distinct(), "instance").groupBy("context").agg(F.count("*").alias("against"))
        scored = met.where("kind is not null").groupBy("context", "kind").agg(F.sum("belief").alias("mass"), F.count_distinct("instance").alias("of_kind"))
        telling = scored.join(rich, "context").join(against, "context", "left").withColumn("share", F.col("mass") / (F.col("known") + F.coalesce("against", F.lit(0))))
        contexts = materialize(telling.where((F.col("share") >= sure) & (F.col("of_kind") >= support)).select("context", "kind", "share"), "sure-contexts")
        added = contexts.select("context", "kind") if seen is None else contexts.select("context", "kind").join(seen, ["context", "kind"], "left_anti")
        if added.isEmpty():
            break
        seen = materialize(added if seen is None else seen.unionAll(added), "seen-contexts")
        new = edges.where("kind < 0").select("context", "instance").join(contexts, "context").groupBy("instance", "kind").agg(F.max("share").alias("belief"))
        believed = materialize(base.unionAll(new.join(base.select("instance", "kind"), ["instance", "kind"], "left_anti").select("instance", "kind", "belief")), "believed")
    best = contexts.groupBy("context").agg(F.max(F.struct("share", F.col("kind"))).alias("b"))
    return best.select("context", "b.kind")


FOUND = T.StructType([T.StructField("base", SPANS), T.StructField("spans", SPANS), T.StructField("masked", T.StringType())])


def mark(text: str, base: list[tuple[int, int, int]], spans: set[tuple[int, int, int]], known: dict[str, int]) -> list[tuple[int, int, int]]:
    """``spans`` and the candidates of ``text`` that the contexts ``known`` mark and no span has yet, by kind, then start."""
    if known and text and ("@" in text or DIGIT.search(text)):
        for a, z in candidates(text, base):
            kinds = [known[c] for c in _context(text, a, z) if c in known]
            if kinds and not any((k, a, z) in spans for k in range(len(KINDS))):
                spans.add((min(kinds), a, z))
    return sorted(spans)


def find_pii(docs: DataFrame, contexts: DataFrame, text_col: str = "text", into: str = "_pii", block: int = BLOCK, masked: bool = False) -> DataFrame:
    """``docs`` with ``into``: base spans, all spans with those that ``contexts`` mark, as array<struct<kind, start, end>> by kind, then start, and the masked text.

    Contexts reach the executors in blocks of at most ``block``; with one block all is done in one pass of one function.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    blocks = _blocks(contexts, block)
    known, later = next(blocks, {}), next(blocks, None)
    shared, whole = sc.broadcast(known), masked and later is None

    def first(texts: pa.Array) -> pa.Array:
        plain = texts.to_pylist()
        base = [base_spans(x or "") for x in plain]
        spans = [mark(x, b, set(b), shared.value) for x, b in zip(plain, base)]
        told = [mask_text(x, s) if x is not None and s else x for x, s in zip(plain, spans)] if whole else [None] * len(plain)
        return pa.StructArray.from_arrays([_span_array(base), _span_array(spans), pa.array(told, pa.string())], names=FOUND.names)

    docs = docs.withColumn(into, F.arrow_udf(first, FOUND)(F.col(text_col)))
    while later is not None:
        held = sc.broadcast(later)
        later = next(blocks, None)
        docs = docs.withColumn(into, F.arrow_udf(_more(held, masked and later is None), FOUND)(F.col(text_col), F.col(into).getField("base"), F.col(into).getField("spans")))
    return docs


def _more(held, last: bool):
    """What a further block of contexts adds."""

    def run(texts: pa.Array, base: pa.Array, found: pa.Array) -> pa.Array:
        plain, own = texts.to_pylist(), [[(x["kind"], x["start"], x["end"]) for x in b] for b in base.to_pylist()]
        spans = [mark(x, b, {(s["kind"], s["start"], s["end"]) for s in f}, held.value) for x, b, f in zip(plain, own, found.to_pylist())]
        told = [mask_text(x, s) if x is not None and s else x for x, s in zip(plain, spans)] if last else [None] * len(plain)
        return pa.StructArray.from_arrays([_span_array(own), _span_array(spans), pa.array(told, pa.string())], names=FOUND.names)

    return run


def _blocks(contexts: DataFrame, block: int) -> Iterator[dict[str, int]]:
    known: dict[str, int] = {}
    for row in contexts.toLocalIterator():
        known[row.context] = row.kind
        if len(known) >= block:
            yield known
            known = {}
    if known:
        yield known


def _span_array(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [s for row in rows for s in row]
    sizes = [0]
    for row in rows:
        sizes.append(sizes[-1] + len(row))
    fields = [pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.int64()), pa.array([s[2] for s in flat], pa.int64())]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(fields, names=["kind", "start", "end"]))


def named(spans: Column) -> Column:
    """kind:start:end of a column of spans, in its order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans."""
    into = unused(docs, "pii")
    found = find_pii(docs, learn_contexts(docs, text_col), text_col, into)
    base, spans = F.col(into).getField("base"), F.col(into).getField("spans")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    given = ("n_email", "n_ip", "n_card", "n_phone", "n_context", "base_sha256", "spans")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c.lower() not in given]
    return found.select(*others, *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], (F.size(spans) - F.size(base)).cast("bigint").alias("n_context"), F.sha2(named(base), 256).alias("base_sha256"), named(spans).alias("spans"))


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlaps joined, replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind; ``size_col``, if there, is the new length."""
    into = unused(docs, "pii")
    found = find_pii(docs, learn_contexts(docs, text_col), text_col, into, masked=True)
    told = found.withColumn(text_col, F.col(into).getField("masked"))
    if size_col and size_col in docs.columns:
        told = told.withColumn(size_col, F.when(F.size(F.col(into).getField("spans")) > 0, F.length(text_col).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    return told.select(*[F.col(f"`{c}`") for c in docs.columns])


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    """The digest that ``base_sha256`` holds, for tests and single texts."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
