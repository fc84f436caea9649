"""Secret scan with multipart credential linking (operator 2), in DataFrame functions only.

Certain parts are found by fixed patterns: assignments to telling names, access identifiers, long hex runs.
Weak parts prove nothing alone: base64-like runs of 40 characters, and shorter key identifiers. They are
reported only where complementary parts lie within ``REACH`` characters in the same scope (the document): a
weak secret beside an access or key identifier, a weak identifier beside a weak secret and a service endpoint.
This is an interval join on (document, stretch of ``REACH`` characters): a part is in every stretch it touches, a
weak part looks into every stretch it reaches. Of each kind only the first start and last end in a stretch are
needed to decide whether any lies in reach, so parts never meet as pairs.

Matches are cut out of a text with ``split``: lengths of the pieces between them give their places, in code
points. Only documents with weak parts take part in the join.

Defined results: null and empty texts have no spans; texts of any length are scanned whole; the same characters may
belong to spans of several kinds; spans that start together are ordered by kind, then end; repeated rows each get
their row; an empty table gives an empty result; other columns pass through, whatever their names, but ones with the
names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .workspace import materialize, packed, unpacked

#: The base patterns.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}+"
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: Weak parts, and the endpoints that go with them.
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
WEAK_ID = r"(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA|ABIA|ACCA)[A-Z0-9]{12,}+"
ENDPOINT = r"(?:https?://|(?<![A-Za-z0-9.-]))(?:[a-z0-9-]+\.)*(?:s3|sts|iam|ec2|sqs|sns|dynamodb|storage|blob|api)(?:[.-][a-z0-9-]+)*\.(?:com|net|io)\b"
REACH = 200
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "weak_id", "weak_secret")
#: Matches of a text that are walked through at a time.
BLOCK = 256


def _spans(text: Column, pattern: str, kind: int, keep_if: Column | None = None) -> Column:
    """array<struct<start, end, kind>> of the matches, leftmost first and without overlap. keep_if: an array of booleans."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x).cast("bigint"))
    pieces = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), (keep_if if keep_if is not None else F.transform(sizes, lambda _: F.lit(True))).alias("keep"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.coalesce(p["size"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.coalesce(p["keep"], F.lit(False)), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def walk(acc: Column, block: Column) -> Column:
        found = F.aggregate(block, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return let(found, lambda w: F.struct(w["at"].alias("at"), F.concat(acc["out"], F.array(w["out"])).alias("out")))

    # an array that grows by one match is copied each time, so it only grows within a block, and by whole blocks
    blocks = let(pieces, lambda every: F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int")), lambda k: F.slice(every, k * BLOCK + 1, BLOCK)))
    none = F.array().cast("array<array<struct<start:bigint,end:bigint,kind:int>>>")
    return F.aggregate(blocks, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), walk, lambda acc: F.flatten(acc["out"]))


def _where_found(text: Column, pattern: str, spans: Column) -> Column:
    """``spans`` only for texts in which ``pattern``, a cheaper test, is found."""
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>"))


def find_parts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """_row, _doc (the other columns) and arrays of spans: _s_base (kinds 0 to 2), _s_weak (3 and 4), _s_ends (5)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= ASSIGN_LEAST)
    access_enough = F.transform(F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), lambda x: F.length(x) >= ACCESS_LEAST)
    assign = _where_found(text, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", _spans(text, ASSIGN, 0, long_enough))
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, 1, access_enough)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>"))
    hexes = _where_found(text, "[0-9a-f]{32}", _spans(text, HEX, 2))
    weak_id = _where_found(text, "(?:ASIA|AROA|AIDA|ABIA|ACCA)[A-Z0-9]{12}", _spans(text, WEAK_ID, 3))
    weak_secret = _where_found(text, "[A-Za-z0-9+/]{40}", _spans(text, WEAK_SECRET, 4))
    weak = F.concat(weak_id, weak_secret)
    parts = docs.select(F.monotonically_increasing_id().alias("_row"), packed(docs, text_col), F.col(text_col).alias("_text"), F.concat(assign, access, hexes).alias("_s_base"), weak.alias("_s_weak"))
    ends = F.when(F.size("_s_weak") > 0, _spans(F.coalesce(F.col("_text"), F.lit("")), ENDPOINT, 5)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>"))
    return parts.withColumn("_s_ends", ends).drop("_text")


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(_row, _s_extra): the weak spans that complementary parts within ``reach`` characters confirm.

    parts: a written table, as it is read twice.
    """
    stretches = lambda first, last: F.explode(F.expr(f"sequence(greatest(0, {first}) div {reach}, ({last}) div {reach})"))
    every = parts.where(F.size("_s_weak") > 0).select("_row", F.explode(F.concat("_s_base", "_s_weak", "_s_ends")).alias("p")).select("_row", "p.start", "p.end", "p.kind")
    touched = every.select("*", stretches("start", "end").alias("stretch"))
    near = touched.groupBy("_row", "stretch", F.col("kind").alias("other")).agg(F.max("end").alias("last"), F.min("start").alias("first"))
    weak = every.where(F.col("kind").isin(3, 4)).select("*", stretches(f"start - {reach}", f"end + {reach}").alias("stretch"))
    met = weak.join(near, ["_row", "stretch"])
    # where neither the last end lies before a weak part nor the first start after it, one that touches the stretch is nearer than its length
    in_reach = F.greatest(F.col("start") - F.col("last"), F.col("first") - F.col("end")) <= reach
    of = lambda *kinds: F.max(F.when(in_reach & F.col("other").isin(*kinds), True).otherwise(False))
    told = met.groupBy("_row", "start", "end", "kind").agg(of(1, 3).alias("identifier"), of(4, 0).alias("secret"), of(5).alias("endpoint"))
    sure = told.where(((F.col("kind") == 4) & F.col("identifier")) | ((F.col("kind") == 3) & F.col("secret") & F.col("endpoint")))
    return sure.groupBy("_row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("_s_extra"))


def _named(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """The columns of ``docs`` but the text, with n_assign, n_access, n_hex, n_weak, base_sha256, spans, which replace any of these names."""
    parts = materialize(find_parts(docs, text_col), "secret-parts")
    joined = parts.join(link_parts(parts, reach), "_row", "left")
    count = lambda kind: F.size(F.filter("_s_base", lambda s: s["kind"] == kind)).cast("bigint")
    extra = F.coalesce("_s_extra", F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>"))
    others = [c for c in unpacked(docs, text_col) if c[0] not in ("n_assign", "n_access", "n_hex", "n_weak", "base_sha256", "spans")]
    return joined.select(
        *[c.alias(name) for name, c in others], count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size(extra).cast("bigint").alias("n_weak"),
        F.sha2(_named(F.col("_s_base")), 256).alias("base_sha256"), _named(F.concat("_s_base", extra)).alias("spans"),
    )
