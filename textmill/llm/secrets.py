"""Secret scan with multipart credential linking.

Strong findings stand alone: assignments to names such as ``password``, access
identifiers, long runs of hex digits.  Other parts of a credential are too
common to report by themselves: user or client names, forty-character keys and
short assigned values, addresses of services.  These weak candidates are linked
by an interval join: within a scope (a block of lines without a blank one) and a
gap of ``REACH`` code points, an identifier needs a secret, a secret needs an
identifier or an endpoint, an endpoint needs both; strong findings count as
partners.  The gap is from the end of the one to the start of the other, 0 if
they overlap, so the length of a part never hides its neighbour.

Before the join the partners are reduced to the first start and the last end of
each role per scope and bin of ``REACH`` code points that they touch, so a
candidate meets the bins within its reach, however many parts a text has.

Defined results: a null text is empty; repeated rows are scanned alike; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read.
Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import stage, text_slices, trimmed

#: Greatest gap between two linked parts.
REACH = 400
#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")

_TO = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = re.compile(rf"(?=[pPsStTaA])(password|passwd|secret|token|api_?key){_TO}([A-Za-z0-9+/_.=-]+)", re.I | re.A)
#: A run of these characters is as long as it can be, so its least length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8

IDENTIFIER = re.compile(rf"\b(?:access_key_id|client_id|account(?:_id)?|user(?:name)?|login){_TO}[A-Za-z0-9_.@-]{{3,}}", re.I | re.A)
KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"""\b(?:https?|jdbc:[a-z]+|s3a?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\x09-\x0D\x20"'<>]{4,}""", re.A)
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
#: Shortest assigned value that may be a weak secret.
LEAST_SHORT = 4


def strong_spans(text: str) -> list:
    """``(kind, start, end)`` of the findings that stand alone, unordered."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGNED]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def weak_spans(text: str, strong: list) -> list:
    """``(kind, start, end)`` of candidates that overlap no strong finding."""
    out = []
    if "=" in text or ":" in text:
        out += [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
        out += [("key", *m.span()) for m in ASSIGN.finditer(text) if LEAST_SHORT <= len(m.group(2)) < LEAST_ASSIGNED]
    if "://" in text:
        out += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    for m in KEY.finditer(text):
        k = m.group()
        if re.search("[a-z]", k) and re.search("[A-Z]", k) and re.search("[0-9]", k):
            out.append(("key", *m.span()))
    taken, free = sorted((s, e) for _, s, e in strong), []
    at = 0
    for w in sorted(out, key=lambda w: w[1:]):
        while at < len(taken) and taken[at][1] <= w[1]:
            at += 1
        # strong spans of several kinds may nest: look at all that begin before the candidate's end
        if not any(s < w[2] and e > w[1] for s, e in _from(taken, at, w[2])):
            free.append(w)
    return free


def _from(spans: list, at: int, end: int):
    while at < len(spans) and spans[at][0] < end:
        yield spans[at]
        at += 1


ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}


def scan(docs: DataFrame) -> DataFrame:
    """Staged ``(rid, doc_id, base, parts)``: the strong spans of every row, and
    for texts with a weak candidate all parts with their role and scope."""
    def run(batches):
        import bisect

        import pyarrow as pa

        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        part = pa.struct([*span, ("role", pa.string()), ("scope", pa.int64()), ("weak", pa.bool_())])
        for batch in text_slices(batches):
            bases, parts = [], []
            for text in batch.column("text").to_pylist():
                strong = strong_spans(text or "")
                weak = weak_spans(text or "", strong)
                scopes = [0, *(m.end() for m in BLANK_LINE.finditer(text))] if weak else []
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in strong])
                parts.append([{"kind": k, "start": s, "end": e, "role": ROLES[k], "scope": bisect.bisect_right(scopes, s) - 1, "weak": w}
                              for group, w in ((strong, False), (weak, True)) for k, s, e in group] if weak else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, pa.list_(span)), pa.array(parts, pa.list_(part))],
                                             names=["doc_id", "base", "parts"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    span = "kind: string, start: bigint, end: bigint"
    found = docs.select("doc_id", "text").mapInArrow(
        trimmed(run), f"doc_id {id_type}, base array<struct<{span}>>, parts array<struct<{span}, role: string, scope: bigint, weak: boolean>>")
    return stage(found.withColumn("rid", F.monotonically_increasing_id()), "secret-parts")


def link(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """``(rid, kind, start, end, partners)`` of the weak candidates whose
    complementary parts co-occur; ``partners`` has the start of one part by role."""
    p = scanned.select("rid", F.explode("parts").alias("p")).select("rid", "p.*")
    bins_of = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach)))
    touched = p.select("rid", "scope", "role", "start", "end", bins_of(F.col("start"), F.col("end")).alias("bin"))
    bins = (touched.groupBy(F.col("rid").alias("rid1"), F.col("scope").alias("scope1"), F.col("role").alias("role1"), F.col("bin").alias("bin1"))
            .agg(F.min("start").alias("lo"), F.max(F.struct("end", "start")).alias("hi")))
    low, high = F.col("start") - reach, F.col("end") + reach
    weak = p.where("weak").withColumn("probe", bins_of(low, high))
    same = (F.col("rid") == F.col("rid1")) & (F.col("scope") == F.col("scope1")) & (F.col("probe") == F.col("bin1")) & (F.col("role") != F.col("role1"))
    # a part that touches a bin within the reach is near; in the first bin one must end late, in the last one start early enough
    first, last = F.col("probe") == F.floor(low / reach), F.col("probe") == F.floor(high / reach)
    near = F.when(first, F.col("hi.end") >= low).when(last, F.col("lo") <= high).otherwise(F.lit(True))
    j = weak.join(bins, same).where(near).withColumn("partner", F.when(first, F.col("hi.start")).otherwise(F.col("lo")))
    starts = {r: F.min(F.when(F.col("role1") == r, F.col("partner"))).alias(r) for r in ("identifier", "secret", "endpoint")}
    g = j.groupBy("rid", "role", "kind", "start", "end").agg(*starts.values())
    has = {r: F.col(r).isNotNull() for r in starts}
    told = (F.when(F.col("role") == "identifier", has["secret"]).when(F.col("role") == "secret", has["identifier"] | has["endpoint"])
            .otherwise(has["identifier"] & has["secret"]))
    return g.where(told).select("rid", "kind", "start", "end", F.struct(*starts).alias("partners"))


def listed(spans: Column) -> Column:
    """Spans in order of start, then kind, joined as ``kind:start:end`` by commas."""
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"),
                                                  s["end"].alias("end"), s["kind"].alias("kind")))
    text = F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` (strong spans) and
    ``linked`` (reported weak ones with their partners)."""
    scanned = scan(docs)
    some = scanned.where(F.size("parts") > 0)
    linked = link(some, reach).groupBy(F.col("rid").alias("rid1")).agg(F.collect_list(F.struct("kind", "start", "end", "partners")).alias("linked"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,partners:struct<identifier:bigint,secret:bigint,endpoint:bigint>>>")
    return (scanned.join(linked, F.col("rid") == F.col("rid1"), "left")
            .select("doc_id", "base", F.coalesce("linked", empty).alias("linked")))
