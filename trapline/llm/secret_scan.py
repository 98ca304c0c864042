"""Secret scan: an inverted index of the trigrams that rules must contain, then verification of the candidates."""

from __future__ import annotations

from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.shared import written

# Kind, pattern, capturing group and how many characters it must have at least.
# The first three are the base rules; their order is that of kinds which start at the same place.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
BASE = ("assign", "access", "hex")

# Strings or alternatives that a query keeps apart at most; beyond, it asks for less.
MOST = 32
# Trigrams of an alternative that are looked for: so many of those with the fewest common letters.
RARE = 3
COMMON = "etaoinsrhldcu"

# A query is a list of alternatives; a text must have all trigrams of one of them.
Query = list[frozenset[str]]
ANY: Query = [frozenset()]


def _either(*queries: Query) -> Query:
    """A text must satisfy one of the queries; alternatives that contain another one are dropped."""
    found = {alternative for query in queries for alternative in query}
    kept = [a for a in found if not any(b < a for b in found)]
    return kept if len(kept) <= MOST else ANY


def _both(left: Query, right: Query) -> Query:
    product = {a | b for a in left for b in right}
    if len(product) > MOST:
        return left if right == ANY or (left != ANY and len(left) <= len(right)) else right
    return _either(list(product))


def _of_strings(strings: set[str]) -> Query:
    return _either([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _strings(op, value) -> set[str] | None:
    """All texts that a part of a pattern can match, if they are few; lower-cased."""
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.AT:
        return {""}
    if op is sre.IN:
        found = set()
        for kind, what in value:
            if kind is sre.LITERAL:
                found.add(chr(what).lower())
            elif kind is sre.RANGE and what[1] - what[0] < 4:
                found.update(chr(code).lower() for code in range(what[0], what[1] + 1))
            else:
                return None
        return found
    if op is sre.SUBPATTERN:
        return _all_strings(value[-1])
    if op is sre.BRANCH:
        parts = [_all_strings(part) for part in value[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 8 and (value[0] == value[1] or value[1] == 1):
        once = _all_strings(value[2])
        if once is None:
            return None
        repeated = _product([once] * value[1])
        return repeated if value[0] or repeated is None else repeated | {""}
    return None


def _product(parts: list[set[str] | None]) -> set[str] | None:
    found = {""}
    for part in parts:
        if part is None or len(found) * len(part) > MOST:
            return None
        found = {a + b for a in found for b in part}
    return found


def _all_strings(pattern) -> set[str] | None:
    return _product([_strings(op, value) for op, value in pattern])


def _query(pattern) -> Query:
    found, strings = ANY, {""}
    for op, value in pattern:
        part = _strings(op, value)
        longer = _product([strings, part])
        if longer is not None:
            strings = longer
            continue
        found, strings = _both(found, _of_strings(strings)), part or {""}
        if op is sre.SUBPATTERN:
            found = _both(found, _query(value[-1]))
        elif op is sre.BRANCH:
            found = _both(found, _either(*(_query(branch) for branch in value[1])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0]:
            found = _both(found, _query(value[2]))
    return _both(found, _of_strings(strings))


def _rare(alternative: frozenset[str]) -> frozenset[str]:
    """The trigrams of an alternative that are worth a search; any part of what a match must contain may be asked for."""
    ordered = sorted(alternative, key=lambda trigram: (sum(c in COMMON for c in trigram), trigram))
    return frozenset(ordered[:RARE])


def trigram_query(pattern: str) -> Query | None:
    """Alternatives of lower-case trigrams, all of one of which every match contains; None if there are none."""
    query = _query(_parser.parse(pattern))
    return None if frozenset() in query else sorted(query, key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams over lower-cased whole texts.

    The one-element explode lowers each text in a step of its own; in one step, it would be lowered for every trigram.
    """
    lowered = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(F.lower(F.col(text_col)))).alias("lowered"))
    text = F.col("lowered")
    present = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in trigrams)))
    return lowered.select(F.explode(present).alias("trigram"), "doc_id")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, kinds): the rules of whose queries a document has all trigrams of an alternative.

    Postings are intersected by counting, per document and alternative, how many of the alternative's
    trigrams point to it; a trigram that nearly all documents have is spread over their ids.
    """
    asked = [
        F.struct(
            F.lit(f"{kind} {i}").alias("alternative"),
            F.lit(kind).alias("kind"),
            F.lit(trigram).alias("trigram"),
            F.lit(len(alternative)).alias("size"),
        )
        for kind, query in queries.items()
        for i, alternative in enumerate(query)
        for trigram in sorted(alternative)
    ]
    # As many rows as the rules have trigrams.
    asked = index.sparkSession.range(1).select(F.inline(F.array(*asked)))
    hits = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "alternative", "kind", "size")
    complete = hits.agg(F.count_distinct("trigram").alias("n")).filter("n = size")
    return complete.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end) in code points of the matches whose group is long enough.

    Splitting at the matches gives the texts between them; places are running
    sums of both lengths.
    """
    regex = F.lit(pattern)
    lengths = F.zip_with(
        F.zip_with(
            F.split(text, pattern, -1),
            F.regexp_extract_all(text, regex, F.lit(0)),
            lambda gap, match: F.struct(F.char_length(gap).alias("gap"), F.char_length(match).alias("match")),
        ),
        F.regexp_extract_all(text, regex, F.lit(group)),
        lambda pair, value: F.struct(
            pair["gap"].alias("gap"), pair["match"].alias("match"), F.char_length(value).alias("value")
        ),
    )
    span = "struct<start:bigint,end:bigint>"
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def add(state: Column, one: Column) -> Column:
        start = state["at"] + one["gap"]
        end = start + one["match"]
        kept = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"), F.when(one["value"] >= least, F.concat(state["spans"], kept)).otherwise(state["spans"]).alias("spans")
        )

    # The last part of the split has no match after it.
    found = F.aggregate(F.filter(lengths, lambda one: one["match"].isNotNull()), empty, add)["spans"]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{span}>"))


def _named(order: int, kind: str):
    return lambda span: F.struct(
        span["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), span["end"].alias("end")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, found (array of kind, start, end by start, then the order of the rules).

    Places are code points of the whole text, ``end`` exclusive; matches of a rule are
    leftmost and do not overlap each other.  Each rule with mandatory trigrams is tried only on the candidates of
    the index, the others on all texts.  The index holds the rules' trigrams, is written once, and
    can serve again.  Candidates are joined without a hint, so few of them are broadcast by
    their size and many shuffle.

    Cases: a null text counts as empty and has no spans; rows that share an id are scanned each for
    itself; rows without an id are not indexed and tried with every rule; an empty table gives no
    rows.  Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = {kind: query for kind, pattern, _, _ in rules if (query := trigram_query(pattern))}
    queries = {kind: sorted(set(map(_rare, query)), key=sorted) for kind, query in queries.items()}
    trigrams = sorted({trigram for query in queries.values() for alternative in query for trigram in alternative})
    tried = rows
    if trigrams:
        index = written(trigram_index(rows.filter("doc_id IS NOT NULL"), trigrams, "doc_id", "text"), "secret-index")
        hits = written(candidates(index, queries), "secret-candidates")
        tried = rows.join(hits, "doc_id", "left")
    found = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        spans = _spans(F.col("text"), pattern, group, least)
        if kind in queries:
            spans = F.when(F.col("doc_id").isNull() | F.array_contains("kinds", kind), spans)
        none = F.array().cast("array<struct<start:bigint,end:bigint>>")
        found.append(F.transform(F.coalesce(spans, none), _named(order, kind)))
    return tried.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(
        F.transform(
            found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 of their spans, and all spans as text."""
    base = F.filter("found", lambda span: span["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")
    )
