"""Tool calls and their results: linked by identifier, ordered by dependency, validated, as canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.shared import slices, written

# Rounds of pointer doubling: enough for chains of 2^40 calls.
MAX_ROUNDS = 40
# JSON types of a schema's properties and the Python types of their values.
TYPES = {
    "string": (str,),
    "integer": (int,),
    "number": (int, float),
    "boolean": (bool,),
    "object": (dict,),
    "array": (list,),
    "null": (type(None),),
}


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no escapes beyond the necessary; not for NaN, infinities or half characters."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    text.encode()  # a lone surrogate is an error here already
    return text


def violations(value, schema: Mapping, path: str = "") -> list[str]:
    """What is wrong with ``value``.  Known are type, properties, required, additionalProperties, items, enum, and bounds."""
    here, found = path or "arguments", []
    kind = schema.get("type")
    if kind and not (isinstance(value, TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))):
        return [f"{here}: not of type {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{here}: not one of the values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            found.append(f"{here}: out of bounds")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            found.append(f"{here}: wrong length")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{here}: {name} is missing" for name in schema.get("required", ()) if name not in value]
        for name, part in sorted(value.items()):
            if name in known:
                found += violations(part, known[name], f"{path}.{name}".lstrip("."))
            elif schema.get("additionalProperties") is False:
                found.append(f"{here}: {name} is not known")
    if isinstance(value, list) and "items" in schema:
        for i, part in enumerate(value):
            found += violations(part, schema["items"], f"{path}[{i}]")
    return found


def _chains(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, top, steps, degree): the end of the chain that each call hangs on, so many steps above it.

    A chain goes up through calls with one predecessor and ends at one with none or several.  ``top`` is null on a cycle
    of such calls and after one.  Pointer doubling: every round a call's pointer goes to where its target's points, so
    the rounds are the logarithm of the longest chain, and each is one join on hashed identifiers.  Calls of
    one conversation, however many, are spread over all tasks.
    """
    keys = ["conv_id", "call_id"]
    found = needs.groupBy(*keys).agg(F.count(F.lit(1)).alias("degree"), F.min("after").alias("one"))
    state = calls.select(*keys).join(found, keys, "left").select(
        *keys,
        F.coalesce("degree", F.lit(0)).alias("degree"),
        F.when(F.col("degree") == 1, F.col("one")).otherwise(F.col("call_id")).alias("up"),
        F.when(F.col("degree") == 1, 1).otherwise(0).cast("long").alias("steps"),
        (F.coalesce("degree", F.lit(0)) != 1).alias("ended"),
    )
    state = written(state, "calls-chains")
    total = state.count()
    for doubled in range(MAX_ROUNDS):
        if 1 << doubled > 2 * total or state.filter("NOT ended").isEmpty():
            break
        above = state.select(
            "conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"),
            F.col("ended").alias("over"),
        )
        state = state.join(above, ["conv_id", "up"]).select(
            *keys, "degree", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("ended") | F.col("over")).alias("ended"),
        )
        state = written(state, "calls-chains")
    return state.select(*keys, F.expr("CASE WHEN ended THEN up END").alias("top"), "steps", "degree")


def _levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest way up to a call without predecessor; null on a cycle and after one.

    ``needs``: distinct pairs of known calls (conv_id, call_id, after).  Chains are contracted first.  What is left are
    calls of several predecessors, which get their level in the round after the last of these has one: a join for each
    of the most such calls that any way passes, and none where no call has several.
    """
    keys = ["conv_id", "call_id"]
    chains = _chains(calls, needs)
    ends = chains.filter("degree = 0").select(*keys, F.lit(0).cast("long").alias("level"))
    several = chains.filter("degree > 1").select(*keys)
    if not several.isEmpty():
        above = chains.select("conv_id", F.col("call_id").alias("after"), "top", (F.col("steps") + 1).alias("steps"))
        open_ = needs.join(several, keys, "left_semi").join(above, ["conv_id", "after"])
        # The longest of several chains between two ends; a null top is a cycle and never gets a level.
        open_ = open_.groupBy(*keys, "top").agg(F.max("steps").alias("steps"))
        open_ = written(open_.withColumn("got", F.lit(None).cast("long")), "calls-open")
        front, solved = ends, [ends]
        while True:
            reached = front.select("conv_id", F.col("call_id").alias("top"), "level")
            open_ = open_.join(reached, ["conv_id", "top"], "left").select(
                *keys, "top", "steps", F.coalesce("got", F.col("level") + F.col("steps")).alias("got")
            )
            open_ = written(open_, "calls-open")
            front = open_.groupBy(*keys).agg(F.max("got").alias("level"), F.count("got").alias("n"), F.count(F.lit(1)).alias("all"))
            front = written(front.filter("n = all").select(*keys, "level"), "calls-front")
            if front.isEmpty():
                break
            solved.append(front)
            open_ = open_.join(front, keys, "left_anti")
        ends = reduce(DataFrame.unionByName, solved)
    ends = ends.select("conv_id", F.col("call_id").alias("top"), F.col("level").alias("base"))
    return chains.join(ends, ["conv_id", "top"], "left").select(*keys, (F.col("base") + F.col("steps")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping], needs: DataFrame | None = None) -> DataFrame:
    """One row per call and per result without one: conv_id, call_id, level, turn, status, errors, record.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (the call that must come
    first, or null).  ``results``: conv_id, call_id, turn, content.  ``needs``: further predecessors, any number for
    a call, as pairs (conv_id, call_id, after).  Rows come sorted by
    conversation, level, turn and identifier, which is a topological order; the sort deals a large
    conversation over many tasks.  The level is the longest way up to a call that waits for none.  ``record`` is canonical JSON of name, arguments, result and identifiers.

    Status: ``ok``; ``invalid`` arguments (not JSON, an unknown tool, or against its schema,
    see ``errors``); ``unanswered`` if there is no result; ``cycle`` if the call waits for itself;
    ``orphan`` for a result without its call.  The first that applies of cycle, invalid, unanswered counts.

    Cases: of calls that share an identifier within a conversation the one of the smallest turn
    counts, then the smallest name and arguments; of several results the first by turn, then by content; a
    dependency on an unknown call is none; arguments that nest too deep, or with half of a surrogate pair, are not JSON; rows without conversation or identifier cannot be linked and
    are left out; null arguments are not JSON; null content is null in the record; empty tables give no rows.  Other
    columns are not read.
    """
    return _sorted(_linked(calls, results, schemas, needs))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.orderBy("conv_id", F.col("level").asc_nulls_last(), "turn", "call_id")


def _first_calls(calls: DataFrame) -> DataFrame:
    keys = ["conv_id", "call_id"]
    first = F.min(F.struct("turn", "name", "arguments", "after")).alias("call")
    return calls.select(*keys, "turn", "name", "arguments", "after").dropna(subset=keys).groupBy(*keys).agg(first)


def _first_results(results: DataFrame) -> DataFrame:
    # The second column sorts null content after texts.
    keys = ["conv_id", "call_id"]
    first = F.min(F.struct("turn", F.col("content").isNull().alias("none"), "content")).alias("result")
    return results.select(*keys, "turn", "content").dropna(subset=keys).groupBy(*keys).agg(first)


def _linked(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping], needs: DataFrame | None) -> DataFrame:
    keys = ["conv_id", "call_id"]
    calls = written(_first_calls(calls).select(*keys, "call.*"), "calls")
    results = written(_first_results(results).select(*keys, "result.turn", "result.content"), "call-results")
    pairs = calls.select(*keys, "after")
    if needs is not None:
        pairs = pairs.unionByName(needs.select(*keys, "after"))
    ids = calls.select(*keys)
    pairs = pairs.dropna().join(ids.withColumnRenamed("call_id", "after"), ["conv_id", "after"], "left_semi")
    pairs = pairs.join(ids, keys, "left_semi").select(*keys, "after").distinct()
    levels = _levels(ids, written(pairs, "calls-needs"))
    # One row for each identifier on the hashed side, so no identifier makes its table large.
    answers = results.select(*keys, F.col("turn").alias("answered"), "content").hint("shuffle_hash")
    linked = calls.join(answers, keys, "left").join(levels, keys)
    orphans = results.join(calls, keys, "left_anti")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, ids, level, turn, name, arguments, answered, content in slices(batches, 5):
            rows = []
            for i in range(len(ids)):
                value, errors = None, []
                try:
                    value = json.loads(arguments[i] or "")
                    canonical(value)
                except (ValueError, RecursionError):
                    value, errors = None, ["arguments: not JSON"]
                else:
                    errors = violations(value, schemas[name[i]]) if name[i] in schemas else ["name: unknown tool"]
                has_result = answered[i] is not None
                status = "cycle" if level[i] is None else "invalid" if errors else "ok" if has_result else "unanswered"
                record = {"id": ids[i], "name": name[i], "arguments": value, "result": content[i] if has_result else None}
                rows.append((conv[i], ids[i], level[i], turn[i], status, "; ".join(errors), canonical(record)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), types)],
                names=["conv_id", "call_id", "level", "turn", "status", "errors", "record"],
            )

    shape = "conv_id long, call_id string, level long, turn long, status string, errors string, record string"
    arguments = F.coalesce("arguments", F.lit(""))
    checked = linked.select(
        *keys, "level", "turn", "name", arguments.alias("arguments"), F.coalesce("answered", "turn").alias("at"), "content",
        F.col("answered").isNotNull().alias("has"),
    )
    checked = checked.select(
        F.col("conv_id").cast("long"), "call_id", "level", F.col("turn").cast("long"), "name", "arguments",
        F.when(F.col("has"), F.col("at")).alias("answered"), "content",
    ).mapInArrow(task, shape)
    lost = orphans.select(
        F.col("conv_id").cast("long"), "call_id", F.lit(None).cast("long").alias("level"), F.col("turn").cast("long"),
        F.lit("orphan").alias("status"), F.lit("").alias("errors"),
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))).alias("record"),
    )
    # Written before any sort, which looks at its input twice.
    return written(checked.unionByName(lost), "calls-checked")


def _aside(rows: DataFrame, columns: list[str], first: DataFrame, status: str) -> DataFrame:
    """Rows that do not count beside the first of their identifier, or that have none: each different row once, with its copies."""
    keys = ["conv_id", "call_id"]
    alike = rows.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("copies"))
    same = [F.col(column).eqNullSafe(F.col(f"first.{column}")) for column in columns]
    kept = F.when(F.col("first").isNotNull() & reduce(lambda x, y: x & y, same), 1).otherwise(0)
    found = alike.join(first, keys, "left").withColumn("copies", F.col("copies") - kept).filter("copies > 0")
    unlinked = F.col("conv_id").isNull() | F.col("call_id").isNull()
    return found.select(
        F.col("conv_id").cast("long"), "call_id", F.lit(None).cast("long").alias("level"), F.col("turn").cast("long"),
        F.when(unlinked, "unlinked").otherwise(status).alias("status"), F.lit("").alias("errors"),
        F.to_json(F.struct(F.col("call_id").alias("id"), *(c for c in columns if c not in ("turn", "after")))).alias("record"),
        "copies",
    )


def link_all(
    calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping], needs: DataFrame | None = None, others: DataFrame | None = None
) -> DataFrame:
    """The rows of ``link_calls`` and one for every other row of the input, with ``copies``, how many equal rows it stands for.

    Further statuses: ``repeated`` for a call whose identifier is that of an earlier one, ``surplus`` for a result beyond the
    first, ``unlinked`` for a call or result without conversation or identifier, ``other`` for rows of ``others``
    (conv_id, turn, role, content), which are neither.  Their level is null, and their record holds what they say as it is.
    The copies add up to the rows of the input.
    """
    linked = _linked(calls, results, schemas, needs).withColumn("copies", F.lit(1).cast("long"))
    repeated = _aside(calls, ["turn", "name", "arguments", "after"], _first_calls(calls).withColumnRenamed("call", "first"), "repeated")
    surplus = _aside(results, ["turn", "content"], _first_results(results).withColumnRenamed("result", "first"), "surplus")
    rows = linked.unionByName(repeated).unionByName(surplus)
    if others is not None:
        alike = others.groupBy("conv_id", "turn", "role", "content").agg(F.count(F.lit(1)).alias("copies"))
        rows = rows.unionByName(
            alike.select(
                F.col("conv_id").cast("long"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("level"),
                F.col("turn").cast("long"), F.lit("other").alias("status"), F.lit("").alias("errors"),
                F.to_json(F.struct("role", "content")).alias("record"), "copies",
            )
        )
    return _sorted(written(rows, "calls-all"))


def other_turns(turns: DataFrame) -> DataFrame:
    """Turns that ``calls_of_conversations`` reads neither as a call nor as a result."""
    neither = ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    return turns.filter(neither).select("conv_id", "turn", "role", F.col("text").alias("content"))


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) read as calls and results.

    What a user says is a call of the tool ``reply``, which waits for the call two turns
    earlier; what an assistant says is the result of the call one turn earlier.  Turns of any other role are
    neither (see ``other_turns``); turns without conversation or number have no identifier.
    """
    said = turns.withColumn("text", F.coalesce("text", F.lit("")))

    def name(back: int):
        return F.when(F.col("turn") >= back, F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string")))

    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.size(F.split("text", " ")).alias("words"), "turn"))
    calls = said.filter("role = 'user'").select(
        "conv_id", name(0).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), name(2).alias("after")
    )
    results = said.filter("role = 'assistant'").select("conv_id", name(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
