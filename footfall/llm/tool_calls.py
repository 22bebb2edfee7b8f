"""Tool-call linking: calls meet their results, in dependency order, checked and canonical.

Built from DataFrame functions alone.

* Calls and results are joined by conversation and call id. Results are reduced to one row
  per id first (the earliest; their number is kept), so many results of one call meet
  nowhere.
* ``calls.after`` names the calls a call builds on. A conversation whose calls only refer
  back is in topological order already: tier 0, ordered by ``seq``. In the others the tier is
  the length of the longest chain of calls below it. Each round draws the links through calls that
  have a single link themselves, so that a chain halves its length, and places those
  whose links all end at placed calls: as many rounds as the logarithm of the longest chain, or
  at most as its length where calls build on several others that wait. Sorting by (tier, seq) gives the order. Calls on or
  behind a cycle have a null tier and the error "cycle".
* Arguments are checked against the schema of their tool and written as canonical JSON: keys
  in code-unit order, no blanks, numbers without trailing zeros, shortest escapes.

Edge cases: a null or malformed arguments text, or one that is not an object, gives the error
"json" and null canonical arguments; repeated keys count as malformed. A tool without a schema
gives "tool". References to unknown calls give "reference" and order nothing. Of calls that
share an id the first by ``seq`` takes the result; the others get "repeated id" and no result.
A call with a null id links nothing. Results of unknown calls do not appear (``orphans`` lists
them). Empty tables give empty results.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import fresh_path, stash

# JSON types as the variant functions name them
TYPES = {
    "string": r"^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE)$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY<",
    "object": r"^OBJECT<",
    "null": r"^VOID$",
}

Schema = dict[str, dict[str, Any]]


def _field_errors(parsed: Column, name: str, rule: dict[str, Any]) -> list[Column]:
    """One column per rule: the error text where it is broken, else null."""
    path = f"$['{name}']"
    value = F.variant_get(parsed, path, "variant")
    kind = F.schema_of_variant(value)
    there = value.isNotNull()
    found = []
    if rule.get("required"):
        found.append(F.when(~there, F.lit(f"{name}: missing")))
    if "type" in rule:
        found.append(F.when(there & ~kind.rlike(TYPES[rule["type"]]), F.lit(f"{name}: type")))
    is_number = kind.rlike(TYPES["number"])
    number = F.when(is_number, F.try_variant_get(parsed, path, "double"))
    if "minimum" in rule:
        found.append(F.when(number < rule["minimum"], F.lit(f"{name}: minimum")))
    if "maximum" in rule:
        found.append(F.when(number > rule["maximum"], F.lit(f"{name}: maximum")))
    text = F.when(kind.rlike(TYPES["string"]), F.try_variant_get(parsed, path, "string"))
    if "min_length" in rule:
        found.append(F.when(F.length(text) < rule["min_length"], F.lit(f"{name}: length")))
    if "enum" in rule:
        allowed = text.isin(*rule["enum"])
        found.append(F.when(there & ~F.coalesce(allowed, F.lit(False)), F.lit(f"{name}: value")))
    return found


def argument_errors(
    tool: Column, parsed: Column, keys: Column, schemas: dict[str, Schema]
) -> Column:
    """Sorted error texts of parsed arguments with the given keys; empty where they are valid.

    A schema maps field names to rules (type, required, minimum, maximum, min_length, enum);
    fields it does not name are errors.
    """
    is_object = F.coalesce(F.schema_of_variant(parsed).rlike(TYPES["object"]), F.lit(False))
    known = F.when(~F.coalesce(tool.isin(*schemas), F.lit(False)), F.array(F.lit("tool")))
    errors = known.when(~is_object, F.array(F.lit("json")))
    for name, schema in schemas.items():
        rules = [e for field, rule in schema.items() for e in _field_errors(parsed, field, rule)]
        extra = F.array_except(keys, F.array(*map(F.lit, schema)))
        unknown = F.transform(extra, lambda k: F.concat(k, F.lit(": unknown")))
        found = F.concat(F.array_compact(F.array(*rules)), unknown)
        errors = errors.when(tool == name, F.array_sort(found))
    return errors


def canonical(parsed: Column) -> Column:
    """Canonical JSON of a parsed object; null for anything else."""
    return F.when(F.schema_of_variant(parsed).rlike(TYPES["object"]), F.to_json(parsed))


def _checked(calls: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """The calls with canonical arguments and the errors of these, written out: arguments
    are parsed once, and the joins to come carry plain columns."""
    parsed = calls.select(
        "conv_id",
        "seq",
        "call_id",
        "tool",
        "after",
        F.try_parse_json("arguments").alias("parsed"),
        F.json_object_keys("arguments").alias("keys"),
    )
    return stash(
        parsed.select(
            "conv_id",
            "seq",
            "call_id",
            "tool",
            "after",
            canonical(F.col("parsed")).alias("arguments"),
            argument_errors(F.col("tool"), F.col("parsed"), F.col("keys"), schemas).alias("errors"),
        ),
        "tool_calls",
    )


def tiers(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, tier) of the calls in conversations that refer forward.

    A call that no row of the result names is in tier 0.
    """
    named = calls.filter("call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min("seq").alias("seq")
    )
    links = calls.select("conv_id", "call_id", F.explode("after").alias("on")).distinct()
    target = named.select(
        F.col("conv_id").alias("c"), F.col("call_id").alias("on_id"), F.col("seq").alias("on_seq")
    )
    links = links.join(
        target, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("on") == F.col("on_id"))
    ).drop("c", "on_id")
    links = links.join(
        named.select(F.col("conv_id").alias("c"), F.col("call_id").alias("id"), "seq"),
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("id")),
    ).drop("c", "id")
    links = stash(links, "tool_links")
    forward = links.filter("on_seq >= seq").select(F.col("conv_id").alias("c")).distinct()
    mixed = F.col("conv_id").eqNullSafe(F.col("c"))
    left = stash(
        links.join(forward, mixed, "left_semi").select("conv_id", "call_id", "on"), "tool_links"
    )
    ahead = left.select(F.col("conv_id").alias("c"), F.col("call_id").alias("id")).distinct()
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("on") == F.col("id"))
    chains = _chains(
        left.join(ahead, same, "left").select(
            "conv_id",
            "call_id",
            F.when(F.col("id").isNotNull(), F.col("on")).alias("on"),
            F.lit(1).cast("long").alias("steps"),
            F.lit(1).cast("long").alias("least"),
        )
    )
    chains, path = stash(chains, "tool_chains"), fresh_path(calls.sparkSession, "tool_tiers")
    placed, n_waiting = _placed(chains, path)
    while n_waiting:
        chains = stash(_shortened(chains, placed), "tool_chains")
        placed, n_left = _placed(chains, path)
        if n_left == n_waiting:
            # nobody's turn came: all that wait are on a cycle or behind one
            return _placed(chains.filter(F.size("open") > 0), path, stuck=True)[0]
        n_waiting = n_left
    return placed


def _chains(links: DataFrame) -> DataFrame:
    """One row per call from rows of (conv_id, call_id, on, steps, least).

    ``open``: the calls it waits for, and how many tiers it is above each at least; ``least``:
    the tier that follows from those whose tier is known.
    """
    each = links.repartition("conv_id", "call_id").groupBy("conv_id", "call_id", "on")
    longest = each.agg(F.max("steps").alias("steps"), F.max("least").alias("least"))
    return longest.groupBy("conv_id", "call_id").agg(
        F.max("least").alias("least"),
        F.collect_list(F.when(F.col("on").isNotNull(), F.struct("on", "steps"))).alias("open"),
    )


# Only on a cycle do steps grow beyond the number of calls; they stop here.
MOST_STEPS = 1 << 60


def _shortened(chains: DataFrame, placed: DataFrame) -> DataFrame:
    """The calls that wait, each link drawn through where the next call is placed or has one link."""
    waiting = chains.filter(F.size("open") > 0)
    single = waiting.filter(F.size("open") == 1).select(
        F.col("conv_id").alias("c"),
        F.col("call_id").alias("id"),
        F.col("least").alias("more"),
        F.element_at("open", 1).alias("next"),
    )
    passed = single.unionByName(
        placed.select(
            F.col("conv_id").alias("c"), F.col("call_id").alias("id"), F.col("tier").alias("more")
        ),
        allowMissingColumns=True,
    )
    links = waiting.select("conv_id", "call_id", "least", F.explode("open").alias("link"))
    met = links.join(
        passed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("link.on") == F.col("id")), "left"
    )
    known, steps = F.col("id").isNotNull(), F.col("link.steps")

    def bounded(total: Column) -> Column:
        return F.least(total, F.lit(MOST_STEPS))

    return _chains(
        met.select(
            "conv_id",
            "call_id",
            F.when(known, F.col("next.on")).otherwise(F.col("link.on")).alias("on"),
            F.when(known, bounded(steps + F.col("next.steps"))).otherwise(steps).alias("steps"),
            F.greatest("least", F.when(known, bounded(steps + F.col("more")))).alias("least"),
        )
    )


def _placed(chains: DataFrame, path: str, stuck: bool = False) -> tuple[DataFrame, int]:
    """All tiers known so far, with those of the calls that wait no more, and how many do wait.

    The tiers of all rounds lie in one folder, so that reading them takes one step, not one a round.
    """
    tier = F.lit(-1).cast("long") if stuck else F.col("least")
    done = chains.filter(F.lit(stuck) | (F.size("open") == 0))
    done = done.select("conv_id", "call_id", tier.alias("tier"))
    done.write.mode("append").parquet(path)
    every = done.sparkSession.read.schema(done.schema).parquet(path)
    return every, 0 if stuck else chains.filter(F.size("open") > 0).count()


def link_tool_calls(
    calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]
) -> DataFrame:
    """One row per call: its place in the order, its errors, canonical JSON and result.

    calls: conv_id, seq, call_id, tool, arguments, after (array of call ids)
    results: conv_id, seq, call_id, content

    Returns conv_id, call_id, seq, tier, tool, arguments (canonical), errors, n_results,
    result and exchange, the whole as one canonical JSON text.
    """
    calls = _checked(calls, schemas)
    answers = (
        results.filter("call_id is not null")
        .groupBy(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"))
        .agg(
            F.count("*").alias("n_results"),
            F.min(F.struct("seq", "content"))["content"].alias("result"),
        )
    )
    first = (
        calls.filter("call_id is not null")
        .groupBy(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_call"))
        .agg(F.min("seq").alias("first_seq"))
    )
    known = calls.filter("call_id is not null").select(
        F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_call")
    ).distinct()
    wanted = calls.select("conv_id", "seq", "call_id", F.explode("after").alias("on"))
    lost = (
        wanted.join(
            known,
            F.col("conv_id").eqNullSafe(F.col("k_conv")) & (F.col("on") == F.col("k_call")),
            "left_anti",
        )
        .select(
            F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_call"), F.col("seq").alias("l_seq")
        )
        .distinct()
        .withColumn("lost", F.lit(True))
    )
    lost = stash(lost, "tool_lost")
    order = tiers(calls).select(
        F.col("conv_id").alias("t_conv"), F.col("call_id").alias("t_call"), "tier"
    )

    def met(prefix: str) -> Column:
        return F.col("conv_id").eqNullSafe(F.col(f"{prefix}_conv")) & (
            F.col("call_id") == F.col(f"{prefix}_call")
        )

    linked = (
        calls.join(first, met("f"), "left")
        .join(answers.hint("shuffle_hash"), met("r"), "left")
        .join(order, met("t"), "left")
        .join(
            lost,
            F.col("conv_id").eqNullSafe(F.col("l_conv"))
            & F.col("call_id").eqNullSafe(F.col("l_call"))
            & F.col("seq").eqNullSafe(F.col("l_seq")),
            "left",
        )
    )
    repeated = F.coalesce(F.col("seq") > F.col("first_seq"), F.lit(False))
    errors = F.concat(
        F.col("errors"),
        F.array_compact(
            F.array(
                F.when(repeated, F.lit("repeated id")),
                F.when(F.col("lost"), F.lit("reference")),
                F.when(F.col("tier") < 0, F.lit("cycle")),
            )
        ),
    )
    result = F.when(~repeated, F.col("result"))
    columns = {
        "errors": errors,
        "n_results": F.when(~repeated, F.coalesce("n_results", F.lit(0))).otherwise(F.lit(0)),
        "result": result,
        "tier": F.when(F.coalesce("tier", F.lit(0)) >= 0, F.coalesce("tier", F.lit(0))),
    }
    exchange = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"),
            F.col("call_id").alias("id"),
            F.col("tool").alias("name"),
            result.alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
    return linked.select(
        "conv_id",
        "call_id",
        F.col("seq").cast("long").alias("seq"),
        columns["tier"].alias("tier"),
        "tool",
        "arguments",
        columns["errors"].alias("errors"),
        columns["n_results"].cast("long").alias("n_results"),
        columns["result"].alias("result"),
        exchange.alias("exchange"),
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that no call of their conversation asked for."""
    asked = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("id")).distinct()
    met = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("id"))
    return results.join(asked, met, "left_anti")


SCHEMAS: dict[str, Schema] = {
    "search": {
        "query": {"type": "string", "required": True, "min_length": 1},
        "limit": {"type": "integer", "minimum": 1, "maximum": 40},
    },
    "count": {
        "what": {"type": "string", "required": True, "enum": ["words", "lines"]},
        "text": {"type": "string", "required": True},
    },
    "measure": {
        "ratio": {"type": "number", "required": True, "minimum": 0, "maximum": 20},
        "deep": {"type": "boolean"},
    },
}


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from plain conversations (conv_id, turn, role, text).

    Assistant turns are calls: the tool follows from the turn, the arguments are JSON made
    of the text, with blanks and unsorted keys, and the user turn after it is the result. A call
    builds on the call two turns before, in every fifth conversation on the one after.
    """
    size = F.length(F.coalesce("text", F.lit("")))
    quoted = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))).substr(F.lit(6), F.lit(1 << 30))
    quoted = F.regexp_replace(quoted, r"\}$", "")
    kind = F.col("turn") % 3
    arguments = (
        F.when(
            kind == 0,
            F.concat(F.lit('{ "query" : '), quoted, F.lit(', "limit":'), (size % 50).cast("string"), F.lit("}")),
        )
        .when(
            kind == 1,
            F.concat(
                F.lit('{"what":"'),
                F.when(size % 7 == 0, "pages").otherwise(F.when(size % 2 == 0, "words").otherwise("lines")),
                F.lit('" , "text": '),
                quoted,
                F.when(size % 11 == 0, "").otherwise("}"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit('{"ratio": '),
                F.concat((size % 30).cast("string"), F.lit(".50")),
                F.when(size % 5 == 0, ', "depth": 3').otherwise(', "deep" : true'),
                F.lit(" }"),
            )
        )
    )

    def call_id(turn: Column) -> Column:
        return F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))

    tools = F.array(*map(F.lit, SCHEMAS))
    step = F.when(F.col("conv_id") % 5 == 0, 2).otherwise(-2)
    after = F.when((F.col("turn") + step) > 0, F.array(call_id(F.col("turn") + step)))
    calls = turns.filter("role = 'assistant'").select(
        "conv_id",
        F.col("turn").alias("seq"),
        call_id(F.col("turn")).alias("call_id"),
        F.element_at(tools, (F.pmod("turn", F.lit(3)) + 1).cast("int")).alias("tool"),
        arguments.alias("arguments"),
        F.coalesce(after, F.array().cast("array<string>")).alias("after"),
    )
    results = turns.filter("role = 'user'").select(
        "conv_id",
        F.col("turn").alias("seq"),
        call_id(F.col("turn") - 1).alias("call_id"),
        F.col("text").alias("content"),
    )
    return calls, results
