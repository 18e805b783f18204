"""Tool-call linking: join calls and results, order calls by dependency, validate arguments, write canonical JSON.

DataFrame functions throughout. Calls and results meet in a hash join on conversation and identifier; the depth of a call in
its chain of dependencies comes from pointer doubling (each turn a call takes over its predecessor's predecessor, so a chain of
n calls takes log2(n) joins, each on unique keys). Where calls wait for several others, chains are shortened in this way up to
the calls that do, and only these are settled in turns, each when all that it waits for is. Schemas are literals in the plan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .neardup import Scratch

#: Argument kinds and how the type of a parsed JSON value is called.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
#: Per tool and field: kind, whether it is required, and perhaps rules: ``enum`` (JSON scalars), ``minimum``, ``maximum``, ``items`` (the kind of
#: each element), ``fields`` (a nested object's own fields).
Schemas = dict[str, dict[str, tuple]]
#: Turns whose settled calls are unioned before they are written together.
TURNS_A_TABLE = 64


def json_text(value: Column) -> Column:
    """A value as a JSON text; ``null`` for null."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), "null").otherwise(F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def _kind(kind: str) -> str:
    return f"^({KINDS[kind]})$"


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.rlike(F.schema_of_variant(value), F.lit(_kind(kind))), F.lit(False))


def ruled(parsed: Column, fields: dict[str, tuple], path: str = "$", label: str = "") -> list[Column]:
    """Arrays of what the rules of ``fields`` find wrong under ``path``; null where nothing is there to test."""
    out, texts = [], []
    for field, (_, _, *rules) in sorted(fields.items()):
        rule, at, said = (rules or [{}])[0], f"{path}['{field}']", label + field
        value = F.try_variant_get(parsed, at, "variant")
        if "enum" in rule:
            texts.append(F.when(~F.to_json(value).isin([json.dumps(x, ensure_ascii=False) for x in rule["enum"]]), F.lit(f"enum:{said}")))
        number = F.when(_is(value, "number"), F.try_variant_get(parsed, at, "double"))
        for bound, beyond in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x)):
            if bound in rule:
                texts.append(F.when(beyond(float(rule[bound])), F.lit(f"{bound}:{said}")))
        if "items" in rule:
            wrong = F.exists(F.try_variant_get(parsed, at, "array<variant>"), lambda v: ~_is(v, rule["items"]))  # noqa: B023 (called at once)
            texts.append(F.when(wrong, F.lit(f"items:{said}")))
        if "fields" in rule:
            names = F.map_keys(F.try_variant_get(parsed, at, "map<string,variant>"))
            for inner, (kind, need, *_) in sorted(rule["fields"].items()):
                has = F.array_contains(names, inner)
                if need:
                    texts.append(F.when(~has, F.lit(f"missing:{said}.{inner}")))
                texts.append(F.when(has & ~_is(F.try_variant_get(parsed, f"{at}['{inner}']", "variant"), kind), F.lit(f"kind:{said}.{inner}")))
            unknown = F.filter(names, lambda k: ~k.isin(list(rule["fields"])))  # noqa: B023
            out.append(F.transform(unknown, lambda k: F.concat(F.lit(f"extra:{said}."), k)))  # noqa: B023
            out += ruled(parsed, rule["fields"], at, f"{said}.")
    return [*([F.array_compact(F.array(*texts))] if texts else []), *out]


def problems_of(name: Column, parsed: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted list of what is wrong with a call: ``arguments`` (not a JSON object), ``tool`` (unknown), ``missing:x``, ``kind:x``, ``extra:x``,
    and by rules ``enum:x``, ``minimum:x``, ``maximum:x``, ``items:x``; fields of a nested object are named ``x.y``. Rules hold for values
    that are there: an absent field only lacks if it is required, and an object of another kind has no fields to test."""
    def fields(of: dict[str, tuple]) -> Column:
        rows = [F.struct(F.lit(f).alias("field"), F.lit(_kind(k)).alias("kind"), F.lit(need).alias("required")) for f, (k, need, *_) in sorted(of.items())]
        return F.array(*rows).cast("array<struct<field:string,kind:string,required:boolean>>")

    table = F.create_map(*[x for tool, of in sorted(schemas.items()) for x in (F.lit(tool), fields(of))])
    own = F.try_element_at(table, name)
    found = F.coalesce(F.map_keys(arguments), F.array().cast("array<string>"))
    missing = F.transform(F.filter(own, lambda f: f["required"] & ~F.array_contains(found, f["field"])), lambda f: F.concat(F.lit("missing:"), f["field"]))
    wrong = F.transform(
        F.filter(own, lambda f: F.array_contains(found, f["field"]) & ~F.rlike(F.schema_of_variant(F.element_at(arguments, f["field"])), f["kind"])),
        lambda f: F.concat(F.lit("kind:"), f["field"]),
    )
    extra = F.transform(F.filter(found, lambda k: ~F.exists(own, lambda f: f["field"] == k)), lambda k: F.concat(F.lit("extra:"), k))
    none = F.array().cast("array<string>")
    more = [F.coalesce(F.when(name == tool, part), none) for tool, of in sorted(schemas.items()) for part in ruled(parsed, of)]
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.array(F.lit("arguments"))).when(own.isNull(), F.array(F.lit("tool"))).otherwise(F.array_sort(F.concat(missing, wrong, extra, *more)))


def _chains(start: DataFrame, scratch: Scratch) -> DataFrame:
    """Follow ``up`` to the end of each chain: ``anchor`` is the call that it ends on, ``level`` the steps to it; in a cycle ``up`` stays."""
    state = scratch.keep(start.select("conv_id", "call_id", "up", F.when(F.col("up").isNull(), F.col("call_id")).alias("anchor"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("level")))
    total, reach = state.count(), 1
    while reach <= total and not state.where("up is not null").isEmpty():
        step = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("up").alias("next"), F.col("anchor").alias("end"), F.col("level").alias("more"))
        joined = state.join(step, (state["conv_id"] == step["c"]) & (state["up"] == step["k"]), "left")
        state = scratch.keep(joined.select("conv_id", "call_id", F.col("next").alias("up"), F.coalesce("anchor", "end").alias("anchor"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        reach *= 2
    return state


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id``, ``call_id`` and ``level``: 0 for a call that waits for none, else one more than the last of those that it waits for; null in
    a cycle or behind one. ``calls``: unique (``conv_id``, ``call_id``), ``after`` (an id in the same conversation, an array of such ids, or
    null; unknown ids and nulls in arrays count as none)."""
    key = ["conv_id", "call_id"]
    known = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"))
    if not isinstance(calls.schema["after"].dataType, ArrayType):
        start = calls.join(known, (calls["conv_id"] == known["c"]) & (calls["after"] == known["k"]), "left")
        state = _chains(start.select(*key, F.col("k").alias("up")), scratch)
        return state.select(*key, F.when(F.col("up").isNull(), F.col("level")).alias("level"))
    each = calls.select(*key, F.explode(F.array_distinct("after")).alias("a"))
    edges = scratch.keep(each.join(known, (each["conv_id"] == known["c"]) & (each["a"] == known["k"])).select(*key, F.col("k").alias("before")))
    first = scratch.keep(edges.groupBy(*key).agg(F.count("*").alias("n_before"), F.min("before").alias("first")))
    state = _chains(calls.join(first, key, "left").select(*key, F.when(F.col("n_before") == 1, F.col("first")).alias("up")), scratch)
    ends = state.where("up is null").select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), "anchor", F.col("level").alias("steps"))
    joints = edges.join(first.where("n_before > 1").select(*key), key)
    waits = joints.join(ends, (joints["conv_id"] == ends["c"]) & (joints["before"] == ends["k"]), "left").groupBy(*key, "anchor").agg(F.max("steps").alias("steps"))
    left = waits.withColumn("base", F.lit(None).cast("long"))
    fresh = calls.join(first, key, "left_anti").select(*key, F.lit(0).cast("long").alias("level"))
    parts = [fresh]
    while True:  # a turn settles the calls of one depth in the graph of calls that wait for several
        now = fresh.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("level").alias("own"))
        left = scratch.keep(left.join(now, (left["conv_id"] == now["c"]) & (left["anchor"] == now["k"]), "left").select(*key, "anchor", "steps", F.coalesce("base", "own").alias("base")))
        settled = left.groupBy(*key).agg(F.count("*").alias("n"), F.count("base").alias("m"), (F.max(F.col("base") + F.col("steps")) + 1).alias("level"))
        fresh = scratch.keep(settled.where("n = m").select(*key, "level"))
        if fresh.isEmpty():
            break
        parts.append(fresh)
        if len(parts) == TURNS_A_TABLE:
            parts = [scratch.keep(_union(parts))]
        left = left.join(fresh, key, "left_anti")
    base = _union(parts).select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("level").alias("base"))
    return state.join(base, (state["conv_id"] == base["c"]) & (state["anchor"] == base["k"]), "left").select(*key, (F.col("base") + F.col("level")).alias("level"))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole, *rest = parts
    for part in rest:
        whole = whole.union(part)
    return whole


def _repeated(rows: DataFrame, firsts: DataFrame, own: list[str]) -> DataFrame:
    """The rows of the keys of ``firsts`` but for one that equals its key's first ``x``."""
    alike = rows.groupBy("conv_id", "call_id", *own).agg(F.count("*").alias("copies")).join(firsts, ["conv_id", "call_id"])
    left = F.col("copies") - F.struct(*own).eqNullSafe(F.col("x")).cast("long")
    return alike.where(left > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), left))).select("conv_id", "call_id", *own)


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and one per result that no call takes.

    ``calls``: ``conv_id``, ``turn``, ``call_id``, ``name``, ``arguments`` (JSON text), ``after`` (the call it waits for, an array
    of such calls, or null). ``results``: ``conv_id``, ``turn``, ``call_id``, ``content``. Other columns are not read.
    Returns ``conv_id``, ``level`` (place in a topological order: sort by level, turn, call_id), ``turn``, ``call_id``, ``kind``
    (``call``, ``orphan``, ``repeated_call`` or ``repeated_result``), ``linked``, ``problems`` (joined by commas; ``cycle`` and ``duplicate`` beside those of ``problems_of``) and
    ``json``, canonical: keys sorted, no blanks, nested values too. Of calls, or results, that share an id the first by turn (then by
    content) is linked and ordered; each other one is a row of its own, marked as repeated, without level and link. Rows with a null ``conv_id``
    or ``call_id`` are calls and orphans without level and link, one each.
    Null arguments are a problem, a null content is JSON null. Empty tables give no rows.
    """
    scratch = Scratch(calls.sparkSession)
    key = ["conv_id", "call_id"]
    own_call, own_result = ["turn", "name", "arguments", "after"], ["turn", "content"]
    named = "conv_id is not null and call_id is not null"
    calls, results = calls.select(*key, *own_call), results.select(*key, *own_result)
    once = calls.where(named).groupBy(*key).agg(F.min(F.struct(*own_call)).alias("x"), F.count("*").alias("n")).select(*key, "x.*", "n")
    answered = results.where(named).groupBy(*key).agg(F.min(F.struct(*own_result)).alias("r"), F.count("*").alias("n_results"))
    once = scratch.keep(once)
    answered = scratch.keep(answered)
    depth = levels(once, scratch)
    placed = once.join(depth, key, "left")
    placed = placed.withColumn("is_call", F.lit(True))
    both = placed.join(answered.drop("n_results").hint("shuffle_hash"), key, "full").withColumn("kind", F.when(F.col("is_call"), "call").otherwise("orphan"))
    others = [
        calls.where(f"not ({named})").withColumn("kind", F.lit("call")),
        _repeated(calls.where(named), once.where("n > 1").select(*key, F.struct(*own_call).alias("x")), own_call).withColumns({"kind": F.lit("repeated_call"), "n": F.lit(2).cast("long")}),
        results.where(f"not ({named})").select(*key, F.struct(F.col("turn"), F.col("content")).alias("r"), F.lit("orphan").alias("kind")),
        _repeated(results.where(named), answered.where("n_results > 1").select(*key, F.col("r").alias("x")), own_result).select(*key, F.struct(F.col("turn"), F.col("content")).alias("r"), F.lit("repeated_result").alias("kind")),
    ]
    for part in others:
        both = both.unionByName(part, allowMissingColumns=True)
    both = both.withColumn("is_call", F.col("kind").isin("call", "repeated_call"))
    parsed = F.try_parse_json("arguments")
    given = F.from_json("arguments", "map<string,variant>")
    row = both.withColumn("parsed", parsed).withColumn("given", F.when(F.schema_of_variant("parsed").startswith("OBJECT"), given))
    wrong = F.concat(
        F.when(F.col("level").isNull() & (F.col("kind") == "call") & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("n") > 1, F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>")),
        problems_of(F.col("name"), F.col("parsed"), F.col("given"), schemas),
    )
    linked = F.col("is_call") & F.col("r").isNotNull()
    arguments = F.coalesce(F.to_json("parsed"), json_text(F.col("arguments")))
    result = F.when(linked, F.concat(F.lit('{"content":'), json_text(F.col("r.content")), F.lit("}"))).otherwise("null")
    call_json = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"call_id":'), json_text(F.col("call_id")), F.lit(',"name":'), json_text(F.col("name")), F.lit(',"result":'), result, F.lit("}"))
    orphan_json = F.concat(F.lit('{"call_id":'), json_text(F.col("call_id")), F.lit(',"content":'), json_text(F.col("r.content")), F.lit("}"))
    return row.select(
        "conv_id",
        "level",
        F.coalesce("turn", "r.turn").alias("turn"),
        "call_id",
        "kind",
        linked.alias("linked"),
        F.when(F.col("is_call"), F.array_join(wrong, ",")).otherwise("").alias("problems"),
        F.when(F.col("is_call"), call_json).otherwise(orphan_json).alias("json"),
    )
