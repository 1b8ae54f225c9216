"""Chat formatting: tool calls linked to their results, in topological order, checked and serialised.

Two tables go in: calls (conversation, identifier, name, arguments as JSON, place) and results (conversation,
identifier, content, place), and the edges between calls. Calls and results meet in a full join on the identifier.
Identifiers that occur once need nothing else; those that repeat are numbered by place - through a range partitioning
and its row counts, not in one window an identifier - and matched one to one.

The topological order: a call's level is the longest chain of calls that it builds on. Calls that build on a single
one are chains; they are settled by doubling pointers, in as many passes as the logarithm of the longest chain. Calls
that build on several have their edges moved down the chains, edges that a longer way replaces are dropped, and what
is settled is taken off, until no edge is left; passes grow with the layers of such calls only. What stands in a
circle, or builds on one, has a null level. All of it are joins of narrow rows by call, so that a conversation with a
third of all turns is spread like any other.

Arguments are parsed to a variant, whose types the schemas are checked against and which is written again as canonical
JSON: keys sorted, at every depth, no blanks, one form for each number and string. Arguments may be a JSON text that
holds the object as a string.

Defined results: a call without a result is ``pending``; a result without a call is ``orphan``; a result placed before
its call is ``early``; null conversations or identifiers match nothing and are kept; arguments that are no JSON, repeat
a key, or are longer than a variant may be (128 MB) are kept as a string with the problem "no JSON"; rows that are
alike are matched one to one in any order; columns other than the named ones are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import written
from sieveline.llm.sharding import numbered

_SAID = {"text": ("string", True), "turn": ("integer", True)}
#: name -> {argument: (type, required)}; the tools of the conversations table's own turns: what a person asks, what a
#: system turn sets, and turns of any other role.
SCHEMAS = {"respond": _SAID, "configure": _SAID, "note": _SAID}
#: Roles whose turns are results.
ANSWERS = ("assistant", "tool")

#: The types of JSON by what a variant calls them.
_TYPES = {
    "string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\([0-9]+,0\\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT",
}


def quoted(text: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def canonical(fields: dict[str, Column]) -> Column:
    """An object of ready JSON values, its keys sorted; a null value leaves its key out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def parsed(arguments: Column) -> Column:
    """The arguments as a variant; null if they are no JSON."""
    v = F.try_parse_json(arguments)
    inner = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    return F.when(F.schema_of_variant(v) == "STRING", F.coalesce(inner, v)).otherwise(v)


def problems(name: Column, value: Column, schemas: dict = SCHEMAS) -> Column:
    """What is wrong with a call's parsed arguments: an array of words, empty if they are valid."""
    found = []
    for tool, fields in schemas.items():
        for field, (kind, required) in fields.items():
            got = F.schema_of_variant(F.try_variant_get(value, f'$["{field}"]', "variant"))
            bad = F.when(got.isNotNull() & ~got.rlike(_TYPES[kind]), f"{field} is no {kind}")
            if required:
                bad = F.when(got.isNull(), f"missing {field}").otherwise(bad)
            found.append(F.when(name == tool, bad))
    known = F.coalesce(name.isin(*schemas), F.lit(False))
    keys = F.json_object_keys(F.to_json(value))
    allowed = F.lit(None).cast("array<string>")
    for tool, fields in schemas.items():
        allowed = F.when(name == tool, F.array(*[F.lit(f) for f in fields]).cast("array<string>")).otherwise(allowed)
    more = F.transform(F.array_sort(F.array_except(keys, allowed)), lambda k: F.concat(F.lit("unexpected "), k))
    whole = F.when(value.isNull(), "no JSON").when(~F.schema_of_variant(value).startswith("OBJECT"), "no object")
    return F.concat(F.filter(F.array(whole, F.when(~known, "unknown tool"), *found), lambda x: x.isNotNull()), F.coalesce(more, F.array().cast("array<string>")))


_ID = ["conv_id", "call_id"]


def _numbered(rows: DataFrame, tie: str) -> DataFrame:
    """``k``: the number of each row, from 1, among those with its conversation and identifier, by place."""
    n, _ = numbered(rows.withColumn("_tie", F.xxhash64(tie)), [*_ID, "place", "_tie"])
    first = n.groupBy(*_ID).agg(F.min("row_number").alias("_first"))
    return n.join(first, _ID).withColumn("k", F.col("row_number") - F.col("_first") + 1).drop("_tie", "row_number", "_first")


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each call, with its result if there is one, and for each result without a call.

    calls: conv_id, call_id, place and any other columns; results: conv_id, call_id, content, place.
    """
    c = calls.withColumnRenamed("place", "call_place")
    r = results.select("conv_id", "call_id", "content", F.col("place").alias("result_place"))
    named = "conv_id is not null and call_id is not null"
    rest = c.where(f"not ({named})").withColumns({"content": F.lit(None).cast("string"), "result_place": F.lit(None).cast(dict(r.dtypes)["result_place"])})
    lone = r.where(f"not ({named})").select("conv_id", "call_id", *[(F.col(x) if x in r.columns else F.lit(None).cast(t)).alias(x) for x, t in rest.dtypes if x not in _ID])
    c, r = c.where(named), r.where(named)
    twice = lambda df: df.groupBy(*_ID).agg(F.count("*").alias("_n")).where("_n > 1").select(*_ID)
    again = written(twice(c).unionByName(twice(r)).distinct())
    if not again.isEmpty():
        cols = [*c.columns, "content", "result_place"]
        place = lambda df, x: df.withColumnRenamed(x, "place")
        nc = _numbered(place(c.join(again, _ID, "left_semi"), "call_place"), "name").withColumnRenamed("place", "call_place")
        nr = _numbered(place(r.join(again, _ID, "left_semi"), "result_place"), "content").withColumnRenamed("place", "result_place")
        rest = rest.unionByName(nc.join(nr, [*_ID, "k"], "full").select(*cols))
        c, r = c.join(again, _ID, "left_anti"), r.join(again, _ID, "left_anti")
    return c.join(r, _ID, "full").unionByName(rest).unionByName(lone)


def _doubled(p: DataFrame) -> DataFrame:
    """Each pointer moved on to where its target points; ``moved`` if that one points anywhere."""
    to = p.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), F.col("w").alias("_w"), F.col("c").alias("_c"))
    both = p.join(to, "ptr", "left")
    return both.select("node", F.coalesce("_p", "ptr").alias("ptr"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"),
                       F.greatest("c", F.col("w") + F.col("_c")).alias("c"), F.col("_p").isNotNull().alias("moved"))


def _ends(one: DataFrame, n: int) -> DataFrame:
    """Of pointers (node, ptr, w, c), a row for each of ``n`` nodes: where their chains end; without circles and what leads there.

    The level of a node is the greater of c and w plus its target's level.
    """
    p, length = written(one), 1
    while length <= n:
        p = written(_doubled(_doubled(p).drop("moved")))
        length *= 4
        if p.where("moved").isEmpty():
            return p.drop("moved")
    return p.drop("moved").join(one.select(F.col("node").alias("ptr")), "ptr", "left_anti")


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id, level. edges: conv_id, call_id, needs; identifiers that no call has count as settled."""
    ids = written(calls.select(*_ID).where("conv_id is not null and call_id is not null").distinct().withColumn("node", F.monotonically_increasing_id()))
    to = ids.select("conv_id", F.col("call_id").alias("needs"), F.col("node").alias("ptr"))
    e = edges.select("conv_id", "call_id", "needs").join(ids, _ID).join(to, ["conv_id", "needs"])
    e = written(e.select("node", "ptr").distinct().withColumn("w", F.lit(1)))
    settled = ids.join(e, "node", "left_anti").select("node", F.lit(0).alias("level"))
    consts = e.select("node").distinct().withColumn("c", F.lit(0))
    chains, size = [], None
    while True:
        deg = e.groupBy("node").agg(F.count("*").alias("n"), F.min("ptr").alias("ptr"), F.min("w").alias("w"))
        now = deg.agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") > 1).alias("many"), F.coalesce(F.sum("n"), F.lit(0)).alias("e")).first()
        if now["one"]:
            chains.append(_ends(deg.where("n = 1").join(consts, "node").select("node", "ptr", "w", "c"), now["one"]))
        if not now["many"] or tuple(now) == size:
            break  # without a change, what is left builds on circles
        size = tuple(now)
        m = e.join(deg.where("n > 1").select("node"), "node", "left_semi").join(consts, "node")
        if now["one"]:
            end = chains[-1].select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), F.col("w").alias("_w"), F.col("c").alias("_c"))
            m = m.join(end, "ptr", "left").select("node", F.coalesce("_p", "ptr").alias("ptr"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), F.greatest("c", F.col("w") + F.col("_c")).alias("c"))
        m = m.join(settled.withColumnRenamed("node", "ptr"), "ptr", "left").groupBy("node", F.when(F.col("level").isNull(), F.col("ptr")).alias("ptr"))
        m = written(m.agg(F.max("w").alias("w"), F.max(F.greatest("c", F.col("w") + F.col("level"))).alias("c")))
        consts = m.groupBy("node").agg(F.max("c").alias("c"))
        e = m.where("ptr is not null").select("node", "ptr", "w")
        settled = written(settled.unionByName(consts.join(e, "node", "left_anti").select("node", F.col("c").alias("level"))))
        # An edge is no longer needed where a way over another call is at least as long.
        two = e.select("node", F.col("ptr").alias("via"), F.col("w").alias("_w")).join(e.select(F.col("node").alias("via"), "ptr", F.col("w").alias("_v")), "via")
        two = two.groupBy("node", "ptr").agg(F.max(F.col("_w") + F.col("_v")).alias("far"))
        e = written(e.join(two, ["node", "ptr"], "left").where("far is null or far < w").select("node", "ptr", "w"))
        consts = written(consts)
    for p in reversed(chains):
        more = p.join(settled.withColumnRenamed("node", "ptr"), "ptr").select("node", F.greatest("c", F.col("w") + F.col("level")).alias("level"))
        settled = settled.unionByName(more)
    return ids.join(settled, "node", "left").select("conv_id", "call_id", "level")


def _place(turn: Column, at: Column) -> Column:
    return F.struct(turn.cast("long").alias("turn"), at.cast("int").alias("at"))


def embedded(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and edges of turns (conv_id, turn, role, text).

    Calls stand in ``<tool_call>{"id", "name", "arguments", "needs"}</tool_call>`` and results in
    ``<tool_response>{"id", "content"}</tool_response>``.
    """
    def tags(tag: str) -> DataFrame:
        found = F.regexp_extract_all("text", F.lit(f"(?s)<{tag}>\\s*(\\{{.*?\\}})\\s*</{tag}>"), F.lit(1))
        rows = turns.where(F.col("text").contains(f"<{tag}>")).select("conv_id", "turn", F.posexplode(found).alias("at", "j"))
        return rows.select("conv_id", _place(F.col("turn"), F.col("at")).alias("place"), "j", F.try_parse_json("j").alias("v"))

    said = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    calls = tags("tool_call").select("conv_id", said("id").alias("call_id"), said("name").alias("name"), F.to_json(F.try_variant_get("v", "$.arguments", "variant")).alias("arguments"), "place", F.try_variant_get("v", "$.needs", "array<string>").alias("needs"))
    results = tags("tool_response").select("conv_id", said("id").alias("call_id"), F.coalesce(said("content"), F.to_json(F.try_variant_get("v", "$.content", "variant"))).alias("content"), "place")
    return calls.drop("needs"), results, calls.select("conv_id", "call_id", F.explode("needs").alias("needs"))


def dialogue(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The turns themselves: those of a person or of the system, or of any role but ``ANSWERS``, are calls, identified by
    their number; an answer is the result of the turn before it. A call builds on the call in the turn before it, or else in
    the one before that, which the answer between them belongs to."""
    ident = lambda n: F.concat(F.lit("turn:"), n.cast("string"))
    answer = F.coalesce(F.col("role").isin(*ANSWERS), F.lit(False))
    tool = F.when(F.col("role") == "user", "respond").when(F.col("role") == "system", "configure").when(F.col("role").isNotNull(), "note")
    args = canonical({"text": quoted(F.col("text")), "turn": F.col("turn").cast("string")})
    place = _place(F.col("turn"), F.lit(-1)).alias("place")
    calls = turns.where(~answer).select("conv_id", ident(F.col("turn")).alias("call_id"), tool.alias("name"), args.alias("arguments"), place)
    results = turns.where(answer).select("conv_id", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"), place)
    asked = turns.where(~answer).select("conv_id", "turn").distinct()
    before = asked.select("conv_id", F.explode(F.array(F.col("turn") + 1, F.col("turn") + 2)).alias("turn"), F.col("turn").alias("from"))
    last = asked.join(before, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.max("from").alias("from"))
    return calls, results, last.select("conv_id", ident(F.col("turn")).alias("call_id"), ident(F.col("from")).alias("needs"))


def formatted(calls: DataFrame, results: DataFrame, edges: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, call_id, state, level, call_place, result_place, problems and json of every call and every orphan result.

    calls: conv_id, call_id, name, arguments, place.
    """
    # The level goes to the calls first: both joins then share one partitioning by call.
    c = calls.select("conv_id", "call_id", "name", "arguments", "place").join(levels(calls, edges), _ID, "left")
    rows = linked(c, results).withColumn("_v", parsed(F.col("arguments")))
    call, result = F.col("call_place").isNotNull(), F.col("result_place").isNotNull()
    state = F.when(~call, "orphan").when(~result, "pending").when(F.col("result_place") < F.col("call_place"), "early").otherwise("linked")
    rows = rows.withColumn("state", state).withColumn("problems", F.when(call, problems(F.col("name"), F.col("_v"), schemas)).otherwise(F.array().cast("array<string>")))
    json = canonical({
        "arguments": F.when(call, F.coalesce(F.to_json("_v"), quoted(F.col("arguments")))),
        "content": F.when(result, quoted(F.col("content"))),
        "id": quoted(F.col("call_id")), "name": F.when(F.col("name").isNotNull(), quoted(F.col("name"))),
        "state": quoted(F.col("state")),
    })
    return rows.select("conv_id", "call_id", "state", "level", "call_place", "result_place", "problems", json.alias("json"))
