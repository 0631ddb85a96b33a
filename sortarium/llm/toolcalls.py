"""Tool calls of conversations, linked to their results, ordered, validated and serialised, on built-in functions alone.

An assistant's message may be {"tool_calls": [{"id", "name", "arguments"}, ...]}, a tool's message
{"tool_call_id", "content"}. Calls and results meet in a hash join on (conversation, id). A call
whose arguments hold the string "$id" as a value, at any depth, uses the result of the conversation's call
of that id, so it comes after it: its level is one more than the highest level among those; (level,
turn, place) is a topological order. Strings that name no call of their conversation, parts of strings and keys are no references. Arguments
are held against the tool's schema, and the call is written as canonical JSON: keys sorted, no blanks, integers as they
are, other numbers as the nearest double.

A schema is a table (tool, parameter, type, required[, enum]). Parameters are paths: "a.b" is the field b
of the object a, "a[]" an item of the array a (dots, brackets and backslashes of a name are written after
a backslash); a null parameter names a tool without any. Types are those of JSON schemas (string, integer,
number, boolean, object, array, null; 3.0 is an integer) or names that schema_of_variant gives; a null type
is any. enum has the JSON of the values allowed. Objects whose fields are not described may hold anything,
as may undescribed items; other fields that the schema doesn't name are errors. What a required field's
object doesn't hold is missing only where that object is there.

Messages that aren't such JSON, null texts and null ids hold no calls. Of several results for one id
the earliest counts; calls that share an id in a conversation are all reported as such. Calls that
wait for each other have no level. Arguments that repeat a key count as no object; with an integer of more than 38 digits,
which could not be kept exactly, they are refused ("number too long"); neither has a canonical form. Repeated rows are repeated calls.
Long texts, arguments and ids count whole. Empty tables give no rows; extra columns are not read. No
conversation is gathered in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortarium.llm.common import cut, small_side

#: The registered query's tools: tool, parameter, type, required.
TOOLS = (
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("search", "after", "string", False),
    ("translate", "text", "string", True),
    ("translate", "target", "string", True),
    ("count", "words", "array", True),
    ("count", "words[]", "string", False),
    ("count", "exact", "boolean", False),
    ("count", "after", "string", False),
)
TOOLS_SCHEMA = "tool string, parameter string, type string, required boolean"


def calls(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, place, call_id, tool, arguments) of every call in messages (conv_id, turn, role, text)."""
    kind = "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>>"
    said = messages.where("role = 'assistant' AND text LIKE '%\"tool_calls\"%'").select("conv_id", "turn", F.from_json("text", kind).alias("m"))
    each = said.select("conv_id", "turn", F.posexplode("m.tool_calls").alias("place", "call"))
    return each.where("call.id IS NOT NULL AND conv_id IS NOT NULL").select("conv_id", "turn", "place", F.col("call.id").alias("call_id"), F.col("call.name").alias("tool"), F.col("call.arguments").alias("arguments"))


def results(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, result_turn, content) of the earliest result for each id."""
    kind = "struct<tool_call_id: string, content: string>"
    said = messages.where("role = 'tool' AND text LIKE '%\"tool_call_id\"%'").select("conv_id", "turn", F.from_json("text", kind).alias("m"))
    said = said.where("m.tool_call_id IS NOT NULL AND conv_id IS NOT NULL")
    return said.groupBy("conv_id", F.col("m.tool_call_id").alias("call_id")).agg(F.min(F.struct("turn", "m.content")).alias("r")).select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))


#: Control characters, which JSON can't hold as they are, for an escaped backslash and an escaped quote.
_BACKSLASH, _QUOTE = "\x01", "\x02"


def _bare(arguments: Column) -> Column:
    """JSON in which no string holds a quote."""
    return F.replace(F.replace(arguments, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def references(arguments: str) -> Column:
    """The strings "$id" among the values of arguments, without the dollar, distinct."""
    strings = F.regexp_extract_all(_bare(F.col(arguments)), F.lit(r'"[^"]*"\s*:?'), F.lit(0))
    values = F.filter(strings, lambda x: x.startswith('"$') & ~x.endswith(":"))
    whole = lambda x: F.replace(F.replace(F.rtrim(x), F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    read = F.transform(values, lambda x: F.get(F.from_json(F.concat(F.lit("["), whole(x), F.lit("]")), "array<string>"), F.lit(0)))
    return F.array_distinct(F.filter(F.transform(read, lambda x: F.substring(x, F.lit(2), F.length(x))), lambda x: x != ""))


def too_long(arguments: str) -> Column:
    """Whether arguments hold a number of more than 38 digits."""
    return F.coalesce(F.regexp_replace(_bare(F.col(arguments)), r'"[^"]*"', "").rlike(r"[0-9]([.]?[0-9]){38}"), F.lit(False))


def levels(found: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every id whose references can all be met; those to no call of the conversation are none.

    Chains of calls with one reference each are jumped over by doubling steps, up to the nearest call with none or
    several (the anchor); rounds only go through those with several.
    """
    named = found.groupBy("conv_id", "call_id").agg(F.array_distinct(F.flatten(F.collect_set("uses"))).alias("uses"))
    wanted = named.select("conv_id", "call_id", F.explode("uses").alias("used")).join(named.select("conv_id", F.col("call_id").alias("used")), ["conv_id", "used"], "left_semi")
    uses = wanted.groupBy("conv_id", "call_id").agg(F.collect_list("used").alias("uses"))
    ids = cut(named.select("conv_id", "call_id").join(uses, ["conv_id", "call_id"], "left").withColumn("uses", F.coalesce("uses", F.array().cast("array<string>"))))
    plain = cut(ids.where(F.size("uses") != 1).select("conv_id", "call_id", F.size("uses").alias("needs")))
    jumps = cut(ids.where(F.size("uses") == 1).select("conv_id", "call_id", F.col("uses")[0].alias("anchor"), F.lit(1).alias("steps")))
    left, reach = jumps.count(), 1
    while reach <= left:
        # A chain of single references is no longer than there are; what still points to one then is a circle.
        over = jumps.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("further"), F.col("steps").alias("more"))
        jumped = jumps.join(over, ["conv_id", "anchor"], "left").select("conv_id", "call_id", F.coalesce("further", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved"))
        jumped = cut(jumped)
        jumps, reach = jumped.drop("moved"), 2 * reach
        if jumped.where("moved").isEmpty():
            break
    jumps = jumps.join(plain.select("conv_id", F.col("call_id").alias("anchor")), ["conv_id", "anchor"], "left_semi")
    known = plain.select("conv_id", "call_id", F.col("call_id").alias("anchor"), F.lit(0).alias("steps")).unionByName(jumps.select("conv_id", "call_id", "anchor", "steps"))
    waits = ids.where(F.size("uses") > 1).select("conv_id", "call_id", F.explode("uses").alias("used"), F.size("uses").alias("needs"))
    waits = cut(waits.join(known.withColumnRenamed("call_id", "used"), ["conv_id", "used"]))
    done = cut(plain.where("needs = 0").select("conv_id", F.col("call_id").alias("anchor"), F.lit(0).alias("level")))
    while True:
        met = waits.join(done, ["conv_id", "anchor"])
        ready = met.groupBy("conv_id", "call_id", "needs").agg(F.count("*").alias("have"), (F.max(F.col("level") + F.col("steps")) + 1).alias("level")).where("have = needs")
        new = cut(ready.select("conv_id", F.col("call_id").alias("anchor"), "level").join(done, ["conv_id", "anchor"], "left_anti"))
        if new.isEmpty():
            break
        done = cut(done.unionByName(new))
    return known.join(done, ["conv_id", "anchor"]).select("conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level"))


def _fits(value: str, kind: str) -> str:
    """Whether a variant is of a type, by the names of JSON schemas or of schema_of_variant."""
    got = f"schema_of_variant({value})"
    number = f"({got} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {got} LIKE 'DECIMAL%')"
    return f"""CASE {kind} WHEN 'string' THEN {got} = 'STRING' WHEN 'boolean' THEN {got} = 'BOOLEAN' WHEN 'null' THEN {got} = 'VOID'
      WHEN 'object' THEN {got} LIKE 'OBJECT%' WHEN 'array' THEN {got} LIKE 'ARRAY%' WHEN 'number' THEN {number}
      WHEN 'integer' THEN {number} AND to_json({value}) RLIKE '^-?[0-9]+([.]0+)?$' ELSE {got} = {kind} END"""


def validation(found: DataFrame, tools: DataFrame) -> DataFrame:
    """found and errors: what is wrong with each call's arguments, sorted and joined by '; ' ('' if nothing is); v, the arguments.

    Calls are checked within their rows at the top; what lies deeper is exploded level by level and meets the schema in
    a join on (tool, path). There are as many levels as the schema is deep.
    """
    enum = F.col("enum") if "enum" in tools.columns else F.lit(None).cast("array<string>")
    spec = tools.select("tool", F.col("parameter").alias("path"), "type", F.coalesce("required", F.lit(False)).alias("required"), enum.alias("enum"))
    # The object or array that a path lies in: the path without its last step.
    spec = cut(spec.withColumn("inside", F.regexp_replace("path", r"(^|\.)(\\.|[^.\[\]\\])*$|\[\]$", "")))
    deepest = spec.agg(F.max(F.size(F.expr(r"regexp_extract_all(path, '(\\\\.|[^.\\[\\]\\\\])+|\\[\\]', 0)")))).first()[0] or 0
    deepest = max(deepest, 1)
    below = spec.where("path IS NOT NULL").groupBy("tool", F.col("inside").alias("path")).agg(F.array_sort(F.collect_set(F.when(F.col("required"), F.col("path")))).alias("needed"))
    rules = spec.where("path IS NOT NULL").select("tool", "path", "type", "enum")
    rules = rules.unionByName(spec.select("tool", F.lit("").alias("path"), F.lit("object").alias("type"), F.lit(None).cast("array<string>").alias("enum")).distinct())
    rules = rules.join(below, ["tool", "path"], "left")
    rules = small_side(cut(rules.withColumn("needed", F.when(F.col("path") == "", F.coalesce("needed", F.array().cast("array<string>"))).otherwise(F.col("needed")))), 100_000)
    df = found.withColumn("v", F.try_parse_json("arguments")).withColumn("row", F.monotonically_increasing_id())
    df = cut(df)
    known = df.join(small_side(spec.select("tool").distinct(), 100_000).withColumn("known", F.lit(True)), "tool", "left")
    is_object = F.coalesce(F.expr("schema_of_variant(v)"), F.lit("")).startswith("OBJECT")
    state = F.when(F.col("known").isNull(), "no such tool").when(F.col("v").isNull() | ~is_object, "no object").when(too_long("arguments"), "number too long")
    known = known.withColumn("state", state).drop("known")
    nodes = known.where("state IS NULL").select("row", "tool", F.lit("").alias("path"), F.col("v").alias("value"))
    wrong = []
    for depth in range(deepest + 1):
        # The fields of what has a schema, of those that the schema describes one by one.
        held = nodes.join(rules, ["tool", "path"], "left").withColumn("fits", F.expr(f"type IS NULL OR coalesce({_fits('value', 'type')}, false)"))
        inner = F.when(F.expr("schema_of_variant(value) LIKE 'OBJECT%'"), F.expr(r"transform(json_object_keys(to_json(value)), k -> concat(IF(path = '', '', concat(path, '.')), regexp_replace(k, '([.\\[\\]\\\\])', '\\\\$1')))"))
        held = held.withColumn("inner", F.coalesce(inner, F.array().cast("array<string>")))
        problems = F.concat(
            F.when(~F.col("fits"), F.array(F.concat(F.lit("type "), "path"))).otherwise(F.array().cast("array<string>")),
            F.when(F.expr("fits AND enum IS NOT NULL AND NOT array_contains(enum, to_json(value))"), F.array(F.concat(F.lit("enum "), "path"))).otherwise(F.array().cast("array<string>")),
            F.when(F.expr("schema_of_variant(value) LIKE 'OBJECT%' AND needed IS NOT NULL"), F.expr("transform(array_except(needed, inner), p -> concat('missing ', p))")).otherwise(F.array().cast("array<string>")),
        )
        wrong.append(held.select("row", F.explode(problems).alias("error")))
        if depth == deepest:
            break
        parts = held.where("needed IS NOT NULL AND (schema_of_variant(value) LIKE 'OBJECT%' OR schema_of_variant(value) LIKE 'ARRAY%')")
        spread = parts.withColumnRenamed("value", "parent").lateralJoin(found.sparkSession.tvf.variant_explode(F.col("parent").outer()).toDF("pos", "key", "child"))
        step = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), F.regexp_replace("key", r"([.\[\]\\])", r"\\$1")))
        spread = spread.select("row", "tool", step.alias("step"), F.col("child").alias("value"), F.col("key").isNotNull().alias("field"))
        named = spread.join(rules.select("tool", F.col("path").alias("step"), F.lit(True).alias("described")), ["tool", "step"], "left")
        wrong.append(named.where("described IS NULL AND field").select("row", F.concat(F.lit("unknown "), "step").alias("error")))
        nodes = named.where("described").select("row", "tool", F.col("step").alias("path"), "value")
    errors = reduce(DataFrame.unionByName, wrong).groupBy("row").agg(F.array_sort(F.collect_set("error")).alias("errors"))
    out = known.join(errors, "row", "left")
    return out.withColumn("errors", F.coalesce("state", F.array_join("errors", "; "), F.lit(""))).drop("row", "state")


def linked(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row a call: conv_id, turn, place, call_id, tool, result_turn, status, level, valid, errors, canonical.

    status: 'linked', 'no result', 'result before call' or 'repeated id'; canonical is null if the
    arguments aren't JSON.
    """
    found = calls(messages).withColumn("uses", F.coalesce(references("arguments"), F.array().cast("array<string>")))
    found = cut(validation(found, tools))
    times = found.groupBy("conv_id", "call_id").agg(F.count("*").alias("times"))
    df = found.join(times, ["conv_id", "call_id"]).join(results(messages), ["conv_id", "call_id"], "left").join(levels(found), ["conv_id", "call_id"], "left")
    status = F.when(F.col("times") > 1, "repeated id").when(F.col("result_turn").isNull(), "no result").when(F.col("result_turn") <= F.col("turn"), "result before call").otherwise("linked")
    text = F.to_json(F.struct(F.col("call_id").alias("id"), F.coalesce("tool", F.lit("")).alias("name")))
    content = F.coalesce(F.to_json(F.struct(F.col("content").alias("result"))), F.lit("{}"))
    canonical = F.concat(F.lit('{"arguments":'), F.to_json("v"), F.lit(","), F.substring(text, F.lit(2), F.length(text) - 2), F.when(F.length(content) > 2, F.concat(F.lit(","), F.substring(content, F.lit(2), F.length(content) - 2))).otherwise(F.lit("")), F.lit("}"))
    return df.select("conv_id", "turn", "place", "call_id", "tool", "result_turn", status.alias("status"), "level", (F.col("errors") == "").alias("valid"), "errors", F.when(F.col("v").isNotNull() & ~too_long("arguments"), canonical).alias("canonical"))


def tools_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOOLS), TOOLS_SCHEMA)


def as_tool_messages(turns: DataFrame) -> DataFrame:
    """Conversations without tools, read as if they had some: the registered query's input, made by rule from every turn.

    Each user turn becomes an assistant's call of the tool that its number picks, with arguments from its
    whole text (every seventh turn leaves out or adds one); each assistant turn becomes the result of the
    call before it. Calls from turn 4 on, but not at turns divisible by 8, use the result of the one two turns before.
    """
    name = F.expr("element_at(array('search', 'translate', 'count'), CAST(pmod(turn div 2, 3) + 1 AS INT))")
    own = F.concat(F.lit("c"), F.col("turn").cast("string"))
    after = F.when((F.col("turn") >= 4) & (F.col("turn") % 8 != 0), F.concat(F.lit("$c"), (F.col("turn") - 2).cast("string")))
    odd = F.col("turn") % 7 == 6
    text = F.coalesce(F.col("text"), F.lit(""))
    arguments = (
        F.when(name == "search", F.to_json(F.struct(F.when(~odd, text).alias("query"), F.length(text).cast("long").alias("limit"), after.alias("after"))))
        .when(name == "translate", F.to_json(F.struct(F.lit("en").alias("target"), text.alias("text"), F.when(odd, F.lit(1)).alias("extra"))))
        .otherwise(F.to_json(F.struct(F.split(text, " ").alias("words"), F.when(odd, F.lit(1)).otherwise(F.lit(None)).alias("exact"), after.alias("after"))))
    )
    call = F.concat(F.lit('{"tool_calls":[{"id":"'), own, F.lit('","name":"'), name, F.lit('","arguments":'), arguments, F.lit("}]}"))
    reply = F.to_json(F.struct(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("tool_call_id"), F.md5(text.cast("binary")).alias("content")))
    user = turns.where("role = 'user'").select("conv_id", "turn", F.lit("assistant").alias("role"), call.alias("text"))
    return user.unionByName(turns.where("role = 'assistant'").select("conv_id", "turn", F.lit("tool").alias("role"), reply.alias("text")))


#: The registered query in DuckDB SQL: the messages' rule, and what the schema above has to say about such arguments.
#: A call's level is the round in which all calls that it uses have one.
ORACLE_SQL = """
WITH RECURSIVE u AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, ['search', 'translate', 'count'][CAST(turn // 2 % 3 + 1 AS BIGINT)] AS tool, turn % 7 = 6 AS odd, coalesce(text, '') AS text,
    CASE WHEN turn >= 4 AND turn % 8 <> 0 THEN '"after":"$c' || (turn - 2) || '"' END AS after
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT *, '{' || CASE tool
    WHEN 'search' THEN concat_ws(',', after, '"limit":' || length(text), CASE WHEN NOT odd THEN '"query":' || to_json(text) END)
    WHEN 'translate' THEN concat_ws(',', CASE WHEN odd THEN '"extra":1' END, '"target":"en"', '"text":' || to_json(text))
    ELSE concat_ws(',', after, CASE WHEN odd THEN '"exact":1' END, '"words":' || to_json(string_split(text, ' '))) END || '}' AS arguments,
    CASE WHEN NOT odd THEN '' ELSE CASE tool WHEN 'search' THEN 'missing query' WHEN 'translate' THEN 'unknown extra' ELSE 'type exact' END END AS errors,
    count(*) OVER (PARTITION BY conv_id, turn) AS times FROM u),
results AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, min(turn) AS result_turn, arg_min(md5(coalesce(text, '')), (turn, md5(coalesce(text, '')))) AS content
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
values_ AS (SELECT DISTINCT conv_id, call_id, substr(value ->> '$', 2) AS used FROM c, json_tree(arguments) AS t(key, value, type, atom, id, parent, fullkey, path) WHERE type = 'VARCHAR' AND starts_with(value ->> '$', '$')),
ids AS (SELECT conv_id, call_id, coalesce(list(DISTINCT used) FILTER (used IS NOT NULL), []) AS uses FROM (SELECT DISTINCT conv_id, call_id FROM c)
  LEFT JOIN (SELECT v.* FROM values_ v SEMI JOIN c ON v.conv_id = c.conv_id AND v.used = c.call_id) USING (conv_id, call_id) GROUP BY ALL),
rounds AS (SELECT 0 AS k, *, CASE WHEN len(uses) = 0 THEN 0 END AS level FROM ids
  UNION ALL SELECT k + 1, conv_id, call_id, uses, CASE WHEN level IS NOT NULL THEN level WHEN list_has_all(ready, uses) THEN k + 1 END
  FROM (SELECT *, coalesce(list(call_id) FILTER (level IS NOT NULL) OVER (PARTITION BY conv_id), []) AS ready, max(level) OVER () AS latest FROM rounds) WHERE latest = k),
levels AS (SELECT conv_id, call_id, max(level) AS level FROM rounds GROUP BY ALL)
SELECT conv_id, turn, 0 AS place, call_id, tool, result_turn, CASE WHEN times > 1 THEN 'repeated id' WHEN result_turn IS NULL THEN 'no result' WHEN result_turn <= turn THEN 'result before call' ELSE 'linked' END AS status,
  level, errors = '' AS valid, errors, sha256('{"arguments":' || arguments || ',"id":' || to_json(call_id) || ',"name":' || to_json(tool) || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content) END || '}') AS canonical_sha256
FROM c LEFT JOIN results USING (conv_id, call_id) LEFT JOIN levels USING (conv_id, call_id)
"""
