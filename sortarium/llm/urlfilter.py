"""URL filters by a temporal join with dated lists, on built-in functions alone.

A list's log says on which day an entry was added or removed. For each (list, kind, value) the log
becomes validity intervals [from, to); a capture is judged by the entries whose interval holds its
fetch time, that is, by each list as it stood then. An entry names a host, a domain (the host itself
and all below it) or a prefix (a host and whole leading path segments). A capture is blocked if a
blocking entry holds for it and no entry of an allow list does.

Of log rows for the same entry and day the highest seq stands. Log rows with nulls are ignored. Null or
malformed URLs have no host and null times meet no entry: such captures aren't blocked. Repeated
captures give equal rows, none is lost; extra columns pass through, added columns replace those of the
same name, and no name of the caller's can clash with the operator's own. Empty lists block nothing. Logs are broadcast only after a
count; a larger log is joined by a shuffle on the keys of distinct captures, salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortarium.llm.common import cut

#: The registered query's log: list, kind, value, action, day, seq.
LOG = (
    ("spam", "host", "spam-farm.example.org", "add", "2024-02-01", 1),
    ("spam", "domain", "spam-farm.example.org", "add", "2024-06-15", 2),
    ("spam", "host", "spam-farm.example.org", "remove", "2024-06-15", 3),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-01-10", 4),
    ("spam", "domain", "cheap-pills.example.com", "remove", "2024-04-10", 5),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-08-01", 6),
    ("spam", "domain", "cheap-pills.example.net", "add", "2024-05-05", 7),
    ("gambling", "domain", "casino-win.example.net", "add", "2024-03-03", 8),
    ("gambling", "domain", "casino-win.example.net", "remove", "2024-11-11", 9),
    ("adult", "host", "adult-x.example.com", "add", "2024-01-01", 10),
    ("adult", "prefix", "adult-x.example.com/en", "add", "2024-01-01", 11),
    ("malware", "domain", "tionsh.example.net", "add", "2024-09-01", 12),
    ("malware", "domain", "tionsh.example.net", "remove", "2024-09-08", 13),
    ("malware", "prefix", "tionsh.example.net/de", "add", "2024-07-01", 14),
    ("allow", "prefix", "tionsh.example.net/en", "add", "2024-09-03", 15),
    ("allow", "host", "www.cheap-pills.example.com", "add", "2024-12-01", 16),
)
LOG_SCHEMA = "list string, kind string, value string, action string, day string, seq long"
ALLOW = ("allow",)
#: List entries up to which they are broadcast; each is a few strings and two times.
BROADCAST_ENTRIES = 100_000
#: Tasks that captures with one key are dealt out to, where the log is too large for a broadcast.
SALTS = 16


def intervals(log: DataFrame) -> DataFrame:
    """(list, kind, value, since, until): when each entry was on its list; until is null where it still is."""
    clean = log.select("list", "kind", F.lower("value").alias("value"), "action", F.try_to_timestamp("day").alias("at"), "seq").dropna()
    last = clean.groupBy("list", "kind", "value", "at").agg(F.max_by("action", "seq").alias("action"))
    order = Window.partitionBy("list", "kind", "value").orderBy("at")
    return last.withColumn("until", F.lead("at").over(order)).where("action = 'add'").select("list", "kind", "value", F.col("at").alias("since"), "until")


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Lower-cased host (null if there is none) and path of a URL, without user, port, query and fragment."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)"
    host = F.lower(F.regexp_extract(F.col(url), pattern, 1))
    return F.when(host != "", F.regexp_replace(host, r"\.$", "")), F.regexp_extract(F.col(url), pattern, 2)


def keys(host: str, path: str) -> Column:
    """array<struct<kind, value>> of all entries that could name a capture."""
    domains = f"transform(sequence(1, size(split({host}, '[.]'))), i -> named_struct('kind', 'domain', 'value', array_join(slice(split({host}, '[.]'), i, size(split({host}, '[.]'))), '.')))"
    parts = f"filter(split({path}, '/'), x -> x <> '')"
    prefixes = f"transform(sequence(0, size({parts})), i -> named_struct('kind', 'prefix', 'value', concat_ws('/', {host}, array_join(slice({parts}, 1, i), '/'))))"
    trimmed = f"transform({prefixes}, p -> named_struct('kind', p.kind, 'value', regexp_replace(p.value, '/$', '')))"
    return F.expr(f"array_distinct(concat(array(named_struct('kind', 'host', 'value', {host})), {domains}, {trimmed}))")


def filtered(captures: DataFrame, log: DataFrame, url: str = "url", fetched: str = "fetched", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """captures and the columns host, lists (of the entries that hold, sorted, comma-joined) and blocked."""
    host, path = host_and_path(url)
    active = cut(intervals(log))
    own = F.struct(F.col(url).cast("string").alias("u"), F.col(fetched).cast("timestamp").alias("t"))
    cases = captures.select(own.alias("c")).select("c.*").distinct().withColumns(dict(zip(("h", "p"), host_and_path("u"))))
    asked = cases.where("h IS NOT NULL AND t IS NOT NULL").select("u", "t", F.explode(keys("h", "p")).alias("key")).select("u", "t", "key.*")
    hits = _met(asked, active).where("t >= since AND (until IS NULL OR t < until)")
    judged = hits.groupBy("u", "t").agg(F.collect_set("list").alias("found"))
    # the captures' own columns, whatever their names, stay in one struct until the verdicts have joined them
    rows = captures.select(F.struct(*(captures[f"`{c}`"] for c in captures.columns)).alias("row"), own.alias("c"), host.alias("host"))
    out = rows.join(judged.select(F.struct("u", "t").alias("of"), "found"), (F.col("c.u") == F.col("of.u")) & (F.col("c.t") == F.col("of.t")), "left")
    found = F.coalesce(F.col("found"), F.array().cast("array<string>"))
    named = F.array(*map(F.lit, allow)) if allow else F.array().cast("array<string>")
    blocked = (F.size(F.array_except(found, named)) > 0) & ~F.arrays_overlap(found, named)
    added = {"host": F.col("host"), "lists": F.array_join(F.array_sort(found), ","), "blocked": blocked}
    kept = [F.col("row").getField(c).alias(c) for c in captures.columns if c.lower() not in added]
    return out.select(*kept, *(v.alias(k) for k, v in added.items()))


def _met(asked: DataFrame, active: DataFrame) -> DataFrame:
    """asked (u, t, kind, value) beside the intervals of its entries.

    A log of proven size is broadcast. A larger one is shuffled, each entry SALTS times: captures that share a key, as all
    of a site or of a top-level domain do, are dealt out by their hashes to as many tasks, and run-time splitting does the rest.
    """
    if active.count() <= BROADCAST_ENTRIES:
        return asked.join(F.broadcast(active), ["kind", "value"])
    dealt = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return asked.withColumn("salt", F.pmod(F.xxhash64("u", "t"), F.lit(SALTS)).cast("int")).join(dealt, ["kind", "value", "salt"]).drop("salt")


def log_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LOG), LOG_SCHEMA)


ORACLE_SQL = f"""
WITH log(list, kind, value, action, day, seq) AS (VALUES {", ".join(str(r) for r in LOG)}),
one AS (SELECT list, kind, value, CAST(day AS DATE) AS day, arg_max(action, seq) AS action FROM log GROUP BY ALL),
span AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, value ORDER BY day) AS until FROM one),
p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) AS fetched,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:@]+(?::[0-9]*)?([^?#]*)', 1) AS path FROM pages),
hit AS (SELECT page_id, list FROM p JOIN span ON action = 'add' AND fetched >= day AND (until IS NULL OR fetched < until)
  AND ((kind = 'host' AND host = value) OR (kind = 'domain' AND (host = value OR ends_with(host, '.' || value)))
    OR (kind = 'prefix' AND starts_with(host || path || '/', value || '/')))),
s AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, bool_or(list <> 'allow') AND NOT bool_or(list = 'allow') AS blocked FROM hit GROUP BY page_id)
SELECT page_id, host, CAST(fetched AS VARCHAR) AS fetched, coalesce(lists, '') AS lists, coalesce(blocked, false) AS blocked FROM p LEFT JOIN s USING (page_id)
"""
