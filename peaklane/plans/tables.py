"""The given tables in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklane.operators import generate as gen

#: Lines as a detection report: a group of parts, a part, a ship year, a price and two rates.
REPORT_SQL = "SELECT p_brand || '|' || p_type AS grp, l_partkey AS item, year(l_shipdate) AS run, l_extendedprice AS v, l_discount AS q1, l_tax AS q2 FROM lineitem JOIN part ON p_partkey = l_partkey"


def report(t) -> DataFrame:
    rows = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    return rows.select(F.concat_ws("|", "p_brand", "p_type").alias("grp"), F.col("l_partkey").alias("item"), F.year("l_shipdate").alias("run"), F.col("l_extendedprice").alias("v"), F.col("l_discount").alias("q1"), F.col("l_tax").alias("q2"))


VALUES_SQL = f"SELECT grp, item, run, round(max(v), 2) AS v FROM ({REPORT_SQL}) WHERE q1 <= 0.05 GROUP BY grp, item, run"


def values(t) -> DataFrame:
    return report(t).filter("q1 <= 0.05").groupBy("grp", "item", "run").agg(F.round(F.max("v"), 2).alias("v"))


#: Isolation windows over prices: centres every 10 from 905, 12 wide, so that neighbours overlap.
WINDOWS_SQL = "SELECT DISTINCT floor(p_retailprice / 10) * 10 + 5 AS center, 12.0 AS width, floor(p_retailprice / 10) * 10 - 1 AS lo, floor(p_retailprice / 10) * 10 + 11 AS hi FROM part"


def windows(t) -> DataFrame:
    low = F.floor(F.col("p_retailprice") / 10) * 10
    return t("part").select((low + 5).cast("double").alias("center"), F.lit(12.0).alias("width"), (low - 1).cast("double").alias("lo"), (low + 11).cast("double").alias("hi")).distinct()


#: Events with whole seconds since the first midnight.
EVENTS_SQL = "SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS sec FROM events"


def events(t) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", "user_id", "event_type", "value", F.floor(micros / 1e6 - 1704067200).cast("long").alias("sec"))


#: Sums of value by user and day, 0 on days without events.
DAILY_SQL = f"""SELECT u.user_id, d.day, coalesce(s.v, 0.0) AS v FROM (SELECT DISTINCT user_id FROM events) u
CROSS JOIN (SELECT unnest(range(0, 30)) AS day) d
LEFT JOIN (SELECT user_id, sec // 86400 AS day, round(sum(value), 2) AS v FROM ({EVENTS_SQL}) GROUP BY ALL) s ON s.user_id = u.user_id AND s.day = d.day"""


def daily(t, *keys: str) -> DataFrame:
    keys = keys or ("user_id",)
    sums = events(t).groupBy(*keys, F.floor(F.col("sec") / 86400).cast("int").alias("day")).agg(F.round(F.sum("value"), 2).alias("v"))
    grid = events(t).select(*keys).distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(29))))
    return grid.join(sums, [*keys, "day"], "left").na.fill(0.0, ["v"])


def series(t, *keys: str) -> DataFrame:
    """Daily sums as one array a key."""
    keys = keys or ("user_id",)
    return daily(t, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("l")).select(*keys, F.transform("l", lambda x: x["v"]).alias("values"))


def ion_series(t) -> DataFrame:
    """Users as matches, event types as ions (numbered by name), with the peak bounds of the users' medians."""
    from peaklane.operators import signal as sg

    order = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    ions = series(t, "user_id", "event_type").withColumn("ion", (F.array_position(order, F.col("event_type")) - 1).cast("int")).drop("event_type")
    middle = series(t).withColumn("p", sg.find_peak("values")).select("user_id", "p.*")
    return ions.join(middle, "user_id")


#: The same users and ions with plain bounds: five days on either side of the day of the user's greatest sum.
ION_SERIES_SQL = f"""SELECT k.user_id, ion, r.day, coalesce(s.v, 0.0) AS v, apex, greatest(apex - 5, 0) AS lo, least(apex + 5, 29) AS hi
FROM (SELECT DISTINCT user_id, event_type, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS ion FROM events) k CROSS JOIN (SELECT unnest(range(0, 30)) AS day) r
LEFT JOIN (SELECT user_id, event_type, sec // 86400 AS day, round(sum(value), 2) AS v FROM ({EVENTS_SQL}) GROUP BY ALL) s ON s.user_id = k.user_id AND s.event_type = k.event_type AND s.day = r.day
JOIN (SELECT user_id, min(day) FILTER (WHERE v = top) AS apex FROM (SELECT *, max(v) OVER (PARTITION BY user_id) AS top FROM ({DAILY_SQL})) GROUP BY user_id) a ON a.user_id = k.user_id"""


def plain_ion_series(t) -> DataFrame:
    order = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    ions = series(t, "user_id", "event_type").withColumn("ion", (F.array_position(order, F.col("event_type")) - 1).cast("int")).drop("event_type")
    top = series(t).select("user_id", (F.array_position("values", F.array_max("values")) - 1).cast("int").alias("apex"))
    return ions.join(top, "user_id").withColumns({"left": F.greatest(F.col("apex") - 5, F.lit(0)), "right": F.least(F.col("apex") + 5, F.lit(29))})


PROTEINS_SQL = "SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents"


def proteins(t) -> DataFrame:
    """Documents as proteins: their letters A to Z."""
    return t("documents").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


PEPTIDES_SQL = f"""SELECT DISTINCT doc_id, pep FROM (SELECT doc_id, unnest(string_split(replace(regexp_replace(seq, '([KR])', '\\1|', 'g'), '|P', 'P'), '|')) AS pep FROM ({PROTEINS_SQL}))
WHERE length(pep) BETWEEN 7 AND 12"""


def peptides(t) -> DataFrame:
    return gen.digest(proteins(t), ["doc_id"], "seq", "Trypsin", 0, 7, 12)


def order_sql(key: str, seed: int) -> str:
    """The order in which ``sample_order`` draws integer keys."""
    from peaklane.operators.sampling import FACTOR, MODULUS

    return f"(({key} % {1 << 30} + {seed}) * {FACTOR}) % {MODULUS}"
