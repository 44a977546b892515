"""Window and ordered-array functions (W) and sampling over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from peaklane.operators import sampling as sm
from peaklane.operators import signal as sg
from peaklane.plans import tables as tb
from peaklane.plans.registry import query


@query("w01_scan_index", f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY sec, event_id) - 1 AS scan_index FROM ({tb.EVENTS_SQL})")
def _(spark, t):
    return sg.scan_index(tb.events(t).withColumn("o", F.struct("sec", "event_id")), ["event_type"], "o").select("event_id", "scan_index")


@query("w01_scan_by_index", f"SELECT event_type, sec, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY sec, event_id) - 1 AS i FROM ({tb.EVENTS_SQL})) WHERE i = 3")
def _(spark, t):
    indexed = sg.scan_index(tb.events(t).withColumn("o", F.struct("sec", "event_id")), ["event_type"], "o")
    return sg.scan_by_index(indexed, ["event_type"], "o", 3).select("event_type", "o.sec", "o.event_id")


@query("w02_top_n", "SELECT l_orderkey, l_extendedprice, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def _(spark, t):
    return sg.top_n(t("lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber"], 3).select("l_orderkey", "l_extendedprice", "l_partkey")


def _smooth_sql(n: int) -> str:
    weights, norm = sg.KERNELS[n]
    terms = " + ".join(f"({c}) * coalesce({'lag' if k < n // 2 else 'lead'}(v, {abs(n // 2 - k)}) OVER w, 0)" for k, c in enumerate(weights))
    return f"SELECT user_id, day, round(({terms}) / {norm}.0, 4) AS smoothed FROM ({tb.DAILY_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY day)"


for _n in (5, 7, 9):

    @query(f"w03_smooth_{_n}", _smooth_sql(_n))
    def _(spark, t, n=_n):
        return sg.smooth(tb.daily(t), ["user_id"], "day", "v", n).select("user_id", "day", F.round("smoothed", 4).alias("smoothed"))


@query("w01_index_of_all", f"SELECT event_id, row_number() OVER (ORDER BY sec, event_id) - 1 AS scan_index FROM ({tb.EVENTS_SQL})")
def _(spark, t):
    return sg.scan_index(tb.events(t).withColumn("o", F.struct("sec", "event_id")), [], "o", most=1024).select("event_id", "scan_index")


@query("w03_smooth_of_all", f"""SELECT user_id, day, round((-3 * coalesce(lag(v, 2) OVER w, 0) + 12 * coalesce(lag(v) OVER w, 0) + 17 * v + 12 * coalesce(lead(v) OVER w, 0) - 3 * coalesce(lead(v, 2) OVER w, 0)) / 35, 4) AS smoothed
FROM ({tb.DAILY_SQL}) WINDOW w AS (ORDER BY user_id, day)""")
def _(spark, t):
    one = tb.daily(t).withColumn("o", F.struct("user_id", "day"))
    return sg.smooth(one, [], "o", "v", 5, most=1024).select("user_id", "day", F.round("smoothed", 4).alias("smoothed"))


@query("w04_smooth_3", f"""SELECT user_id, day, round(CASE WHEN a IS NULL THEN v * 2 / 3 + b / 3 WHEN b IS NULL THEN v * 2 / 3 + a / 3 ELSE a / 4 + v / 2 + b / 4 END, 4) AS smoothed
FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM ({tb.DAILY_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY day))""")
def _(spark, t):
    return sg.smooth(tb.daily(t), ["user_id"], "day", "v", 3).select("user_id", "day", F.round("smoothed", 4).alias("smoothed"))


#: The walk of the peak boundary as recursion: side -1 to the left, 1 to the right of the apex.
_PEAK = """WITH RECURSIVE s AS (SELECT user_id, list(v ORDER BY day) AS x FROM ({daily}) GROUP BY user_id), a AS ({apex}),
g AS (SELECT user_id, side, x, ap, CASE WHEN side < 0 THEN ap - 1 ELSE len(x) - ap END AS n, x[ap] AS top FROM a, (VALUES (-1), (1)) t(side)),
w AS (SELECT user_id, side, x, ap, n, top, 0 AS steps, top AS last, 0 AS rises FROM g
UNION ALL SELECT user_id, side, x, ap, n, top, steps + 1, x[ap + side * (steps + 1)], CASE WHEN x[ap + side * (steps + 1)] < last THEN rises ELSE rises + 1 END FROM w
WHERE steps < n AND NOT (x[ap + side * (steps + 1)] >= last AND (last <= 0.1 * top OR rises >= 1))),
e AS (SELECT user_id, side, x, ap, top, max(steps) AS k FROM w GROUP BY ALL), q AS (SELECT *, [x[ap + side * i] for i in range(1, k + 1)] AS walk FROM e),
b AS (SELECT user_id, side, x, ap, CASE WHEN k > 0 AND list_min(walk) < top THEN list_position(walk, list_min(walk)) ELSE k END AS m FROM q)
SELECT l.user_id, (l.ap - 1)::INT AS apex, (l.ap - l.m - 1)::INT AS left, (l.ap + r.m - 1)::INT AS right, round(greatest(list_min(l.x[l.ap - l.m : l.ap + r.m]), 0), 2) AS min_smoothed FROM b l JOIN b r ON l.user_id = r.user_id AND l.side = -1 AND r.side = 1"""
_TOP = "SELECT user_id, x, CASE WHEN list_max(x) > 0 THEN list_position(x, list_max(x)) ELSE 1 END AS ap FROM s"


def _peaks(df):
    return df.select("user_id", "p.apex", "p.left", "p.right", F.round("p.min_smoothed", 2).alias("min_smoothed"))


@query("w05_find_peak", _PEAK.format(daily=tb.DAILY_SQL, apex=_TOP))
def _(spark, t):
    return _peaks(tb.series(t).withColumn("p", sg.find_peak("values")))


@query("w06_find_peak_at", _PEAK.format(daily=tb.DAILY_SQL, apex="SELECT user_id, x, 11 + user_id % 5 AS ap FROM s"))
def _(spark, t):
    return _peaks(tb.series(t).withColumn("p", sg.find_peak("values", F.lit(10) + F.col("user_id") % 5)))


_CLIMB = """SELECT user_id, x, ap FROM (WITH RECURSIVE c AS (SELECT user_id, x, 11 + user_id % 5 AS p0, 0 AS n FROM s UNION ALL SELECT user_id, x, p0, n + 1 FROM c WHERE p0 - n > 1 AND x[p0 - n - 1] > x[p0 - n]),
g1 AS (SELECT user_id, any_value(x) AS x, any_value(p0) AS p0, max(n) AS n FROM c GROUP BY user_id), l AS (SELECT *, x[p0 - n] AS top FROM g1),
r AS (SELECT user_id, x, p0, n, top, 0 AS k, top AS t FROM l UNION ALL SELECT user_id, x, p0, n, top, k + 1, x[p0 + k + 1] FROM r WHERE p0 + k < len(x) AND x[p0 + k + 1] > t)
SELECT user_id, any_value(x) AS x, CASE WHEN max(k) > 0 THEN any_value(p0) + max(k) ELSE any_value(p0) - any_value(n) END AS ap FROM r GROUP BY user_id)"""


@query("w07_find_peak_climbing", _PEAK.format(daily=tb.DAILY_SQL, apex=_CLIMB))
def _(spark, t):
    return _peaks(tb.series(t).withColumn("p", sg.find_peak("values", F.lit(10) + F.col("user_id") % 5, climb=True)))


def _ions(df):
    return df.select("user_id", "ion", "best_ion", F.round("cor", 4).alias("cor"))


def _best_sql(rule: str) -> str:
    """Every ion's correlation with the best ion of its user, ``best`` chosen by ``rule`` from x(user_id, i, score, skew)."""
    return f"""WITH d AS ({tb.ION_SERIES_SQL}), w AS (SELECT user_id, ion, v AS a FROM d WHERE day = apex),
c AS (SELECT x.user_id, x.ion AS i, y.ion AS j, CASE WHEN x.ion = y.ion THEN 1.0 ELSE greatest(CASE WHEN stddev_pop(x.v) > 0 AND stddev_pop(y.v) > 0 THEN corr(x.v, y.v) ELSE 0 END, 0) END AS cor
FROM d x JOIN d y ON x.user_id = y.user_id AND x.day = y.day WHERE x.day BETWEEN x.lo AND x.hi GROUP BY x.user_id, x.ion, y.ion),
s AS (SELECT c.user_id, i, round(CASE WHEN sum(a) <> 0 THEN sum(cor * a) / sum(a) END, 12) AS score FROM c JOIN w ON w.user_id = c.user_id AND w.ion = c.j GROUP BY c.user_id, i),
e AS (SELECT user_id, ion, max(v) FILTER (WHERE day = lo) AS s, max(v) FILTER (WHERE day = hi) AS e, max(v) FILTER (WHERE day = apex) AS a FROM d GROUP BY user_id, ion),
m AS (SELECT user_id, 1.5 * median(s) AS ms, 1.5 * median(e) AS me, max(a) AS top FROM e GROUP BY user_id),
k AS (SELECT e.user_id, ion, (s > ms AND s > p * a)::INT + (e > me AND e > p * a)::INT AS skew FROM (SELECT e.*, ms, me, CASE WHEN a >= 0.5 * top THEN 0.10 ELSE 0.25 END AS p FROM e JOIN m USING (user_id)) e),
x AS (SELECT s.user_id, i, score, skew FROM s JOIN k ON k.user_id = s.user_id AND k.ion = s.i), b AS (SELECT user_id, {rule} AS best_ion FROM x GROUP BY user_id)
SELECT c.user_id, i AS ion, best_ion::INT AS best_ion, round(cor, 4) AS cor FROM c JOIN b ON b.user_id = c.user_id AND b.best_ion = c.j"""


_FIRST = "coalesce((list(i ORDER BY score DESC, i) FILTER (WHERE {0}))[1], min(i))"


@query("w08_best_ion", _best_sql(_FIRST.format("score IS NOT NULL")))
def _(spark, t):
    return _ions(sg.best_ion(tb.plain_ion_series(t), ["user_id"], "ion", "values", "left", "right", "apex"))


@query("w09_best_ion_without_skew", _best_sql(_FIRST.format("score IS NOT NULL AND skew = 0")))
def _(spark, t):
    return _ions(sg.best_ion(tb.plain_ion_series(t), ["user_id"], "ion", "values", "left", "right", "apex", skew=True))


@query("w10_chosen_ion", _best_sql("any_value(user_id % 5)"))
def _(spark, t):
    ions = tb.plain_ion_series(t).withColumn("chosen", (F.col("user_id") % 5).cast("int"))
    return _ions(sg.best_ion(ions, ["user_id"], "ion", "values", "left", "right", "apex", chosen="chosen"))


@query("w11_refine_peak")
def _(spark, t):
    ions = tb.ion_series(t).withColumn("cor", F.when((F.col("user_id") % 3 == 0) & (F.col("ion") > 1), 0.5).otherwise(1.0))
    return sg.refine_peak(ions, ["user_id"], "values", "left", "right", "cor").withColumn("min_smoothed", F.round("min_smoothed", 2))


_order = tb.order_sql


@query("w12_stratified_sample", f"""WITH m AS (SELECT max(o_totalprice) AS top FROM orders), b AS (SELECT o_orderkey, floor(o_totalprice / top * 10)::BIGINT AS bin FROM orders, m WHERE o_totalprice < top AND o_totalprice >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {_order('o_orderkey', 7)}, o_orderkey) AS r, count(*) OVER (PARTITION BY bin) // 2 AS h FROM b) SELECT o_orderkey, bin FROM r WHERE r <= least(h, 100)""")
def _(spark, t):
    return sm.stratified_sample(t("orders"), "o_totalprice", "o_orderkey", 1000, 7).select("o_orderkey", "bin")


@query("w13_sample_with_tokens", f"""WITH n AS (SELECT p_partkey, '' AS drawn_for FROM part ORDER BY {_order('p_partkey', 7)}, p_partkey LIMIT 100), k AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS token FROM part),
c AS (SELECT token, count(*) AS c FROM k GROUP BY token ORDER BY c DESC, token LIMIT 3), r AS (SELECT p_partkey, token, row_number() OVER (PARTITION BY token ORDER BY {_order('p_partkey', 7)}, p_partkey) AS r FROM k JOIN c USING (token))
SELECT * FROM n UNION ALL SELECT p_partkey, token FROM r WHERE r <= 20 AND (SELECT count(*) FROM part) > 100""")
def _(spark, t):
    return sm.sample_with_tokens(t("part"), "p_partkey", "p_name", 100, 3, 20, 7, " ").select("p_partkey", "drawn_for")


@query("w14_sample_undetected", f"""WITH x AS (SELECT p_brand || '|' || p_type AS grp, p_partkey AS item, p_size > 25 AS det FROM part), d AS (SELECT *, count(*) FILTER (WHERE det) OVER (PARTITION BY grp) AS d FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {_order('item', 7)}, item) AS r FROM d WHERE NOT det AND d > 0) SELECT grp, item FROM r WHERE r <= greatest(ceil(1.0 * (d - 1) / 2 / 2), 1)""")
def _(spark, t):
    x = t("part").select(F.concat_ws("|", "p_brand", "p_type").alias("grp"), F.col("p_partkey").alias("item"), (F.col("p_size") > 25).alias("det"))
    return sm.sample_undetected(x, "grp", "item", "det", 1.0, 2, 7, "item").select("grp", "item")


@query("w15_leakage_free_split", f"""WITH t AS (SELECT count(*) AS n FROM part), r AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY {_order('p_partkey', 7)}, p_partkey) AS r FROM part), s AS (SELECT greatest(1, least(1000, ceil(n * 0.1) - 10)) AS s, n FROM t),
tr AS (SELECT p_partkey, p_size FROM r, s WHERE r <= n - s), l AS (SELECT p_partkey, row_number() OVER (ORDER BY {_order('p_partkey', 7)}, p_partkey) AS r FROM part WHERE p_size NOT IN (SELECT p_size FROM tr)),
te AS (SELECT p_partkey FROM l, s WHERE r <= s UNION ALL SELECT p_partkey FROM part WHERE (SELECT count(*) FROM l) = 0)
SELECT p_partkey, 'train' AS part FROM tr UNION ALL SELECT p_partkey, 'test' FROM te""")
def _(spark, t):
    return sm.leakage_free_split(t("part"), "p_size", "p_partkey", 7).select("p_partkey", "part")


@query("w16_sort_peaks", f"SELECT user_id, array_to_string(list(event_id ORDER BY sec, event_id), ',') AS ids FROM ({tb.EVENTS_SQL}) GROUP BY user_id")
def _(spark, t):
    bins = tb.events(t).groupBy("user_id").agg(F.collect_list(F.struct("sec", "event_id")).alias("peaks"))
    return sg.sort_peaks(bins, ["user_id"], "peaks").select("user_id", F.array_join(F.col("peaks.event_id").cast("array<string>"), ",").alias("ids"))
