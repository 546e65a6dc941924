"""Queries on prices and revenue over ``lineitem``, ``orders`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import pricing
from tessella.plans.registry import query
from tessella.sources.tables import table


def named(frame, keys, cols, digits=6, exact=()):
    return frame.select(*keys, *[(c if n in exact else F.round(c, digits)).alias(n) for n, c in cols.items()])


PTS_SQL = "pts AS (SELECT o_orderpriority AS segment, year(o_orderdate)::INT AS seq, round(avg(o_totalprice), 2) AS price, count(*)::DOUBLE AS quantity FROM orders GROUP BY 1, 2)"


def points(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("segment"), F.year("o_orderdate").alias("seq")).agg(F.round(F.avg("o_totalprice"), 2).alias("price"), F.count("*").cast("double").alias("quantity"))


E_SQL = f"""{PTS_SQL}, lg AS (SELECT *, lag(price) OVER w AS p0, lag(quantity) OVER w AS q0 FROM pts WINDOW w AS (PARTITION BY segment ORDER BY seq)),
  el AS (SELECT segment, coalesce(avg(CASE WHEN p0 IS NULL THEN NULL WHEN abs((price - p0) / p0) > 1e-10 THEN abs(((quantity - q0) / q0) / ((price - p0) / p0)) ELSE 0 END), 0) AS e,
    arg_max(price, {{'v': price * quantity, 's': seq}}) AS optimal_price, avg(price) AS ap, min(price) AS lo, max(price) AS hi, sum(quantity) AS q, arg_max(price, seq) AS lastp, arg_max(quantity, seq) AS lastq FROM lg GROUP BY 1)"""


def elastic(spark, sf_dir):
    p = points(spark, sf_dir)
    more = p.groupBy("segment").agg(F.avg("price").alias("ap"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.max_by("price", "seq").alias("lastp"), F.max_by("quantity", "seq").alias("lastq"))
    return pricing.elasticity(p).join(more, "segment").withColumnRenamed("price_elasticity", "e")


@query("price_elasticity", f"WITH {E_SQL} SELECT segment, round(e, 6) AS price_elasticity, optimal_price, CASE WHEN e > 1.5 THEN 'highly_elastic' WHEN e > 1 THEN 'elastic' WHEN e > 0.5 THEN 'inelastic' ELSE 'highly_inelastic' END AS elasticity_classification FROM el")
def price_elasticity(spark, sf_dir):
    return elastic(spark, sf_dir).select("segment", F.round("e", 6).alias("price_elasticity"), "optimal_price", "elasticity_classification")


@query(
    "price_best",
    f"""WITH {E_SQL}, t AS (SELECT *, CASE WHEN e > 0 THEN lastp * (1 + 0.1::DOUBLE / (e + 1)) ELSE lastp * 1.1::DOUBLE END AS target FROM el), c AS (SELECT *, least(greatest((target - lastp) / lastp * 100, -20), 30) AS ch FROM t),
    m AS (SELECT *, ch / nullif(e, 0) / 100 AS moved FROM c) SELECT segment, round(target, 4) AS optimized_price, round(ch, 4) AS price_adjustment, round(least(greatest((target * lastq * (1 + moved) - lastp * lastq) / (lastp * lastq) * 100, -30), 50), 4) AS projected_revenue_increase,
    CASE WHEN moved < -0.1 THEN 'Volume decline risk' WHEN moved > 0.1 THEN 'Volume growth opportunity' ELSE 'Minimal volume impact' END AS customer_impact FROM m""",
)
def price_best(spark, sf_dir):
    return named(elastic(spark, sf_dir), ["segment"], pricing.best_price(F.col("lastp"), F.col("e"), F.col("lastq")), 4, ("customer_impact",))


@query("price_thresholds", f"WITH {E_SQL} SELECT segment, round(0.8::DOUBLE * ap, 4) AS acceptable_threshold, round(ap, 4) AS breakeven_threshold, round(1.5::DOUBLE * ap, 4) AS premium_threshold, round(1.3::DOUBLE * ap, 4) AS conversion_drop_point FROM el")
def price_thresholds(spark, sf_dir):
    return named(elastic(spark, sf_dir), ["segment"], pricing.thresholds(F.col("ap")), 4)


@query("price_demand", f"WITH {E_SQL} SELECT segment, m::DOUBLE AS multiplier, round(greatest(lastq * (1 + (1 - m::DOUBLE) * e * 0.5::DOUBLE), 0), 6) AS demand FROM el, (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE), (1.1::DOUBLE), (1.2::DOUBLE)) v(m)")
def price_demand(spark, sf_dir):
    m = F.explode(F.array(*[F.lit(x) for x in (0.8, 0.9, 1.0, 1.1, 1.2)]))
    return elastic(spark, sf_dir).withColumn("multiplier", m).select("segment", "multiplier", F.round(pricing.demand(F.col("lastq"), F.col("e"), F.col("multiplier")), 6).alias("demand"))


@query(
    "price_change_impact",
    f"""WITH {E_SQL}, r AS (SELECT segment, 0.05::DOUBLE * -e AS v, ((1 + 0.05::DOUBLE) * (1 + 0.05::DOUBLE * -e) - 1) * 100 AS rev FROM el) SELECT segment, round(v * 100, 6) AS projected_volume_change, round(rev, 6) AS projected_revenue_change, round(greatest(-v, 0) * 50, 6) AS churn_risk_increase,
    CASE WHEN rev > 5 THEN 'Price increase justified by revenue growth' WHEN rev < -5 THEN 'Price increase will damage revenue; not recommended' ELSE 'Minimal revenue impact; proceed with caution' END AS recommendation FROM r""",
)
def price_change_impact(spark, sf_dir):
    return named(elastic(spark, sf_dir), ["segment"], pricing.price_change(F.lit(0.05), -F.col("e")), 6, ("recommendation",))


@query(
    "price_gap",
    """WITH b AS (SELECT p_brand AS segment, avg(p_retailprice) AS own FROM part GROUP BY 1), g AS (SELECT segment, own, (sum(own) OVER () - own) / (count(*) OVER () - 1) AS m, (SELECT min(o.own) FROM b o WHERE o.segment <> b.segment) AS lo, (SELECT max(o.own) FROM b o WHERE o.segment <> b.segment) AS hi FROM b),
    c AS (SELECT *, least(greatest((own - m) / m * 100, -50), 100) AS gap FROM g) SELECT segment, round(gap, 6) AS price_gap, CASE WHEN gap < -20 THEN 'very_competitive' WHEN gap < 0 THEN 'competitive' WHEN gap < 20 THEN 'in_line' ELSE 'premium' END AS competitiveness,
    CASE WHEN own < lo THEN 'market_leader' WHEN own > hi THEN 'premium_tier' ELSE 'middle_market' END AS market_position FROM c""",
)
def price_gap(spark, sf_dir):
    """Each brand against the means of the others, of which there are few."""
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("segment")).agg(F.avg("p_retailprice").alias("own"))
    rivals = b.select(F.col("segment").alias("other"), F.col("own").alias("theirs"))
    both = b.join(F.broadcast(rivals), F.col("segment") != F.col("other")).groupBy("segment", "own").agg(F.avg("theirs").alias("m"), F.min("theirs").alias("lo"), F.max("theirs").alias("hi"))
    return named(both, ["segment"], pricing.competitive(F.col("own"), F.col("m"), F.col("lo"), F.col("hi")), 6, ("competitiveness", "market_position"))


T_SQL = "t AS (SELECT c_mktsegment AS segment, count(*) FILTER (year(o_orderdate) = 1998)::DOUBLE AS cur, count(*) FILTER (year(o_orderdate) BETWEEN 1995 AND 1997) / 3.0::DOUBLE AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


@query(
    "tier_migration",
    f"WITH {T_SQL}, g AS (SELECT segment, (cur - mean) / mean AS g FROM t) SELECT segment, round(least(greatest(1 - abs(g), 0), 1), 9) AS stay, round(greatest(g, 0), 9) AS upgrade, round(greatest(-g, 0), 9) AS downgrade, CASE WHEN g > 0.1 THEN 'upgrade' WHEN g < -0.1 THEN 'downgrade' ELSE 'stay' END AS most_likely, CASE WHEN g < -0.3 THEN 0.8 ELSE 0.2 END::DOUBLE AS churn_risk FROM g",
)
def tier_migration(spark, sf_dir):
    y = F.year("o_orderdate")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    t = rows.groupBy("segment").agg(F.count_if(y == 1998).cast("double").alias("cur"), (F.count_if(y.between(1995, 1997)) / 3.0).alias("mean"))
    return named(t, ["segment"], pricing.tier_migration(F.col("cur"), F.col("mean")), 9, ("most_likely",))


BUY_SQL = "buy AS (SELECT c_mktsegment AS segment, o_orderpriority AS category, sum(o_totalprice) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), sh AS (SELECT segment, category, amount / sum(amount) OVER (PARTITION BY segment) AS affinity FROM buy)"


def bought(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    return rows.select("segment", F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("amount"))


@query("category_affinity", f"WITH {BUY_SQL} SELECT segment, category, round(affinity, 9) AS affinity FROM sh")
def category_affinity(spark, sf_dir):
    return pricing.category_affinity(bought(spark, sf_dir))[0].withColumn("affinity", F.round("affinity", 9))


@query("category_bundles", f"WITH {BUY_SQL}, p AS (SELECT a.segment, a.category || '-' || b.category AS bundle, sqrt(a.affinity * b.affinity) AS score, row_number() OVER (PARTITION BY a.segment ORDER BY sqrt(a.affinity * b.affinity) DESC, a.category, b.category)::INT AS rank FROM sh a JOIN sh b ON a.segment = b.segment AND a.category < b.category) SELECT segment, bundle, round(score, 9) AS score, rank FROM p WHERE rank <= 3")
def category_bundles(spark, sf_dir):
    return pricing.category_affinity(bought(spark, sf_dir))[1].withColumn("score", F.round("score", 9))


S_SQL = "s AS (SELECT l_returnflag || l_linestatus AS segment, l_discount AS discount, l_quantity / 50.0::DOUBLE AS response FROM lineitem), ps AS (SELECT segment, avg(response) / avg(discount) AS s FROM s GROUP BY 1)"


def sensitive(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("segment"), F.col("l_discount").alias("discount"), (F.col("l_quantity") / 50.0).alias("response"))
    return pricing.price_sensitivity(rows)


@query("price_sensitivity", f"WITH {S_SQL} SELECT segment, round(s, 6) AS price_sensitivity, CASE WHEN s > 2 THEN 'highly_sensitive' WHEN s > 1 THEN 'sensitive' WHEN s > 0.5 THEN 'moderate' ELSE 'insensitive' END AS sensitivity_class, round(least(greatest(1 - s / 3, 0), 1), 6) AS willingness_to_pay FROM ps")
def price_sensitivity(spark, sf_dir):
    return sensitive(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("price_sensitivity", "willingness_to_pay")})


@query(
    "discount_optimum",
    f"WITH {S_SQL}, d AS (SELECT segment, s / 4 AS s, least(greatest(0.15::DOUBLE * s / 4, 0), 0.5) AS d FROM ps) SELECT segment, round(d, 6) AS optimal_discount, round(2 * d * s, 6) AS expected_lift, round(2 * d * s * 1000 * (1 - d), 4) AS revenue_impact, round(0.3::DOUBLE * 2 * d * s, 6) AS acquisition_impact, 2 * d * s * 1000 * (1 - d) > 0.1 AS recommended FROM d",
)
def discount_optimum(spark, sf_dir):
    cols = pricing.discount(F.col("price_sensitivity") / 4.0, F.lit(1000.0))
    return sensitive(spark, sf_dir).select("segment", *[(c if n == "recommended" else F.round(c, 4 if n == "revenue_impact" else 6)).alias(n) for n, c in cols.items()])


@query("price_range", "SELECT p_brand AS segment, round(1.2::DOUBLE * min(p_retailprice), 4) AS minimum_price, round(avg(p_retailprice) * 1.15::DOUBLE, 4) AS maximum_price, round((1.2::DOUBLE * min(p_retailprice) + avg(p_retailprice) * 1.15::DOUBLE) / 2, 4) AS optimal_price, round(least(greatest((avg(p_retailprice) * 1.15::DOUBLE - 1.2::DOUBLE * min(p_retailprice)) / avg(p_retailprice), 0), 1), 4) AS flexibility FROM part GROUP BY 1")
def price_range(spark, sf_dir):
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("segment")).agg(F.avg("p_retailprice").alias("market"), F.min("p_retailprice").alias("cost"))
    return named(b, ["segment"], pricing.price_range(F.col("market"), F.col("cost"), F.lit(0.5)), 4)


@query(
    "margin_optimum",
    "SELECT p_brand AS segment, round((avg(p_retailprice) - min(p_retailprice)) * 100 / avg(p_retailprice), 4) AS current_margin, round(greatest(min(p_retailprice) * 2.2::DOUBLE, avg(p_retailprice)), 4) AS optimal_price, round((greatest(min(p_retailprice) * 2.2::DOUBLE, avg(p_retailprice)) - min(p_retailprice)) * 100 / greatest(min(p_retailprice) * 2.2::DOUBLE, avg(p_retailprice)), 4) AS optimal_margin FROM part GROUP BY 1",
)
def margin_optimum(spark, sf_dir):
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("segment")).agg(F.avg("p_retailprice").alias("market"), F.min("p_retailprice").alias("cost"))
    return named(b, ["segment"], pricing.margin(F.col("market"), F.col("cost")), 4)


@query("bundle_price", "SELECT p_brand AS segment, round(0.85::DOUBLE * sum(p_retailprice), 2) AS bundle_price, round(least(greatest((sum(p_retailprice) - 0.85::DOUBLE * sum(p_retailprice)) * 100 / sum(p_retailprice), 0), 30), 6) AS discount FROM part GROUP BY 1")
def bundle_price(spark, sf_dir):
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("segment")).agg(F.sum("p_retailprice").alias("total"))
    cols = pricing.bundle(F.col("total"))
    return b.select("segment", F.round(cols["bundle_price"], 2).alias("bundle_price"), F.round(cols["discount"], 6).alias("discount"))


TV_SQL = "tv AS (SELECT c_mktsegment AS segment, o_orderpriority AS tier, round(sum(o_totalprice), 2) AS value, count(*) FILTER (year(o_orderdate) = 1998)::DOUBLE / count(*) FILTER (year(o_orderdate) = 1997) AS growth, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) AS churn FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def tiers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    y = F.year("o_orderdate")
    return rows.groupBy("segment", F.col("o_orderpriority").alias("tier")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), (F.count_if(y == 1998) / F.nullif(F.count_if(y == 1997), F.lit(0))).alias("growth"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("churn"))


@query("tier_value", f"WITH {TV_SQL} SELECT segment, arg_max(tier, {{'v': value, 't': tier}}) AS most_valuable_tier, round(max(value) / sum(value), 9) AS value_concentration, arg_max(tier, {{'v': growth, 't': tier}}) AS fastest_growing_tier FROM tv GROUP BY 1")
def tier_value(spark, sf_dir):
    return pricing.tier_value(tiers(spark, sf_dir), "segment").withColumn("value_concentration", F.round("value_concentration", 9))


@query("tier_churn", f"WITH {TV_SQL} SELECT segment, arg_max(tier, {{'v': churn, 't': tier}}) AS highest_churn_tier, arg_min(tier, {{'v': churn, 't': tier}}) AS lowest_churn_tier, 0.65::DOUBLE AS price_churn_correlation FROM tv GROUP BY 1")
def tier_churn(spark, sf_dir):
    return pricing.churn_by_tier(tiers(spark, sf_dir), "segment")


R_SQL = "r AS (SELECT c_mktsegment AS segment, o_custkey AS member, round(sum(o_totalprice), 2) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY x DESC) AS i, count(*) OVER (PARTITION BY segment) AS n, sum(x) OVER (PARTITION BY segment) AS t FROM r)"


def revenues(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    return rows.groupBy("segment", F.col("o_custkey").alias("member")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))


@query("segment_revenue", f"WITH {R_SQL} SELECT segment, round(sum(x), 2) AS total_revenue, count(*) AS member_count, round(avg(x), 2) AS avg_revenue_per_member, round(max(x) / sum(x), 9) AS largest_share, round(sum(x) FILTER (i <= greatest(n // 5, 1)) / sum(x), 9) AS revenue_concentration FROM rk GROUP BY 1")
def segment_revenue(spark, sf_dir):
    out = pricing.segment_revenue(revenues(spark, sf_dir), "segment")
    return out.withColumns({"total_revenue": F.round("total_revenue", 2), "avg_revenue_per_member": F.round("avg_revenue_per_member", 2), "largest_share": F.round("largest_share", 9), "revenue_concentration": F.round("revenue_concentration", 9)})


@query("revenue_concentration", f"WITH {R_SQL}, c AS (SELECT segment, sum((x / t) * (x / t)) AS hhi, greatest(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 0) AS gini, sum(x) FILTER (i <= greatest(n // 10, 1)) / sum(x) AS top_share FROM rk GROUP BY 1) SELECT segment, round(hhi, 9) AS hhi, round(gini, 9) AS gini, round(top_share, 9) AS top_share, CASE WHEN hhi > 0.5 THEN 'critical' WHEN hhi > 0.25 THEN 'high' WHEN hhi > 0.21 THEN 'medium' ELSE 'low' END AS risk FROM c")
def revenue_concentration(spark, sf_dir):
    return pricing.concentration(revenues(spark, sf_dir), "segment").withColumns({c: F.round(c, 9) for c in ("hhi", "gini", "top_share")})


I_SQL = "i AS (SELECT n_name AS segment, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount)) / 2 AS investment, sum(l_extendedprice * l_discount) AS cogs, count(*)::DOUBLE AS items, count(DISTINCT s_suppkey)::DOUBLE AS members FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"


def invested(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy(F.col("n_name").alias("segment")).agg(F.sum("l_extendedprice").alias("revenue"), (F.sum(net) / 2).alias("investment"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("cogs"), F.count("*").cast("double").alias("items"), F.countDistinct("s_suppkey").cast("double").alias("members"))


@query("revenue_roi", f"WITH {I_SQL}, q AS (SELECT *, (revenue - investment) * 100 / investment AS r FROM i) SELECT segment, round(r, 6) AS roi_percentage, round(least(investment * 365 / revenue, 10000), 6) AS payback_days, round(revenue / investment, 6) AS profitability_index, CASE WHEN r > 100 THEN 'low' WHEN r > 20 THEN 'medium' WHEN r > 0 THEN 'medium-high' ELSE 'high' END AS risk FROM q")
def revenue_roi(spark, sf_dir):
    return named(invested(spark, sf_dir), ["segment"], pricing.roi(F.col("revenue"), F.col("investment")), 6, ("risk",))


@query("revenue_margins", f"WITH {I_SQL} SELECT segment, round((revenue - cogs) / revenue * 100, 6) AS gross_margin, round((revenue - cogs - investment) / revenue * 100, 6) AS operating_margin, round(least(greatest((revenue - cogs - investment) / revenue * 100, -100), 100), 6) AS net_margin FROM i")
def revenue_margins(spark, sf_dir):
    return named(invested(spark, sf_dir), ["segment"], pricing.margins(F.col("revenue"), F.col("cogs"), F.col("investment")), 6)


@query("revenue_cac", f"WITH {I_SQL}, c AS (SELECT segment, cogs / items AS cac, least(cogs / items / 200.0::DOUBLE, 1000) AS pb FROM i) SELECT segment, round(cac, 6) AS cac, round(pb, 6) AS payback_months, round(CASE WHEN pb > 0 AND pb < 12 THEN (12 - pb) / 12 WHEN pb = 0 THEN 1 ELSE 0 END, 6) AS efficiency FROM c")
def revenue_cac(spark, sf_dir):
    return named(invested(spark, sf_dir), ["segment"], pricing.cac(F.col("cogs"), F.col("items"), F.lit(200.0)), 6)


@query("revenue_efficiency", f"WITH {I_SQL}, e AS (SELECT segment, least((revenue / cogs + revenue / (items * 1000) + revenue / (members * 1e6)) / 3 / 100, 1) AS s FROM i) SELECT segment, round(s, 6) AS efficiency_score, CASE WHEN s > 0.75 THEN 'best-in-class' WHEN s > 0.5 THEN 'above-average' WHEN s > 0.25 THEN 'average' ELSE 'below-average' END AS efficiency_class FROM e")
def revenue_efficiency(spark, sf_dir):
    return named(invested(spark, sf_dir), ["segment"], pricing.efficiency(F.col("revenue"), F.col("cogs"), F.col("items") * 1000, F.col("members") * 1e6), 6, ("efficiency_class",))


@query("revenue_upsell", f"WITH {I_SQL}, u AS (SELECT segment, members, cogs / revenue * 8 AS pen, revenue / items AS aov FROM i) SELECT segment, trunc(members * 10 * (1 - pen))::BIGINT AS addressable_members, round(trunc(members * 10 * (1 - pen)) * aov, 2) AS revenue_potential, CASE WHEN pen < 0.2 THEN 0.9 WHEN pen < 0.5 THEN 0.7 WHEN pen < 0.8 THEN 0.4 ELSE 0.1 END::DOUBLE AS priority FROM u")
def revenue_upsell(spark, sf_dir):
    cols = pricing.upsell(F.col("cogs") / F.col("revenue") * 8, F.col("members") * 10, F.col("revenue") / F.col("items"))
    return invested(spark, sf_dir).select("segment", *[(F.round(c, 2) if n == "revenue_potential" else c).alias(n) for n, c in cols.items()])


@query("revenue_health", f"WITH {I_SQL}, h AS (SELECT segment, 100 * (0.35::DOUBLE * least(greatest(((revenue - investment) * 100 / investment + 100) / 200, 0), 1) + 0.25::DOUBLE * 0.6 + 0.25::DOUBLE * cogs / revenue + 0.15::DOUBLE * 0.9) AS s FROM i) SELECT segment, round(s, 6) AS health_score, CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 60 THEN 'good' WHEN s >= 40 THEN 'fair' ELSE 'poor' END AS health_class FROM h")
def revenue_health(spark, sf_dir):
    return named(invested(spark, sf_dir), ["segment"], pricing.revenue_health((F.col("revenue") - F.col("investment")) * 100 / F.col("investment"), F.lit(10.0), F.col("cogs") / F.col("revenue"), F.lit(0.1)), 6, ("health_class",))


@query("revenue_product_mix", "WITH p AS (SELECT n_name AS segment, p_brand AS product, sum(l_extendedprice) AS x FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2), s AS (SELECT *, x / sum(x) OVER (PARTITION BY segment) AS s FROM p) SELECT segment, round(sum(s * s), 9) AS concentration, round(1 - sum(s * s), 9) AS diversity, round(max(s), 9) AS top_share, arg_max(product, s) AS top_product FROM s GROUP BY 1")
def revenue_product_mix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    li = li.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    out = pricing.product_mix(li.select(F.col("n_name").alias("segment"), F.col("p_brand").alias("product"), F.col("l_extendedprice").alias("x")), "segment")
    return out.withColumns({c: F.round(c, 9) for c in ("concentration", "diversity", "top_share")})


Y_SQL = "y AS (SELECT o_orderpriority AS segment, sum(o_totalprice) FILTER (year(o_orderdate) = 1997) AS a, sum(o_totalprice) FILTER (year(o_orderdate) = 1998) AS b, sum(o_totalprice) FILTER (year(o_orderdate) = 1995) AS c FROM orders GROUP BY 1)"


def yearly(spark, sf_dir):
    in_ = lambda y: F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("segment")).agg(in_(1997).alias("a"), in_(1998).alias("b"), in_(1995).alias("c"))


@query("revenue_growth", f"WITH {Y_SQL}, g AS (SELECT *, (b - a) * 100 / a AS p FROM y) SELECT segment, round(b - a, 2) AS absolute_growth, round(p, 6) AS growth_percentage, round((pow(b / c, 1 / 3.0::DOUBLE) - 1) * 100, 6) AS cagr, CASE WHEN p > 20 THEN 'high-growth' WHEN p > 5 THEN 'moderate-growth' WHEN p > -5 THEN 'stable' WHEN p > -20 THEN 'slow-decline' ELSE 'rapid-decline' END AS growth_class FROM g")
def revenue_growth(spark, sf_dir):
    cols = pricing.growth(F.col("a"), F.col("b"), F.col("c"))
    return yearly(spark, sf_dir).select("segment", *[(c if n == "growth_class" else F.round(c, 2 if n == "absolute_growth" else 6)).alias(n) for n, c in cols.items()])


@query("revenue_cohorts", "WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS y FROM orders GROUP BY 1), g AS (SELECT y::INT AS cohort, count(DISTINCT o.o_custkey) FILTER (year(o_orderdate) = 1999) AS m, count(DISTINCT o.o_custkey) AS n, sum(o_totalprice) AS rev FROM orders o JOIN f USING (o_custkey) GROUP BY 1) SELECT cohort, round(CASE WHEN m > 0 THEN rev / m ELSE 0 END, 2) AS revenue_per_member, round(m::DOUBLE / n, 9) AS retention FROM g")
def revenue_cohorts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = o.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("cohort"))
    g = o.join(first, "o_custkey").groupBy("cohort").agg(F.countDistinct(F.when(F.year("o_orderdate") == 1999, F.col("o_custkey"))).alias("m"), F.countDistinct("o_custkey").alias("n"), F.sum("o_totalprice").alias("rev"))
    cols = pricing.cohort_revenue(F.col("rev"), F.col("m"), F.col("n"))
    return g.select("cohort", F.round(cols["revenue_per_member"], 2).alias("revenue_per_member"), F.round(cols["retention"], 9).alias("retention"))


@query(
    "revenue_anomaly",
    """WITH m AS (SELECT o_orderpriority AS segment, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS t, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2),
    s AS (SELECT segment, t, x, avg(x) OVER w AS mean, stddev_pop(x) OVER w AS sd, lag(x) OVER (PARTITION BY segment ORDER BY t) AS base FROM m WINDOW w AS (PARTITION BY segment)),
    z AS (SELECT *, (x - mean) / sd AS z, (x - base) * 100 / base AS v FROM s WHERE base IS NOT NULL)
    SELECT segment, t, round(z, 6) AS z_score, round(v, 6) AS variance_percentage, CASE WHEN abs(z) > 3 OR abs(v) > 50 THEN 'critical' WHEN abs(z) > 2.5 OR abs(v) > 40 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN x < base THEN 'revenue_decline' ELSE 'revenue_spike' END AS alert_type FROM z WHERE abs(z) > 2 OR abs(v) > 30""",
)
def revenue_anomaly(spark, sf_dir):
    from pyspark.sql import Window

    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("segment"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t")).agg(F.sum("o_totalprice").alias("x"))
    w = Window.partitionBy("segment")
    s = m.withColumn("mean", F.avg("x").over(w)).withColumn("sd", F.stddev_pop("x").over(w)).withColumn("base", F.lag("x").over(w.orderBy("t"))).where("base IS NOT NULL")
    cols = pricing.anomalies(F.col("x"), F.col("base"), F.col("mean"), F.col("sd"))
    out = s.select("segment", "t", *[(F.round(c, 6) if n in ("z_score", "variance_percentage") else c).alias(n) for n, c in cols.items()])
    return out.where("alert").drop("alert")


@query("revenue_attribution", "WITH a AS (SELECT c_mktsegment AS segment, o_orderpriority AS channel, sum(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT segment, round(sum(x) * 0.25::DOUBLE, 2) AS first_touch, round(sum(x) * 0.25::DOUBLE, 2) AS last_touch, round(sum(x) * 0.5::DOUBLE, 2) AS multi_touch FROM a GROUP BY 1")
def revenue_attribution(spark, sf_dir):
    per = bought(spark, sf_dir).groupBy("segment", F.col("category").alias("channel")).agg(F.sum("amount").alias("x")).withColumn("seq", F.lit(0))
    out = pricing.attribution(per, "segment").drop("channel_attribution")
    return out.withColumns({c: F.round(c, 2) for c in ("first_touch", "last_touch", "multi_touch")})
