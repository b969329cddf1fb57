"""Priced requests; ledgers side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import pricing
from tidemark.plans.base import events, money, registry, table

QUERIES, ORACLES, query = registry()


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 1000 AS prompt FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN prompt > 40000 THEN 6.0 WHEN prompt > 20000 THEN 3.0 ELSE 1.5 END AS rate,
floor(prompt * CASE WHEN prompt > 40000 THEN 6.0 WHEN prompt > 20000 THEN 3.0 ELSE 1.5 END * 1.0 / 1000000.0 * 1e9 + 0.5) / 1e9 AS usd FROM x""")
def context_tier_price(spark, sf_dir):
    tiers = F.array(*[F.struct(F.lit(a).alias("above"), F.lit(r).alias("rate")) for a, r in ((20000.0, 3.0), (40000.0, 6.0))])
    prompt = F.col("l_quantity") * 1000
    rate = F.coalesce(pricing.context_tier(tiers, prompt)["rate"], F.lit(1.5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rate.alias("rate"), pricing.token_line(prompt, rate, F.lit(1.0)).alias("usd"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS cw, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 0.25 END AS w5, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * 0.5 END AS w1, CASE WHEN l_linenumber % 4 = 0 THEN 'anthropic' ELSE 'openai' END AS maker FROM lineitem),
s AS (SELECT *, coalesce(w5, 0) + greatest(cw - coalesce(w5, 0) - coalesce(w1, 0), 0) AS five, coalesce(w1, 0) AS hour FROM x)
SELECT l_orderkey, l_linenumber, five, hour, CASE WHEN maker = 'anthropic' THEN 3.75 ELSE 3.0 END AS rate5, CASE WHEN maker = 'anthropic' THEN 6.0 ELSE 3.0 END AS rate1 FROM s""")
def cache_write_split(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    five, hour = pricing.write_split(q, F.when(n % 2 == 0, q * 0.25), F.when(n % 3 == 0, q * 0.5))
    maker = F.when(n % 4 == 0, "anthropic").otherwise("openai")
    none = F.lit(None).cast("double")
    rate5, rate1 = pricing.cache_write_rates(F.lit(3.0), none, none, maker)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", five.alias("five"), hour.cast("double").alias("hour"), rate5.alias("rate5"), rate1.alias("rate1"))


@query("""SELECT l_returnflag, floor(sum(l_quantity * 0.01) * 1e6 + 0.5) / 1e6 AS estimate_usd, floor(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_tax END) * 1e6 + 0.5) / 1e6 AS billed_usd,
floor(sum(CASE WHEN l_linenumber = 9 THEN l_discount END) * 1e6 + 0.5) / 1e6 AS tool_usd FROM lineitem GROUP BY 1""")
def cost_three_ledgers(spark, sf_dir):
    n = F.col("l_linenumber")
    columns = pricing.ledgers(F.col("l_quantity") * 0.01, F.when(n % 2 == 0, F.col("l_tax")), F.when(n == 9, F.col("l_discount")))
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", *columns)
    return lines.groupBy("l_returnflag").agg(*[money(F.sum(c)).alias(c) for c in ("estimate_usd", "billed_usd", "tool_usd")])


@query("SELECT o_custkey, floor(100.0 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) * 1e6 + 0.5) / 1e6 AS usd FROM orders GROUP BY 1")
def subscription_share(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    own = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("own"))
    total = orders.agg(F.sum("o_totalprice").alias("total"))
    return own.join(F.broadcast(total)).select("o_custkey", pricing.subscription_share(F.col("own"), F.lit(100.0), F.col("total")).alias("usd"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0.0 WHEN l_linenumber IN (2, 3, 4) THEN NULL ELSE l_tax END AS usd,
CASE WHEN l_linenumber = 1 THEN 'local' WHEN l_linenumber IN (2, 3, 4) THEN NULL ELSE 'price-book' END AS method, CASE l_linenumber WHEN 2 THEN 'no-usage' WHEN 3 THEN 'total-only' WHEN 4 THEN 'model-unpriced' END AS reason FROM lineitem""")
def estimate_ladder(spark, sf_dir):
    n = F.col("l_linenumber")
    est = pricing.estimate(n == 1, n != 2, n != 3, n != 4, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", est.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS searches, CASE l_suppkey % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.025 END AS each FROM lineitem)
SELECT l_orderkey, l_linenumber, floor(searches * each * 1e9 + 0.5) / 1e9 AS usd, searches IS NOT NULL AND each IS NULL AS unpriced FROM x""")
def search_lines(spark, sf_dir):
    n, maker = F.col("l_linenumber"), F.col("l_suppkey") % 3
    searches = F.when(n % 3 != 0, F.col("l_quantity"))
    each = F.when(maker == 0, 0.01).when(maker == 1, 0.025)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pricing.unit_line(searches, each).alias("usd"), pricing.unpriced_units(searches, each).alias("unpriced"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber IN (2, 3, 4) AS none, CASE WHEN l_suppkey % 3 = 0 THEN l_discount END AS listed, CASE WHEN l_suppkey % 2 = 0 THEN floor(l_quantity * 0.04 * 1e9 + 0.5) / 1e9 END AS premium, l_tax FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0.0 WHEN NOT none THEN l_tax ELSE coalesce(listed, premium) END AS usd,
CASE WHEN l_linenumber = 1 THEN 'local' WHEN NOT none THEN 'price-book' WHEN listed IS NOT NULL THEN 'list-price' WHEN premium IS NOT NULL THEN 'premium-requests' END AS method,
CASE l_linenumber WHEN 2 THEN 'no-usage' WHEN 3 THEN 'total-only' WHEN 4 THEN 'model-unpriced' END AS reason, NOT none OR listed IS NOT NULL AS complete FROM x""")
def fallback_estimates(spark, sf_dir):
    n, supplier = F.col("l_linenumber"), F.col("l_suppkey")
    estimated = pricing.estimate(n == 1, n != 2, n != 3, n != 4, F.col("l_tax"))
    premium = pricing.unit_line(F.when(supplier % 2 == 0, F.col("l_quantity")), F.lit(0.04))
    out = pricing.with_fallback(F.col("x"), F.when(supplier % 3 == 0, F.col("l_discount")), premium)
    lines = table(spark, sf_dir, "lineitem").withColumn("x", estimated)
    return lines.select("l_orderkey", "l_linenumber", out.alias("y")).select("l_orderkey", "l_linenumber", "y.*")


@query("""SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-03 16:00:00' AND isodow(ts) < 6 AND (hour(ts) BETWEEN 1 AND 3 OR hour(ts) BETWEEN 6 AND 9) THEN 2.0 ELSE 1.0 END AS multiplier FROM events""")
def peak_multipliers(spark, sf_dir):
    since = F.lit("2024-01-03 16:00:00").cast("timestamp")
    return events(spark, sf_dir).select("event_id", pricing.peak_multiplier(F.col("ts"), since, [(1, 4), (6, 10)], 2.0).alias("multiplier"))


@query("""WITH p AS (SELECT p_brand AS model, p_size AS version, max(p_retailprice) AS input FROM part WHERE p_brand < 'Brand#3' GROUP BY 1, 2),
o AS (SELECT DISTINCT p_brand AS model FROM part), k AS (SELECT model, 0 AS pos, 'none' AS key FROM o UNION ALL SELECT model, 1, 'Brand#1' || right(model, 1) FROM o UNION ALL SELECT model, 2, 'Brand#11' FROM o),
b AS (SELECT model, arg_min(key, pos) AS key FROM k WHERE key IN (SELECT model FROM p) AND model NOT IN (SELECT model FROM p) GROUP BY 1)
SELECT model, version, input FROM p UNION ALL SELECT b.model, version, input FROM b JOIN p ON b.key = p.model""")
def observed_model_prices(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "model")
    prices = part.where("model < 'Brand#3'").groupBy("model", F.col("p_size").alias("version")).agg(F.max("p_retailprice").alias("input"))
    observed = part.select("model", F.array(F.lit("none"), F.concat(F.lit("Brand#1"), F.right("model", F.lit(1))), F.lit("Brand#11")).alias("keys"))
    return pricing.expand_prices(prices, observed, "model", "keys")


@query("""WITH c AS (SELECT p_brand, l_shipdate AS seen, floor(max(p_retailprice) / 300) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
v AS (SELECT *, lag(rate) OVER (PARTITION BY p_brand ORDER BY seen) AS b, row_number() OVER (PARTITION BY p_brand ORDER BY seen) AS n FROM c)
SELECT p_brand, CASE WHEN n > 1 THEN epoch_us(seen) END AS effective_us, rate::BIGINT AS rate FROM v WHERE n = 1 OR rate IS DISTINCT FROM b""")
def sheet_versions(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    catalogs = joined.groupBy("p_brand", F.col("l_shipdate").cast("timestamp").alias("at")).agg(F.floor(F.max("p_retailprice") / 300).alias("rate"))
    return pricing.sheet_from_catalogs(catalogs, "p_brand", "at", ["rate"]).select("p_brand", F.unix_micros("effective_from").alias("effective_us"), "rate")


@query("""WITH p AS (SELECT 0 AS sheet_rank, p_brand || '-x' AS key, max(p_retailprice) AS input FROM part GROUP BY p_brand UNION ALL SELECT 1, p_brand, min(p_retailprice) FROM part GROUP BY p_brand),
r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '-y' ELSE p_brand || '-x' END AS k0, p_brand AS k1 FROM part),
c AS (SELECT p_partkey, 0 AS pos, k0 AS key FROM r UNION ALL SELECT p_partkey, 1, k1 FROM r),
h AS (SELECT c.p_partkey, arg_min(p.key, (sheet_rank, pos)) AS model_key, arg_min(p.input, (sheet_rank, pos)) AS input FROM c JOIN p USING (key) GROUP BY 1)
SELECT p_partkey, model_key, input FROM part LEFT JOIN h USING (p_partkey)""")
def sheet_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    none = F.lit(None).cast("timestamp").alias("effective_from")
    sheet = lambda rank, key, rate: part.groupBy("p_brand").agg(rate.alias("input")).select(F.lit(rank).alias("sheet_rank"), key.alias("model_key"), none, "input", F.col("input").alias("output"), F.col("input").alias("cached_input"))
    prices = sheet(0, F.concat("p_brand", F.lit("-x")), F.max("p_retailprice")).union(sheet(1, F.col("p_brand"), F.min("p_retailprice")))
    first = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("-y"))).otherwise(F.concat("p_brand", F.lit("-x")))
    requests = part.select("p_partkey", F.array(first, F.col("p_brand")).alias("keys"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    return pricing.lookup_price(requests, prices, "keys", "at", "p_partkey").select("p_partkey", "model_key", "input")


@query("""WITH x AS (SELECT p_partkey, ['openrouter/anthropic/Claude-3.5-Sonnet-20240620', 'gpt-4o-mini-2024-07-18', 'ollama/unknown-thing', 'GitHub/gemini-1.5-pro', 'weird', 'claude-opus-4-high-fast'][1 + p_partkey % 6] AS raw FROM part),
s AS (SELECT p_partkey, lower(raw) AS l, string_split(lower(raw), '/') AS g FROM x), n AS (SELECT *, regexp_replace(g[len(g)], '-20[0-9]{2}-?[0-9]{2}-?[0-9]{2}$', '') AS model FROM s)
SELECT p_partkey, model, CASE g[1] WHEN 'openrouter' THEN 'openrouter' WHEN 'ollama' THEN 'ollama' WHEN 'github' THEN 'github-copilot' END AS via,
CASE WHEN len(g) = 3 OR regexp_matches(model, 'claude') THEN 'anthropic' WHEN regexp_matches(model, '^gpt') THEN 'openai' WHEN regexp_matches(model, 'gemini') THEN 'google' WHEN g[1] = 'ollama' THEN 'local' ELSE 'unknown' END AS maker,
regexp_replace(model, '(-(high|fast))+$', '') AS base, CASE WHEN model LIKE '%-fast' THEN 'fast' END AS speed FROM n""")
def model_names(spark, sf_dir):
    raws = ["openrouter/anthropic/Claude-3.5-Sonnet-20240620", "gpt-4o-mini-2024-07-18", "ollama/unknown-thing", "GitHub/gemini-1.5-pro", "weird", "claude-opus-4-high-fast"]
    raw = F.element_at(F.array(*[F.lit(r) for r in raws]), (F.col("p_partkey") % 6 + 1).cast("int"))
    part = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    r = F.col("raw")
    return part.select("p_partkey", names.normalize_model(r).alias("model"), names.infer_via(r).alias("via"), names.infer_maker(r).alias("maker"), names.model_base(r).alias("base"), names.implied_speed(r).alias("speed"))


@query("""WITH x AS (SELECT p_partkey, ['refs/heads/main', 'HEAD', 'feature/a b', '(HEAD detached at 1a2b)', '0123456789abcdef0123456789abcdef01234567', '  dev '][1 + p_partkey % 6] AS raw FROM part)
SELECT p_partkey, ['main', NULL, 'feature/a b', NULL, NULL, 'dev'][1 + p_partkey % 6] AS branch FROM x""")
def branch_names(spark, sf_dir):
    raws = ["refs/heads/main", "HEAD", "feature/a b", "(HEAD detached at 1a2b)", "0123456789abcdef0123456789abcdef01234567", "  dev "]
    raw = F.element_at(F.array(*[F.lit(r) for r in raws]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", names.branch_name(raw).alias("branch"))
